"""Topic patterns: words between dots, ``*`` is one word, ``#`` any number of words."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def topic_regex(pattern: str) -> str:
    """An anchored regular expression in which a dot matches line breaks too.

    ``#`` between dots may vanish with one of them; ``#`` inside a word matches anything.
    """
    out = []
    for token in re.findall(r"\.#\.|\.#|#\.|#|\*|.", pattern, flags=re.DOTALL):
        out.append({".#.": r"(\..*)?\.", ".#": r"(\..*)?", "#.": r"(.*\.)?", "#": ".*", "*": "[^.]+"}.get(token) or re.escape(token))
    return "(?s)^" + "".join(out) + r"\z"


def topic_matches(topic: Column, pattern: str) -> Column:
    """Whether ``topic`` matches; plain patterns compare, prefix patterns use ``startswith``."""
    if not set("*#") & set(pattern):
        return topic == F.lit(pattern)
    if pattern == "#":
        return topic.isNotNull()
    return topic.rlike(topic_regex(pattern))
