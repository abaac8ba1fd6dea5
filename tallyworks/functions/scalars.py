"""Column functions and pure functions of the work ledger."""

from __future__ import annotations

import json
import re
from datetime import datetime, timedelta
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the retry schedule, in seconds.
BACKOFF_BASE, BACKOFF_CAP, ORDERED_CAP = 5, 86_400, 300
#: Longest unique key, in bytes.
MOST_KEY_BYTES = 1024


def backoff_seconds(attempt: Column, jitter: Column | None = None, ordered: Column | None = None) -> Column:
    """attempt^4 + 5 s up to a day, times 1 + jitter; deliveries in order wait 5 minutes at most."""
    delay = F.least(F.pow(attempt.cast("double"), 4) + BACKOFF_BASE, F.lit(float(BACKOFF_CAP)))
    if ordered is not None:
        delay = F.when(ordered, F.least(delay, F.lit(float(ORDERED_CAP)))).otherwise(delay)
    return delay if jitter is None else delay * (F.lit(1.0) + jitter)


def exponential_seconds(attempt: Column, base: float, cap: float) -> Column:
    """base, twice as much for every attempt after the first, up to cap; attempts count from 1."""
    return F.least(F.lit(base) * F.pow(F.lit(2.0), F.greatest(attempt, F.lit(1)) - 1), F.lit(cap))


def available_tokens(rate: Column, burst: Column, tokens: Column, refilled_at: Column, as_of: Column) -> Column:
    """Tokens in a bucket at ``as_of``; null without a rate. Without a burst the rate, rounded up, is the capacity."""
    capacity = F.when(burst > 0, burst.cast("double")).otherwise(F.ceil(rate).cast("double"))
    elapsed = F.coalesce((F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(refilled_at.cast("timestamp"))) / 1e6, F.lit(0.0))
    filled = F.when(tokens.isNull(), capacity).otherwise(F.least(capacity, tokens + rate * elapsed))
    return F.when(rate > 0, filled)


def canonical_json(value) -> str:
    """Objects with sorted keys, without blanks."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def unique_key(args=None, queue: str | None = None, period: timedelta | None = None, now: datetime | None = None) -> str:
    """Key of the chosen parts: ``a=<sorted JSON>``, ``q=<queue>``, ``p=<start of the period>``; ``*`` for none."""
    parts = []
    if args is not None:
        parts.append("a=" + canonical_json(args))
    if queue is not None:
        parts.append("q=" + queue)
    if period is not None:
        zero = datetime(1, 1, 1, tzinfo=now.tzinfo)  # periods count from the year 1
        start = zero + ((now - zero) // period) * period
        parts.append("p=" + start.strftime("%Y-%m-%dT%H:%M:%SZ"))
    key = "\n".join(parts) or "*"
    if len(key.encode()) > MOST_KEY_BYTES:
        raise ValueError(f"unique key over {MOST_KEY_BYTES} bytes")
    return key


def decode_json(text: str):
    """JSON with numbers as exact decimals; refuses numbers beyond 131072 digits before or 16383 after the point."""

    def number(x: str) -> Decimal:
        d = Decimal(x)
        if d and (d.adjusted() >= 131072 or -d.as_tuple().exponent > 16383):
            raise ValueError(f"number out of range: {x[:40]}")
        return d

    return json.loads(text, parse_float=number, parse_int=number, parse_constant=lambda c: (_ for _ in ()).throw(ValueError(c)))


def json_contains(have, want) -> bool:
    """Whether ``have`` contains ``want``: every member of ``want`` has its match, order and repetition aside.

    A scalar is also contained in an array of which it is an element, but only as the whole of ``want``.
    """
    if isinstance(have, list) and not isinstance(want, (list, dict)):
        return any(_matches(h, want) for h in have)
    return _matches(have, want)


def _matches(have, want) -> bool:
    if type(have) is not type(want):
        return False
    if isinstance(have, dict):
        return want.keys() <= have.keys() and all(_matches(have[k], want[k]) for k in want)
    if isinstance(have, list):
        return all(any(_matches(h, w) for h in have) for w in want)
    return have == want


def metadata_contains(column: str, wanted: dict) -> Column:
    """``column`` (JSON text) contains the object ``wanted``.

    Nested objects of integers, strings and booleans become comparisons of extracted values,
    inside the JVM; other filters go through an Arrow UDF.
    """
    leaves: list[tuple[str, object]] = []

    def flat(value: dict, path: str) -> bool:
        for k, v in value.items():
            if not re.fullmatch(r"\w+", k):
                return False
            if isinstance(v, dict) and v:
                if not flat(v, f"{path}.{k}"):
                    return False
            elif isinstance(v, (bool, int, str)):
                leaves.append((f"{path}.{k}", v))
            else:
                return False
        return True

    if wanted and flat(wanted, "$"):
        parsed = F.try_parse_json(F.col(column))
        out = F.lit(True)
        for path, v in leaves:
            kind = "boolean" if isinstance(v, bool) else "decimal(38,10)" if isinstance(v, int) else "string"
            is_kind = F.schema_of_variant(F.variant_get(parsed, path, "variant")) if not isinstance(v, bool) and isinstance(v, int) else None
            hit = F.try_variant_get(parsed, path, kind) == F.lit(v)
            out = out & (hit if is_kind is None else hit & ~is_kind.isin("STRING", "BOOLEAN"))
        return F.coalesce(out, F.lit(False))

    @F.pandas_udf("boolean")
    def contains(texts: pd.Series) -> pd.Series:
        target = decode_json(json.dumps(wanted))
        return texts.map(lambda t: t is not None and json_contains(decode_json(t), target))

    return contains(F.col(column))


def valid_tags(tags: list[str]) -> list[str]:
    """Distinct tags in order; each 1 to 255 bytes without control characters, 64 at most."""
    out = list(dict.fromkeys(tags))
    if len(out) > 64 or any(not 1 <= len(t.encode()) <= 255 or re.search(r"[\x00-\x1f\x7f]", t) for t in out):
        raise ValueError("invalid tag filter")
    return out


def visible(xid: Column, snapshot: Column) -> Column:
    """Whether a transaction is visible in a snapshot (xmin, xmax, xip)."""
    running = F.array_contains(snapshot["xip"], xid)
    return (xid < snapshot["xmin"]) | ((xid < snapshot["xmax"]) & ~running)


def canonical_json_column(text: Column) -> Column:
    """JSON text with sorted keys and without blanks, in the JVM; null for text that is no JSON."""
    return F.to_json(F.try_parse_json(text))


def period_start(ts: Column, seconds: int) -> Column:
    """Start of the period that holds ``ts``; periods count from the first of January of the year 1."""
    zero = 62_135_596_800 * 1_000_000
    micros = F.unix_micros(ts.cast("timestamp")) + F.lit(zero)
    return F.timestamp_micros(micros - F.pmod(micros, F.lit(seconds * 1_000_000)) - F.lit(zero)).cast("timestamp_ntz")


def unique_key_column(args: Column | None = None, queue: Column | None = None, period: Column | None = None) -> Column:
    """``unique_key`` over columns: JSON arguments, queue and the start of a period; over-long keys raise."""
    parts = []
    if args is not None:
        parts.append(F.concat(F.lit("a="), canonical_json_column(args)))
    if queue is not None:
        parts.append(F.concat(F.lit("q="), queue))
    if period is not None:
        parts.append(F.concat(F.lit("p="), F.date_format(period, "yyyy-MM-dd'T'HH:mm:ss'Z'")))
    key = F.concat_ws("\n", *parts) if parts else F.lit("*")
    return F.when(F.octet_length(key) > MOST_KEY_BYTES, F.raise_error(F.lit(f"unique key over {MOST_KEY_BYTES} bytes"))).otherwise(key)


def uuid7(at: Column, random_hex: Column) -> Column:
    """A version 7 UUID: milliseconds of ``at``, then bits of ``random_hex`` (20 hex digits or more)."""
    ms = F.lpad(F.lower(F.hex(F.floor(F.unix_micros(at.cast("timestamp")) / 1000).cast("long"))), 12, "0")
    variant = F.lower(F.hex(F.conv(F.substring(random_hex, 4, 1), 16, 10).cast("int").bitwiseAND(F.lit(3)) + F.lit(8)))
    return F.concat_ws(
        "-", F.substring(ms, 1, 8), F.substring(ms, 9, 4), F.concat(F.lit("7"), F.substring(random_hex, 1, 3)),
        F.concat(variant, F.substring(random_hex, 5, 3)), F.substring(random_hex, 8, 12),
    )


def small_int(value: Column) -> Column:
    """``value`` as a 16-bit integer; others raise."""
    fits = value.between(-(1 << 15), (1 << 15) - 1)
    return F.when(value.isNull() | fits, value.cast("short")).otherwise(F.raise_error(F.lit("not a 16-bit integer")))


def clean_tags(tags: Column) -> Column:
    """The distinct non-empty tags in their order; null for none."""
    kept = F.filter(F.array_distinct(tags), lambda t: t.isNotNull() & (t != ""))
    return F.when(F.size(kept) > 0, kept)


def merged_objects(first: Column, second: Column) -> Column:
    """JSON objects merged at the top level, the second one's members winning, in canonical form; null is empty."""
    a, b = (F.coalesce(F.from_json(c, "map<string, variant>"), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<variant>"))) for c in (first, second))
    return canonical_json_column(F.to_json(F.map_concat(F.map_filter(a, lambda k, _: ~F.array_contains(F.map_keys(b), k)), b)))


def position_text(xid: Column, seq: Column) -> Column:
    """A log position as text, ``xid:seq``."""
    return F.concat_ws(":", xid.cast("string"), seq.cast("string"))


def parse_position(text: Column) -> Column:
    """(xid, seq) of a position's text; null if it is none."""
    parts = F.when(F.regexp_like(text, F.lit(r"^\d{1,18}:\d{1,18}$")), F.split(text, ":"))
    return F.when(parts.isNotNull(), F.struct(F.get(parts, F.lit(0)).cast("long").alias("xid"), F.get(parts, F.lit(1)).cast("long").alias("seq")))
