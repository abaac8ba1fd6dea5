"""Benchmark decontamination with one Aho-Corasick automaton.

Wanted are the windows of ``width`` words of the normalised benchmark items (an item of
fewer words is one window). Each text is normalised and scanned once; matches are mapped
back to words and, for the operator's own output, to offsets in the original text.

Edge cases: a null or wordless text has no words and no hits; items without words have no
window; equal windows of several items count for each of them; an empty benchmark hits
nothing; repeated rows are scored alike; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import stage

#: Bytes that are no part of a word after lower-casing become blanks, A-Z become a-z.
_KEEP = {*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)}
_TABLE = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c in _KEEP else 0x20 for c in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

#: Bytes of benchmark text that one automaton holds; a larger benchmark is scanned in parts.
PART_BYTES = 8 << 20
#: Bytes of texts that a worker scans with one part before it builds the next one.
HELD_BYTES = 64 << 20


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split() if text else []


Found = list[tuple[int, int, int]]


class Matcher:
    """One Aho-Corasick automaton over the words of all items, a word being three characters.

    Every window of ``width`` words of an item holds exactly one block of ``width // 2`` words
    that starts at a multiple of ``width - width // 2 + 1``; only these blocks (and whole items
    of fewer words) are patterns, so the automaton grows with the words of the benchmark and
    not with its windows. An occurrence is grown over the equal words around it, and
    counts if a whole window is equal.
    """

    def __init__(self, items: list[tuple[int, str]], width: int):
        import ahocorasick

        self.width, self.block = width, max(1, width // 2)
        self.codes: dict[bytes, int] = {}
        self.items: list[tuple[int, array]] = []
        places: dict[str, list[tuple[int, int]]] = {}
        for item, text in items:
            ids = array("i", [self.codes.setdefault(w, len(self.codes) + 1) for w in words_of(text)])
            if not ids:
                continue
            n, own = len(ids), len(self.items)
            self.items.append((item, ids))
            step, size = (width - self.block + 1, self.block) if n >= width else (1, n)
            for at in range(0, n - size + 1, step):
                places.setdefault("".join(map(_coded, ids[at : at + size])), []).append((own, at))
        self.lines = {w: _coded(i) for w, i in self.codes.items()}
        self.auto = ahocorasick.Automaton()
        for pattern, where in places.items():
            self.auto.add_word(pattern, (len(pattern) // 3, where))
        self.auto.make_automaton()

    def scan(self, words: list[bytes]) -> Found:
        """(first word, end word, item) of each stretch of ``words`` that consists of windows of the item."""
        if not self.items or not words:
            return []
        line, ids = self.lines.get, None
        found: Found = []
        for last, (size, places) in self.auto.iter("".join([line(w, _OTHER) for w in words])):
            start = last // 3 + 1 - size
            ids = ids or [self.codes.get(w, 0) for w in words]
            for own, at in places:
                item, of = self.items[own]
                if list(of[at : at + size]) != ids[start : start + size]:
                    continue  # equal characters of different words, in a very large vocabulary
                reach = self.width - size if len(of) >= self.width else 0
                a = b = 0
                while a < reach and a < at and a < start and of[at - a - 1] == ids[start - a - 1]:
                    a += 1
                while b < reach and at + size + b < len(of) and start + size + b < len(ids) and of[at + size + b] == ids[start + size + b]:
                    b += 1
                if a + size + b >= min(self.width, len(of)):
                    found.append((start - a, start + size + b, item))
        return found


def _coded(i: int) -> str:
    """Three characters for a word's number; the first is of a range of its own, so matches start at words."""
    return chr(256 + (i >> 14 & 127)) + chr(1 + (i >> 7 & 127)) + chr(1 + (i & 127))


#: A word of no item.
_OTHER = _coded(0)


def hit_runs(found: Found) -> list[tuple[int, int]]:
    """Union of the occurrences as [first, end) runs of words."""
    runs: list[list[int]] = []
    for a, b, _ in sorted(found):
        if runs and a <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], b)
        else:
            runs.append([a, b])
    return [(a, b) for a, b in runs]


class Scanner:
    """Occurrences of the benchmark in batches of texts, for use inside ``mapInArrow``.

    The benchmark lies staged in the shared folder in parts of about ``part_bytes``. With one
    part its automaton is built once in each Python worker; with more, a worker holds
    HELD_BYTES of texts at a time, scans them with one part after the other and keeps one automaton.
    """

    def __init__(self, benchmark: DataFrame, width: int, item: str, text: str, part_bytes: int):
        size = benchmark.agg(F.sum(F.octet_length(text))).first()[0] or 0
        self.width, self.token, n = width, uuid.uuid4().hex, max(1, -(-int(size) // part_bytes))
        part = F.pmod(F.xxhash64(item, text), F.lit(n))
        rows = benchmark.select(F.col(item).alias("i"), F.col(text).alias("t"), part.cast("int").alias("p"))
        context = benchmark.sparkSession.sparkContext
        staged = stage(rows, "benchmark") if n > 1 else rows
        self.parts = [context.broadcast([(r.i, r.t) for r in staged.where(F.col("p") == k).collect()]) for k in range(n)]

    def matcher(self, part: int) -> Matcher:
        if _BUILT.get("of") != (self.token, part):
            _BUILT.clear()
            _BUILT.update(of=(self.token, part), matcher=Matcher(self.parts[part].value, self.width))
        return _BUILT["matcher"]

    def scan(self, batches: Iterator[pa.RecordBatch], text: int) -> Iterator[tuple[pa.RecordBatch, list[tuple[int, Found]]]]:
        """Each batch with (words, occurrences) of each of its texts."""
        held: list[tuple[pa.RecordBatch, list[tuple[int, Found]]]] = []
        size = 0
        for batch in batches:
            if len(self.parts) == 1:
                words = map(words_of, batch.column(text).to_pylist())
                yield batch, [(len(w), self.matcher(0).scan(w)) for w in words]
                continue
            held.append((batch, []))
            size += batch.nbytes
            if size >= HELD_BYTES:
                yield from self._all_parts(held, text)
                held, size = [], 0
        yield from self._all_parts(held, text)

    def _all_parts(self, held, text: int):
        for part in range(len(self.parts) if held else 0):
            matcher = self.matcher(part)
            for batch, out in held:
                for i, value in enumerate(batch.column(text)):
                    words = words_of(value.as_py())
                    if part == 0:
                        out.append((len(words), []))
                    out[i][1].extend(matcher.scan(words))
        yield from held


#: The automaton that this Python worker built last.
_BUILT: dict = {}


SCHEMA = (
    "doc_id long, n_words long, n_hit long, items array<long>, "
    "spans array<struct<start: int, end: int>>"
)


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, width: int = 10, key: str = "doc_id", text: str = "text",
    item: str = "item_id", item_text: str = "text", part_bytes: int = PART_BYTES,
) -> DataFrame:
    """doc_id, n_words, n_hit, items hit and hit spans (code points of the original text).

    Texts never leave their partition.
    """
    scanner = Scanner(benchmark, width, item, item_text, part_bytes)

    def scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in scanner.scan(batches, 1):
            hits, items, spans = [], [], []
            for i, (_, occurrences) in enumerate(found):
                runs = hit_runs(occurrences)
                hits.append(sum(b - a for a, b in runs))
                items.append(sorted({x for *_, x in occurrences}))
                at = [m.span() for m in _WORD.finditer(batch.column(1)[i].as_py())] if runs else []
                spans.append([{"start": at[a][0], "end": at[b - 1][1]} for a, b in runs])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).cast(pa.int64()), pa.array([n for n, _ in found], pa.int64()), pa.array(hits, pa.int64()),
                    pa.array(items, pa.list_(pa.int64())),
                    pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                ],
                names=["doc_id", "n_words", "n_hit", "items", "spans"],
            )

    return docs.select(F.col(key), F.col(text)).mapInArrow(scan_batches, SCHEMA)


def items_digest(items: list[int]) -> str:
    return hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()


def clean(
    docs: DataFrame, benchmark: DataFrame, width: int = 10, text: str = "text",
    item: str = "item_id", item_text: str = "text", part_bytes: int = PART_BYTES,
) -> DataFrame:
    """The rows of ``docs`` that ``find_contamination`` does not hit, columns unchanged; no shuffle."""
    scanner = Scanner(benchmark, width, item, item_text, part_bytes)
    at = docs.columns.index(text)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in scanner.scan(batches, at):
            yield batch.filter(pa.array([not occurrences for _, occurrences in found], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
