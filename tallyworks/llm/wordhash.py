"""Vectorised words and word shingles of an Arrow string column, as 64-bit hashes.

A word's hash is a polynomial over its bytes, read off one running sum of the whole chunk;
shingle hashes combine word hashes. Every result is a pure function of the bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

U = np.uint64
#: Bytes of text handled at once (a longer single text is handled alone).
CHUNK_BYTES = 1 << 20
CHUNK_ROWS = 1 << 10
_P = U(0x9E3779B97F4A7C15 | 1)
_P_INVERSE = U(pow(int(_P), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser (a bijection), on a copy."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def salt(*values: int) -> np.uint64:
    """One 64-bit constant for a few small integers."""
    out = np.zeros(1, U)
    for v in values:
        out = mix(out * U(0x2545F4914F6CDD1D) + np.array([(v + 1) * 0x9E3779B97F4A7C15 % (1 << 64)], U))
    return out[0]


@lru_cache(maxsize=2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_P, _P_INVERSE):
        p = np.full(size, base, U)
        p[0] = U(1)
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def _lowered(byte: int) -> int:
    return byte + 32 if 0x41 <= byte <= 0x5A else byte


#: One random code a byte, equal for A-Z and a-z.
_CODE = mix(np.array([_lowered(b) for b in range(256)], U) * U(0xD1342543DE82EF95) + U(7))
#: Bytes of words: all but space and \t to \r.
NOT_BLANK = np.array([b != 0x20 and not 0x09 <= b <= 0x0D for b in range(256)])


def chunks(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets into them) of runs of rows; null counts as empty."""
    column = column.fill_null("").cast(pa.large_string())
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + CHUNK_BYTES, "right")) - 1)
        end = min(end, n, row + CHUNK_ROWS)
        own = offsets[row : end + 1]
        yield row, data[own[0] : own[-1]], own - own[0]
        row = end


def words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray = NOT_BLANK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and for each text (plus one) the index of its first word."""
    size = len(data)
    if not size:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    inside = is_word[data]
    edge = np.zeros(size + 1, bool)
    edge[offsets] = True
    before = np.empty(size, bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty(size, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One hash of each byte span, A-Z as a-z."""
    size = len(data)
    up, down = _powers(1 << max(10, (size - 1).bit_length()))
    running = np.zeros(size + 1, U)
    np.cumsum(_CODE[data] * up[:size], out=running[1:])
    spans = (running[ends] - running[starts]) * down[starts]
    return mix(spans + (ends - starts).astype(U) * U(0xA24BAED4963EE407))


def shingles(hashes: np.ndarray, first: np.ndarray, width: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its ``width``-word shingles.

    A text of fewer words has its whole sequence as one; one without words has none.
    """
    lanes = [salt(1, j) | U(1) for j in range(width)]
    n = len(hashes)
    rolled = np.zeros(max(0, n - width + 1), U)
    for j in range(width):
        rolled += hashes[j : j + len(rolled)] * lanes[j]
    rolled = mix(rolled)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(rolled[a : b - width + 1]))
        elif b > a:
            short = sum((hashes[a + j : a + j + 1] * lanes[j] for j in range(b - a)), np.zeros(1, U))
            out.append(mix(short ^ salt(2, b - a)))
        else:
            out.append(np.zeros(0, U))
    return out


def shingle_sets(column: pa.Array, width: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, sets) of runs of rows."""
    for row, data, offsets in chunks(column):
        starts, ends, first = words(data, offsets)
        yield row, shingles(span_hashes(data, starts, ends), first, width)
