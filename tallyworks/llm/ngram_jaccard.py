"""N-gram Jaccard self-join with parity sketches.

A document is its set of word shingles. XOR-hashing every shingle into one of K blocks gives
a parity sketch: a shingle in only one of two sets changes exactly one block. Sets with
Jaccard similarity of at least t differ in at most D = floor((1-t)/(1+t) * (|A|+|B|))
shingles, so with K = D + 1 + spare blocks at least spare + 1 blocks are equal (pigeonhole).
Sets are dealt into size bands, K is fixed a band, a set signs its own band and, if it is
near the upper edge, the next one. A block's 64-bit XOR is one join key.

* Blocks that are empty in a set would join unrelated sets. A set with at most ``spare``
  empty blocks leaves them out, which loses nothing. Another set signs again with the
  next seed, so any two similar sets share a seed at which one of them was regular.
* Equal sets sign alike and are one class from the start, whatever their number.
* Linked sets agree on at least as many blocks as a set has filled ones, less the largest
  difference that its size and band allow. A set that shares fewer keys with all others
  together leaves its buckets before any pair is formed.
* Candidates are stars, not pairs: each set of a bucket meets the bucket's smallest set. Links contract into components; buckets that
  hold several of these meet around the member that shares most keys with the others: near copies
  of one text are closer to it than to each other, so few of them stay apart.
* What then still holds several components is thinned by support: only shingles that sets of
  two components hold can be in a link that is still wanted. A set of n shingles, c of them
  supported, links with sets of at most ``reach`` = c (1+t)/t - n shingles, so it leaves every
  bucket in which no set of another component is small enough and reaches far enough. Sets
  just below the threshold go this way in linear time, as edits make shingles of their own.
* The rest is joined pairwise, behind the reach and the Hamming bound. Two sets that must share
  r keys meet among all but r - 1 of each set's keys, so those of the fullest buckets are left
  out. Every two sets that share a key were then compared, excluded or are in one component.
* The Hamming bound is that of a sketch of 512 parity bits, and for long sets of one with at
  least four bits for each shingle that may differ (longer ones fold onto shorter ones).
* Links are verified on the whole sets. Texts of a popular star are salted.
* Links are counted afterwards, if asked for: all sets of a component meet in salted blocks,
  which yield a count a set and no pairs. Copies weigh in with their number.

Sets and shingles are 64-bit hashes (two of 10^9 different sets collide with 3 % chance).

Edge cases: null, empty and blank texts have no shingle and link with nothing; a text of
fewer words than the width is one shingle; repeated rows are copies of each other; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .components import components, merged
from .store import limited_semi, release, small, stage
from .wordhash import U, mix, salt, shingle_sets

SEEDS = 6
SKETCH_LONGS = 8
#: Low bits of a key that name its band and seed.
GROUP_BITS = 10
#: Members of a star that one task verifies together.
STAR_SPLIT = 1_000
#: Sketches and pairs that are broadcast at most; more are joined by sort-merge.
BROADCAST_ROWS = 300_000
#: Size of the bitmap of shared keys (8 MB).
BITMAP_BITS = 26
#: Sets and shingles, on average, in one part of a component whose links are counted.
PART_SETS, PART_SHINGLES = 500, 500_000
#: Rounds of stars around other members (the first around central ones), and of thinning by support, before the pairwise round.
HUB_ROUNDS, SUPPORT_ROUNDS = 1, 3


@dataclass(frozen=True)
class Threshold:
    """Link when ``den * |A and B| >= num * |A or B|`` on shingles of ``width`` words."""

    width: int = 5
    num: int = 80
    den: int = 100

    def most_differing(self, total: int) -> int:
        """Largest symmetric difference of two linked sets with ``total`` elements in all."""
        return total * (self.den - self.num) // (self.den + self.num)


@lru_cache(maxsize=4)
def bands(rule: Threshold) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower edges of the size bands, blocks and spare blocks of each."""
    edges = [1]
    while rule.most_differing(2 * edges[-1]) == 0:
        edges[-1] += 1
    edges = [1, edges[0]] if edges[0] > 1 else [1]
    while edges[-1] < 1 << 40:
        edges.append(max(edges[-1] + 1, edges[-1] * rule.den * 5 // (rule.num * 4) + 1))
    blocks, spare = [], []
    for low, top in zip(edges, [e - 1 for e in edges[1:]] + [edges[-1]], strict=True):
        differing = rule.most_differing(2 * top)
        more, smallest = 0, -(-rule.num * low // rule.den)
        for _ in range(30 if differing >= 12 else 0):  # empty blocks that the smallest set expects, and a margin
            k = differing + 1 + more
            empty = k * math.exp(-smallest / k)
            more = min(math.ceil(empty + 1.5 * math.sqrt(empty)), differing)
        spare.append(more)
        blocks.append(0 if differing == 0 else differing + 1 + more)
    return np.array(edges, np.int64), np.array(blocks, np.int64), np.array(spare, np.int64)


def _sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    running = np.concatenate([np.zeros(1, U), np.cumsum(values, dtype=U)])
    ends = np.cumsum(sizes)
    return running[ends] - running[ends - sizes]


def set_ids(flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """One id a set, equal for equal sets; empty sets have 0."""
    ids = mix(_sums(mix(flat ^ salt(3)), sizes) + sizes.astype(U) * U(0x9E3779B97F4A7C15))
    ids[sizes == 0] = 0
    return ids


def parity_bits(flat: np.ndarray, sizes: np.ndarray, longs: int = SKETCH_LONGS) -> np.ndarray:
    """A sketch of parity bits, one row of ``longs`` (a power of two) integers a set."""
    width = 64 * longs
    owner = np.repeat(np.arange(len(sizes)), sizes)
    at = owner * width + (mix(flat ^ salt(4)) & U(width - 1)).astype(np.int64)
    odd = (np.bincount(at, minlength=len(sizes) * width) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64).reshape(len(sizes), longs)


def wide_sketches(sets: list[np.ndarray], rule: Threshold) -> list[np.ndarray | None]:
    """The long sketch of each set for which the short one has too few bits, else None."""
    out: list[np.ndarray | None] = []
    for s in sets:
        longs = 1 << max(0, 4 * rule.most_differing(2 * len(s)) - 1).bit_length() >> 6
        out.append(parity_bits(s, np.array([len(s)]), longs)[0] if longs > SKETCH_LONGS else None)
    return out


def flips(a: np.ndarray, b: np.ndarray) -> int:
    """Differing bits of two sketches, the longer one folded onto the shorter one."""
    while len(a) != len(b):
        a, b = (a, b) if len(a) > len(b) else (b, a)
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    return int(np.bitwise_count((a ^ b).view(U)).sum())


def _sign(flat: np.ndarray, sizes: np.ndarray, tags: np.ndarray, rule: Threshold) -> tuple[np.ndarray, np.ndarray]:
    """Keys of sets that all sign one band each, and the set that each key is of."""
    _, all_blocks, all_spare = bands(rule)
    keys, owners = [], []
    todo = np.flatnonzero(all_blocks[tags] > 0)
    starts = np.cumsum(sizes) - sizes
    for seed in range(SEEDS):
        if not len(todo):
            break
        n, k = sizes[todo], all_blocks[tags[todo]]
        base = np.cumsum(k) - k
        total = int(k.sum())
        own = np.repeat(np.arange(len(todo)), n)
        tokens = flat[np.repeat(starts[todo] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
        slot = base[own] + ((mix(tokens ^ salt(5, seed)) >> U(32)) * k[own].astype(U) >> U(32)).astype(np.int64)
        parity = np.zeros(total, U)
        np.bitwise_xor.at(parity, slot, mix(tokens ^ salt(6, seed)))
        filled = np.bincount(slot, minlength=total) > 0
        block_of = np.repeat(np.arange(len(todo)), k)
        name = (tags[todo][block_of] * (1 << 32) + np.arange(total) - base[block_of]).astype(U)
        group = (tags[todo][block_of] * SEEDS + seed).astype(U)
        key = mix(parity ^ mix(name ^ salt(7, seed))) >> U(GROUP_BITS) << U(GROUP_BITS) | group
        empty = k - np.bincount(block_of[filled], minlength=len(todo))
        odd_one = empty > all_spare[tags[todo]]
        kept = filled if seed < SEEDS - 1 else filled | odd_one[block_of]
        keys.append(key[kept])
        owners.append(todo[block_of[kept]])
        todo = todo[odd_one]
    if not keys:
        return np.zeros(0, U), np.zeros(0, np.int64)
    return np.concatenate(keys), np.concatenate(owners)


def signatures(sets: list[np.ndarray], rule: Threshold) -> list[np.ndarray]:
    """For each set its join keys."""
    sizes = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate([*sets, np.zeros(0, U)])
    edges, blocks, _ = bands(rule)
    tag = np.maximum(np.searchsorted(edges, sizes, "right") - 1, 0)
    keys, owners = _sign(flat, sizes, tag, rule)
    upper = np.minimum(tag + 1, len(edges) - 1)
    reach = np.flatnonzero((rule.den * sizes >= rule.num * edges[upper]) & (upper > tag))
    starts = np.cumsum(sizes) - sizes
    if len(reach):
        part = np.concatenate([flat[starts[i] : starts[i] + sizes[i]] for i in reach.tolist()])
        more, own = _sign(part, sizes[reach], upper[reach], rule)
        keys, owners = np.concatenate([keys, more]), np.concatenate([owners, reach[own]])
    order = np.argsort(owners, kind="stable")
    cuts = np.cumsum(np.bincount(owners, minlength=len(sets)))
    return np.split(keys[order], cuts[:-1])


_SKETCH = [f"s{i}" for i in range(SKETCH_LONGS)]


def sketch_documents(docs: DataFrame, rule: Threshold, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, sid (id of the set), sketches and join keys; one scan, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, sets in shingle_sets(batch.column(1), rule.width):
                sizes = np.array([len(s) for s in sets], np.int64)
                flat = np.concatenate([*sets, np.zeros(0, U)])
                keys = signatures(sets, rule)
                lengths = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
                bits = parity_bits(flat, sizes)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(row, len(sets)).cast(pa.int64()), pa.array(sizes),
                        pa.array(set_ids(flat, sizes).view(np.int64)),
                        *[pa.array(np.ascontiguousarray(bits[:, i])) for i in range(SKETCH_LONGS)],
                        pa.ListArray.from_arrays(pa.array(lengths), pa.array(np.concatenate([*keys, np.zeros(0, U)]).view(np.int64))),
                        pa.array(wide_sketches(sets, rule), pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "n_shingles", "sid", *_SKETCH, "keys", "wide"],
                )

    fields = ", ".join(f"{s} long" for s in ["doc_id", "n_shingles", "sid", *_SKETCH])
    return docs.select(F.col(key), F.col(text)).mapInArrow(run, f"{fields}, keys array<long>, wide array<long>")


def _near(rule: Threshold) -> Column:
    """The Hamming bound of the short sketches of a and b, and their sizes."""
    differing = sum((F.bit_count(F.col(f"a.{s}").bitwiseXOR(F.col(f"b.{s}"))) for s in _SKETCH), F.lit(0))
    most = (F.col("a.n") + F.col("b.n")) * F.lit(rule.den - rule.num)
    fits = F.least("a.n", "b.n") * F.lit(rule.den) >= F.greatest("a.n", "b.n") * F.lit(rule.num)
    return fits & (differing * F.lit(rule.den + rule.num) <= most)


def _screen(pairs: DataFrame, sketches: DataFrame, wide: DataFrame, rule: Threshold) -> DataFrame:
    """The pairs (u, v, ...) that the Hamming bounds leave: of short sketches, then of long ones."""
    a, b = (small(sketches.select("*"), BROADCAST_ROWS).alias(x) for x in "ab")
    joined = pairs.join(a, F.col("u") == F.col("a.sid")).join(b, F.col("v") == F.col("b.sid")).where(_near(rule))
    return _screen_wide(joined.select(*[pairs[c] for c in pairs.columns], F.col("a.n").alias("na"), F.col("b.n").alias("nb")), wide, rule)


def _screen_wide(pairs: DataFrame, wide: DataFrame, rule: Threshold) -> DataFrame:
    """The pairs (u, v, ..., na, nb) within the Hamming bound of their long sketches; a set without one passes."""
    kept = [c for c in pairs.columns if c not in ("na", "nb")]
    both = pairs
    for end in "uv":
        both = both.join(wide.select(F.col("sid").alias(end), F.col("wide").alias(f"w{end}")), end, "left")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = len(kept)
            most = (batch.column(n).to_numpy() + batch.column(n + 1).to_numpy()) * (rule.den - rule.num)
            us, vs = batch.column(n + 2), batch.column(n + 3)
            near = np.ones(len(batch), bool)
            for i in np.flatnonzero(pc.and_(us.is_valid(), vs.is_valid()).to_numpy(zero_copy_only=False)).tolist():
                near[i] = flips(us[i].values.to_numpy(), vs[i].values.to_numpy()) * (rule.den + rule.num) <= most[i]
            yield batch.select(kept).filter(pa.array(near))

    return stage(both.select(*kept, "na", "nb", "wu", "wv").mapInArrow(compare, pairs.select(*kept).schema), "jaccard-screened")


def _texts(docs: DataFrame, sig: DataFrame, sids: DataFrame, rule: Threshold, key: str, text: str) -> DataFrame:
    """(sid, text), one text for each wanted set."""
    wanted = limited_semi(sig.select("doc_id", "sid"), sids, "sid").groupBy("sid").agg(F.min("doc_id").alias("doc_id"))
    ids = stage(wanted.select("doc_id").distinct(), "jaccard-ids")
    rows = limited_semi(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")), ids, "doc_id")

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, sets in shingle_sets(batch.column(1), rule.width):
                sizes = np.array([len(s) for s in sets], np.int64)
                ids = set_ids(np.concatenate([*sets, np.zeros(0, U)]), sizes).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(ids), batch.column(1).slice(row, len(sets))], names=["sid", "text"])

    found = stage(rows.mapInArrow(named, "sid long, text string"), "jaccard-texts")
    release(ids)
    if found.count() == sids.count():
        return found
    once = stage(found.join(small(sids), "sid", "left_semi").dropDuplicates(["sid"]), "jaccard-texts")  # keys repeat
    release(found)
    return once


def _verify(pairs: DataFrame, texts: DataFrame, rule: Threshold) -> DataFrame:
    """The pairs (u, v) whose whole sets are similar enough.

    v's texts travel to u's; a u of many pairs is dealt out in parts of about STAR_SPLIT.
    """
    pairs = stage(pairs, "jaccard-pairs")
    stars = pairs.groupBy("u").agg(F.ceil(F.count(F.lit(1)) / F.lit(STAR_SPLIT)).cast("int").alias("parts"))
    stars = small(stars, BROADCAST_ROWS)
    dealt = pairs.join(stars, "u").withColumn("part", F.pmod(F.xxhash64("v"), F.col("parts")).cast("int"))
    members = texts.join(small(dealt, BROADCAST_ROWS), F.col("v") == F.col("sid")).select("u", "part", "v", F.lit(1).alias("role"), "text")
    centres = texts.join(stars, F.col("u") == F.col("sid")).select(
        "u", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("u").alias("v"), F.lit(0).alias("role"), "text"
    )
    together = centres.union(members).repartition("u", "part").sortWithinPartitions("u", "part", "role", "v")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre_of, centre = None, np.zeros(0, U)
        for batch in batches:
            us, parts, vs, roles = (batch.column(i).to_pylist() for i in range(4))
            out: tuple[list[int], list[int]] = ([], [])
            for row, sets in shingle_sets(batch.column(4), rule.width):
                for i, s in enumerate(sets, row):
                    if roles[i] == 0:
                        centre_of, centre = (us[i], parts[i]), s
                    elif (us[i], parts[i]) == centre_of:
                        both = len(np.intersect1d(centre, s, assume_unique=True))
                        if rule.den * both >= rule.num * (len(centre) + len(s) - both):
                            out[0].append(us[i])
                            out[1].append(vs[i])
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["u", "v"])

    links = stage(together.mapInArrow(compare, "u long, v long"), "jaccard-links")
    release(pairs)
    return links


def _bitmap(keys: DataFrame) -> np.ndarray:
    """Bits of the lowest BITMAP_BITS bits of all keys' hashes, in words. Its size is fixed, whatever the number of keys."""
    low = F.shiftright("key", GROUP_BITS).bitwiseAND(F.lit((1 << BITMAP_BITS) - 1))
    bit = F.expr(f"shiftleft(1L, CAST(shiftright(key, {GROUP_BITS}) & 63 AS INT))")
    words = keys.groupBy(F.shiftright(low, 6).alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
    out = np.zeros(1 << (BITMAP_BITS - 6), np.int64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return out.view(U)


def needed(n: np.ndarray, group: np.ndarray, kept: np.ndarray, rule: Threshold) -> np.ndarray:
    """Keys that a set of ``n`` shingles shares with any set it links to, of the ``kept`` ones of a group."""
    edges, _, spare = bands(rule)
    tops = np.append(edges[1:] - 1, edges[-1])
    other = np.minimum(tops[group // SEEDS], n * rule.den // rule.num)
    blank = np.where(group % SEEDS == SEEDS - 1, spare[group // SEEDS], 0)  # keys of empty blocks that only one of two sets holds
    return np.maximum(1, kept - blank - (n + other) * (rule.den - rule.num) // (rule.den + rule.num))


def _shared_buckets(sig: DataFrame, rule: Threshold) -> DataFrame:
    """(key, sid) of the keys that two different sets share, for sets that share enough of them.

    Copies of a set are left out first, so a count tells shared keys and packs well. A bitmap
    of fixed size then keeps most other rows out of the second shuffle, and a join the rest;
    a bitmap too full to help costs that shuffle its savings and no result.
    """
    first = sig.groupBy("sid").agg(F.min("doc_id").alias("first"))
    copies = stage(sig.select("doc_id", "sid").join(first, "sid").where("doc_id <> first").select("doc_id", "sid").distinct(), "jaccard-copies")
    rows = limited_semi(sig, copies, ["doc_id", "sid"], "left_anti").select("sid", "n_shingles", "keys")
    shared = rows.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    shared = stage(shared, "jaccard-shared")
    bitmap = rows.sparkSession.sparkContext.broadcast(_bitmap(shared))

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            keys = lists.flatten().to_numpy().view(U)
            owner = np.repeat(np.arange(len(batch)), np.diff(lists.offsets.to_numpy()))
            low = (keys >> U(GROUP_BITS)) & U((1 << BITMAP_BITS) - 1)
            hit = (bitmap.value[(low >> U(6)).astype(np.int64)] >> (low & U(63))) & U(1) > 0
            code = (owner << GROUP_BITS) + (keys & U((1 << GROUP_BITS) - 1)).astype(np.int64)
            codes, at, kept = np.unique(code, return_inverse=True, return_counts=True)
            need = needed(batch.column(1).to_numpy()[codes >> GROUP_BITS], codes & ((1 << GROUP_BITS) - 1), kept, rule)
            hit &= (np.bincount(at[hit], minlength=len(codes)) >= need)[at]
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys[hit].view(np.int64)), pa.array(batch.column(0).to_numpy()[owner[hit]]), pa.array(need[at[hit]])],
                names=["key", "sid", "need"],
            )

    buckets = stage(rows.mapInArrow(marked, "key long, sid long, need long").join(shared, "key").distinct(), "jaccard-buckets")
    release(shared, copies)
    bitmap.unpersist()
    enough = stage(_enough(buckets), "jaccard-enough")
    release(buckets)
    return enough


def _enough(buckets: DataFrame) -> DataFrame:
    """The rows (key, sid, need) of sets that share as many keys of the group as they need."""
    group = F.col("key").bitwiseAND(F.lit((1 << GROUP_BITS) - 1)).alias("grp")
    met = buckets.groupBy("key").agg(F.count(F.lit(1)).alias("sets")).where("sets > 1").select("key")
    rows = buckets.join(met, "key").select("*", group)
    fit = rows.groupBy("sid", "grp").agg(F.count(F.lit(1)).alias("have"), F.max("need").alias("least")).where("have >= least")
    return rows.join(fit.select("sid", "grp"), ["sid", "grp"]).select("key", "sid", "need")


def _count_links(texts: DataFrame, found: DataFrame, sig: DataFrame, rule: Threshold) -> DataFrame:
    """(node, root, near): for each linked set the rows of all other sets that it is linked to.

    Links stay inside components. A component is dealt into parts, and every two parts (and
    each with itself) are one block, so a set's text is sent once a part and no pair is sent.
    """
    sizes = sig.groupBy("sid").agg(F.count(F.lit(1)).alias("copies"), F.min("n_shingles").alias("n"))
    rows = stage(found.withColumnRenamed("node", "sid").join(sizes, "sid"), "jaccard-members")
    need = F.greatest(F.count(F.lit(1)) / F.lit(PART_SETS), F.sum("n") / F.lit(PART_SHINGLES))
    large = stage(rows.groupBy("root").agg(F.ceil(need).cast("int").alias("parts")).where("parts > 1"), "jaccard-parts")
    dealt = rows.join(small(large, BROADCAST_ROWS), "root", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("sid"), F.col("parts")).cast("int")).select("sid", "root", "copies", "parts", "part")
    met = texts.join(small(dealt, BROADCAST_ROWS), "sid").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    blocks = met.select("root", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "sid", "copies", "text")
    blocks = blocks.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j", "part", "sid")

    def near_of(block: tuple[int, int, int], members: list[tuple[int, int, int, np.ndarray]]) -> np.ndarray:
        """The sum of the linked members' copies, for each member."""
        sizes = np.array([len(m[3]) for m in members], np.int64)
        copies = np.array([m[2] for m in members], np.int64)
        codes, at = np.unique(np.concatenate([m[3] for m in members]), return_inverse=True)
        ends = np.cumsum(sizes)
        mark, near = np.zeros(len(codes), np.int32), np.zeros(len(members), np.int64)
        split = sum(m[0] == block[1] for m in members)  # of two parts, the first meets the second only
        for a in range(len(members) - 1 if block[1] == block[2] else split):
            b = a + 1 if block[1] == block[2] else split
            if b == len(members):
                break
            own = at[ends[a] - sizes[a] : ends[a]]
            mark[own] = 1
            low = ends[b] - sizes[b]
            both = np.add.reduceat(mark[at[low:]], ends[b:] - sizes[b:] - low)
            mark[own] = 0
            hit = rule.den * both >= rule.num * (sizes[a] + sizes[b:] - both)
            near[a] += copies[b:][hit].sum()
            near[b:][hit] += copies[a]
        return near

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, members = None, []

        def told() -> pa.RecordBatch:
            near = near_of(block, members) if members else np.zeros(0, np.int64)
            return pa.RecordBatch.from_arrays([pa.array([m[1] for m in members], pa.int64()), pa.array(near)], names=["sid", "near"])

        for batch in batches:
            roots, firsts, seconds, parts, sids, copies = (batch.column(i).to_pylist() for i in range(6))
            for row, sets in shingle_sets(batch.column(6), rule.width):
                for i, s in enumerate(sets, row):
                    if (roots[i], firsts[i], seconds[i]) != block:
                        yield told()
                        block, members = (roots[i], firsts[i], seconds[i]), []
                    members.append((parts[i], sids[i], copies[i], s))
        yield told()

    near = blocks.mapInArrow(count, "sid long, near long").groupBy(F.col("sid").alias("node")).agg(F.sum("near").alias("near"))
    counted = stage(found.join(near, "node"), "jaccard-counted")
    release(rows, large)
    return counted


def link_sets(
    docs: DataFrame, sig: DataFrame, rule: Threshold, key: str = "doc_id", text: str = "text", links_too: bool = False
) -> DataFrame:
    """(node, root) of the sets that are linked to another set, and ``near`` of ``_count_links`` if asked for."""
    shared = _shared_buckets(sig, rule)
    buckets = shared
    drawn = limited_semi(sig, buckets.select("sid").distinct(), "sid").select("sid", F.col("n_shingles").alias("n"), *_SKETCH, "wide").dropDuplicates(["sid"])
    drawn = stage(drawn, "jaccard-sketches")
    sketches, wide = drawn.drop("wide"), drawn.where("wide IS NOT NULL").select("sid", "wide")
    texts = _texts(docs, sig, drawn.select("sid"), rule, key, text)
    used = [shared, drawn]

    def own(staged: DataFrame) -> DataFrame:
        used.append(staged)
        return staged

    def keep(df: DataFrame, label: str) -> DataFrame:
        return own(stage(df, label))

    hubs = buckets.groupBy("key").agg(F.min("sid").alias("u"))  # one row a bucket
    stars = buckets.join(hubs, "key").where("sid <> u").select("u", F.col("sid").alias("v")).distinct()
    tested = own(_screen(stars, sketches, wide, rule))
    links = own(_verify(tested, texts, rule))
    root = keep(merged(links), "jaccard-roots")

    for turn in range(HUB_ROUNDS):
        buckets = own(_open(buckets, root))
        if buckets.isEmpty():
            break
        hubs = _central(buckets) if turn == 0 else buckets.groupBy("key").agg(F.min_by(F.struct("sid", "comp"), F.xxhash64("sid", "key", F.lit(turn))).alias("hub"))
        met = buckets.join(hubs, "key").where(F.col("comp") != F.col("hub.comp"))
        pairs = met.select(F.least("sid", "hub.sid").alias("u"), F.greatest("sid", "hub.sid").alias("v")).distinct()
        pairs = own(_screen(pairs, sketches, wide, rule))
        found = own(_verify(_untested(pairs, tested), texts, rule))
        tested = tested.union(pairs)
        links = links.union(found)
        root = keep(merged(links), "jaccard-roots")

    left = own(_open(buckets, root))
    if not left.isEmpty():
        links = links.union(own(_pairwise(left, tested, texts, sketches, wide, rule, keep)))
    found = own(components(links))
    if links_too:
        found = _count_links(texts, found, sig, rule)
    else:
        used.remove(found)
    release(texts, *used)
    return found


def _pairwise(
    left: DataFrame, tested: DataFrame, texts: DataFrame, sketches: DataFrame, wide: DataFrame, rule: Threshold, keep: Callable[[DataFrame, str], DataFrame]
) -> DataFrame:
    """Links between components that share an open bucket, of pairs that are not tested yet."""
    left = _rarest(_supported(left, texts, rule, keep))
    left = keep(left.join(small(sketches, BROADCAST_ROWS).drop("n"), "sid"), "jaccard-left")
    a, b = left.alias("a"), left.alias("b")
    crossing = (F.col("a.key") == F.col("b.key")) & (F.col("a.sid") < F.col("b.sid")) & (F.col("a.comp") != F.col("b.comp"))
    reached = (F.col("a.n") <= F.col("b.reach")) & (F.col("b.n") <= F.col("a.reach"))
    pairs = a.join(b, crossing & reached & _near(rule))
    pairs = pairs.select(F.col("a.sid").alias("u"), F.col("b.sid").alias("v"), F.col("a.n").alias("na"), F.col("b.n").alias("nb")).distinct()
    screened = _screen_wide(pairs, wide, rule)
    links = _verify(_untested(screened, tested), texts, rule)
    release(screened)
    return links


def _rarest(left: DataFrame) -> DataFrame:
    """``left`` (key, sid, need, ...) without the rows at which no wanted pair needs to meet.

    Two sets that may still link share ``need`` keys of a group or more, all of them open. The
    first key that they share, in one order of all keys, is among the first have - need + 1 of
    each, of ``have`` keys that the set has there. Keys of few sets come first.
    """
    sizes = left.groupBy("key").agg(F.count(F.lit(1)).alias("sets"))
    rows = left.join(sizes, "key").withColumn("grp", F.col("key").bitwiseAND(F.lit((1 << GROUP_BITS) - 1)))
    own = Window.partitionBy("sid", "grp")
    at = F.row_number().over(own.orderBy("sets", "key"))
    rows = rows.withColumn("at", at).withColumn("have", F.count(F.lit(1)).over(own))
    return rows.where("at <= have - need + 1").select(*left.columns)


def _supported(left: DataFrame, texts: DataFrame, rule: Threshold, keep: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """The rows (key, sid, need, comp, n, reach) of open buckets whose sets may still link to another component.

    Linear in the shingles of the sets, whatever the size of a bucket: no two sets meet here.
    """

    def exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, sets in shingle_sets(batch.column(2), rule.width):
                sizes = np.array([len(s) for s in sets])
                ids, comps = (np.repeat(batch.column(i).to_numpy()[row : row + len(sets)], sizes) for i in (0, 1))
                flat = np.concatenate([*sets, np.zeros(0, U)]).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(comps), pa.array(flat)], names=["sid", "comp", "shingle"])

    sets = left.select("sid", "comp").distinct()
    rows = texts.join(small(sets, BROADCAST_ROWS), "sid").select("sid", "comp", "text")
    held = keep(rows.mapInArrow(exploded, "sid long, comp long, shingle long"), "jaccard-held")
    for turn in range(SUPPORT_ROUNDS):
        shared = held.groupBy("shingle").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x < y").select("shingle", F.lit(1).alias("one"))
        sizes = held.join(shared, "shingle", "left").groupBy("sid").agg(F.count(F.lit(1)).alias("n"), F.count("one").alias("c"))
        if turn:  # n counts all shingles of a set, so it is the same in every round
            left = left.drop("n", "reach")
        reach = (F.floor(F.col("c") * F.lit(rule.num + rule.den) / F.lit(rule.num)) - F.col("n")).alias("reach")
        sizes = keep(sizes.select("sid", "n", "c", reach).where("reach >= c").drop("c"), "jaccard-reach")
        sized = left.join(small(sizes, BROADCAST_ROWS), "sid")
        sized = keep(sized, "jaccard-sized")
        by = sized.groupBy("key", "comp").agg(F.max("reach").alias("far"), F.min("n").alias("least"))
        best = by.groupBy("key").agg(F.max(F.struct("far", "comp")).alias("f"), F.min(F.struct("least", "comp")).alias("l"))
        both = by.join(best, "key").groupBy("key").agg(
            F.first("f").alias("f"), F.first("l").alias("l"),
            F.max(F.when(F.col("comp") != F.col("f.comp"), F.col("far"))).alias("f2"),
            F.min(F.when(F.col("comp") != F.col("l.comp"), F.col("least"))).alias("l2"),
        )
        far = F.when(F.col("comp") == F.col("f.comp"), F.col("f2")).otherwise(F.col("f.far"))
        least = F.when(F.col("comp") == F.col("l.comp"), F.col("l2")).otherwise(F.col("l.least"))
        before = left.select("sid").distinct().count()
        left = keep(sized.join(both, "key").where((F.col("n") <= far) & (least <= F.col("reach"))).select(*sized.columns), "jaccard-thinned")
        after = left.select("sid").distinct()
        if after.count() > 0.9 * before:
            break
        held = keep(limited_semi(held, after, "sid"), "jaccard-held")
    return left


def _central(buckets: DataFrame) -> DataFrame:
    """(key, hub) of each bucket: the member that meets most other sets, summed over its open keys of the group.

    Near copies of one text differ from it less than from each other, and the text itself has the
    key that most of them have at every block. Linear: no two sets meet here.
    """
    rows = buckets.select("key", "sid", "comp", F.col("key").bitwiseAND(F.lit((1 << GROUP_BITS) - 1)).alias("grp"))
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("sets"))
    met = rows.join(sizes, "key").groupBy("sid", "grp").agg(F.sum("sets").alias("met"))
    return rows.join(met, ["sid", "grp"]).groupBy("key").agg(F.max_by(F.struct("sid", "comp"), F.struct("met", "sid")).alias("hub"))


def _open(buckets: DataFrame, root: DataFrame) -> DataFrame:
    """(key, sid, need, comp) of the keys whose sets are in several components."""
    mixed = buckets.join(small(root), F.col("sid") == F.col("node"), "left").select("key", "sid", "need", F.coalesce("root", "sid").alias("comp"))
    split = mixed.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x < y").select("key")
    split = stage(split, "jaccard-split-keys")
    rows = stage(limited_semi(mixed, split, "key"), "jaccard-split")
    release(split)
    return rows


def _untested(pairs: DataFrame, tested: DataFrame) -> DataFrame:
    known = tested.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    return pairs.join(known, ["u", "v"], "left_anti")


def jaccard_components(
    docs: DataFrame, rule: Threshold = Threshold(), key: str = "doc_id", text: str = "text", links_too: bool = False
) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links), set_id and root_id of every row.

    root_id is the smallest set_id of the component; keys that repeat can give two components one component_id.

    With ``links_too`` also n_links, the number of other rows that the row is linked to.
    """
    return _classes(docs, rule, key, text, links_too)[0]


def _classes(docs: DataFrame, rule: Threshold, key: str, text: str, links_too: bool = False) -> tuple[DataFrame, list[DataFrame]]:
    """The rows of ``jaccard_components`` and the staged tables that they are read from."""
    wide = stage(sketch_documents(docs, rule, key, text), "jaccard-sketched")
    root = link_sets(docs, wide, rule, key, text, links_too)
    sig = stage(wide.select("doc_id", "n_shingles", "sid"), "jaccard-sets")
    release(wide)
    named = sig.where("n_shingles > 0").groupBy("sid").agg(F.min("doc_id").alias("d"), F.count(F.lit(1)).alias("copies"))
    near = [(F.col("copies") - 1 + F.coalesce("near", F.lit(0))).alias("n_links")] if links_too else []
    rooted = named.join(root, F.col("sid") == F.col("node"), "left").select("sid", "d", F.coalesce("root", "sid").alias("root"), *near)
    least = rooted.groupBy("root").agg(F.min("d").alias("component_id"))
    links = ["n_links"] if links_too else []
    of_set = stage(rooted.join(least, "root").select("sid", "component_id", "root", *links), "jaccard-classes")
    release(root)
    rows = sig.select("doc_id", "n_shingles", "sid").join(of_set, "sid", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), F.col("sid").alias("set_id"),
        F.coalesce("root", "sid").alias("root_id"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in links],
    )
    return rows, [sig, of_set]


def keep_one(docs: DataFrame, rule: Threshold = Threshold(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` with the smallest key of their component, columns unchanged.

    Rows that repeat a key are told apart by their sets: one of a component stays, and a row
    goes only if its own text is linked to another. Rows without a key stay.
    """
    rows, parts = _classes(docs, rule, key, text)
    found = stage(rows.where("doc_id IS NOT NULL"), "jaccard-found")
    release(*parts)
    again = stage(found.groupBy("doc_id").count().where("count > 1").select("doc_id"), "jaccard-again")
    gone = found.where("doc_id <> component_id").select("doc_id").union(again)  # those that repeat are looked at below
    gone = stage(gone.distinct().withColumnRenamed("doc_id", key), "jaccard-dropped")
    kept = limited_semi(docs, gone, key, "left_anti")
    if again.isEmpty():
        release(found, again)
        return kept
    stays = limited_semi(found.where("doc_id = component_id"), again, "doc_id").groupBy("doc_id", "root_id")
    stays = stays.agg(F.min("set_id").alias("_set")).select(F.col("doc_id").alias(key), "_set").distinct()
    rows = limited_semi(docs, again.withColumnRenamed("doc_id", key), key)

    def with_set(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.zeros(0, np.int64)]
            for _, sets in shingle_sets(batch.column(batch.schema.get_field_index(text)), rule.width):
                sizes = np.array([len(s) for s in sets], np.int64)
                ids.append(set_ids(np.concatenate([*sets, np.zeros(0, U)]), sizes).view(np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(ids))], names=[*batch.schema.names, "_set"])

    rows = rows.mapInArrow(with_set, StructType([*docs.schema.fields, StructField("_set", LongType())]))
    rows = limited_semi(rows, stage(stays, "jaccard-stays"), [key, "_set"]).dropDuplicates([key, "_set"])
    return kept.union(rows.select(*docs.columns))
