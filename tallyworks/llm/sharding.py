"""Sharding by a hierarchical weighted hash tree.

A document descends region -> rack -> shard. At each level every child of the node reached so
far draws ``-ln(u) / weight`` from a hash of (document key, child) and the weight of its whole
subtree; the earliest draw wins, so a child is chosen in proportion to its weight. Three levels
cost regions + racks of one region + shards of one rack draws (11 for 40 shards), not one a shard.
If a weight changes, only the draws of that shard, its rack and its region change: rows move
between that region and others, that rack and its siblings, that shard and its siblings, and
nowhere else.

Shards that are appended race for themselves: the winning region's draw is an exponential draw
with the weight of the whole laid-out tree, so an appended shard whose own draw is earlier takes
its fair share, straight from everywhere into itself, and moves no other row. Lay the tree
out anew (and move rows) when many shards have been appended.

Edge cases: a null key hashes like any constant and gets one defined shard; a null text has
size ``overhead`` and CRC 0; repeated rows share a shard and get different slots; an empty
table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Parts that every shard's rows are dealt into for numbering; bounds the offset table.
SLOT_BUCKETS = 512
#: First number of the nodes of each kind, in hashes (fixed values: others place rows elsewhere).
REGION, RACK, SHARD, APPENDED = 1 << 40, 2 << 40, 3 << 40, 4 << 40


@dataclass(frozen=True)
class Tree:
    """Nested layout: shard s sits in rack s // shards_per_rack, and so on upwards.

    ``weights`` gives the weight of each laid-out shard (default 1.0); racks and regions weigh
    what their shards weigh. ``appended`` holds the weights of shards added since.
    """

    shards: int
    shards_per_rack: int = 4
    racks_per_region: int = 4
    weights: tuple[float, ...] | None = None
    appended: tuple[float, ...] = ()

    def __post_init__(self) -> None:
        if self.shards < 1 or (self.weights is not None and len(self.weights) != self.shards):
            raise ValueError("a tree needs one weight for each of its shards")
        if min([*self.leaf_weights(), *self.appended]) <= 0:
            raise ValueError("weights are positive")

    def leaf_weights(self) -> list[float]:
        return list(self.weights or [1.0] * self.shards)

    def level_weights(self) -> tuple[list[float], list[float], list[float]]:
        """Weights of regions, racks and shards."""
        leaves = self.leaf_weights()

        def grouped(of: list[float], by: int) -> list[float]:
            return [sum(of[i : i + by]) for i in range(0, len(of), by)]

        racks = grouped(leaves, self.shards_per_rack)
        return grouped(racks, self.racks_per_region), racks, leaves

    def grown(self, weight: float = 1.0) -> Tree:
        """The tree with one more shard at its end."""
        return replace(self, appended=(*self.appended, weight))


def _draw(key: Column, node: Column, weight: Column) -> Column:
    u = (F.shiftrightunsigned(F.xxhash64(key, node), 11).cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))
    return -F.log(u) / weight


def _earliest(draws: list[tuple[Column, Column]]) -> Column:
    """The struct (d, c) of the earliest draw; the smaller child wins a tie."""
    structs = [F.struct(d.alias("d"), c.alias("c")) for d, c in draws]
    return F.least(*structs) if len(structs) > 1 else structs[0]


def _children(key: Column, kind: int, parent: Column, fanout: int, weights: list[float]) -> Column:
    """The earliest child of ``parent`` among its ``fanout`` (the last parent may have fewer)."""
    known = F.array(*[F.lit(float(w)) for w in weights])
    draws = []
    for i in range(min(fanout, len(weights))):
        node = parent * F.lit(fanout) + F.lit(i)
        drawn = _draw(key, node + F.lit(kind), F.get(known, node.cast("int")))
        draws.append((F.coalesce(drawn, F.lit(float("inf"))), node))
    return _earliest(draws)


def descend(rows: DataFrame, tree: Tree, key: str) -> DataFrame:
    """``rows`` and the columns ``base_draw`` (the winning region's) and ``base_shard``."""
    k = F.col(key)
    regions, racks, leaves = tree.level_weights()
    tops = [(_draw(k, F.lit(REGION + i), F.lit(float(w))), F.lit(i).cast("long")) for i, w in enumerate(regions)]
    own = [F.col(c) for c in rows.columns]
    rows = rows.select(*own, _earliest(tops).alias("region"))
    rows = rows.select(*own, "region", _children(k, RACK, F.col("region.c"), tree.racks_per_region, racks).alias("rack"))
    shard = _children(k, SHARD, F.col("rack.c"), tree.shards_per_rack, leaves)["c"].cast("int")
    return rows.select(*own, F.col("region.d").alias("base_draw"), shard.alias("base_shard"))


def _raced(key: Column, tree: Tree) -> Column:
    """The shard over ``base_draw`` and ``base_shard``, appended shards included."""
    if not tree.appended:
        return F.col("base_shard")
    race = [(F.col("base_draw"), F.lit(-1))]
    race += [(_draw(key, F.lit(APPENDED + i), F.lit(float(w))), F.lit(i)) for i, w in enumerate(tree.appended)]
    won = _earliest(race)["c"]
    return F.when(won < 0, F.col("base_shard")).otherwise(won + F.lit(tree.shards))


def assign(docs: DataFrame, tree: Tree, key: str = "doc_id", text: str = "text", overhead: int = 16) -> DataFrame:
    """Size, CRC and shard of each row, before and after growth by one shard; no shuffle."""
    body, k = F.coalesce(F.col("body").cast("binary"), F.lit(b"")), F.col("k")
    placed = descend(docs.select(F.col(key).alias("k"), F.col(text).alias("body")), tree, "k")
    return placed.select(
        k.alias(key),
        (F.octet_length(body) + F.lit(overhead)).cast("long").alias("size"),
        F.crc32(body).cast("long").alias("text_crc32"),
        F.lit("key").alias("law"),
        _raced(k, tree).alias("shard"),
        _raced(k, tree.grown()).alias("grown_shard"),
    )


def number_slots(rows: DataFrame, tree: Tree, key: str = "doc_id", buckets: int = SLOT_BUCKETS) -> DataFrame:
    """Gapless slots from 0 within each shard, in two steps.

    A shard's rows are dealt into ``buckets`` parts by a hash, so no task gets a whole shard.
    Counts of the parts (at most shards x buckets rows, broadcast if they are few) give each
    part its first slot; ``row_number`` inside the part gives the rest. (A left join, as an inner
    one would push a null check on the shard, and with it all draws, below the projections.)
    """
    dealt = rows.withColumn("_part", F.pmod(F.xxhash64(F.col(key), F.lit("slot")), F.lit(buckets)).cast("int"))
    counts = dealt.groupBy("shard", "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("shard", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    within = Window.partitionBy("shard", "_part").orderBy(key, "text_crc32", "size")
    numbered = dealt.withColumn("_i", F.row_number().over(within))
    few = (tree.shards + len(tree.appended)) * buckets <= 1_000_000
    return (
        numbered.join(F.broadcast(first) if few else first, ["shard", "_part"], "left")
        .withColumn("slot", (F.col("_first") + F.col("_i") - 1).cast("long"))
        .drop("_part", "_first", "_i")
    )


def shard_documents(docs: DataFrame, shards: int = 40, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Shard, slot and the shard after growth by one for every row of ``docs``."""
    tree = Tree(shards)
    return number_slots(assign(docs, tree, key, text), tree, key).select(
        F.col(key), "size", "text_crc32", "law", "shard", "slot", "grown_shard"
    )
