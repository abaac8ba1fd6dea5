"""Connected components of an edge table, by alternating large and small stars.

All links stay distributed. Each round is written to the shared folder, so a lost executor
costs one round at most; star-like graphs are done in two or three rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import release, stage


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of u is linked to the smallest of u and its neighbours."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of u, and u, are linked to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def merged(edges: DataFrame) -> DataFrame:
    """(node, root) after two hops: equal roots mean one component, the converse may not hold yet.

    Enough to contract stars between rounds of a join; three exchanges and no loop.
    """
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    near = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    far = both.join(near.select(F.col("u").alias("v"), "m"), "v").groupBy("u").agg(F.min("m").alias("m"))
    return far.select(F.col("u").alias("node"), F.col("m").alias("root"))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(u, v) links to (node, root), as a staged table: root is the smallest node of the component.

    The first round reads ``edges`` twice, so these should come from written tables. Nodes without a link do not appear; an empty table gives an empty result.
    """
    now, spent, before = edges.select("u", "v").where("u <> v"), [], None
    for _ in range(max_rounds):
        now = stage(_small_star(_large_star(now)), "stars")
        release(*spent)
        spent = [now]
        mark = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if mark == before:
            break
        before = mark
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    out = stage(now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots), "components")
    release(now)
    return out
