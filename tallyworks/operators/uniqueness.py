"""Unique inserts: duplicates within a batch, against live jobs and against finished ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def in_batch(rows: DataFrame) -> DataFrame:
    """(seq, kind, first_seq, first_states, action): insert, duplicate of the first, or a later round.

    Minima by (kind, key) with partial aggregation, then a join that AQE splits: a key that a
    third of the batch shares is no one task's work.
    """
    first = rows.groupBy("kind", "unique_key").agg(F.min(F.struct("seq", "finished_states")).alias("f"))
    joined = rows.join(first, ["kind", "unique_key"])
    action = F.when(F.col("seq") == F.col("f.seq"), "insert").when(same_states(F.col("finished_states"), F.col("f.finished_states")), "duplicate")
    return joined.select("seq", "kind", F.col("f.seq").alias("first_seq"), action.otherwise("later").alias("action"))


def live_conflicts(rows: DataFrame, live: DataFrame) -> DataFrame:
    """Rows whose (kind, unique_key) a live job has, with what replacing it may change (nothing while it runs)."""
    held = live.where("unique_key IS NOT NULL").groupBy("kind", "unique_key").agg(F.min(F.struct(F.col("id"), F.col("state"))).alias("h"))
    return rows.join(held, ["kind", "unique_key"]).select(
        F.col("seq"), F.col("h.id").alias("live_id"), F.when(F.col("h.state") == "running", "keep").otherwise("replace").alias("action")
    )


def finished_duplicates(rows: DataFrame, finished: DataFrame, states: tuple[str, ...]) -> DataFrame:
    """For each row the latest finished job of its kind and key, in one of ``states``."""
    latest = finished.where(F.col("state").isin(*states) & F.col("unique_key").isNotNull()).groupBy("kind", "unique_key").agg(
        F.max_by(F.struct("id", "state", "finalized_at"), F.struct("finalized_at", "id")).alias("d")
    )
    return rows.join(latest, ["kind", "unique_key"]).select("seq", F.col("d.id").alias("finished_id"), F.col("d.state").alias("finished_state"))


def insert_many(rows: DataFrame, live: DataFrame) -> DataFrame:
    """New live jobs of a batch: first of each key, no live job with it; rows without a key always."""
    free = rows.where("unique_key IS NULL")
    order = Window.partitionBy("kind", "unique_key").orderBy("seq")
    first = rows.where("unique_key IS NOT NULL").withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
    new = first.join(live.where("unique_key IS NOT NULL").select("kind", "unique_key"), ["kind", "unique_key"], "left_anti")
    return free.unionByName(new.select(*rows.columns))


def same_states(a: Column, b: Column) -> Column:
    """Whether two comma-separated lists of states hold the same set; two nulls do."""
    as_set = lambda c: F.array_sort(F.array_distinct(F.split(c, ",")))
    return as_set(a).eqNullSafe(as_set(b))


def replace_live(rows: DataFrame, live: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Live jobs after a replacing insert: the last incoming row of a key gives ``columns`` to its waiting job.

    Running jobs keep theirs; jobs without an incoming row are not returned.
    """
    last = rows.groupBy("kind", "unique_key").agg(F.max_by(F.struct(*columns), "seq").alias("new"))
    held = live.where("unique_key IS NOT NULL AND state <> 'running'").join(last, ["kind", "unique_key"])
    return held.withColumns({c: F.col(f"new.{c}") for c in columns}).select(*live.columns)
