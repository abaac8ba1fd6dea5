"""Sinks: bulk append, log append and the partitioned history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .transitions import with_positions


def append_jobs(rows: DataFrame, path: str) -> None:
    """Bulk append without uniqueness: new files beside the old ones; a failed append leaves none visible."""
    rows.write.mode("append").parquet(path)


def append_events(events: DataFrame, path: str, xid: int, first_seq: int, order: str) -> DataFrame:
    """Append events to a log that is partitioned by day, as one transaction ``xid`` with gapless seqs; gives what was added."""
    rows = with_positions(events, order, "_at").withColumn("seq", F.lit(first_seq) + F.col("_at")).withColumn("xid", F.lit(xid).cast("long"))
    rows = rows.drop("_at").withColumn("day", F.to_date("created_at"))
    rows.write.mode("append").partitionBy("day").parquet(path)
    return rows


def archive(finished: DataFrame, path: str) -> None:
    """Append finished jobs to the history, partitioned by outcome and day so that scans and retention prune."""
    outcome = F.when(F.col("state") == "completed", "completed").otherwise("failed")
    rows = finished.withColumn("outcome", outcome).withColumn("day", F.to_date("finalized_at"))
    rows.repartition("outcome", "day").write.mode("append").partitionBy("outcome", "day").parquet(path)


def read_history(spark, path: str, outcome: str | None = None) -> DataFrame:
    """The archived history; an outcome reads its partitions only."""
    rows = spark.read.parquet(path)
    return rows if outcome is None else rows.where(F.col("outcome") == outcome)


def as_json(rows: DataFrame, *columns: str) -> DataFrame:
    """One JSON object a row, under ``value``; nulls are kept."""
    return rows.select(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("value"))
