"""Exact deduplication against a persistent digest index.

The index is a Parquet table bucketed and sorted by digest. A batch is reduced to one row a
digest, anti-joined to the index (co-partitioned, sort-merge) and what is new is appended.

Edge cases: null text counts as empty; of equal texts the smallest key stays, of repeated
rows with that key the first written one, so exactly one row of a group is kept; null keys
sort after all others; an empty batch leaves the index as it is; extra columns are ignored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import scratch_path, stage

BLANKS = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS, " ")


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(normalised(text).cast("binary"), 256))


class DigestIndex:
    """Table (digest, keep_key, keep_row, batch) at ``path``, in ``buckets`` sorted buckets."""

    SCHEMA = "digest BINARY, keep_key BIGINT, keep_row BIGINT, batch STRING"

    def __init__(self, spark: SparkSession, path: str, buckets: int = 32):
        self.spark, self.path, self.buckets = spark, path, buckets
        self.table = f"digest_index_{uuid.uuid5(uuid.NAMESPACE_URL, path).hex}"
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.table} ({self.SCHEMA}) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}'"
        )

    def rows(self) -> DataFrame:
        return self.spark.table(self.table)

    def append_new(self, batch: DataFrame, label: str) -> None:
        """``batch``: one row a digest (digest, keep_key, keep_row); known digests are skipped."""
        known = self.rows().select("digest")
        new = batch.join(known.hint("merge"), "digest", "left_anti").withColumn("batch", F.lit(label))
        columns = [x.split()[0] for x in self.SCHEMA.split(", ")]
        new.repartition(self.buckets, "digest").select(*columns).write.insertInto(self.table)
        self.spark.catalog.refreshTable(self.table)


def digest_rows(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, _row, digest) of every row, written once to the shared folder."""
    rows = docs.select(
        F.col(key).cast("long").alias(key), F.monotonically_increasing_id().alias("_row"), digest(F.col(text)).alias("digest")
    )
    return stage(rows, "digests")


def dedup_batch(docs: DataFrame, index: DigestIndex, label: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row of ``docs`` with its group, after appending the new digests to ``index``.

    Groups are counted with partial aggregation, so a text that a third of all rows share
    costs one row a task in the shuffle; the join back to the rows is split by AQE.
    A row is kept if its digest was new and it is the group's first row.
    """
    rows = digest_rows(docs, key, text)
    first = F.min(F.struct(F.col(key).isNull().alias("n"), F.col(key).alias("k"), F.col("_row").alias("r")))
    groups = stage(
        rows.groupBy("digest").agg(first.alias("first"), F.count(F.lit(1)).alias("group_size")).select(
            "digest", F.col("first.k").alias("keep_key"), F.col("first.r").alias("keep_row"), "group_size"
        ),
        "groups",
    )
    index.append_new(groups.select("digest", "keep_key", "keep_row"), label)
    held = groups.select("digest", "group_size").join(index.rows(), "digest")
    return rows.join(held, "digest").select(
        F.col(key),
        F.col("keep_key").alias("keep_id"),
        F.col("group_size").cast("long").alias("group_size"),
        ((F.col("batch") == F.lit(label)) & (F.col("_row") == F.col("keep_row"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", buckets: int = 32) -> DataFrame:
    """``dedup_batch`` into a new index in the shared folder."""
    spark = docs.sparkSession
    return dedup_batch(docs, DigestIndex(spark, scratch_path(spark, "digest-index"), buckets), "first", key, text)
