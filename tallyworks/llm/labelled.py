"""Bounded, repeatable samples of labelled rows for fitting models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import limited_semi, stage


def fold(key: str, parts: int) -> Column:
    """crc32 of the key as text, modulo ``parts``; null keys are in no fold."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % F.lit(parts)


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, held_out: Column, most: int, key: str = "doc_id", text: str = "text", also: str | None = None
) -> DataFrame:
    """(key, text, y) of at most ``most`` labelled rows outside the held-out fold; with ``also`` that column too, as text.

    Keys are taken in the order of a hash, so the sample is a uniform one and the same on every
    run. A key that is labelled twice has the mean label, and one with several rows its smallest
    text; null labels are left out.
    """
    rows = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull() & ~held_out)
    rows = rows.groupBy(key).agg(F.avg(F.col(label).cast("double")).alias("y"))
    rows = stage(rows.orderBy(F.xxhash64(key, F.lit("sample")), key).limit(most), "label-sample")
    extra = F.col(also).cast("string") if also else F.lit(None).cast("string")
    texts = docs.select(F.col(key), F.struct(F.coalesce(F.col(text), F.lit("")).alias("text"), extra.alias("also")).alias("row"))
    once = limited_semi(texts, rows.select(key), key).groupBy(key).agg(F.min("row").alias("row"))
    return once.join(F.broadcast(rows), key).select(key, "row.text", "y", *[F.col("row.also").alias("also")] * bool(also))
