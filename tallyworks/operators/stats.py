"""Queue statistics and telemetry."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.ledger import WAITING
from .claim import at


def depth(jobs: DataFrame, as_of: str) -> DataFrame:
    """(queue, state, n, oldest_due_seconds) of live jobs; only waiting ones can be due."""
    age = (F.unix_micros(at(as_of).cast("timestamp")) - F.unix_micros(F.col("scheduled_at").cast("timestamp"))) / 1e6
    oldest = F.max(F.when(F.col("state").isin(*WAITING) & (F.col("scheduled_at") <= at(as_of)), age))
    return jobs.groupBy("queue", "state").agg(F.count(F.lit(1)).alias("n"), oldest.alias("oldest_due_seconds"))


def running_by_client(jobs: DataFrame) -> DataFrame:
    """Running jobs of each client; leased jobs have none."""
    return jobs.where((F.col("state") == "running") & F.col("attempted_by").isNotNull()).groupBy("attempted_by").agg(F.count(F.lit(1)).alias("n"))


def completed_within(finished: DataFrame, queues: DataFrame, seconds: int, as_of: str) -> DataFrame:
    """Completed in the last ``seconds``, for every known queue."""
    since = at(as_of) - F.make_dt_interval(secs=F.lit(seconds))
    recent = finished.where((F.col("state") == "completed") & (F.col("finalized_at") > since) & (F.col("finalized_at") <= at(as_of)))
    counts = recent.groupBy(F.col("queue").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return queues.select("name").join(counts, "name", "left").select("name", F.coalesce("n", F.lit(0)).alias("n"))


def queue_stats(jobs: DataFrame, queues: DataFrame, as_of: str) -> DataFrame:
    """One row a queue that has jobs or a row of its own: counts by state, and the oldest due job's age."""
    by_state = {s: F.count_if(F.col("state") == s) for s in ("available", "scheduled", "retryable", "running")}
    age = (F.unix_micros(at(as_of).cast("timestamp")) - F.unix_micros(F.col("scheduled_at").cast("timestamp"))) / 1e6
    oldest = F.max(F.when((F.col("scheduled_at") <= at(as_of)) & (F.col("state") != "running"), age))
    counts = jobs.groupBy(F.col("queue").alias("name")).agg(*[v.alias(k) for k, v in by_state.items()], oldest.alias("oldest_seconds"))
    rows = queues.select("name", "paused").join(counts, "name", "full")
    return rows.select("name", F.coalesce("paused", F.lit(False)).alias("paused"), *[F.coalesce(s, F.lit(0)).alias(s) for s in by_state], "oldest_seconds")


def nearest_index(rows: DataFrame, group: str, value: str) -> DataFrame:
    """p50 = a[n/2], p99 = a[n*99/100] and max of the sorted values of each group.

    Equal values are counted first. Counts are range-partitioned by (group, value), so a hot
    group is spread over many tasks; sums by partition and group tell each partition how much
    lies before it, and the running count at a value tells whether it covers an index.
    """
    counts = rows.groupBy(group, value).agg(F.count(F.lit(1)).alias("c"))
    ranged = counts.repartitionByRange(F.col(group), F.col(value)).withColumn("_part", F.spark_partition_id()).checkpoint()
    sums = ranged.groupBy(group, "_part").agg(F.sum("c").alias("s"))
    parts = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(group, "_part", F.coalesce(F.sum("s").over(parts), F.lit(0)).alias("_before"))
    totals = counts.groupBy(group).agg(F.sum("c").alias("n"), F.max(value).alias("max_value"))
    inside = F.sum("c").over(Window.partitionBy(group, "_part").orderBy(value))
    ranked = ranged.withColumn("_in", inside).join(starts, [group, "_part"]).withColumn("upto", F.col("_before") + F.col("_in")).join(totals, group)
    at_index = lambda k: (F.col("upto") - F.col("c") <= k) & (k < F.col("upto"))
    half, most = F.floor(F.col("n") / 2), F.floor(F.col("n") * 99 / 100)
    return ranked.groupBy(group).agg(
        F.max("n").alias("n"), F.max(F.when(at_index(half), F.col(value))).alias("p50"),
        F.max(F.when(at_index(most), F.col(value))).alias("p99"), F.max("max_value").alias("max_value"),
    )


def faster_half(results: DataFrame, *group: str) -> DataFrame:
    """Mean rate of the faster half (rounded up) of the runs of each group."""
    order = Window.partitionBy(*group).orderBy(F.col("rate").desc(), "run")
    n = F.count(F.lit(1)).over(Window.partitionBy(*group))
    kept = results.withColumn("i", F.row_number().over(order)).withColumn("n", n).where(F.col("i") <= F.ceil(F.col("n") / 2))
    return kept.groupBy(*group).agg(F.avg("rate").alias("rate"))


def compare_runs(results: DataFrame, tolerance: float = 0.1) -> DataFrame:
    """Base against head by scenario: change, and whether head is slower by more than ``tolerance``."""
    half = faster_half(results, "side", "scenario")
    base = half.where("side = 'base'").select("scenario", F.col("rate").alias("base_rate"))
    head = half.where("side = 'head'").select("scenario", F.col("rate").alias("head_rate"))
    change = F.col("head_rate") / F.col("base_rate") - 1
    return base.join(head, "scenario").select("scenario", "base_rate", "head_rate", change.alias("change"), (change < -tolerance).alias("regressed"))


def attempts_by_outcome(attempts: DataFrame, low: float, high: float, bins: int) -> DataFrame:
    """Attempts of each outcome in each bin of their duration."""
    return attempts.groupBy("outcome", F.width_bucket("ms", F.lit(low), F.lit(high), F.lit(bins)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def log_totals(runs: DataFrame) -> DataFrame:
    return runs.agg(F.count(F.lit(1)).alias("runs"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def bench_lines(lines: DataFrame, schema: str) -> DataFrame:
    """JSON objects among text lines; other lines are skipped."""
    return lines.where(F.col("value").startswith("{")).select(F.from_json("value", schema).alias("r")).select("r.*")


def cluster(clients: DataFrame, leaders: DataFrame, as_of: str) -> DataFrame:
    """(live_clients, leader): clients whose lease holds, and the leader of the default group (0 for none)."""
    now = at(as_of)
    alive = clients.agg(F.count_if(F.col("expires_at") > now).alias("live_clients"), F.lit(1).alias("one"))
    lead = leaders.agg(F.max(F.when((F.col("name") == "default") & (F.col("expires_at") > now), F.col("client_id"))).alias("leader"), F.lit(1).alias("one"))
    return alive.join(lead, "one").select("live_clients", F.coalesce("leader", F.lit(0)).alias("leader"))


def as_object(rows: DataFrame, group: str, name: str, value: str) -> DataFrame:
    """(group, object): one JSON object a group, with sorted names."""
    entries = F.array_sort(F.collect_list(F.struct(F.col(name).cast("string").alias("key"), F.col(value).alias("value"))))
    return rows.groupBy(group).agg(F.to_json(F.map_from_entries(entries)).alias("object"))


def joined_text(rows: DataFrame, group: str, value: str, separator: str = ",") -> DataFrame:
    """(group, text): the distinct values of a group in order, as one text."""
    return rows.groupBy(group).agg(F.array_join(F.array_sort(F.collect_set(value)), separator).alias("text"))


def per_day(rows: DataFrame, column: str, first: str, last: str) -> DataFrame:
    """(day, n) for every day of a range, days without rows too."""
    spark = rows.sparkSession
    days = spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("day"))
    counts = rows.groupBy(F.to_date(column).alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return days.join(counts, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n"))


def batch_counts(finished: DataFrame) -> DataFrame:
    """(batch_id, done, failed) that one finalize adds to the progress of its batches."""
    ends = finished.where("batch_id IS NOT NULL").groupBy("batch_id")
    return ends.agg(F.count(F.lit(1)).alias("done"), F.count_if(F.col("state") != "completed").alias("failed"))
