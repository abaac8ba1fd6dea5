"""Claiming: eligibility, ordering lanes, limits and the claim order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import available_tokens
from ..sources.ledger import WAITING

ORDER = ("priority", "scheduled_at", "seq")
#: Jobs that one claim takes at most.
MOST_CLAIMED = 512


def at(as_of: str) -> Column:
    return F.lit(as_of).cast("timestamp_ntz")


def due(as_of: str) -> Column:
    """Waiting, scheduled in the past and not past its time to live."""
    now = at(as_of)
    return F.col("state").isin(*WAITING) & (F.col("scheduled_at") <= now) & (F.col("expires_at").isNull() | (F.col("expires_at") > now))


def lane_heads(jobs: DataFrame) -> DataFrame:
    """(queue, ordering_key, head, busy): first waiting seq of a lane, and whether one of it runs.

    One aggregation with partial sums in place of an anti-join and a minimum: a key that a
    third of all jobs carry costs one row a task. A head whose time has not come still blocks.
    """
    lanes = jobs.where(F.col("ordering_key").isNotNull() & F.col("state").isin(*WAITING, "running"))
    return lanes.groupBy("queue", "ordering_key").agg(
        F.min(F.when(F.col("state") != "running", F.col("seq"))).alias("head"),
        F.bool_or(F.col("state") == "running").alias("busy"),
    )


def eligible(jobs: DataFrame, as_of: str) -> DataFrame:
    """Jobs that may be claimed now, before limits."""
    now = jobs.where(due(as_of))
    heads = lane_heads(jobs).where("NOT busy").select("queue", "ordering_key", F.col("head").alias("seq"))
    free = now.where("ordering_key IS NULL")
    first = now.where("ordering_key IS NOT NULL").join(heads, ["queue", "ordering_key", "seq"], "left_semi")
    return free.unionByName(first)


def top_per_queue(jobs: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` jobs of each queue in claim order (a group limit runs before the shuffle)."""
    order = Window.partitionBy("queue").orderBy(*ORDER)
    return jobs.withColumn("position", F.row_number().over(order)).where(F.col("position") <= limit)


def claim_next(jobs: DataFrame, limit: int, as_of: str) -> DataFrame:
    return top_per_queue(eligible(jobs, as_of), limit)


def within_partitions(jobs: DataFrame, ready: DataFrame, limit: int) -> DataFrame:
    """Rows of ``ready`` within the partition limit; jobs without a key are exempt.

    ``row_number() <= limit`` is implied and is filtered on its own, so that a group limit
    applies ahead of the shuffle; running jobs are counted with partial sums.
    """
    running = (
        jobs.where((F.col("state") == "running") & F.col("attempted_by").isNotNull() & F.col("partition_key").isNotNull())
        .groupBy("queue", "partition_key").agg(F.count(F.lit(1)).alias("n"))
    )
    order = Window.partitionBy("queue", "partition_key").orderBy(*ORDER)
    keyed = ready.where("partition_key IS NOT NULL").withColumn("slot", F.row_number().over(order)).where(F.col("slot") <= limit)
    keyed = keyed.join(running, ["queue", "partition_key"], "left").where(F.col("slot") + F.coalesce("n", F.lit(0)) <= limit)
    return ready.where("partition_key IS NULL").unionByName(keyed.drop("slot", "n"))


def budgets(jobs: DataFrame, queues: DataFrame, limit: int, as_of: str) -> DataFrame:
    """(name, running, available, budget, wait_seconds) of each queue: claim limit, global limit and tokens."""
    running = (
        jobs.where((F.col("state") == "running") & F.col("attempted_by").isNotNull())
        .groupBy(F.col("queue").alias("name")).agg(F.count(F.lit(1)).alias("running"))
    )
    rows = queues.join(running, "name", "left").withColumn("running", F.coalesce("running", F.lit(0)))
    tokens = available_tokens(F.col("rate_per_sec"), F.col("rate_burst"), F.col("tokens"), F.col("refilled_at"), at(as_of))
    rows = rows.withColumn("available", tokens)
    budget = F.least(F.lit(limit), F.col("global_limit") - F.col("running"), F.floor("available"))
    rows = rows.withColumn("budget", F.greatest(budget, F.lit(0)).cast("long"))
    wait = F.when((F.col("rate_per_sec") > 0) & (F.floor("available") <= 0), (1 - F.col("available")) / F.col("rate_per_sec"))
    return rows.select("name", "running", "available", "budget", wait.alias("wait_seconds"))


def claim(jobs: DataFrame, limit: int, client: int, as_of: str, partition_limit: int | None = None) -> DataFrame:
    """All jobs after one claim: chosen ones run, with attempt and fence raised by one."""
    ready = eligible(jobs, as_of)
    if partition_limit is not None:
        ready = within_partitions(jobs, ready, partition_limit)
    chosen = top_per_queue(ready, limit).select("id", F.lit(True).alias("chosen"))
    return jobs.join(chosen, "id", "left").withColumns(
        {
            "state": F.when(F.col("chosen"), "running").otherwise(F.col("state")),
            "attempt": F.col("attempt") + F.when(F.col("chosen"), 1).otherwise(0),
            "fence": F.col("fence") + F.when(F.col("chosen"), 1).otherwise(0),
            "attempted_by": F.when(F.col("chosen"), F.lit(client)).otherwise(F.col("attempted_by")),
            "attempted_at": F.when(F.col("chosen"), at(as_of)).otherwise(F.col("attempted_at")),
        }
    ).drop("chosen")


def claim_limited(jobs: DataFrame, queues: DataFrame, limit: int, as_of: str) -> DataFrame:
    """The claim order cut by each queue's budget; queues without a row have no limit of their own."""
    own = budgets(jobs, queues, limit, as_of).select(F.col("name").alias("queue"), "budget")
    ready = top_per_queue(eligible(jobs, as_of), limit)
    return ready.join(own, "queue", "left").where(F.col("position") <= F.coalesce("budget", F.lit(limit))).drop("budget")


def aging(jobs: DataFrame, seconds: int, as_of: str, queue: str | None = None) -> DataFrame:
    """Jobs (of a queue) that wait ``seconds`` or longer: one priority higher, scheduled now; 0 seconds age nothing."""
    if queue is not None:
        jobs = jobs.where(F.col("queue") == queue)
    if seconds <= 0:
        jobs = jobs.limit(0)
    old = F.col("state").isin(*WAITING) & (F.col("priority") > 1) & (F.col("scheduled_at") <= at(as_of) - F.make_dt_interval(secs=F.lit(seconds)))
    return jobs.where(old).withColumn("priority", F.col("priority") - 1).withColumn("scheduled_at", at(as_of))


def wake_lane(jobs: DataFrame, queue: str, ordering_key: str, most: int, as_of: str) -> DataFrame:
    """The first ``most`` scheduled or retryable jobs of a lane, made available now; those past their time to live stay."""
    lane = (F.col("queue") == queue) & (F.col("ordering_key") == ordering_key) & F.col("state").isin("scheduled", "retryable")
    lane = lane & (F.col("expires_at").isNull() | (F.col("expires_at") > at(as_of)))
    return jobs.where(lane).orderBy("seq").limit(most).withColumns({"state": F.lit("available"), "scheduled_at": F.least("scheduled_at", at(as_of))})


def mark_lane(jobs: DataFrame, queue: str, ordering_key: str, as_of: str) -> DataFrame:
    """(id, wake_requested_at) of the lane's running jobs: they are woken when their attempt ends."""
    lane = (F.col("queue") == queue) & (F.col("ordering_key") == ordering_key) & (F.col("state") == "running")
    return jobs.where(lane).select("id", at(as_of).alias("wake_requested_at"))


def clamped(limit: int) -> int:
    """A claim's limit, from 1 to MOST_CLAIMED."""
    return max(1, min(limit, MOST_CLAIMED))


def spend_tokens(queues: DataFrame, budgets: DataFrame, claimed: DataFrame, as_of: str) -> DataFrame:
    """Queues after a limited claim: the bucket holds what was available less what was claimed, as of now.

    Queues without a rate keep their row; a claim of nothing refills only.
    """
    taken = claimed.groupBy(F.col("queue").alias("name")).agg(F.count(F.lit(1)).alias("taken"))
    rows = queues.join(budgets.select("name", "available"), "name", "left").join(taken, "name", "left")
    rated = F.col("available").isNotNull()
    left = F.greatest(F.col("available") - F.coalesce("taken", F.lit(0)), F.lit(0.0))
    return rows.withColumns(
        {"tokens": F.when(rated, left).otherwise(F.col("tokens")), "refilled_at": F.when(rated, at(as_of)).otherwise(F.col("refilled_at"))}
    ).select(*queues.columns)
