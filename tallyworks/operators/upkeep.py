"""Rescue, leases, retention and periodic slots."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cron import Cron
from ..sources.ledger import WAITING
from .claim import at


def expired(jobs: DataFrame, as_of: str) -> DataFrame:
    """Waiting jobs past their time to live."""
    return jobs.where(F.col("state").isin(*WAITING) & (F.col("expires_at") <= at(as_of)))


def rescue_candidates(jobs: DataFrame, clients: DataFrame, stuck_seconds: int, as_of: str) -> DataFrame:
    """(id, attempted_by, stuck): running jobs whose client has no live lease, or that run too long."""
    alive = clients.where(F.col("expires_at") > at(as_of)).select(F.col("id").alias("attempted_by"), F.lit(True).alias("alive"))
    stuck = F.coalesce(F.col("attempted_at") < at(as_of) - F.make_dt_interval(secs=F.lit(stuck_seconds)), F.lit(False))
    running = jobs.where((F.col("state") == "running") & F.col("attempted_by").isNotNull())
    rows = running.join(alive, "attempted_by", "left").withColumn("stuck", stuck if stuck_seconds > 0 else F.lit(False))
    return rows.where(F.col("stuck") | F.col("alive").isNull()).select("id", "attempted_by", "stuck")


def leases_due(leases: DataFrame, clients: DataFrame, grace_days: int, as_of: str) -> DataFrame:
    """Due leases; if clients restarted after a renewal, ttl (or the grace) counts from the first restart.

    Starts are few distinct values: the first one after each renewal comes from a sorted list
    of the distinct starts, so the range join needs no pairs. Starts are counted per live
    client and lists stay as short as the cluster is large.
    """
    starts = clients.where((F.col("started_at") <= at(as_of)) & (F.col("expires_at") > at(as_of)))
    listed = starts.agg(F.array_sort(F.collect_set("started_at")).alias("starts"))
    listed = F.broadcast(listed.withColumn("one", F.lit(1)))  # one row: an aggregate without keys
    rows = leases.where(F.col("expires_at") <= at(as_of)).withColumn("one", F.lit(1)).join(listed, "one")
    first = F.element_at(F.filter("starts", lambda s: s > F.col("renewed_at")), 1)
    first = F.when(F.size(F.filter("starts", lambda s: s > F.col("renewed_at"))) > 0, first)
    wait = F.make_dt_interval(days=F.greatest("ttl_days", F.lit(grace_days)))
    return rows.where(F.coalesce(first + wait, F.col("expires_at")) <= at(as_of)).select("id", "renewed_at", "expires_at")


def partitions_to_drop(finished: DataFrame, keep_days: dict[str, int], as_of: str) -> DataFrame:
    """(outcome, day, n): whole days of history past the retention of their outcome; 0 keeps for ever."""
    outcome = F.when(F.col("state") == "completed", "completed").otherwise("failed")
    days = finished.groupBy(outcome.alias("outcome"), F.to_date("finalized_at").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    keep = F.lit(None).cast("int")
    for name, value in keep_days.items():
        keep = F.when(F.col("outcome") == name, F.lit(value if value > 0 else None).cast("int")).otherwise(keep)
    return days.where(F.date_add("day", 1).cast("timestamp_ntz") < at(as_of) - F.make_dt_interval(days=keep))


def expired_log_runs(runs: DataFrame, jobs: DataFrame, grace_days: int, most_runs: int, keep_days: dict[str, int], as_of: str) -> DataFrame:
    """(job_id, fence) of log runs to drop: unknown jobs, runs beyond ``most_runs``, finished past retention.

    Runs within the grace, of a later fence than the job's, or of its running attempt stay.
    """
    order = Window.partitionBy("job_id").orderBy(F.col("fence").desc())
    ranked = runs.withColumn("rank", F.row_number().over(order))
    job = jobs.select(F.col("id").alias("job_id"), F.col("state"), F.col("fence").alias("job_fence"), "finalized_at")
    rows = ranked.join(job, "job_id", "left")
    old = F.col("updated_at") <= at(as_of) - F.make_dt_interval(days=F.lit(grace_days))
    held = (F.col("job_fence") == 0) | (F.col("fence") > F.col("job_fence")) | ((F.col("state") == "running") & (F.col("fence") == F.col("job_fence")))
    keep = F.when(F.col("state") == "completed", F.lit(keep_days["completed"])).when(F.col("state").isin("canceled", "discarded"), F.lit(keep_days["failed"]))
    done = (keep > 0) & F.col("finalized_at").isNotNull() & (F.col("finalized_at") + F.make_dt_interval(days=keep) <= at(as_of))
    many = (F.lit(most_runs) > 0) & (F.col("rank") > most_runs)
    gone = F.when(F.col("state").isNull(), True).when(held, False).otherwise(many | F.coalesce(done, F.lit(False)))
    return rows.where(old & gone).select("job_id", "fence")


def effective_definitions(registrations: DataFrame, clients: DataFrame, as_of: str) -> DataFrame:
    """For each periodic job the definition of the newest live client that registered it."""
    alive = clients.where(F.col("expires_at") > at(as_of)).select(F.col("id").alias("client_id"), "started_at")
    newest = F.max_by(F.struct("client_id", "definition"), F.struct("started_at", "client_id"))
    return registrations.join(alive, "client_id").groupBy("name").agg(newest.alias("d")).select("name", "d.client_id", "d.definition")


def cron_slots(spark, specs: list[tuple[str, str]], start: str, end: str, most: int = 10_000) -> DataFrame:
    """(name, slot): the slots of each spec after ``start`` up to ``end``, ``most`` of a spec; specs are settings, computed on the driver."""
    zone = timezone.utc
    a, b = (datetime.fromisoformat(x).replace(tzinfo=zone) for x in (start, end))
    rows = [(name, s.replace(tzinfo=None)) for name, spec in specs for s in Cron(spec).slots(a, b, most)]
    return spark.createDataFrame(rows, "name string, slot timestamp_ntz")


def missed_slots(slots: DataFrame, last: DataFrame) -> DataFrame:
    """Slots later than the last inserted one of their name; names without one start fresh."""
    return slots.join(last, "name", "left").where(F.col("last_slot").isNull() | (F.col("slot") > F.col("last_slot"))).select("name", "slot")


def latest_slots(slots: DataFrame, n: int) -> DataFrame:
    order = Window.partitionBy("name").orderBy(F.col("slot").desc())
    return slots.withColumn("i", F.row_number().over(order)).where(F.col("i") <= n).drop("i")


def upsert_queues(queues: DataFrame, changes: DataFrame) -> DataFrame:
    """Queue limits after changes (name, global_limit, rate_per_sec, rate_burst); tokens restart only if the rate changed."""
    new = changes.select("name", *[F.col(c).alias(f"new_{c}") for c in ("global_limit", "rate_per_sec", "rate_burst")], F.lit(True).alias("changed"))
    rows = queues.join(new, "name", "full")
    kept = ~F.coalesce(F.col("changed"), F.lit(False))
    value = lambda c: F.when(kept, F.col(c)).otherwise(F.col(f"new_{c}")).alias(c)
    same_rate: Column = kept | F.col("rate_per_sec").eqNullSafe(F.col("new_rate_per_sec"))
    return rows.select(
        "name", *[value(c) for c in ("global_limit", "rate_per_sec", "rate_burst")],
        F.when(same_rate, F.col("tokens")).alias("tokens"), F.coalesce("paused", F.lit(False)).alias("paused"),
    )


def renew_leases(leases: DataFrame, renewals: DataFrame, as_of: str) -> DataFrame:
    """Leases after renewals (id): those not past their end run for their ttl from now; late renewals change nothing."""
    rows = leases.join(renewals.select("id", F.lit(True).alias("asked")).distinct(), "id", "left")
    hit = F.col("asked") & (F.col("expires_at") > at(as_of))
    ends = at(as_of) + F.make_dt_interval(days=F.col("ttl_days"))
    return rows.withColumns(
        {"renewed_at": F.when(hit, at(as_of)).otherwise(F.col("renewed_at")), "expires_at": F.when(hit, ends).otherwise(F.col("expires_at"))}
    ).drop("asked")


def expire_leases(jobs: DataFrame, due: DataFrame, as_of: str) -> DataFrame:
    """(id, to_state) of running leased jobs whose lease is due: retryable, or discarded after the last attempt."""
    held = jobs.where((F.col("state") == "running") & F.col("attempted_by").isNull()).join(due.select("id"), "id", "left_semi")
    return held.select("id", F.when(F.col("attempt") >= F.col("max_attempts"), "discarded").otherwise("retryable").alias("to_state"))


def claim_by_id(jobs: DataFrame, ids: DataFrame, as_of: str) -> DataFrame:
    """(id, attempt, fence) of waiting, due jobs that are claimed by id and held by a lease."""
    ready = F.col("state").isin(*WAITING) & (F.col("scheduled_at") <= at(as_of)) & (F.col("expires_at").isNull() | (F.col("expires_at") > at(as_of)))
    rows = jobs.where(ready).join(ids.select("id").distinct(), "id", "left_semi")
    return rows.select("id", (F.col("attempt") + 1).alias("attempt"), (F.col("fence") + 1).alias("fence"))


def ensure_queues(queues: DataFrame, names: DataFrame) -> DataFrame:
    """Queues and a row without limits for each new name."""
    new = names.select("name").distinct().join(queues.select("name"), "name", "left_anti")
    return queues.unionByName(new.withColumn("paused", F.lit(False)), allowMissingColumns=True)


def pause_queues(queues: DataFrame, names: tuple[str, ...], paused: bool = True) -> DataFrame:
    """Queues with those of ``names`` paused (or resumed); no names mean all."""
    hit = F.col("name").isin(*names) if names else F.lit(True)
    return queues.withColumn("paused", F.when(hit, F.lit(paused)).otherwise(F.col("paused")))


def insert_slots(slots: DataFrame, last: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new jobs, last slots after): slots not inserted yet, under the unique key ``periodic:name:slot``."""
    new = missed_slots(slots, last)
    key = F.concat_ws(":", F.lit("periodic"), "name", F.date_format("slot", "yyyy-MM-dd'T'HH:mm:ss"))
    after = last.unionByName(new.select("name", F.col("slot").alias("last_slot"))).groupBy("name").agg(F.max("last_slot").alias("last_slot"))
    return new.withColumn("unique_key", key), after


def drop_days(finished: DataFrame, due: DataFrame) -> DataFrame:
    """History without the (outcome, day) partitions that are due."""
    outcome = F.when(F.col("state") == "completed", "completed").otherwise("failed")
    rows = finished.withColumn("outcome", outcome).withColumn("day", F.to_date("finalized_at"))
    return rows.join(F.broadcast(due.select("outcome", "day")), ["outcome", "day"], "left_anti").drop("outcome", "day")
