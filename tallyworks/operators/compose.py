"""Composed transitions: what one finalize sets in motion, workflow inserts, replays and upserts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.ledger import FINISHED
from . import workflow


@dataclass(frozen=True)
class Settled:
    """Result of ``finalize_steps``; every member is a DataFrame."""

    steps: DataFrame  # all steps with their new states
    canceled: DataFrame  # job_id of steps that a failure canceled
    promoted: DataFrame  # batch_id, job_id of steps that may run now
    counts: DataFrame  # batch_id, done, failed
    results: DataFrame  # batch_id, job_id, state of steps that others read
    edges: DataFrame  # edges whose dependent is still open


def finalize_steps(steps: DataFrame, edges: DataFrame, finished: DataFrame, rounds: int = 100) -> Settled:
    """Apply ``finished`` (job_id, to_state) to a graph: cancel dependents, count, record, promote.

    Failures cascade over plain ``cancel`` edges; then groups without a live or completed
    member cancel their dependents and those cascade again, until nothing changes.
    """
    rows = steps.join(finished.select("job_id", "to_state"), "job_id", "left")
    now = rows.select("batch_id", "job_id", F.coalesce("to_state", "state").alias("state")).checkpoint()
    failed = now.where(F.col("state").isin("canceled", "discarded")).select("job_id")
    canceled = None
    for _ in range(rounds):
        more = workflow.cascade(edges, failed).join(now.where(~F.col("state").isin(*FINISHED)), "job_id", "left_semi")
        more = more.unionByName(workflow.exhausted(edges, now).join(now.where(~F.col("state").isin(*FINISHED)), "job_id", "left_semi"))
        more = more.distinct().checkpoint()
        if more.isEmpty():
            break
        canceled = more if canceled is None else canceled.unionByName(more)
        marks = more.withColumn("gone", F.lit(True))
        now = now.join(marks, "job_id", "left").select("batch_id", "job_id", F.when(F.col("gone"), "canceled").otherwise(F.col("state")).alias("state")).checkpoint()
        failed = more
    else:
        raise RuntimeError("cancellations did not settle")
    canceled = more if canceled is None else canceled
    ended = now.join(finished.select("job_id").unionByName(canceled).distinct(), "job_id", "left_semi")
    counts = ended.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("done"), F.count_if(F.col("state") != "completed").alias("failed")
    )
    read = edges.select(F.col("depends_on").alias("job_id")).distinct()
    results = ended.join(read, "job_id", "left_semi").select("batch_id", "job_id", "state")
    open_edges = edges.join(now.where(~F.col("state").isin(*FINISHED)).select("job_id"), "job_id", "left_semi")
    return Settled(now, canceled, workflow.ready_steps(edges, now), counts, results, open_edges)


def finished_duplicates_of_batch(found: DataFrame, rows: DataFrame) -> DataFrame:
    """(batch_id, done, failed): rows of a batch insert that already finished count at once."""
    joined = rows.select("seq", "batch_id").join(found, "seq")
    return joined.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("done"), F.count_if(F.col("finished_state") != "completed").alias("failed")
    )


def insert_workflow(spark, batch_id: int, tasks: list[dict], first_id: int) -> tuple[DataFrame, DataFrame]:
    """(steps, edges) of a workflow given as tasks with name, depends_on and any_of (lists of names).

    Names are unique and known, and the graph has no cycle.
    """
    ids = {t["name"]: first_id + i for i, t in enumerate(tasks)}
    if len(ids) != len(tasks):
        raise ValueError("task names repeat")
    needs = {t["name"]: [*t.get("depends_on", []), *(n for g in t.get("any_of", []) for n in g)] for t in tasks}
    unknown = {n for v in needs.values() for n in v} - ids.keys()
    if unknown:
        raise ValueError(f"unknown tasks {sorted(unknown)}")
    left = {k: set(v) for k, v in needs.items()}
    while left:
        free = [k for k, v in left.items() if not v & left.keys()]
        if not free:
            raise ValueError("the workflow has a cycle")
        left = {k: v for k, v in left.items() if k not in free}
    steps = [(batch_id, ids[t["name"]], t["name"], "pending" if needs[t["name"]] else "available") for t in tasks]
    edges = []
    for t in tasks:
        policy = t.get("on_failure", "cancel")
        edges += [(batch_id, ids[t["name"]], ids[n], policy, None) for n in t.get("depends_on", [])]
        edges += [(batch_id, ids[t["name"]], ids[n], f"any_{policy}", g) for g, group in enumerate(t.get("any_of", []), 1) for n in group]
    return (
        spark.createDataFrame(steps, "batch_id long, job_id long, step string, state string"),
        spark.createDataFrame(edges, "batch_id long, job_id long, depends_on long, on_failure string, any_of int"),
    )


def upsert(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """``table`` with the rows of ``changes`` in place of those with the same key."""
    return table.join(changes.select(key), key, "left_anti").unionByName(changes, allowMissingColumns=True)


def replay(finished: DataFrame, deliveries: DataFrame, subscription: str, limit: int) -> DataFrame:
    """The oldest discarded jobs of a subscription, up to ``limit``, to be retried."""
    own = deliveries.where(F.col("subscription") == subscription).select("id")
    return finished.where("state = 'discarded'").join(own, "id", "left_semi").orderBy("id").limit(limit)


def tag_changes(old: Column, new: Column) -> Column:
    """(added, removed) of two tag lists; null is empty."""
    a, b = (F.coalesce(c, F.array().cast("array<string>")) for c in (old, new))
    return F.struct(F.array_except(b, a).alias("added"), F.array_except(a, b).alias("removed"))


def append_log(logs: Column, attempt: Column, log: Column, snoozed: Column, keep: int) -> Column:
    """Attempt logs with one more, the last ``keep``; a snoozed run of the same attempt is replaced."""
    entry = F.struct(attempt.alias("attempt"), snoozed.alias("snoozed"), log.alias("log"))
    kept = F.filter(logs, lambda x: ~(x["snoozed"] & (x["attempt"] == attempt)))
    both = F.concat(kept, F.array(entry))
    return F.slice(both, F.greatest(F.size(both) - keep + 1, F.lit(1)), keep)


def snooze_reason(state: Column, reason: Column) -> Column:
    """The reason shows only while the job is scheduled."""
    return F.when(state == "scheduled", reason)


def apply_kind_aliases(jobs: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """Old kind names in favour of their new ones."""
    if not aliases:
        return jobs
    table = F.create_map(*[F.lit(x) for kv in sorted(aliases.items()) for x in kv])
    return jobs.withColumn("kind", F.coalesce(F.try_element_at(table, F.col("kind")), F.col("kind")))


def latest_log_of_attempt(logs: DataFrame) -> DataFrame:
    """Of several log entries of an attempt the last one; earlier ones are superseded."""
    order = Window.partitionBy("id", "attempt").orderBy(F.col("position").desc())
    return logs.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
