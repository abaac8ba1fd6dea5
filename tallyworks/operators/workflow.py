"""Batches and workflow graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.ledger import FINISHED


def fold_progress(batches: DataFrame, progress: DataFrame) -> DataFrame:
    """(id, pending, failed, total, done, complete): the append-only progress folded in, pending never below 0."""
    sums = progress.groupBy(F.col("batch_id").alias("id")).agg(F.sum("done").alias("d"), F.sum("failed").alias("f"))
    rows = batches.join(sums, "id", "left")
    pending = F.greatest(F.col("pending") - F.coalesce("d", F.lit(0)), F.lit(0))
    return rows.select(
        "id", pending.alias("pending"), (F.col("failed") + F.coalesce("f", F.lit(0))).alias("failed"), "total",
        F.coalesce("d", F.lit(0)).alias("done"), (pending <= 0).alias("complete"), "on_success", "on_failure", "on_complete",
    )


def callbacks(folded: DataFrame) -> DataFrame:
    """(batch_id, batch_failed, callback, kind) of the callbacks of complete batches."""
    ok = F.col("failed") == 0
    choices = F.array(
        F.struct(F.when(ok, "success").otherwise("failure").alias("callback"), F.when(ok, F.col("on_success")).otherwise(F.col("on_failure")).alias("kind")),
        F.struct(F.lit("complete").alias("callback"), F.col("on_complete").alias("kind")),
    )
    rows = folded.where("complete").select(F.col("id").alias("batch_id"), F.col("failed").alias("batch_failed"), F.inline(choices))
    return rows.where("kind IS NOT NULL")


def settle(folded: DataFrame) -> DataFrame:
    """Batches after settling: complete ones frozen, progress folded away."""
    return folded.withColumn("state", F.when(F.col("complete"), "complete").otherwise("open"))


def any_of_groups(edges: DataFrame, steps: DataFrame) -> DataFrame:
    """(job_id, any_of, cancels, satisfied, live) of any-of groups; a job that is gone without a result has completed."""
    state = steps.select(F.col("job_id").alias("depends_on"), "state")
    rows = edges.where("any_of IS NOT NULL").join(state, "depends_on", "left")
    failed, gone_well = F.col("state").isin("canceled", "discarded"), F.col("state").isNull() | (F.col("state") == "completed")
    return rows.groupBy("job_id", "any_of").agg(
        F.bool_or(F.col("on_failure") == "any_cancel").alias("cancels"), F.bool_or(gone_well).alias("satisfied"), F.bool_or(~failed & ~gone_well).alias("live")
    )


def ready_steps(edges: DataFrame, steps: DataFrame) -> DataFrame:
    """Waiting steps with no live ordinary dependency and no group that holds them."""
    open_jobs = steps.where(~F.col("state").isin(*FINISHED))
    ordinary = edges.where("any_of IS NULL").join(open_jobs.select(F.col("job_id").alias("depends_on")), "depends_on", "left_semi")
    holding = any_of_groups(edges, steps).where("NOT satisfied AND (live OR cancels)")
    ready = open_jobs.join(ordinary.select("job_id"), "job_id", "left_anti").join(holding.select("job_id"), "job_id", "left_anti")
    return ready.select("batch_id", "job_id")


def exhausted(edges: DataFrame, steps: DataFrame) -> DataFrame:
    """Steps that an exhausted any-of group cancels."""
    return any_of_groups(edges, steps).where("NOT satisfied AND NOT live AND cancels").select("job_id").distinct()


def cascade(edges: DataFrame, failed: DataFrame) -> DataFrame:
    """(job_id): all dependents of failed steps over plain ``cancel`` edges, however long the chains.

    A frontier loop: each round joins only new steps and drops visited ones. Rounds are
    checkpointed, so plans stay short and lost executors cost one round.
    """
    plain = edges.where((F.col("any_of").isNull()) & (F.col("on_failure") == "cancel")).select("depends_on", "job_id").checkpoint()
    frontier = failed.select("job_id").distinct().checkpoint()
    seen, reached = frontier, None
    while True:  # ends, as every round adds unseen steps or is the last
        step = plain.join(frontier.select(F.col("job_id").alias("depends_on")), "depends_on").select("job_id").distinct()
        frontier = step.join(seen, "job_id", "left_anti").checkpoint()
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
        reached = frontier if reached is None else reached.unionByName(frontier)
    return frontier if reached is None else reached


def levels(edges: DataFrame, steps: DataFrame, rounds: int = 1000) -> DataFrame:
    """(job_id, level): longest path from a root, by rounds that move only steps whose level grew."""
    known = steps.select("job_id")
    graph = edges.select("job_id", "depends_on").join(known.select(F.col("job_id").alias("depends_on")), "depends_on", "left_semi").checkpoint()
    moved = known.withColumn("level", F.lit(0)).checkpoint()
    found = moved
    for _ in range(rounds):
        moved = (
            graph.join(moved.select(F.col("job_id").alias("depends_on"), "level"), "depends_on")
            .groupBy("job_id").agg((F.max("level") + 1).alias("level")).checkpoint()
        )
        if moved.isEmpty():
            return found
        found = found.unionByName(moved).groupBy("job_id").agg(F.max("level").alias("level")).checkpoint()
    raise ValueError("the graph has a cycle or is deeper than the rounds")


def dependencies(edges: DataFrame, steps: DataFrame) -> DataFrame:
    """(job_id, dependencies): ids and states of what each step depends on, in order."""
    state = steps.select(F.col("job_id").alias("depends_on"), "state")
    rows = edges.join(state, "depends_on", "left").select("job_id", "depends_on", F.coalesce("state", F.lit("gone")).alias("state"))
    return rows.groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("depends_on", "state"))).alias("dependencies"))


def get_workflow(batches: DataFrame, steps: DataFrame, edges: DataFrame, batch_id: int) -> DataFrame:
    """The batch, its steps by id and their edges, as one ordered listing."""
    batch = batches.where(F.col("id") == batch_id).select(F.lit("batch").alias("part"), "id", F.lit(None).cast("long").alias("other"))
    own = steps.where(F.col("batch_id") == batch_id).select(F.lit("step").alias("part"), F.col("job_id").alias("id"), F.lit(None).cast("long").alias("other"))
    links = edges.where(F.col("batch_id") == batch_id).select(F.lit("edge").alias("part"), F.col("job_id").alias("id"), F.col("depends_on").alias("other"))
    return batch.union(own).union(links)
