"""State transitions: pure functions of snapshots, with the clock as an input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import backoff_seconds
from ..sources.ledger import FINISHED, WAITING
from .claim import at


def outcome() -> Column:
    """State that one attempt leads to, from result, canceled, fenced, stopped, too_large, attempt and max_attempts.

    result: ok, error, snooze, or cancel (by the worker).
    """
    by_worker, tail = F.col("result") == "cancel", F.col("attempt") >= F.col("max_attempts")
    give_back = F.col("stopped") & ~by_worker & ~F.col("too_large")
    return (
        F.when(F.col("result") == "ok", "completed")
        .when(F.col("result") == "snooze", "scheduled")
        .when(~by_worker & F.col("canceled"), "canceled")
        .when(~by_worker & ~F.col("too_large") & F.col("fenced") & ~tail, "retryable")
        .when(give_back, "retryable")
        .when(by_worker | F.col("too_large") | tail, "discarded")
        .otherwise("retryable")
    )


def finalize(jobs: DataFrame, results: DataFrame, as_of: str) -> tuple[DataFrame, DataFrame]:
    """(live, history) after results (id, attempted_by, fence, to_state, delay_seconds, give_back).

    A result applies to the running attempt of its client and fence only; a stale one changes
    nothing. Retries and snoozes stay live with their delay, ends move to history.
    """
    keyed = results.select("id", "attempted_by", "fence", "to_state", "delay_seconds", "give_back")
    rows = jobs.join(keyed, ["id", "attempted_by", "fence"], "left")
    hit = (F.col("state") == "running") & F.col("to_state").isNotNull()
    ends = hit & F.col("to_state").isin(*FINISHED)
    again = hit & ~F.col("to_state").isin(*FINISHED)
    delay = F.make_dt_interval(secs=F.coalesce("delay_seconds", F.lit(0.0)).cast("decimal(18,6)"))
    extra = ("to_state", "delay_seconds", "give_back")
    live = rows.where(~F.coalesce(ends, F.lit(False))).withColumns(
        {
            "attempt": F.when(again & (F.coalesce("give_back", F.lit(False)) | (F.col("to_state") == "scheduled")), F.col("attempt") - 1).otherwise(F.col("attempt")),
            "scheduled_at": F.when(again, at(as_of) + delay).otherwise(F.col("scheduled_at")),
            "attempted_by": F.when(again, None).otherwise(F.col("attempted_by")),
            "state": F.when(again, F.col("to_state")).otherwise(F.col("state")),
        }
    )
    done = rows.where(ends).withColumns({"state": F.col("to_state"), "finalized_at": at(as_of)})
    return live.drop(*extra).select(*jobs.columns), done.drop(*extra).select(*jobs.columns)


def retry_delay(ordered: Column | None = None) -> Column:
    return backoff_seconds(F.col("attempt"), ordered=ordered)


def cancel(jobs: DataFrame, ids: DataFrame, as_of: str) -> DataFrame:
    """(id, action, to_state): running jobs get a request, waiting ones end, finished ones stay."""
    rows = jobs.join(ids.select("id").distinct(), "id", "left_semi")
    action = F.when(F.col("state") == "running", "request").when(F.col("state").isin(*FINISHED), "unchanged").otherwise("cancel")
    return rows.select("id", action.alias("action"), F.when(action == "cancel", "canceled").otherwise(F.col("state")).alias("to_state"))


def delete(jobs: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(jobs without the deleted, refused ids): running jobs are refused."""
    asked = ids.select("id").distinct()
    refused = jobs.where("state = 'running'").join(asked, "id", "left_semi").select("id")
    return jobs.join(asked.join(refused, "id", "left_anti"), "id", "left_anti"), refused


def retry(jobs: DataFrame, ids: DataFrame, as_of: str, first_seq: int | None = None) -> DataFrame:
    """Retried jobs: available at once, time to live cleared; exhausted ones may try once more.

    A finished job does not return while a live one has its unique key; of several finished ones
    of a key the smallest id returns (``retry_conflicts`` lists the others). Returning jobs get
    a fresh seq, from ``first_seq`` on (by default after the largest).
    """
    rows = jobs.join(ids.select("id").distinct(), "id", "left_semi").where("state <> 'running'")
    live, finished = rows.where(F.col("state").isin(*WAITING, "pending")), _returning(jobs, rows)
    spent = F.col("attempt") >= F.col("max_attempts")
    start = F.lit(first_seq) if first_seq is not None else F.lit(jobs.agg(F.max("seq")).first()[0] or 0) + 1
    back = with_positions(finished, "id", "_at").withColumns(
        {
            "max_attempts": F.when(spent, F.col("attempt") + 1).otherwise(F.col("max_attempts")),
            "seq": start + F.col("_at"), "scheduled_at": at(as_of),
        }
    ).select(*jobs.columns)
    now = live.withColumn("scheduled_at", F.least("scheduled_at", at(as_of))).unionByName(back)
    none = F.lit(None).cast("timestamp_ntz")
    return now.withColumns({"expires_at": none, "finalized_at": none, "state": F.lit("available")})


def _returning(jobs: DataFrame, asked: DataFrame) -> DataFrame:
    """The asked-for finished jobs that may go live: no live job has their key, and one for each key."""
    held = jobs.where(~F.col("state").isin(*FINISHED) & F.col("unique_key").isNotNull()).select("kind", "unique_key").distinct()
    finished = asked.where(F.col("state").isin(*FINISHED))
    keyed = finished.where("unique_key IS NOT NULL").join(held, ["kind", "unique_key"], "left_anti")
    first = keyed.groupBy("kind", "unique_key").agg(F.min("id").alias("id")).select("id")
    return finished.where("unique_key IS NULL").unionByName(finished.join(first, "id", "left_semi"))


def retry_conflicts(jobs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id) of the finished jobs that a retry refuses, as another job holds or takes their unique key."""
    asked = jobs.join(ids.select("id").distinct(), "id", "left_semi")
    return asked.where(F.col("state").isin(*FINISHED)).join(_returning(jobs, asked).select("id"), "id", "left_anti").select("id")


def with_positions(rows: DataFrame, by: str, name: str) -> DataFrame:
    """``rows`` with gapless positions from 0 in the order of ``by``.

    Rows are range-partitioned and numbered inside each partition; one count a partition
    gives where each starts, so no task sorts all rows.
    """
    ranged = rows.repartitionByRange(F.col(by)).withColumn("_part", F.spark_partition_id()).checkpoint()
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(by)) - 1
    return ranged.join(F.broadcast(starts.drop("_n")), "_part").withColumn(name, F.col("_start") + inside).drop("_part", "_start")


def cancel_rows(jobs: DataFrame, ids: DataFrame, as_of: str) -> tuple[DataFrame, DataFrame]:
    """(live, history) after a cancel: waiting jobs end as canceled, running ones are only asked (see ``cancel``)."""
    waiting = jobs.where(~F.col("state").isin(*FINISHED, "running")).join(ids.select("id").distinct(), "id", "left_semi")
    done = waiting.withColumns({"state": F.lit("canceled"), "finalized_at": at(as_of)})
    return jobs.join(waiting.select("id"), "id", "left_anti"), done


def discard_expired(expired: DataFrame, as_of: str) -> DataFrame:
    return expired.withColumns({"state": F.lit("discarded"), "finalized_at": at(as_of)})


def rescue(jobs: DataFrame, candidates: DataFrame, as_of: str) -> DataFrame:
    """Rescued jobs: retryable now, or discarded after their last attempt."""
    rows = jobs.join(candidates.select("id"), "id", "left_semi")
    spent = F.col("attempt") >= F.col("max_attempts")
    return rows.withColumns({"state": F.when(spent, "discarded").otherwise("retryable"), "scheduled_at": at(as_of), "attempted_by": F.lit(None).cast("long")})


def record_progress(jobs: DataFrame, reports: DataFrame) -> DataFrame:
    """(id, step, cursor) of accepted reports (id, attempted_by, fence, attempt, step, cursor): the running attempt's only."""
    running = jobs.where("state = 'running'").select("id", "attempted_by", "fence", "attempt")
    return reports.join(running, ["id", "attempted_by", "fence", "attempt"], "left_semi").select("id", "step", "cursor")


def violations(live: DataFrame, finished: DataFrame) -> DataFrame:
    """(rule, n) of broken invariants; empty for a sound ledger."""
    lanes = live.where("state = 'running' AND ordering_key IS NOT NULL").groupBy("queue", "ordering_key").count().where("count > 1")
    keys = live.where("unique_key IS NOT NULL").groupBy("kind", "unique_key").count().where("count > 1")
    twice = live.join(finished, "id", "left_semi")
    rows = [(lanes, "one running job a lane"), (keys, "one live job a unique key"), (twice, "live or finished, not both")]
    out = None
    for df, rule in rows:
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(rule).alias("rule"), "n").where("n > 0")
        out = one if out is None else out.union(one)
    return out


def finalize_rows(jobs: DataFrame, results: DataFrame, as_of: str, keep_errors: int = 10) -> tuple[DataFrame, DataFrame]:
    """``finalize`` with what an attempt leaves behind.

    ``results`` have error, output and reason too, ``jobs`` errors (a list of (attempt, error)),
    output, snooze_reason and wake_requested_at. An error is appended, the last ``keep_errors``
    stay; a finished job keeps its output; a snoozed one shows its reason while it is scheduled;
    a job that was asked to wake during its attempt waits no longer.
    """
    told = results.select("id", "attempted_by", "fence", "error", F.col("output").alias("new_output"), "reason")
    hit = (F.col("state") == "running") & F.col("answered")
    entry = F.array(F.struct(F.col("attempt").alias("attempt"), F.col("error").alias("error")))
    both = F.concat(F.coalesce("errors", F.array().cast("array<struct<attempt: int, error: string>>")), entry)
    kept = F.slice(both, F.greatest(F.size(both) - keep_errors + 1, F.lit(1)), keep_errors)
    rows = jobs.join(told.withColumn("answered", F.lit(True)), ["id", "attempted_by", "fence"], "left").withColumns(
        {
            "errors": F.when(hit & F.col("error").isNotNull(), kept).otherwise(F.col("errors")),
            "output": F.when(hit, F.col("new_output")).otherwise(F.col("output")),
            "snooze_reason": F.when(hit, F.col("reason")).otherwise(F.col("snooze_reason")),
        }
    ).select(*jobs.columns)
    live, done = finalize(rows, results, as_of)
    waits = F.col("state").isin("scheduled", "retryable")
    woken = waits & F.col("wake_requested_at").isNotNull()
    live = live.withColumns(
        {
            "snooze_reason": F.when((F.col("state") == "scheduled") & ~woken, F.col("snooze_reason")),
            "scheduled_at": F.when(woken, F.least("scheduled_at", at(as_of))).otherwise(F.col("scheduled_at")),
            "state": F.when(woken, "available").otherwise(F.col("state")),
            "wake_requested_at": F.when(F.col("state") == "running", F.col("wake_requested_at")),
            "output": F.lit(None).cast("string"),
        }
    )
    return live, done.drop("snooze_reason", "wake_requested_at")
