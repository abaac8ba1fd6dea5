"""Registered queries of sinks, lifecycles, leases, logs and aggregates, with their DuckDB twins."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import claim, compose, ingest, listing, messaging, stats, transitions, uniqueness, upkeep, worker, workflow
from ..sources.ledger import AS_OF, SUBSCRIPTIONS, subscriptions, tables
from .queries import BUDGET, DONE, ELIGIBLE, FOLDED, LEADERS, NOW, POSITION, WAIT, _checkpoints, _leaders, register


def _folder(spark: SparkSession, name: str) -> str:
    return f"{_checkpoints(spark)}/{name}-{uuid.uuid4().hex}"


# --- scans and listings ---------------------------------------------------------------------


@register(f"SELECT id, state, CASE WHEN state IN {DONE} THEN finalized_at END AS finalized_at FROM jobs", "jobs")
def scan_everything(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = tables(spark, sf_dir, "jobs")
    return listing.everything(listing.live(jobs).drop("finalized_at"), listing.history(jobs)).select("id", "state", "finalized_at")


@register(f"SELECT id, state, finalized_at FROM jobs WHERE id = (SELECT min(id) FROM jobs WHERE state IN {DONE})", "jobs")
def job_get_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = tables(spark, sf_dir, "jobs")
    first = listing.history(jobs).agg(F.min("id")).first()[0]
    return listing.find_job(listing.live(jobs).drop("finalized_at"), listing.history(jobs), first or 0).select("id", "state", "finalized_at")


@register("SELECT p.id, n, state FROM (VALUES (7, 1), (-5, 2), (33, 3), (2, 4)) p(id, n) LEFT JOIN jobs j ON j.id = p.id", "jobs")
def list_by_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = spark.createDataFrame([(7, 1), (-5, 2), (33, 3), (2, 4)], "id long, n int")
    return listing.by_ids(tables(spark, sf_dir, "jobs"), ids).select("id", "n", "state")


@register("SELECT id, queue, state FROM jobs WHERE id IN (1, 7, 33, 34) AND priority IN (1, 2, 3, 4)", "jobs")
def list_ids_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = listing.JobFilter(ids=(1, 7, 33, 34), priorities=(1, 2, 3, 4)).apply(tables(spark, sf_dir, "jobs"))
    return found.select("id", "queue", "state")


@register("""SELECT id, state FROM jobs WHERE CAST(json_extract(metadata, '$.tier.level') AS INT) = 2 AND tags IS NOT NULL""", "jobs")
def list_metadata_general(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A filter with an exact decimal, which goes through the general containment."""
    jobs = tables(spark, sf_dir, "jobs").where("tags IS NOT NULL")
    return jobs.where(scalars.metadata_contains("metadata", {"tier": {"level": 2.0}})).select("id", "state")


LOGGED = """logged AS (SELECT id, CAST(n // 2 AS INT) AS attempt, n - 1 AS position, 'log ' || CAST(id AS VARCHAR) || '.' || CAST(n AS VARCHAR) AS log
  FROM jobs, LATERAL (SELECT unnest(range(1, 2 + id % 6)) AS n) x)"""


def _logged(jobs: DataFrame) -> DataFrame:
    entry = lambda n: F.struct(
        F.floor(n / 2).cast("int").alias("attempt"), F.concat(F.lit("log "), F.col("id").cast("string"), F.lit("."), n.cast("string")).alias("log")
    )
    return jobs.withColumn("logs", F.transform(F.sequence(F.lit(1), (1 + F.col("id") % 6).cast("int")), entry))


@register(f"WITH {LOGGED} SELECT id, position, attempt, log FROM logged", "jobs")
def job_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.unpack_logs(_logged(tables(spark, sf_dir, "jobs"))).select("id", F.col("position").cast("long"), "log.attempt", "log.log")


@register(
    f"""WITH {LOGGED}, l AS (SELECT id, attempt, arg_max(log, position) AS log FROM logged GROUP BY id, attempt)
    SELECT id, attempt, log FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY attempt DESC) AS r FROM l) x WHERE r <= 2""", "jobs",
)
def latest_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.latest_logs(_logged(tables(spark, sf_dir, "jobs")), 2)


@register("SELECT conv_id, turn, right(text, 40) AS chunk FROM conversations WHERE strlen(text) = length(text)")
def log_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last 40 bytes of each log, on logs of single-byte characters, where SQL can say it too."""
    logs = spark.read.parquet(f"{sf_dir}/conversations.parquet").where(F.octet_length("text") == F.char_length("text"))
    return listing.read_log(logs, -1, 40).select("conv_id", "turn", F.decode("chunk", "UTF-8").alias("chunk"))


@register(
    """SELECT DISTINCT id FROM (SELECT id, row_number() OVER (PARTITION BY tag ORDER BY id DESC) AS r
      FROM (SELECT DISTINCT id, unnest(tags) AS tag FROM jobs) t WHERE tag IN ('t1', 'b3', 'b7')) x WHERE r <= 20""", "jobs",
)
def newest_per_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.newest_per_tag(tables(spark, sf_dir, "jobs"), ("t1", "b3", "b7"), 20)


@register("SELECT id, unnest(tags) AS tag, CAST(unnest(range(1, len(tags) + 1)) AS INT) AS ordinality FROM jobs WHERE tags IS NOT NULL", "jobs")
def tags_with_ordinality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.tag_rows(tables(spark, sf_dir, "jobs"))


@register("SELECT least(count(*), 101) AS n FROM jobs WHERE queue = 'q1'", "jobs")
def bounded_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A count that stops at 101: the count itself is the feature."""
    n = listing.bounded_count(tables(spark, sf_dir, "jobs").where("queue = 'q1'"), 100)
    return spark.createDataFrame([(n,)], "n long")


@register("SELECT id FROM jobs WHERE state = 'discarded'", "jobs")
def sweep_discarded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages of a sweep, joined again."""
    rows = tables(spark, sf_dir, "jobs").where("state = 'discarded'").select("id")
    pages = list(listing.sweep(rows, 5_000))
    out = rows.limit(0)
    for page in pages:
        out = out.unionByName(page)
    return out


@register(
    f"""SELECT kind, unique_key, id, state, id IN (SELECT job_id FROM edges) AS held FROM jobs j WHERE state NOT IN {DONE} AND EXISTS (
      SELECT 1 FROM jobs k WHERE k.batch_id < 300 AND k.kind = j.kind AND k.unique_key = j.unique_key)""", "jobs", "edges",
)
def keyed_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = tables(spark, sf_dir, "jobs")
    return listing.keyed_live(listing.live(jobs), tables(spark, sf_dir, "edges"), jobs.where("batch_id < 300"))


@register("SELECT id, '{\"id\":' || CAST(id AS VARCHAR) || ',\"kind\":\"' || kind || '\",\"ordering_key\":' || coalesce('\"' || ordering_key || '\"', 'null') || '}' AS value FROM jobs", "jobs")
def jobs_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ingest.as_json(tables(spark, sf_dir, "jobs"), "id", "kind", "ordering_key")
    return rows.select(F.get_json_object("value", "$.id").cast("long").alias("id"), "value")


@register("SELECT id, scenario, ms FROM attempts", "attempts")
def bench_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ingest.as_json(tables(spark, sf_dir, "attempts"), "id", "scenario", "ms")
    return stats.bench_lines(rows.union(spark.createDataFrame([("# no object",), ("",)], "value string")), "id long, scenario string, ms double")


# --- sinks ----------------------------------------------------------------------------------


@register("SELECT queue, CAST(count(*) * 2 AS BIGINT) AS n, CAST(2 * sum(id) AS BIGINT) AS ids FROM jobs GROUP BY queue", "jobs")
def insert_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two bulk appends, read back."""
    path, jobs = _folder(spark, "copied"), tables(spark, sf_dir, "jobs")
    ingest.append_jobs(jobs, path)
    ingest.append_jobs(jobs, path)
    return spark.read.parquet(path).groupBy("queue").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids"))


@register(
    """SELECT CAST(999999 AS BIGINT) AS xid, 5000 + row_number() OVER (ORDER BY seq) - 1 AS seq, topic, CAST(created_at AS DATE) AS day FROM stream""", "stream",
)
def stream_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark, "log")
    ingest.append_events(tables(spark, sf_dir, "stream"), path, 999_999, 5_000, "seq")
    return spark.read.parquet(path).select("xid", "seq", "topic", "day")


@register(f"SELECT id, state, 'failed' AS outcome, CAST(finalized_at AS DATE) AS day FROM jobs WHERE state IN ('canceled', 'discarded')", "jobs")  # noqa: F541
def archive_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finished jobs archived by outcome and day; the failed ones are read from their partitions only."""
    path = _folder(spark, "history")
    ingest.archive(listing.history(tables(spark, sf_dir, "jobs")), path)
    return ingest.read_history(spark, path, "failed").select("id", "state", "outcome", "day")


@register(
    f"""SELECT id FROM (SELECT id, CASE WHEN state = 'completed' THEN 'completed' ELSE 'failed' END AS outcome, CAST(finalized_at AS DATE) AS day FROM jobs WHERE state IN {DONE}) x
    WHERE NOT (day + INTERVAL 1 DAY < {NOW} - CASE WHEN outcome = 'completed' THEN 30 ELSE 200 END * INTERVAL 1 DAY)""", "jobs",
)
def history_after_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    finished = listing.history(tables(spark, sf_dir, "jobs"))
    due = upkeep.partitions_to_drop(finished, {"completed": 30, "failed": 200}, AS_OF)
    return upkeep.drop_days(finished, due).select("id")


# --- claims and transitions -----------------------------------------------------------------


@register(f"WITH {ELIGIBLE} SELECT queue, id FROM (SELECT *, {POSITION} AS p FROM ready) x WHERE p <= 512", "jobs")
def claim_clamped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return claim.claim_next(tables(spark, sf_dir, "jobs"), claim.clamped(100_000), AS_OF).select("queue", "id")


@register(
    f"""WITH {BUDGET}, {ELIGIBLE}, took AS (SELECT queue, count(*) AS n FROM (SELECT *, {POSITION} AS p FROM ready) x LEFT JOIN budgets ON name = queue
      WHERE p <= least(2000, coalesce(budget, 2000)) GROUP BY queue)
    SELECT q.name, CAST(CASE WHEN b.available IS NULL THEN q.tokens ELSE greatest(b.available - coalesce(n, 0), 0) END AS DOUBLE) AS tokens,
      CASE WHEN b.available IS NULL THEN q.refilled_at ELSE {NOW} END AS refilled_at
    FROM queues q LEFT JOIN budgets b ON b.name = q.name LEFT JOIN took ON queue = q.name""", "jobs", "queues",
)
def claim_spends_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs, queues = tables(spark, sf_dir, "jobs"), tables(spark, sf_dir, "queues").withColumn("tokens", F.col("tokens").cast("double"))
    taken = claim.claim_limited(jobs, queues, 2000, AS_OF)
    return claim.spend_tokens(queues, claim.budgets(jobs, queues, 2000, AS_OF), taken, AS_OF).select("name", "tokens", "refilled_at")


@register(f"SELECT id, {NOW} AS wake_requested_at FROM jobs WHERE queue = 'q2' AND ordering_key = 'o58' AND state = 'running'", "jobs")
def wake_marks_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    return claim.mark_lane(tables(spark, sf_dir, "jobs"), "q2", "o58", AS_OF)


@register(
    f"""WITH asked AS (SELECT * FROM jobs WHERE batch_id < 200 AND state IN {DONE})
    SELECT id FROM asked j WHERE unique_key IS NOT NULL AND (
      EXISTS (SELECT 1 FROM jobs l WHERE l.state NOT IN {DONE} AND l.kind = j.kind AND l.unique_key = j.unique_key)
      OR EXISTS (SELECT 1 FROM asked l WHERE l.kind = j.kind AND l.unique_key = j.unique_key AND l.id < j.id))""", "jobs",
)
def retry_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = tables(spark, sf_dir, "jobs")
    return transitions.retry_conflicts(jobs, jobs.where("batch_id < 200"))


@register(
    f"""SELECT id, CASE WHEN state IN {WAIT} AND batch_id < 100 THEN 'canceled' ELSE state END AS state,
      CASE WHEN state IN {WAIT} AND batch_id < 100 THEN {NOW} ELSE finalized_at END AS finalized_at FROM jobs""", "jobs",
)
def cancel_to_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = tables(spark, sf_dir, "jobs")
    left, done = transitions.cancel_rows(jobs, jobs.where("batch_id < 100"), AS_OF)
    return left.unionByName(done).select("id", "state", "finalized_at")


@register(f"SELECT id, 'discarded' AS state, {NOW} AS finalized_at FROM jobs WHERE state IN {WAIT} AND expires_at <= {NOW}", "jobs")
def ttl_discard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transitions.discard_expired(upkeep.expired(tables(spark, sf_dir, "jobs"), AS_OF), AS_OF).select("id", "state", "finalized_at")


ANSWERS = """answers AS (SELECT id, attempted_by, fence, CASE id % 4 WHEN 0 THEN 'completed' WHEN 1 THEN 'retryable' WHEN 2 THEN 'scheduled' ELSE 'discarded' END AS to_state,
    CAST(id % 60 AS DOUBLE) AS delay_seconds, false AS give_back, CASE WHEN id % 2 = 1 THEN 'failed ' || CAST(id AS VARCHAR) END AS error,
    CASE WHEN id % 4 = 0 THEN 'out ' || CAST(id AS VARCHAR) END AS output, CASE WHEN id % 4 = 2 THEN 'later' END AS reason
  FROM jobs WHERE state = 'running' AND attempted_by IS NOT NULL AND id % 9 <> 0)"""


def _answers(jobs: DataFrame) -> DataFrame:
    n, text = F.col("id") % 4, F.col("id").cast("string")
    return jobs.where("state = 'running' AND attempted_by IS NOT NULL AND id % 9 <> 0").select(
        "id", "attempted_by", "fence", F.when(n == 0, "completed").when(n == 1, "retryable").when(n == 2, "scheduled").otherwise("discarded").alias("to_state"),
        (F.col("id") % 60).cast("double").alias("delay_seconds"), F.lit(False).alias("give_back"),
        F.when(F.col("id") % 2 == 1, F.concat(F.lit("failed "), text)).alias("error"), F.when(n == 0, F.concat(F.lit("out "), text)).alias("output"),
        F.when(n == 2, "later").alias("reason"),
    )


@register(
    f"""WITH {ANSWERS}, x AS (
      SELECT j.*, r.id IS NOT NULL AS hit, r.to_state, r.delay_seconds, r.error, r.output AS told, r.reason, j.id % 5 = 0 AND j.state = 'running' AS wake
      FROM jobs j LEFT JOIN answers r ON r.id = j.id AND r.attempted_by = j.attempted_by AND r.fence = j.fence)
    SELECT id, CASE WHEN NOT hit THEN state WHEN to_state IN ('scheduled', 'retryable') AND wake THEN 'available' ELSE to_state END AS state,
      CASE WHEN hit AND to_state IN ('scheduled', 'retryable') THEN CASE WHEN wake THEN {NOW} ELSE {NOW} + CAST(delay_seconds AS INT) * INTERVAL 1 SECOND END ELSE scheduled_at END AS scheduled_at,
      CASE WHEN hit AND error IS NOT NULL THEN error ELSE 'old' END AS last_error, CASE WHEN hit AND to_state IN {DONE} THEN told END AS output,
      CASE WHEN hit AND to_state = 'scheduled' AND NOT wake THEN reason END AS snooze_reason, CASE WHEN NOT hit AND wake THEN {NOW} END AS wake_requested_at
    FROM x""", "jobs",
)
def finalize_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors, output, snooze reasons and wakes of a finalize; stale answers change nothing."""
    none = F.lit(None).cast("string")
    old = F.array(F.struct(F.lit(0).alias("attempt"), F.lit("old").alias("error")))
    jobs = tables(spark, sf_dir, "jobs").withColumns({
        "errors": old, "output": none, "snooze_reason": none,
        "wake_requested_at": F.when((F.col("id") % 5 == 0) & (F.col("state") == "running"), claim.at(AS_OF)),
    })
    left, done = transitions.finalize_rows(jobs, _answers(jobs), AS_OF, 2)
    both = left.unionByName(done, allowMissingColumns=True)
    return both.select("id", "state", "scheduled_at", F.element_at("errors", -1)["error"].alias("last_error"), "output", "snooze_reason", "wake_requested_at")


@register(f"SELECT batch_id, count(*) AS done, count(*) FILTER (state <> 'completed') AS failed FROM jobs WHERE state IN {DONE} GROUP BY batch_id", "jobs")
def batch_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.batch_counts(listing.history(tables(spark, sf_dir, "jobs")))


@register(f"WITH {FOLDED} SELECT id, pending, failed, CASE WHEN complete THEN 'complete' ELSE 'open' END AS state FROM folded", "batches", "batch_progress")
def batch_settled(spark: SparkSession, sf_dir: str) -> DataFrame:
    folded = workflow.fold_progress(tables(spark, sf_dir, "batches"), tables(spark, sf_dir, "batch_progress"))
    return workflow.settle(folded).select("id", "pending", "failed", "state")


@register(
    """SELECT job_id FROM (SELECT e.job_id, e.any_of, bool_or(on_failure = 'any_cancel') AS cancels,
        bool_or(s.state IS NULL OR s.state = 'completed') AS fine, bool_or(s.state NOT IN ('completed', 'canceled', 'discarded')) AS alive
      FROM edges e LEFT JOIN steps s ON s.job_id = e.depends_on WHERE any_of IS NOT NULL GROUP BY ALL) x
    WHERE cancels AND NOT fine AND NOT coalesce(alive, false) GROUP BY job_id""", "edges", "steps",
)
def any_of_exhausted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workflow.exhausted(tables(spark, sf_dir, "edges"), tables(spark, sf_dir, "steps"))


@register(
    """SELECT s.batch_id, s.job_id, 'completed' AS state FROM steps s WHERE s.state = 'available' AND s.job_id IN (SELECT depends_on FROM edges)""", "edges", "steps",
)
def step_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open steps that all complete at once: the results that others read."""
    steps = tables(spark, sf_dir, "steps")
    finished = steps.where("state = 'available'").select("job_id", F.lit("completed").alias("to_state"))
    settled = compose.finalize_steps(steps, tables(spark, sf_dir, "edges"), finished)
    return settled.results.join(finished.select("job_id"), "job_id", "left_semi").select("batch_id", "job_id", "state")


@register(
    """SELECT * FROM (VALUES (900, 1, 'a', 'available', 0), (900, 2, 'b', 'pending', 1), (900, 3, 'c', 'pending', 2), (900, 4, 'd', 'pending', 2))
    t(batch_id, job_id, step, state, needs)"""
)
def workflow_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks = [{"name": "a"}, {"name": "b", "depends_on": ["a"]}, {"name": "c", "depends_on": ["a", "b"]}, {"name": "d", "any_of": [["b", "c"]]}]
    steps, edges = compose.insert_workflow(spark, 900, tasks, 1)
    needs = edges.groupBy("job_id").agg(F.count(F.lit(1)).alias("needs"))
    return steps.join(needs, "job_id", "left").select("batch_id", "job_id", "step", "state", F.coalesce("needs", F.lit(0)).alias("needs"))


@register("SELECT id, CASE WHEN state = 'scheduled' THEN 'waits for ' || kind END AS snooze_reason FROM jobs", "jobs")
def snooze_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    reason = compose.snooze_reason(F.col("state"), F.concat(F.lit("waits for "), "kind"))
    return tables(spark, sf_dir, "jobs").select("id", reason.alias("snooze_reason"))


@register("SELECT id, list_transform(range(greatest(0, id % 6 - 2), id % 6), lambda n: 'run ' || CAST(n AS VARCHAR)) || ['last'] AS logs FROM jobs", "jobs")
def logs_appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log is appended, the last three stay, and the snoozed run of the same attempt is replaced."""
    old = F.transform(F.sequence(F.lit(0), (F.col("id") % 6).cast("int")), lambda n: F.struct(n.alias("attempt"), (n == F.col("id") % 6).alias("snoozed"), F.concat(F.lit("run "), n.cast("string")).alias("log")))
    rows = tables(spark, sf_dir, "jobs").withColumn("old", old)
    now = compose.append_log(F.col("old"), (F.col("id") % 6).cast("int"), F.lit("last"), F.lit(False), 3)
    return rows.select("id", F.transform(now, lambda e: e["log"]).alias("logs"))


# --- uniqueness -----------------------------------------------------------------------------


@register(
    f"""SELECT j.id, x.priority FROM jobs j JOIN (SELECT kind, unique_key, arg_max(1 + id % 4, id) AS priority FROM jobs WHERE unique_key IS NOT NULL GROUP BY ALL) x
      USING (kind, unique_key) WHERE j.state IN {WAIT}""", "jobs",
)
def unique_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = tables(spark, sf_dir, "jobs")
    rows = jobs.where("unique_key IS NOT NULL").select(F.col("id").alias("seq"), "kind", "unique_key", (1 + F.col("id") % 4).cast("long").alias("priority"))
    return uniqueness.replace_live(rows, listing.live(jobs), ("priority",)).select("id", "priority")


@register("SELECT id, 'a=' || replace(metadata, ' ', '') || chr(10) || 'q=' || queue || chr(10) || 'p=' || strftime(date_trunc('hour', scheduled_at), '%Y-%m-%dT%H:%M:%SZ') AS unique_key FROM jobs", "jobs")
def unique_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = scalars.period_start(F.col("scheduled_at"), 3600)
    return tables(spark, sf_dir, "jobs").select("id", scalars.unique_key_column(F.col("metadata"), F.col("queue"), start).alias("unique_key"))


@register("SELECT id, scheduled_at - to_microseconds((epoch_us(scheduled_at) + 62135596800000000) % 604800000000) AS start FROM jobs", "jobs")
def period_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables(spark, sf_dir, "jobs").select("id", scalars.period_start(F.col("scheduled_at"), 604_800).alias("start"))


# --- leases, queues and periodic jobs -------------------------------------------------------


@register(
    f"""SELECT id, CASE WHEN hit THEN {NOW} ELSE renewed_at END AS renewed_at, CASE WHEN hit THEN {NOW} + ttl_days * INTERVAL 1 DAY ELSE expires_at END AS expires_at
    FROM (SELECT *, id % 4 <> 0 AND expires_at > {NOW} AS hit FROM leases) x""", "leases",
)
def leases_renewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    leases = tables(spark, sf_dir, "leases")
    return upkeep.renew_leases(leases, leases.where("id % 4 <> 0"), AS_OF).select("id", "renewed_at", "expires_at")


@register(
    f"""SELECT j.id, CASE WHEN attempt >= max_attempts THEN 'discarded' ELSE 'retryable' END AS to_state FROM jobs j JOIN leases l ON l.id = j.id
    WHERE state = 'running' AND attempted_by IS NULL AND l.expires_at <= {NOW}""", "jobs", "leases",
)
def leases_expired(spark: SparkSession, sf_dir: str) -> DataFrame:
    due = tables(spark, sf_dir, "leases").where(F.col("expires_at") <= claim.at(AS_OF))
    return upkeep.expire_leases(tables(spark, sf_dir, "jobs"), due, AS_OF)


@register(
    f"""SELECT id, attempt + 1 AS attempt, fence + 1 AS fence FROM jobs WHERE batch_id < 400 AND state IN {WAIT} AND scheduled_at <= {NOW}
      AND (expires_at IS NULL OR expires_at > {NOW})""", "jobs",
)
def claim_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = tables(spark, sf_dir, "jobs")
    return upkeep.claim_by_id(jobs, jobs.where("batch_id < 400"), AS_OF)


@register("SELECT name, name IN ('q1', 'q3') OR paused AS paused FROM queues UNION ALL SELECT 'q7', false", "queues")
def queues_paused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queues that are ensured, then paused."""
    names = spark.createDataFrame([("q1",), ("q7",), ("q7",)], "name string")
    return upkeep.pause_queues(upkeep.ensure_queues(tables(spark, sf_dir, "queues"), names), ("q1", "q3")).select("name", "paused")


@register(
    """WITH slots AS (SELECT queue AS name, scheduled_at AS slot FROM jobs GROUP BY ALL),
      last AS (SELECT * FROM (VALUES ('q0', TIMESTAMP '1997-01-01'), ('q1', TIMESTAMP '1996-01-01')) l(name, last_slot))
    SELECT name, slot, 'periodic:' || name || ':' || strftime(slot, '%Y-%m-%dT%H:%M:%S') AS unique_key FROM slots LEFT JOIN last USING (name) WHERE last_slot IS NULL OR slot > last_slot""", "jobs",
)
def periodic_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    slots = tables(spark, sf_dir, "jobs").select(F.col("queue").alias("name"), F.col("scheduled_at").alias("slot")).distinct()
    last = spark.createDataFrame([("q0", "1997-01-01"), ("q1", "1996-01-01")], "name string, at string").select("name", F.col("at").cast("timestamp_ntz").alias("last_slot"))
    return upkeep.insert_slots(slots, last)[0]


@register(
    """SELECT name, slot FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY slot DESC) AS r
      FROM (SELECT DISTINCT queue AS name, scheduled_at AS slot FROM jobs) s) x WHERE r <= 5""", "jobs",
)
def periodic_last_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    slots = tables(spark, sf_dir, "jobs").select(F.col("queue").alias("name"), F.col("scheduled_at").alias("slot")).distinct()
    return upkeep.latest_slots(slots, 5)


# --- messaging ------------------------------------------------------------------------------

PUBLISHED = {"clicks": '{"team": "web", "level": 1}', "errors": '{"level": 9}'}


@register(
    f"""SELECT xid, seq, s.name AS subscription, 'msg:m' || CAST(seq AS VARCHAR) AS unique_key, 'scheduled' AS state, {NOW} + INTERVAL 60 SECONDS AS scheduled_at,
      {NOW} + INTERVAL 3660 SECONDS AS expires_at, CAST(seq % 7 AS VARCHAR) AS level, CASE WHEN s.name = 'clicks' THEN 'web' END AS team
    FROM stream e JOIN subscriptions s ON (s.name = 'clicks' AND topic LIKE 'ev.click.%') OR (s.name = 'errors' AND topic LIKE 'ev.error%')""", "stream", "subscriptions",
)
def publish_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delay, time to live, dedup keys and merged metadata of a publish."""
    headers = F.concat(F.lit('{"level": '), (F.col("seq") % 7).cast("string"), F.lit("}"))
    events = tables(spark, sf_dir, "stream").withColumn("message_id", F.concat(F.lit("m"), F.col("seq").cast("string"))).withColumn("headers", headers)
    found = messaging.publish(events, [s for s in SUBSCRIPTIONS if s[0] in PUBLISHED], PUBLISHED, 60, 3600, AS_OF)
    return found.select(
        "xid", "seq", "subscription", "unique_key", "state", "scheduled_at", "expires_at",
        F.get_json_object("metadata", "$.level").alias("level"), F.get_json_object("metadata", "$.team").alias("team"),
    )


@register(
    """SELECT 'clicks' AS subscription, count(*) FILTER (seq % 3 <> 0) AS inserted, count(*) FILTER (seq % 3 = 0) AS duplicates
    FROM stream WHERE topic LIKE 'ev.click.%'""", "stream",
)
def publish_dedup_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = tables(spark, sf_dir, "stream").withColumn("message_id", F.col("seq").cast("string"))
    found = messaging.deduplicated(messaging.fan_out(events, [SUBSCRIPTIONS[1]]).withColumn("message_id", F.col("seq").cast("string")), "message_id")
    held = events.where("seq % 3 = 0").select(F.lit("click").alias("kind"), F.concat(F.lit("msg:"), F.col("message_id")).alias("unique_key"))
    return messaging.publish_counts(found, held)


@register(
    """SELECT xid, seq, 'audit' AS kind, CASE WHEN key IS NOT NULL THEN 'c1:' || key END AS ordering_key,
      'stream:c1:' || CAST(xid AS VARCHAR) || ':' || CAST(seq AS VARCHAR) AS unique_key, 'consumer' AS source FROM stream WHERE topic LIKE 'ev.view.%'""", "stream",
)
def stream_deliver(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordering lanes of a consumer, whose metadata wins."""
    events = tables(spark, sf_dir, "stream").where("topic LIKE 'ev.view.%'").withColumn("headers", F.lit('{"source": "event"}'))
    jobs = messaging.deliver(events, "c1", "audit", True, metadata='{"source": "consumer"}')
    return jobs.select("xid", "seq", "kind", "ordering_key", "unique_key", F.get_json_object("metadata", "$.source").alias("source"))


@register("SELECT CAST(created_at AS DATE) AS day, count(*) AS n FROM stream GROUP BY day HAVING day + INTERVAL 1 DAY <= TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 7 DAYS", "stream")
def stream_days_to_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messaging.days_to_drop(tables(spark, sf_dir, "stream"), 7, "2024-01-20 00:00:00")


@register("SELECT seq, CAST(xid AS VARCHAR) || ':' || CAST(seq AS VARCHAR) AS position, xid AS back FROM stream", "stream")
def stream_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables(spark, sf_dir, "stream").withColumn("position", scalars.position_text(F.col("xid"), F.col("seq")))
    return rows.select("seq", "position", scalars.parse_position(F.col("position"))["xid"].alias("back"))


@register("SELECT DISTINCT topic, CAST(len(string_split(topic, '.')) AS INT) AS parts, CAST(strlen(topic) AS INT) AS bytes FROM stream", "stream")
def topic_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables(spark, sf_dir, "stream").select("topic").distinct()
    return rows.select("topic", F.size(F.split("topic", r"\.")).alias("parts"), F.octet_length("topic").alias("bytes"))


# --- statistics -----------------------------------------------------------------------------


@register(
    f"""WITH {LEADERS} SELECT (SELECT count(*) FROM clients WHERE expires_at > {NOW}) AS live_clients,
      coalesce((SELECT max(client_id) FROM leaders WHERE name = 'default' AND expires_at > {NOW}), 0) AS leader""", "clients",
)
def cluster_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.cluster(tables(spark, sf_dir, "clients"), _leaders(spark), AS_OF)


@register("SELECT queue, '{' || string_agg('\"' || state || '\":' || CAST(n AS VARCHAR), ',' ORDER BY state) || '}' AS object FROM (SELECT queue, state, count(*) AS n FROM jobs GROUP BY ALL) x GROUP BY queue", "jobs")
def states_as_object(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = tables(spark, sf_dir, "jobs").groupBy("queue", "state").agg(F.count(F.lit(1)).alias("n"))
    return stats.as_object(counts, "queue", "state", "n")


@register("SELECT queue, string_agg(DISTINCT kind, ',' ORDER BY kind) AS text FROM jobs GROUP BY queue", "jobs")
def kinds_as_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.joined_text(tables(spark, sf_dir, "jobs"), "queue", "kind")


@register(
    f"""SELECT CAST(d AS DATE) AS day, count(j.id) AS n FROM generate_series(TIMESTAMP '1995-01-01', TIMESTAMP '1995-03-31', INTERVAL 1 DAY) t(d)
    LEFT JOIN jobs j ON CAST(j.finalized_at AS DATE) = CAST(d AS DATE) AND state IN {DONE} GROUP BY d""", "jobs",
)
def finalized_per_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.per_day(listing.history(tables(spark, sf_dir, "jobs")), "finalized_at", "1995-01-01", "1995-03-31")


# --- functions ------------------------------------------------------------------------------


@register("SELECT id, least(2.0 * pow(2, greatest(attempt, 1) - 1), 10.0) AS delay FROM jobs", "jobs")
def exponential_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables(spark, sf_dir, "jobs").select("id", scalars.exponential_seconds(F.col("attempt"), 2.0, 10.0).alias("delay"))


@register(
    """SELECT id, substr(ms, 1, 8) || '-' || substr(ms, 9, 4) || '-7' || substr(r, 1, 3) || '-' ||
      substr('89ab', 1 + (strpos('0123456789abcdef', substr(r, 4, 1)) - 1) % 4, 1) || substr(r, 5, 3) || '-' || substr(r, 8, 12) AS uuid
    FROM (SELECT id, printf('%012x', epoch_ms(scheduled_at)) AS ms, sha256(CAST(id AS VARCHAR)) AS r FROM jobs) x""", "jobs",
)
def uuid7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    bits = F.sha2(F.col("id").cast("string"), 256)
    return tables(spark, sf_dir, "jobs").select("id", scalars.uuid7(F.col("scheduled_at"), bits).alias("uuid"))


@register("SELECT id, CAST(id % 30000 AS SMALLINT) AS small FROM jobs", "jobs")
def small_ints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables(spark, sf_dir, "jobs").select("id", scalars.small_int(F.col("id") % 30_000).alias("small"))


@register(
    """SELECT id, CASE WHEN len(c) > 0 THEN c END AS tags FROM (SELECT id, list_filter(l, lambda x, i: x <> '' AND list_position(l, x) = i) AS c
      FROM (SELECT id, ['b' || CAST(id % 3 AS VARCHAR), '', CASE WHEN id % 2 = 0 THEN 'b0' ELSE '' END, 'a', 'a'] AS l FROM jobs) x) y""", "jobs",
)
def cleaned_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.array(F.concat(F.lit("b"), (F.col("id") % 3).cast("string")), F.lit(""), F.when(F.col("id") % 2 == 0, "b0").otherwise(""), F.lit("a"), F.lit("a"))
    return tables(spark, sf_dir, "jobs").select("id", scalars.clean_tags(raw).alias("tags"))


@register(
    """SELECT id, CAST(json_extract_string(json_merge_patch(metadata, '{"tenant": 99, "source": "x"}'), '$.tenant') AS INT) AS tenant, 'x' AS source,
      CAST(json_extract(metadata, '$.tier.level') AS INT) AS level, CAST(json_extract(metadata, '$.tenant') AS INT) AS kept FROM jobs""", "jobs",
)
def merged_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both directions of a merge: the later object wins, whichever it is."""
    other = F.lit('{"tenant": 99, "source": "x"}')
    now, back = scalars.merged_objects(F.col("metadata"), other), scalars.merged_objects(other, F.col("metadata"))
    value = lambda c, path: F.get_json_object(c, path).cast("int")
    return tables(spark, sf_dir, "jobs").select(
        "id", value(now, "$.tenant").alias("tenant"), F.get_json_object(now, "$.source").alias("source"),
        value(now, "$.tier.level").alias("level"), value(back, "$.tenant").alias("kept"),
    )


# --- workers --------------------------------------------------------------------------------


@register(
    f"""SELECT id, fence, CASE WHEN kind = 'k1' THEN 'ok' ELSE 'error' END AS result,
      CASE WHEN kind = 'k1' THEN '[' || queue || '/' || CAST(attempt AS VARCHAR) || ']' END AS output,
      CASE kind WHEN 'k1' THEN NULL WHEN 'k2' THEN 'ValueError: refused ' || CAST(id AS VARCHAR) ELSE 'no worker for ' || kind END AS error
    FROM jobs WHERE state = 'running' AND attempted_by IS NOT NULL""", "jobs",
)  # fmt: skip  # noqa: F541
def worker_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Handlers by kind with middleware around them over the running jobs."""

    def mail(job: dict) -> tuple[str, str | None, str | None]:
        return "ok", f"{job['queue']}/{job['attempt']}", None

    def refuse(job: dict) -> tuple[str, str | None, str | None]:
        raise ValueError(f"refused {job['id']}")

    def bracketed(handler):
        def run(job: dict):
            result, output, error = handler(job)
            return result, f"[{output}]", error

        return run

    claimed = tables(spark, sf_dir, "jobs").where("state = 'running' AND attempted_by IS NOT NULL").select("id", "attempted_by", "fence", "kind", "queue", "attempt")
    return worker.work(claimed, {"k1": mail, "k2": refuse}, [bracketed]).select("id", "fence", "result", "output", "error")


@register("SELECT id, CASE WHEN id % 4 = 0 THEN 1.5 WHEN kind = 'k2' THEN 30.0 ELSE least(pow(attempt, 4) + 5, 86400.0) END AS delay FROM jobs", "jobs")
def retry_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = F.when(F.col("id") % 4 == 0, 1.5)
    return tables(spark, sf_dir, "jobs").select("id", worker.retry_delay(F.col("attempt"), F.col("kind"), {"k2": 30.0}, own).alias("delay"))


@register("SELECT name, pattern FROM subscriptions", "subscriptions")
def subscription_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subscriptions(spark).select("name", "pattern")
