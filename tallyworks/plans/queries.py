"""Registered ledger queries, each with its DuckDB twin where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import claim, compose, listing, messaging, stats, transitions, uniqueness, upkeep, workflow
from ..sources.ledger import AS_OF, SUBSCRIPTIONS, duck_rule, duck_subscriptions, subscriptions, tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

NOW = f"TIMESTAMP '{AS_OF}'"
WAIT = "('available', 'scheduled', 'retryable')"
DONE = "('completed', 'canceled', 'discarded')"


def register(sql: str | None = None, *rules: str):
    """Register a query; ``rules`` are derived tables that its SQL reads."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            parts = [f"{r} AS ({duck_subscriptions() if r == 'subscriptions' else duck_rule(r)})" for r in rules]
            body = sql.strip()
            if body.upper().startswith("WITH "):
                recursive = "RECURSIVE " if body.upper().startswith("WITH RECURSIVE") else ""
                body = body[len("WITH RECURSIVE ") if recursive else len("WITH ") :]
                ORACLE_SQL[f.__name__] = f"WITH {recursive}{', '.join(parts)}, {body}"
            else:
                ORACLE_SQL[f.__name__] = f"WITH {', '.join(parts)} {body}" if parts else body
        return f

    return add


ELIGIBLE = f"""
  ready AS (
    SELECT j.* FROM jobs j
    WHERE state IN {WAIT} AND scheduled_at <= {NOW} AND (expires_at IS NULL OR expires_at > {NOW})
      AND (ordering_key IS NULL OR (
        NOT EXISTS (SELECT 1 FROM jobs r WHERE r.queue = j.queue AND r.ordering_key = j.ordering_key AND r.state = 'running')
        AND seq = (SELECT min(h.seq) FROM jobs h WHERE h.queue = j.queue AND h.ordering_key = j.ordering_key AND h.state IN {WAIT}))))"""
POSITION = "row_number() OVER (PARTITION BY queue ORDER BY priority, scheduled_at, seq)"


@register(f"WITH {ELIGIBLE} SELECT queue, id, position FROM (SELECT *, CAST({POSITION} AS INT) AS position FROM ready) x WHERE position <= 200", "jobs")
def claim_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return claim.claim_next(tables(spark, sf_dir, "jobs"), 200, AS_OF).select("queue", "id", "position")


@register(f"WITH {ELIGIBLE} SELECT queue, ordering_key, id FROM ready WHERE ordering_key IS NOT NULL", "jobs")
def claim_ordering_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return claim.eligible(tables(spark, sf_dir, "jobs"), AS_OF).where("ordering_key IS NOT NULL").select("queue", "ordering_key", "id")


WITHIN = f"""{ELIGIBLE},
  run AS (SELECT queue, partition_key, count(*) AS n FROM jobs
          WHERE state = 'running' AND attempted_by IS NOT NULL AND partition_key IS NOT NULL GROUP BY ALL),
  slots AS (SELECT *, row_number() OVER (PARTITION BY queue, partition_key ORDER BY priority, scheduled_at, seq) AS slot FROM ready),
  allowed AS (SELECT s.* FROM slots s LEFT JOIN run r ON r.queue = s.queue AND r.partition_key = s.partition_key
              WHERE s.partition_key IS NULL OR slot + coalesce(n, 0) <= 30)"""


@register(f"WITH {WITHIN} SELECT queue, partition_key, id FROM allowed", "jobs")
def claim_partition_limited(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = tables(spark, sf_dir, "jobs")
    return claim.within_partitions(jobs, claim.eligible(jobs, AS_OF), 30).select("queue", "partition_key", "id")


BUDGET = f"""
  run AS (SELECT queue AS name, count(*) AS running FROM jobs WHERE state = 'running' AND attempted_by IS NOT NULL GROUP BY queue),
  b AS (SELECT q.*, coalesce(r.running, 0) AS run,
          CASE WHEN rate_per_sec > 0 THEN least(CASE WHEN rate_burst > 0 THEN rate_burst ELSE ceil(rate_per_sec) END,
            tokens + rate_per_sec * (epoch_us({NOW}) - epoch_us(refilled_at)) / 1e6) END AS available
        FROM queues q LEFT JOIN run r USING (name)),
  budgets AS (SELECT name, run AS running, CAST(available AS DOUBLE) AS available,
    CAST(greatest(least(2000, coalesce(global_limit - run, 2000), coalesce(floor(available), 2000)), 0) AS BIGINT) AS budget,
    CAST(CASE WHEN rate_per_sec > 0 AND floor(available) <= 0 THEN (1 - available) / rate_per_sec END AS DOUBLE) AS wait_seconds FROM b)"""


@register(f"WITH {BUDGET} SELECT * FROM budgets", "jobs", "queues")
def claim_budget_token_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return claim.budgets(tables(spark, sf_dir, "jobs"), tables(spark, sf_dir, "queues"), 2000, AS_OF)


@register(
    f"WITH {BUDGET}, {ELIGIBLE} SELECT queue, id, position FROM (SELECT *, CAST({POSITION} AS INT) AS position FROM ready) x "
    "LEFT JOIN budgets ON name = queue WHERE position <= least(2000, coalesce(budget, 2000))", "jobs", "queues",
)
def claim_with_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return claim.claim_limited(tables(spark, sf_dir, "jobs"), tables(spark, sf_dir, "queues"), 2000, AS_OF).select("queue", "id", "position")


@register(
    f"""WITH {WITHIN}, chosen AS (SELECT id FROM (SELECT *, {POSITION} AS p FROM allowed) x WHERE p <= 500)
    SELECT j.id, CASE WHEN c.id IS NULL THEN state ELSE 'running' END AS state, CAST(attempt + CASE WHEN c.id IS NULL THEN 0 ELSE 1 END AS INT) AS attempt,
      fence + CASE WHEN c.id IS NULL THEN 0 ELSE 1 END AS fence, CASE WHEN c.id IS NULL THEN attempted_by ELSE 7777 END AS attempted_by
    FROM jobs j LEFT JOIN chosen c ON c.id = j.id""", "jobs",
)
def claim_transition(spark: SparkSession, sf_dir: str) -> DataFrame:
    after = claim.claim(tables(spark, sf_dir, "jobs"), 500, 7777, AS_OF, partition_limit=30)
    return after.select("id", "state", "attempt", "fence", "attempted_by")


@register(f"SELECT id, CAST(priority - 1 AS INT) AS priority FROM jobs WHERE state IN {WAIT} AND priority > 1 AND scheduled_at <= {NOW} - INTERVAL 864000 SECONDS", "jobs")
def age_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return claim.aging(tables(spark, sf_dir, "jobs"), 864_000, AS_OF).select("id", "priority")


@register(
    f"""SELECT id, 'available' AS state FROM jobs WHERE queue = 'q2' AND ordering_key = 'o58' AND state IN ('scheduled', 'retryable')
      AND (expires_at IS NULL OR expires_at > {NOW}) ORDER BY seq LIMIT 20""", "jobs",
)
def wake_ordering_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return claim.wake_lane(tables(spark, sf_dir, "jobs"), "q2", "o58", 20, AS_OF).select("id", "state")


@register(f"SELECT id, expires_at FROM jobs WHERE state IN {WAIT} AND expires_at <= {NOW}", "jobs")
def ttl_expired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upkeep.expired(tables(spark, sf_dir, "jobs"), AS_OF).select("id", "expires_at")


RESCUE = f"""rescued AS (
  SELECT j.*, attempted_at < {NOW} - INTERVAL 31536000 SECONDS AS stuck FROM jobs j
  WHERE state = 'running' AND attempted_by IS NOT NULL AND (attempted_at < {NOW} - INTERVAL 31536000 SECONDS
    OR NOT EXISTS (SELECT 1 FROM clients c WHERE c.id = attempted_by AND c.expires_at > {NOW})))"""


@register(f"WITH {RESCUE} SELECT id, attempted_by, stuck FROM rescued", "jobs", "clients")
def rescue_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upkeep.rescue_candidates(tables(spark, sf_dir, "jobs"), tables(spark, sf_dir, "clients"), 31_536_000, AS_OF)


@register(f"WITH {RESCUE} SELECT id, CASE WHEN attempt >= max_attempts THEN 'discarded' ELSE 'retryable' END AS state FROM rescued", "jobs", "clients")
def rescue_transition(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = tables(spark, sf_dir, "jobs")
    found = upkeep.rescue_candidates(jobs, tables(spark, sf_dir, "clients"), 31_536_000, AS_OF)
    return transitions.rescue(jobs, found, AS_OF).select("id", "state")


@register(
    f"""SELECT id, renewed_at, expires_at FROM leases l WHERE expires_at <= {NOW} AND coalesce(
      (SELECT min(c.started_at) FROM clients c WHERE c.started_at > l.renewed_at AND c.started_at <= {NOW} AND c.expires_at > {NOW})
      + greatest(ttl_days, 3) * INTERVAL 1 DAY, expires_at) <= {NOW}""", "leases", "clients",
)
def leases_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upkeep.leases_due(tables(spark, sf_dir, "leases"), tables(spark, sf_dir, "clients"), 3, AS_OF)


AGE = f"(epoch_us({NOW}) - epoch_us(scheduled_at)) / 1e6"


@register(
    f"""SELECT queue, state, count(*) AS n, CAST(max({AGE}) FILTER (state IN {WAIT} AND scheduled_at <= {NOW}) AS DOUBLE) AS oldest_due_seconds
    FROM jobs WHERE state NOT IN {DONE} GROUP BY queue, state""", "jobs",
)
def depth_by_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.depth(listing.live(tables(spark, sf_dir, "jobs")), AS_OF)


@register(
    f"""WITH c AS (SELECT queue AS name, count(*) FILTER (state = 'available') AS available, count(*) FILTER (state = 'scheduled') AS scheduled,
        count(*) FILTER (state = 'retryable') AS retryable, count(*) FILTER (state = 'running') AS running,
        CAST(max({AGE}) FILTER (scheduled_at <= {NOW} AND state <> 'running') AS DOUBLE) AS oldest_seconds
      FROM jobs WHERE state NOT IN {DONE} GROUP BY queue)
    SELECT name, coalesce(paused, false) AS paused, coalesce(available, 0) AS available, coalesce(scheduled, 0) AS scheduled,
      coalesce(retryable, 0) AS retryable, coalesce(running, 0) AS running, oldest_seconds
    FROM c FULL JOIN queues USING (name)""", "jobs", "queues",
)
def queue_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.queue_stats(listing.live(tables(spark, sf_dir, "jobs")), tables(spark, sf_dir, "queues"), AS_OF)


@register("SELECT attempted_by, count(*) AS n FROM jobs WHERE state = 'running' AND attempted_by IS NOT NULL GROUP BY attempted_by", "jobs")
def running_by_client(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.running_by_client(tables(spark, sf_dir, "jobs"))


@register(
    f"""SELECT name, (SELECT count(*) FROM jobs WHERE queue = name AND state = 'completed' AND finalized_at <= {NOW}
      AND finalized_at > {NOW} - INTERVAL 2592000 SECONDS) AS n FROM queues""", "jobs", "queues",
)
def completed_last_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.completed_within(listing.history(tables(spark, sf_dir, "jobs")), tables(spark, sf_dir, "queues"), 2_592_000, AS_OF)


LEADERS = f"leaders AS (SELECT 'default' AS name, CAST(7 AS BIGINT) AS client_id, {NOW} + INTERVAL 15 SECONDS AS expires_at UNION ALL SELECT 'other', 8, {NOW})"


def _leaders(spark: SparkSession) -> DataFrame:
    ends = claim.at(AS_OF) + F.make_dt_interval(secs=F.when(F.col("name") == "default", 15).otherwise(0))
    return spark.createDataFrame([("default", 7), ("other", 8)], "name string, client_id long").withColumn("expires_at", ends)


@register(
    f"""WITH {LEADERS} SELECT c.id, hostname, c.expires_at > {NOW} AS live, l.client_id IS NOT NULL AS leads FROM clients c
    LEFT JOIN leaders l ON l.client_id = c.id AND l.name = 'default' AND l.expires_at > {NOW}""", "clients",
)
def client_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clients and whether they lead: a lease in the table of leaders decides (a fixed sample here)."""
    now = claim.at(AS_OF)
    lead = _leaders(spark).where((F.col("name") == "default") & (F.col("expires_at") > now)).select(F.col("client_id").alias("id"), F.lit(True).alias("leads"))
    rows = tables(spark, sf_dir, "clients").join(F.broadcast(lead), "id", "left")
    return rows.select("id", "hostname", (F.col("expires_at") > now).alias("live"), F.coalesce("leads", F.lit(False)).alias("leads"))


def _listed(condition: str) -> str:
    return f"SELECT id, queue, state FROM jobs WHERE {condition}"


def _list(spark: SparkSession, sf_dir: str, **wanted) -> DataFrame:
    return listing.JobFilter(**wanted).apply(tables(spark, sf_dir, "jobs")).select("id", "queue", "state")


@register(_listed("queue = 'q1' AND kind IN ('k1', 'k2') AND state IN ('available', 'discarded') AND priority IN (1, 2)"), "jobs")
def list_by_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _list(spark, sf_dir, queue="q1", kinds=("k1", "k2"), states=("available", "discarded"), priorities=(1, 2))


@register(_listed("queue = 'q2' AND ordering_key = 'o5'"), "jobs")
def list_ordering_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _list(spark, sf_dir, queue="q2", ordering_key="o5")


@register(_listed("list_has_any(tags, ['t1', 'b3'])"), "jobs")
def list_tags_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _list(spark, sf_dir, tags_any=("t1", "b3"))


@register(_listed("list_has_all(tags, ['t1', 'b3'])"), "jobs")
def list_tags_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _list(spark, sf_dir, tags_all=("t1", "b3"))


@register(_listed("json_contains(metadata, '{\"tenant\": 3, \"tier\": {\"level\": 1}}')"), "jobs")
def list_metadata_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _list(spark, sf_dir, metadata={"tenant": 3, "tier": {"level": 1}})


@register("SELECT id, queue, state FROM jobs WHERE id < 9000 ORDER BY id DESC LIMIT 100", "jobs")
def list_newest_keyset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.page(tables(spark, sf_dir, "jobs"), 100, after=9000, newest=True).select("id", "queue", "state")


@register("SELECT j.id, state, l.expires_at AS lease_expires_at FROM jobs j LEFT JOIN leases l ON l.id = j.id WHERE j.id = 42", "jobs", "leases")
def job_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.get_job(tables(spark, sf_dir, "jobs"), tables(spark, sf_dir, "leases"), 42).select("id", "state", "lease_expires_at")


@register("SELECT job_id, fence, size FROM log_runs WHERE job_id > 5 OR (job_id = 5 AND fence < 3) ORDER BY job_id, fence DESC LIMIT 50", "log_runs")
def log_runs_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.log_runs_page(tables(spark, sf_dir, "log_runs"), 50, (5, 3)).select("job_id", "fence", "size")


@register("SELECT count(*) AS runs, CAST(sum(size) AS BIGINT) AS bytes FROM log_runs", "log_runs")
def log_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.log_totals(tables(spark, sf_dir, "log_runs"))


@register(
    """SELECT seq, kind, first_seq, CASE WHEN seq = first_seq THEN 'insert' WHEN s IS NOT DISTINCT FROM fs THEN 'duplicate' ELSE 'later' END AS action
    FROM (SELECT seq, kind, finished_states AS s, min(seq) OVER w AS first_seq, first(finished_states) OVER (w ORDER BY seq) AS fs
          FROM candidates WINDOW w AS (PARTITION BY kind, unique_key)) x""", "candidates",
)
def unique_in_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return uniqueness.in_batch(tables(spark, sf_dir, "candidates"))


INCOMING = "incoming AS (SELECT id AS seq, kind, unique_key FROM jobs WHERE unique_key IS NOT NULL)"


@register(
    f"""WITH {INCOMING}, held AS (SELECT kind, unique_key, min(id) AS live_id, arg_min(state, id) AS s FROM jobs
      WHERE state NOT IN {DONE} AND unique_key IS NOT NULL GROUP BY ALL)
    SELECT seq, live_id, CASE WHEN s = 'running' THEN 'keep' ELSE 'replace' END AS action FROM incoming JOIN held USING (kind, unique_key)""", "jobs",
)
def unique_live_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = tables(spark, sf_dir, "jobs")
    incoming = jobs.where("unique_key IS NOT NULL").select(F.col("id").alias("seq"), "kind", "unique_key")
    return uniqueness.live_conflicts(incoming, listing.live(jobs))


@register(
    f"""WITH {INCOMING}, done AS (SELECT *, row_number() OVER (PARTITION BY kind, unique_key ORDER BY finalized_at DESC, id DESC) AS rn
      FROM jobs WHERE state IN ('completed', 'discarded') AND unique_key IS NOT NULL)
    SELECT i.seq, d.id AS finished_id, d.state AS finished_state FROM incoming i JOIN done d USING (kind, unique_key) WHERE rn = 1""", "jobs",
)
def unique_finished_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = tables(spark, sf_dir, "jobs")
    incoming = jobs.where("unique_key IS NOT NULL").select(F.col("id").alias("seq"), "kind", "unique_key")
    return uniqueness.finished_duplicates(incoming, listing.history(jobs), ("completed", "discarded"))


@register(
    f"""WITH {INCOMING}, f AS (SELECT *, row_number() OVER (PARTITION BY kind, unique_key ORDER BY seq) AS n FROM incoming)
    SELECT seq, kind, unique_key FROM f WHERE n = 1 AND NOT EXISTS (
      SELECT 1 FROM jobs j WHERE j.state NOT IN {DONE} AND j.kind = f.kind AND j.unique_key = f.unique_key)""", "jobs",
)
def insert_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = tables(spark, sf_dir, "jobs")
    incoming = jobs.where("unique_key IS NOT NULL").select(F.col("id").alias("seq"), "kind", "unique_key")
    return uniqueness.insert_many(incoming, listing.live(jobs))


FOLDED = """p AS (SELECT batch_id AS id, sum(done) AS d, sum(failed) AS f FROM batch_progress GROUP BY batch_id),
  folded AS (SELECT b.id, CAST(greatest(pending - coalesce(d, 0), 0) AS BIGINT) AS pending, CAST(failed + coalesce(f, 0) AS BIGINT) AS failed, total,
    CAST(coalesce(d, 0) AS BIGINT) AS done, greatest(pending - coalesce(d, 0), 0) <= 0 AS complete, on_success, on_failure, on_complete
    FROM batches b LEFT JOIN p ON p.id = b.id)"""


@register(f"WITH {FOLDED} SELECT id, pending, failed, total, done, complete FROM folded", "batches", "batch_progress")
def batch_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    folded = workflow.fold_progress(tables(spark, sf_dir, "batches"), tables(spark, sf_dir, "batch_progress"))
    return folded.select("id", "pending", "failed", "total", "done", "complete")


@register(
    f"""WITH {FOLDED} SELECT * FROM (
      SELECT id AS batch_id, failed AS batch_failed, CASE WHEN failed = 0 THEN 'success' ELSE 'failure' END AS callback,
        CASE WHEN failed = 0 THEN on_success ELSE on_failure END AS kind FROM folded WHERE complete
      UNION ALL SELECT id, failed, 'complete', on_complete FROM folded WHERE complete) x WHERE kind IS NOT NULL""", "batches", "batch_progress",
)
def batch_callbacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workflow.callbacks(workflow.fold_progress(tables(spark, sf_dir, "batches"), tables(spark, sf_dir, "batch_progress")))


GROUPS = """g AS (SELECT e.job_id, any_of, bool_or(on_failure = 'any_cancel') AS cancels,
    bool_or(s.state IS NULL OR s.state = 'completed') AS satisfied, bool_or(coalesce(s.state = 'available', false)) AS live
  FROM edges e LEFT JOIN steps s ON s.job_id = e.depends_on WHERE any_of IS NOT NULL GROUP BY e.job_id, any_of)"""


@register(f"WITH {GROUPS} SELECT * FROM g", "edges", "steps")
def anyof_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workflow.any_of_groups(tables(spark, sf_dir, "edges"), tables(spark, sf_dir, "steps"))


@register(f"WITH {GROUPS} SELECT DISTINCT job_id FROM g WHERE NOT satisfied AND NOT live AND cancels", "edges", "steps")
def anyof_exhausted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workflow.exhausted(tables(spark, sf_dir, "edges"), tables(spark, sf_dir, "steps"))


@register(
    f"""WITH {GROUPS} SELECT batch_id, job_id FROM steps t WHERE state = 'available'
      AND NOT EXISTS (SELECT 1 FROM edges e JOIN steps s ON s.job_id = e.depends_on WHERE e.job_id = t.job_id AND e.any_of IS NULL AND s.state = 'available')
      AND NOT EXISTS (SELECT 1 FROM g WHERE g.job_id = t.job_id AND NOT satisfied AND (live OR cancels))""", "edges", "steps",
)
def deps_ready(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workflow.ready_steps(tables(spark, sf_dir, "edges"), tables(spark, sf_dir, "steps"))


@register(
    """WITH RECURSIVE c AS (
      SELECT e.job_id FROM edges e JOIN steps s ON s.job_id = e.depends_on WHERE s.state = 'discarded' AND any_of IS NULL AND on_failure = 'cancel'
      UNION SELECT e.job_id FROM edges e JOIN c ON c.job_id = e.depends_on WHERE any_of IS NULL AND on_failure = 'cancel')
    SELECT job_id FROM c WHERE job_id NOT IN (SELECT job_id FROM steps WHERE state = 'discarded')""", "edges", "steps",
)
def cascade_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    _checkpoints(spark)
    return workflow.cascade(tables(spark, sf_dir, "edges"), tables(spark, sf_dir, "steps").where("state = 'discarded'"))


@register(
    """WITH RECURSIVE l AS (
      SELECT job_id, 0 AS level FROM steps UNION
      SELECT e.job_id, level + 1 FROM edges e JOIN l ON l.job_id = e.depends_on)
    SELECT job_id, max(level) AS level FROM l GROUP BY job_id""", "edges", "steps",
)
def dag_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    _checkpoints(spark)
    return workflow.levels(tables(spark, sf_dir, "edges"), tables(spark, sf_dir, "steps"))


@register("SELECT e.job_id, depends_on, coalesce(s.state, 'gone') AS state FROM edges e LEFT JOIN steps s ON s.job_id = e.depends_on", "edges", "steps")
def dependencies_by_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = workflow.dependencies(tables(spark, sf_dir, "edges"), tables(spark, sf_dir, "steps"))
    return found.select("job_id", F.inline("dependencies"))


@register(
    """SELECT 'batch' AS part, id, CAST(NULL AS BIGINT) AS other FROM batches WHERE id = 100
    UNION ALL SELECT 'step', job_id, NULL FROM steps WHERE batch_id = 100 UNION ALL SELECT 'edge', job_id, depends_on FROM edges WHERE batch_id = 100""",
    "batches", "steps", "edges",
)
def workflow_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workflow.get_workflow(*(tables(spark, sf_dir, t) for t in ("batches", "steps", "edges")), 100)


DUCK_PATTERN = r"""'^' || replace(replace(replace(replace(replace(replace(pattern, '.', '\.'), '*', '[^.]+'),
  '\.#\.', '(\..*)?\.'), '\.#', '(\..*)?'), '#\.', '(.*\.)?'), '#', '.*') || '$'"""


@register(
    f"""SELECT xid, seq, topic, name AS subscription, s.kind, queue, CASE WHEN ordered THEN 10 ELSE 25 END AS max_attempts,
      CASE WHEN ordered THEN key END AS ordering_key
    FROM stream JOIN subscriptions s ON regexp_matches(topic, {DUCK_PATTERN})""", "stream", "subscriptions",
)
def publish_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messaging.fan_out(tables(spark, sf_dir, "stream"), SUBSCRIPTIONS)


@register(
    r"SELECT xid, seq, topic FROM stream WHERE regexp_matches(topic, '^ev\.click(\..*)?$') AND (xid > 99 OR (xid = 99 AND seq > 995)) ORDER BY xid, seq LIMIT 500",
    "stream",
)
def stream_read_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messaging.read_log(tables(spark, sf_dir, "stream"), "ev.click.#", (99, 995), 500).select("xid", "seq", "topic")


SEEN, READING = (100, 140, (105, 120)), (130, 400, (133, 399))


@register(
    """SELECT xid, seq, topic FROM stream WHERE (xid < 130 OR (xid < 400 AND xid NOT IN (133, 399)))
      AND NOT (xid < 100 OR (xid < 140 AND xid NOT IN (105, 120))) ORDER BY xid, seq LIMIT 1500""", "stream",
)
def stream_pump_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    now, seen = messaging.snapshot(*READING), messaging.snapshot(*SEEN)
    return messaging.pump(tables(spark, sf_dir, "stream"), "#", seen, now, None, 1500).select("xid", "seq", "topic")


@register("SELECT xid, seq FROM stream WHERE created_at < TIMESTAMP '2024-01-20 00:00:00' ORDER BY xid DESC, seq DESC LIMIT 1", "stream")
def stream_seek_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messaging.seek(tables(spark, sf_dir, "stream"), since="2024-01-20 00:00:00")


OUTCOME = """CASE WHEN result = 'ok' THEN 'completed' WHEN result = 'snooze' THEN 'scheduled'
  WHEN result <> 'cancel' AND canceled THEN 'canceled'
  WHEN result <> 'cancel' AND NOT too_large AND fenced AND attempt < 3 THEN 'retryable'
  WHEN stopped AND result <> 'cancel' AND NOT too_large THEN 'retryable'
  WHEN result = 'cancel' OR too_large OR attempt >= 3 THEN 'discarded' ELSE 'retryable' END"""


@register(f"SELECT id, {OUTCOME} AS outcome FROM attempts", "attempts")
def outcome_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables(spark, sf_dir, "attempts").withColumn("max_attempts", F.lit(3)).select("id", transitions.outcome().alias("outcome"))


@register(
    f"""SELECT outcome, CAST(CASE WHEN ms < 0 THEN 0 WHEN ms >= 100 THEN 11 ELSE floor(ms / 10) + 1 END AS BIGINT) AS bin, count(*) AS n
    FROM (SELECT *, {OUTCOME} AS outcome FROM attempts) x GROUP BY ALL""", "attempts",
)
def attempts_by_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables(spark, sf_dir, "attempts").withColumn("max_attempts", F.lit(3)).withColumn("outcome", transitions.outcome())
    return stats.attempts_by_outcome(rows, 0.0, 100.0, 10)


@register(
    """SELECT id, least(pow(attempt, 4) + 5, 86400.0) AS delay, CASE WHEN ordering_key IS NULL THEN least(pow(attempt, 4) + 5, 86400.0)
      ELSE least(pow(attempt, 4) + 5, 300.0) END AS ordered_delay FROM (SELECT *, id % 30 AS attempt FROM (SELECT id, ordering_key FROM jobs)) x""", "jobs",
)
def retry_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = tables(spark, sf_dir, "jobs").withColumn("attempt", F.col("id") % 30)
    return jobs.select("id", transitions.retry_delay().alias("delay"), transitions.retry_delay(F.col("ordering_key").isNotNull()).alias("ordered_delay"))


RESULTS = """results AS (SELECT id, attempted_by, fence - CASE WHEN id % 10 = 0 THEN 1 ELSE 0 END AS fence,
  CASE id % 5 WHEN 0 THEN 'completed' WHEN 1 THEN 'discarded' WHEN 2 THEN 'scheduled' ELSE 'retryable' END AS to_state,
  CAST(id % 60 AS DOUBLE) AS delay_seconds, id % 7 = 0 AS give_back FROM jobs WHERE state = 'running' AND attempted_by IS NOT NULL)"""


def _results(jobs: DataFrame) -> DataFrame:
    n = F.col("id") % 5
    return jobs.where("state = 'running' AND attempted_by IS NOT NULL").select(
        "id", "attempted_by", (F.col("fence") - F.when(F.col("id") % 10 == 0, 1).otherwise(0)).alias("fence"),
        F.when(n == 0, "completed").when(n == 1, "discarded").when(n == 2, "scheduled").otherwise("retryable").alias("to_state"),
        (F.col("id") % 60).cast("double").alias("delay_seconds"), (F.col("id") % 7 == 0).alias("give_back"),
    )


@register(
    f"""WITH {RESULTS} SELECT j.id, coalesce(CASE WHEN j.state = 'running' THEN to_state END, state) AS state,
      CAST(attempt - CASE WHEN j.state = 'running' AND (to_state = 'scheduled' OR (to_state = 'retryable' AND give_back)) THEN 1 ELSE 0 END AS INT) AS attempt,
      CASE WHEN j.state = 'running' AND to_state IN ('scheduled', 'retryable') THEN {NOW} + CAST(delay_seconds AS INT) * INTERVAL 1 SECOND ELSE scheduled_at END AS scheduled_at,
      CASE WHEN j.state = 'running' AND to_state IN ('completed', 'discarded') THEN {NOW} ELSE finalized_at END AS finalized_at
    FROM jobs j LEFT JOIN results r ON r.id = j.id AND r.attempted_by = j.attempted_by AND r.fence = j.fence""", "jobs",
)
def finalize_transition(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = tables(spark, sf_dir, "jobs")
    live, done = transitions.finalize(jobs, _results(jobs), AS_OF)
    return live.unionByName(done).select("id", "state", "attempt", "scheduled_at", "finalized_at")


@register(
    f"""SELECT id, CASE WHEN state = 'running' THEN 'request' WHEN state IN {DONE} THEN 'unchanged' ELSE 'cancel' END AS action,
      CASE WHEN state = 'running' OR state IN {DONE} THEN state ELSE 'canceled' END AS to_state FROM jobs WHERE batch_id < 100""", "jobs",
)
def cancel_transition(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = tables(spark, sf_dir, "jobs")
    return transitions.cancel(jobs, jobs.where("batch_id < 100"), AS_OF)


@register("SELECT id FROM jobs WHERE NOT (batch_id < 500 AND state <> 'running')", "jobs")
def delete_transition(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = tables(spark, sf_dir, "jobs")
    return transitions.delete(jobs, jobs.where("batch_id < 500"))[0].select("id")


@register(
    f"""WITH asked AS (SELECT * FROM jobs WHERE batch_id < 200 AND state <> 'running'),
      back AS (SELECT *, row_number() OVER (ORDER BY id) AS n FROM asked j WHERE state IN {DONE} AND (unique_key IS NULL OR (
        NOT EXISTS (SELECT 1 FROM jobs l WHERE l.state NOT IN {DONE} AND l.kind = j.kind AND l.unique_key = j.unique_key)
        AND NOT EXISTS (SELECT 1 FROM asked l WHERE l.state IN {DONE} AND l.kind = j.kind AND l.unique_key = j.unique_key AND l.id < j.id))))
    SELECT id, CASE WHEN attempt >= max_attempts THEN attempt + 1 ELSE max_attempts END AS max_attempts, {NOW} AS scheduled_at,
      (SELECT max(seq) FROM jobs) + n AS seq FROM back
    UNION ALL SELECT id, max_attempts, least(scheduled_at, {NOW}) AS scheduled_at, seq FROM asked WHERE state NOT IN {DONE}""", "jobs",
)
def retry_transition(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = tables(spark, sf_dir, "jobs")
    return transitions.retry(jobs, jobs.where("batch_id < 200"), AS_OF).select("id", "max_attempts", "scheduled_at", "seq")


@register(
    f"""SELECT outcome, day, count(*) AS n
    FROM (SELECT CASE WHEN state = 'completed' THEN 'completed' ELSE 'failed' END AS outcome, CAST(finalized_at AS DATE) AS day FROM jobs WHERE state IN {DONE}) x
    WHERE day + INTERVAL 1 DAY < {NOW} - CASE WHEN outcome = 'completed' THEN 30 ELSE 200 END * INTERVAL 1 DAY GROUP BY outcome, day""", "jobs",
)
def retention_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upkeep.partitions_to_drop(listing.history(tables(spark, sf_dir, "jobs")), {"completed": 30, "failed": 200}, AS_OF)


@register(
    f"""WITH r AS (SELECT l.*, row_number() OVER (PARTITION BY job_id ORDER BY l.fence DESC) AS rk, j.id, j.state, j.fence AS jf, j.finalized_at AS fin
      FROM log_runs l LEFT JOIN jobs j ON j.id = l.job_id)
    SELECT job_id, fence FROM r WHERE updated_at <= {NOW} - INTERVAL 7 DAYS AND CASE WHEN state IS NULL THEN true
      WHEN jf = 0 OR fence > jf OR (state = 'running' AND fence = jf) THEN false
      ELSE rk > 3 OR coalesce(CASE WHEN state = 'completed' THEN fin + INTERVAL 30 DAYS <= {NOW}
        WHEN state IN ('canceled', 'discarded') THEN fin + INTERVAL 90 DAYS <= {NOW} END, false) END""", "log_runs", "jobs",
)
def log_retention_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs, jobs = tables(spark, sf_dir, "log_runs"), tables(spark, sf_dir, "jobs")
    return upkeep.expired_log_runs(runs, jobs, 7, 3, {"completed": 30, "failed": 90}, AS_OF)


@register(
    """WITH a AS (SELECT scenario, list(ms ORDER BY ms) AS v FROM attempts GROUP BY scenario)
    SELECT scenario, CAST(len(v) AS BIGINT) AS n, v[len(v) // 2 + 1] AS p50, v[len(v) * 99 // 100 + 1] AS p99, v[len(v)] AS max_value FROM a""", "attempts",
)
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.nearest_index(tables(spark, sf_dir, "attempts"), "scenario", "ms")


BENCH = "bench AS (SELECT scenario, CASE WHEN id % 2 = 0 THEN 'base' ELSE 'head' END AS side, id AS run, CAST(round(ms * 100) AS BIGINT) AS rate FROM attempts)"


@register(
    f"""WITH {BENCH}, h AS (SELECT *, row_number() OVER (PARTITION BY side, scenario ORDER BY rate DESC, run) AS i,
        count(*) OVER (PARTITION BY side, scenario) AS n FROM bench),
      m AS (SELECT side, scenario, avg(rate) AS rate FROM h WHERE i <= ceil(n / 2) GROUP BY side, scenario)
    SELECT b.scenario, b.rate AS base_rate, h.rate AS head_rate, h.rate / b.rate - 1 AS change, h.rate / b.rate - 1 < -0.1 AS regressed
    FROM m b JOIN m h ON h.scenario = b.scenario AND b.side = 'base' AND h.side = 'head'""", "attempts",
)
def bench_compare_faster_half(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables(spark, sf_dir, "attempts").select(
        "scenario", F.when(F.col("id") % 2 == 0, "base").otherwise("head").alias("side"), F.col("id").alias("run"),
        F.round(F.col("ms") * 100).cast("long").alias("rate"),
    )
    return stats.compare_runs(rows)


REGISTERED = "registrations AS (SELECT id AS client_id, 'p' || CAST(id % 9 AS VARCHAR) AS name, 'every ' || CAST(id % 4 AS VARCHAR) AS definition FROM clients)"


@register(
    f"""WITH {REGISTERED} SELECT name, client_id, definition FROM (SELECT r.*, row_number() OVER (PARTITION BY name ORDER BY started_at DESC, client_id DESC) AS n
      FROM registrations r JOIN clients c ON c.id = client_id WHERE expires_at > {NOW}) x WHERE n = 1""", "clients",
)
def periodic_effective(spark: SparkSession, sf_dir: str) -> DataFrame:
    clients = tables(spark, sf_dir, "clients")
    registered = clients.select(
        F.col("id").alias("client_id"), F.concat(F.lit("p"), (F.col("id") % 9).cast("string")).alias("name"),
        F.concat(F.lit("every "), (F.col("id") % 4).cast("string")).alias("definition"),
    )
    return upkeep.effective_definitions(registered, clients, AS_OF)


@register(
    """SELECT name, CASE WHEN name = 'q9' THEN 5 WHEN name = 'q0' THEN 9 ELSE global_limit END AS global_limit,
      CAST(CASE WHEN name = 'q0' THEN 2.5 WHEN name = 'q9' THEN 1.0 ELSE rate_per_sec END AS DOUBLE) AS rate_per_sec,
      CASE WHEN name IN ('q0', 'q9') THEN NULL ELSE rate_burst END AS rate_burst, CASE WHEN name = 'q9' THEN NULL ELSE tokens END AS tokens, paused
    FROM (SELECT name, global_limit, rate_per_sec, rate_burst, tokens, paused FROM queues UNION ALL SELECT 'q9', NULL, NULL, NULL, NULL, false) x""", "queues",
)
def queue_limits_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    queues = tables(spark, sf_dir, "queues").withColumn("rate_per_sec", F.col("rate_per_sec").cast("double"))
    changes = spark.createDataFrame([("q0", 9, 2.5, None), ("q9", 5, 1.0, None)], "name string, global_limit int, rate_per_sec double, rate_burst int")
    return upkeep.upsert_queues(queues, changes)


@register(
    f"""SELECT (SELECT count(*) FROM clients WHERE expires_at > {NOW}) AS live_clients,
      (SELECT count(*) FROM jobs WHERE state = 'running' AND attempted_by IS NULL) AS leased, (SELECT count(*) FROM jobs) AS jobs""", "clients", "jobs",
)
def ledger_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = tables(spark, sf_dir, "jobs").agg(
        F.count_if((F.col("state") == "running") & F.col("attempted_by").isNull()).alias("leased"), F.count(F.lit(1)).alias("jobs")
    )
    live = tables(spark, sf_dir, "clients").agg(F.count_if(F.col("expires_at") > claim.at(AS_OF)).alias("live_clients"), F.lit(1).alias("one"))
    return live.join(jobs.withColumn("one", F.lit(1)), "one").drop("one")


@register("SELECT id, attempt % 3 AS step, id * 2 AS cursor FROM jobs WHERE state = 'running' AND attempted_by IS NOT NULL AND id % 4 > 0", "jobs")
def progress_recorded(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = tables(spark, sf_dir, "jobs")
    stale = F.when(F.col("id") % 4 == 0, 1).otherwise(0)  # reports of a fence that has passed
    reports = jobs.select("id", "attempted_by", (F.col("fence") - stale).alias("fence"), "attempt", (F.col("attempt") % 3).alias("step"), (F.col("id") * 2).alias("cursor"))
    return transitions.record_progress(jobs, reports)


@register(
    f"""WITH {INCOMING}, done AS (SELECT *, row_number() OVER (PARTITION BY kind, unique_key ORDER BY finalized_at DESC, id DESC) AS rn
      FROM jobs WHERE state IN {DONE} AND unique_key IS NOT NULL)
    SELECT i.seq % 50 AS batch_id, count(*) AS done, count(*) FILTER (d.state <> 'completed') AS failed
    FROM incoming i JOIN done d USING (kind, unique_key) WHERE rn = 1 GROUP BY i.seq % 50""", "jobs",
)
def batch_finished_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = tables(spark, sf_dir, "jobs")
    incoming = jobs.where("unique_key IS NOT NULL").select(F.col("id").alias("seq"), "kind", "unique_key", (F.col("id") % 50).alias("batch_id"))
    found = uniqueness.finished_duplicates(incoming, listing.history(jobs), ("completed", "canceled", "discarded"))
    return compose.finished_duplicates_of_batch(found, incoming)


@register("SELECT name, pattern, kind, queue, ordered FROM subscriptions WHERE name NOT IN ('all', 'exact') UNION ALL SELECT 'all', 'ev.#', 'audit', 'q3', true", "subscriptions")
def subscription_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = subscriptions(spark).where("name <> 'exact'")
    return compose.upsert(known, spark.createDataFrame([("all", "ev.#", "audit", "q3", True)], known.schema), "name")


@register("SELECT id FROM jobs WHERE state = 'discarded' AND id % 3 = 1 ORDER BY id LIMIT 40", "jobs")
def replay_discarded(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = tables(spark, sf_dir, "jobs")
    deliveries = jobs.select("id", F.concat(F.lit("s"), (F.col("id") % 3).cast("string")).alias("subscription"))
    return compose.replay(listing.history(jobs), deliveries, "s1", 40).select("id")


@register(
    """SELECT id, list_sort(list_filter(n, lambda x: NOT list_contains(o, x))) AS added, list_sort(list_filter(o, lambda x: NOT list_contains(n, x))) AS removed
    FROM (SELECT id, coalesce(tags, []) AS o, ['t1', 'b' || CAST(id % 7 AS VARCHAR)] AS n FROM jobs) x""", "jobs",
)
def tag_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = tables(spark, sf_dir, "jobs").withColumn("new", F.array(F.lit("t1"), F.concat(F.lit("b"), (F.col("id") % 7).cast("string"))))
    change = jobs.select("id", compose.tag_changes(F.col("tags"), F.col("new")).alias("c"))
    return change.select("id", F.array_sort("c.added").alias("added"), F.array_sort("c.removed").alias("removed"))


@register("SELECT id, CASE kind WHEN 'k1' THEN 'mail' WHEN 'k3' THEN 'export' ELSE kind END AS kind FROM jobs", "jobs")
def kind_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compose.apply_kind_aliases(tables(spark, sf_dir, "jobs"), {"k1": "mail", "k3": "export"}).select("id", "kind")


@register()
def cron_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    specs = [("quarter", "*/15 * * * *"), ("weekdays", "0 9 * * MON-FRI"), ("chicago", "CRON_TZ=America/Chicago 30 1 * * *"), ("days", "0 12 13 * FRI")]
    return upkeep.cron_slots(spark, specs, "2026-10-30 00:00:00", "2026-11-14 00:00:00")


@register()
def stream_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fan-out as a stream over the events file, run until it has caught up."""
    import uuid

    from ..sources.ledger import RULES, _braces
    from ..streaming.fanout import start_fan_out

    root = f"{_checkpoints(spark)}/stream-{uuid.uuid4().hex}"
    log = spark.readStream.schema(spark.read.parquet(f"{sf_dir}/events.parquet").schema).parquet(_pattern(sf_dir))
    rule = RULES["stream"].format(S="STRING", A="array(", Z=")", events="{source}")
    start_fan_out(spark.sql(_braces(rule), source=log), SUBSCRIPTIONS, f"{root}/out", f"{root}/log").awaitTermination()
    return spark.read.parquet(f"{root}/out")


ORACLE_SQL["stream_fanout"] = ORACLE_SQL["publish_fanout"]


def _pattern(sf_dir: str) -> str:
    """A file stream lists a directory: the table itself if it is one, else a pattern for its file."""
    return f"{sf_dir}/events.parque[t]"


def _checkpoints(spark: SparkSession) -> str:
    """The shared checkpoint folder; only a local session without one gets its own."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        import tempfile

        root = tempfile.mkdtemp(prefix="tallyworks-ledger-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


from . import lifecycle  # noqa: E402, F401 - registers the rest
