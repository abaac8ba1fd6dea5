"""Ledger tables: derived from the sample schema by one rule text for every SQL engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: The clock of all sample queries.
AS_OF = "1998-06-01 00:00:00"
EVENTS_AS_OF = "2024-01-20 00:00:00"

WAITING = ("available", "scheduled", "retryable")
FINISHED = ("completed", "canceled", "discarded")

#: Rules of the derived tables. {S} is the string type, {A}/{Z} open and close an array.
RULES = {
    "jobs": """
        SELECT o_orderkey AS id, o_orderkey AS seq, 'k' || CAST(o_custkey % 5 AS {S}) AS kind,
          'q' || CAST(o_custkey % 3 AS {S}) AS queue,
          CASE WHEN o_orderstatus = 'P' THEN 'running'
               WHEN o_orderstatus = 'O' THEN CASE o_orderkey % 4 WHEN 0 THEN 'scheduled' WHEN 1 THEN 'retryable' ELSE 'available' END
               WHEN o_orderkey % 7 > 0 THEN 'completed' WHEN o_orderkey % 14 = 0 THEN 'canceled' ELSE 'discarded' END AS state,
          least(CAST(substr(o_orderpriority, 1, 1) AS INT), 4) AS priority,
          CAST(o_orderkey % 4 AS INT) AS attempt, 3 AS max_attempts, CAST(o_orderkey % 4 + 1 AS BIGINT) AS fence,
          o_orderdate AS scheduled_at, o_orderdate AS attempted_at,
          CASE WHEN o_orderstatus = 'P' AND o_orderkey % 6 > 0 THEN o_custkey % 120 END AS attempted_by,
          CASE WHEN o_orderkey % 9 = 0 THEN o_orderdate + INTERVAL 30 DAYS END AS expires_at,
          CASE WHEN o_orderkey % 5 = 0 THEN 'o' || CAST(o_custkey % 250 AS {S}) END AS ordering_key,
          CASE WHEN o_orderkey % 2 = 0 THEN 'p' || CAST(o_custkey % 50 AS {S}) END AS partition_key,
          CASE WHEN o_orderkey % 3 = 0 THEN 'u' || CAST(o_custkey % 700 AS {S}) END AS unique_key,
          CAST(o_orderkey % 1000 AS BIGINT) AS batch_id,
          CASE WHEN o_orderstatus = 'F' THEN o_orderdate + INTERVAL 6 HOURS END AS finalized_at,
          CASE WHEN o_orderkey % 11 > 0 THEN {A}'t' || CAST(o_custkey % 4 AS {S}), 'b' || CAST(o_orderkey % 10 AS {S}){Z} END AS tags,
          '{{"tenant": ' || CAST(o_custkey % 7 AS {S}) || ', "tier": {{"level": ' || CAST(o_orderkey % 3 AS {S}) || '}}}}' AS metadata
        FROM {orders}""",
    "clients": """
        SELECT s_suppkey AS id, s_name AS hostname,
          TIMESTAMP '1998-01-01 00:00:00' + CAST(s_suppkey % 150 AS INT) * INTERVAL 1 DAY AS started_at,
          CASE WHEN s_acctbal < 0 THEN TIMESTAMP '1998-05-01 00:00:00' ELSE TIMESTAMP '1998-06-02 00:00:00' END AS expires_at
        FROM {supplier}""",
    "leases": """
        SELECT o_orderkey AS id, CAST(1 + o_orderkey % 5 AS INT) AS ttl_days,
          o_orderdate AS renewed_at, o_orderdate + CAST(1 + o_orderkey % 5 AS INT) * INTERVAL 1 DAY AS expires_at
        FROM {orders} WHERE o_orderstatus = 'P' AND o_orderkey % 6 = 0""",
    "queues": """
        SELECT 'q' || CAST(r_regionkey AS {S}) AS name,
          CASE WHEN r_regionkey % 2 = 0 THEN 1700 + 10 * r_regionkey END AS global_limit,
          CASE WHEN r_regionkey <> 1 THEN 2.5 + r_regionkey END AS rate_per_sec,
          CASE WHEN r_regionkey = 2 THEN 40 END AS rate_burst, CAST(3.25 * r_regionkey AS DOUBLE) AS tokens,
          TIMESTAMP '1998-05-31 23:59:50' + CAST(r_regionkey AS INT) * INTERVAL 1 SECOND AS refilled_at,
          r_regionkey = 4 AS paused
        FROM {region}""",
    "edges": """
        SELECT DISTINCT l_orderkey AS batch_id, l_orderkey * 10 + l_linenumber AS job_id, l_orderkey * 10 + l_linenumber - 1 AS depends_on,
          CASE l_linenumber % 4 WHEN 0 THEN 'ignore' WHEN 1 THEN 'any_cancel' WHEN 2 THEN 'cancel' ELSE 'cancel' END AS on_failure,
          CASE WHEN l_linenumber % 4 = 1 THEN CAST(l_linenumber AS INT) END AS any_of
        FROM {lineitem} WHERE l_linenumber > 1""",
    "steps": """
        SELECT batch_id, job_id, CASE WHEN failed > 0 THEN 'discarded' WHEN open > 0 THEN 'available' ELSE 'completed' END AS state
        FROM (SELECT l_orderkey AS batch_id, l_orderkey * 10 + l_linenumber AS job_id,
                max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS failed, max(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) AS open
              FROM {lineitem} GROUP BY l_orderkey, l_linenumber) x""",
    "batch_progress": """
        SELECT l_orderkey AS batch_id, CAST(1 AS BIGINT) AS done, CAST(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS BIGINT) AS failed
        FROM {lineitem}""",
    "batches": """
        SELECT o_orderkey AS id, CAST(3 + o_orderkey % 4 AS BIGINT) AS pending, CAST(0 AS BIGINT) AS failed, CAST(7 AS BIGINT) AS total,
          CASE WHEN o_orderkey % 2 = 0 THEN 'notify' END AS on_success, CASE WHEN o_orderkey % 3 = 0 THEN 'alert' END AS on_failure,
          CASE WHEN o_orderkey % 5 = 0 THEN 'sweep' END AS on_complete
        FROM {orders}""",
    "stream": """
        SELECT CAST(floor(event_id / 10) AS BIGINT) AS xid, event_id AS seq,
          'ev.' || event_type || '.u' || CAST(user_id % 10 AS {S}) AS topic,
          CASE WHEN event_id % 3 > 0 THEN 'key' || CAST(user_id AS {S}) END AS key, props AS payload, ts AS created_at
        FROM {events}""",
    "attempts": """
        SELECT event_id AS id, event_type AS scenario, value AS ms, ts AS at, CAST(event_id % 4 AS INT) AS attempt,
          CASE WHEN event_type = 'error' THEN 'error' WHEN event_id % 13 = 0 THEN 'cancel' WHEN event_id % 17 = 0 THEN 'snooze' ELSE 'ok' END AS result,
          event_id % 19 = 0 AS canceled, event_id % 23 = 0 AS fenced, event_id % 29 = 0 AS stopped, event_id % 31 = 0 AS too_large
        FROM {events}""",
    "log_runs": """
        SELECT conv_id AS job_id, CAST(turn + 1 AS BIGINT) AS fence, CAST(length(text) AS BIGINT) AS size,
          TIMESTAMP '1998-05-01 00:00:00' + CAST((conv_id + turn) % 45 AS INT) * INTERVAL 1 DAY AS updated_at
        FROM {conversations}""",
    "candidates": """
        SELECT doc_id AS seq, source AS kind, lang AS finished_states, text AS unique_key FROM {documents}""",
}

#: Subscriptions of the samples (fixed values): name, pattern, kind, queue, ordered, metadata.
SUBSCRIPTIONS = [
    ("all", "#", "audit", "q0", False),
    ("clicks", "ev.click.*", "click", "q1", False),
    ("errors", "ev.error.#", "alert", "q2", True),
    ("exact", "ev.view.u3", "view", "q1", False),
    ("none", "orders.*", "never", "q0", False),
    ("user-one", "ev.*.u1", "one", "q2", True),
    ("user-three", "#.u3", "three", "q0", False),
]


def tables(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table. Only the columns that a query uses are read."""
    rule = RULES[name]
    source = next(t for t in ("orders", "supplier", "region", "lineitem", "events", "conversations", "documents") if "{" + t + "}" in rule)
    text = rule.format(S="STRING", A="array(", Z=")", **{source: "{source}"})
    text = text.replace('"tenant"', '"tenant"')
    return spark.sql(_braces(text), source=spark.read.parquet(f"{sf_dir}/{source}.parquet"))


def _braces(text: str) -> str:
    """Braces inside literals doubled again, for the formatter of ``spark.sql``."""
    return text.replace("{", "{{").replace("}", "}}").replace("{{source}}", "{source}")


def subscriptions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SUBSCRIPTIONS, "name string, pattern string, kind string, queue string, ordered boolean")


def duck_rule(name: str) -> str:
    """The rule as a DuckDB query."""
    bare = {t: t for t in ("orders", "supplier", "region", "lineitem", "events", "conversations", "documents")}
    return RULES[name].format(S="VARCHAR", A="[", Z="]", **bare)


def duck_subscriptions() -> str:
    rows = ", ".join(f"('{n}', '{p}', '{k}', '{q}', {str(o).lower()})" for n, p, k, q, o in SUBSCRIPTIONS)
    return f"SELECT * FROM (VALUES {rows}) s(name, pattern, kind, queue, ordered)"
