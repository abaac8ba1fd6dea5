"""Transitions, graphs and log positions on hand-made tables."""

import pytest
from pyspark.sql import functions as F

from tallyworks.operators import claim, compose, listing, messaging, stats, transitions, upkeep, workflow
from tallyworks.sources.ledger import AS_OF, SUBSCRIPTIONS, tables
from tallyworks.sources.snapshots import Snapshots

SF = "/root/testdata/sf0.001"
JOB = (
    "id long, seq long, kind string, queue string, state string, priority int, attempt int, max_attempts int, fence long, scheduled_at timestamp_ntz, "
    "attempted_at timestamp_ntz, attempted_by long, expires_at timestamp_ntz, ordering_key string, partition_key string, unique_key string, finalized_at timestamp_ntz"
)
FIELDS = [f.split()[0] for f in JOB.split(", ")]
NOW = "2026-01-01 12:00:00"


def jobs(spark, *rows):
    base = {"kind": "k", "queue": "q", "state": "available", "priority": 2, "attempt": 0, "max_attempts": 3, "fence": 0, "scheduled_at": "2026-01-01 10:00:00"}
    full = [base | {"seq": r["id"]} | r for r in rows]
    df = spark.createDataFrame([tuple(r.get(f) for f in FIELDS) for r in full], ", ".join(f.replace("timestamp_ntz", "string") for f in JOB.split(", ")))
    return df.select(*[F.col(f.split()[0]).cast(f.split()[1]) for f in JOB.split(", ")])


def ids(df, column="id"):
    return sorted(r[column] for r in df.collect())


def test_partition_limit(spark):
    rows = [{"id": i, "partition_key": k} for i, k in enumerate("aaaabbb")] + [{"id": 8}, {"id": 9}]
    table = jobs(spark, *rows)
    ready = claim.eligible(table, NOW)
    assert ids(claim.within_partitions(table, ready, 2)) == [0, 1, 4, 5, 8, 9]
    after = claim.claim(table, 10, 5, NOW, partition_limit=2)
    assert ids(after.where("state = 'running'")) == [0, 1, 4, 5, 8, 9]
    assert claim.within_partitions(after, claim.eligible(after, NOW), 2).count() == 0


def test_lanes(spark):
    rows = [{"id": i, "ordering_key": k} for i, k in enumerate("aaabb")] + [{"id": 9}]
    table = jobs(spark, *rows)
    assert ids(claim.eligible(table, NOW)) == [0, 3, 9]
    blocked = table.withColumn("scheduled_at", F.when(F.col("id") == 0, F.lit("2027-01-01 00:00:00").cast("timestamp_ntz")).otherwise(F.col("scheduled_at")))
    assert ids(claim.eligible(blocked, NOW)) == [3, 9]  # a later head still blocks its lane
    running = table.withColumn("state", F.when(F.col("id") == 3, "running").otherwise(F.col("state")))
    assert ids(claim.eligible(running, NOW)) == [0, 9]


def test_stale_fence_changes_nothing(spark):
    table = jobs(spark, {"id": 1, "state": "running", "attempted_by": 7, "fence": 4, "attempt": 1}, {"id": 2, "state": "running", "attempted_by": 7, "fence": 4, "attempt": 1})
    results = spark.createDataFrame([(1, 7, 3, "completed", 0.0, False), (2, 7, 4, "retryable", 30.0, True)], "id long, attempted_by long, fence long, to_state string, delay_seconds double, give_back boolean")
    live, done = transitions.finalize(table, results, NOW)
    got = {r.id: (r.state, r.attempt, str(r.scheduled_at)) for r in live.collect()}
    assert done.count() == 0 and got[1][0] == "running" and got[2] == ("retryable", 0, "2026-01-01 12:00:30")


def test_invariants_hold_after_claims(spark):
    table = tables(spark, SF, "jobs").withColumn("unique_key", F.lit(None).cast("string"))
    table = table.withColumn("ordering_key", F.when(F.col("state") != "running", F.col("ordering_key")))
    after = claim.claim(table, 1000, 3, AS_OF)
    assert transitions.violations(listing.live(after), listing.history(after)).count() == 0


def test_graph_settles(spark):
    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    tasks = [
        {"name": "a"}, {"name": "b", "depends_on": ["a"]}, {"name": "c", "depends_on": ["b"]}, {"name": "d", "depends_on": ["a"], "on_failure": "ignore"},
        {"name": "x"}, {"name": "y"}, {"name": "g", "any_of": [["x", "y"]]}, {"name": "h", "any_of": [["b", "c"]]}, {"name": "i", "depends_on": ["h"]},
    ]
    steps, edges = compose.insert_workflow(spark, 1, tasks, 10)
    name = {10 + i: t["name"] for i, t in enumerate(tasks)}
    done = spark.createDataFrame([(10, "discarded"), (14, "completed")], "job_id long, to_state string")
    out = compose.finalize_steps(steps, edges, done)
    assert {name[r.job_id] for r in out.canceled.collect()} == {"b", "c", "h", "i"}
    assert {"d", "g"} <= {name[r.job_id] for r in out.promoted.collect()}
    assert out.counts.first().asDict() == {"batch_id": 1, "done": 6, "failed": 5}
    levels = {name[r.job_id]: r.level for r in workflow.levels(edges, steps).collect()}
    assert (levels["a"], levels["b"], levels["c"], levels["h"], levels["i"]) == (0, 1, 2, 3, 4)
    for bad in ([{"name": "a", "depends_on": ["b"]}, {"name": "b", "depends_on": ["a"]}], [{"name": "a"}, {"name": "a"}], [{"name": "a", "depends_on": ["z"]}]):
        with pytest.raises(ValueError):
            compose.insert_workflow(spark, 1, bad, 1)


def test_late_commits_come_once(spark):
    log = spark.createDataFrame([(x, x, "t", "2026-01-01") for x in (999, 1000, 1001, 1002)], "xid long, seq long, topic string, created_at string")
    first, second = messaging.snapshot(1000, 1003, (1000,)), messaging.snapshot(1003, 1003)
    start = messaging.snapshot(0, 0)
    assert [r.xid for r in messaging.pump(log, "#", start, first, None, 10).collect()] == [999, 1001, 1002]
    assert [r.xid for r in messaging.pump(log, "#", first, second, None, 10).collect()] == [1000]
    assert messaging.advance({"seen": 0}, [(1, 1)], 5, {"xmin": 9})["cursor"] is None
    assert messaging.advance({"seen": 0}, [(1, 1), (1, 2)], 2, {"xmin": 9})["cursor"] == (1, 2)


def test_fan_out_in_parts(spark):
    events = tables(spark, SF, "stream")
    many = SUBSCRIPTIONS * 40
    assert messaging.fan_out(events, many).count() == 40 * messaging.fan_out(events, SUBSCRIPTIONS).count()


def test_filters_are_checked():
    for bad in ({"ordering_key": "a"}, {"priorities": (5,)}, {"tags_any": ("",)}):
        with pytest.raises(ValueError):
            listing.JobFilter(**bad).check()


def test_logs(spark):
    df = spark.createDataFrame([(1, "hello world")], "id long, text string")
    assert bytes(listing.read_log(df, -1, 5).first().chunk) == b"world" and bytes(listing.read_log(df, 0, 5).first().chunk) == b"hello"
    logs = spark.createDataFrame([([(1, True, "a"), (0, False, "b")],)], "logs array<struct<attempt: int, snoozed: boolean, log: string>>")
    got = logs.select(compose.append_log(F.col("logs"), F.lit(1), F.lit("c"), F.lit(False), 5).alias("l")).first().l
    assert [x.log for x in got] == ["b", "c"]


def test_slots(spark):
    slots = upkeep.cron_slots(spark, [("h", "@hourly")], "2026-01-01 00:00:00", "2026-01-01 05:00:00")
    last = spark.sql("SELECT 'h' AS name, TIMESTAMP_NTZ '2026-01-01 03:00:00' AS last_slot")
    assert slots.count() == 5 and upkeep.missed_slots(slots, last).count() == 2 and upkeep.latest_slots(slots, 3).count() == 3


def test_snapshots(spark, tmp_path):
    store = Snapshots(spark, str(tmp_path / "ledger"))
    with pytest.raises(FileNotFoundError):
        store.read("jobs")
    for n in (3, 5):
        store.commit({"jobs": spark.range(n)})
    assert store.read("jobs").count() == 5 and store.read("jobs", 1).count() == 3
    assert store.prune(1) == [1] and store.versions() == [2]


def test_retry_keeps_unique_keys_unique(spark):
    """Of finished jobs of one key one returns, with a fresh seq; the others are conflicts."""
    table = jobs(
        spark, {"id": 1, "state": "completed", "unique_key": "u"}, {"id": 2, "state": "discarded", "unique_key": "u", "attempt": 3},
        {"id": 3, "state": "completed"}, {"id": 4, "state": "canceled", "unique_key": "w"}, {"id": 5, "unique_key": "w"}, {"id": 9, "state": "running"},
    )
    back = transitions.retry(table, table, NOW)
    assert {r.id: r.seq for r in back.collect()} == {1: 10, 3: 11, 5: 5} and ids(transitions.retry_conflicts(table, table)) == [2, 4]
    finished = listing.history(table).join(back.select("id"), "id", "left_anti")
    live = listing.live(table).join(back.select("id"), "id", "left_anti").unionByName(back)
    assert transitions.violations(live, finished).count() == 0
    sample = tables(spark, SF, "jobs").withColumn("ordering_key", F.lit(None).cast("string"))
    back = transitions.retry(sample, sample, AS_OF).checkpoint()
    before = {(r.rule): r.n for r in transitions.violations(listing.live(sample), listing.history(sample)).collect()}
    live = listing.live(sample).join(back.select("id"), "id", "left_anti").unionByName(back)
    finished = listing.history(sample).join(back.select("id"), "id", "left_anti")
    assert {(r.rule): r.n for r in transitions.violations(live, finished).collect()} == before


def test_aging_wakes_and_depth(spark):
    table = jobs(
        spark, {"id": 1, "scheduled_at": "2026-01-01 11:00:00"}, {"id": 2, "priority": 1}, {"id": 3, "queue": "r"}, {"id": 4, "state": "running"},
        {"id": 5, "state": "scheduled", "ordering_key": "o"}, {"id": 6, "state": "retryable", "ordering_key": "o", "expires_at": "2026-01-01 11:00:00"}, {"id": 7, "state": "running", "ordering_key": "o"},
    )
    assert ids(claim.aging(table, 3600, NOW, "q")) == [1, 5, 6] and ids(claim.aging(table, 3601, NOW)) == [3, 5, 6]
    assert claim.aging(table, 0, NOW).count() == 0
    assert ids(claim.wake_lane(table, "q", "o", 10, NOW)) == [5] and ids(claim.mark_lane(table, "q", "o", NOW)) == [7]
    due = {(r.queue, r.state): r.oldest_due_seconds for r in stats.depth(table, NOW).collect()}
    assert due[("q", "running")] is None and due[("q", "available")] == 7200


def test_cascades_go_down_whole_chains(spark):
    edges = spark.createDataFrame([(1, i + 1, i, "cancel", None) for i in range(25)], "batch_id long, job_id long, depends_on long, on_failure string, any_of int")
    gone = workflow.cascade(edges, spark.createDataFrame([(0,)], "job_id long"))
    assert ids(gone, "job_id") == list(range(1, 26))


def test_many_plain_subscriptions_join(spark):
    events = spark.createDataFrame([(1, i, f"t.{i}", None) for i in range(6)], "xid long, seq long, topic string, key string")
    many = [(f"s{i}", f"t.{i}", "k", "q", False) for i in range(300)] + [("all", "t.#", "k", "q", True)]
    found = {(r.seq, r.subscription, r.max_attempts) for r in messaging.fan_out(events, many).collect()}
    assert found == {(i, f"s{i}", 25) for i in range(6)} | {(i, "all", 10) for i in range(6)}


def test_percentiles_over_partitions(spark):
    rows = spark.range(10_001).select(F.lit("g").alias("g"), (F.col("id") * 7 % 10_001).alias("v")).union(spark.createDataFrame([("one", 5)], "g string, v long"))
    got = {r.g: (r.n, r.p50, r.p99, r.max_value) for r in stats.nearest_index(rows, "g", "v").collect()}
    assert got == {"g": (10_001, 5000, 9900, 10_000), "one": (1, 5, 5, 5)}
