"""Scans and listings of live and finished jobs."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import metadata_contains, valid_tags
from ..sources.ledger import FINISHED


def live(jobs: DataFrame) -> DataFrame:
    return jobs.where(~F.col("state").isin(*FINISHED))


def history(jobs: DataFrame, states: tuple[str, ...] = FINISHED) -> DataFrame:
    return jobs.where(F.col("state").isin(*states))


def everything(live_jobs: DataFrame, finished: DataFrame) -> DataFrame:
    """Live and finished jobs in one shape; what one side lacks is null."""
    return live_jobs.unionByName(finished, allowMissingColumns=True)


@dataclass(frozen=True)
class JobFilter:
    """Empty members match everything."""

    queue: str | None = None
    kinds: tuple[str, ...] = ()
    states: tuple[str, ...] = ()
    ids: tuple[int, ...] = ()
    priorities: tuple[int, ...] = ()
    ordering_key: str | None = None
    tags_any: tuple[str, ...] = ()
    tags_all: tuple[str, ...] = ()
    metadata: dict = field(default_factory=dict)

    def check(self) -> None:
        if self.ordering_key is not None and self.queue is None:
            raise ValueError("an ordering key needs its queue")
        if any(not 1 <= p <= 4 for p in self.priorities):
            raise ValueError("priorities are 1 to 4")
        if not isinstance(self.metadata, dict):
            raise ValueError("a metadata filter is an object")
        valid_tags([*self.tags_any, *self.tags_all])

    def apply(self, jobs: DataFrame) -> DataFrame:
        self.check()
        for name, values in (("kind", self.kinds), ("state", self.states), ("id", self.ids), ("priority", self.priorities)):
            if values:
                jobs = jobs.where(F.col(name).isin(*values))
        for name, value in (("queue", self.queue), ("ordering_key", self.ordering_key)):
            if value is not None:
                jobs = jobs.where(F.col(name) == value)
        if self.tags_any:
            jobs = jobs.where(F.arrays_overlap("tags", F.array(*map(F.lit, valid_tags(list(self.tags_any))))))
        if self.tags_all:
            wanted = F.array(*map(F.lit, valid_tags(list(self.tags_all))))
            jobs = jobs.where(F.size(F.array_except(wanted, F.col("tags"))) == 0)
        return jobs.where(metadata_contains("metadata", self.metadata)) if self.metadata else jobs


def page(jobs: DataFrame, limit: int, after: int | None = None, newest: bool = False) -> DataFrame:
    """One keyset page by id; the sort keeps only ``limit`` rows a task."""
    if after is not None:
        jobs = jobs.where(F.col("id") < after if newest else F.col("id") > after)
    return jobs.orderBy(F.col("id").desc() if newest else "id").limit(limit)


def get_job(jobs: DataFrame, leases: DataFrame, job_id: int) -> DataFrame:
    """One job with the expiry of its lease."""
    lease = leases.select("id", F.col("expires_at").alias("lease_expires_at"))
    return jobs.where(F.col("id") == job_id).join(lease, "id", "left")


def log_runs_page(runs: DataFrame, limit: int, after: tuple[int, int] | None = None) -> DataFrame:
    """Log runs by job, newest fence first, after a (job_id, fence)."""
    if after is not None:
        runs = runs.where((F.col("job_id") > after[0]) | ((F.col("job_id") == after[0]) & (F.col("fence") < after[1])))
    return runs.orderBy("job_id", F.col("fence").desc()).limit(limit)


def read_log(logs: DataFrame, offset: int, size: int, column: str = "text") -> DataFrame:
    """A byte range of a log; offset -1 means its last ``size`` bytes."""
    data = F.col(column).cast("binary")
    start = F.greatest(F.octet_length(data) - size, F.lit(0)) if offset < 0 else F.lit(offset)
    return logs.withColumn("chunk", F.substring(data, start + 1, F.lit(size))).withColumn("from", start.cast("long"))


def unpack_logs(jobs: DataFrame, logs: str = "logs") -> DataFrame:
    """One row for each log entry of each job, with its position."""
    return jobs.select("id", F.posexplode(logs).alias("position", "log"))


def by_ids(jobs: DataFrame, ids: DataFrame) -> DataFrame:
    """Jobs of a parameter table (id, n), in the order n of the parameters; an unknown id gives a row of nulls."""
    return ids.join(jobs, "id", "left").orderBy("n")


def find_job(live_jobs: DataFrame, finished: DataFrame, job_id: int) -> DataFrame:
    """One job, live or finished; the live row wins while a job is on its way to history."""
    both = everything(live_jobs.withColumn("rank", F.lit(0)), finished.withColumn("rank", F.lit(1))).where(F.col("id") == job_id)
    return both.orderBy("rank").limit(1).drop("rank")


def sweep(jobs: DataFrame, size: int):
    """Pages of at most ``size`` jobs by id until none is left; each page is read after the one before."""
    after = None
    while True:
        rows = page(jobs, size, after).checkpoint()
        last = rows.agg(F.max("id")).first()[0]
        if last is None:
            return
        yield rows
        after = last


def newest_per_tag(jobs: DataFrame, tags: tuple[str, ...], n: int) -> DataFrame:
    """Jobs that are among the ``n`` newest of any of the tags, each once (a group limit runs before the shuffle)."""
    rows = jobs.select("id", F.explode("tags").alias("tag")).where(F.col("tag").isin(*tags)).distinct()
    order = Window.partitionBy("tag").orderBy(F.col("id").desc())
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n).select("id").distinct()


def tag_rows(jobs: DataFrame) -> DataFrame:
    """(id, tag, ordinality): one row for each tag, with its place from 1."""
    return jobs.select("id", F.posexplode("tags").alias("place", "tag")).select("id", "tag", (F.col("place") + 1).alias("ordinality"))


def bounded_count(rows: DataFrame, most: int) -> int:
    """The number of rows, or ``most`` + 1 if there are more; scans no further than that."""
    return rows.limit(most + 1).count()


def latest_logs(jobs: DataFrame, keep: int, logs: str = "logs") -> DataFrame:
    """(id, attempt, log): the last entry of each attempt, for the last ``keep`` attempts of each job."""
    entries = unpack_logs(jobs, logs).select("id", "position", "log.attempt", "log.log")
    last = entries.groupBy("id", "attempt").agg(F.max_by("log", "position").alias("log"))
    order = Window.partitionBy("id").orderBy(F.col("attempt").desc())
    return last.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep).drop("rank")


def keyed_live(live_jobs: DataFrame, edges: DataFrame, keys: DataFrame) -> DataFrame:
    """(kind, unique_key, id, state, held): live jobs of the keys; held ones wait for an edge."""
    held = edges.select(F.col("job_id").alias("id"), F.lit(True).alias("held")).distinct()
    rows = live_jobs.join(keys.select("kind", "unique_key").distinct(), ["kind", "unique_key"], "left_semi").join(held, "id", "left")
    return rows.select("kind", "unique_key", "id", "state", F.coalesce("held", F.lit(False)).alias("held"))
