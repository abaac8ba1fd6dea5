"""Publish fan-out and the event log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import merged_objects, position_text, visible
from ..functions.topics import topic_matches

#: Attempts of plain and of ordered deliveries (fixed values).
ATTEMPTS, ORDERED_ATTEMPTS = 25, 10
#: Patterns that one projection tests. Beyond it, plain topics go through an equi-join, patterns with wildcards in parts.
MOST_PATTERNS = 200


def fan_out(events: DataFrame, subscriptions: list[tuple]) -> DataFrame:
    """One delivery for each event and matching subscription.

    Subscriptions are a short list of settings, so matching is one narrow projection over the
    log: an array of the matching ones, exploded. No join and no shuffle at any size of log.
    """
    if len(subscriptions) > MOST_PATTERNS:
        plain = [s for s in subscriptions if not set("*#") & set(s[1])]
        wild = [s for s in subscriptions if set("*#") & set(s[1])]
        schema = "subscription string, topic string, kind string, queue string, ordered boolean"
        exact = events.sparkSession.createDataFrame([tuple(s[:5]) for s in plain], schema)
        attempts = F.when(F.col("ordered"), ORDERED_ATTEMPTS).otherwise(ATTEMPTS).alias("max_attempts")
        out = events.join(exact, "topic").select(
            "xid", "seq", "topic", "subscription", "kind", "queue", attempts, F.when(F.col("ordered"), F.col("key")).alias("ordering_key")
        )
        for i in range(0, len(wild), MOST_PATTERNS):
            out = out.unionByName(fan_out(events, wild[i : i + MOST_PATTERNS]))
        return out

    def delivery(name: str, pattern: str, kind: str, queue: str, ordered: bool) -> Column:
        row = F.struct(
            F.lit(name).alias("subscription"), F.lit(kind).alias("kind"), F.lit(queue).alias("queue"),
            F.lit(ORDERED_ATTEMPTS if ordered else ATTEMPTS).alias("max_attempts"),
            (F.col("key") if ordered else F.lit(None).cast("string")).alias("ordering_key"),
        )
        return F.when(topic_matches(F.col("topic"), pattern), row)

    hits = F.filter(F.array(*[delivery(*s) for s in subscriptions]), lambda d: d.isNotNull())
    return events.select("xid", "seq", "topic", F.inline(hits))


def deduplicated(deliveries: DataFrame, dedup_id: str) -> DataFrame:
    """Unique keys ``msg:<id>`` of published deliveries."""
    return deliveries.withColumn("unique_key", F.concat(F.lit("msg:"), F.col(dedup_id)))


def read_log(events: DataFrame, pattern: str, after: tuple[int, int] | None, limit: int) -> DataFrame:
    """Events of a pattern after a position, in numeric position order."""
    rows = events.where(topic_matches(F.col("topic"), pattern))
    if after is not None:
        rows = rows.where((F.col("xid") > after[0]) | ((F.col("xid") == after[0]) & (F.col("seq") > after[1])))
    return rows.orderBy("xid", "seq").limit(limit)


def snapshot(xmin: int, xmax: int, xip: tuple[int, ...] = ()) -> Column:
    return F.struct(F.lit(xmin).alias("xmin"), F.lit(xmax).alias("xmax"), F.array(*[F.lit(x).cast("long") for x in xip]).alias("xip"))


def pump(events: DataFrame, pattern: str, seen: Column, now: Column, cursor: tuple[int, int] | None, limit: int) -> DataFrame:
    """The next events of a consumer: committed by ``now``, not yet in ``seen``, past the cursor.

    A long transaction holds nothing back: its events come once it is in a later snapshot.
    """
    delta = events.where(visible(F.col("xid"), now) & ~visible(F.col("xid"), seen))
    return read_log(delta, pattern, cursor, limit)


def advance(consumer: dict, delivered: list[tuple[int, int]], limit: int, now: dict) -> dict:
    """The consumer's row after a pump: cursor moved, or the delta closed when it is exhausted."""
    reading = consumer.get("reading") or now
    if len(delivered) < limit:
        return consumer | {"seen": reading, "reading": None, "cursor": None}
    return consumer | {"reading": reading, "cursor": max(delivered)}


def seek(events: DataFrame, position: tuple[int, int] | None = None, since: str | None = None, latest: bool = False) -> DataFrame:
    """(xid, seq) after which a consumer reads on: a position, else a time, else latest, else the start."""
    if position is not None:
        return events.sparkSession.createDataFrame([position], "xid long, seq long")
    if since is not None:
        before = events.where(F.col("created_at") < F.lit(since).cast("timestamp_ntz"))
        return before.agg(F.max(F.struct("xid", "seq")).alias("p")).select("p.xid", "p.seq")
    if latest:
        return events.agg(F.max(F.struct("xid", "seq")).alias("p")).select("p.xid", "p.seq")
    return events.sparkSession.createDataFrame([(0, 0)], "xid long, seq long")


def publish(events: DataFrame, subscriptions: list[tuple], metadata: dict[str, str], delay_seconds: int, ttl_seconds: int, as_of: str) -> DataFrame:
    """Deliveries of a publish: delayed, with a time to live, a unique key ``msg:<id>`` and merged metadata.

    ``events`` have message_id and headers (JSON); ``metadata`` holds JSON by subscription. Members of the
    event's headers win over those of the subscription. A delivery is available at once without a delay.
    """
    now = F.lit(as_of).cast("timestamp_ntz")
    rows = fan_out(events, subscriptions).join(events.select("xid", "seq", "message_id", "headers"), ["xid", "seq"])
    own = F.create_map(*[F.lit(x) for kv in sorted(metadata.items()) for x in kv]) if metadata else None
    base = F.try_element_at(own, F.col("subscription")) if own is not None else F.lit(None).cast("string")
    starts = now + F.make_dt_interval(secs=F.lit(delay_seconds))
    return deduplicated(rows, "message_id").withColumns(
        {
            "state": F.lit("scheduled" if delay_seconds > 0 else "available"), "scheduled_at": starts,
            "expires_at": starts + F.make_dt_interval(secs=F.lit(ttl_seconds)) if ttl_seconds > 0 else F.lit(None).cast("timestamp_ntz"),
            "metadata": merged_objects(base, F.col("headers")),
        }
    )


def publish_counts(deliveries: DataFrame, live: DataFrame) -> DataFrame:
    """(subscription, inserted, duplicates) of a publish against live jobs (kind, unique_key)."""
    held = live.where("unique_key IS NOT NULL").select("kind", "unique_key").distinct().withColumn("held", F.lit(True))
    rows = deliveries.join(held, ["kind", "unique_key"], "left")
    first = F.count_if(F.col("held").isNull())
    return rows.groupBy("subscription").agg(first.alias("inserted"), F.count_if(F.col("held")).alias("duplicates"))


def deliver(events: DataFrame, consumer: str, kind: str, ordered: bool, headers: str = "headers", metadata: str | None = None) -> DataFrame:
    """Jobs of pumped events: events of one key keep their order in a lane of the consumer.

    Unlike in ``publish``, members of the consumer's metadata win over those of the event.
    """
    lane = F.when(F.lit(ordered) & F.col("key").isNotNull(), F.concat(F.lit(f"{consumer}:"), F.col("key")))
    return events.select(
        "xid", "seq", F.lit(kind).alias("kind"), lane.alias("ordering_key"), F.concat(F.lit(f"stream:{consumer}:"), position_text(F.col("xid"), F.col("seq"))).alias("unique_key"),
        merged_objects(F.col(headers), F.lit(metadata)).alias("metadata"),
    )


def days_to_drop(events: DataFrame, keep_days: int, as_of: str) -> DataFrame:
    """(day, n): whole days of the log that are past ``keep_days``."""
    days = events.groupBy(F.to_date("created_at").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return days.where(F.date_add("day", 1).cast("timestamp_ntz") <= F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(days=F.lit(keep_days)))
