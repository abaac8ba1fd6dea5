"""Structured Streaming: fan-out of the event log into deliveries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.messaging import fan_out


def event_stream(spark: SparkSession, path: str, schema, files_a_trigger: int = 100) -> DataFrame:
    """The event log as a file stream; the schema is given, never inferred."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_trigger).parquet(path)


def start_fan_out(events: DataFrame, subscriptions: list[tuple], sink: str, checkpoint: str) -> StreamingQuery:
    """Deliver what is there and stop; the checkpoint is the cursor, the sink is exactly-once."""
    deliveries = fan_out(events, subscriptions)
    return (
        deliveries.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )
