"""Events of accepted readings, and their form on the topic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluxgauge.functions import codec, headers, ids
from fluxgauge.sources.readers import MAIN_TOPIC, TOPIC_PARTITIONS


def envelope(
    accepted: DataFrame, recorded_at: Column, event_id: Column | None = None, keep: tuple[str, ...] = ()
) -> DataFrame:
    """Accepted readings as events. The id is name-based unless another one is given.
    ``keep`` names columns to carry along."""
    named = ids.event_id(F.col("device_id"), F.col("date")) if event_id is None else event_id
    return accepted.select(
        named.alias("eventId"),
        F.col("device_id").alias("deviceId"),
        F.col("measurement"),
        F.col("date"),
        recorded_at.alias("recordedAt"),
        *keep,
    )


def topic_records(
    events: DataFrame, timestamp: Column, record_headers: Column | None = None,
    topic: str = MAIN_TOPIC, partitions: int = TOPIC_PARTITIONS, keep: tuple[str, ...] = (),
) -> DataFrame:
    """Events as keyed records: the device id as text, the event as JSON."""
    key = F.col("deviceId").cast("string")
    none = F.expr("array()").cast("array<struct<key:string,value:binary>>")
    return events.select(
        key.cast("binary").alias("key"),
        codec.encode_event(*[F.col(c) for c in ("eventId", "deviceId", "measurement", "date", "recordedAt")])
        .cast("binary").alias("value"),
        F.lit(topic).alias("topic"),
        ids.topic_partition(key, partitions).alias("partition"),
        timestamp.alias("timestamp"),
        (none if record_headers is None else record_headers).alias("headers"),
        *keep,
    )


def read_events(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Decode records: the events with their trace headers, and the undecodable records."""
    decoded = codec.decode_events(records)
    good = decoded.where(F.col("event").isNotNull()).select(
        "event.*", "partition", "offset", "timestamp",
        headers.last(F.col("headers"), headers.TRACE_ID).alias("trace_id"),
        headers.last(F.col("headers"), headers.SPAN_ID).alias("span_id"),
    )
    return good, decoded.where(F.col("event").isNull()).drop("event")


def with_trace_headers(records: DataFrame, trace_id: Column, span_id: Column) -> DataFrame:
    """Append the current trace context; receivers use the last one."""
    return records.withColumn("headers", headers.append(
        F.col("headers"), headers.header(headers.TRACE_ID, trace_id), headers.header(headers.SPAN_ID, span_id)))


def partition_counts(readings: DataFrame, partitions: int = TOPIC_PARTITIONS) -> DataFrame:
    """How many records and devices each topic partition receives."""
    per_device = readings.groupBy("device_id").agg(F.count("*").alias("records"))
    return (
        per_device.groupBy(ids.topic_partition(F.col("device_id").cast("string"), partitions).alias("partition"))
        .agg(F.sum("records").alias("records"), F.count("*").alias("devices"))
    )
