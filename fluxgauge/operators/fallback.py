"""Events that could not be published: kept in a table, replayed oldest first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluxgauge import schemas
from fluxgauge.functions import outcome


def rows(events: DataFrame, failed_at: Column) -> DataFrame:
    """Events as fallback rows; the recording time is not kept."""
    return events.select(
        F.col("eventId").alias("event_id"),
        F.col("deviceId").alias("device_id"),
        F.col("measurement").cast(schemas.TABLE_DECIMAL).alias("measurement"),
        "date",
        failed_at.alias("failed_at"),
    )


def oldest_first(fallback: DataFrame) -> DataFrame:
    return fallback.orderBy("failed_at", "event_id")


def newest_first(fallback: DataFrame, k: int | None = None) -> DataFrame:
    ordered = fallback.orderBy(F.desc("failed_at"), "event_id")
    return ordered if k is None else ordered.limit(k)


def replay(fallback: DataFrame, sink_healthy: bool, *carried: str) -> DataFrame:
    """Events to publish again; none while the sink is unhealthy. The time of failure
    stands in for the recording time. ``carried`` columns stay in front."""
    return fallback.where(F.lit(sink_healthy)).select(
        *carried,
        F.col("event_id").alias("eventId"),
        F.col("device_id").alias("deviceId"),
        "measurement",
        "date",
        F.col("failed_at").alias("recordedAt"),
    )


def remaining(fallback: DataFrame, replayed: DataFrame) -> DataFrame:
    """What stays in the table once the given events (``event_id``) were published."""
    return fallback.join(replayed.select("event_id"), "event_id", "left_anti")


def replay_summary(attempts: DataFrame, sink_healthy: bool) -> DataFrame:
    """Successes, failures and the reply text of one replay run (``published`` per row)."""
    tried = attempts.where(F.lit(sink_healthy))
    counted = tried.agg(
        F.count_if(F.col("published")).alias("replayed_count"),
        F.count_if(~F.col("published")).alias("failed_count"),
    )
    return counted.withColumn("message", outcome.count_message(
        F.col("replayed_count"), outcome.REPLAYED, outcome.NOTHING_TO_REPLAY))
