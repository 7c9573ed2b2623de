"""Forms that keep their state in Spark's state store instead of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dedup_all_history(stream: DataFrame) -> DataFrame:
    """First seen per (device, date), never forgotten: state grows with the pairs."""
    return stream.dropDuplicates(["device_id", "date"])


def dedup_within(stream: DataFrame, delay: str) -> DataFrame:
    """The same with bounded state: repeats later than ``delay`` are accepted again."""
    return stream.withWatermark("date", delay).dropDuplicatesWithinWatermark(["device_id", "date"])


def latest(stream: DataFrame) -> DataFrame:
    """Latest reading per device in update mode; state is one row per device."""
    return stream.groupBy("device_id").agg(
        F.max_by("measurement", F.struct("date", "arrival_seq")).alias("latest_measurement"),
        F.max("date").alias("latest_date"),
    )
