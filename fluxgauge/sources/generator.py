"""Repeatable random readings, for demos and load trials."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxgauge import schemas


def readings(spark: SparkSession, rows: int, devices: int = 10, start: str = "2025-01-31 10:00:00") -> DataFrame:
    """Devices 1..n, measurements 10 to 59, one reading per second."""
    pick = F.pmod(F.xxhash64("id"), F.lit(devices))
    level = F.pmod(F.xxhash64("id", F.lit("level")), F.lit(50))
    return spark.range(rows).select(
        F.col("id").alias("arrival_seq"),
        (pick + 1).alias("device_id"),
        (level + 10).cast(schemas.WIRE_DECIMAL).alias("measurement"),
        F.timestamp_seconds(F.unix_timestamp(F.lit(start).cast("timestamp")) + F.col("id")).alias("date"),
    )
