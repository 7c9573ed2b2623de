"""Idempotent acceptance: the first arrival of a (device, date) pair wins.

The pair is found with an aggregation, which combines copies before the shuffle, so a
pair repeated in a third of all rows costs one row per map task. Whole rows are then
matched on their unique arrival number, which no key can skew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ["device_id", "date"]


def first_arrivals(df: DataFrame, *carried: str, copies: str | None = None) -> DataFrame:
    """One row per (device, date): the first arrival's number, measurement and carried
    columns, and on request how many copies arrived. Fixed-width columns keep this a hash
    aggregation."""
    count = [F.count("*").alias(copies)] if copies else []
    return df.groupBy(*KEY).agg(
        F.min("arrival_seq").alias("arrival_seq"),
        *[F.min_by(name, "arrival_seq").alias(name) for name in ("measurement", *carried)],
        *count,
    )


def first_rows(df: DataFrame) -> DataFrame:
    """The accepted rows with all their columns, of any width."""
    first = df.groupBy(*KEY).agg(F.min("arrival_seq").alias("arrival_seq")).select("arrival_seq")
    return df.join(first, "arrival_seq", "left_semi")


def repeats(df: DataFrame) -> DataFrame:
    """The rows that repeat an earlier (device, date) pair, whatever their measurement."""
    first = df.groupBy(*KEY).agg(F.min("arrival_seq").alias("arrival_seq")).select("arrival_seq")
    return df.join(first, "arrival_seq", "left_anti")


def not_stored(first: DataFrame, stored: DataFrame) -> DataFrame:
    """First arrivals whose pair is not in the store. Both sides hold a pair once."""
    return first.join(stored.select(*KEY), KEY, "left_anti")


def mark_stored(first: DataFrame, stored: DataFrame) -> DataFrame:
    """All first arrivals with ``already_stored``: both outcomes in one join."""
    known = stored.select(*KEY, F.lit(True).alias("_known"))
    return first.join(known, KEY, "left").withColumn("already_stored", F.coalesce("_known", F.lit(False))).drop("_known")


def uniqueness_violations(df: DataFrame, *key: str) -> DataFrame:
    """Keys that occur more than once, and how often."""
    return df.groupBy(*key).agg(F.count("*").alias("copies")).where(F.col("copies") > 1)


def audit_rows(accepted: DataFrame, recorded_at) -> DataFrame:
    """Accepted readings as rows of the audit table."""
    return accepted.select("device_id", "measurement", "date", recorded_at.alias("recorded_at"), "arrival_seq")
