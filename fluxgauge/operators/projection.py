"""The read model: the latest reading of every device.

A reading replaces the stored one unless the stored date is strictly later, so among
equal dates the last arrival stays. Repeated (device, date) pairs were removed before,
where the first arrival stays.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fluxgauge.operators import blocks


# Room for any 64-bit arrival number below the date in one decimal of 38 digits.
_ARRIVALS = Decimal(10**19)
_BEFORE_ALL = -(10**18)


def age(date: str, arrival: Column) -> Column:
    """Date, then arrival, as one number. Aggregates over it are hash aggregates; over a struct, each would sort its
    whole input first. A missing date or arrival precedes all others; a date out of range raises an overflow."""
    micros = F.coalesce(F.unix_micros(F.col(date)), F.lit(_BEFORE_ALL)).cast("decimal(19,0)")
    return micros * F.lit(_ARRIVALS).cast("decimal(20,0)") + F.coalesce(arrival, F.lit(_BEFORE_ALL)).cast("decimal(19,0)")


def latest(events: DataFrame) -> DataFrame:
    """Fold events into one row per device; combines on the map side, shuffles devices only."""
    return events.groupBy("device_id").agg(
        F.max_by("measurement", age("date", F.col("arrival_seq"))).alias("latest_measurement"),
        F.max("date").alias("latest_date"),
    )


def latest_accepted(readings: DataFrame) -> DataFrame:
    """De-duplicate and fold in one aggregation.

    The latest reading of a device is the first arrival at its greatest date, so the
    (device, date) exchange that de-duplication alone would need is not needed here.
    """
    return readings.groupBy("device_id").agg(
        F.max_by("measurement", age("date", -F.col("arrival_seq"))).alias("latest_measurement"),
        F.max("date").alias("latest_date"),
    )


def device_response(projection: DataFrame) -> DataFrame:
    return projection.select(
        F.col("device_id").alias("deviceId"),
        F.col("latest_measurement").alias("measurement"),
        F.col("latest_date").alias("date"),
    )


def device(projection: DataFrame, device_id) -> DataFrame:
    """Point lookup; the filter reaches the scan."""
    return projection.where(F.col("device_id") == F.lit(device_id))


def most_recent(projection: DataFrame, k: int) -> DataFrame:
    return projection.orderBy(F.desc("latest_date"), "device_id").limit(k)


def against_projection(events: DataFrame, projection: DataFrame) -> DataFrame:
    """Each event beside its device's stored row: is the device known, is the event stale.

    The projection holds a device once, so a busy device is skewed on the events' side
    only, which adaptive execution splits. Broadcasting is left to measured sizes.
    """
    stored = projection.select("device_id", "latest_date", "latest_measurement")
    return events.join(stored, "device_id", "left").withColumns({
        "known": F.col("latest_date").isNotNull() | F.col("latest_measurement").isNotNull(),
        "stale": F.coalesce(F.col("latest_date") > F.col("date"), F.lit(False)),
    })


def with_out_of_order(
    events: DataFrame, projection: DataFrame | None = None, block_width: int = blocks.ARRIVALS_PER_BLOCK,
    arrivals: DataFrame | None = None,
) -> DataFrame:
    """Flag events that arrive after a strictly later one of their device.

    Skipped events never raise the stored date, so the running maximum over all earlier
    arrivals equals the stored date. A stored projection simply precedes every arrival.
    ``arrivals`` are the readings before de-duplication: repeats change no maximum, so
    summing those up saves de-duplicating once more.
    """
    seed = None
    if projection is not None:
        seed = projection.select("device_id", F.col("latest_date").alias("stored_date"))
    seen = blocks.running(
        events, ["device_id"], [F.col("arrival_seq")], blocks.block_of(F.col("arrival_seq"), block_width),
        {"stored_date": ("max", F.col("date"))}, inclusive=False, seed=seed, summary_rows=arrivals,
    )
    return seen.withColumn("out_of_order", F.coalesce(F.col("stored_date") > F.col("date"), F.lit(False)))


def history(events: DataFrame, block_width: int = blocks.ARRIVALS_PER_BLOCK) -> DataFrame:
    """The projection as it stands after each event; a skipped event leaves it unchanged."""
    state = F.struct(
        F.col("date"), F.col("arrival_seq").alias("seq"), F.col("measurement").alias("value")
    )
    seen = blocks.running(
        events, ["device_id"], [F.col("arrival_seq")], blocks.block_of(F.col("arrival_seq"), block_width),
        {"state": ("max", state)},
    )
    return seen.withColumns({
        "latest_measurement": F.col("state.value"),
        "latest_date": F.col("state.date"),
    }).drop("state")


def merge(projection: DataFrame, events: DataFrame, updated_at: Column) -> DataFrame:
    """Upsert: fold stored rows and new events together. Stored rows arrived before all
    events; a stored row without a date is older than anything. Only changed or new
    devices get the new ``updated_at``."""
    stored = projection.select(
        "device_id", "latest_measurement", "latest_date", F.lit(None).cast("bigint").alias("arrival_seq"), "updated_at"
    )
    new = events.select(
        "device_id",
        F.col("measurement").alias("latest_measurement"),
        F.col("date").alias("latest_date"),
        "arrival_seq",
        updated_at.alias("updated_at"),
    )
    newest = age("latest_date", F.col("arrival_seq"))
    return stored.unionByName(new).groupBy("device_id").agg(
        F.max_by("latest_measurement", newest).alias("latest_measurement"),
        F.max("latest_date").alias("latest_date"),
        F.max_by("updated_at", newest).alias("updated_at"),
    )


def recent_per_device(events: DataFrame, k: int) -> DataFrame:
    """The k latest readings of every device, latest first. Spark limits each device to k
    rows before the shuffle as well, so a busy device sends k rows per map task."""
    latest_first = Window.partitionBy("device_id").orderBy(F.desc("date"), F.desc("arrival_seq"))
    return events.withColumn("rank", F.row_number().over(latest_first)).where(F.col("rank") <= k)
