"""Telemetry-shaped views over the given tables.

Each is a row-wise mapping or one hash aggregation, so a view costs the operators
above it no extra sort and holds for any distribution of keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxgauge import schemas
from fluxgauge.functions import codec, headers, ids
from fluxgauge.operators import blocks, projection
from fluxgauge.sources.readers import DEAD_LETTER_TOPIC, TOPIC_PARTITIONS, table

# Readings later than this instant count as future ones in the derived requests.
AS_OF = "2024-01-25 00:00:00"
# When derived rows were recorded.
RECORDED_AT = "2024-02-01 00:00:00"
# How far the stored tables of an earlier run reach.
STORED_UNTIL = "2024-01-15 00:00:00"
PROJECTED_UNTIL = "2024-01-02 00:00:00"

PUBLISHED, FALLBACK, DEAD_LETTER = 0, 1, 2

# Arrival numbers of the derived readings are spaced by this much, so the operators'
# blocks of consecutive arrivals are counted in these units.
ARRIVAL_UNIT = 10_000_000
# Places that an arrival number moves a row by at most, and offsets to a place.
MOVED = 210
OFFSETS = 2 * MOVED + 1


def as_of():
    return F.lit(AS_OF).cast("timestamp")


def recorded_at():
    return F.lit(RECORDED_AT).cast("timestamp")


def arrival_seq(event_id):
    """A unique arrival number that moves rows up to 210 places from their time order."""
    return (event_id + (event_id * 7919) % 211) * ARRIVAL_UNIT + event_id


def offset(number):
    """An arrival number without the gaps, so that it fits an offset's 48 bits; in the same order."""
    shifted = number + MOVED
    return blocks.block_of(shifted, ARRIVAL_UNIT + 1) * OFFSETS + F.pmod(shifted, F.lit(ARRIVAL_UNIT + 1))


def arrival_at(offset):
    """The arrival number whose ``offset`` this is."""
    return blocks.block_of(offset, OFFSETS) * (ARRIVAL_UNIT + 1) + F.pmod(offset, F.lit(OFFSETS)) - MOVED


def shape_readings(events: DataFrame) -> DataFrame:
    """Readings from ``events``, batch or stream, with disorder and repeated (device, date) pairs."""
    event_id = F.col("event_id")
    return events.select(
        arrival_seq(event_id).alias("arrival_seq"),
        event_id,
        F.col("user_id").alias("device_id"),
        F.col("value").cast(schemas.TABLE_DECIMAL).alias("measurement"),
        F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("date"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
        F.when(F.col("event_type") == "error", FALLBACK)
        .when(F.col("event_type") == "signup", DEAD_LETTER)
        .otherwise(PUBLISHED)
        .alias("route"),
    )


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shape_readings(table(spark, sf_dir, "events"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings with missing fields, too large measurements and future dates."""
    event_id = F.col("event_id")
    wide = F.col("measurement").cast(schemas.WIRE_DECIMAL)
    return readings(spark, sf_dir).select(
        "arrival_seq",
        "event_id",
        F.when(event_id % 97 != 0, F.col("device_id")).alias("device_id"),
        F.when(event_id % 101 == 0, wide + 100_000_000).when(event_id % 89 != 0, wide)
        .cast(schemas.WIRE_DECIMAL).alias("measurement"),
        F.when(event_id % 83 != 0, F.col("date")).alias("date"),
        "ts",
        "k",
        "route",
    )


def request_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests as JSON text: ISO dates, epoch dates, numbers sent as text, and broken bodies."""
    event_id = F.col("event_id")
    iso = F.concat(F.lit('"'), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"), F.lit('"'))
    epoch = (F.unix_micros("ts").cast("decimal(20,0)") / F.lit(1_000_000).cast("decimal(7,0)")).cast("decimal(20,6)")
    date = (
        F.when(event_id % 5 == 1, epoch.cast("string"))
        .when(event_id % 83 == 0, F.lit("null"))
        .when(event_id % 71 == 0, F.lit('"yesterday"'))
        .otherwise(iso)
    )
    number = F.col("measurement").cast("string")
    measurement = F.when(event_id % 7 == 2, F.concat(F.lit('"'), number, F.lit('"'))).otherwise(number)
    end = F.when(event_id % 103 == 0, F.lit("")).otherwise(F.lit("}"))
    return readings(spark, sf_dir).select(
        "event_id",
        F.concat(F.lit('{"deviceId":'), F.col("device_id").cast("string"), F.lit(',"measurement":'), measurement,
                 F.lit(',"date":'), date, end).alias("body"),
    )


def stored_telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an earlier run already kept: the first half of the month."""
    return (
        readings(spark, sf_dir)
        .where(F.col("date") < F.lit(STORED_UNTIL).cast("timestamp"))
        .groupBy("device_id", "date")
        .agg(F.min_by("measurement", "arrival_seq").alias("measurement"), F.min("arrival_seq").alias("arrival_seq"))
        .select("device_id", "measurement", "date", recorded_at().alias("recorded_at"), "arrival_seq")
    )


def stored_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An earlier read model, as of the end of the first day; later devices are missing."""
    return (
        readings(spark, sf_dir)
        .where(F.col("date") < F.lit(PROJECTED_UNTIL).cast("timestamp"))
        .groupBy("device_id")
        .agg(
            F.max_by("measurement", projection.age("date", -F.col("arrival_seq"))).alias("latest_measurement"),
            F.max("date").alias("latest_date"),
        )
        .withColumn("updated_at", recorded_at())
    )


def dead_letter_records(readings: DataFrame) -> DataFrame:
    """Dead-letter topic records with one header pair per failed delivery.

    ``k`` sets how often delivery failed; some records carry a broken value or count.
    """
    k = F.col("k")
    event = codec.encode_event(
        ids.event_id(F.col("device_id"), F.col("date")).alias("eventId"),
        F.col("device_id").alias("deviceId"),
        F.col("measurement").alias("measurement"),
        F.col("date").alias("date"),
        F.col("ts").alias("recordedAt"),
    )
    value = F.when(k % 25 == 24, F.concat(F.lit("#"), event)).otherwise(event)
    attempts = F.when(k % 4 > 0, F.sequence(F.lit(1), k % 4)).otherwise(F.expr("array()").cast("array<int>"))

    def pair(attempt):
        count = F.when((k % 10 == 9) & (attempt == k % 4), F.lit("x")).otherwise(attempt.cast("string"))
        text = F.concat(F.lit("cannot store reading: "), (k % 3).cast("string"))
        return F.array(headers.header(headers.RETRY_COUNT, count), headers.header(headers.EXCEPTION_MESSAGE, text))

    return readings.select(
        F.col("device_id").cast("string").cast("binary").alias("key"),
        value.cast("binary").alias("value"),
        F.lit(DEAD_LETTER_TOPIC).alias("topic"),
        ids.topic_partition(F.col("device_id").cast("string"), TOPIC_PARTITIONS).alias("partition"),
        F.col("event_id").alias("offset"),
        F.timestamp_millis(F.unix_millis("ts")).alias("timestamp"),
        F.flatten(F.transform(attempts, pair)).alias("headers"),
    )


def received_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One counter series per event type, restarting from zero every 500 events."""
    return table(spark, sf_dir, "events").select(
        F.lit("telemetry_received_total").alias("metric"),
        F.create_map(
            F.lit("type"), F.col("event_type"),
            F.lit("job"), F.lit("telemetry-service"),
            F.lit("status"), F.when(F.col("event_type") == "error", F.lit("500")).otherwise(F.lit("202")),
        ).alias("labels"),
        F.col("ts").cast("timestamp").alias("ts"),
        (F.col("event_id") % 500).cast("double").alias("value"),
    )


def memory_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Used and maximum memory gauges, one pair per event."""
    events = table(spark, sf_dir, "events").select(
        F.col("ts").cast("timestamp").alias("ts"),
        F.create_map(F.lit("area"), F.when(F.col("user_id") % 3 == 0, F.lit("heap")).otherwise(F.lit("nonheap")),
                     F.lit("instance"), F.col("user_id").cast("string")).alias("labels"),
        F.col("value"),
    )
    used = events.select(F.lit("jvm_memory_used_bytes").alias("metric"), "labels", "ts", "value")
    limit = events.select(F.lit("jvm_memory_max_bytes").alias("metric"), "labels", "ts",
                          F.lit(500.0).alias("value"))
    return used.unionByName(limit)


def delivery_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Publish attempts per device: whether they failed, how long they took, the breaker state."""
    return shape_outcomes(table(spark, sf_dir, "events"))


def shape_outcomes(events: DataFrame) -> DataFrame:
    """The same of ``events``, batch or stream."""
    return events.select(
        F.col("user_id").alias("device_id"),
        F.col("event_id").alias("seq"),
        F.col("ts").cast("timestamp").alias("ts"),
        (F.col("event_type") == "error").alias("failed"),
        F.col("value").cast(schemas.TABLE_DECIMAL).alias("elapsed_ms"),
        F.when(F.col("event_type") == "error", 2).when(F.col("event_type") == "signup", 1).otherwise(0).alias("state"),
    )


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One span per (order, line number); span n hangs under span n/2, so 1 is the root."""
    line = F.col("l_linenumber").cast("bigint")
    grouped = (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_orderkey", line.alias("line"))
        .agg(
            F.sum(F.col("l_quantity").cast(schemas.TABLE_DECIMAL)).alias("duration_ms"),
            F.min(F.ascii("l_returnflag")).alias("service_code"),
            F.max(F.ascii("l_linestatus")).alias("status_code"),
            F.min(F.col("l_shipdate").cast("timestamp")).alias("start"),
        )
    )
    return grouped.select(
        F.lpad(F.hex("l_orderkey"), 32, "0").alias("trace_id"),
        F.lpad(F.hex("line"), 16, "0").alias("span_id"),
        F.when(F.col("line") > 1, F.lpad(F.hex(F.expr("line div 2")), 16, "0")).alias("parent_id"),
        F.concat(F.lit("step-"), F.col("line").cast("string")).alias("name"),
        F.concat(F.lit("service-"), F.expr("chr(service_code)")).alias("service"),
        "start",
        F.col("duration_ms").cast("double").alias("duration_ms"),
        F.create_map(F.lit("error"), F.when(F.col("status_code") == F.ascii(F.lit("O")), F.lit("true"))
                     .otherwise(F.lit("false"))).alias("tags"),
    )


def write_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The write side of each trace: one per order."""
    return table(spark, sf_dir, "orders").select(
        F.lpad(F.hex("o_orderkey"), 32, "0").alias("trace_id"), F.col("o_orderdate").cast("timestamp").alias("start")
    )


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Service log lines, one per order; some are written outside any trace."""
    order = F.col("o_orderkey")
    level = F.when(F.col("o_orderstatus") == "F", F.lit("ERROR")).otherwise(F.lit(" INFO"))
    ids_text = F.when(order % 11 == 0, F.lit(",")).otherwise(
        F.concat(F.lpad(F.hex("o_orderkey"), 32, "0"), F.lit(","), F.lpad(F.hex("o_custkey"), 16, "0"))
    )
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("line_no"),
        F.concat(F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy-MM-dd HH:mm:ss.SSS"), F.lit(" "), level,
                 F.lit(" [telemetry-service,"), ids_text, F.lit("] handler : order "),
                 order.cast("string")).alias("line"),
    )
