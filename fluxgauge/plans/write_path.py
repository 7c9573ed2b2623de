"""Ingest, validation, de-duplication, audit rows and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxgauge import schemas
from fluxgauge.functions import codec, ids
from fluxgauge.operators import dedup, events, validate
from fluxgauge.plans import sql
from fluxgauge.plans.registry import query
from fluxgauge.sources import readers, views


def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.classify(views.requests(spark, sf_dir), views.as_of())


def accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First arrivals with what the later stages need; all columns have fixed width."""
    return dedup.first_arrivals(views.readings(spark, sf_dir), "event_id", "ts", "k", "route")


@query("src_json_ingest", f"""WITH {sql.RAW},
d AS (
  SELECT event_id, device_id, measurement, ts,
         event_id % 103 = 0 OR (event_id % 5 <> 1 AND event_id % 83 <> 0 AND event_id % 71 = 0) AS broken,
         event_id % 5 <> 1 AND event_id % 83 = 0 AS dateless FROM raw)
SELECT event_id, NOT broken AS decoded,
       CASE WHEN NOT broken THEN device_id END AS device_id,
       CASE WHEN NOT broken THEN CAST(measurement AS DOUBLE) END AS measurement,
       CASE WHEN NOT broken AND NOT dateless THEN ts END AS date
FROM d""")
def src_json_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    decoded = codec.decode_requests(views.request_bodies(spark, sf_dir))
    return decoded.select(
        "event_id",
        F.col("request").isNotNull().alias("decoded"),
        F.col("request.deviceId").alias("device_id"),
        F.col("request.measurement").alias("measurement"),
        F.col("request.date").alias("date"),
    )


@query("validate_domain", f"""WITH {sql.REQ}
SELECT event_id, CASE WHEN detail LIKE '%: %' THEN split_part(detail, ': ', 2) ELSE detail END AS reason FROM cls""")
def validate_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.with_domain_reason(views.requests(spark, sf_dir), views.as_of()).select("event_id", "reason")


@query("rejects", f"""WITH {sql.REQ}
SELECT event_id, status, message, {sql.AS_OF} AS timestamp, device_id,
       CAST(measurement AS DOUBLE) AS measurement, date FROM bad""")
def rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.rejects(classified(spark, sf_dir), views.as_of()).select(
        "event_id", "status", "message", "timestamp", "device_id", "measurement", "date")


@query("reject_status_counts", f"""WITH {sql.REQ}
SELECT status, message, count(*) AS n FROM bad GROUP BY status, message""")
def reject_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.status_counts(validate.rejects(classified(spark, sf_dir), views.as_of()))


@query("null_guard", f"""WITH {sql.REQ}
SELECT event_id, device_id IS NOT NULL AND date IS NOT NULL AS usable FROM req""")
def null_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, bad = validate.null_guard(views.requests(spark, sf_dir), "device_id", "date")
    return good.select("event_id", F.lit(True).alias("usable")).unionByName(
        bad.select("event_id", F.lit(False).alias("usable")))


@query("decimal_overflow", f"""WITH {sql.RAW},
wide AS (
  SELECT event_id, CASE WHEN event_id % 101 = 0 THEN CAST(measurement AS DECIMAL(38,9)) + 100000000
                        ELSE CAST(measurement AS DECIMAL(38,9)) + CAST(0.005 AS DECIMAL(38,9)) END AS m FROM raw)
SELECT event_id, CAST(TRY_CAST(m AS DECIMAL(10,2)) AS DOUBLE) AS stored, abs(m) >= 99999999.995 AS overflow FROM wide""")
def decimal_overflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = F.col("measurement").cast(schemas.WIRE_DECIMAL)
    readings = views.readings(spark, sf_dir).select(
        "event_id",
        F.when(F.col("event_id") % 101 == 0, wide + 100_000_000)
        .otherwise(wide + F.lit("0.005").cast(schemas.WIRE_DECIMAL)).cast(schemas.WIRE_DECIMAL).alias("measurement"),
    )
    return validate.with_stored_measurement(readings).select("event_id", "stored", "overflow")


@query("dedup_accept", f"""WITH {sql.ACC}
SELECT device_id, date, arrival_seq, CAST(measurement AS DOUBLE) AS measurement, event_id FROM acc""")
def dedup_accept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.first_arrivals(views.readings(spark, sf_dir), "event_id")


@query("dedup_rejects", f"""WITH {sql.ACC}
SELECT device_id, date, arrival_seq, CAST(measurement AS DOUBLE) AS measurement, event_id FROM ranked WHERE rn > 1""")
def dedup_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.repeats(views.readings(spark, sf_dir)).select(
        "device_id", "date", "arrival_seq", "measurement", "event_id")


_STORE = f"""{sql.ACC}, store AS (SELECT * FROM acc WHERE date < TIMESTAMP '2024-01-15 00:00:00')"""


@query("dedup_vs_store", f"""WITH {_STORE}
SELECT a.event_id, a.device_id, a.date,
       EXISTS (SELECT 1 FROM store s WHERE s.device_id = a.device_id AND s.date = a.date) AS already_stored FROM acc a""")
def dedup_vs_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = dedup.first_arrivals(views.readings(spark, sf_dir), "event_id")
    marked = dedup.mark_stored(first, views.stored_telemetry(spark, sf_dir))
    return marked.select("event_id", "device_id", "date", "already_stored")


@query("dedup_not_stored", f"""WITH {_STORE}
SELECT a.event_id, a.device_id, a.date FROM acc a
WHERE NOT EXISTS (SELECT 1 FROM store s WHERE s.device_id = a.device_id AND s.date = a.date)""")
def dedup_not_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = dedup.first_arrivals(views.readings(spark, sf_dir), "event_id")
    return dedup.not_stored(first, views.stored_telemetry(spark, sf_dir)).select("event_id", "device_id", "date")


@query("uniq_violations", f"""WITH {sql.RAW}
SELECT device_id, date, count(*) AS copies FROM raw GROUP BY device_id, date HAVING count(*) > 1""")
def uniq_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.uniqueness_violations(views.readings(spark, sf_dir), "device_id", "date")


@query("telemetry_append", f"""WITH {sql.REQ}
SELECT device_id, CAST(CAST(measurement AS DECIMAL(10,2)) AS DOUBLE) AS measurement, date,
       {sql.RECORDED_AT} AS recorded_at, arrival_seq FROM acc_req""")
def telemetry_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = dedup.first_arrivals(validate.valid(classified(spark, sf_dir)))
    return dedup.audit_rows(first, views.recorded_at())


@query("event_envelope", f"""WITH {sql.ACC}
SELECT {sql.event_id()} AS "eventId", device_id AS "deviceId", CAST(measurement AS DOUBLE) AS measurement, date,
       {sql.RECORDED_AT} AS "recordedAt" FROM acc""")
def event_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.envelope(accepted(spark, sf_dir), views.recorded_at())


@query("event_serialize", f"""WITH {sql.ACC}
SELECT CAST(device_id AS VARCHAR) AS key, {sql.topic_partition()} AS partition,
       '{{"eventId":"' || {sql.event_id()} || '","deviceId":' || CAST(device_id AS VARCHAR) || ',"measurement":'
       || CAST(measurement AS VARCHAR) || ',"date":"' || strftime(date, '%Y-%m-%dT%H:%M:%S.%f') || 'Z","recordedAt":"'
       || strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || 'Z"}}' AS value,
       device_id AS decoded_device, CAST(measurement AS DOUBLE) AS decoded_measurement, ts AS decoded_recorded_at
FROM acc""")
def event_serialize(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = events.topic_records(
        events.envelope(accepted(spark, sf_dir), F.col("ts")), timestamp=F.col("recordedAt"))
    event = F.col("event")
    return codec.decode_events(records).select(
        F.col("key").cast("string").alias("key"), "partition", F.col("value").cast("string").alias("value"),
        event["deviceId"].alias("decoded_device"), event["measurement"].alias("decoded_measurement"),
        event["recordedAt"].alias("decoded_recorded_at"))


@query("partition_balance", f"""WITH {sql.RAW}
SELECT {sql.topic_partition()} AS partition, count(*) AS records, count(DISTINCT device_id) AS devices
FROM raw GROUP BY 1""")
def partition_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.partition_counts(views.readings(spark, sf_dir))


@query("trace_id_parse", """WITH t AS (
  SELECT event_id, substr(sha256(CAST(event_id AS VARCHAR)), 1, CASE event_id % 3 WHEN 0 THEN 16 WHEN 1 THEN 32 ELSE 10 END) AS trace_id,
         substr(sha256(CAST(user_id AS VARCHAR)), 1, CASE event_id % 2 WHEN 0 THEN 16 ELSE 15 END) AS span_id FROM events)
SELECT event_id,
       CASE WHEN length(trace_id) IN (16, 32) THEN CAST(CAST('0x' || right(trace_id, 16) AS UBIGINT) AS VARCHAR) END AS trace_id_lo,
       CASE WHEN length(span_id) = 16 THEN CAST(CAST('0x' || span_id AS UBIGINT) AS VARCHAR) END AS span_id_value
FROM t""")
def trace_id_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    event = F.col("event_id")
    sized = readers.table(spark, sf_dir, "events").select(
        event,
        F.substr(F.sha2(event.cast("string"), 256), F.lit(1),
                 F.when(event % 3 == 0, 16).when(event % 3 == 1, 32).otherwise(10)).alias("trace_id"),
        F.substr(F.sha2(F.col("user_id").cast("string"), 256), F.lit(1),
                 F.when(event % 2 == 0, 16).otherwise(15)).alias("span_id"),
    )
    return sized.select(
        "event_id",
        ids.trace_id_low(F.col("trace_id")).cast("string").alias("trace_id_lo"),
        ids.span_id_value(F.col("span_id")).cast("string").alias("span_id_value"),
    )
