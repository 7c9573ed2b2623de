"""Fallback table, dead letters, replay and reconciliation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxgauge.functions import headers
from fluxgauge.operators import dead_letter, dedup, events, fallback, metrics, projection
from fluxgauge.plans import sql
from fluxgauge.plans.registry import query
from fluxgauge.plans.write_path import accepted
from fluxgauge.sources import views


def _routed(spark: SparkSession, sf_dir: str, route: int) -> DataFrame:
    return accepted(spark, sf_dir).where(F.col("route") == route)


def fallback_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events whose publishing failed five seconds after they were recorded."""
    failed = events.envelope(_routed(spark, sf_dir, views.FALLBACK), F.col("ts"))
    return fallback.rows(failed, F.col("recordedAt") + F.expr("INTERVAL 5 SECONDS"))


def dead_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.dead_letter_records(_routed(spark, sf_dir, views.DEAD_LETTER))


def dead_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dead_letter.messages(dead_records(spark, sf_dir))


def _attempts(rows: DataFrame) -> DataFrame:
    """A replay run in which events measured below 5 fail again."""
    return rows.withColumn("published", F.col("measurement") >= 5)


_FALLBACK_COLUMNS = "event_id, device_id, CAST(measurement AS DOUBLE) AS measurement, date, failed_at"


@query("fallback_route", f"WITH {sql.FALLBACK} SELECT {_FALLBACK_COLUMNS} FROM fallback")
def fallback_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fallback_rows(spark, sf_dir)


@query("fallback_ordered", f"WITH {sql.FALLBACK} SELECT {_FALLBACK_COLUMNS} FROM fallback ORDER BY failed_at, event_id")
def fallback_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fallback.oldest_first(fallback_rows(spark, sf_dir))


@query("fallback_recent", f"""WITH {sql.FALLBACK}
SELECT {_FALLBACK_COLUMNS} FROM fallback ORDER BY failed_at DESC, event_id""")
def fallback_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fallback.newest_first(fallback_rows(spark, sf_dir))


@query("fallback_replay", f"""WITH {sql.FALLBACK}
SELECT event_id AS "eventId", device_id AS "deviceId", CAST(measurement AS DOUBLE) AS measurement, date,
       failed_at AS "recordedAt" FROM fallback""")
def fallback_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fallback.replay(fallback_rows(spark, sf_dir), sink_healthy=True)


def _latest_with(main: DataFrame, again: DataFrame) -> DataFrame:
    """The projection once republished events joined the main stream, behind the others."""
    columns = [F.col("deviceId").alias("device_id"), "measurement", "date"]
    first = main.select(*columns, F.lit(0).cast("bigint").alias("arrival_seq"))
    return projection.latest(first.unionByName(again.select(*columns, F.lit(1).cast("bigint").alias("arrival_seq"))))


_LATEST_OF = """SELECT device_id, CAST(measurement AS DOUBLE) AS latest_measurement, date AS latest_date FROM (
  SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY date DESC) AS newest FROM stream) t WHERE newest = 1"""


@query("fallback_replay_latest", f"""WITH {sql.ACC},
stream AS (SELECT * FROM acc WHERE route IN (0, 1)) {_LATEST_OF}""")
def fallback_replay_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    main = events.envelope(_routed(spark, sf_dir, views.PUBLISHED), F.col("ts"))
    return _latest_with(main, fallback.replay(fallback_rows(spark, sf_dir), sink_healthy=True))


@query("fallback_remaining", f"WITH {sql.FALLBACK} SELECT {_FALLBACK_COLUMNS} FROM fallback WHERE measurement < 5")
def fallback_remaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fallback_rows(spark, sf_dir)
    return fallback.remaining(rows, _attempts(rows).where("published"))


@query("replay_summary", f"""WITH {sql.FALLBACK}, n AS (
  SELECT count(*) FILTER (WHERE measurement >= 5) AS replayed_count,
         count(*) FILTER (WHERE measurement < 5) AS failed_count FROM fallback)
SELECT replayed_count, failed_count, 'Successfully replayed ' || CAST(replayed_count AS VARCHAR) || ' events' AS message FROM n
UNION ALL SELECT 0, 0, 'No fallback events to replay'""")
def replay_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run against a healthy sink, and one that finds the sink unhealthy."""
    attempts = _attempts(fallback_rows(spark, sf_dir))
    return fallback.replay_summary(attempts, True).unionByName(fallback.replay_summary(attempts, False))


@query("dlq_route", f"""WITH {sql.ACC}
SELECT CAST(device_id AS VARCHAR) AS key, {sql.topic_partition()} AS partition,
       CASE WHEN route = 2 THEN 'telemetry.recorded.dlq' ELSE 'telemetry.recorded' END AS topic,
       CAST(CASE WHEN route = 2 THEN 3 ELSE 0 END AS BIGINT) AS retry_count,
       CASE WHEN route = 2 THEN 'cannot store reading' ELSE 'Unknown error' END AS error_message,
       CAST(CASE WHEN route = 2 THEN 8 ELSE 2 END AS BIGINT) AS header_count,
       lpad(hex(event_id), 32, '0') AS trace_id
FROM acc""")
def dlq_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of readings that cannot be stored leave the main topic; the trace stays on."""
    rows = accepted(spark, sf_dir)
    records = events.with_trace_headers(
        events.topic_records(
            events.envelope(rows, F.col("ts"), keep=("event_id", "route")), F.col("recordedAt"), keep=("event_id", "route")),
        F.lpad(F.hex("event_id"), 32, "0"), F.lpad(F.hex("event_id"), 16, "0"))
    good, bad = dead_letter.route(records, F.when(F.col("route") == views.DEAD_LETTER, F.lit("cannot store reading")))
    return good.unionByName(bad).select(
        F.col("key").cast("string").alias("key"), "partition", "topic",
        headers.retry_count(F.col("headers")).alias("retry_count"),
        headers.error_message(F.col("headers")).alias("error_message"),
        F.size("headers").alias("header_count"),
        headers.last(F.col("headers"), headers.TRACE_ID).alias("trace_id"))


_MESSAGE = """event_id, device_id, CAST(measurement AS DOUBLE) AS measurement, date, error_message, retry_count,
       record_ts AS timestamp, part AS partition, off AS offset"""


def _flat(listed: DataFrame) -> DataFrame:
    return listed.select(
        F.col("event.eventId").alias("event_id"), F.col("event.deviceId").alias("device_id"),
        F.col("event.measurement").alias("measurement"), F.col("event.date").alias("date"),
        F.col("errorMessage").alias("error_message"), F.col("retryCount").alias("retry_count"),
        "timestamp", "partition", "offset")


@query("dlq_list", f"WITH {sql.DLQ} SELECT {_MESSAGE} FROM msg ORDER BY part, off")
def dlq_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dead_letter.in_topic_order(_flat(dead_messages(spark, sf_dir)))


@query("dlq_first_n", f"WITH {sql.DLQ} SELECT {_MESSAGE} FROM msg ORDER BY part, off LIMIT 10")
def dlq_first_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dead_letter.in_topic_order(_flat(dead_messages(spark, sf_dir))).limit(10)


@query("dlq_undecodable", f"WITH {sql.DLQ} SELECT part AS partition, off AS offset FROM dlq WHERE broken")
def dlq_undecodable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dead_letter.undecodable(dead_records(spark, sf_dir)).select("partition", "offset")


@query("dlq_errors", f"""WITH {sql.DLQ}
SELECT error_message AS "errorMessage", count(*) AS n, max(retry_count) AS max_retries FROM msg GROUP BY 1""")
def dlq_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dead_letter.errors(dead_messages(spark, sf_dir))


def _earlier_runs(listed: DataFrame) -> DataFrame:
    """The ledger of a run in the middle of the month."""
    return listed.where(F.col("timestamp") < F.lit(views.STORED_UNTIL).cast("timestamp")).select("event.eventId")


@query("dlq_reprocess", f"""WITH {sql.DLQ}
SELECT event_id AS "eventId", device_id AS "deviceId", CAST(measurement AS DOUBLE) AS measurement, date, ts AS "recordedAt"
FROM msg WHERE record_ts >= TIMESTAMP '2024-01-15 00:00:00'""")
def dlq_reprocess(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = dead_messages(spark, sf_dir)
    return dead_letter.reprocess(listed, _earlier_runs(listed))


@query("dlq_reprocess_latest", f"""WITH {sql.DLQ},
stream AS (SELECT device_id, measurement, date FROM acc WHERE route = 0
           UNION ALL SELECT device_id, measurement, date FROM msg) {_LATEST_OF}""")
def dlq_reprocess_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    main = events.envelope(_routed(spark, sf_dir, views.PUBLISHED), F.col("ts"))
    return _latest_with(main, dead_letter.reprocess(dead_messages(spark, sf_dir)))


@query("dlq_summary", f"""WITH {sql.DLQ}, n AS (SELECT count(*) AS reprocessed_count FROM msg)
SELECT reprocessed_count, 'Successfully reprocessed ' || CAST(reprocessed_count AS VARCHAR) || ' messages from DLQ' AS message
FROM n""")
def dlq_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dead_letter.reprocess_summary(dead_letter.reprocess(dead_messages(spark, sf_dir)))


@query("header_last", f"""WITH {sql.DLQ}
SELECT off AS offset, CASE WHEN k % 4 = 0 THEN NULL WHEN k % 10 = 9 THEN 'x' ELSE CAST(k % 4 AS VARCHAR) END AS last_count,
       retry_count, error_message, CAST(2 * (k % 4) AS BIGINT) AS header_count FROM dlq""")
def header_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    column = F.col("headers")
    return dead_records(spark, sf_dir).select(
        "offset", headers.last(column, headers.RETRY_COUNT).alias("last_count"),
        headers.retry_count(column).alias("retry_count"), headers.error_message(column).alias("error_message"),
        F.size("headers").alias("header_count"))


@query("retry_schedule", f"""WITH {sql.DLQ}, s AS (
  SELECT off, record_ts, n AS attempt, CAST(1000 * power(2, n - 1) AS BIGINT) AS delay_ms
  FROM (SELECT off, record_ts, unnest(range(1, retry_count + 1)) AS n FROM dlq))
SELECT off AS offset, CAST(attempt AS BIGINT) AS attempt, delay_ms,
       CAST(sum(delay_ms) OVER w AS BIGINT) AS elapsed_ms,
       record_ts + to_milliseconds(CAST(sum(delay_ms) OVER w AS BIGINT)) AS due_at
FROM s WINDOW w AS (PARTITION BY off ORDER BY attempt)""")
def retry_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = dead_records(spark, sf_dir)
    return dead_letter.retry_schedule(
        records, headers.retry_count(F.col("headers")), F.col("timestamp"), max_retries=None
    ).select("offset", "attempt", "delay_ms", "elapsed_ms", "due_at")


# What the three places hold after some faults: readings lost, kept twice, and kept though never accepted.
_KEPT = f"""{sql.ACC},
kept AS (
  SELECT event_id, route AS place FROM acc WHERE event_id % 53 <> 7
  UNION ALL SELECT event_id, CASE WHEN route = 1 THEN 2 ELSE 1 END FROM acc WHERE event_id % 59 = 11
  UNION ALL SELECT event_id, 0 FROM ranked WHERE rn > 1 AND event_id % 3 = 0),
judged AS (
  SELECT event_id, count(k.place) AS places, CASE WHEN max(a.event_id) IS NULL THEN 'unknown' WHEN count(k.place) = 0 THEN 'lost'
         WHEN count(k.place) > 1 THEN 'kept_twice' END AS fault
  FROM acc a FULL JOIN kept k USING (event_id) GROUP BY event_id)"""


def _kept(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """The accepted readings, and what is found of them in the three places."""
    every = accepted(spark, sf_dir)
    event, route = F.col("event_id"), F.col("route")
    second = F.when(route == views.FALLBACK, views.DEAD_LETTER).otherwise(views.FALLBACK)
    strangers = dedup.repeats(views.readings(spark, sf_dir)).where(event % 3 == 0).select(
        "event_id", F.lit(views.PUBLISHED).alias("place"))
    kept = (
        every.where(event % 53 != 7).select("event_id", route.alias("place"))
        .unionByName(every.where(event % 59 == 11).select("event_id", second.alias("place")))
        .unionByName(strangers)
    )
    return [every, *[kept.where(F.col("place") == place) for place in (views.PUBLISHED, views.FALLBACK, views.DEAD_LETTER)]]


@query("no_loss_reconcile", f"""WITH {_KEPT}
SELECT (SELECT count(*) FROM acc) AS accepted, (SELECT count(*) FROM kept WHERE place = 0) AS published,
       (SELECT count(*) FROM kept WHERE place = 1) AS fallback, (SELECT count(*) FROM kept WHERE place = 2) AS dead_letter,
       count(*) FILTER (WHERE fault = 'lost') AS lost, count(*) FILTER (WHERE fault = 'kept_twice') AS kept_twice,
       count(*) FILTER (WHERE fault = 'unknown') AS unknown FROM judged""")
def no_loss_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dead_letter.reconcile(*_kept(spark, sf_dir))


@query("no_loss_faults", f"WITH {_KEPT} SELECT event_id, fault, places FROM judged WHERE fault IS NOT NULL")
def no_loss_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dead_letter.faults(*_kept(spark, sf_dir))


@query("table_counts", f"""WITH {sql.FALLBACK},
dlq AS (SELECT * FROM acc WHERE route = 2)
SELECT 'telemetry' AS table_name, count(*) AS n FROM acc
UNION ALL SELECT 'devices', count(DISTINCT device_id) FROM acc
UNION ALL SELECT 'fallback_events', count(*) FROM fallback
UNION ALL SELECT 'dead_letters', count(*) FROM dlq""")
def table_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.table_counts({
        "telemetry": accepted(spark, sf_dir),
        "devices": projection.latest_accepted(views.readings(spark, sf_dir)),
        "fallback_events": fallback_rows(spark, sf_dir),
        "dead_letters": dead_records(spark, sf_dir),
    })
