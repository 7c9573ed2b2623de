"""Streams over the ``events`` table, in several batches with a restart before each; each must equal its batch counterpart."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxgauge import schemas
from fluxgauge.functions import headers, ids, outcome
from fluxgauge.operators import events, metrics
from fluxgauge.plans import sql
from fluxgauge.plans.observability import QUANTILES, SKETCHED
from fluxgauge.plans.registry import query
from fluxgauge.session import scratch
from fluxgauge.sources import readers, views
from fluxgauge.streaming import flows, live
from fluxgauge.streaming.tables import BatchTable

# Arrivals in a block of the read side, in offsets.
BLOCK = views.OFFSETS << 20

EVENTS = "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"


BATCHES = 5


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.schema(EVENTS).parquet(f"{sf_dir}/events.parquet")


def _share(every: DataFrame) -> Callable[[Column], Column]:
    """From an arrival number to the step at which it comes."""
    order = views.arrival_seq(F.col("event_id"))
    low, high = every.agg(F.min(order), F.max(order)).first()
    return lambda number: F.lit(0) if low is None else F.floor((number - low) / (high - low + 1) * BATCHES)


def _arriving(spark: SparkSession, sf_dir: str, folder: str, again: int = 0) -> Iterator[None]:
    """Put the events into a folder in order of arrival, a share at each step, with the ``again`` shares before it.

    Dealt anew, as a table in order of time has a share in few of its parts, and a stream reads a small file in one task."""
    every = _events(spark, sf_dir)
    share = _share(every)(views.arrival_seq(F.col("event_id")))
    for step in range(BATCHES):
        every.where(share.between(step - again, step)).repartition("event_id").write.mode("append").parquet(folder)
        yield


def _run(spark: SparkSession, sf_dir: str, root: str, shape: Callable[[DataFrame], DataFrame],
         process: Callable[[DataFrame, int], None], again: int = 0, watched: live.LiveMetrics | None = None,
         name: str | None = None) -> None:
    """Start the stream again after each arrival; its checkpoint goes on with the next batch."""
    for _ in _arriving(spark, sf_dir, f"{root}/input", again):
        stream = shape(readers.file_stream(spark, f"{root}/input", EVENTS))
        running = flows.start(stream, process, f"{root}/checkpoint", available_now=True, name=name)
        running.awaitTermination()
        if watched is not None:
            watched.settled(running.runId)


def _readings(arrived: DataFrame) -> DataFrame:
    wide = F.col("measurement").cast(schemas.WIRE_DECIMAL).alias("measurement")
    return views.shape_readings(arrived).select("device_id", wide, "date", "arrival_seq")


def _records(arrived: DataFrame) -> DataFrame:
    """Topic records of the readings in arrival order; error events carry a broken value."""
    rows = views.shape_readings(arrived)
    kept = ("arrival_seq", "route")
    records = events.topic_records(
        events.envelope(rows, F.col("ts"), keep=kept), F.col("recordedAt"), keep=kept)
    broken = F.concat(F.encode(F.lit("#"), "UTF-8"), F.col("value"))
    return records.select(
        "key", F.when(F.col("route") == views.FALLBACK, broken).otherwise(F.col("value")).alias("value"),
        "topic", "partition", views.offset(F.col("arrival_seq")).alias("offset"), "timestamp", "headers")


def _write_side(spark: SparkSession, sf_dir: str, name: str, publish=None) -> flows.WriteSide:
    root = scratch(spark, name)
    topic = BatchTable(f"{root}/topic", schemas.TOPIC_RECORD)
    side = flows.WriteSide(root, publish or topic.write, now=views.recorded_at)
    _run(spark, sf_dir, root, _readings, side.process)
    return side


def _read_side(spark: SparkSession, sf_dir: str, name: str) -> flows.ReadSide:
    root = scratch(spark, name)
    side = flows.ReadSide(root, now=views.recorded_at, block_width=BLOCK)
    _run(spark, sf_dir, root, _records, side.process)
    return side


@query("stream_dedup", f"""WITH {sql.ACC}
SELECT device_id, CAST(measurement AS DOUBLE) AS measurement, date, {sql.RECORDED_AT} AS recorded_at, arrival_seq FROM acc""")
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _write_side(spark, sf_dir, "stream-dedup").audit.read(spark)


@query("stream_fallback", f"""WITH {sql.ACC}
SELECT {sql.event_id()} AS event_id, device_id, CAST(measurement AS DOUBLE) AS measurement, date,
       {sql.RECORDED_AT} AS failed_at FROM acc""")
def stream_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Publishing always fails here, so every event must be in the fallback table."""
    def unavailable(records: DataFrame, batch_id: int) -> None:
        raise ConnectionError("topic is not reachable")

    return _write_side(spark, sf_dir, "stream-fallback", unavailable).fallback.read(spark)


_STREAM = f"""{sql.RAW},
good AS (SELECT * FROM raw WHERE route <> 1)"""


@query("stream_latest", f"""WITH {_STREAM}
SELECT device_id, CAST(measurement AS DOUBLE) AS latest_measurement, date AS latest_date, {sql.RECORDED_AT} AS updated_at FROM (
  SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY date DESC, arrival_seq DESC) AS newest FROM good) t
WHERE newest = 1""")
def stream_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = _read_side(spark, sf_dir, "stream-latest")
    return side.projection.current(spark)


@query("stream_out_of_order", f"""WITH {_STREAM}
SELECT device_id, date, CAST(measurement AS DOUBLE) AS measurement, arrival_seq,
       coalesce(max(date) OVER (PARTITION BY device_id ORDER BY arrival_seq
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > date, false) AS out_of_order FROM good""")
def stream_out_of_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = _read_side(spark, sf_dir, "stream-order").flags.read(spark)
    return flags.withColumn("arrival_seq", views.arrival_at(ids.arrival_offset(F.col("arrival_seq"))))


@query("stream_dlq_split", f"""WITH {sql.RAW}
SELECT CAST(device_id AS VARCHAR) AS key, 'telemetry.recorded.dlq' AS topic, {sql.topic_partition()} AS partition,
       arrival_seq AS offset, CAST(6 AS BIGINT) AS header_count FROM raw WHERE route = 1""")
def stream_dlq_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    dead = _read_side(spark, sf_dir, "stream-dead").dead_letters.read(spark)
    return dead.select(F.col("key").cast("string").alias("key"), "topic", "partition", views.arrival_at(F.col("offset")).alias("offset"),
                       F.size("headers").alias("header_count"))


@query("stream_counters", f"""WITH {_STREAM}
SELECT 'telemetry.out_of_order.total' AS metric, count(*) FILTER (WHERE pm > date) AS value FROM (
  SELECT date, max(date) OVER (PARTITION BY device_id ORDER BY arrival_seq
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm FROM good) t
UNION ALL SELECT 'telemetry.dlq.sent.total', count(*) FROM raw WHERE route = 1
UNION ALL SELECT 'telemetry.events.repeated.total', 0
UNION ALL SELECT 'telemetry.received.total', count(*) FROM raw
UNION ALL SELECT 'telemetry.duplicates.total', count(*) - count(DISTINCT (device_id, date)) FROM raw""")
def stream_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    added = _write_side(spark, sf_dir, "stream-received").counters.read(spark).unionByName(
        _read_side(spark, sf_dir, "stream-counted").counters.read(spark))
    return added.groupBy("metric").agg(F.sum("value").alias("value"))


@query("stream_rate_1m", """
SELECT event_type, date_trunc('minute', ts) AS window_start, count(*) AS n, count(*) / 60.0::DOUBLE AS per_second
FROM events GROUP BY 1, 2""")
def stream_rate_1m(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every batch adds its counts, so no row is too late and no state is kept."""
    root = scratch(spark, "stream-rate")
    table = BatchTable(f"{root}/windows", "event_type STRING, window_start TIMESTAMP, n BIGINT")

    def count(batch: DataFrame, batch_id: int) -> None:
        table.write(metrics.window_counts(batch, ["event_type"], "ts", "1 minute"), batch_id)

    _run(spark, sf_dir, root, lambda arrived: arrived.withColumn("ts", F.col("ts").cast("timestamp")), count)
    return table.read_sum(spark, ["event_type", "window_start"], "n").withColumn("per_second", F.col("n") / F.lit(60.0))


_SHARES = f"""shares AS (
  SELECT *, floor((arrival_seq - min(arrival_seq) OVER ()) / (max(arrival_seq) OVER () - min(arrival_seq) OVER () + 1) * {BATCHES}) AS step
  FROM raw)"""


@query("stream_republished", f"""WITH {sql.RAW}, {_SHARES},
once AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY step, device_id, date ORDER BY arrival_seq) AS nth
                 FROM shares WHERE route <> 1) t WHERE nth = 1)
SELECT 'telemetry.out_of_order.total' AS metric, count(*) FILTER (WHERE pm > date) AS value FROM (
  SELECT date, max(date) OVER (PARTITION BY device_id ORDER BY arrival_seq
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm FROM once) t
UNION ALL SELECT 'telemetry.dlq.sent.total', count(*) FROM raw WHERE route = 1
UNION ALL SELECT 'telemetry.events.repeated.total', CAST(sum(2 * least(3, {BATCHES} - step)) AS BIGINT)
  - (SELECT count(*) FROM raw WHERE route = 1) - (SELECT count(*) FROM once) FROM shares""")
def stream_republished(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record is published twice, and both again with each of the next two batches; no other counter may change.
    An event id counts once in a batch, so a pair repeated inside one is a repeat as well."""
    root = scratch(spark, "stream-republished")
    side = flows.ReadSide(root, now=views.recorded_at, block_width=BLOCK)
    share = _share(_events(spark, sf_dir))

    def published(arrived: DataFrame) -> DataFrame:
        sent = headers.header(headers.PRODUCER_BATCH, F.concat(F.lit("devices:"), share(views.arrival_at(F.col("offset"))).cast("string")))
        return _records(arrived).withColumn("headers", headers.append(F.col("headers"), sent)).withColumn(
            "offset", F.explode(F.array(F.col("offset") * 2, F.col("offset") * 2 + 1)))

    _run(spark, sf_dir, root, published, side.process, again=2)
    return side.counters.read(spark).groupBy("metric").agg(F.sum("value").alias("value"))


@query("stream_live_metrics", f"""WITH {sql.RAW}, {_SHARES},
n AS (SELECT CAST(count(DISTINCT step) AS BIGINT) AS samples, count(*) AS received FROM shares)
SELECT 'telemetry.received.total' AS metric, samples, CAST(received AS DOUBLE) AS total, true AS grows FROM n
UNION ALL SELECT 'stream.rows.read', samples, NULL, true FROM n
UNION ALL SELECT 'telemetry.duplicates.total', samples,
  CAST((SELECT count(*) - count(DISTINCT (device_id, date)) FROM raw) AS DOUBLE), true FROM n
UNION ALL SELECT 'stream.batch.ms', samples, NULL, true FROM n""")
def stream_live_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of a running stream as samples with time, made cumulative like any other counter, and its progress.

    ``grows``: no sample is below the one before; of progress, every batch read rows and took time.
    """
    root = scratch(spark, "stream-live")
    topic = BatchTable(f"{root}/topic", schemas.TOPIC_RECORD)
    side = flows.WriteSide(root, topic.write)
    watched = live.LiveMetrics(spark, f"{root}/live", ["readings"])
    spark.streams.addListener(watched)
    try:
        _run(spark, sf_dir, root, _readings, side.process, watched=watched, name="readings")
    finally:
        spark.streams.removeListener(watched)
    progress = watched.tables["readings"].read(spark)
    added = side.counters.read(spark)
    grown = metrics.cumulative(added, ["metric"], "ts", "value").groupBy("metric").agg(
        F.count("*").alias("samples"), F.max("value").alias("total"))
    falls = added.groupBy("metric").agg((F.min("value") >= 0).alias("grows"))
    batches = progress.where(F.col("metric").isin(live.ROWS, live.BATCH_TIME)).groupBy("metric").agg(
        F.count("*").alias("samples"), F.lit(None).cast("double").alias("total"), (F.min("value") > 0).alias("grows"))
    return grown.join(falls, "metric").select("metric", "samples", "total", "grows").unionByName(batches)


@query("stream_timer", SKETCHED)
def stream_timer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each batch keeps its sketches of processing times; reading merges them."""
    root = scratch(spark, "stream-timer")
    table = BatchTable(f"{root}/sketches", "state STRING, count BIGINT, total DOUBLE, max DOUBLE, sketch BINARY")

    def timed(rows: DataFrame) -> DataFrame:
        return views.shape_outcomes(rows).select(outcome.breaker_state(F.col("state")).alias("state"), "elapsed_ms")

    def keep(batch: DataFrame, batch_id: int) -> None:
        table.write(metrics.timer_sketches(batch, ["state"], "elapsed_ms"), batch_id)

    _run(spark, sf_dir, root, timed, keep)
    approx = metrics.timer_approx(table.read(spark), ["state"], QUANTILES)
    return metrics.rank_errors(timed(_events(spark, sf_dir)), approx, ["state"], "elapsed_ms", QUANTILES)
