"""Replay and reprocessing of stored tables, run several times over."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxgauge import schemas
from fluxgauge.plans import sql
from fluxgauge.plans.recovery import dead_records, fallback_rows
from fluxgauge.plans.registry import query
from fluxgauge.session import scratch
from fluxgauge.streaming.deletes import DeletableTable
from fluxgauge.streaming.jobs import ReplayJob, ReprocessJob
from fluxgauge.streaming.tables import BatchTable

BATCHES = 4
REFUSED = 5      # the first run's sink refuses events measured below this


class Topic:
    """A sink that keeps one folder per run, and refuses small measurements while it is ``strict``."""

    def __init__(self, root: str) -> None:
        self.table = BatchTable(f"{root}/topic", f"{schemas.TOPIC_RECORD.replace('offset BIGINT, ', '')}, eventId STRING")
        self.strict = True

    def publish(self, records: DataFrame, run: int) -> DataFrame | None:
        measured = F.get_json_object(F.col("value").cast("string"), "$.measurement").cast("double")
        taken = records.where(measured >= REFUSED) if self.strict else records
        self.table.write(taken.withColumn("partition", F.col("partition").cast("int")), run)
        return records.where(measured < REFUSED).select("eventId") if self.strict else None


def stored_fallback(spark: SparkSession, sf_dir: str, root: str) -> DeletableTable:
    """The fallback rows in a few batch folders, as a stream would have left them."""
    table = DeletableTable(f"{root}/fallback", schemas.FALLBACK, "event_id")
    rows = fallback_rows(spark, sf_dir).withColumn("part", F.pmod("device_id", F.lit(BATCHES)))
    for batch in range(BATCHES):
        table.write(rows.where(F.col("part") == batch).drop("part"), batch)
    return table


def _replayed(spark: SparkSession, sf_dir: str, runs: int) -> tuple[ReplayJob, Topic, list]:
    """Runs: a strict sink, an unhealthy one, then one that takes everything, twice."""
    root = scratch(spark, "replay")
    topic, gate = Topic(root), {"healthy": True}
    job = ReplayJob(root, topic.publish, stored_fallback(spark, sf_dir, root), lambda: gate["healthy"])
    results = []
    for step in range(runs):
        topic.strict, gate["healthy"] = step == 0, step != 1
        result = job.run(spark)
        results.append((step, result.succeeded, result.failed, job.table.read(spark).count(), result.message))
    return job, topic, results


@query("replay_job", f"""WITH {sql.FALLBACK}, n AS (
  SELECT count(*) FILTER (WHERE measurement >= {REFUSED}) AS good, count(*) FILTER (WHERE measurement < {REFUSED}) AS bad FROM fallback),
r AS (
  SELECT 0 AS step, good AS replayed, bad AS failed, bad AS remaining FROM n
  UNION ALL SELECT 1, 0, 0, bad FROM n
  UNION ALL SELECT 2, bad, 0, 0 FROM n
  UNION ALL SELECT 3, 0, 0, 0 FROM n)
SELECT CAST(step AS BIGINT) AS step, CAST(replayed AS BIGINT) AS replayed, CAST(failed AS BIGINT) AS failed,
       CAST(remaining AS BIGINT) AS remaining,
       CASE WHEN replayed = 0 THEN 'No fallback events to replay'
            ELSE 'Successfully replayed ' || CAST(replayed AS VARCHAR) || ' events' END AS message FROM r""")
def replay_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four runs over the stored table: some events refused, an unhealthy sink, the rest, and nothing left."""
    return spark.createDataFrame(_replayed(spark, sf_dir, 4)[2], "step BIGINT, replayed BIGINT, failed BIGINT, remaining BIGINT, message STRING")


@query("replay_table", f"""WITH {sql.FALLBACK}
SELECT event_id, device_id, CAST(measurement AS DOUBLE) AS measurement, date, failed_at FROM fallback WHERE measurement < {REFUSED}""")
def replay_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored rows after a run and the rewrite of the folders that lost rows."""
    job = _replayed(spark, sf_dir, 1)[0]
    job.table.rewrite(spark)
    return job.table.read(spark).drop("batch_id")


@query("replay_topic", f"""WITH {sql.FALLBACK}
SELECT event_id, CAST(device_id AS VARCHAR) AS key, CAST(CASE WHEN measurement < {REFUSED} THEN 1 ELSE 0 END AS BIGINT) AS run FROM fallback""")
def replay_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event is on the topic once, by the run that published it."""
    topic = _replayed(spark, sf_dir, 3)[1]
    return topic.table.read(spark, numbered="run").select(F.col("eventId").alias("event_id"), F.col("key").cast("string").alias("key"), "run")


@query("reprocess_job", f"""WITH {sql.DLQ}, n AS (
  SELECT count(*) FILTER (WHERE measurement >= {REFUSED}) AS good, count(*) FILTER (WHERE measurement < {REFUSED}) AS bad FROM msg),
r AS (
  SELECT 0 AS step, good AS done, bad AS failed, good AS ledger FROM n
  UNION ALL SELECT 1, bad, 0, good + bad FROM n
  UNION ALL SELECT 2, 0, 0, good + bad FROM n)
SELECT CAST(step AS BIGINT) AS step, CAST(done AS BIGINT) AS reprocessed, CAST(failed AS BIGINT) AS failed, CAST(ledger AS BIGINT) AS ledger,
       CASE WHEN done = 0 THEN 'No messages to reprocess in DLQ'
            ELSE 'Successfully reprocessed ' || CAST(done AS VARCHAR) || ' messages from DLQ' END AS message FROM r""")
def reprocess_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three runs over stored dead letters: some refused, the rest, and nothing left; the ledger holds what was published."""
    root = scratch(spark, "reprocess")
    letters = BatchTable(f"{root}/dead-letters", schemas.TOPIC_RECORD)
    letters.write(dead_records(spark, sf_dir).select(
        "key", "value", "topic", F.col("partition").cast("int").alias("partition"), "offset", "timestamp", "headers"), 0)
    topic = Topic(root)
    job = ReprocessJob(root, topic.publish, letters.read)
    results = []
    for step in range(3):
        topic.strict = step == 0
        result = job.run(spark)
        results.append((step, result.succeeded, result.failed, job.ledger(spark).count(), result.message))
    return spark.createDataFrame(results, "step BIGINT, reprocessed BIGINT, failed BIGINT, ledger BIGINT, message STRING")
