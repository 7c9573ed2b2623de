"""The latest reading per device and everything derived from it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxgauge.operators import dedup, projection
from fluxgauge.plans import sql
from fluxgauge.plans.registry import query
from fluxgauge.sources import views

# A sixteenth of a million arrivals per block: derived arrival numbers are spaced apart.
BLOCK = views.ARRIVAL_UNIT << 16


def accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.first_arrivals(views.readings(spark, sf_dir), "event_id")


def current(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projection.latest_accepted(views.readings(spark, sf_dir))


@query("latest_per_device", f"""WITH {sql.LATEST}
SELECT device_id, CAST(latest_measurement AS DOUBLE) AS latest_measurement, latest_date FROM latest""")
def latest_per_device(spark: SparkSession, sf_dir: str) -> DataFrame:
    return current(spark, sf_dir)


@query("latest_from_audit", f"""WITH {sql.LATEST}
SELECT device_id, CAST(latest_measurement AS DOUBLE) AS latest_measurement, latest_date FROM latest""")
def latest_from_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same fold over the de-duplicated readings, as a consumer of the topic does it."""
    return projection.latest(accepted(spark, sf_dir))


@query("devices_list", f"""WITH {sql.LATEST}
SELECT device_id AS "deviceId", CAST(latest_measurement AS DOUBLE) AS measurement, latest_date AS date FROM latest""")
def devices_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projection.device_response(current(spark, sf_dir))


@query("device_lookup", f"""WITH {sql.LATEST}
SELECT device_id, CAST(latest_measurement AS DOUBLE) AS latest_measurement, latest_date FROM latest WHERE device_id = 42""")
def device_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projection.device(current(spark, sf_dir), 42)


@query("devices_recent", f"""WITH {sql.LATEST}
SELECT device_id, CAST(latest_measurement AS DOUBLE) AS latest_measurement, latest_date FROM latest
ORDER BY latest_date DESC, device_id LIMIT 20""")
def devices_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projection.most_recent(current(spark, sf_dir), 20)


@query("device_recent_k", f"""WITH {sql.ACC}
SELECT device_id, date, CAST(measurement AS DOUBLE) AS measurement, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY date DESC, arrival_seq DESC) AS rank FROM acc) t
WHERE rank <= 3""")
def device_recent_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projection.recent_per_device(accepted(spark, sf_dir), 3).select("device_id", "date", "measurement", "rank")


_FLAGGED = f"""{sql.ACC},
o AS (
  SELECT *, max(date) OVER (PARTITION BY device_id ORDER BY arrival_seq
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm FROM acc)"""


@query("out_of_order_flag", f"""WITH {_FLAGGED}
SELECT event_id, device_id, date, coalesce(pm > date, false) AS out_of_order FROM o""")
def out_of_order_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projection.with_out_of_order(
        accepted(spark, sf_dir), block_width=BLOCK, arrivals=views.readings(spark, sf_dir)
    ).select(
        "event_id", "device_id", "date", "out_of_order")


_STORED = f"""{_FLAGGED},
stored AS (
  SELECT device_id, date AS latest_date, measurement AS latest_measurement FROM (
    SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY date DESC) AS newest
    FROM acc WHERE date < TIMESTAMP '2024-01-02 00:00:00') t WHERE newest = 1)"""


@query("out_of_order_vs_projection", f"""WITH {_STORED}
SELECT o.event_id, o.device_id, coalesce(greatest(o.pm, s.latest_date) > o.date, false) AS out_of_order
FROM o LEFT JOIN stored s ON s.device_id = o.device_id""")
def out_of_order_vs_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projection.with_out_of_order(
        accepted(spark, sf_dir), views.stored_projection(spark, sf_dir), BLOCK, views.readings(spark, sf_dir)
    ).select("event_id", "device_id", "out_of_order")


@query("event_vs_projection", f"""WITH {_STORED}
SELECT a.event_id, a.device_id, a.date, s.device_id IS NOT NULL AS known,
       coalesce(s.latest_date > a.date, false) AS stale
FROM acc a LEFT JOIN stored s ON s.device_id = a.device_id""")
def event_vs_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projection.against_projection(accepted(spark, sf_dir), views.stored_projection(spark, sf_dir)).select(
        "event_id", "device_id", "date", "known", "stale")


@query("projection_history", f"""WITH {sql.ACC}
SELECT a.event_id, a.device_id, a.arrival_seq,
       CAST(arg_max(a.measurement, a.date) OVER w AS DOUBLE) AS latest_measurement, max(a.date) OVER w AS latest_date
FROM acc a WINDOW w AS (PARTITION BY a.device_id ORDER BY a.arrival_seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def projection_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projection.history(accepted(spark, sf_dir), BLOCK).select(
        "event_id", "device_id", "arrival_seq", "latest_measurement", "latest_date")


@query("projection_merge", f"""WITH {_STORED},
every AS (
  SELECT device_id, latest_measurement, latest_date, -1 AS arrival_seq, TIMESTAMP '2024-02-01 00:00:00' AS updated_at FROM stored
  UNION ALL SELECT device_id, measurement, date, arrival_seq, TIMESTAMP '2024-02-02 00:00:00' FROM acc)
SELECT device_id, CAST(latest_measurement AS DOUBLE) AS latest_measurement, latest_date, updated_at FROM (
  SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY latest_date DESC, arrival_seq DESC) AS rn FROM every) t
WHERE rn = 1""")
def projection_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projection.merge(
        views.stored_projection(spark, sf_dir), accepted(spark, sf_dir), F.lit("2024-02-02 00:00:00").cast("timestamp"))
