"""Log lines, spans and traces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxgauge.operators import traces
from fluxgauge.plans import sql
from fluxgauge.plans.registry import query
from fluxgauge.sources import views


@query("log_trace_parse", f"""WITH {sql.LOGS}
SELECT line_no, logged_at, level, 'telemetry-service' AS application, trace_id, span_id, message FROM parsed""")
def log_trace_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces.parse_log(views.log_lines(spark, sf_dir)).select(
        "line_no", "logged_at", "level", "application", "trace_id", "span_id", "message")


@query("log_trace_join", f"""WITH {sql.TRACES}, {sql.LOGS}
SELECT p.line_no, p.level, p.trace_id, t.span_count, t.total_ms, t.started_at
FROM parsed p JOIN traces t ON t.trace_id = p.trace_id""")
def log_trace_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = traces.parse_log(views.log_lines(spark, sf_dir))
    return traces.with_logs(logs, traces.summary(views.spans(spark, sf_dir))).select(
        "line_no", "level", "trace_id", "span_count", "total_ms", "started_at")


@query("span_search", f"""WITH {sql.SPANS}
SELECT trace_id, span_id, name, service, start, duration_ms FROM spans
WHERE service = 'service-R' AND name = 'step-2' AND error = 'true' AND start >= TIMESTAMP '1995-01-01'
  AND start < TIMESTAMP '2003-01-01' AND duration_ms BETWEEN 10 AND 40""")
def span_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces.search(
        views.spans(spark, sf_dir), service="service-R", name="step-2", tags={"error": "true"},
        since=F.lit("1995-01-01").cast("timestamp"), until=F.lit("2003-01-01").cast("timestamp"), min_ms=10, max_ms=40,
    ).select("trace_id", "span_id", "name", "service", "start", "duration_ms")


@query("span_parent_self_time", f"""WITH {sql.SPANS},
kids AS (SELECT trace_id, parent_id, sum(duration_ms) AS ms, count(*) AS n FROM spans WHERE parent_id IS NOT NULL GROUP BY 1, 2)
SELECT s.trace_id, s.span_id, s.parent_id, p.name AS parent_name, coalesce(k.n, 0) AS children,
       s.duration_ms - coalesce(k.ms, 0) AS self_ms, s.parent_id IS NOT NULL AND p.name IS NULL AS orphan
FROM spans s LEFT JOIN spans p ON p.trace_id = s.trace_id AND p.span_id = s.parent_id
LEFT JOIN kids k ON k.trace_id = s.trace_id AND k.parent_id = s.span_id""")
def span_parent_self_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces.self_time(views.spans(spark, sf_dir)).select(
        "trace_id", "span_id", "parent_id", "parent_name", "children", "self_ms", "orphan")


_TREE = f"""RECURSIVE {sql.SPANS},
placed AS (
  SELECT trace_id, span_id, span_id AS root_id, CAST(0 AS BIGINT) AS depth, duration_ms AS path_ms FROM spans s
  WHERE NOT EXISTS (SELECT 1 FROM spans p WHERE p.trace_id = s.trace_id AND p.span_id = s.parent_id)
  UNION ALL
  SELECT s.trace_id, s.span_id, p.root_id, p.depth + 1, p.path_ms + s.duration_ms
  FROM placed p JOIN spans s ON s.trace_id = p.trace_id AND s.parent_id = p.span_id)"""


@query("span_tree", f"WITH {_TREE} SELECT * FROM placed")
def span_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces.tree(views.spans(spark, sf_dir))


@query("trace_critical_path", f"""WITH {_TREE}
SELECT trace_id, span_id AS leaf_id, root_id, path_ms AS critical_ms, depth + 1 AS spans FROM (
  SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY path_ms DESC, span_id) AS rank FROM placed) t WHERE rank = 1""")
def trace_critical_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces.critical_paths(traces.tree(views.spans(spark, sf_dir)))


@query("trace_summary", f"WITH {sql.TRACES} SELECT * FROM traces")
def trace_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces.summary(views.spans(spark, sf_dir))


@query("trace_services", f"WITH {sql.SPANS} SELECT DISTINCT service FROM spans")
def trace_services(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces.services(views.spans(spark, sf_dir))


@query("trace_slowest_k", f"WITH {sql.TRACES} SELECT * FROM traces ORDER BY total_ms DESC, trace_id LIMIT 20")
def trace_slowest_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces.slowest(traces.summary(views.spans(spark, sf_dir)), 20)


@query("trace_missing_consumer", """
SELECT lpad(hex(o_orderkey), 32, '0') AS trace_id, o_orderdate AS start FROM orders o
WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey)""")
def trace_missing_consumer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces.without_consumer(views.write_spans(spark, sf_dir), views.spans(spark, sf_dir)).select("trace_id", "start")


@query("service_edges", f"""WITH {sql.SPANS}
SELECT p.service AS caller, s.service AS callee, count(*) AS calls
FROM spans s JOIN spans p ON p.trace_id = s.trace_id AND p.span_id = s.parent_id GROUP BY 1, 2""")
def service_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces.service_edges(views.spans(spark, sf_dir))
