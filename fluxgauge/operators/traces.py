"""Traces, spans and the log lines that carry their ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluxgauge.functions import ids
from fluxgauge.session import scratch

# Fixed value: level, then [application,trace id,span id], ids empty outside a trace.
LOG_PATTERN = r"^(\S+ \S+)\s+([A-Z]+)\s+\[([^,\]]*),([^,\]]*),([^,\]]*)\]\s*(.*)$"
# Joins the fields of one match, so that a line is matched once.
_SEPARATOR = "\u0001"


def parse_log(lines: DataFrame, line: str = "line") -> DataFrame:
    """Time, level, application, ids and message of each line; ids are null without a trace.
    All are null for a line of another form."""
    fields = F.regexp_replace(line, LOG_PATTERN, _SEPARATOR.join(f"${i}" for i in range(1, 7)))
    # Exploding an array of one keeps the optimizer from matching again in filters and fields.
    parsed = lines.withColumn("_part", F.explode(F.array(F.split(fields, _SEPARATOR, 6))))

    def part(i: int) -> Column:
        return F.when(F.size("_part") == 6, F.get("_part", i))

    return parsed.withColumns({
        "logged_at": part(0).try_cast("timestamp"),
        "level": part(1),
        "application": part(2),
        "trace_id": F.nullif(part(3), F.lit("")),
        "span_id": F.nullif(part(4), F.lit("")),
        "message": part(5),
    }).drop(line, "_part")


def parse_ids(df: DataFrame) -> DataFrame:
    """Numeric trace and span ids; null where malformed, the row stays."""
    return df.withColumns({
        "trace_id_lo": ids.trace_id_low(F.col("trace_id")),
        "span_id_value": ids.span_id_value(F.col("span_id")),
    })


def search(
    spans: DataFrame, service: str | None = None, name: str | None = None, trace_id: str | None = None,
    tags: dict[str, str] | None = None, since=None, until=None, min_ms: float | None = None, max_ms: float | None = None,
) -> DataFrame:
    """Spans matching all given conditions; plain comparisons, so they reach the scan."""
    conditions: list[Column] = []
    if service is not None:
        conditions.append(F.col("service") == service)
    if name is not None:
        conditions.append(F.col("name") == name)
    if trace_id is not None:
        conditions.append(F.col("trace_id") == trace_id)
    for key, value in (tags or {}).items():
        conditions.append(F.col("tags")[key] == value)
    if since is not None:
        conditions.append(F.col("start") >= since)
    if until is not None:
        conditions.append(F.col("start") < until)
    if min_ms is not None:
        conditions.append(F.col("duration_ms") >= min_ms)
    if max_ms is not None:
        conditions.append(F.col("duration_ms") <= max_ms)
    for condition in conditions:
        spans = spans.where(condition)
    return spans


def summary(spans: DataFrame) -> DataFrame:
    """One row per trace: spans, longest span, total time, start, number of services."""
    per_service = spans.groupBy("trace_id", "service").agg(
        F.count("*").alias("n"), F.max("duration_ms").alias("longest"), F.sum("duration_ms").alias("total"),
        F.min("start").alias("first"), F.count_if(F.col("tags")["error"] == "true").alias("errors"))
    return per_service.groupBy("trace_id").agg(
        F.sum("n").alias("span_count"), F.max("longest").alias("longest_ms"), F.sum("total").alias("total_ms"),
        F.min("first").alias("started_at"), F.count("*").alias("services"), F.sum("errors").alias("error_count"))


def services(spans: DataFrame) -> DataFrame:
    return spans.select("service").distinct()


def slowest(summaries: DataFrame, k: int) -> DataFrame:
    return summaries.orderBy(F.desc("total_ms"), "trace_id").limit(k)


def without_consumer(written: DataFrame, spans: DataFrame) -> DataFrame:
    """Written traces with no consumer span. The spans shrink to distinct trace ids first."""
    return written.join(spans.select("trace_id").distinct(), "trace_id", "left_anti")


def with_logs(logs: DataFrame, summaries: DataFrame) -> DataFrame:
    """Log lines beside the roll-up of their trace, one row per line."""
    return logs.where(F.col("trace_id").isNotNull()).join(summaries, "trace_id")


def self_time(spans: DataFrame) -> DataFrame:
    """Each span with its parent's name, its children's time and the time of its own.

    Children are summed before the join, so a span with millions of children is one row.
    """
    children = (
        spans.where(F.col("parent_id").isNotNull())
        .groupBy("trace_id", F.col("parent_id").alias("span_id"))
        .agg(F.sum("duration_ms").alias("children_ms"), F.count("*").alias("children"))
    )
    parents = spans.select("trace_id", F.col("span_id").alias("parent_id"), F.col("name").alias("parent_name"))
    return (
        spans.join(children, ["trace_id", "span_id"], "left")
        .join(parents, ["trace_id", "parent_id"], "left")
        .withColumns({
            "children": F.coalesce("children", F.lit(0)),
            "self_ms": F.col("duration_ms") - F.coalesce("children_ms", F.lit(0.0)),
            "orphan": F.col("parent_id").isNotNull() & F.col("parent_name").isNull(),
        })
        .drop("children_ms")
    )


def tree(spans: DataFrame) -> DataFrame:
    """Where each span hangs in its trace: ``depth`` below its root, ``root_id``, and
    ``path_ms``, the time of the span and all spans above it.

    A span without parent, or whose parent is missing, is a root. Each span points at its
    parent first; every round moves the pointer to where the span pointed at points, so depth
    d is reached in log2(d) rounds, and spans that have reached their root rest. Spans in or
    below a cycle never do: once a round brings no span to its root they have null. Span ids
    are unique within a trace; spans without trace or span id are left out.

    Each round is written to the shared folder, as the next one reads it twice. Only pointers
    are joined, and of the side that is looked up each span is there once, so a root with many
    spans below it is split like any skewed join.
    """
    spark, keys = spans.sparkSession, ["trace_id", "span_id"]
    named = spans.where(F.col("trace_id").isNotNull() & F.col("span_id").isNotNull())
    known = named.select("trace_id", F.col("span_id").alias("parent_id"), F.lit(True).alias("_known"))
    below = F.col("_known").isNotNull()
    state = named.select(*keys, "parent_id", F.col("duration_ms").alias("path_ms")).join(known, ["trace_id", "parent_id"], "left").select(
        *keys, F.when(below, F.col("parent_id")).otherwise(F.col("span_id")).alias("root_id"),
        F.when(below, 1).otherwise(0).cast("bigint").alias("depth"), "path_ms", below.alias("open"))
    base, schema = scratch(spark, "span-tree"), state.schema
    settled, waiting, rounds = None, None, 0
    while True:
        folder = f"{base}/{rounds}"
        state.write.partitionBy("open").parquet(folder)
        written = spark.read.schema(schema).parquet(folder)
        done, still = written.where(~F.col("open")), written.where("open")
        settled = done if settled is None else settled.unionByName(done)
        left = still.count()
        if left == 0 or left == waiting:
            break
        waiting, rounds = left, rounds + 1
        above = settled.unionByName(still).select(
            "trace_id", F.col("span_id").alias("root_id"), F.col("root_id").alias("_up"), F.col("depth").alias("_hops"),
            F.col("path_ms").alias("_ms"), F.col("open").alias("_open"))
        state = still.join(above, ["trace_id", "root_id"]).select(
            *keys, F.col("_up").alias("root_id"), (F.col("depth") + F.col("_hops")).alias("depth"),
            (F.col("path_ms") + F.col("_ms")).alias("path_ms"), F.col("_open").alias("open"))
    unplaced = still.select(*keys, *[F.lit(None).cast(schema[c].dataType).alias(c) for c in ("root_id", "depth", "path_ms")])
    return settled.drop("open").unionByName(unplaced)


def critical_paths(placed: DataFrame) -> DataFrame:
    """Per trace the path from a root that takes longest: its last span (of equals the one
    with the least id), its root, its time and its number of spans. Takes what ``tree`` returns."""
    longest = placed.where(F.col("depth").isNotNull()).groupBy("trace_id").agg(
        F.min(F.struct((-F.col("path_ms")).alias("ms"), "span_id", "root_id", "depth")).alias("_p"))
    return longest.select(
        "trace_id", F.col("_p.span_id").alias("leaf_id"), F.col("_p.root_id").alias("root_id"),
        (-F.col("_p.ms")).alias("critical_ms"), (F.col("_p.depth") + 1).alias("spans"))


def service_edges(spans: DataFrame) -> DataFrame:
    """Calls between services: from a span's parent to the span.

    Spans of one parent and service are counted before the join, so it sees each
    combination once.
    """
    calls = (
        spans.where(F.col("parent_id").isNotNull())
        .groupBy("trace_id", F.col("parent_id").alias("span_id"), F.col("service").alias("callee"))
        .agg(F.count("*").alias("n"))
    )
    callers = spans.select("trace_id", "span_id", F.col("service").alias("caller"))
    return calls.join(callers, ["trace_id", "span_id"]).groupBy("caller", "callee").agg(F.sum("n").alias("calls"))
