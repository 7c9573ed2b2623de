"""Counters, timers and the failure rate of recent calls."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fluxgauge.functions import outcome
from fluxgauge.operators import blocks

# Metric names and the one constant tag.
RECEIVED = "telemetry.received.total"
DUPLICATES = "telemetry.duplicates.total"
OUT_OF_ORDER = "telemetry.out_of_order.total"
DLQ_SENT = "telemetry.dlq.sent.total"
DLQ_REPROCESSED = "telemetry.dlq.reprocessed.total"
PROCESSING_TIME = "telemetry.processing.time"
TAGS = {RECEIVED: {"type": "temperature"}}
REPEATED = "telemetry.events.repeated.total"   # our own: records of a batch that was published again

SKETCH_K = 1000        # size of a quantile sketch: at most a few thousand numbers per key and part
SKETCH_ERROR = 0.01    # asserted error of a rank, as a share of the count; at this size 0.28 % is met 99 times in 100


def received(classified: DataFrame) -> Column:
    """Counts rows that were decoded with all fields, before any other rule: future-dated
    and repeated rows count, rows with a missing field do not."""
    present = F.col("device_id").isNotNull() & F.col("measurement").isNotNull() & F.col("date").isNotNull()
    return F.count_if(present)


def counters(counted: DataFrame, names: dict[str, str]) -> DataFrame:
    """A one-row aggregate as metric rows; ``names`` maps metrics to its columns."""
    def tags(name: str) -> Column:
        pairs = [F.lit(x) for pair in TAGS.get(name, {}).items() for x in pair]
        return (F.create_map(*pairs) if pairs else F.expr("map()")).cast("map<string,string>")

    rows = F.array(*[
        F.struct(F.lit(name).alias("metric"), tags(name).alias("labels"), F.col(column).cast("bigint").alias("value"))
        for name, column in names.items()
    ])
    return counted.select(F.explode(rows).alias("_row")).select("_row.*")


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Row counts of named tables."""
    return reduce(DataFrame.unionByName, [
        df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n") for name, df in tables.items()
    ])


def quantile_name(q: float) -> str:
    return f"p{q * 100:g}".replace(".", "_")


def timer(df: DataFrame, by: list[str], value: str, quantiles: tuple[float, ...], bucket: float) -> DataFrame:
    """Count, total, maximum and exact interpolated quantiles of a timer.

    The built-in exact percentile keeps every distinct value of a group in one task. Here
    values are counted first (with map-side combine), then ranked block by block, and the
    two values around each quantile are picked by an aggregation. ``bucket`` is the width
    of a block of values; blocks only spread the work and do not change the result.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n"))
    slot = F.floor(F.col(value) / F.lit(bucket)).cast("bigint")
    ranked = blocks.running(counted, by, [F.col(value)], slot, {"_upto": ("sum", F.col("_n"))})
    totals = counted.groupBy(*by).agg(
        F.sum("_n").alias("count"),
        F.sum(F.col(value) * F.col("_n")).alias("total"),
        F.max(value).alias("max"),
    )
    placed = ranked.join(totals.select(*by, "count"), by)

    def at_rank(rank: Column) -> Column:
        return F.min(F.when(F.col("_upto") > rank, F.col(value)))

    ends = []
    for q in quantiles:
        position = F.lit(q) * (F.col("count") - 1)
        ends += [at_rank(F.floor(position)).alias(f"_low_{quantile_name(q)}"),
                 at_rank(F.ceil(position)).alias(f"_high_{quantile_name(q)}")]
    picked = placed.groupBy(*by).agg(*ends)
    joined = totals.join(picked, by)

    def interpolated(q: float) -> Column:
        low = F.col(f"_low_{quantile_name(q)}").cast("double")
        high = F.col(f"_high_{quantile_name(q)}").cast("double")
        position = F.lit(q) * (F.col("count") - 1)
        return low + (high - low) * (position - F.floor(position))

    return joined.select(*by, "count", "total", "max",
                         *[interpolated(q).alias(quantile_name(q)) for q in quantiles])


def timer_sketches(df: DataFrame, by: list[str], value: str, k: int = SKETCH_K) -> DataFrame:
    """Count, total, maximum and a quantile sketch per key, in one pass with map-side combine.

    Such rows are small and can be kept per batch, hour or day; ``timer_approx`` merges any of them. Nulls are left out.
    """
    number = F.col(value).cast("double")
    return df.where(F.col(value).isNotNull()).groupBy(*by).agg(
        F.count("*").alias("count"), F.sum(number).alias("total"), F.max(number).alias("max"),
        F.kll_sketch_agg_double(number, k).alias("sketch"))


def timer_approx(sketches: DataFrame, by: list[str], quantiles: tuple[float, ...], k: int = SKETCH_K) -> DataFrame:
    """The timer from kept sketches: quantiles are values of the data whose ranks are nearly right."""
    merged = sketches.groupBy(*by).agg(
        F.sum("count").alias("count"), F.sum("total").alias("total"), F.max("max").alias("max"),
        F.kll_merge_agg_double("sketch", k).alias("_sketch"))
    return merged.select(*by, "count", "total", "max", *[
        F.kll_sketch_get_quantile_double("_sketch", F.lit(float(q))).alias(quantile_name(q)) for q in quantiles])


def rank_errors(
    values: DataFrame, approx: DataFrame, by: list[str], value: str, quantiles: tuple[float, ...], error: float = SKETCH_ERROR
) -> DataFrame:
    """Per key and quantile: the count of all values, and whether the estimate's true rank is within ``error`` of it.

    Equal values share a range of ranks; the nearest one counts. Values are counted before they meet their key's one row
    of estimates, so a hot key sends one row per distinct value and task.
    """
    number = F.col(value).cast("double")
    counted = values.where(F.col(value).isNotNull()).groupBy(*by, number.alias("_value")).agg(F.count("*").alias("_n"))
    names = [quantile_name(q) for q in quantiles]
    ranks = counted.join(approx.select(*by, *names), by).groupBy(*by).agg(
        F.sum("_n").alias("count"),
        *[F.sum(F.when(F.col("_value") < F.col(n), F.col("_n")).otherwise(0)).alias(f"_below_{n}") for n in names],
        *[F.sum(F.when(F.col("_value") <= F.col(n), F.col("_n")).otherwise(0)).alias(f"_upto_{n}") for n in names])
    rows = [
        F.struct(F.lit(float(q)).alias("quantile"),
                 ((F.col(f"_below_{n}") <= F.lit(q + error) * F.col("count"))
                  & (F.col(f"_upto_{n}") >= F.lit(q - error) * F.col("count"))).alias("within_bound"))
        for q, n in zip(quantiles, names)
    ]
    return ranks.select(*by, "count", F.explode(F.array(*rows)).alias("_row")).select(*by, "count", "_row.*")


def failure_rate(
    calls: DataFrame, by: list[str], order: str, failed: str,
    window: int = outcome.WINDOW_CALLS, threshold: float = outcome.FAILURE_THRESHOLD_PCT,
    order_width: int = blocks.ARRIVALS_PER_BLOCK, block_rows: int = blocks.ARRIVALS_PER_BLOCK,
) -> DataFrame:
    """Failure percentage of the last ``window`` calls, from the call that fills the window.

    Calls are numbered block by block; equal blocks of call numbers, each with the tail of
    the one before, then evaluate the window without gathering a key in one task.
    """
    numbered = blocks.running(
        calls, by, [F.col(order)], blocks.block_of(F.col(order), order_width), {"call_no": ("sum", F.lit(1))})
    spread = blocks.with_lookback(numbered, F.col("call_no") - 1, block_rows, window - 1)
    last = Window.partitionBy(*by, "_block").orderBy("call_no").rowsBetween(1 - window, 0)
    rate = F.sum(F.col(failed).cast("int")).over(last) * F.lit(100.0 / window)
    return (
        spread.withColumn("failure_rate_pct", rate)
        .where(F.col("_own") & (F.col("call_no") >= window))
        .withColumn("over_threshold", F.col("failure_rate_pct") >= threshold)
        .drop("_own", "_block")
    )


def breaker_status(
    calls: DataFrame, by: list[str], order: str, failed: str, state: str, window: int = outcome.WINDOW_CALLS
) -> DataFrame:
    """Where each breaker stands: its last state, and the calls in its window. The failure
    rate is -1 until the window is full. Spark keeps only ``window`` calls per key and task."""
    newest = Window.partitionBy(*by).orderBy(F.desc(order))
    last = calls.withColumn("_back", F.row_number().over(newest)).where(F.col("_back") <= window)
    counted = last.groupBy(*by).agg(
        F.max_by(state, order).alias("state"), F.count("*").alias("buffered_calls"),
        F.count_if(F.col(failed)).alias("failed_calls"))
    rate = F.when(F.col("buffered_calls") < window, F.lit(-1.0)).otherwise(F.col("failed_calls") * F.lit(100.0 / window))
    return counted.withColumn("failure_rate_pct", rate)


def consumer_lag(offsets: DataFrame) -> DataFrame:
    """Records not yet consumed per topic: worst partition and sum."""
    lag = F.col("end_offset") - F.col("committed_offset")
    return offsets.groupBy("topic").agg(F.max(lag).alias("lag_max"), F.sum(lag).alias("lag_total"))


def lag_over_time(
    produced: DataFrame, consumed: DataFrame, by: list[str], ts: str, block_seconds: int = 86_400
) -> DataFrame:
    """Records produced and not yet consumed, at every moment either changes. Both sides are
    counted per moment first; the running difference then works block by block."""
    changes = produced.select(*by, ts, F.lit(1).alias("_change")).unionByName(
        consumed.select(*by, ts, F.lit(-1).alias("_change")))
    summed = changes.groupBy(*by, ts).agg(F.sum("_change").alias("_change"))
    us = F.unix_micros(ts)
    return blocks.running(
        summed, by, [us], blocks.block_of(us, block_seconds * 1_000_000), {"lag": ("sum", F.col("_change"))}).drop("_change")


def cumulative(added: DataFrame, by: list[str], ts: str, value: str, block_seconds: int = 86_400) -> DataFrame:
    """What each batch added to a counter, as counter samples that only grow."""
    us = F.unix_micros(ts)
    per_moment = added.groupBy(*by, ts).agg(F.sum(value).alias(value))
    grown = blocks.running(per_moment, by, [us], blocks.block_of(us, block_seconds * 1_000_000), {"_total": ("sum", F.col(value))})
    return grown.select(*by, ts, F.col("_total").cast("double").alias("value"))


def window_counts(df: DataFrame, by: list[str], ts: str, window: str) -> DataFrame:
    """Rows per fixed window."""
    counted = df.groupBy(*by, F.window(ts, window).alias("_w")).agg(F.count("*").alias("n"))
    return counted.select(*by, F.col("_w.start").alias("window_start"), "n")
