"""Time series of metric samples: rates, ratios, quantiles from buckets, step lookups."""

from __future__ import annotations

from math import gcd

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fluxgauge.operators import blocks

# How far back a lookup may reach, in seconds.
STALENESS = 300

# Samples per block of a trailing rate: what one task sorts at a time, whatever a series sends.
ROWS_PER_BLOCK = 1 << 20

# Seconds per cell of a stepped rate. Timestamps have microseconds, so a cell of one series
# holds at most a million samples with distinct times.
CELL_SECONDS = 1


def select(samples: DataFrame, metric: str, by: list[str], **matching: str) -> DataFrame:
    """Samples of one metric whose labels match, with the labels in ``by`` as columns."""
    chosen = samples.where(F.col("metric") == metric)
    for name, value in matching.items():
        chosen = chosen.where(F.col("labels")[name] == value)
    return chosen.select(*[F.col("labels")[name].alias(name) for name in by], "ts", "value")


def _bucket(ts: Column, seconds: int) -> Column:
    return F.timestamp_seconds(blocks.block_of(F.unix_seconds(ts), seconds) * seconds)


def tumbling_rate(events: DataFrame, by: list[str], ts: str, seconds: int) -> DataFrame:
    """Events per second in fixed windows."""
    return (
        events.groupBy(*by, _bucket(F.col(ts), seconds).alias("window_start"))
        .agg(F.count("*").alias("n"))
        .withColumn("per_second", F.col("n") / F.lit(float(seconds)))
    )


def _extrapolated(increase: Column, seconds: int, covered: Column, to_start: Column, to_end: Column,
                  samples: Column, first_value: Column) -> Column:
    """Extend an increase measured between the first and last sample to the whole window:
    to a window edge closer than 1.1 average sample distances, else by half a distance,
    and never back beyond the point where the counter would have been zero."""
    step = covered / (samples - 1)
    start_gap = F.when(to_start >= step * 1.1, step / 2).otherwise(to_start)
    end_gap = F.when(to_end >= step * 1.1, step / 2).otherwise(to_end)
    to_zero = F.when(increase > 0, covered * (first_value / increase))
    return increase * ((covered + F.least(start_gap, to_zero) + end_gap) / covered)


def _counter_delta(value: str, before: Column) -> Column:
    """Growth since the value before; a smaller value means the counter restarted at zero."""
    return F.when(F.col(value) < before, F.col(value)).otherwise(F.col(value) - before)


def _counter_totals(points: DataFrame, cut: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each sample with its number in its series and what its counter would show had it never
    restarted; and for each block the first sample behind it (``_next``).

    Blocks are summed up as (first, last, lost at restarts, count), and a scan over these few
    rows tells each block what precedes and what follows it.
    """
    within = Window.partitionBy("_series", "_cut").orderBy("_us")
    before = F.lag("value").over(within)
    placed = blocks.in_cuts(points, ["_series"], "_us", cut).withColumns({
        "_lost": F.when(F.col("value") < before, before).otherwise(F.lit(0.0)), "_no": F.row_number().over(within)})
    local = placed.withColumn("_lost", F.sum("_lost").over(within.rowsBetween(Window.unboundedPreceding, 0)))
    ends = local.groupBy("_series", "_cut").agg(
        F.count("*").alias("_rows"), F.max_by("_lost", "_no").alias("_inside"), F.min("_us").alias("_us"),
        F.min_by("value", "_no").alias("_first"), F.max_by("value", "_no").alias("_last"))
    # Blocks without samples have questions only.
    ends = cut.select("_series", "_cut").distinct().join(ends, ["_series", "_cut"], "left")
    along = Window.partitionBy("_series").orderBy("_cut")
    earlier, so_far = along.rowsBetween(Window.unboundedPreceding, -1), along.rowsBetween(Window.unboundedPreceding, 0)
    later = along.rowsBetween(1, Window.unboundedFollowing)
    last = F.last("_last", ignorenulls=True).over(earlier)
    scanned = ends.withColumns({
        "_across": F.when(F.col("_first") < last, last).otherwise(F.lit(0.0)),
        "_rows_before": F.coalesce(F.sum("_rows").over(earlier), F.lit(0)),
        "_inside_before": F.coalesce(F.sum("_inside").over(earlier), F.lit(0.0)),
    }).withColumn("_lost_before", F.col("_inside_before") + F.sum("_across").over(so_far))
    head = F.when(F.col("_us").isNotNull(), F.struct(
        "_us", F.col("_first").alias("value"), (F.col("_rows_before") + 1).alias("_no"),
        (F.col("_first") + F.col("_lost_before")).alias("_total")))
    scanned = scanned.withColumn("_head", head).select(
        "_series", "_cut", "_rows_before", "_lost_before", F.first("_head", ignorenulls=True).over(later).alias("_next"))
    totals = local.join(scanned.drop("_next"), ["_series", "_cut"]).select(
        "_series", "ts", "value", "_us", (F.col("_no") + F.col("_rows_before")).alias("_no"),
        (F.col("value") + F.col("_lost") + F.col("_lost_before")).alias("_total"))
    return totals, scanned.select("_series", "_cut", "_next")


def counter_rate(
    samples: DataFrame, by: list[str], seconds: int, extrapolate: bool = False, block_rows: int = ROWS_PER_BLOCK
) -> DataFrame:
    """Increase and per-second rate of a counter over the window ending at each sample.

    The window excludes its start. Fewer than two samples in it give no rate. Samples of a
    series have distinct times; missing labels (null) are a label value like any other.

    An increase is the difference of two running totals, that of the sample and that of the
    first sample in its window. Each sample asks for the latter at its window's start; samples
    and questions are put in order in blocks cut by their number, and a question that its
    block leaves open takes the next block's first sample. So no task sorts more than a
    block, however many samples one series or one window has.
    """
    span = seconds * 1_000_000
    points = samples.where(F.col("ts").isNotNull() & F.col("value").isNotNull()).select(
        F.struct(F.lit(0).alias("_all"), *by).alias("_series"), "ts", "value", F.unix_micros("ts").alias("_us"))
    start = F.col("_us") - F.lit(span - 1)
    moments = points.select("_series", F.explode(F.array("_us", start)).alias("_at"))
    cut = blocks.cuts(moments, ["_series"], "_at", block_rows)
    kinds = F.explode(F.array(F.struct(F.col("_us").alias("_at"), F.lit(1).alias("_is_sample")),
                              F.struct(start.alias("_at"), F.lit(0).alias("_is_sample"))))
    totals, heads = _counter_totals(points, cut)
    asked = totals.withColumn("_kind", kinds).select("*", "_kind.*").drop("_kind")
    placed = blocks.in_cuts(asked, ["_series"], "_at", cut)
    sample = F.when(F.col("_is_sample") == 1, F.struct("_us", "value", "_no", "_total"))
    backwards = Window.partitionBy("_series", "_cut").orderBy(F.desc("_at"), F.desc("_is_sample")) \
        .rowsBetween(Window.unboundedPreceding, 0)
    found = placed.withColumn("_here", F.last(sample, ignorenulls=True).over(backwards)).where("_is_sample = 0")
    measured = found.join(heads, ["_series", "_cut"]).withColumn("_first", F.coalesce("_here", "_next")).select(
        *[F.col("_series")[name].alias(name) for name in by], "ts", "value", "_us",
        (F.col("_total") - F.col("_first._total")).alias("increase"),
        (F.col("_no") - F.col("_first._no") + 1).alias("_samples"),
        F.col("_first._us").alias("_first_us"), F.col("_first.value").alias("_first_value"),
    ).where(F.col("_samples") >= 2)
    if extrapolate:
        covered = (F.col("_us") - F.col("_first_us")) / F.lit(1e6)
        measured = measured.withColumn("increase", _extrapolated(
            F.col("increase"), seconds, covered, F.lit(float(seconds)) - covered, F.lit(0.0),
            F.col("_samples"), F.col("_first_value")))
    return measured.select(*by, "ts", "value", "increase", (F.col("increase") / F.lit(float(seconds))).alias("per_second"))


def _merged(parts: DataFrame, group: list[str], along: str) -> DataFrame:
    """Successive pieces of a counter as one piece: what grew inside them and between them."""
    in_order = Window.partitionBy(*group).orderBy(along)
    across = F.coalesce(_counter_delta("_first_value", F.lag("_last_value").over(in_order)), F.lit(0.0))
    return parts.withColumn("_across", across).groupBy(*group).agg(
        (F.sum("_inside") + F.sum("_across")).alias("_inside"), F.sum("_samples").alias("_samples"),
        F.min("_first_us").alias("_first_us"), F.max("_last_us").alias("_last_us"),
        F.min_by("_first_value", along).alias("_first_value"), F.max_by("_last_value", along).alias("_last_value"))


def counter_rate_at_steps(
    samples: DataFrame, by: list[str], step: int, seconds: int, extrapolate: bool = False
) -> DataFrame:
    """The same at every multiple of ``step`` seconds, over the ``seconds`` before it.

    Samples are sorted once, within their cell of a second, and become one row per series and
    cell. Cells become buckets, which windows that overlap share, and buckets windows; each is
    a row of first, last, count and increase. A bucket has at most ``width`` cells and a window
    at most ``seconds / width`` buckets, however many samples a series has.
    """
    width = gcd(step, seconds)
    width_us, step_us, span = width * 1_000_000, step * 1_000_000, seconds * 1_000_000

    # Cells and buckets end at multiples of their width and exclude their start, as windows do.
    us = F.unix_micros("ts")
    cell = -blocks.block_of(-us, CELL_SECONDS * 1_000_000)
    in_cell = Window.partitionBy(*by, "_cell").orderBy("_us")
    cells = (
        samples.withColumns({"_us": us, "_cell": cell})
        .withColumn("_delta", _counter_delta("value", F.lag("value").over(in_cell)))
        .groupBy(*by, "_cell")
        .agg(F.coalesce(F.sum("_delta"), F.lit(0.0)).alias("_inside"), F.count("*").alias("_samples"),
             F.min("_us").alias("_first_us"), F.max("_us").alias("_last_us"),
             F.min_by("value", "_us").alias("_first_value"), F.max_by("value", "_us").alias("_last_value"))
    )
    bucket = -blocks.block_of(-F.col("_cell"), width // CELL_SECONDS)
    buckets = _merged(cells.withColumn("_bucket", bucket), [*by, "_bucket"], "_cell")
    end_us = F.col("_bucket") * width_us
    first_step, last_step = -blocks.block_of(-end_us, step_us), blocks.block_of(end_us + (span - width_us), step_us)
    spread = buckets.withColumn("_step", F.explode(F.when(first_step <= last_step, F.sequence(first_step, last_step))))
    measured = _merged(spread, [*by, "_step"], "_bucket").withColumnRenamed("_inside", "increase").where(F.col("_samples") >= 2)
    if extrapolate:
        at_us = F.col("_step") * step_us
        covered = (F.col("_last_us") - F.col("_first_us")) / F.lit(1e6)
        measured = measured.withColumn("increase", _extrapolated(
            F.col("increase"), seconds, covered,
            (F.col("_first_us") - (at_us - span)) / F.lit(1e6), (at_us - F.col("_last_us")) / F.lit(1e6),
            F.col("_samples"), F.col("_first_value")))
    return measured.select(
        *by, F.timestamp_micros(F.col("_step") * step_us).alias("step"), "increase",
        (F.col("increase") / F.lit(float(seconds))).alias("per_second"))


def instant(samples: DataFrame, by: list[str], at: Column, staleness: int = STALENESS) -> DataFrame:
    """The newest value of each series at one moment; series silent for longer than
    ``staleness`` seconds have none. The time filter reaches the scan."""
    since = at - F.make_dt_interval(secs=F.lit(staleness))
    return (
        samples.where((F.col("ts") <= at) & (F.col("ts") > since))
        .groupBy(*by)
        .agg(F.max_by("value", "ts").alias("value"), F.max("ts").alias("ts"))
    )


def at_steps(samples: DataFrame, by: list[str], start: Column, end: Column, step: int, staleness: int = STALENESS) -> DataFrame:
    """The newest value of each series at every step from ``start`` to ``end``.

    Samples first collapse to the newest one before each step, an aggregation that
    combines before the shuffle. Of a series' survivors each covers the steps within
    ``staleness``, up to the next one's first: no step is covered twice, so what is shuffled
    does not grow with the steps a sample covers. A series has one row per step at most in
    the window, however many samples it has.
    """
    step_us, stale_us = step * 1_000_000, staleness * 1_000_000
    start_us, end_us = F.unix_micros(start), F.unix_micros(end)
    us = F.unix_micros("ts")
    # The first step at or after the sample: a ceiling, written as a negated floor.
    first_step = F.greatest(F.lit(0).cast("bigint"), -blocks.block_of(start_us - us, step_us))
    near = samples.where((us <= end_us) & (us > start_us - stale_us)).withColumn("_step", first_step)
    newest = near.groupBy(*by, "_step").agg(F.max_by("value", "ts").alias("value"), F.max("ts").alias("ts"))
    last_step = F.least(
        blocks.block_of(end_us - start_us, step_us),
        blocks.block_of(F.unix_micros("ts") + stale_us - 1 - start_us, step_us),
    )
    following = F.lead("_step").over(Window.partitionBy(*by).orderBy("_step"))
    covering = (
        newest.withColumn("_last", last_step).where(F.col("_step") <= F.col("_last"))
        .withColumn("_last", F.least(F.col("_last"), following - 1))
        .withColumn("_step", F.explode(F.sequence("_step", "_last")))
    )
    return covering.select(
        *by, "value", F.col("ts").alias("sample_ts"), F.timestamp_micros(start_us + F.col("_step") * step_us).alias("step"))


def aggregates(values: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """sum, avg, max, min and count over series, per remaining label."""
    return values.groupBy(*by).agg(
        F.sum(value).alias("sum"), F.avg(value).alias("avg"), F.max(value).alias("max"),
        F.min(value).alias("min"), F.count("*").alias("count"))


def ratio(left: DataFrame, right: DataFrame, on: list[str], percent: bool = False) -> DataFrame:
    """Divide two vectors with equal labels and times; null where the divisor is zero.
    Each side holds one row per label set and time."""
    paired = left.select(*on, F.col("value").alias("_left")).join(right.select(*on, F.col("value").alias("_right")), on)
    quotient = F.col("_left") / F.nullif(F.col("_right"), F.lit(0))
    return paired.select(*on, (quotient * 100 if percent else quotient).alias("ratio"))


def rate_vector(samples: DataFrame, metric: str, step: int, seconds: int, extrapolate: bool = False, **matching: str) -> DataFrame:
    """The rate of every series of a counter at every step: ``labels``, ``step``, ``value``.
    Labels are an array of (key, value) in order, so that series can be grouped and joined."""
    chosen = samples.where(F.col("metric") == metric)
    for name, value in matching.items():
        chosen = chosen.where(F.col("labels")[name] == value)
    named = chosen.select(F.array_sort(F.map_entries("labels")).alias("labels"), "ts", "value")
    rates = counter_rate_at_steps(named, ["labels"], step, seconds, extrapolate)
    return rates.select("labels", "step", F.col("per_second").alias("value"))


def matched_ratio(left: DataFrame, right: DataFrame, on: list[str] | None = None, ignoring: tuple[str, ...] = ()) -> DataFrame:
    """Divide two vectors one to one, at equal steps and equal labels.

    Labels count only if named in ``on``, or without it if not in ``ignoring``; these are the
    labels of the result. A series without a partner at a step has no row there, and zero by
    zero has null. Two series of one side that can't be told apart by the labels that count
    are an error, as it is not defined which one to take.
    """
    def keyed(vector: DataFrame, name: str) -> DataFrame:
        counts = (lambda e: e["key"].isin(on)) if on is not None else (lambda e: ~e["key"].isin(*ignoring))
        key = F.col("labels") if on is None and not ignoring else F.filter("labels", counts)
        grouped = vector.groupBy(key.alias("labels"), "step").agg(F.count("*").alias("_n"), F.max("value").alias("_v"))
        several = F.raise_error(F.concat(F.lit("several series match at one step: "), F.to_json("labels"))).cast("double")
        return grouped.select("labels", "step", F.when(F.col("_n") > 1, several).otherwise(F.col("_v")).alias(name))

    paired = keyed(left, "_left").join(keyed(right, "_right"), ["labels", "step"])
    return paired.select("labels", "step", (F.col("_left") / F.nullif(F.col("_right"), F.lit(0.0))).alias("ratio"))


def bucket_counts(df: DataFrame, by: list[str], value: str, bounds: list[float]) -> DataFrame:
    """Cumulative histogram counts: observations at or below each bound (``le``) and +Inf.
    All bounds are counted in one pass, then turned into rows."""
    limits = [*bounds, float("inf")]
    counted = df.groupBy(*by).agg(*[F.count_if(F.col(value) <= F.lit(b)).alias(f"_b{i}") for i, b in enumerate(limits)])
    pairs = F.array(*[F.struct(F.lit(b).alias("le"), F.col(f"_b{i}").cast("double").alias("count")) for i, b in enumerate(limits)])
    return counted.select(*by, F.explode(pairs).alias("_bucket")).select(*by, "_bucket.*")


def histogram_quantile(buckets: DataFrame, by: list[str], quantiles: tuple[float, ...]) -> DataFrame:
    """Quantiles from cumulative buckets (``le``, ``count``): linear inside the bucket, the
    lowest starting at zero, or being its bound if that is not above zero; in the +Inf bucket the last finite bound. A
    group with no finite bound has no quantiles. A group has one row
    per distinct bound, so its window stays small."""
    summed = buckets.groupBy(*by, "le").agg(F.sum("count").alias("count"))
    along = Window.partitionBy(*by).orderBy("le")
    whole = Window.partitionBy(*by)
    placed = summed.select(
        *by, "le", "count",
        F.coalesce(F.lag("le").over(along), F.least(F.col("le"), F.lit(0.0))).alias("_low"),
        F.coalesce(F.lag("count").over(along), F.lit(0.0)).alias("_below"),
        F.max("count").over(whole).alias("_total"),
        F.max("le").over(whole).alias("_top"),
        F.count("*").over(whole).alias("_bounds"),
    ).where((F.col("_top") == float("inf")) & (F.col("_total") > 0) & (F.col("_bounds") > 1))
    asked = F.explode(F.array(*[F.lit(float(q)) for q in quantiles]))
    rank = F.col("quantile") * F.col("_total")
    inside = F.col("_low") + (F.col("le") - F.col("_low")) * (rank - F.col("_below")) / (F.col("count") - F.col("_below"))
    value = F.when(F.col("le") == float("inf"), F.col("_low")).otherwise(inside)
    return (
        placed.withColumn("quantile", asked)
        .where((F.col("count") >= rank) & (F.col("count") > F.col("_below")))
        .groupBy(*by, "quantile")
        .agg(F.min_by(value, "le").alias("value"))
    )
