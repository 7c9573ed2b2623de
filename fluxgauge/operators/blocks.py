"""Running aggregates and trailing windows that no single key can overload.

``Window.partitionBy(device)`` puts a device's whole history into one task. Here the
order column is cut into blocks of a fixed width, so the sort-based part of the work is
done per (key, block). What earlier blocks contribute is one summary row per
(key, block), made by an ordinary aggregation with map-side combine.

Choose the width so that a (key, block) fits a task: with unique consecutive arrival
numbers a block never holds more rows than its width, whatever the distribution of keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_AGGREGATE = {"max": F.max, "min": F.min, "sum": F.sum}
_COMBINE = {
    "max": F.greatest,
    "min": F.least,
    "sum": lambda before, here: F.when(before.isNull(), here).when(here.isNull(), before).otherwise(before + here),
}

# Arrivals per block unless the caller knows better: about 16 million narrow rows sort
# within one task, and 10^12 readings give some 60,000 summary rows for the busiest key.
ARRIVALS_PER_BLOCK = 1 << 24


def block_of(order: Column, width: int) -> Column:
    """Number of the block an integer order value falls into."""
    order = order.cast("bigint")
    return F.call_function("div", order - F.pmod(order, F.lit(width)), F.lit(width).cast("bigint"))


def running(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    block: Column | None,
    aggregates: dict[str, tuple[str, Column]],
    inclusive: bool = True,
    seed: DataFrame | None = None,
    summary_rows: DataFrame | None = None,
) -> DataFrame:
    """Add running aggregates per key, in ``order``.

    ``block`` must never decrease along ``order``. None means that every key is known to
    have few rows, such as one per step of a grid; a plain window then reads the input
    once. ``aggregates`` maps a new column to ("max" | "min" | "sum", value). With
    ``inclusive=False`` a row sees only earlier rows. ``seed`` holds the keys and the new
    columns: values that precede every row. ``summary_rows`` are rows with the same block
    summaries that cost less to compute than ``df``. Guard against null keys first.
    """
    last_row = 0 if inclusive else -1
    if block is None:
        if seed is not None or summary_rows is not None:
            raise ValueError("seed and summary_rows need blocks")
        along = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, last_row)
        return df.withColumns({name: _AGGREGATE[kind](value).over(along) for name, (kind, value) in aggregates.items()})

    def totals_of(frame: DataFrame) -> DataFrame:
        return frame.groupBy(*keys, "_block").agg(
            *[_AGGREGATE[kind](value).alias(f"_total_{name}") for name, (kind, value) in aggregates.items()]
        )

    blocked = df.withColumn("_block", block)
    totals = totals_of(blocked if summary_rows is None else summary_rows.withColumn("_block", block))
    if seed is not None:
        first = seed.select(*keys, F.lit(-(1 << 62)).alias("_block"),
                            *[F.col(name).alias(f"_total_{name}") for name in aggregates])
        totals = totals.unionByName(first)
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        *keys, "_block",
        *[_AGGREGATE[kind](f"_total_{name}").over(earlier).alias(f"_carried_{name}")
          for name, (kind, _) in aggregates.items()],
    )
    within = (
        Window.partitionBy(*keys, "_block").orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, last_row)
    )
    joined = blocked.join(carried, [*keys, "_block"], "left")
    return joined.select(
        *df.columns,
        *[_COMBINE[kind](F.col(f"_carried_{name}"), _AGGREGATE[kind](value).over(within)).alias(name)
          for name, (kind, value) in aggregates.items()],
    )


def previous(df: DataFrame, keys: list[str], order: Column, block: Column, columns: list[str]) -> DataFrame:
    """Add ``previous_<column>``: the values of the key's preceding row, null for its first.

    Within a block this is a lag; the first row of a block takes the last row of the block
    before, which an aggregation finds (a hash aggregation for fixed-width columns).
    """
    blocked = df.withColumn("_block", block)
    ends = blocked.groupBy(*keys, "_block").agg(*[F.max_by(c, order).alias(f"_end_{c}") for c in columns])
    by_block = Window.partitionBy(*keys).orderBy("_block")
    carried = ends.select(*keys, "_block", *[F.lag(f"_end_{c}").over(by_block).alias(f"_carried_{c}") for c in columns])
    within = Window.partitionBy(*keys, "_block").orderBy(order)
    joined = blocked.join(carried, [*keys, "_block"], "left")
    first = F.row_number().over(within) == 1
    return joined.select(*df.columns, *[
        F.when(first, F.col(f"_carried_{c}")).otherwise(F.lag(c).over(within)).alias(f"previous_{c}") for c in columns
    ])


def with_lookback(df: DataFrame, order: Column, width: int, span: int) -> DataFrame:
    """Assign rows to blocks (``_block``) and repeat each row in the later blocks whose
    rows may look back ``span`` units at it. ``_own`` marks the row's own block: evaluate
    windows per (key, ``_block``), then keep the own rows.
    """
    own = block_of(order, width)
    reach = block_of(order + F.lit(span), width)
    return df.withColumn("_own_block", own).withColumn("_block", F.explode(F.sequence(own, reach))) \
        .withColumn("_own", F.col("_block") == F.col("_own_block")).drop("_own_block")


def cuts(df: DataFrame, keys: list[str], order: str, rows: int, cell: int = 1_000_000) -> DataFrame:
    """Blocks of about ``rows`` rows each, however the rows lie along ``order``.

    Rows are counted per cell (``cell`` units of the integer ``order``), and consecutive
    cells share a block until it is full: one row per key and cell with its ``_cut``. A
    block holds at most ``rows`` and one cell more; with distinct microseconds and cells of
    a second that is a million. The counts combine before the shuffle, and the running
    count over them is cut into blocks itself. Guard against null keys first.
    """
    counted = df.groupBy(*keys, block_of(F.col(order), cell).alias("_cell")).agg(F.count("*").alias("_rows"))
    before = running(counted, keys, [F.col("_cell")], block_of(F.col("_cell"), 1 << 16),
                     {"_before": ("sum", F.col("_rows"))}, inclusive=False)
    return before.select(*keys, "_cell", block_of(F.coalesce("_before", F.lit(0)), rows).alias("_cut"))


def in_cuts(df: DataFrame, keys: list[str], order: str, cut: DataFrame, cell: int = 1_000_000) -> DataFrame:
    """Rows with the ``_cut`` they are in; the join is on key and cell, so no key overloads it."""
    return df.withColumn("_cell", block_of(F.col(order), cell)).join(cut, [*keys, "_cell"]).drop("_cell")
