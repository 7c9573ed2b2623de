"""Sustained conditions and state changes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fluxgauge.operators import blocks


@dataclass(frozen=True)
class Rule:
    """A condition that must hold without a break for some seconds."""

    name: str
    threshold: float
    above: bool
    hold_seconds: int
    severity: str

    def condition(self, value: Column) -> Column:
        return value > self.threshold if self.above else value == self.threshold


# Fixed value: seconds between two evaluations of a rule.
INTERVAL = 30

# The documented alert rules; there 1 is the open state of the breaker.
RULES = (
    Rule("HighDuplicateRate", 0.1, True, 300, "warning"),
    Rule("CircuitBreakerOpen", 1.0, False, 60, "critical"),
    Rule("HighConsumerLag", 1000.0, True, 300, "warning"),
    Rule("DLQMessagesDetected", 0.0, True, 120, "warning"),
    Rule("HighMemoryUsage", 0.9, True, 300, "warning"),
    Rule("HighLatency", 0.5, True, 300, "warning"),
)


def rule(name: str) -> Rule:
    return next(r for r in RULES if r.name == name)


def sustained(
    evaluations: DataFrame, by: list[str], ts: str, active: Column, hold_seconds: int | Column,
    step_seconds: int = INTERVAL, block_steps: int = 1 << 14,
) -> DataFrame:
    """Stretches of evaluations in which the condition held for at least ``hold_seconds``.

    Evaluations lie on a grid of steps, one per series and step. A step at which a series has
    no evaluation ends its stretch as one that does not hold does: silence is not an alert. So
    a stretch is a run of consecutive active steps and the other evaluations are not needed.
    Runs are found in blocks of steps. One that touches neither end of its block is complete;
    the others, two per block at most, are put together by a window over these few rows.
    """
    step = blocks.block_of(F.unix_micros(ts), step_seconds * 1_000_000)
    within = Window.partitionBy(*by, "_block").orderBy("_step")
    hold_us = (hold_seconds if isinstance(hold_seconds, Column) else F.lit(hold_seconds)).cast("bigint") * 1_000_000
    runs = (
        evaluations.where(active).withColumns({"_step": step, "_hold": hold_us})
        .withColumn("_block", blocks.block_of(F.col("_step"), block_steps))
        .withColumn("_run", F.col("_step") - F.dense_rank().over(within))
        .groupBy(*by, "_block", "_run")
        .agg(F.min("_step").alias("_from"), F.max("_step").alias("_until"), F.min(ts).alias("active_from"),
             F.max(ts).alias("active_until"), F.count("*").alias("evaluations"), F.max("_hold").alias("_hold"))
    )
    inside = (F.col("_from") > F.col("_block") * block_steps) & (F.col("_until") < (F.col("_block") + 1) * block_steps - 1)
    along = Window.partitionBy(*by).orderBy("_from")
    starts = F.coalesce(F.col("_from") - F.lag("_until").over(along) > 1, F.lit(True)).cast("int")
    joined = (
        runs.where(~inside).withColumn("_starts", starts).withColumn("_run", F.sum("_starts").over(along))
        .groupBy(*by, "_run")
        .agg(F.min("active_from").alias("active_from"), F.max("active_until").alias("active_until"),
             F.sum("evaluations").alias("evaluations"), F.max("_hold").alias("_hold"))
    )
    columns = [*by, "active_from", "active_until", "evaluations", "_hold"]
    held = F.unix_micros("active_until") - F.unix_micros("active_from")
    return (
        runs.where(inside).select(columns).unionByName(joined.select(columns))
        .where(held >= F.col("_hold"))
        .withColumn("fired_at", F.timestamp_micros(F.unix_micros("active_from") + F.col("_hold")))
        .drop("_hold")
    )


def transitions(
    observed: DataFrame, by: list[str], order: str, ts: str, state: str, block_width: int = blocks.ARRIVALS_PER_BLOCK
) -> DataFrame:
    """State changes with the time spent in the new state (null while it lasts).

    The next change is the preceding one in reversed order, so both looks work block by
    block. Numeric states keep the block summaries in hash aggregations.
    """
    seq, back = F.col(order), -F.col(order)
    before = blocks.previous(observed, by, seq, blocks.block_of(seq, block_width), [state])
    changed = before.where(F.col(f"previous_{state}") != F.col(state)).select(
        *by, order, ts, F.col(f"previous_{state}").alias("from_state"), F.col(state).alias("to_state"))
    after = blocks.previous(changed, by, back, blocks.block_of(back, block_width), [ts])
    spent = (F.unix_micros(f"previous_{ts}") - F.unix_micros(ts)) / F.lit(1e6)
    return after.withColumn("seconds_in_state", spent).drop(f"previous_{ts}")
