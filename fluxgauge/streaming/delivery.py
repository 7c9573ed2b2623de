"""Sink calls that may fail: retry with growing delays, then fall back."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame

from fluxgauge.functions import outcome

Sink = Callable[[DataFrame, int], None]


def delays() -> list[float]:
    """Seconds to wait before each retry."""
    return [outcome.FIRST_DELAY_MS * outcome.DELAY_FACTOR**n / 1000 for n in range(outcome.MAX_RETRIES)]


def with_retries(sink: Sink, rows: DataFrame, batch_id: int, wait: Callable[[float], None] = time.sleep) -> None:
    for delay in delays():
        try:
            sink(rows, batch_id)
            return
        except Exception:  # the sink decides what fails; the last error is raised below
            wait(delay)
    sink(rows, batch_id)


def with_fallback(primary: Sink, fallback: Sink) -> Callable[[DataFrame, DataFrame, int], bool]:
    """Publish a batch, or keep it in the fallback when publishing fails. Returns whether it
    was published. An error of the fallback ends the batch, which the stream then repeats."""
    def deliver(records: DataFrame, spare: DataFrame, batch_id: int) -> bool:
        try:
            primary(records, batch_id)
            return True
        except Exception:  # any failure of the primary sink takes the other way
            fallback(spare, batch_id)
            return False

    return deliver
