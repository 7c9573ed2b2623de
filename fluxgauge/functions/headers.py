"""Record headers: a multi-valued array of (key, value bytes)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fluxgauge.functions.codec import int_or_zero

# Header names and defaults of the wire format.
RETRY_COUNT = "retry-count"
EXCEPTION_MESSAGE = "exception-message"
TRACE_ID = "X-B3-TraceId"
SPAN_ID = "X-B3-SpanId"
UNKNOWN_ERROR = "Unknown error"
PRODUCER_BATCH = "producer-batch"   # our own: who published a record, and in which batch


def header(key: str, value: Column) -> Column:
    return F.struct(F.lit(key).alias("key"), value.cast("string").cast("binary").alias("value"))


def append(headers: Column, *added: Column) -> Column:
    """Add headers behind the existing ones; earlier values stay."""
    return F.concat(F.coalesce(headers, F.expr("array()")), F.array(*added))


def last(headers: Column, key: str, default: Column | None = None) -> Column:
    """Text of the last header with this key; the default when it is missing or null."""
    matching = F.filter(headers, lambda h: h["key"] == key)
    text = F.try_element_at(matching, F.lit(-1))["value"].cast("string")
    return text if default is None else F.coalesce(text, default)


def producer_batch(producer: str, batch_id: int) -> Column:
    """Headers of what a producer publishes in one batch."""
    return F.array(header(PRODUCER_BATCH, F.lit(f"{producer}:{batch_id}")))


def producer_of(headers: Column) -> tuple[Column, Column]:
    """Producer and batch number of a record; both null when the header is missing or malformed."""
    text = last(headers, PRODUCER_BATCH)
    well = text.rlike("^.+:[0-9]{1,18}$")
    return (F.when(well, F.regexp_extract(text, "^(.+):[0-9]+$", 1)),
            F.when(well, F.substring_index(text, ":", -1)).try_cast("bigint"))


def error_message(headers: Column) -> Column:
    return last(headers, EXCEPTION_MESSAGE, F.lit(UNKNOWN_ERROR))


def retry_count(headers: Column) -> Column:
    return int_or_zero(last(headers, RETRY_COUNT, F.lit("0")))
