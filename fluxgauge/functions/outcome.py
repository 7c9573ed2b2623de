"""Reject texts, status codes, breaker states and retry delays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Messages and codes callers of the service see.
DEVICE_REQUIRED = "deviceId is required"
MEASUREMENT_REQUIRED = "measurement is required"
DATE_REQUIRED = "date is required"
DATE_IN_FUTURE = "date cannot be in the future"
ALREADY_PROCESSED = "Already processed"
UNAVAILABLE = "Service temporarily unavailable"
INTERNAL_ERROR = "Internal server error"
ACCEPTED = 202
STATUS_BY_REASON = {
    "validation": (400, None),
    "duplicate": (200, ALREADY_PROCESSED),
    "kafka_unavailable": (503, UNAVAILABLE),
    "database_unavailable": (503, UNAVAILABLE),
    "error": (500, INTERNAL_ERROR),
}
REPLAYED = "Successfully replayed %d events"
NOTHING_TO_REPLAY = "No fallback events to replay"
REPROCESSED = "Successfully reprocessed %d messages from DLQ"
NOTHING_TO_REPROCESS = "No messages to reprocess in DLQ"
BREAKER_STATES = {0: "CLOSED", 1: "HALF_OPEN", 2: "OPEN"}

# Retries of a failed delivery, and the breaker's sliding window.
MAX_RETRIES = 3
FIRST_DELAY_MS = 1000
DELAY_FACTOR = 2
WINDOW_CALLS = 10
FAILURE_THRESHOLD_PCT = 50.0


def edge_message(message: str) -> str:
    """Text of a missing field found while reading the request body."""
    return f"{message.split(' ')[0]}: {message}"


def status_of(reason: Column) -> Column:
    """Status code of a failure kind; anything unknown is an internal error."""
    chain = None
    for name, (code, _) in STATUS_BY_REASON.items():
        chain = (F if chain is None else chain).when(reason == name, F.lit(code))
    return chain.otherwise(F.lit(500))


def message_of(reason: Column, detail: Column) -> Column:
    """Text of a failure kind; validation failures show their own detail."""
    chain = F.when(reason == "validation", detail)
    for name, (_, text) in STATUS_BY_REASON.items():
        if text is not None:
            chain = chain.when(reason == name, F.lit(text))
    return chain.otherwise(F.lit(INTERNAL_ERROR))


def breaker_state(code: Column) -> Column:
    """Gauge value to state name."""
    pairs = [F.lit(x) for pair in BREAKER_STATES.items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), code.cast("int"))


def backoff_ms(attempt: Column) -> Column:
    """Delay before the given retry (1-based): the first delay, doubled each time."""
    return (F.lit(FIRST_DELAY_MS) * F.pow(F.lit(DELAY_FACTOR), attempt - 1)).cast("bigint")


def count_message(count: Column, some: str, none: str) -> Column:
    return F.when(count > 0, F.format_string(some, count)).otherwise(F.lit(none))
