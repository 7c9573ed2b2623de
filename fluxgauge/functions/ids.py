"""Event, trace and span identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def event_id(device_id: Column, date: Column) -> Column:
    """Name-based id of an accepted reading: the same reading always gets the same id,
    so a retried task or a replayed batch does not create a second event."""
    digest = F.sha2(F.concat_ws(":", device_id.cast("string"), F.unix_micros(date).cast("string")), 256)
    parts = [F.substring(digest, start, size) for start, size in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat_ws("-", *parts)


def random_event_id() -> Column:
    """A random id, for callers that do not need repeatable output."""
    return F.uuid()


OFFSET_BITS = 48   # offsets below 2^48, partitions below 2^15


def arrival(partition: Column, offset: Column) -> Column:
    """One arrival number of a record from its partition and offset, unique in its topic.

    Offsets keep their order inside a partition, and so a device's records, which share one. Partitions follow each other,
    so that a range of arrival numbers holds no more records than it is wide. No partition is partition 0; a number out of
    range ends the job, as two records would meet.
    """
    part = F.coalesce(partition, F.lit(0)).cast("bigint")
    fits = part.between(0, (1 << 63 - OFFSET_BITS) - 1) & offset.between(0, (1 << OFFSET_BITS) - 1)
    number = F.shiftleft(part, OFFSET_BITS) + offset
    return F.when(offset.isNull(), None).when(fits, number).otherwise(
        F.raise_error(F.concat(F.lit("partition or offset out of range: "), part, F.lit("/"), offset)).cast("bigint"))


def arrival_offset(number: Column) -> Column:
    """The offset in an arrival number."""
    return number.bitwiseAND(F.lit((1 << OFFSET_BITS) - 1))


def topic_partition(key: Column, partitions: int) -> Column:
    """Stable partition of a text key; all records of a device share one."""
    return (F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint") % partitions).cast("int")


def _unsigned(text: Column, lengths: tuple[int, ...]) -> Column:
    valid = F.length(text).isin(*lengths) & text.rlike("^[0-9A-Fa-f]+$")
    return F.when(valid, F.conv(F.right(text, F.lit(16)), 16, 10).cast("decimal(20,0)"))


def trace_id_low(text: Column) -> Column:
    """Low 64 bits, unsigned, of a 16- or 32-digit hex trace id; null when malformed."""
    return _unsigned(text, (16, 32))


def span_id_value(text: Column) -> Column:
    """Unsigned value of a 16-digit hex span id; null when malformed."""
    return _unsigned(text, (16,))
