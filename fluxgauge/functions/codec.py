"""JSON and timestamp wire forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluxgauge import schemas

_CORRUPT = "_corrupt_record"


def _decode(text: Column, schema: str) -> Column:
    return F.from_json(
        text, f"{schema}, {_CORRUPT} STRING", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT}
    )


def epoch_seconds(value: Column) -> Column:
    """Decimal epoch seconds to a timestamp, exact to the microsecond."""
    return F.timestamp_micros(F.floor(value * 1_000_000).cast("bigint"))


def _with_epoch(schema: str, fields: tuple[str, ...]) -> str:
    for field in fields:
        schema = schema.replace(f"{field} TIMESTAMP", f"{field} DECIMAL(20,9)")
    return schema


def _decode_column(df: DataFrame, text: str, into: str, schema: str, stamps: tuple[str, ...]) -> DataFrame:
    """Decode ISO-8601 stamps or decimal epoch seconds, whichever the text holds; else null.

    Looking at the first stamp's form saves a failed attempt. Exploding an array of one
    keeps the decoded value a column of its own; otherwise the optimizer copies the decoder
    into every filter and field that uses it.
    """
    source = F.col(text).cast("string")
    names = [part.split()[0] for part in schema.split(", ")]

    def fields(row: Column) -> Column:
        seconds = F.struct(*[(epoch_seconds(row[n]) if n in stamps else row[n]).alias(n) for n in names])
        return F.when(row[_CORRUPT].isNull(), seconds)

    is_epoch = source.rlike(rf'"{stamps[0]}"\s*:\s*"?-?[0-9.]+"?\s*[,}}]')
    epoch = F.transform(F.array(_decode(source, _with_epoch(schema, stamps))), fields)[0]
    iso = F.transform(
        F.array(_decode(source, schema)),
        lambda row: F.when(row[_CORRUPT].isNull(), F.struct(*[row[n].alias(n) for n in names])))[0]
    # an instant has a time and a zone; a bare day or a local time is none
    loose = F.lit(False)
    for name in stamps:
        loose = loose | source.rlike(rf'"{name}"\s*:\s*"(?!\s*[^"T]+T[0-9:.]+(?:Z|[+-][0-9:]+)\s*")')
    decoded = F.when(source.isNull(), None).when(is_epoch, epoch).when(~loose, iso)
    return df.withColumn(into, F.explode(F.array(decoded)))


def decode_requests(df: DataFrame, body: str = "body", into: str = "request") -> DataFrame:
    """Add the request struct, null where the body cannot be decoded."""
    return _decode_column(df, body, into, schemas.REQUEST, ("date",))


def decode_events(df: DataFrame, value: str = "value", into: str = "event") -> DataFrame:
    """Add the event struct, null where the record value cannot be decoded."""
    return _decode_column(df, value, into, schemas.EVENT, ("date", "recordedAt"))


def encode_event(*fields: Column) -> Column:
    return F.to_json(
        F.struct(*fields), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'", "timeZone": "UTC"}
    )


def iso_instant(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def table_decimal(value: Column) -> Column:
    """Round half away from zero to the stored scale; null when it does not fit."""
    return value.try_cast(schemas.TABLE_DECIMAL)


def int_or_zero(text: Column) -> Column:
    return F.coalesce(text.try_cast("int"), F.lit(0))
