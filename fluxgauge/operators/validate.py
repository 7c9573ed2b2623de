"""Row validation: every row ends up either valid or rejected with a status and a text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluxgauge.functions import codec, outcome

# Required fields in the order they are checked, with their messages.
REQUIRED = {
    "device_id": outcome.DEVICE_REQUIRED,
    "measurement": outcome.MEASUREMENT_REQUIRED,
    "date": outcome.DATE_REQUIRED,
}


def _first_missing(text=lambda message: message) -> Column:
    return F.coalesce(*[F.when(F.col(name).isNull(), F.lit(text(message))) for name, message in REQUIRED.items()])


def domain_reason(as_of: Column) -> Column:
    """Text of the first rule a reading breaks, else null. A date equal to now is fine."""
    future = F.when(F.col("date") > as_of, F.lit(outcome.DATE_IN_FUTURE))
    return F.coalesce(_first_missing(), future)


def with_domain_reason(df: DataFrame, as_of: Column) -> DataFrame:
    return df.withColumn("reason", domain_reason(as_of))


def classify(df: DataFrame, as_of: Column, decoded: Column | None = None) -> DataFrame:
    """Add ``failure`` and ``detail`` (null for valid rows) in the order the service checks:
    undecodable body, missing field at the edge, domain rules, value too large to store.
    Pass ``as_of`` as a literal when valid and rejected rows are written by separate jobs.
    """
    undecodable = F.lit(False) if decoded is None else ~decoded
    missing = _first_missing(outcome.edge_message)
    future = F.when(F.col("date") > as_of, F.lit(outcome.DATE_IN_FUTURE))
    overflow = F.col("measurement").isNotNull() & codec.table_decimal(F.col("measurement")).isNull()
    detail = F.when(~undecodable, F.coalesce(missing, future))
    failure = (
        F.when(undecodable, F.lit("error"))
        .when(detail.isNotNull(), F.lit("validation"))
        .when(overflow, F.lit("error"))
    )
    return df.withColumns({"failure": failure, "detail": detail})


def valid(classified: DataFrame) -> DataFrame:
    """Rows that passed, at the scale the tables store."""
    return (
        classified.where(F.col("failure").isNull())
        .withColumn("measurement", codec.table_decimal(F.col("measurement")))
        .drop("failure", "detail")
    )


def rejects(classified: DataFrame, as_of: Column) -> DataFrame:
    """Rows that failed, with the status and message the caller receives."""
    failure = F.col("failure")
    return (
        classified.where(failure.isNotNull())
        .withColumns({
            "status": outcome.status_of(failure),
            "message": outcome.message_of(failure, F.col("detail")),
            "timestamp": as_of,
        })
        .drop("failure", "detail")
    )


def status_counts(rejected: DataFrame) -> DataFrame:
    return rejected.groupBy("status", "message").agg(F.count("*").alias("n"))


def null_guard(df: DataFrame, *keys: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose keys are all present, and the others."""
    present = F.lit(True)
    for key in keys:
        present = present & F.col(key).isNotNull()
    return df.where(present), df.where(~present)


def with_stored_measurement(df: DataFrame) -> DataFrame:
    """The rounded measurement and whether it fails to fit the stored scale."""
    stored = codec.table_decimal(F.col("measurement"))
    return df.withColumns({
        "stored": stored,
        "overflow": F.col("measurement").isNotNull() & stored.isNull(),
    })
