"""Helpers the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxgauge.session import scratch

TEXT_ROWS = 256  # texts in one Arrow batch: bounds a Python worker's memory


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df`` from a table written in the shared folder, without their lineage."""
    path = scratch(df.sparkSession, f"llm-{name}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def merged(side: DataFrame) -> DataFrame:
    """A side of a join in which neither side may be broadcast.

    Spark sizes a stored table by its compressed files and takes an exploded row for one, so it may send millions of rows
    through the driver. A measured shuffle without an explode after it needs no such mark.
    """
    return side.hint("merge")


class TermHashes(dict):
    """Term to its XXH64; a bounded number of short terms is kept."""

    LONGEST, MOST = 32, 1 << 18

    def __missing__(self, term: bytes) -> int:
        found = xxhash.xxh64_intdigest(term)
        if len(term) <= self.LONGEST:
            if len(self) >= self.MOST:
                self.clear()
            self[term] = found
        return found


@contextmanager
def _setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def arrow_rows(spark: SparkSession, rows: int):
    """Give Python workers batches of at most so many rows."""
    return _setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def shuffles_dropped(spark: SparkSession):
    """Shuffle files go as soon as the query that wrote them ends, not when the driver happens to collect its garbage."""
    return _setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def text_batches(spark: SparkSession) -> None:
    """Small batches for every later plan of the session that hands texts to Python."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(TEXT_ROWS))


def id_remainder(modulus: int) -> Column:
    """crc32 of doc_id as text, modulo ``modulus``; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % modulus


def same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))
