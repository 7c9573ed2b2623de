"""Records that their producer published again: found by batch numbers, not by all ids ever seen.

A producer numbers its batches and starts one after the last was published, so once a partition has shown a record of a
batch, all earlier batches are closed: another record of theirs is a repeat. Only the ids of each partition's open batch are
kept. Records without a batch number, such as replays of the fallback table, always pass; the read model absorbs repeats.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PUBLISHED = "partition INT, producer STRING, producer_batch BIGINT, record_id STRING"
_SOURCE = ["partition", "producer"]
_RECORD = [*_SOURCE, "producer_batch", "record_id"]


def nothing(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], PUBLISHED)


def _marks(rows: DataFrame) -> DataFrame:
    """The open batch of each partition and producer."""
    return rows.groupBy(*_SOURCE).agg(F.max("producer_batch").alias("mark"))


def unseen(batch: DataFrame, known: DataFrame) -> DataFrame:
    """Rows of a batch without repeats: of equal records the first arrival stays, those of closed batches and those
    ``known`` from the open one go. A record is matched by its arrival number, which no key can skew."""
    numbered = batch.where(F.col("producer").isNotNull())
    first = numbered.groupBy(*_RECORD).agg(F.min("arrival_seq").alias("arrival_seq"))
    late = F.coalesce(F.col("producer_batch") < F.col("mark"), F.lit(False))
    fresh = first.join(_marks(known), _SOURCE, "left").where(~late).join(known, _RECORD, "left_anti").select("arrival_seq")
    return batch.where(F.col("producer").isNull()).unionByName(numbered.join(fresh, "arrival_seq", "left_semi"))


def open_batches(batch: DataFrame, known: DataFrame) -> DataFrame:
    """What to know before the next batch: the ids of every partition's and producer's open batch."""
    every = known.unionByName(batch.where(F.col("producer").isNotNull()).select(*_RECORD)).distinct()
    return every.join(_marks(every), _SOURCE).where(F.col("producer_batch") == F.col("mark")).select(*_RECORD)
