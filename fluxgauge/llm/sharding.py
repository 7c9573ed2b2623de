"""Shards of near equal size by sampled splitters."""

from __future__ import annotations

import json
from bisect import bisect_left

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fluxgauge.llm.common import stored

RANGES = 1024             # least number of key ranges
ROWS_PER_RANGE = 500_000  # more ranges once they would be larger
SAMPLES_PER_RANGE = 64
KEY_BITS = 52             # keys are exact as doubles, as the quantile sketch keeps them
WHOLE = 160               # equal texts stay together up to this fraction (1 / WHOLE) of all bytes


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.col("text")
    key = F.shiftrightunsigned(F.xxhash64(F.coalesce(text, F.lit(""))), 64 - KEY_BITS)
    return docs.select(
        "doc_id",
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        key.alias("key"),
        F.xxhash64(F.lit(1), "doc_id").alias("tie"))


def _fraction(hashed: Column) -> Column:
    return F.shiftrightunsigned(hashed, 11) / F.lit(float(1 << 53))


def _splitters(rows: DataFrame, ranges: int, total: int) -> list[int]:
    """Quantiles of a sample whose rows are drawn in proportion to their size; a heavy key is there several times."""
    drawn = rows.where(_fraction(F.xxhash64(F.lit(2), "key", "tie")) < F.col("size") * (ranges * SAMPLES_PER_RANGE / total))
    cuts = [i / ranges for i in range(1, ranges)]
    return drawn.agg(F.percentile_approx("key", cuts, ranges * SAMPLES_PER_RANGE)).first()[0] or []


def _slots(splitters: list[int]) -> tuple[Column, Column]:
    """For a key: how many splitters are less than it, and how many are equal to it.

    The splitters lie in a literal array by the key's leading bits, so that a row looks at one or two of them.
    """
    bits = max(1, (len(splitters) + 1).bit_length() - 1)
    starts = [bisect_left(splitters, b << (KEY_BITS - bits)) for b in range((1 << bits) + 1)]
    table = [{"n": a, "s": splitters[a:b]} for a, b in zip(starts, starts[1:])]
    literal = F.from_json(F.lit(json.dumps(table)), "array<struct<n:int,s:array<bigint>>>")
    cell = F.element_at(literal, (F.shiftrightunsigned("key", KEY_BITS - bits) + 1).cast("int"))
    less = cell["n"] + F.size(F.filter(cell["s"], lambda s: s < F.col("key")))
    equal = F.size(F.filter(cell["s"], lambda s: s == F.col("key")))
    return less, equal


def shard_by_bytes(docs: DataFrame, shards: int = 8, ranges: int | None = None) -> DataFrame:
    """Put every document into one of ``shards`` shards of near equal bytes.

    Returns doc_id, size, text_crc32, shard and slot (gapless from 0 within the shard). Size is the text's UTF-8 bytes
    plus 1; a null text has size 1 and checksum null. Documents are ordered by (hash of text, hash of doc_id), ranges of
    that order are cut at quantiles of a size-weighted sample, and a shard is a piece of the order. Equal texts are
    neighbours and stay in one shard unless they hold more than 1/160 of all bytes; such a group is cut where the shard
    ends. So shards differ by 1/160 of all bytes or one document at most. Repeated rows each get a slot of their own. An
    empty table gives no rows. Other columns are not read.

    Only narrow rows without texts are shuffled. A range that one key overfills shows as repeated splitters and is
    subdivided by the hash of doc_id into as many parts, so no task holds more than a few ranges' rows.
    """
    rows = stored(_keyed(docs), "shard-keys")
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    ranges = ranges or max(RANGES, n // ROWS_PER_RANGE)
    less, equal = _slots(_splitters(rows, ranges, total) if n else [])
    ranged = rows.withColumns({"range": less, "heavy": equal}).withColumn(
        "part", F.when(F.col("heavy") == 0, 0).otherwise(1 + F.floor(_fraction(F.col("tie")) * F.col("heavy"))).cast("int"))
    by_part = Window.partitionBy("range", "part").orderBy("key", "tie", "doc_id")
    by_text = Window.partitionBy("range", "part", "key")
    before = Window.orderBy("range", "part").rowsBetween(Window.unboundedPreceding, -1)
    group = Window.partitionBy("range", F.col("part") > 0)
    # a few rows per range, whatever the number of documents
    parts = ranged.groupBy("range", "part").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).select(
        "range", "part", "bytes",
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("base"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base_rows")).select(
        F.col("range").alias("p_range"), F.col("part").alias("p_part"), "base", "base_rows",
        F.min("base").over(group).alias("heavy_start"), F.sum("bytes").over(group).alias("heavy_bytes"))
    placed = ranged.join(parts, (F.col("range") == F.col("p_range")) & (F.col("part") == F.col("p_part"))).select(
        "doc_id", "size", "text_crc32", "key", "tie", "range", "part", "base", "base_rows", "heavy_start", "heavy_bytes",
        (F.sum("size").over(by_part.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size") + F.col("base")).alias("start"),
        F.row_number().over(by_part).alias("nth"))
    grouped = placed.withColumns({
        "group_start": F.when(F.col("part") > 0, F.col("heavy_start")).otherwise(F.min("start").over(by_text)),
        "group_bytes": F.when(F.col("part") > 0, F.col("heavy_bytes")).otherwise(F.sum("size").over(by_text)),
    })
    twice_middle = F.when(F.col("group_bytes") * WHOLE <= total, 2 * F.col("group_start") + F.col("group_bytes")).otherwise(
        2 * F.col("start") + F.col("size"))
    dealt = stored(grouped.select(
        "doc_id", "size", "text_crc32",
        F.least(F.lit(shards - 1), F.floor(twice_middle / F.lit(2.0 * max(total, 1) / shards))).cast("int").alias("shard"),
        (F.col("base_rows") + F.col("nth") - 1).alias("place")), "shard-places")
    first = dealt.groupBy(F.col("shard").alias("of")).agg(F.min("place").alias("first"))
    return dealt.join(first, F.col("shard") == F.col("of")).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("place") - F.col("first")).alias("slot"))
