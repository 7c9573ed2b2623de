"""Bloom filters of stored keys, by day, made and asked with built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ENTRY = "day DATE, buckets BIGINT, words BIGINT, bucket BIGINT, bits ARRAY<BIGINT>"
KEYS = 4096       # keys of one filter; a day with more has several, by the key's hash
PER_WORD = 4      # keys to a word of 64 bits: 16 bits a key, one key in some four hundred is found in vain
PROBES = 4


def pair_hash(device: str, date: str) -> Column:
    return F.xxhash64(device, F.unix_micros(date))


def _places(hash_: Column, words: Column) -> Column:
    """The PROBES bits of a key in a filter of so many words (double hashing)."""
    again = F.xxhash64(hash_)
    low, step = again.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(again, 32).bitwiseOR(F.lit(1).cast("bigint"))
    return F.array(*[F.pmod(low + i * step, words * 64) for i in range(PROBES)])


def _bucket(hash_: Column, buckets: Column) -> Column:
    return F.pmod(hash_, buckets)


def filters(keys: DataFrame) -> DataFrame:
    """One filter per day and bucket of the keys (day, hash). A filter never has more than KEYS / PER_WORD words or so."""
    days = keys.groupBy("day").agg(F.ceil(F.count("*") / KEYS).cast("bigint").alias("buckets"), F.count("*").alias("n"))
    need = F.ceil(F.col("n") / F.col("buckets") / PER_WORD)
    sized = days.select(F.col("day").alias("of_day"), "buckets", F.pow(F.lit(2.0), F.ceil(F.log2(need.cast("double")))).cast("bigint").alias("words"))
    placed = keys.join(sized, F.col("day") == F.col("of_day")).select(
        "day", "buckets", "words", _bucket(F.col("hash"), F.col("buckets")).alias("bucket"), F.explode(_places(F.col("hash"), F.col("words"))).alias("at"))
    by = ["day", "buckets", "words", "bucket"]
    set_ = placed.groupBy(*by, F.floor(F.col("at") / 64).cast("bigint").alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("bits"))
    maps = set_.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("set"))
    every = F.sequence(F.lit(0).cast("bigint"), F.col("words") - 1)
    return maps.select(*by, F.transform(every, lambda w: F.coalesce(F.try_element_at("set", w), F.lit(0).cast("bigint"))).alias("bits"))


def days(keys: DataFrame) -> DataFrame:
    """Entries without filters: every key of one of the days may be there."""
    one = F.lit(1).cast("bigint")
    return keys.select("day").distinct().select(
        "day", one.alias("buckets"), one.alias("words"), F.lit(0).cast("bigint").alias("bucket"), F.lit(None).cast("array<bigint>").alias("bits"))


def hits(keys: DataFrame, entries: DataFrame, owner: list[str]) -> DataFrame:
    """The ``owner`` columns and day of every filter that may hold one of the keys (day, hash)."""
    outline = entries.select(*owner, "day", "buckets", "words").distinct()
    asked = keys.join(outline, "day").select(
        *owner, "day", _bucket(F.col("hash"), F.col("buckets")).alias("bucket"), _places(F.col("hash"), F.col("words")).alias("places"))
    met = asked.join(entries.select(*owner, "day", "bucket", "bits"), [*owner, "day", "bucket"])
    inside = F.expr("bits is null or forall(places, p -> (shiftrightunsigned(bits[cast(p div 64 as int)], cast(p % 64 as int)) & 1L) = 1L)")
    return met.where(inside).select(*owner, "day").distinct()
