"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluxgauge.llm.common import stored

SEED = "mix-1"
PIECE = 16    # a larger mean is the sum of independent draws with means up to this
TERMS = 64    # the distribution function of a mean up to PIECE is 1 in double precision beyond this


def _uniform(*parts: Column) -> Column:
    """52 bits of an MD5 as a number in [0, 1)."""
    digest = F.md5(F.concat_ws("|", F.lit(SEED), *parts).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def _distribution(mean: Column) -> Column:
    """P(X <= k) for k = 0 .. TERMS - 1."""
    first = F.exp(-mean)
    start = F.struct(first.alias("p"), F.array(first).alias("cdf"))

    def step(state, k):
        p = state["p"] * mean / k
        return F.struct(p.alias("p"), F.concat(state["cdf"], F.array(F.element_at(state["cdf"], -1) + p)).alias("cdf"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(TERMS - 1)), start, step)["cdf"]


def rates(docs: DataFrame, weights: dict[str | None, float] | None = None) -> DataFrame:
    """Each source's mean repetition: target bytes over own bytes, the total staying as it is.

    Without ``weights`` a source's target weight is the square root of its bytes. A document counts its UTF-8 bytes plus
    1. Sources missing from ``weights`` have weight 0. Null is a source like any other.
    """
    own = docs.groupBy("source").agg(
        F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1).alias("bytes"), F.count("*").alias("n_docs"))
    if weights is None:
        weighted = own.withColumn("weight", F.sqrt(F.col("bytes").cast("double")))
    else:
        weighted = own.withColumn("weight", F.lit(0.0))
        for source, weight in weights.items():
            weighted = weighted.withColumn(
                "weight", F.when(F.col("source").eqNullSafe(F.lit(source)), F.lit(float(weight))).otherwise(F.col("weight")))
    bytes_, weight = weighted.agg(F.sum("bytes"), F.sum("weight")).first()
    scale = (bytes_ or 0) / weight if weight else 0.0
    mean = F.round(F.col("weight") * F.lit(scale) / F.col("bytes"), 9)
    pieces = F.greatest(F.lit(1), F.ceil(mean / PIECE)).cast("int")
    return weighted.select(
        F.col("source").alias("of_source"), mean.alias("rate"), pieces.alias("pieces"), _distribution(mean / pieces).alias("cdf"))


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None) -> DataFrame:
    """Every column of ``docs``, once per copy drawn, in an order mixed over all sources.

    A document's count inverts the Poisson distribution of its source's rate at a number hashed from its doc_id, so a
    repeated run draws the same copies. Rows that share a doc_id share the count; a null doc_id is replaced by the
    text's digest. Null and empty texts take part. An empty table gives no rows. Returns the struct ``row`` (the
    document), source, rate, copies, copy (from 1) and mix_key, the place in the mixed order.

    The rates, one row per source, are written first: Spark then knows their size before it plans the join, broadcasts
    them below its threshold, and moves no document by its source.
    """
    packed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("source").alias("source"),
        F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))).alias("id"))
    rated = packed.join(stored(rates(docs, weights), "mix-rates"), F.col("source").eqNullSafe(F.col("of_source")))
    draw = F.aggregate(
        F.sequence(F.lit(1), F.col("pieces")), F.lit(0),
        lambda n, j: n + F.size(F.filter("cdf", lambda c: c <= _uniform(F.col("id"), j.cast("string")))))
    counted = rated.withColumn("u", _uniform(F.col("id"), F.lit("1"))).withColumn(
        "copies", F.when(F.col("pieces") == 1, F.size(F.filter("cdf", lambda c: c <= F.col("u")))).otherwise(draw))
    copies = counted.where("copies > 0").select(
        "row", "source", "rate", F.col("copies").cast("long").alias("copies"), "id",
        F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies").cast("long"))).alias("copy"))
    return copies.withColumn(
        "mix_key", F.md5(F.concat_ws("|", F.lit(SEED), "id", F.lit("copy"), F.col("copy").cast("string")).cast("binary"))
    ).drop("id").orderBy("mix_key")
