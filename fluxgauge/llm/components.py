"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxgauge.llm.common import stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hang the larger (or smaller) neighbours of every node on its least neighbour."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    # small: a > b holds for every edge, so the neighbours of a are all smaller
    least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    hung = both.join(least, "a")
    if large:
        return hung.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return hung.where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b")).union(
        least.select("a", F.col("m").alias("b")))


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.hash("a", "b").cast("long")).alias("h"),
                    F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
    return tuple(row)


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) of every node that has an edge; root is the least node it reaches.

    ``edges`` has two long columns a and b. Null ends, loops and repeats are ignored. Large and small stars alternate
    until nothing changes, about log2 of the longest path; each round is written to the shared folder. A node with very
    many edges is aggregated before its shuffle and joined by adaptive execution in parts.
    """
    ordered = edges.where("a is not null and b is not null and a != b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now = stored(ordered.distinct(), name)
    seen = _signature(now)
    while True:
        now = stored(_star(_star(now, large=True).distinct(), large=False).where("a != b").distinct(), name)
        after = _signature(now)
        if after == seen:
            break
        seen = after
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
