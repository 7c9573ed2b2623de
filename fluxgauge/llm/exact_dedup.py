"""Exact de-duplication by a tree merge of sorted digest runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxgauge.llm.common import merged, stored

RUNS = 64
FAN_IN = 8
IDENTITY = ("digest", "n_bytes", "witness")


def _digests(docs: DataFrame, runs: int) -> DataFrame:
    """One narrow row per document: its digest, two witnesses of the text, and the run it starts in."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        "doc_id",
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"),
        F.octet_length(text).cast("long").alias("n_bytes"),
        F.xxhash64(text).alias("witness"),
        F.pmod(F.xxhash64("doc_id"), F.lit(runs)).cast("int").alias("run"))


def _merge(runs: DataFrame, fan_in: int) -> DataFrame:
    """``fan_in`` neighbouring runs become one; of equal texts the greatest identifier is retained.

    The greatest struct keeps this a sort aggregate: each task sorts its rows by digest and merges equal neighbours,
    before the exchange and after it.
    """
    return (
        runs.groupBy(*IDENTITY, F.expr(f"run div {fan_in}").cast("int").alias("run"))
        .agg(F.max(F.struct("keep_id")).alias("kept"), F.sum("group_size").alias("group_size"))
        .select(*IDENTITY, "run", F.col("kept.keep_id").alias("keep_id"), "group_size"))


def report(docs: DataFrame, runs: int = RUNS, fan_in: int = FAN_IN) -> DataFrame:
    """For every document the copy that stays: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their SHA-256, their length and an independent 64-bit hash agree; a null text is the empty
    text. The greatest doc_id of equal texts stays. A null doc_id is less than any other; a group whose ids are all null
    has keep_id null and keeps all its rows, because nothing tells them apart. Rows that repeat the doc_id that stays
    are the same document: all are marked as kept, and ``drop_copies`` leaves one. An empty table gives no rows. Other
    columns are not read.

    Runs meet in rounds of ``fan_in``, so a text that holds a third of all rows is one row per task and run before
    the first exchange and at most ``fan_in`` rows per later task. The way back is the same tree: documents are joined
    by (digest, run), so that text is spread over all runs there as well.
    """
    rows = stored(_digests(docs, runs), "digests")
    leaves = _merge(rows.withColumnRenamed("doc_id", "keep_id").withColumn("group_size", F.lit(1).cast("long")), 1)
    root, width = leaves, runs
    while width > 1:
        root, width = _merge(root, fan_in), -(-width // fan_in)
    answer = leaves.select(*IDENTITY, "run").join(root.drop("run"), list(IDENTITY))
    return rows.join(merged(answer), [*IDENTITY, "run"]).select(
        "doc_id", "keep_id", "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"))


def drop_copies(docs: DataFrame, runs: int = RUNS, fan_in: int = FAN_IN) -> DataFrame:
    """The documents that stay, with all their columns.

    Rows that repeat both the doc_id and the text of the document that stays are reduced to one.
    """
    found = report(docs, runs, fan_in)
    dropped = found.where(~F.col("kept")).select(
        F.col("doc_id").alias("dropped_id"), F.col("text_sha256").alias("dropped_sha")).distinct()
    repeated = (
        found.where(F.col("kept") & F.col("doc_id").isNotNull() & (F.col("group_size") > 1))
        .groupBy(F.col("doc_id").alias("repeated_id")).agg(F.count("*").alias("times")).where("times > 1"))
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                         F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256).alias("sha"))
    staying = packed.join(dropped, F.col("row.doc_id").eqNullSafe(F.col("dropped_id")) & (F.col("sha") == F.col("dropped_sha")), "left_anti")
    if repeated.isEmpty():  # else texts would move twice for nothing
        return staying.select("row.*")
    once = staying.join(repeated, F.col("row.doc_id") == F.col("repeated_id"), "left_anti")
    again = staying.join(repeated, F.col("row.doc_id") == F.col("repeated_id"), "left_semi")
    single = again.groupBy(F.col("row.doc_id").alias("id"), "sha").agg(F.first("row").alias("row"))
    return once.select("row").union(single.select("row")).select("row.*")
