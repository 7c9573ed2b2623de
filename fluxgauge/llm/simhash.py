"""Near-duplicate documents by SimHash, joined on a grid of segment bit counts."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fluxgauge.llm.common import merged, stored, text_batches
from fluxgauge.llm.components import components

WORDS = 4
SEED = 42
DISTANCE = 4
BLOCKS = 8
LOW_BITS = 0x5555555555555555
CHUNK = 1 << 15  # shingles counted together


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def simhash(text: str, words: int = WORDS, seed: int = SEED) -> int:
    """Bit i is 1 if over half of the shingles' hashes have it; repeats count, no words give 0."""
    tokens = text.encode("utf-8").lower().split()  # lower-cases A-Z only and splits at ASCII white space only
    if not tokens:
        return 0
    n = max(1, len(tokens) - words + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, CHUNK):
        hashes = np.array([xxhash.xxh64_intdigest(b" ".join(tokens[i:i + words]), seed) for i in range(at, min(n, at + CHUNK))], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def _mark() -> Column:
    """Tells the texts of one doc_id apart."""
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, a mark of the text, and the text's SimHash as a signed 64-bit integer; a null text counts as empty."""
    text_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            marks = [_signed(simhash(t or "", words)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "mark": batch.column("mark"), "fp": pa.array(marks, pa.int64())})

    schema = T.StructType([docs.schema["doc_id"]]).add("mark", "long").add("fp", "long")
    return docs.select("doc_id", _mark().alias("mark"), "text").mapInArrow(run, schema)


def embedded(fp: Column) -> Column:
    """The bit counts of 32 segments of two bits, each written in unary: 00, 01 or 11.

    The Manhattan distance of two count vectors is then the number of bits in which their codes differ, and never more
    than the number of bits in which the fingerprints differ.
    """
    low = fp.bitwiseAND(F.lit(LOW_BITS))
    high = F.shiftrightunsigned(fp, 1).bitwiseAND(F.lit(LOW_BITS))
    return F.shiftleft(low.bitwiseAND(high), 1).bitwiseOR(low.bitwiseOR(high))


def _differ(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def _cells(prints: DataFrame, distance: int) -> DataFrame:
    """The grid cells of every fingerprint: the counts of any BLOCKS - distance of BLOCKS blocks of segments.

    Vectors within the distance agree in all but ``distance`` blocks, so they share a cell.
    """
    width = 64 // BLOCKS
    block = [((1 << width) - 1) << (width * b) for b in range(BLOCKS)]
    masks = [_signed(reduce(int.__or__, c)) for c in combinations(block, BLOCKS - distance)]
    code = embedded(F.col("fp"))
    tasks = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # a number of its own, by another key than the grouping's: else few tasks would make all the cells
    dealt = prints.repartition(tasks, F.xxhash64("fp"))
    return dealt.select("fp", code.alias("code")).select("fp", F.explode(F.transform(
        F.array(*[F.lit(m).cast("long") for m in masks]), lambda m: F.xxhash64(F.col("code").bitwiseAND(m), m))).alias("cell"))


def near_groups(prints: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(node, root) of every fingerprint that links to another: connected by steps of at most ``distance`` bits.

    ``prints`` has distinct fingerprints ``fp``. Cells with one fingerprint go first. In every other cell all are
    compared with the cell's least and greatest, a number of tests in proportion to the rows, and linked groups are
    formed. Pairs still open are those of one cell in different groups; each has a member outside the cell's largest
    group, so only such members are compared with the rest of the cell. No pair within the distance is left out, and a
    dense group of thousands never becomes all its pairs.
    """
    cells = _cells(prints, distance)
    shared = cells.groupBy("cell").agg(F.count("*").alias("n"), F.min("fp").alias("least"), F.max("fp").alias("greatest")).where("n > 1")
    members = stored(cells.join(merged(shared), "cell"), "simhash-cells")
    near = lambda a, b: (_differ(embedded(F.col(a)), embedded(F.col(b))) <= distance) & (_differ(F.col(a), F.col(b)) <= distance)
    to_least = members.where((F.col("fp") != F.col("least")) & near("fp", "least")).select(F.col("fp").alias("a"), F.col("least").alias("b"))
    to_greatest = members.where((F.col("fp") != F.col("greatest")) & near("fp", "greatest")).select(
        F.col("fp").alias("a"), F.col("greatest").alias("b"))
    first = stored(components(to_least.union(to_greatest).distinct(), "simhash-first"), "simhash-groups")

    # three members have all been compared with each other
    grouped = members.where("n > 3").select("cell", "fp").join(merged(first), F.col("fp") == F.col("node"), "left").select(
        "cell", "fp", F.coalesce("root", "fp").alias("root"))
    by_root = grouped.groupBy("cell", "root").agg(F.count("*").alias("size"))
    mixed = by_root.groupBy("cell").agg(F.max_by("root", "size").alias("main"), F.count("*").alias("kinds")).where("kinds > 1")
    open_cells = grouped.join(mixed.select("cell", "main"), "cell")
    few = open_cells.where("root != main").select("cell", F.col("fp").alias("fp_a"), F.col("root").alias("root_a"))
    rest = open_cells.select("cell", F.col("fp").alias("fp_b"), F.col("root").alias("root_b"))
    crossing = few.join(rest, (few["cell"] == rest["cell"]) & (F.col("root_a") != F.col("root_b")) & near("fp_a", "fp_b")).select(
        F.col("root_a").alias("a"), F.col("root_b").alias("b")).distinct()
    second = components(crossing, "simhash-second")
    nodes = first.union(second.select("node", F.col("node").alias("root"))).distinct()
    moved = second.select(F.col("node").alias("of"), F.col("root").alias("final"))
    return nodes.alias("n").join(merged(moved), F.col("n.root") == F.col("of"), "left").select(
        F.col("n.node").alias("node"), F.coalesce("final", "n.root").alias("root")).groupBy("node").agg(F.min("root").alias("root"))


def _grouped(docs: DataFrame, words: int, distance: int) -> DataFrame:
    """doc_id, mark, fp and component_id of every row."""
    marks = stored(fingerprints(docs, words), "simhash-prints")
    prints = marks.groupBy("fp").agg(F.min("doc_id").alias("least_id"))
    groups = near_groups(prints.select("fp"), distance)
    rooted = prints.join(groups, F.col("fp") == F.col("node"), "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    answer = rooted.join(least, "root").select(F.col("fp").alias("of_fp"), "component_id")
    return marks.join(merged(answer), F.col("fp") == F.col("of_fp")).select("doc_id", "mark", "fp", "component_id")


def near_duplicates(docs: DataFrame, words: int = WORDS, distance: int = DISTANCE) -> DataFrame:
    """doc_id, fp and component_id, the least doc_id reachable by links of at most ``distance`` differing bits.

    A null or empty text, or one of white space only, has fingerprint 0 and links like any other. Repeated rows have the
    same fingerprint. A null doc_id takes part but is never a component_id unless its group has no other. An empty table
    gives no rows. Other columns are not read.
    """
    return _grouped(docs, words, distance).select("doc_id", "fp", "component_id")


def keep_first(docs: DataFrame, words: int = WORDS, distance: int = DISTANCE) -> DataFrame:
    """The document with the least doc_id of every group of ``near_duplicates``, with all columns; documents linked with
    none all stay.

    A row goes only if its own text has a fingerprint in a group with a smaller doc_id, so of two rows that share a
    doc_id an unlinked text stays. Rows that share the least doc_id of their group stay together, as they can't be told
    apart by id, and so do rows without doc_id. An empty table gives none; other columns may have any name.
    """
    found = _grouped(docs, words, distance)
    dropped = found.where("doc_id != component_id").select(
        F.col("doc_id").alias("dropped_id"), F.col("mark").alias("dropped_mark")).distinct()
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), _mark().alias("mark"))
    return packed.join(dropped, (F.col("row.doc_id") == F.col("dropped_id")) & (F.col("mark") == F.col("dropped_mark")),
                       "left_anti").select("row.*")
