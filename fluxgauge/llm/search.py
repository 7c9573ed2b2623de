"""Ranked lexical search: bit-sliced Bloom signatures bound every score from above, and what they can't exclude is rescored."""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fluxgauge.llm.common import TEXT_ROWS, TermHashes, arrow_rows, stored

TOP = 10
ITEMS = 2048           # queries that are answered together
AT_ONCE = 64           # queries whose terms are weighed together in one block
HASHES = 4             # slices a signature entry sets
SPARSE = 10            # slices per entry of the block's size class
BLOCK_DOCS = 1024      # greatest number of documents in a block
BLOCK_ENTRIES = 1 << 19
BLOCK_ROWS = 4         # blocks in one Arrow batch
SMALL = 1 << 15        # documents to rescore that may be sent to every executor (about 2 MB)

# Letters and digits stay, A-Z becomes a-z, every byte beyond ASCII stays, and the rest separates terms.
_FORM = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
# A document has the entries of all levels that its number of occurrences reaches: 1, 2, 3, 4, 6, 8, 12, 16, 24, ...
_LEVELS = np.array([1] + [2**e + half for e in range(1, 40) for half in (0, 2 ** (e - 1))], np.int64)
_STEP, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def terms(text: str) -> list[bytes]:
    """Maximal runs of ASCII letters, digits and anything beyond ASCII, in order, with A-Z in lower case."""
    return text.encode("utf-8").translate(_FORM).split()


def _entries(hashes: np.ndarray, level: np.ndarray) -> np.ndarray:
    """One 64-bit value per term and level."""
    h = (hashes + level.astype(np.uint64) * _STEP) * _MIX
    return h ^ (h >> np.uint64(29))


def _slices(entries: np.ndarray, rows: int) -> np.ndarray:
    """The slices of every entry, HASHES to each (double hashing)."""
    step = (entries >> np.uint64(32)) | np.uint64(1)
    at = entries[:, None] + np.arange(HASHES, dtype=np.uint64) * step[:, None]
    return (at % np.uint64(rows)).astype(np.int64)


@dataclass(frozen=True)
class Queries:
    """A bounded set of items: each with its distinct terms as numbers into ``terms``."""

    ids: tuple
    terms: tuple[bytes, ...]
    of: tuple[np.ndarray, ...]


@dataclass(frozen=True)
class Weights:
    """What scores depend on besides a document: N, L and the weight of every query term."""

    n: int
    words: int
    weight: np.ndarray


def _queries(rows) -> Queries:
    number: dict[bytes, int] = {}
    of = [np.array(sorted({number.setdefault(t, len(number)) for t in terms(r["text"] or "")}), np.int64) for r in rows]
    return Queries(tuple(r["item_id"] for r in rows), tuple(number), tuple(of))


def _length_factor(n, w: Weights):
    return 10 + (90 * n * w.n) // w.words


def _block(pending: list, size_class: int) -> dict:
    """The signatures of one block's documents, slice by slice: bit j of a slice is document j's."""
    rows, docs = SPARSE << size_class, -(-len(pending) // 8) * 8
    bits = np.zeros((rows, docs), bool)
    for j, (_, _, _, entries) in enumerate(pending):
        bits[_slices(entries, rows).ravel(), j] = True
    return {"doc_ids": [p[0] for p in pending], "marks": [p[1] for p in pending], "lengths": [p[2] for p in pending],
            "slices": np.packbits(bits, axis=1).tobytes()}


def signatures(docs: DataFrame, queries: Queries) -> DataFrame:
    """One row per block of documents of one size class, and one row per task with the statistics of the query terms.

    A block's size class is the number of entries of its documents, rounded up to a power of two, so long documents do
    not fill short ones' signatures; the longer they are, the fewer share a block.
    """
    wanted = {t: i for i, t in enumerate(queries.terms)}
    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = (f"doc_ids array<{id_type}>, marks array<long>, lengths array<long>, slices binary, "
              "term array<int>, df array<long>, docs long, words long")

    def sign(batches):
        known, df = TermHashes(), np.zeros(len(wanted), np.int64)
        pending: dict[int, list] = {}
        totals = [0, 0]
        arrow = {}

        def row(**fields):
            return pa.RecordBatch.from_pydict({name: pa.array([fields.get(name)], kind) for name, kind in arrow.items()})

        for batch in batches:
            arrow = arrow or {
                "doc_ids": pa.list_(batch.schema.field("doc_id").type), "marks": pa.list_(pa.int64()), "lengths": pa.list_(pa.int64()),
                "slices": pa.binary(), "term": pa.list_(pa.int32()), "df": pa.list_(pa.int64()), "docs": pa.int64(), "words": pa.int64()}
            for doc_id, mark, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "mark", "text"))):
                counts = Counter(terms(text or ""))
                if not counts:
                    continue
                for t in counts.keys() & wanted.keys():
                    df[wanted[t]] += 1
                hashes = np.array([known[t] for t in counts], np.uint64)
                tf = np.fromiter(counts.values(), np.int64, len(counts))
                reached = np.searchsorted(_LEVELS, tf, "right")
                ends = np.cumsum(reached)
                level = np.arange(ends[-1]) - np.repeat(ends - reached, reached)
                length = int(tf.sum())
                totals[0] += 1
                totals[1] += length
                size_class = max(3, int(ends[-1] - 1).bit_length())
                group = pending.setdefault(size_class, [])
                group.append((doc_id, mark, length, _entries(np.repeat(hashes, reached), level)))
                if len(group) >= max(8, min(BLOCK_DOCS, BLOCK_ENTRIES >> size_class)):
                    yield row(**_block(pending.pop(size_class), size_class))
        for size_class, group in pending.items():
            yield row(**_block(group, size_class))
        if totals[0]:
            some = np.flatnonzero(df)
            yield row(term=some.tolist(), df=df[some].tolist(), docs=totals[0], words=totals[1])

    return _texts(docs).mapInArrow(sign, schema)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("mark"), "text")


def _weights(blocks: DataFrame, queries: Queries) -> Weights | None:
    """From the tasks' statistics; None if no document has a term. At most one row per query term comes to the driver."""
    stats = blocks.where("docs is not null")
    n, words = stats.agg(F.sum("docs"), F.sum("words")).first()
    if not n:
        return None
    df = np.zeros(len(queries.terms), np.int64)
    for r in stats.select(F.explode(F.arrays_zip("term", "df")).alias("x")).groupBy("x.term").agg(F.sum("x.df").alias("df")).collect():
        df[r["term"]] = r["df"]
    weight = [math.floor(1000 * math.log((2 * n + 2) / (2 * int(d) + 1))) if d else 0 for d in df]
    return Weights(n, words, np.array(weight, np.int64))


def _saturated(tf, m):
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def _bounds(slices: np.ndarray, lengths: np.ndarray, hashes: np.ndarray, queries: Queries, w: Weights):
    """(first item, upper bounds) for some items at a time: bounds[i, j] is no less than the score of document j.

    A term adds, for every level that its slices show, what its part of the score can grow by from the level below; a
    document that has the term has all these slices set, so nothing is missed.
    """
    rows, width = len(slices), len(lengths)
    m = _length_factor(lengths, w)
    for first in range(0, len(queries.of), AT_ONCE):
        items = queries.of[first:first + AT_ONCE]
        used = np.unique(np.concatenate([np.empty(0, np.int64), *items]))
        used = used[w.weight[used] > 0]
        part = np.zeros((len(used) + 1, width), np.int64)  # the last row stays zero, for terms without weight
        active, have, below = np.arange(len(used)), np.full((len(used), slices.shape[1]), 255, np.uint8), np.zeros(width, np.int64)
        for level in range(len(_LEVELS) - 1):
            at = _slices(_entries(hashes[used[active]], np.full(len(active), level)), rows)
            have = have & np.bitwise_and.reduce(slices[at], axis=1)
            some = have.any(axis=1)
            active, have = active[some], have[some]
            if not len(active):
                break
            most = _saturated(np.minimum(_LEVELS[level + 1] - 1, lengths), m)
            part[active] += np.unpackbits(have, axis=1, count=width) * ((most - below) * w.weight[used[active]][:, None])
            below = most
        place = np.full(len(queries.terms) + 1, len(used))
        place[used] = np.arange(len(used))
        yield first, np.stack([part[place[item]].sum(axis=0) for item in items])


def _read(batches, queries: Queries, w: Weights):
    """(batch, row, first item, bounds) over all blocks."""
    hashes = np.array([xxhash.xxh64_intdigest(t) for t in queries.terms], np.uint64)
    for batch in batches:
        for i in range(batch.num_rows):
            lengths = np.array(batch.column("lengths")[i].values, np.int64)
            slices = np.frombuffer(batch.column("slices")[i].as_buffer(), np.uint8).reshape(-1, -(-len(lengths) // 8))
            for first, bounds in _bounds(slices, lengths, hashes, queries, w):
                yield batch, i, first, bounds


def _found(batch: pa.RecordBatch, i: int, items: np.ndarray, docs: np.ndarray, bounds: np.ndarray) -> pa.RecordBatch:
    at = pa.array(docs)
    return pa.RecordBatch.from_arrays([
        pa.array(items, pa.int32()), batch.column("doc_ids")[i].values.take(at), batch.column("marks")[i].values.take(at),
        pa.array(bounds, pa.int64())], names=["item", "doc_id", "mark", "bound"])


def _leading(blocks: DataFrame, queries: Queries, w: Weights, top: int, schema: str) -> DataFrame:
    """The ``top`` documents of every item by upper bound; a block passes on no more than these."""
    def lead(batches):
        for batch, i, first, bounds in _read(batches, queries, w):
            best = np.argpartition(-bounds, min(top, bounds.shape[1]) - 1, axis=1)[:, :top]
            values = np.take_along_axis(bounds, best, axis=1)
            item, place = np.nonzero(values)
            yield _found(batch, i, item + first, best[item, place], values[item, place])

    order = Window.partitionBy("item").orderBy(F.desc("bound"), "doc_id", "mark")
    return blocks.mapInArrow(lead, schema).withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= top)


def _possible(blocks: DataFrame, queries: Queries, w: Weights, least: np.ndarray, schema: str) -> DataFrame:
    """Every (item, document) whose upper bound reaches the item's least score."""
    def pick(batches):
        for batch, i, first, bounds in _read(batches, queries, w):
            item, doc = np.nonzero(bounds >= least[first:first + len(bounds), None])
            if len(item):
                yield _found(batch, i, item + first, doc, bounds[item, doc])

    return blocks.mapInArrow(pick, schema)


def _rescored(docs: DataFrame, pairs: DataFrame, queries: Queries, w: Weights, small: bool) -> DataFrame:
    """item, doc_id and the exact score of the pairs (item, doc_id, mark), read from the whole texts."""
    wanted = pairs.groupBy(F.col("doc_id").alias("of_id"), F.col("mark").alias("of_mark")).agg(F.collect_set("item").alias("items"))
    same = F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("mark") == F.col("of_mark"))
    picked = _texts(docs).join(F.broadcast(wanted) if small else wanted, same).select("doc_id", "text", "items")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    number = {t: i for i, t in enumerate(queries.terms)}

    def score(batches):
        for batch in batches:
            found: tuple[list, list, list] = ([], [], [])
            for j, (text, items) in enumerate(zip(batch.column("text").to_pylist(), batch.column("items").to_pylist())):
                counts = Counter(terms(text or ""))
                n = sum(counts.values())
                m = _length_factor(n, w)
                part = {number[t]: int(w.weight[number[t]]) * _saturated(counts[t], m) for t in counts.keys() & number.keys()}
                for item in items:
                    found[0].append(item)
                    found[1].append(j)
                    found[2].append(sum(part.get(t, 0) for t in queries.of[item].tolist()))
            yield pa.RecordBatch.from_arrays([
                pa.array(found[0], pa.int32()), batch.column("doc_id").take(pa.array(found[1], pa.int64())), pa.array(found[2], pa.int64())],
                names=["item", "doc_id", "score"])

    return picked.mapInArrow(score, f"item int, doc_id {id_type}, score long")


def _answer(docs: DataFrame, queries: Queries, top: int) -> DataFrame | None:
    """The ranking of one bounded set of items; None if nothing can score."""
    spark = docs.sparkSession
    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"item int, doc_id {id_type}, mark long, bound long"
    with arrow_rows(spark, TEXT_ROWS):
        index = stored(signatures(docs, queries), "search-index")
    w = _weights(index, queries)
    if w is None:
        return None
    blocks = index.where("slices is not null").select("doc_ids", "marks", "lengths", "slices")
    with arrow_rows(spark, BLOCK_ROWS):
        leading = _leading(blocks, queries, w, top, schema).collect()  # at most ``top`` rows per item
    if not leading:
        return None
    first = spark.createDataFrame([(r["item"], r["doc_id"], r["mark"]) for r in leading], f"item int, doc_id {id_type}, mark long")
    with arrow_rows(spark, TEXT_ROWS):
        best = Window.partitionBy("item").orderBy(F.desc("score"))
        exact = _rescored(docs, first, queries, w, small=True).withColumn("nth", F.row_number().over(best)).where(
            F.col("nth") == top).collect()  # one row per item at most
    least = np.ones(len(queries.ids), np.int64)
    for r in exact:
        least[r["item"]] = max(1, r["score"])
    with arrow_rows(spark, BLOCK_ROWS):
        pairs = stored(_possible(blocks, queries, w, least, schema).drop("bound").distinct(), "search-possible")
    small = pairs.count() <= SMALL
    with arrow_rows(spark, TEXT_ROWS):
        scores = stored(_rescored(docs, pairs, queries, w, small).where("score > 0"), "search-scores")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("item", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """item_id, rank, doc_id and score: the ``top`` documents of every item with a score above 0.

    Every document is signed once per ITEMS items, and no block is skipped: a document is left out only if its upper
    bound is below the exact score of ``top`` others. Repeated documents are ranked one by one, equal scores by doc_id
    (null last); every row of ``items`` is answered, also with a repeated or null item_id. A null or empty text, or one
    without terms, has none. Empty tables give no rows; other columns are not read.
    """
    spark = docs.sparkSession
    schema = f"item_id {items.schema['item_id'].dataType.simpleString()}, rank int, doc_id {docs.schema['doc_id'].dataType.simpleString()}, score long"
    parts = -(-items.count() // ITEMS)
    answers = []
    for part in range(parts):
        chosen = items if parts == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part)
        queries = _queries(chosen.select("item_id", "text").collect())  # about ITEMS rows
        ranked = _answer(docs, queries, top) if queries.terms else None
        if ranked is not None:
            names = spark.createDataFrame(list(enumerate(queries.ids)), f"of_item int, {schema.split(',')[0]}")
            answers.append(ranked.join(F.broadcast(names), F.col("item") == F.col("of_item")).select("item_id", "rank", "doc_id", "score"))
    if not answers:
        return spark.createDataFrame([], schema)
    out = answers[0]
    for more in answers[1:]:
        out = out.unionByName(more)
    return out
