"""Substring dedup: passages that repeat across documents, found in suffix trees split by variable-length prefixes.

A window of WINDOW words always holds one of the text's anchors: the runs of PREFIX words whose hash is least among all
such runs of some window. Equal windows have their anchor at the same place, so only suffixes that start at anchors are
sorted, one in about eighteen. Suffixes with the same first PREFIX words make one subtree, and several small subtrees one
memory-sized unit of work. Where more than LEAVES suffixes share these words, the prefix is taken as long as the whole
window: what shares it is then a single deep node, and its least document is an aggregate that needs no memory.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluxgauge.llm.common import TEXT_ROWS, TermHashes, arrow_rows, stored

WINDOW = 50
PREFIX = 16
LEAVES = 4096     # suffixes of one unit of work
_BASE, _MIX = 0x9E3779B97F4A7C15 | 1, np.uint64(0xBF58476D1CE4E5B9)


def words(text: str) -> list[bytes]:
    """Runs of anything but ASCII white space, unchanged."""
    return text.encode("utf-8").split()


class _Powers:
    """Powers of an odd base modulo 2^64, and of its inverse, as far as they were needed."""

    def __init__(self) -> None:
        self.up, self.down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            self.up, self.down = (np.multiply.accumulate(np.array([1] + [b] * (n - 1), np.uint64)) for b in (_BASE, pow(_BASE, -1, 1 << 64)))
        return self.up[:n], self.down[:n]


def anchors(hashes: np.ndarray, powers: _Powers, window: int, prefix: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Place and prefix hash of every anchor, and the first and last window it stands for."""
    n = len(hashes)
    if n < window:
        return (np.empty(0, np.int64),) * 4
    up, down = powers(n)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * up, dtype=np.uint64)])
    runs = (total[prefix:] - total[:-prefix]) * down[:n - prefix + 1]
    runs = (runs ^ (runs >> np.uint64(29))) * _MIX
    runs ^= runs >> np.uint64(32)
    least = np.lib.stride_tricks.sliding_window_view(runs, window - prefix + 1).argmin(axis=1) + np.arange(n - window + 1)
    first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    last = np.concatenate([first[1:], [len(least)]]) - 1
    return least[first], runs[least[first]].view(np.int64), first, last


def _key(text: Column) -> Column:
    """128 bits that tell texts apart."""
    return F.substring(F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)), 1, 16)


def _digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def _hash_words(tokens: list[bytes], known: TermHashes) -> np.ndarray:
    return np.fromiter(map(known.__getitem__, tokens), np.uint64, len(tokens))


def _scanned(docs: DataFrame, window: int, prefix: int) -> DataFrame:
    """doc_id, key, n_words, the digest of all words joined by one space, and the distinct prefix hashes of the anchors."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def scan(batches):
        known, powers = TermHashes(), _Powers()
        for batch in batches:
            counts, digests, found = [], [], []
            for text in batch.column("text").to_pylist():
                tokens = words(text or "")
                counts.append(len(tokens))
                digests.append(hashlib.sha256(b" ".join(tokens)).hexdigest())
                found.append(np.unique(anchors(_hash_words(tokens, known), powers, window, prefix)[1]) if len(tokens) >= window else [])
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), batch.column("key"), pa.array(counts, pa.int64()), pa.array(digests, pa.string()),
                pa.array(found, pa.list_(pa.int64()))], names=["doc_id", "key", "n_words", "words_sha256", "anchors"])

    return docs.select("doc_id", _key(F.col("text")).alias("key"), "text").mapInArrow(
        scan, f"doc_id {id_type}, key binary, n_words long, words_sha256 string, anchors array<long>")


def _suffixes(texts: DataFrame, window: int, prefix: int) -> DataFrame:
    """For every text the suffixes at its shared anchors, with as many words around as the anchor's windows cover: the
    prefix hash, a digest ``leaf`` of these words, ``before`` (words before the anchor), the words, and the places."""
    lead_type = texts.schema["lead"].dataType.simpleString()

    def cut(batches):
        known, powers = TermHashes(), _Powers()
        for batch in batches:
            out: dict[str, list] = {c: [] for c in ("prefix", "leaf", "before", "words", "places", "of")}
            for i, (text, live) in enumerate(zip(batch.column("text").to_pylist(), batch.column("live").to_pylist())):
                tokens, leaves = words(text), {}
                at, runs, first, last = anchors(_hash_words(tokens, known), powers, window, prefix)
                for k in np.flatnonzero(np.isin(runs, np.array(live, np.int64))).tolist():
                    around = b" ".join(tokens[first[k]:last[k] + window])
                    before = int(at[k] - first[k])
                    leaves.setdefault((int(runs[k]), before, around), []).append(int(at[k]))
                for (run, before, around), places in leaves.items():
                    for name, value in zip(out, (run, _digest(b"%d " % before + around), before, around.decode("utf-8"), places, i)):
                        out[name].append(value)
            of = pa.array(out.pop("of"), pa.int64())
            kinds = (pa.int64(), pa.binary(), pa.int32(), pa.string(), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("key").take(of), batch.column("lead").take(of), *(pa.array(v, t) for v, t in zip(out.values(), kinds))],
                names=["key", "lead", *out])

    return texts.select("key", "lead", "text", "live").mapInArrow(
        cut, f"key binary, lead {lead_type}, prefix long, leaf binary, before int, words string, places array<int>")


def subtree(rows: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffix tree of the rows of word numbers, group by group: the leaves' order, and for every two neighbours the
    depth of the node where they part (-1 between groups). An internal node of depth d is a run of neighbours that part at
    d or deeper."""
    even = rows if rows.shape[1] % 2 == 0 else np.pad(rows, ((0, 0), (0, 1)))
    wide = (even[:, ::2].astype(np.uint64) << np.uint64(32)) | even[:, 1::2].astype(np.uint64)
    order = np.lexsort((*wide.T[::-1], group))
    same = rows[order[1:]] == rows[order[:-1]]
    depth = np.where(same.all(axis=1), rows.shape[1], same.argmin(axis=1))
    return order, np.where(group[order[1:]] == group[order[:-1]], depth, -1)


def _nodes(order: np.ndarray, depth: np.ndarray, least: int) -> np.ndarray:
    """For every leaf the number of the node of depth ``least`` or deeper that it hangs on."""
    out = np.empty(len(order), np.int64)
    out[order] = np.concatenate([[0], np.cumsum(depth < least)])
    return out


def repeated_windows(tokens: list[list[bytes]], before: np.ndarray, group: np.ndarray, lead: np.ndarray, window: int, prefix: int) -> np.ndarray:
    """For every leaf a set of bits: bit j is set if its window that starts j words before the anchor is also a leaf's with
    a smaller ``lead``.

    Two leaves share that window if they hang on one node of depth ``window - j`` in the tree of their suffixes and on
    one node of depth j in the tree of the words before the anchor, read backwards. Deep nodes of both trees together are
    the maximal repeats around the anchor.
    """
    reach, numbers = window - prefix, {}
    after, back = np.zeros((len(tokens), window), np.int32), np.zeros((len(tokens), reach), np.int32)
    for i, (row, b) in enumerate(zip(tokens, before.tolist())):
        ids = [numbers.setdefault(t, len(numbers) + 1) for t in row]
        right = ids[b:b + window]
        after[i, :len(right)] = right
        back[i, :b] = ids[:b][::-1]
    least = before - (np.array([len(row) for row in tokens]) - window)  # the words end with the anchor's last window
    forwards, backwards = subtree(after, group), subtree(back, group)
    found = np.zeros(len(tokens), np.int64)
    for j in range(reach + 1):
        there = np.flatnonzero((least <= j) & (j <= before))
        if len(there) > 1:
            pair = _nodes(*forwards, window - j)[there] * len(tokens) + _nodes(*backwards, j)[there]
            _, node = np.unique(pair, return_inverse=True)
            smallest = np.full(node.max() + 1, np.iinfo(np.int64).max)
            np.minimum.at(smallest, node, lead[there])
            found[there] |= (lead[there] > smallest[node]).astype(np.int64) << j
    return found


def _in_subtrees(leaves: DataFrame, window: int, prefix: int) -> DataFrame:
    """leaf and found of all leaves in subtrees of at most LEAVES, several subtrees at a time."""
    unit = LEAVES

    def grow(batches):
        kept: list[tuple] = []

        def judged():
            tokens = [words(r[3]) for r in kept]
            _, group = np.unique(np.array([r[0] for r in kept], np.int64), return_inverse=True)
            _, lead = np.unique(np.array([r[4] for r in kept]), return_inverse=True)
            found = repeated_windows(tokens, np.array([r[2] for r in kept], np.int64), group, lead, window, prefix)
            return pa.RecordBatch.from_pydict({"leaf": pa.array([r[1] for r in kept], pa.binary()), "found": pa.array(found, pa.int64())})

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("prefix", "leaf", "before", "words", "first"))):
                if len(kept) >= unit and row[0] != kept[-1][0]:
                    yield judged()
                    kept = []
                kept.append(row)
        if kept:
            yield judged()

    tasks = int(leaves.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = leaves.repartition(tasks, "prefix").sortWithinPartitions("prefix")
    return dealt.select("prefix", "leaf", "before", "words", "first").mapInArrow(grow, "leaf binary, found long").where("found != 0")


def _in_long_prefixes(leaves: DataFrame, window: int) -> DataFrame:
    """leaf and found of all leaves whose prefix more than LEAVES share: by prefixes as long as the window."""
    first_type = leaves.schema["first"].dataType.simpleString()

    def extend(batches):
        for batch in batches:
            out: tuple[list, list, list] = ([], [], [])
            for i, (before, text) in enumerate(zip(batch.column("before").to_pylist(), batch.column("words").to_pylist())):
                tokens = words(text)
                for start in range(len(tokens) - window + 1):
                    out[0].append(_digest(b" ".join(tokens[start:start + window])))
                    out[1].append(before - start)
                    out[2].append(i)
            of = pa.array(out[2], pa.int64())
            yield pa.RecordBatch.from_arrays([
                pa.array(out[0], pa.binary()), pa.array(out[1], pa.int32()), batch.column("leaf").take(of), batch.column("first").take(of)],
                names=["node", "j", "leaf", "first"])

    windows = leaves.select("leaf", "before", "words", "first").mapInArrow(extend, f"node binary, j int, leaf binary, first {first_type}")
    least = windows.groupBy(F.col("node").alias("of_node")).agg(F.min("first").alias("least"))
    later = windows.join(least, F.col("node") == F.col("of_node")).where("first > least")
    return later.groupBy("leaf").agg(F.bit_or(F.expr("shiftleft(1L, j)")).alias("found"))


def _cut_texts(texts: DataFrame, window: int, prefix: int) -> DataFrame:
    """key, spans and kept of texts with ``hits``: pairs of a place and the set of windows before it that repeat."""
    def cut(batches):
        for batch in batches:
            spans, kept = [], []
            for text, hits in zip(batch.column("text").to_pylist(), batch.column("hits").to_pylist()):
                tokens = words(text)
                starts = np.zeros(len(tokens) + window, np.int64)
                place = np.concatenate([np.array(h["places"], np.int64) for h in hits])
                found = np.repeat(np.array([h["found"] for h in hits], np.int64), [len(h["places"]) for h in hits])
                for j in range(window - prefix + 1):
                    starts[place[(found >> j) & 1 == 1] - j] = 1
                total = np.concatenate([np.zeros(window, np.int64), np.cumsum(starts)])
                covered = (total[window:] - total[:-window])[:len(tokens)] > 0
                edges = np.flatnonzero(np.diff(np.concatenate([[False], covered, [False]]).astype(np.int8)))
                spans.append([{"start": int(a), "end": int(b)} for a, b in edges.reshape(-1, 2)])
                kept.append(b" ".join(t for t, c in zip(tokens, covered.tolist()) if not c).decode("utf-8"))
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(spans, kind), pa.array(kept, pa.string())], names=["key", "spans", "kept"])

    return texts.mapInArrow(cut, "key binary, spans array<struct<start:long,end:long>>, kept string")


def repeats(docs: DataFrame, window: int = WINDOW, prefix: int = PREFIX) -> DataFrame:
    """doc_id, key, n_words, spans, kept, words_sha256: of every row the word ranges [start, end) that are covered by a
    window whose words also start in a document with a smaller doc_id, and the text that is left (null where nothing goes;
    then words_sha256 is the digest of all words joined by one space).

    A row whose whole text also stands in a document with a smaller doc_id goes as a whole if it has a window at all; so
    only one text of every group of copies is looked into. Texts shorter than the window, empty and null ones lose nothing.
    Rows without doc_id neither lose words nor take any; rows that share a doc_id take nothing from each other. Repeats
    within one document stay. An empty table gives no rows; other columns are not read. ``window`` - ``prefix`` must be
    below 63.
    """
    spark = docs.sparkSession
    with arrow_rows(spark, TEXT_ROWS):
        scan = stored(_scanned(docs, window, prefix), "repeats-scan")
    leads = stored(scan.groupBy("key").agg(F.min("doc_id").alias("lead"), F.max(F.size("anchors")).alias("anchored")), "repeats-leads")

    leading = leads.where("lead is not null and anchored > 0").select(F.col("key").alias("of_key"), "lead")
    once = scan.select("key", "doc_id", "anchors").join(leading, (F.col("key") == F.col("of_key")) & (F.col("doc_id") == F.col("lead")))
    places = once.select("key", "lead", F.explode("anchors").alias("prefix"))
    mark = F.xxhash64("key")  # may agree for two texts of 2^64; then a shared passage of these two alone is looked for in vain
    shared = places.groupBy(F.col("prefix").alias("live")).agg(F.min(mark).alias("a"), F.max(mark).alias("b")).where("a < b").select("live")
    live = places.join(shared, F.col("prefix") == F.col("live"), "left_semi").groupBy(F.col("key").alias("of_key"), "lead").agg(
        F.collect_set("prefix").alias("live"))
    whole = docs.select("doc_id", "text", _key(F.col("text")).alias("key"))
    with arrow_rows(spark, TEXT_ROWS):
        texts = stored(whole.join(live, (F.col("key") == F.col("of_key")) & (F.col("doc_id") == F.col("lead"))).dropDuplicates(
            ["key", "doc_id"]).select("key", "lead", "text", "live"), "repeats-texts")
        suffixes = stored(_suffixes(texts, window, prefix), "repeats-suffixes")

    leaves = stored(suffixes.groupBy("leaf", "prefix").agg(
        F.min("lead").alias("first"), F.first("before").alias("before"), F.first("words").alias("words")), "repeats-leaves")
    crowd = leaves.groupBy(F.col("prefix").alias("of_prefix")).agg(F.count("*").alias("leaves")).where("leaves > 1")
    grown = leaves.join(crowd, F.col("prefix") == F.col("of_prefix"))
    found = stored(_in_subtrees(grown.where(F.col("leaves") <= LEAVES), window, prefix).unionByName(
        _in_long_prefixes(grown.where(F.col("leaves") > LEAVES), window)), "repeats-found")

    judged = leaves.select(F.col("leaf").alias("of_leaf"), "first").join(found, F.col("of_leaf") == F.col("leaf"), "left").select("of_leaf", "first", "found")
    every = F.lit((1 << (window - prefix + 1)) - 1)  # all windows of the leaf; bits beyond its own are taken off below
    own = F.expr(f"(shiftleft(1L, before + 1) - 1) & ~(shiftleft(1L, before - (n - {window})) - 1)")
    hits = suffixes.select("key", "lead", "leaf", "before", "places", F.size(F.split("words", " ")).alias("n")).join(
        judged, F.col("leaf") == F.col("of_leaf")).withColumn(
        "found", F.when(F.col("lead") > F.col("first"), every).otherwise(F.coalesce("found", F.lit(0))).bitwiseAND(own)).where("found != 0")
    of_text = hits.groupBy(F.col("key").alias("of_key")).agg(F.collect_list(F.struct("places", "found")).alias("hits"))
    with arrow_rows(spark, TEXT_ROWS):
        cut = stored(_cut_texts(texts.join(of_text, F.col("key") == F.col("of_key")).select("key", "text", "hits"), window, prefix), "repeats-cut")

    rows = scan.drop("anchors").join(leads.select(F.col("key").alias("lead_key"), "lead"), F.col("key") == F.col("lead_key")).join(
        cut.select(F.col("key").alias("cut_key"), F.col("spans").alias("cut_spans"), F.col("kept").alias("cut_kept")), F.col("key") == F.col("cut_key"), "left")
    copy = (F.col("doc_id") > F.col("lead")) & (F.col("n_words") >= window)
    itself = F.col("doc_id") == F.col("lead")
    none = F.array().cast("array<struct<start:long,end:long>>")
    return rows.select(
        "doc_id", "key", "n_words",
        F.when(copy, F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_words").alias("end")))).when(
            itself, F.coalesce("cut_spans", none)).otherwise(none).alias("spans"),
        F.when(copy, F.lit("")).when(itself, F.col("cut_kept")).alias("kept"), "words_sha256")


def strip(docs: DataFrame, window: int = WINDOW, prefix: int = PREFIX) -> DataFrame:
    """All documents with all columns; a text that loses words is replaced by what is left of it, others stay as they are."""
    changed = repeats(docs, window, prefix).where("kept is not null").select(
        F.col("doc_id").alias("of_id"), F.col("key").alias("of_key"), "kept").dropDuplicates(["of_id", "of_key"])
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), _key(F.col("text")).alias("key"))
    joined = packed.join(changed, (F.col("row.doc_id") == F.col("of_id")) & (F.col("key") == F.col("of_key")), "left")
    return joined.select(F.col("row").withField("text", F.coalesce("kept", "row.text")).alias("row")).select("row.*")
