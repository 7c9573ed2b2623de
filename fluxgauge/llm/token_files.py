"""Token ids in binary shard files, with a minimal perfect hash index for keyed access."""

from __future__ import annotations

import os
import re
import uuid
from array import array
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fluxgauge.llm.common import stored, text_batches
from fluxgauge.session import scratch

END_ID = 2
SHARD_BYTES = 32 << 20   # text per shard
KEYS_PER_PART = 50_000   # keys of one index part: a part is built and read by one task
GAMMA = 2                # bits per key and level of the index
CACHED = 3 << 18         # units whose ids a worker remembers, about
LONGEST = 48             # and only those of so many characters: longer ones are encoded each time they come
TOGETHER = 1000          # units that the library sees as one text
SPACE = "\u0120"         # fixed value: the byte-level form of a space
ODD = re.compile(r" (?:\s|\Z)")
BETWEEN = re.compile(r" (?=\S)")
MARKS = ",.;:!?"
MAGIC = b"FGTOKENS"
HEADER = 16              # magic, then the width of an id in bytes as a 64-bit integer


# ---------------------------------------------------------------- encoding

class Coder:
    """Whole texts to ids with the tokenizers library, which sees every distinct unit between spaces once.

    A text falls into units that the byte-level pre-tokenizer never joins: at every space before something that is no white
    space. Other white space stays with the unit before it. A text with a special token goes to the library whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.type = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
        self.code = "H" if self.type.itemsize == 2 else "I"
        self.spaced = np.zeros(self.library.get_vocab_size(), bool)
        self.spaced[[i for token, i in self.library.get_vocab(with_added_tokens=False).items() if token[0] == SPACE]] = True
        self.units: dict[str, bytes] = {}

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [array(self.code, e.ids).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _units(self, pieces: list[str]) -> list[bytes]:
        """Ids of ' ' + piece for each piece. Many pieces without a space are encoded as one text: a unit begins at every
        token that begins with a space, as there is no other."""
        if any(" " in p for p in pieces):
            return self._ids([" " + p for p in pieces])
        out: list[bytes] = []
        groups = [pieces[at:at + TOGETHER] for at in range(0, len(pieces), TOGETHER)]
        joined = self.library.encode_batch_fast([" " + " ".join(g) for g in groups], add_special_tokens=False)
        for group, encoding in zip(groups, joined):
            ids = np.array(encoding.ids, self.type)
            starts = (np.flatnonzero(self.spaced[ids]) * self.type.itemsize).tolist()
            if len(starts) != len(group):
                raise ValueError("a unit does not begin with one token that begins with a space")
            raw = ids.tobytes()
            out += [raw[a:b] for a, b in zip(starts, [*starts[1:], len(raw)])]
        return out

    def _learn(self, pieces: set[str]) -> None:
        """Ids of ' ' + piece. Letters with a mark behind them are two pre-tokens, so the letters are learned alone."""
        marked = {p for p in pieces if p[-1] in MARKS and p[:-1].isalpha()}
        stems = list({p[:-1] for p in marked}.difference(self.units) | (pieces - marked))
        odd = [p for p in stems if " " in p]
        self.units.update(zip(odd, self._units(odd)))
        plain = [p for p in stems if " " not in p] if odd else stems
        self.units.update(zip(plain, self._units(plain)))
        mark = dict(zip(MARKS, self._ids(list(MARKS))))
        self.units.update((p, self.units[p[:-1]] + mark[p[-1]]) for p in marked)

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.units) > CACHED:
            self.units.clear()
        special = [any(s in text for s in self.special) for text in texts]
        split = [BETWEEN.split(text) if ODD.search(text) else text.split(" ") for text in texts]
        firsts = self._ids([text if whole else pieces[0] for text, pieces, whole in zip(texts, split, special)])
        rest = [() if whole else pieces[1:] for pieces, whole in zip(split, special)]
        new = set().union(*rest).difference(self.units)
        self._learn(new)
        out = [first + b"".join(map(self.units.__getitem__, pieces)) for first, pieces in zip(firsts, rest)]
        for piece in new:
            if len(piece) > LONGEST:
                self.units.pop(piece, None)
                self.units.pop(piece[:-1], None)  # what was learned for its letters alone
        return out


@lru_cache(maxsize=2)
def coder(path: str) -> Coder:
    return Coder(path)


def write_shards(docs: DataFrame, vocab: str, folder: str, end_id: int = END_ID) -> DataFrame:
    """Write the ids of all documents in ascending doc_id order; returns where each one lies.

    One row per document: doc_id, copy (0, 1, ... for rows that share a doc_id), shard, file, offset and n_tokens in
    ids. Shards are ranges of doc_id; each ends with ``end_id`` after every document. A file is written by one task
    attempt under a name of its own and counts only if the attempt's rows do, so a repeated or lost attempt leaves a file
    nobody refers to. ``folder`` must be a place that pyarrow opens on every executor.
    """
    text_batches(docs.sparkSession)
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    ordered = docs.select("doc_id", "text").repartitionByRange(max(1, -(-size // SHARD_BYTES)), "doc_id") \
        .sortWithinPartitions("doc_id", F.xxhash64("text"))

    def write(batches):
        shard = TaskContext.get().partitionId()
        file = f"{folder}/shard-{shard:06d}-{uuid.uuid4().hex}.bin"
        code = coder(vocab)
        end = np.array([end_id], code.type).tobytes()
        out, offset, copy, last = None, 0, 0, object()
        try:
            for batch in batches:
                if out is None:
                    system, path = FileSystem.from_uri(file)
                    system.create_dir(os.path.dirname(path), recursive=True)
                    out = system.open_output_stream(path)
                    out.write(MAGIC + code.type.itemsize.to_bytes(8, "little"))
                copies, offsets, sizes = [], [], []
                for doc_id, ids in zip(batch.column("doc_id").to_pylist(), code.encode([t or "" for t in batch.column("text").to_pylist()])):
                    copy = copy + 1 if doc_id == last else 0
                    last = doc_id
                    out.write(ids + end)
                    n = len(ids) // code.type.itemsize + 1
                    copies.append(copy)
                    offsets.append(offset)
                    sizes.append(n)
                    offset += n
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch.column("doc_id"), "copy": pa.array(copies, pa.int64()), "shard": pa.array([shard] * len(sizes), pa.int32()),
                    "file": pa.array([file] * len(sizes)), "offset": pa.array(offsets, pa.int64()), "n_tokens": pa.array(sizes, pa.int64())})
        finally:
            if out is not None:
                out.close()

    return stored(ordered.mapInArrow(write, T.StructType([docs.schema["doc_id"]]).add("copy", "long").add("shard", "integer")
                                     .add("file", "string").add("offset", "long").add("n_tokens", "long")), "token-rows")


# ---------------------------------------------------------------- index

def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose output bits all depend on all input bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hash(doc_id: pd.Series, copy: pd.Series, seed: int) -> np.ndarray:
    """A hash of the key (doc_id, copy) that is independent for every seed; a null doc_id is a key as well."""
    null = doc_id.isna().to_numpy()
    word = doc_id.astype("Int64").fillna(0).to_numpy(np.int64).astype(np.uint64)
    second = copy.to_numpy(np.int64).astype(np.uint64) * np.uint64(2) + null.astype(np.uint64)
    step = _mix(np.array([seed + 1], np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    with np.errstate(over="ignore"):
        return _mix(_mix(word + step) ^ (second * np.uint64(0x9E3779B97F4A7C15) + step))


def build_levels(doc_id: pd.Series, copy: pd.Series) -> tuple[list[np.ndarray], np.ndarray]:
    """Bit arrays of a minimal perfect hash, and each key's slot.

    On every level the keys left over hash into a bit array; a key that is alone at its bit ends there, the others go
    one level down. A key's slot is the number of set bits before its own.
    """
    left = np.arange(len(doc_id))
    slot = np.full(len(doc_id), -1)
    levels, used = [], 0
    while len(left):
        size = max(64, GAMMA * len(left))
        at = (_hash(doc_id.iloc[left], copy.iloc[left], len(levels)) % np.uint64(size)).astype(np.int64)
        alone = np.bincount(at, minlength=size) == 1
        done = alone[at]
        slot[left[done]] = used + (np.cumsum(alone) - 1)[at[done]]
        levels.append(alone)
        used += int(alone.sum())
        left = left[~done]
    return levels, slot


def find_slots(levels: list[np.ndarray], doc_id: pd.Series, copy: pd.Series) -> np.ndarray:
    """Slots of any keys; -1 where no level has a bit. A key that isn't in the index may get another key's slot."""
    left, slot, used = np.arange(len(doc_id)), np.full(len(doc_id), -1), 0
    for level, bits in enumerate(levels):
        at = (_hash(doc_id.iloc[left], copy.iloc[left], level) % np.uint64(len(bits))).astype(np.int64)
        hit = bits[at]
        slot[left[hit]] = used + (np.cumsum(bits) - 1)[at[hit]]
        used += int(bits.sum())
        left = left[~hit]
    return slot


FINGERPRINT_SEED = 1 << 20


def _part(parts: int) -> Column:
    return F.pmod(F.xxhash64("doc_id", "copy"), F.lit(parts)).cast("int")


def build_index(rows: DataFrame) -> DataFrame:
    """One row per part of the keys: bit arrays, and by slot a 32-bit fingerprint, shard, offset and number of ids."""
    parts = max(1, -(-rows.count() // KEYS_PER_PART))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        levels, slot = build_levels(pdf["doc_id"], pdf["copy"])
        order = np.argsort(slot)
        mark = _hash(pdf["doc_id"], pdf["copy"], FINGERPRINT_SEED).astype(np.uint32)
        column = lambda name, kind: pdf[name].to_numpy(kind)[order].tobytes()
        return pd.DataFrame([{
            "part": pdf["part"].iloc[0], "parts": parts,
            "sizes": [len(bits) for bits in levels], "bits": [np.packbits(bits).tobytes() for bits in levels],
            "fingerprint": mark[order].tobytes(), "shard": column("shard", "<i4"), "offset": column("offset", "<i8"),
            "n_tokens": column("n_tokens", "<i8")}])

    return stored(rows.select("doc_id", "copy", "shard", "offset", "n_tokens", _part(parts).alias("part")).groupBy("part").applyInPandas(
        build, "part int, parts int, sizes array<long>, bits array<binary>, fingerprint binary, shard binary, offset binary, n_tokens binary"),
        "token-index")


def locate(keys: DataFrame, index: DataFrame) -> DataFrame:
    """Shard, offset and number of ids of every key (doc_id, copy) that the index has; others are left out.

    Each key costs one hash per level and one look at its slot. A key outside the index is told by its fingerprint, but
    for one in four billion.
    """
    head = index.select("parts").first()
    parts = head[0] if head else 1

    def look(keys: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        out = keys[["doc_id", "copy"]]
        if not len(found) or not len(keys):
            return pd.DataFrame({"doc_id": out["doc_id"][:0], "copy": out["copy"][:0], "shard": [], "offset": [], "n_tokens": []})
        row = found.iloc[0]
        levels = [np.unpackbits(np.frombuffer(b, np.uint8), count=n).astype(bool) for b, n in zip(row["bits"], row["sizes"])]
        slot = find_slots(levels, keys["doc_id"], keys["copy"])
        same = np.frombuffer(row["fingerprint"], "<u4")[slot] == _hash(keys["doc_id"], keys["copy"], FINGERPRINT_SEED).astype(np.uint32)
        there = (slot >= 0) & same
        read = lambda name, kind: np.frombuffer(row[name], kind)[slot[there]]
        return out[there].assign(shard=read("shard", "<i4"), offset=read("offset", "<i8"), n_tokens=read("n_tokens", "<i8"))

    schema = T.StructType([keys.schema["doc_id"]]).add("copy", "long").add("shard", "integer").add("offset", "long").add("n_tokens", "long")
    return keys.select("doc_id", "copy", _part(parts).alias("part")).groupBy("part").cogroup(
        index.groupBy("part")).applyInPandas(look, schema)


def read_ids(located: DataFrame, rows: DataFrame) -> DataFrame:
    """The ids of located documents, read from the shard files: doc_id, copy, shard, offset, n_tokens, ids (32 bits each)."""
    text_batches(located.sparkSession)
    files = rows.select("shard", "file").distinct()
    placed = located.join(files, "shard").repartition("shard").sortWithinPartitions("shard", "offset")

    def read(batches):
        opened, source, width = None, None, 0
        for batch in batches:
            ids = []
            for file, offset, n in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "n_tokens"))):
                if file != opened:
                    system, path = FileSystem.from_uri(file)
                    source, opened = system.open_input_file(path), file
                    head = source.read_at(HEADER, 0)
                    if head[:8] != MAGIC:
                        raise ValueError(f"{file} is no shard of token ids")
                    width = int.from_bytes(head[8:], "little")
                raw = source.read_at(n * width, HEADER + offset * width)
                ids.append(np.frombuffer(raw, f"<u{width}").astype("<u4").tobytes())
            yield pa.RecordBatch.from_pydict({
                **{c: batch.column(c) for c in ("doc_id", "copy", "shard", "offset", "n_tokens")}, "ids": pa.array(ids, pa.binary())})

    schema = T.StructType([located.schema["doc_id"]]).add("copy", "long").add("shard", "integer").add("offset", "long") \
        .add("n_tokens", "long").add("ids", "binary")
    return placed.select("doc_id", "copy", "shard", "offset", "n_tokens", "file").mapInArrow(read, schema)


def write_and_read(docs: DataFrame, vocab: str, folder: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Write all documents' ids, index them, and read every document back through the index.

    Returns doc_id, start (ids of all documents before it), n_tokens (with the end id), ids (32-bit little-endian
    integers), shard and offset. A null text counts as empty and has the end id alone. Rows that share a doc_id are all
    kept, in an order of their own; null ids come first. An empty table gives no rows. Other columns are not read.
    """
    folder = folder or scratch(docs.sparkSession, "token-shards")
    rows = write_shards(docs, vocab, folder, end_id)
    index = build_index(rows)
    keys = docs.groupBy("doc_id").agg(F.count("*").alias("n")).select(
        "doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("copy"))
    found = read_ids(locate(keys, index), rows)
    before = Window.orderBy("of_shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = rows.groupBy(F.col("shard").alias("of_shard")).agg(F.sum("n_tokens").alias("n")).select(
        "of_shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))  # one row per shard file
    return found.join(shards, F.col("shard") == F.col("of_shard")).select(
        "doc_id", (F.col("base") + F.col("offset")).alias("start"), "n_tokens", "ids", "shard", "offset")
