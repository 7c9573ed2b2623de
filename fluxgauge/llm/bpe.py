"""Byte-level BPE as a streaming transducer with bounded lookahead, and its inverse."""

from __future__ import annotations

import codecs
import heapq
import json
from array import array
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from fluxgauge.llm.common import text_batches

# The pre-tokenizer's pattern, and the classes a run of it can be made of.
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
RUNS = tuple(regex.compile(p) for p in (r"\p{L}+", r"\p{N}+", r"\s+", r"[^\s\p{L}\p{N}]+"))
CONTRACTION = 3        # characters the longest contraction looks at
SPAN = 1 << 16         # characters the pre-tokenizer looks at together
CACHED = 1 << 18       # units, and words, whose ids a worker remembers


def byte_alphabet() -> dict[str, int]:
    """The vocabulary writes printable Latin-1 bytes as themselves and all others as characters from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Merges:
    """Vocabulary, merge list, and the lookahead that the merge list needs."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        alphabet = byte_alphabet()
        encoded = spec["model"]["vocab"]
        self.bytes_of = {i: bytes(alphabet[c] for c in token) for token, i in encoded.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of.update({i: content.encode() for content, i in self.special.items()})
        self.byte_id = [0] * 256
        for c, b in alphabet.items():
            self.byte_id[b] = encoded[c]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.order = {(encoded[left], encoded[right]): r for r, (left, right) in enumerate(pairs)}
        self.merged = [encoded[left + right] for left, right in pairs]
        self.lookahead = self._sufficient_lookahead()

    def _sufficient_lookahead(self) -> int:
        """Bytes after a token that can still change it.

        In order of rank: whether (u, v) merges depends on u and v standing there at that time. v may have been formed
        or eaten by an earlier rule (v, y), which depends on y's bytes and on what y depends on. ``formed`` and ``eaten``
        carry the greatest such reach to the right of a token's end; the greatest of all tokens is sufficient.
        """
        length = {i: len(b) for i, b in self.bytes_of.items()}
        formed, eaten = dict.fromkeys(length, 0), dict.fromkeys(length, 0)
        for (u, v), t in zip(sorted(self.order, key=self.order.get), self.merged):
            right = max(formed[v], eaten[v])
            formed[t] = max(formed[t], right, max(formed[u], eaten[u]) - length[v])
            eaten[u] = max(eaten[u], length[v] + right)
        return max(max(formed[i], eaten[i]) for i in length)

    def merge(self, data: bytes) -> list[int]:
        """The tokens of one pre-token: the lowest-ranked pair merges first, the leftmost of equals."""
        ids = [self.byte_id[b] for b in data]
        if len(ids) > 48:
            return self._merge_long(ids)
        rank, merged, none = self.order.get, self.merged, len(self.merged)
        ranks = [rank(pair, none) for pair in zip(ids, ids[1:])]
        while ranks:
            best = min(ranks)
            if best == none:
                break
            i = ranks.index(best)
            ids[i:i + 2] = [merged[best]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank((ids[i - 1], ids[i]), none)
            if i < len(ranks):
                ranks[i] = rank((ids[i], ids[i + 1]), none)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        n, rank = len(ids), self.order.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := rank((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            best, i, a, b = heapq.heappop(heap)
            j = after[i] if ids[i] == a else n
            if j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = self.merged[best], -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for left in (before[i], i):
                right = after[left] if left >= 0 else n
                if right < n and (r := rank((ids[left], ids[right]))) is not None:
                    heapq.heappush(heap, (r, left, ids[left], ids[right]))
        return [i for i in ids if i >= 0]


class Transducer:
    """Encodes one pre-token that arrives in pieces; emits every token once no later byte can change it."""

    def __init__(self, merges: Merges):
        self.merges = merges
        self.held = b""
        self.window = max(1024, 4 * merges.lookahead)

    def push(self, data: bytes) -> list[int]:
        out: list[int] = []
        for at in range(0, len(data), self.window):
            self.held += data[at:at + self.window]
            if len(self.held) >= self.window:
                out += self._stable(len(self.held) - self.merges.lookahead)
        return out

    def close(self) -> list[int]:
        ids, self.held = self.merges.merge(self.held), b""
        return ids

    def _stable(self, limit: int) -> list[int]:
        out, end = [], 0
        for token in self.merges.merge(self.held):
            size = len(self.merges.bytes_of[token])
            if end + size > limit:
                break
            out.append(token)
            end += size
        self.held = self.held[end:]
        return out


def pretokens(text: str, span: int = SPAN) -> Iterator[tuple[str, bool]]:
    """Pieces of pre-tokens, each with whether it ends its pre-token; only a run longer than ``span`` has several."""
    at, n = 0, len(text)
    while at < n:
        stop = min(n, at + span)
        started = at
        for m in PATTERN.finditer(text, at, stop):
            if stop < n and m.end() > stop - CONTRACTION:
                break
            yield m.group(), True
            at = m.end()
        if at > started or stop == n:
            continue
        # one run fills the span: find its end, then hand it on in parts
        run = next(r for r in RUNS if r.match(text, at + 1))
        end = run.match(text, at + 1).end()
        if run is RUNS[2] and end < n:
            end -= 1  # the last space of a run belongs to what follows
        while at < end:
            cut = min(end, at + span)
            yield text[at:cut], cut == end
            at = cut


class Overlap(Exception):
    """A piece between two spaces that doesn't stand alone."""


class Units(dict):
    """Ids of ' ' + piece, as little-endian bytes, filled on demand and bounded."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, piece: str) -> bytes:
        if not piece or piece[0].isspace():
            raise Overlap
        if len(self) >= CACHED:
            self.clear()
        ids = self.encode(" " + piece)
        if len(piece) < 64:
            self[piece] = ids
        return ids


class Encoder:
    """Whole texts to ids as 32-bit little-endian integers."""

    def __init__(self, merges: Merges, span: int = SPAN):
        self.merges = merges
        self.span = span
        self.known: dict[str, list[int]] = {}
        self.units = Units(self._unit)
        self.split = regex.compile("(" + "|".join(map(regex.escape, merges.special)) + ")") if merges.special else None

    def _plain(self, text: str) -> bytes:
        out, long = array("I"), None
        for piece, ends in pretokens(text, self.span):
            if long is None and ends and len(piece) < 256:
                out.extend(self._word(piece))
                continue
            long = long or Transducer(self.merges)
            out.extend(long.push(piece.encode("utf-8")))
            if ends:
                out.extend(long.close())
                long = None
        return out.tobytes()

    def _word(self, piece: str) -> list[int]:
        ids = self.known.get(piece)
        if ids is None:
            if len(self.known) >= CACHED:
                self.known.clear()
            ids = self.known[piece] = self.merges.merge(piece.encode("utf-8"))
        return ids

    def _unit(self, unit: str) -> bytes:
        """A space and what follows it; letters, and letters with a mark after them, need no pattern."""
        if len(unit) < 256:
            if unit[1:].isalpha():
                return array("I", self._word(unit)).tobytes()
            if unit[1:-1].isalpha() and unit[-1] in ",.;:!?":
                return array("I", self._word(unit[:-1]) + self._word(unit[-1])).tobytes()
        return self._plain(unit)

    def encode(self, text: str) -> bytes:
        """Between single spaces a text falls into units that don't depend on each other: no pre-token spans a space,
        and the space belongs to what follows it, unless white space stands on both sides. Such texts go whole."""
        if self.split and any(s in text for s in self.merges.special):
            return b"".join(
                array("I", [self.merges.special[part]]).tobytes() if part in self.merges.special else self._plain(part)
                for part in self.split.split(text))
        first, _, rest = text.partition(" ")
        if not _ or not first:
            return self._plain(text)
        try:
            return self._plain(first) + b"".join(map(self.units.__getitem__, rest.split(" ")))
        except Overlap:
            return self._plain(text)


class Decoder:
    """Ids to text, a block at a time; holds back only the bytes of an unfinished character."""

    def __init__(self, merges: Merges):
        self.bytes_of = merges.bytes_of
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def push(self, ids) -> str:
        return self.state.decode(b"".join(map(self.bytes_of.__getitem__, ids)))

    def close(self) -> str:
        text = self.state.decode(b"", True)
        self.state.reset()
        return text


def decode(merges: Merges, ids: bytes, block: int = 1 << 14) -> str:
    numbers, decoder = memoryview(ids).cast("I"), Decoder(merges)
    return "".join(decoder.push(numbers[at:at + block]) for at in range(0, len(numbers), block)) + decoder.close()


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(Merges(path))


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Encode and decode every whole text: doc_id, ids (32-bit little-endian integers in a binary), n_tokens, decoded.

    A null text counts as the empty text, which has no ids. Special tokens in a text become their ids; decoding writes
    them out again. Repeated rows are encoded each; an empty table gives no rows; other columns are not read. ``path``
    names the vocabulary file, which every executor must have. Memory: the vocabulary, two bounded caches, one batch of
    texts. There is no shuffle.
    """
    text_batches(docs.sparkSession)

    def run(batches):
        coder = encoder(path)
        for batch in batches:
            ids = [coder.encode(text or "") for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"),
                "ids": pa.array(ids, pa.binary()),
                "n_tokens": pa.array([len(i) // 4 for i in ids], pa.int64()),
                "decoded": pa.array([decode(coder.merges, i) for i in ids], pa.string()),
            })

    schema = T.StructType([docs.schema["doc_id"], T.StructField("ids", T.BinaryType()), T.StructField("n_tokens", T.LongType()),
                           T.StructField("decoded", T.StringType())])
    return docs.select("doc_id", "text").mapInArrow(run, schema)
