"""Language-model scores from Brown classes: exchange clustering of all words, class transitions, word emissions."""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fluxgauge.llm.common import arrow_rows, id_remainder, shuffles_dropped, stored, text_batches
from fluxgauge.session import scratch

HELD = 7                 # documents whose crc32(doc_id) mod 7 is 2 are not learned from
CLUSTERED = 1_000        # most frequent words, exchanged one at a time before the tasks exchange all words
CLASSES = 64             # least number of classes besides the shapes; grows with the cube root of the vocabulary
LOOKED_UP = 1 << 17      # most frequent words whose counts every worker holds; all others are joined
LONGEST = 64             # bytes of a word that may be looked up; longer ones are joined
FLUSH = 250_000          # distinct words a worker counts before it hands them on
SHAPES = 32              # classes where all other words start, and where unseen words stay, by their form
SWEEPS = 8               # passes of the first exchange
SPREAD = 3               # greatest number of passes over all words
PAIRED = 1 << 22         # words, or counts of neighbours, a worker sorts and adds up at once
BLOCK = 1 << 21          # class contexts times classes a worker weighs at once
GATHERED = 1 << 19       # counts added up at once where their words meet
WORDS = 10_000           # words a worker gets at once
HANDED = 20_000          # rows a worker hands on at once
BUCKET = 2_000_000       # running words for each bucket of the tables by word
RARE = 1 << 62           # ids from here are those of words that workers do not hold: a shape and a hash
HASHED = (1 << 57) - 1   # bits of the hash
PRIOR = 50.0             # weight of the unconditional class distribution in a transition
KEEN = 0.5               # share of an empty class's gain at which a class in use is taken instead
DELTA = 0.5              # added to every word's count within its class
SCHEMA_COUNTS = "word string, shape int, n long"


def words(text: str) -> list[bytes]:
    """Runs of anything but ASCII white space, A-Z in lower case."""
    return text.encode("utf-8").lower().split()


def shape(word: bytes) -> int:
    """Class of a word outside the clustered ones, by its form alone: length, digits, a mark at the end, non-ASCII letters."""
    length = min(3, (len(word) - 1) // 4)
    digits = re.search(rb"[0-9]", word) is not None
    mark = not (word[-1] >= 128 or 97 <= word[-1] <= 122 or 48 <= word[-1] <= 57)
    foreign = not word.isascii()
    return length + 4 * digits + 8 * mark + 16 * foreign


def count_words(docs: DataFrame) -> DataFrame:
    """word, shape and n over the documents that may be learned from; every worker adds up before the shuffle."""
    def count(batches):
        seen: Counter = Counter()

        def flush():
            out = pa.RecordBatch.from_pydict({
                "word": pa.array([w.decode("utf-8") for w in seen], pa.string()),
                "shape": pa.array([shape(w) for w in seen], pa.int32()), "n": pa.array(list(seen.values()), pa.int64())})
            seen.clear()
            return out

        for batch in batches:
            for text in batch.column("text").to_pylist():
                seen.update(words(text or ""))
                if len(seen) > FLUSH:
                    yield flush()
        yield flush()

    return stored(docs.where(id_remainder(HELD) != 2).select("text").mapInArrow(count, SCHEMA_COUNTS).groupBy("word", "shape").agg(
        F.sum("n").alias("n")), "word-counts")


def _entropy(x):
    return np.where(x > 0, x * np.log(np.maximum(x, 1e-300)), 0.0)


def exchange(pairs: np.ndarray, n_words: int, classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """Class of every unit. The first ``n_words`` units are moved, one at a time, to the class that gives the class
    bigram model the greatest likelihood; shapes and the end stay in classes of their own behind them."""
    classes = max(1, min(classes, n_words))
    fixed = len(pairs) - n_words
    of = np.concatenate([np.arange(n_words) % classes, classes + np.arange(fixed)])
    total = classes + fixed
    member = np.zeros((len(pairs), total))
    member[np.arange(len(pairs)), of] = 1
    between = member.T @ pairs @ member
    after, before = pairs @ member, member.T @ pairs     # unit -> class, class -> unit

    for _ in range(sweeps):
        moved = 0
        for w in range(n_words):
            own, self_ = of[w], pairs[w, w]
            out, into = after[w].copy(), before[:, w].copy()
            out[own] -= self_
            into[own] -= self_
            # take the word out of its class
            between[own] -= out
            between[:, own] -= into
            between[own, own] -= self_
            rows, columns = between.sum(axis=1), between.sum(axis=0)
            plain = _entropy(between)
            # gain of adding it to each class c: cells of row c and column c, then the margins
            row_gain = (_entropy(between + out[None, :]) - plain).sum(axis=1)
            column_gain = (_entropy(between + into[:, None]) - plain).sum(axis=0)
            diagonal = between.diagonal()
            corner = _entropy(diagonal + out + into + self_) - _entropy(diagonal + out) - _entropy(diagonal + into) + _entropy(diagonal)
            margin = _entropy(rows + out.sum() + self_) - _entropy(rows) + _entropy(columns + into.sum() + self_) - _entropy(columns)
            gain = (row_gain + column_gain + corner - margin)[:classes]
            best = int(gain.argmax())
            if gain[best] <= gain[own] + 1e-9:
                best = own
            between[best] += out
            between[:, best] += into
            between[best, best] += self_
            if best != own:
                moved += 1
                of[w] = best
                after[:, own] -= pairs[:, w]
                after[:, best] += pairs[:, w]
                before[own] -= pairs[w]
                before[best] += pairs[w]
        if not moved:
            break
    return of


def _rare_id(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word, 42) & HASHED | shape(word) << 57 | RARE


def _rare_ids(word: str, shape: str) -> Column:
    return F.xxhash64(word).bitwiseAND(F.lit(HASHED)).bitwiseOR(F.shiftleft(F.col(shape).cast("long"), 57)).bitwiseOR(F.lit(RARE))


def _shapes(ids: np.ndarray) -> np.ndarray:
    return np.abs(ids) >> 57 & (SHAPES - 1)


def _sums(word: np.ndarray, key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Add up n of equal (word, key), in their order. Keys of numbered words are from -1 to below 1 << 20."""
    small, rest = np.flatnonzero(word < RARE), np.flatnonzero(word >= RARE)
    order = np.r_[small[np.argsort(word[small] << 20 | key[small] + 1)], rest[np.lexsort((key[rest], word[rest]))]]
    word, key, n = word[order], key[order], n[order]
    starts = np.flatnonzero(np.r_[True, (word[1:] != word[:-1]) | (key[1:] != key[:-1])]) if len(n) else order
    return word[starts], key[starts], np.add.reduceat(n, starts) if len(n) else n


def _counted(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    values = np.sort(values)
    starts = np.flatnonzero(np.r_[True, values[1:] != values[:-1]]) if len(values) else values
    return values[starts], np.diff(np.r_[starts, len(values)])


def _starts(word: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, word[1:] != word[:-1]]) if len(word) else np.zeros(0, np.int64)


def _pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    return (batch.slice(at, HANDED) for at in range(0, len(batch), HANDED))


def _whole_words(batches: Iterator[pa.RecordBatch], flat: Callable) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """word, key and n, added up, a few whole words at a time; flat makes them of a batch, whose words are sorted."""
    kept, rows = [], 0
    for batch in batches:
        now = flat(batch)
        if not len(now[0]):
            continue
        kept.append(now)
        rows += len(now[0])
        if rows < GATHERED:
            continue
        now = [np.concatenate(c) for c in zip(*kept)]
        cut = int(np.searchsorted(now[0], now[0][-1]))  # the last word may go on
        if cut:
            yield _sums(*(c[:cut] for c in now))
            kept = [[c[cut:] for c in now]]
        else:
            kept = [_sums(*now)]
        rows = 0
    if kept:
        yield _sums(*(np.concatenate(c) for c in zip(*kept)))


def _lists(batch: pa.RecordBatch, names: tuple[str, ...]) -> list[np.ndarray]:
    """The place in the batch of every entry of its lists, and the entries of each named column; null lists are empty."""
    sizes = pc.fill_null(pc.list_value_length(batch.column(names[0])), 0).to_numpy(zero_copy_only=False)
    return [np.repeat(np.arange(len(batch)), sizes), *(batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in names)]


def bucketed(df: DataFrame, buckets: int, table: str) -> DataFrame:
    """The rows of ``df`` from a table in buckets by word: tables of as many buckets are joined by word without a shuffle."""
    df.write.bucketBy(buckets, "word").saveAsTable(table)
    return df.sparkSession.table(table)


def word_neighbours(docs: DataFrame, ids: dict[bytes, int], buckets: int, table: str) -> DataFrame:
    """word and the arrays key and n, one row per word: its neighbours in the texts that may be learned from.

    Words in ``ids`` have their number there, the end, which also stands before a text, has the next one, and all other
    words have an id from RARE on, a hash and the shape. Number i behind the word has key 2 * i, before it 2 * i + 1;
    other words have their id as key, negative before the word. To a numbered word, which may have any number of other
    words beside it, these are the shapes alone, numbered behind the end. A word behind itself counts once, as behind.
    """
    shared = docs.sparkSession.sparkContext.broadcast(ids)

    def rows_of(units, size):
        a, b = units[:-1], units[1:]
        both, parts = (a < size) & (b < size), []
        for side, word, other in ((0, a[both], b[both]), (1, b[both], a[both])):
            pair, n = _counted((word * (2 * size) + 2 * other + side)[(word != other) | (side == 0)])
            parts.append((*np.divmod(pair, 2 * size), n))
        a, b = a[~both], b[~both]
        word, other, side = np.r_[a, b], np.r_[b, a], np.repeat([0, 1], len(a))
        far = np.where(word < size, 2 * (size + _shapes(other)) + side, np.where(side == 1, -other, other))
        key = np.where(other < size, 2 * other + side, far)
        once = (side == 0) | (word != other)
        parts.append(_sums(word[once], key[once], np.ones(int(once.sum()), np.int64)))
        word, key, n = (np.concatenate(c) for c in zip(*parts))
        order = np.argsort(word, kind="stable")  # three sorted runs
        word, key, n = word[order], key[order], n[order]
        return _keyed(word, key, n)

    def count(batches):
        ids = shared.value
        get, end, none = ids.get, len(ids), repeat(-1)
        seen, rows = [np.array([end], np.int64)], 0
        for batch in batches:
            tokens: list = []
            for text in batch.column("text").to_pylist():
                tokens += words(text or "")
                tokens.append(b"")  # no word is empty
            found = np.fromiter(map(get, tokens, none), np.int64, len(tokens))
            for i in np.flatnonzero(found < 0):
                found[i] = _rare_id(tokens[i]) if tokens[i] else end
            seen.append(found)
            rows += len(found)
            if rows > PAIRED:
                units, rows = np.concatenate(seen), 0
                seen = [units[-1:]]
                yield from _pieces(rows_of(units, end + 1))
        yield from _pieces(rows_of(np.concatenate(seen), end + 1))

    def flat(batch):
        at, key, n = _lists(batch, ("key", "n"))
        return [batch.column("word").to_numpy()[at], key, n]

    def merge(batches):
        for word, key, n in _whole_words(batches, flat):
            yield from _pieces(_keyed(word, key, n))

    schema = "word long, key array<long>, n array<long>"
    found = docs.where(id_remainder(HELD) != 2).select("text").mapInArrow(count, schema)
    return bucketed(found.repartition(buckets, "word").sortWithinPartitions("word").mapInArrow(merge, schema), buckets, table)


def _keyed(word: np.ndarray, key: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    starts = _starts(word)
    ends = np.r_[starts, len(word)].astype(np.int32)
    lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(c.astype(np.int64))) for c in (key, n)]
    return pa.RecordBatch.from_arrays([pa.array(word[starts]), *lists], ["word", "key", "n"])


def unit_pairs(neighbours: DataFrame, unit: np.ndarray, first: int) -> np.ndarray:
    """How often unit b follows unit a. ``unit`` has the units of the numbered words, the end and the shapes, those of
    other words are their shapes', from ``first`` on."""
    shared, size = neighbours.sparkSession.sparkContext.broadcast(unit), int(unit.max()) + 1

    def count(batches):
        units, total = shared.value, np.zeros(size * size)
        for batch in batches:
            word = batch.column("word").to_numpy()
            at, key, n = _lists(batch, ("key", "n"))
            behind = np.where(np.abs(key) >= RARE, key > 0, key & 1 == 0)
            at, key, n = at[behind], key[behind], n[behind]
            a = np.where(word >= RARE, first + _shapes(word), units[np.minimum(word, len(units) - 1)])
            b = np.where(key >= RARE, first + _shapes(key), units[np.minimum(key >> 1, len(units) - 1)])
            total += np.bincount(a[at] * size + b, n, size * size)
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"cell": pa.array(cells, pa.int64()), "n": pa.array(total[cells].astype(np.int64), pa.int64())})

    with arrow_rows(neighbours.sparkSession, WORDS):
        return _table(neighbours.mapInArrow(count, "cell long, n long"), size)


def _table(cells: DataFrame, size: int) -> np.ndarray:
    """Sums of n by cell, size * size of them at most."""
    summed = cells.groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(size * size)
    out[summed["cell"].to_numpy(np.int64)] = summed["n"].to_numpy()
    return out.reshape(size, size)


def with_classes(neighbours: DataFrame, state: DataFrame | None) -> DataFrame:
    """The neighbours of every word beside what ``moved`` has told it: own, code and told. Both are in buckets by word."""
    if state is None:
        return neighbours
    return neighbours.join(state.withColumnRenamed("n", "told").hint("shuffle_hash"), "word", "left")


def _contexts(batch: pa.RecordBatch, classes: np.ndarray, total: int) -> tuple[np.ndarray, ...]:
    """own of every word in a batch of ``with_classes``, and place, code and n of its neighbours, not added up.

    Code j is class j behind the word, total + 1 + j class j before it, and code total the word behind itself.
    """
    word, size = batch.column("word").to_numpy(), len(classes) - SHAPES
    at, key, n = _lists(batch, ("key", "n"))
    own = np.where(word >= RARE, classes[size + _shapes(word)], classes[np.minimum(word, size - 1)])
    rare = np.abs(key) >= RARE
    number = np.where(rare, size + _shapes(key), key >> 1)
    before = np.where(rare, key < 0, key & 1 == 1)
    loop = np.where(rare, key, number) == word[at]
    code = np.where(loop, total, classes[number] + before * (total + 1))
    if "own" not in batch.schema.names:
        return own, at, code, n
    now = batch.column("own").fill_null(-1).to_numpy(zero_copy_only=False)
    own = np.where((word >= RARE) & (now >= 0), now, own)
    here = loop | (number < size)  # the other words have told their classes
    from_, told, times = _lists(batch, ("code", "told"))
    return own, np.r_[at[here], from_], np.r_[code[here], told], np.r_[n[here], times]


def class_table(rows: DataFrame, classes: np.ndarray, total: int) -> np.ndarray:
    """How often class b follows class a, of all words; total * total numbers."""
    shared = rows.sparkSession.sparkContext.broadcast(classes)

    def count(batches):
        table = np.zeros(total * total)
        for batch in batches:
            own, at, code, n = _contexts(batch, shared.value, total)
            behind = code <= total
            own, code = own[at[behind]], code[behind]
            table += np.bincount(own * total + np.where(code == total, own, code), n[behind], total * total)
        cells = np.flatnonzero(table)
        yield pa.RecordBatch.from_pydict({"cell": pa.array(cells, pa.int64()), "n": pa.array(table[cells].astype(np.int64), pa.int64())})

    with arrow_rows(rows.sparkSession, WORDS):
        return _table(rows.mapInArrow(count, "cell long, n long"), total)


def _xlogx(x):
    return x * np.log(np.maximum(x, 1))  # of whole numbers


def likelihood(between: np.ndarray) -> float:
    return float(_xlogx(between).sum() - _xlogx(between.sum(axis=0)).sum() - _xlogx(between.sum(axis=1)).sum())


def best_classes(starts: np.ndarray, own: np.ndarray, code: np.ndarray, n: np.ndarray, between: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The best class of every word while all others stay, and the gain in likelihood over its own class, for every class.

    Word i has the rows from starts[i] on of its class contexts, added up. The last class is the end's; no word can move
    there. What rows of one code and n gain is worked out once, and for the own class, which the word leaves, apart. Of
    equally good classes, which are empty ones as a rule, the class that a word is beside most often names one: words that
    choose at the same time meet in it if their contexts are alike.
    """
    total, size = len(between), len(starts)
    word = np.repeat(np.arange(size), np.diff(np.r_[starts, len(code)]))
    mine, every = own[starts], np.arange(size)
    again = code == total
    loops = np.bincount(word[again], n[again], size)
    word, code, n = word[~again], code[~again].astype(np.int64), n[~again].astype(np.int64)
    before = code > total
    j, home = np.where(before, code - total - 1, code), mine[word]

    gain, own_gain = np.zeros((size, total)), np.zeros(size)
    if len(word):
        most = int(n.max()) + 1
        kinds, kind = np.unique(code * most + n, return_inverse=True)
        of, times = np.divmod(kinds, most)
        cells = np.concatenate([between.T, between[:1], between])[of]  # code total does not occur
        table = _xlogx(cells + times[:, None]) - np.concatenate([_xlogx(between.T), between[:1], _xlogx(between)])[of]
        with_rows = _starts(word)
        gain[word[with_rows]] = np.add.reduceat(table[kind], with_rows, axis=0)
    # the word taken out of its own class
    inner, sides = j == home, np.zeros((2, size))
    sides[before[inner].astype(int), word[inner]] = n[inner]
    cells = np.where(before, between[j, home], between[home, j]) - n
    cells[inner] -= sides[1 - before[inner].astype(int), word[inner]] + loops[word[inner]]
    own_gain += np.bincount(word, _xlogx(cells + n) - _xlogx(cells), size)
    for side, cells in ((1, between), (0, between.T)):  # its neighbours met it there too
        met = sides[1 - side, word]
        part = np.flatnonzero((before == side) & (j != home) & (met > 0))
        cell, met, less = cells[j[part], home[part]], met[part], n[part]
        gain[word[part], j[part]] += _xlogx(cell - less + met) - _xlogx(cell - less) - _xlogx(cell + met) + _xlogx(cell)

    # the corner: classes both behind and before the word, and all classes if it stands behind itself
    def corner(cell, out, into, self_):
        return _xlogx(cell + out + into + self_) - _xlogx(cell + out) - _xlogx(cell + into) + _xlogx(cell)

    diagonal = between.diagonal()
    _, x, y = np.intersect1d((word * total + j)[~before], (word * total + j)[before], assume_unique=True, return_indices=True)
    x, y = np.flatnonzero(~before)[x], np.flatnonzero(before)[y]
    plain = loops[word[x]] == 0
    x, y = x[plain], y[plain]
    gain[word[x], j[x]] += corner(diagonal[j[x]], n[x], n[y], 0)
    looped = np.flatnonzero(loops)
    if len(looped):
        place = np.full(size, -1)
        place[looped] = np.arange(len(looped))
        beside, held = np.zeros((2, len(looped), total)), place[word] >= 0
        beside[before[held].astype(int), place[word[held]], j[held]] = n[held]
        gain[looped] += corner(diagonal[None, :], *beside, loops[looped, None])
    own_gain += corner(diagonal[mine] - sides.sum(axis=0) - loops, *sides, loops)

    # the margins
    for axis, side in ((1, ~before), (0, before)):
        margin, share = between.sum(axis=axis), np.bincount(word[side], n[side], size) + loops
        shares, at = np.unique(share, return_inverse=True)
        gain -= (_xlogx(margin[None, :] + shares[:, None]) - _xlogx(margin)[None, :])[at]
        own_gain -= _xlogx(margin[mine]) - _xlogx(margin[mine] - share)
    gain[every, mine] = own_gain
    gain -= own_gain[:, None]
    best = gain[:, :-1].argmax(axis=1)
    top = gain[every, best]
    used = np.flatnonzero(between[:-1].any(axis=1))
    if len(used):  # an empty class gains less than it seems, as others choose it at the same time
        held = used[gain[:, used].argmax(axis=1)]
        best = np.where(gain[every, held] >= KEEN * top, held, best)
        top = gain[every, best]
    equal = (gain[:, :-1] >= (top - 1e-7)[:, None]) & ~np.isin(best, used)[:, None]
    many = np.flatnonzero((equal.sum(axis=1) > 1) & (top > 1e-6))
    if len(many):
        near, at = np.unique(word * total + j, return_inverse=True)
        of, near = np.divmod(near, total)
        order = np.lexsort((near, -np.bincount(at, n), of))
        firsts = order[_starts(of[order])]
        chief = np.zeros(size, np.int64)  # the class a word is beside most often, the first of such
        chief[of[firsts]] = near[firsts]
        choice, free = equal[many], max(1, total - 1 - SHAPES)
        choice[choice[:, :free].any(axis=1), free:] = False  # rather than a shape's class
        ranks = choice.cumsum(axis=1)
        best[many] = (choice & (ranks == chief[many, None] % ranks[:, -1:] + 1)).argmax(axis=1)
    return np.where(top > 1e-6, best, mine), gain


def moved(rows: DataFrame, classes: np.ndarray, between: np.ndarray, turn: int, turns: int, first: int, buckets: int, table: str) -> DataFrame:
    """word, own and the arrays code and n: the class of every word but the end, the best one for the words from number
    ``first`` on whose turn it is, and the contexts that a word has from those neighbours which are not numbered, by their new classes."""
    spark, total = rows.sparkSession, len(between)
    shared = spark.sparkContext.broadcast((classes, between))

    def choose(batches):
        classes, between = shared.value
        size, kept, n_kept = len(classes) - SHAPES, [], 0

        def told():
            word, code, n = _sums(*(np.concatenate(c) for c in zip(*kept)))
            kept.clear()
            return _pieces(pa.RecordBatch.from_pydict({"word": word, "code": code.astype(np.int32), "n": n}))

        for batch in batches:
            word = batch.column("word").to_numpy()
            own, at, code, n = _contexts(batch, classes, total)
            turns_now = (((word * np.int64(-7046029254386353131)) >> np.int64(40) & np.int64(0xFFFF)) % turns == turn) & (word >= first) & (word != size - 1)
            now = turns_now[at]
            at, code = at[now], code[now]
            place = at * (2 * total + 1) + code
            order = np.argsort(place)
            place, n = place[order], n[now][order]
            firsts = _starts(place)
            at, code = np.divmod(place[firsts], 2 * total + 1)
            n = np.add.reduceat(n, firsts) if len(n) else n
            starts = _starts(at)
            of, spans, to, i = at[starts], np.r_[starts, len(at)], own.copy(), 0
            while i < len(starts):
                until = max(i + 1, int(np.searchsorted(spans, spans[i] + BLOCK // total, side="right")) - 1)
                part = slice(spans[i], spans[until])
                to[of[i:until]] = best_classes(starts[i:until] - spans[i], own[at[part]], code[part], n[part], between)[0]
                i = until
            moving = word != size - 1
            kept.append((word[moving], np.full(int(moving.sum()), -1), to[moving].astype(np.int64)))
            at, key, n = _lists(batch, ("key", "n"))
            tells = (word[at] >= RARE) & (key != word[at])
            at, key, n = at[tells], key[tells], n[tells]
            rare = np.abs(key) >= RARE
            before = np.where(rare, key < 0, key & 1 == 1)
            kept.append((np.where(rare, np.abs(key), key >> 1), to[at] + np.where(before, 0, total + 1), n))
            n_kept += len(word) + len(n)
            if n_kept > PAIRED:
                yield from told()
                n_kept = 0
        if kept:
            yield from told()

    def flat(batch):
        return [batch.column("word").to_numpy(), batch.column("code").to_numpy().astype(np.int64), batch.column("n").to_numpy()]

    def pack(batches):
        for word, code, n in _whole_words(batches, flat):
            starts, real = _starts(word), code >= 0
            own = np.where(real[starts], -1, n[starts])
            ends = np.r_[0, np.cumsum(np.add.reduceat(real.astype(np.int64), starts))].astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(c)) for c in (code[real].astype(np.int32), n[real])]
            yield from _pieces(pa.RecordBatch.from_arrays([pa.array(word[starts]), pa.array(own.astype(np.int32)), *lists], ["word", "own", "code", "n"]))

    with arrow_rows(spark, WORDS):
        dealt = rows.mapInArrow(choose, "word long, code int, n long").repartition(buckets, "word").sortWithinPartitions("word")
        return bucketed(dealt.mapInArrow(pack, "word long, own int, code array<int>, n array<long>"), buckets, table)


@dataclass
class Model:
    """log10 probabilities. ``known`` gives a frequent word's class and count. Behind the ``n_clustered`` first classes
    come those of the shapes, and the end's."""
    n_clustered: int
    known: dict[bytes, tuple[int, int]] = field(repr=False)
    transition: np.ndarray = field(repr=False)   # class -> class: of the class, given the class before
    floor: np.ndarray = field(repr=False)        # class: minus log10 of its smoothed total
    train_tokens: int
    vocabulary: int
    ends: int


def _frequent(counts: DataFrame) -> tuple[list[tuple[bytes, int, int]], Column]:
    """(word, shape, n) of the most frequent words that workers may look up, LOOKED_UP at most, the first the commonest,
    and the condition by which they were picked.

    A histogram of counts (16 levels per doubling, a few hundred rows) tells which levels fit as a whole; so the driver
    gets these words only, however many partitions there are.
    """
    level = F.floor(F.log2("n") * 16)
    room, lowest = LOOKED_UP, None
    short = F.octet_length("word") <= LONGEST
    for row in counts.where(short).groupBy(level.alias("level")).agg(F.count("*").alias("words")).orderBy(F.desc("level")).collect():
        room -= row["words"]
        if room < 0:
            break
        lowest = row["level"]
    picked = short & (level >= lowest) if lowest is not None else F.lit(False)
    rows = counts.where(picked).select("word", "shape", "n").collect()
    return sorted(((r["word"].encode("utf-8"), r["shape"], r["n"]) for r in rows), key=lambda r: (-r[2], r[0])), picked


def exchange_all(neighbours: DataFrame, classes: np.ndarray, between: np.ndarray, first: int, buckets: int, folder: str) -> tuple[np.ndarray, DataFrame | None, np.ndarray]:
    """Move all words, SPREAD times at most, and return the classes of the numbered words, the end and the shapes, a
    table with the class of every word as own (None: all others have their shapes'), and the class table.

    The ``first`` words, exchanged one at a time before, stay: so common ones, moved at the same time, lower the likelihood.
    In a pass, tasks choose for every second word its best class while all others stay; the next pass takes the other
    words. The words' neighbours are counted once and stay where they are; what goes to other tasks is the classes of
    words that are not numbered, added up by neighbour and class. Only the class table and the numbered words' classes
    pass through the driver. A pass after which the likelihood of the class bigrams is less than before it is taken
    back; two of them, one after the other, end the exchange.
    """
    state, failed = None, 0
    for turn in range(SPREAD):
        told = moved(with_classes(neighbours, state), classes, between, turn % 2, 2, first, buckets, f"{folder}.told_{turn}")
        held = told.where((F.col("word") < RARE) & (F.col("own") >= 0)).select("word", "own").toPandas()  # at most LOOKED_UP rows
        then = classes.copy()
        then[held["word"].to_numpy(np.int64)] = held["own"].to_numpy()
        after = class_table(with_classes(neighbours, told), then, len(between))
        if likelihood(after) < likelihood(between):
            failed += 1
            if failed == 2:  # neither half of the words moves any more
                break
            continue
        classes, state, between, failed = then, told, after, 0
    return classes, state, between


def train(docs: DataFrame) -> tuple[Model, DataFrame]:
    """The model and the table of all word counts (word, shape, n) it was made from, with the class of every word that
    the model does not hold.

    The CLUSTERED most frequent words are exchanged on the driver, with all others in the classes of their shapes; from
    there tasks exchange all words, by the counts of all pairs of words. Words of one shape whose 57-bit hashes agree share
    a class.
    """
    spark = docs.sparkSession
    text_batches(spark)
    with shuffles_dropped(spark):
        counts = count_words(docs)
    n_docs = docs.where(id_remainder(HELD) != 2).count()
    n, v = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    frequent, picked = _frequent(counts)
    n_seeds = len(frequent[:CLUSTERED])
    wanted = max(CLASSES, math.ceil(v ** (1 / 3)))
    classes, buckets = wanted + SHAPES + 1, 1 + n // BUCKET
    shapes, shaped = np.arange(SHAPES), np.array([s for _, s, _ in frequent[n_seeds:]], np.int64)
    unit = np.r_[np.arange(n_seeds), n_seeds + shaped, n_seeds + SHAPES, n_seeds + shapes]  # numbered words, the end, shapes
    folder = f"class_lm_{uuid.uuid4().hex}"
    spark.sql(f"CREATE DATABASE {folder} LOCATION '{scratch(spark, 'llm-classes')}'")
    try:
        with shuffles_dropped(spark):
            neighbours = word_neighbours(docs, {w: i for i, (w, _, _) in enumerate(frequent)}, buckets, f"{folder}.neighbours")
            pairs = unit_pairs(neighbours, unit, n_seeds)
            of = np.r_[exchange(pairs, n_seeds, wanted)[:n_seeds], wanted + np.arange(SHAPES + 1)]
            member = np.eye(classes)[of]
            hot, state, between = exchange_all(neighbours, of[unit], member.T @ pairs @ member, n_seeds, buckets, folder)
            others = counts.where(~picked).select("word", "shape", "n")
            if state is None:
                others = others.withColumn("class", (F.col("shape") + wanted).cast("int"))
            else:
                rare = state.where(F.col("word") >= RARE).select(F.col("word").alias("id"), F.col("own").alias("class"))
                others = others.withColumn("id", _rare_ids("word", "shape")).join(rare, "id").drop("id")
            # the class of every word that the model does not hold
            counted = stored(others.union(counts.where(picked).select("word", "shape", "n", F.lit(None).cast("int").alias("class"))), "word-classes")
    finally:
        spark.sql(f"DROP DATABASE {folder} CASCADE")
    share = (between.sum(axis=0) + 1) / (between.sum() + classes)
    follow = (between + PRIOR * share[None, :]) / (between.sum(axis=1, keepdims=True) + PRIOR)

    # counts and distinct words of every class; unseen words are one more of each shape
    tokens, kinds = np.zeros(classes), np.zeros(classes)
    for (_, _, c), k in zip(frequent, hot):
        tokens[k] += c
        kinds[k] += 1
    for row in counted.where("class is not null").groupBy("class").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():
        tokens[row["class"]] += row["n"]
        kinds[row["class"]] += row["v"]
    kinds[wanted:-1] += 1
    floor = -np.log10(np.maximum(tokens + DELTA * kinds, DELTA))
    floor[-1] = 0.0  # the end is its class's only word
    known = {w: (int(k), c) for (w, _, c), k in zip(frequent, hot)}
    return Model(wanted, known, np.log10(follow).astype(np.float32), floor, n + n_docs, v + (n_docs > 0), n_docs), counted


def score(docs: DataFrame, trained: tuple[Model, DataFrame] | None = None) -> DataFrame:
    """Log10 probabilities of every whole text, its end included.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score (unigrams with one added) and score (class
    bigrams: P(class | class before) * P(word | class)). A word never seen has the class of its shape, and count 0 in
    it. A null text is empty and has its end alone. Repeated rows are scored each, rows without doc_id too; an empty
    table gives no rows. Other columns are not read.

    Frequent words are looked up in the worker. The rest leave one by one, with their place and the classes beside it,
    and meet their counts and classes in a join by word; back together by document they add their transitions. So
    nothing is lost and no text is shuffled.
    """
    spark = docs.sparkSession
    model, counts = trained or train(docs)
    shared = spark.sparkContext.broadcast(model)
    names = ["row", "doc_id", "held_out", "word", "place", "behind", "ahead", "shape", "n_tokens", "n_known", "base", "model"]

    def read(batches):
        m = shared.value
        first = TaskContext.get().partitionId() << 33
        end, get = len(m.transition) - 1, m.known.get
        ends_known = int(m.ends > 0)
        for batch in batches:
            whole: list[tuple] = []
            rare: list[tuple] = []
            for at, text in enumerate(batch.column("text").to_pylist()):
                path, seen = [end], []
                tokens = words(text or "")
                met: list[int] = []
                for w in tokens:
                    found = get(w)
                    if found is None:
                        met.append(len(path))
                        path.append(-1)
                    else:
                        path.append(found[0])
                        seen.append(found[1])
                path.append(end)
                rare.extend((first + at, tokens[i - 1].decode("utf-8"), i, path[i - 1], path[i + 1], shape(tokens[i - 1])) for i in met)
                way, c = np.array(path), np.array(seen, np.float64)
                steps = (way[:-1] >= 0) & (way[1:] >= 0)
                whole.append((first + at, len(tokens) + 1, len(seen) + ends_known, float(np.log10(c + 1).sum() + np.log10(m.ends + 1.0)),
                              float(m.transition[way[:-1][steps], way[1:][steps]].sum(dtype=np.float64) + m.floor[way[1:][way[1:] >= 0]].sum()
                                    + np.log10(c + DELTA).sum())))
            first += len(batch)
            blank = len(rare)
            by_doc, by_word = list(zip(*whole)) or [()] * 5, list(zip(*rare)) or [()] * 6
            rows = len(whole)

            def column(of_doc, of_word, kind):
                return pa.array([*of_doc, *of_word], kind)
            yield pa.RecordBatch.from_arrays([
                column(by_doc[0], by_word[0], pa.int64()), column(batch.column("doc_id").to_pylist(), [None] * blank, batch.schema.field("doc_id").type),
                column(batch.column("held_out").to_pylist(), [None] * blank, pa.bool_()),
                column([f" {r}" for r in by_doc[0]], by_word[1], pa.string()),  # no word holds a space, so these meet no count
                column([0] * rows, by_word[2], pa.int64()), column([-1] * rows, by_word[3], pa.int32()),
                column([-1] * rows, by_word[4], pa.int32()), column([0] * rows, by_word[5], pa.int32()),
                column(by_doc[1], [0] * blank, pa.int64()), column(by_doc[2], [0] * blank, pa.int64()),
                column(by_doc[3], [0.0] * blank, pa.float64()), column(by_doc[4], [0.0] * blank, pa.float64())], names)

    schema = T.StructType().add("row", "long").add(docs.schema["doc_id"]).add("held_out", "boolean").add("word", "string").add(
        "place", "long").add("behind", "integer").add("ahead", "integer").add("shape", "integer").add("n_tokens", "long").add("n_known", "long").add(
        "base", "double").add("model", "double")
    parts = docs.select("doc_id", (id_remainder(HELD) == 2).alias("held_out"), "text").mapInArrow(read, schema)
    c, found = F.coalesce(F.col("n"), F.lit(0)), F.col("place") > 0
    met = parts.join(counts.where("class is not null").select(F.col("word").alias("of_word"), "n", "class"), F.col("word") == F.col("of_word"), "left").select(
        "row", "doc_id", "held_out", "n_tokens", "place", "behind", "ahead",
        F.coalesce("class", F.col("shape") + model.n_clustered).alias("class"),
        (F.col("n_known") + F.col("n").isNotNull().cast("long")).alias("n_known"),
        (F.col("base") + F.when(found, F.log10(c + 1)).otherwise(0.0)).alias("base"),
        (F.col("model") + F.when(found, F.log10(c + DELTA)).otherwise(0.0)).alias("model"))

    def walk(batches):
        m, last = shared.value, 0
        for batch in batches:
            if not len(batch):
                continue
            place, behind, ahead, own = (batch.column(c).to_numpy() for c in ("place", "behind", "ahead", "class"))
            before = np.r_[last, own[:-1]]  # a word not looked up behind another one is the next row
            behind = np.where(behind >= 0, behind, before)
            last = own[-1]
            here = place > 0
            step = np.where(here, m.transition[behind, own] + m.floor[own], 0.0) + np.where(here & (ahead >= 0), m.transition[own, ahead], 0.0)
            yield batch.set_column(batch.schema.get_field_index("model"), "model", pa.array(batch.column("model").to_numpy() + step))

    walked = met.repartition("row").sortWithinPartitions("row", "place").mapInArrow(walk, met.schema)
    n_all = float(model.train_tokens + model.vocabulary + 1)
    return walked.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.sum("n_tokens").alias("n_tokens"),
        F.sum("n_known").alias("n_known"), F.sum("base").alias("base"), F.sum("model").alias("score")).select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(model.train_tokens).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * F.log10(F.lit(n_all))).alias("base_score"), "score")
