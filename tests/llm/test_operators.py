"""Every operator against a plain Python version, on the small tables and on awkward rows."""

import collections
import hashlib
import math
import os
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from fluxgauge.llm import bpe, class_lm, embeddings, exact_dedup, language, mixing, personal_data, queries, repeats, search, sharding, simhash, token_files, whitening
from fluxgauge.session import shared_dir

SF = "/root/testdata/sf0.001"
SPACE = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls everywhere, empty and very long texts, repeated rows, special tokens, and columns named like our own."""
    long_word, long_text = "x" * 200_000, "the and of " * 30_000
    rows = [
        (1, "A b  c\n\n d", "en", "s"), (2, None, None, None), (3, "", "en", "s"), (4, long_word, None, "s"), (5, long_text, "fr", "t"),
        (6, "A b  c\n\n d", "en", None), (6, "A b  c\n\n d", "en", None), (None, "A b  c\n\n d", "en", "s"), (7, "12 34 !?", "en", "t"),
        (8, "x<|endoftext|>y 𝄞é", "en", "t"), (9, " \t\n", "de", "t"), (10, "1" * 100_000, "de", "t"), (None, None, None, None),
        (11, "mail a.b@c.org, ip 10.0.0.1 call +1 (736) 555-2678 card 4111 1111 1111 1111", "en", "t"),
    ]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return frame.withColumns({c: F.lit("?") for c in (
        "n_chars", "shard", "row", "fp", "n", "word", "part", "size", "digest", "cell", "copy", "start", "ids", "rate", "kept", "draw", "digits", "__letters", "letters", "mark", "doc", "words", "dropped_id")})


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


def texts(frame):
    return [(r["doc_id"], r["text"] or "") for r in frame.select("doc_id", "text").collect()]


def library():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(queries.vocabulary())


# ---------------------------------------------------------------- 1 token files

@pytest.mark.parametrize("name", ["docs", "odd", "none"])
def test_token_files(request, name):
    frame = request.getfixturevalue(name)
    got = token_files.write_and_read(frame, queries.vocabulary()).collect()
    code = library()
    want = collections.Counter((i, zlib.crc32(np.array([*code.encode(t, add_special_tokens=False).ids, 2], "<u4").tobytes())) for i, t in texts(frame))
    assert collections.Counter((r["doc_id"], zlib.crc32(r["ids"])) for r in got) == want
    at, last = 0, -1
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at and (r["doc_id"] if r["doc_id"] is not None else -1) >= last
        at, last = at + r["n_tokens"], r["doc_id"] if r["doc_id"] is not None else -1
        assert len(r["ids"]) == 4 * r["n_tokens"]


def test_index_is_minimal_and_perfect_and_rejects_strangers(spark, docs, tmp_path):
    rows = token_files.write_shards(docs, queries.vocabulary(), str(tmp_path / "shards"))
    index = token_files.build_index(rows)
    row = index.first()
    assert sum(bin(b).count("1") for part in row["bits"] for b in part) == rows.count() == len(row["fingerprint"]) // 4
    strangers = spark.range(10**6, 10**6 + 500).select(F.col("id").alias("doc_id"), F.lit(0).cast("long").alias("copy"))
    assert token_files.locate(strangers, index).count() == 0


# ---------------------------------------------------------------- 2 embeddings

def plain_links(rows, cosine):
    good = {}
    for vec_id, vector, label in rows:
        v = None if vector is None or any(x is None or not math.isfinite(x) for x in vector) else np.array(vector, float)
        if vec_id is not None and label is not None and v is not None and len(v) and v.any():
            good[vec_id] = (label, v / abs(v).max() / np.linalg.norm(v / abs(v).max()))
    links = {i: {j for j, (b, w) in good.items() if j != i and a == b and len(v) == len(w) and v @ w >= cosine} for i, (a, v) in good.items()}
    root = {}
    for i in sorted(links):
        if i not in root:
            todo = [i]
            while todo:
                j = todo.pop()
                if j not in root:
                    root[j] = i
                    todo += links[j]
    return {r[0]: (len(links.get(r[0], ())), root.get(r[0], r[0])) for r in rows}


@pytest.mark.parametrize("cosine", [0.98, 0.5, 0.3])
def test_embeddings_against_all_pairs(spark, cosine):
    frame = spark.read.parquet(f"{SF}/embeddings.parquet")
    want = plain_links([tuple(r) for r in frame.select("vec_id", "embedding", "label").collect()], cosine)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embeddings.near_duplicates(frame, cosine).collect()}
    assert got == want


def test_embeddings_awkward(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows, n = [], 0
    for label in (1, 2, None):
        for center in rng.normal(size=(6, 8)):
            for _ in range(12):
                rows.append((n, [float(x) for x in center + rng.normal(size=8) * 0.08], label))
                n += 1
    copy = rows[0][1]
    rows += [(n + i, copy, 1) for i in range(40)] + [(n + 40, None, 1), (n + 41, [0.0] * 8, 1), (n + 42, [float("nan")] + [1.0] * 7, 1),
             (n + 43, [None] + [1.0] * 7, 1), (n + 44, [], 1), (n + 45, [2 * x for x in copy], 1), (n + 46, copy[:4], 1), (n + 47, [1e300] * 8, 2)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("rep", F.lit("?")).withColumn("dim", F.lit(0))
    monkeypatch.setattr(embeddings, "BLOCK_ROWS", 5)
    monkeypatch.setattr(embeddings, "FAN_OUT", 2)
    got = embeddings.near_duplicates(frame.repartition(7)).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got} == plain_links(rows, 0.98)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)
    assert embeddings.near_duplicates(frame.where("false")).count() == 0


# ---------------------------------------------------------------- 3 exact dedup

@pytest.mark.parametrize("name", ["docs", "odd", "none"])
@pytest.mark.parametrize("runs,fan_in", [(64, 8), (5, 2)])
def test_exact_dedup(request, name, runs, fan_in):
    frame = request.getfixturevalue(name)
    groups = collections.defaultdict(list)
    for i, t in texts(frame):
        groups[t].append(i)
    want = []
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        want += [(i, keep, len(ids), i == keep, hashlib.sha256(t.encode()).hexdigest()) for i in ids]
    got = [tuple(r) for r in exact_dedup.report(frame, runs, fan_in).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_drop_copies_keeps_columns_and_one_of_each(odd):
    left = exact_dedup.drop_copies(odd)
    assert left.columns == odd.columns
    kept = collections.Counter((r["doc_id"], r["text"] or "") for r in left.collect())
    assert kept[(6, "A b  c\n\n d")] == 1 and (1, "A b  c\n\n d") not in kept and kept[(3, "")] == 1
    assert len({t for _, t in kept}) == len(kept)


# ---------------------------------------------------------------- 4 sharding

@pytest.mark.parametrize("name", ["docs", "odd", "none"])
def test_shards(request, name):
    frame = request.getfixturevalue(name)
    got = sharding.shard_by_bytes(frame).collect()
    assert collections.Counter((r["doc_id"], r["size"]) for r in got) == collections.Counter(
        (i, len(t.encode()) + 1) for i, t in texts(frame))
    places = collections.defaultdict(list)
    for r in got:
        places[r["shard"]].append(r["slot"])
    assert all(sorted(p) == list(range(len(p))) for p in places.values()) and set(places) <= set(range(8))


def test_shards_are_equal_and_hot_text_is_divided(spark):
    frame = spark.range(30_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("hot " * 20)).when(
        F.col("id") % 10 == 1, F.concat(F.lit("pair "), (F.col("id") / 20).cast("int"))).otherwise(
        F.concat(F.lit("text "), F.repeat(F.col("id").cast("string"), (F.col("id") % 40).cast("int")))).alias("text"))
    got = sharding.shard_by_bytes(frame).join(frame, "doc_id").cache()
    sizes = [r["b"] for r in got.groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert len(sizes) == 8 and max(sizes) < 1.03 * min(sizes)
    split = got.groupBy("text").agg(F.count_distinct("shard").alias("k")).where("k > 1").collect()
    assert [r["text"] for r in split] == ["hot " * 20]


# ---------------------------------------------------------------- 5 language

def test_language_on_held_out_texts(spark):
    frame = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.identify(frame).join(frame.select("doc_id", "lang"), "doc_id").where("held_out and lang_pred != 'und'").collect()
    assert len(got) > 150 and sum(r["lang"] == r["lang_pred"] for r in got) / len(got) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_awkward(odd, none, docs):
    got = {r["doc_id"]: r for r in language.identify(odd).collect()}
    assert all(got[i]["lang_pred"] == "und" for i in (2, 3, 7, 9, 10)) and got[5]["lang_pred"] != "und"
    for i, r in got.items():
        assert r["held_out"] == (zlib.crc32(("" if i is None else str(i)).encode()) % 4 == 2)
    assert language.identify(none).count() == 0
    unlabelled = language.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r["lang_pred"] for r in unlabelled} == {"und"}
    assert language.keep_identified(odd).columns == odd.columns


def test_chunked_grams_are_all_grams(monkeypatch):
    text = "Abcdefghij" * 7
    whole = [sorted(np.concatenate(list(language.grams(text))))]
    monkeypatch.setattr(language, "CHUNK", 8)
    assert [sorted(np.concatenate(list(language.grams(text))))] == whole


# ---------------------------------------------------------------- 6 language model

@pytest.mark.parametrize("name", ["docs", "odd", "none"])
def test_class_model(request, name, monkeypatch):
    monkeypatch.setattr(class_lm, "CLUSTERED", 60)
    monkeypatch.setattr(class_lm, "LOOKED_UP", 200)
    frame = request.getfixturevalue(name)
    counts, rows = collections.Counter(), []
    for i, t in texts(frame):
        tokens = [w.encode().lower() for w in SPACE.findall(t)] + [None]
        held = zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
        rows.append((i, held, tokens))
        if not held:
            counts.update(tokens)
    n, v = sum(counts.values()), len(counts)
    want = sorted(((i, held, len(ts), sum(t in counts for t in ts), n) for i, held, ts in rows), key=str)
    got = class_lm.score(frame).collect()
    assert sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) for r in got), key=str) == want
    base = sorted(sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in ts) for _, _, ts in rows)
    assert np.allclose(sorted(r["base_score"] for r in got), base)


def test_class_model_beats_unigrams_on_held_out_texts(spark):
    frame = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sums = class_lm.score(frame).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert sums[0] > sums[1]


def test_emissions_and_transitions_sum_to_one(docs):
    model, counts = class_lm.train(docs)
    rows = counts.collect()
    units = {}
    for r in rows:
        unit = model.known.get(r["word"].encode(), (model.n_clustered + r["shape"], 0))[0]
        units.setdefault((float(model.floor[unit]), model.transition[unit].tobytes()), []).append(r["n"])
    for (floor, _), ns in units.items():
        assert sum((c + class_lm.DELTA) * 10 ** floor for c in ns) <= 1 + 1e-6
    assert np.isfinite(model.transition).all()


def test_exchange_raises_the_likelihood():
    rng = np.random.default_rng(1)
    group = np.arange(40) % 4
    pairs = rng.poisson(np.where((group[:, None] + 1) % 4 == group[None, :], 20, 1)).astype(float)
    pairs = np.pad(pairs, ((0, 1), (0, 1)), constant_values=1)
    shuffled = np.append(rng.permutation(40), 40)
    of = class_lm.exchange(pairs[np.ix_(shuffled, shuffled)], 40, classes=4)

    def likelihood(of):
        member = np.eye(of.max() + 1)[of]
        c = member.T @ pairs[np.ix_(shuffled, shuffled)] @ member
        return sum(x * math.log(x) for x in c.ravel() if x) - sum(x * math.log(x) for x in [*c.sum(0), *c.sum(1)] if x)

    assert likelihood(of) >= 0.99 * likelihood(np.append(group[shuffled[:40]], 4)) or likelihood(of) > likelihood(np.append(np.arange(40) % 4, 4))


def test_gains_are_those_of_the_likelihood():
    rng = np.random.default_rng(3)
    pairs = rng.poisson(0.7, (12, 12)).astype(float)
    of = np.append(rng.integers(0, 4, 11), 4)
    table = lambda of: np.eye(5)[of].T @ pairs @ np.eye(5)[of]
    rows = []
    for w in range(11):
        found = collections.Counter({5: pairs[w, w]})
        for x in range(12):
            if x != w:
                found[of[x]] += pairs[w, x]
                found[6 + of[x]] += pairs[x, w]
        rows.append(sorted((c, n) for c, n in found.items() if n))
    flat = [x for r in rows for x in r]
    _, gain = class_lm.best_classes(
        np.cumsum([0] + [len(r) for r in rows[:-1]]), np.repeat(of[:11], [len(r) for r in rows]), np.array([c for c, _ in flat]),
        np.array([n for _, n in flat]), table(of))
    now = class_lm.likelihood(table(of))
    for w in range(11):
        for c in range(4):
            assert abs(class_lm.likelihood(table(np.r_[of[:w], c, of[w + 1:]])) - now - gain[w, c]) < 1e-6


def test_no_word_takes_the_class_of_the_end():
    """Words that stand at the start of texts' sentences have the end's neighbours."""
    between = np.array([[2, 1, 1, 1], [5, 3, 1, 1], [1, 4, 2, 60], [60, 1, 1, 0]], float)
    best, gain = class_lm.best_classes(np.array([0]), np.array([1]), np.array([0, 5 + 2]), np.array([4, 4]), between)
    assert gain[0].argmax() == 3 and best[0] < 3


def test_every_word_may_leave_its_shape(spark, monkeypatch):
    """Words of one length and alphabet in two kinds of context, most of them beyond those that workers look up."""
    monkeypatch.setattr(class_lm, "CLUSTERED", 8)
    monkeypatch.setattr(class_lm, "LOOKED_UP", 20)
    rng = np.random.default_rng(2)
    kinds = {k: [f"{k}{i:02d}" for i in range(40)] for k in "ab"}
    near = {"a": ["the", "an", "one"], "b": ["we", "they", "you"]}
    line = lambda k: f"{rng.choice(near[k])} {rng.choice(kinds[k])} {rng.choice(near[k])}"
    frame = spark.createDataFrame([(i, " ".join(line("ab"[int(rng.integers(2))]) for _ in range(40))) for i in range(60)], "doc_id long, text string")
    model, counts = class_lm.train(frame)
    classes = {r["word"]: r["class"] for r in counts.collect()} | {w.decode(): c for w, (c, _) in model.known.items()}
    assert len(model.known) <= 20 and all(classes[w] < model.n_clustered for k in "ab" for w in kinds[k] if w in classes)
    main = {k: collections.Counter(classes[w] for w in kinds[k] if w in classes).most_common(1)[0] for k in "ab"}
    assert main["a"][0] != main["b"][0] and min(n for _, n in main.values()) >= 20
    held = {r["doc_id"]: r for r in class_lm.score(frame, (model, counts)).collect()}
    table = {r["word"]: r["n"] for r in counts.collect()}
    for r in frame.collect():
        path = [len(model.transition) - 1]
        want = 0.0
        for w in r["text"].split():
            path.append(classes.get(w, model.n_clustered + class_lm.shape(w.encode())))
            want += math.log10(table.get(w, 0) + class_lm.DELTA)
        path.append(path[0])
        want += sum(model.transition[a, b] + model.floor[b] for a, b in zip(path, path[1:]))
        assert abs(held[r["doc_id"]]["score"] - want) < 1e-3


def test_class_training_leaves_only_counts_and_classes(docs):
    folder = shared_dir(docs.sparkSession)
    before = set(os.listdir(folder))
    class_lm.train(docs)[1].collect()
    left = {name.rsplit("-", 1)[0] for name in set(os.listdir(folder)) - before}
    assert left == {"llm-word-counts", "llm-word-classes"}
    assert not [d for d in docs.sparkSession.catalog.listDatabases() if d.name.startswith("class_lm")]


# ---------------------------------------------------------------- 7 simhash

def plain_simhash(text, words):
    tokens = SPACE.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    shingles = [" ".join(tokens[i:i + words]) for i in range(max(1, len(tokens) - words + 1))] if tokens else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(prints, distance):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= distance:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(prints))]


@pytest.mark.parametrize("name", ["docs", "odd", "none"])
def test_simhash(request, name):
    frame = request.getfixturevalue(name)
    rows = texts(frame)
    prints = [plain_simhash(t, 4) for _, t in rows]
    groups = plain_groups(prints, 4)
    least = {}
    for (i, _), g in zip(rows, groups):
        least[g] = i if least.get(g) is None else least[g] if i is None else min(i, least[g])
    want = collections.Counter((i, p - (1 << 64) if p >> 63 else p, least[g]) for (i, _), p, g in zip(rows, prints, groups))
    assert collections.Counter(tuple(r) for r in simhash.near_duplicates(frame).collect()) == want


def test_near_groups_on_dense_fingerprints(spark):
    """Chains and balls that no single pivot covers, among strangers."""
    rng = np.random.default_rng(5)
    flip = lambda x, k: int(x) ^ sum(1 << int(b) for b in rng.choice(64, k, replace=False))
    prints = {int(x) for x in rng.integers(0, 1 << 63, 150)}
    for _ in range(3):
        now = int(rng.integers(0, 1 << 63))
        for _ in range(40):
            now = flip(now, 4)
            prints.add(now)
    for _ in range(3):
        center = int(rng.integers(0, 1 << 63))
        prints |= {flip(center, int(rng.integers(0, 6))) for _ in range(90)}
    prints = sorted(x - (1 << 64) if x >> 63 else x for x in prints)
    want = plain_groups([x & (1 << 64) - 1 for x in prints], 4)
    found = {r["node"]: r["root"] for r in simhash.near_groups(spark.createDataFrame([(x,) for x in prints], "fp long")).collect()}
    ours = [found.get(x, x) for x in prints]
    assert len(set(zip(want, ours))) == len(set(want)) == len(set(ours))


def test_keep_first(spark, odd, none):
    """One document of each group of four bits; an unlinked text stays, also beside a linked one of the same doc_id."""
    rows = texts(odd)
    least = {}
    for (i, _), g in zip(rows, plain_groups([plain_simhash(t, 4) for _, t in rows], 4)):
        if i is not None:
            least[g] = min(i, least.get(g, i))
    want = collections.Counter(
        i for (i, _), g in zip(rows, plain_groups([plain_simhash(t, 4) for _, t in rows], 4)) if i is None or i == least[g])
    kept = simhash.keep_first(odd)
    assert kept.columns == odd.columns
    assert collections.Counter(r["doc_id"] for r in kept.collect()) == want
    assert simhash.keep_first(none).count() == 0
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(1, text), (2, text.upper()), (2, "quite another text that is linked with nothing"), (3, text)]
    kept = simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["text"]) for r in kept) == [rows[0], rows[2]]


def test_keep_identified_keeps_columns_of_any_name(odd, none):
    kept = language.keep_identified(odd)
    assert kept.columns == odd.columns
    want = collections.Counter(r["doc_id"] for r in language.identify(odd).collect() if r["score"] >= language.MIN_SCORE)
    assert collections.Counter(r["doc_id"] for r in kept.collect()) == want
    assert language.keep_identified(none).count() == 0


def test_personal_data_learns_from_every_candidate(spark):
    """Ten candidates of a class among 25,000 are learned from, wherever their hashes lie."""
    rows = spark.range(25_000).select(
        F.lit(0.0).alias("label"), F.lit(0.0).alias("f_a"), (F.col("id") % 7).cast("double").alias("f_b"), (F.col("id") * 1_000_003).alias("draw"))
    few = spark.createDataFrame([(1.0, 1.0, 0.0, n * 2_000_000 * 1_000_003 + 1_000_002) for n in range(10)],
                                "label double, f_a double, f_b double, draw long")
    assembler, model, threshold = personal_data._fit(rows.unionByName(few), ["f_a", "f_b"])
    asked = assembler.transform(spark.createDataFrame([(1.0, 0.0), (0.0, 3.0)], "f_a double, f_b double"))
    assert [r["probability"][1] >= threshold for r in model.transform(asked).collect()] == [True, False]


def test_personal_data_threshold_counts_equal_probabilities_together(spark):
    rows = [(0.9, 1.0, 199.0), (0.8, 1.0, 1.0), (0.8, 0.0, 1.0), (0.7, 0.0, 5.0)]
    assert personal_data._threshold(spark.createDataFrame(rows, "p double, label double, weight double")) == 0.8
    rows[2] = (0.8, 0.0, 3.0)
    assert personal_data._threshold(spark.createDataFrame(rows, "p double, label double, weight double")) == 0.9


def test_personal_data_survives_long_runs(spark):
    """Two megabytes of one unit each: no pattern needs a stack as deep as its match is long, or time by its square."""
    units = [".a", "a.", "@a", "a@a.", "1.", "1 ", "4111 ", "+1 ", "+1(", "(at) a", " dot", "[dot] a", "mail a (at) b (dot) c ", "555-", "0049 "]
    rows = [(i, "x (at) a", u, 2_000_000 // len(u)) for i, u in enumerate(units)] + [(99, "a.b@c.org", "", 0)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, unit string, n int").repartition(8).select(
        "doc_id", F.concat("text", F.expr("repeat(unit, n)")).alias("text"))
    got = {r["doc_id"]: r["n"] for r in personal_data.find(frame).select("doc_id", F.size("base").alias("n")).collect()}
    assert set(got) == {r[0] for r in rows} and got[99] == 1 and got[4] == 250_000


# ---------------------------------------------------------------- 8 BPE

@pytest.mark.parametrize("name", ["docs", "odd", "none"])
def test_bpe(request, name):
    frame, code = request.getfixturevalue(name), library()
    want = collections.Counter()
    for i, t in texts(frame):
        ids = code.encode(t, add_special_tokens=False).ids
        want[i, np.array(ids, "<u4").tobytes(), len(ids), code.decode(ids, skip_special_tokens=False)] += 1
    got = collections.Counter((r["doc_id"], bytes(r["ids"]), r["n_tokens"], r["decoded"]) for r in bpe.round_trip(frame, queries.vocabulary()).collect())
    assert got == want


def test_transducer_emits_the_same_tokens_in_any_pieces():
    merges = bpe.Merges(queries.vocabulary())
    rng = np.random.default_rng(7)
    for alphabet in ("etaoinsh", "a", "=-", "0123456789"):
        data = "".join(rng.choice(list(alphabet), 5_000)).encode()
        coder = bpe.Transducer(merges)
        coder.window = merges.lookahead + 8
        out, at, held = [], 0, 0
        while at < len(data):
            n = int(rng.integers(1, 200))
            out += coder.push(data[at:at + n])
            held, at = max(held, len(coder.held)), at + n
        assert out + coder.close() == merges.merge(data)
        assert held <= coder.window + merges.lookahead + 200


def test_short_spans_and_broken_bytes():
    merges, code = bpe.Merges(queries.vocabulary()), library()
    coder = bpe.Encoder(merges, span=16)
    rng = np.random.default_rng(9)
    pieces = ["a", " ", "  ", "\n", "'s", "'re", "th", "1", "é", "字", "!", "\t", "𝄞", "aaaaaaaaaaaaaaaaaaaaaaaa", " \n "]
    for _ in range(300):
        text = "".join(rng.choice(pieces, int(rng.integers(0, 60))))
        assert np.frombuffer(coder.encode(text), "<u4").tolist() == code.encode(text, add_special_tokens=False).ids
        ids = rng.integers(0, 50_257, 40).tolist()
        assert bpe.decode(merges, np.array(ids, "<u4").tobytes(), 3) == code.decode(ids, skip_special_tokens=False)


# ---------------------------------------------------------------- 9 personal data

def plain_base(text):
    """The contract's patterns by Python's own engine."""
    out = []
    for kind, pattern in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"), ("ip", r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}"),
                          ("card", r"[0-9](?:[\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(pattern, text) if kind != "email" or "@" in text else ():
            digits = re.sub("[^0-9]", "", m.group())
            odd = [int(d) for d in digits[::-1]]
            good = {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in m.group().split(".")),
                    "card": lambda: 16 <= len(digits) <= 19 and sum(odd[::2] + [2 * d - 9 * (d > 4) for d in odd[1::2]]) % 10 == 0,
                    "phone": lambda: 8 <= len(digits) <= 15}[kind]()
            if good:
                out.append((kind, m.start(), m.end()))
    return out


NASTY = ["a@b.com%foo@x.y z", "a@b a@b.c.d-e.", "1.2.3.4.5.6.7.8 1.2.3.256 001.2.3.4", "4111-1111-1111-1111 4111 1111 1111 1112",
         "41111111111111111111111111", "+1 (736) 555-2678 +1-2 ++49 30 1234567. +49(30)", "é𝄞 x@y.zz 𝄞 10.0.0.1", "@@ @a.b .@a.b a@.b", "+1" + " " * 50 + "2345678"]


@pytest.mark.parametrize("name", ["docs", "odd", "none"])
def test_personal_data(request, name, spark):
    frame = request.getfixturevalue(name)
    if name == "odd":
        frame = frame.select("doc_id", "text").union(spark.createDataFrame(list(enumerate(NASTY, 100)), "doc_id long, text string"))
    got = personal_data.find(frame).collect()
    show = lambda spans: ",".join(":".join(map(str, s)) for s in spans)
    want = collections.Counter((i, show(plain_base(t))) for i, t in texts(frame))
    assert collections.Counter((r["doc_id"], show(r["base"])) for r in got) == want
    assert all(set(map(tuple, r["base"])) <= set(map(tuple, r["spans"])) for r in got)


def test_trees_add_wider_spans(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(400):
        digits = "".join(map(str, rng.integers(0, 10, 10)))
        rows.append((i, f"call +1 {digits[:3]} {digits[3:6]} {digits[6:]} host 10.{i % 300}.0.1 pay {digits}{digits[:6]}"))
    rows.append((1000, "call (736) 555-2678 now"))
    got = personal_data.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    for r in got:
        spans = sorted((s["start"], s["end"]) for s in r["spans"])
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:])) or len(r["spans"]) == len(r["base"])


# ---------------------------------------------------------------- 10 mixing

def test_mix_awkward(odd, none):
    got = mixing.mix(odd).collect()
    by = collections.Counter((r["row"]["doc_id"], r["row"]["text"]) for r in got)
    assert all(set(r["row"].asDict()) == set(odd.columns) for r in got)
    assert [r["mix_key"] for r in got] == sorted(r["mix_key"] for r in got)
    for r in got:
        assert by[r["row"]["doc_id"], r["row"]["text"]] % r["copies"] == 0
    assert mixing.mix(none).count() == 0


def test_mix_follows_rates(spark):
    frame = spark.range(40_000).select(F.col("id").alias("doc_id"), F.lit("word").alias("text"), F.when(F.col("id") % 100 == 0, "rare").otherwise("hot").alias("source"))
    rates = {r["of_source"]: r["rate"] for r in mixing.rates(frame, {"rare": 1, "hot": 1}).collect()}
    assert rates == {"rare": 50.0, "hot": round(40_000 / 2 / 39_600, 9)}
    got = mixing.mix(frame, {"rare": 1, "hot": 1}).groupBy("source").agg(F.count("*").alias("n"), F.max("copies").alias("most")).collect()
    n = {r["source"]: r["n"] for r in got}
    assert abs(n["rare"] - 20_000) < 800 and abs(n["hot"] - 20_000) < 800


def test_mix_query_reads_the_mixed_texts(spark, monkeypatch):
    mix = mixing.mix
    monkeypatch.setattr(mixing, "mix", lambda docs: mix(docs).withColumn("row", F.col("row").withField("text", F.lit("lost"))))
    with pytest.raises(Exception, match="a mixed text differs"):
        queries.QUERIES["op10_poisson_mix"](spark, SF).collect()


# ---------------------------------------------------------------- 11 substring dedup

def plain_repeats(rows, window):
    """(doc_id, n_words, spans) of every row."""
    tokens = [SPACE.findall(t or "") for _, t in rows]
    least = {}
    for (i, _), ws in zip(rows, tokens):
        if i is not None:
            for p in range(len(ws) - window + 1):
                key = tuple(ws[p:p + window])
                least[key] = min(i, least.get(key, i))
    out = []
    for (i, _), ws in zip(rows, tokens):
        gone = set()
        if i is not None:
            for p in range(len(ws) - window + 1):
                if least[tuple(ws[p:p + window])] < i:
                    gone.update(range(p, p + window))
        spans = [(a, next(b for b in range(a, len(ws) + 1) if b not in gone)) for a in sorted(gone) if a - 1 not in gone]
        out.append((i, len(ws), tuple(spans), " ".join(w for p, w in enumerate(ws) if p not in gone)))
    return collections.Counter(out)


def found_repeats(frame, rows, window, prefix):
    got = collections.Counter()
    for r in repeats.repeats(frame, window, prefix).collect():
        spans = tuple((s["start"], s["end"]) for s in r["spans"])
        kept = r["kept"]
        if kept is None:
            kept = next(j for j in (" ".join(SPACE.findall(t or "")) for i, t in rows if i == r["doc_id"])
                        if hashlib.sha256(j.encode()).hexdigest() == r["words_sha256"])
        got[r["doc_id"], r["n_words"], spans, kept] += 1
    return got


@pytest.mark.parametrize("leaves", [4096, 3])
def test_repeats_awkward(spark, odd, none, monkeypatch, leaves):
    """Few words, so that repeats of every length and place occur; copies, periodic texts, shared passages; subtrees of
    any size and split ones."""
    monkeypatch.setattr(repeats, "LEAVES", leaves)
    rng = np.random.default_rng(11)
    rows = []
    passage = [f"p{i}" for i in range(30)]
    for i in range(150):
        text = [f"w{x}" for x in rng.integers(0, 3 if i % 3 else 400, rng.integers(0, 60))]
        if i % 4 == 0:
            at = int(rng.integers(0, len(text) + 1))
            text[at:at] = passage[int(rng.integers(0, 8)):int(rng.integers(20, 31))]
        rows.append((int(rng.integers(0, 90)), " ".join(text)))
    rows += [(200 + i, rows[i][1]) for i in range(0, 60, 3)] + [(300, "a " * 100), (301, "a b " * 60), (299, "b a " * 40), (None, rows[0][1]), rows[1]]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("?") for c in ("key", "lead", "live", "spans", "prefix", "n", "leaf")})
    assert found_repeats(frame.repartition(5), rows, 10, 4) == plain_repeats(rows, 10)
    if leaves == 3:
        every = texts(odd)
        assert found_repeats(odd, every, 50, 16) == plain_repeats(every, 50)
        left = repeats.strip(frame, 10, 4)
        assert left.columns == frame.columns
        want = collections.Counter((i, kept) for (i, _, _, kept), k in plain_repeats(rows, 10).items() for _ in range(k))
        assert collections.Counter((r["doc_id"], r["text"].strip()) for r in left.collect()) == want
        assert repeats.repeats(none).count() == 0 and repeats.strip(none).count() == 0


def test_anchors_are_set_by_the_window_alone():
    rng = np.random.default_rng(5)
    passage = rng.integers(0, 1 << 62, 80).astype(np.uint64)
    powers, places = repeats._Powers(), []
    for before in (0, 7, 300):
        text = np.concatenate([rng.integers(0, 1 << 62, before).astype(np.uint64), passage, rng.integers(0, 1 << 62, 40).astype(np.uint64)])
        at, runs, first, last = repeats.anchors(text, powers, 50, 16)
        assert first[0] == 0 and (first[1:] == last[:-1] + 1).all() and last[-1] == len(text) - 50
        assert ((first <= at) & (at <= first + 34) & (last <= at)).all()
        of_window = np.repeat(np.arange(len(at)), last - first + 1)
        places.append([(int(at[k]) - p, int(runs[k])) for p, k in enumerate(of_window)][before:before + 31])
    assert places[0] == places[1] == places[2]


# ---------------------------------------------------------------- 12 search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_search(rows, items, top=10):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    bags = [(i, collections.Counter(TERM.findall((t or "").translate(lower)))) for i, t in rows]
    bags = [(i, bag) for i, bag in bags if bag]
    n, words = len(bags), sum(sum(bag.values()) for _, bag in bags)
    df = collections.Counter(t for _, bag in bags for t in bag)
    want = []
    for item_id, text in items:
        scored = []
        for i, bag in bags:
            m = 10 + (90 * sum(bag.values()) * n) // words
            scored.append((-sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * bag[t]) // (1000 * bag[t] + 8 * m))
                                for t in set(TERM.findall((text or "").translate(lower))) if bag[t]), i is None, i or 0, i))
        want += [(item_id, rank, s[3], -s[0]) for rank, s in enumerate(sorted(s for s in scored if s[0] < 0)[:top], 1)]
    return collections.Counter(want)


def test_search_awkward(spark, odd, none, docs, monkeypatch):
    """Small blocks, several groups of queries, repeated and null items, ties, and documents of every size."""
    monkeypatch.setattr(search, "BLOCK_DOCS", 24)
    monkeypatch.setattr(search, "AT_ONCE", 2)
    monkeypatch.setattr(search, "ITEMS", 4)
    monkeypatch.setattr(search, "SMALL", 5)
    every = odd.select("doc_id", "text").union(docs.select("doc_id", "text")).withColumns({c: F.lit("?") for c in ("mark", "item", "rank", "bound")})
    items = [(1, "the AND of"), (1, "the AND of"), (None, "x<|endoftext|>y 𝄞É"), (2, None), (3, ""), (4, "neverseen !"), (5, "a b c d"),
             *[(10 + i, t[:200]) for i, (_, t) in enumerate(texts(docs)[:6])]]
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("term", F.lit("?"))
    got = collections.Counter(tuple(r) for r in search.search(every, asked).collect())
    assert got == plain_search([(r["doc_id"], r["text"]) for r in every.select("doc_id", "text").collect()], items)
    assert search.search(none, asked).count() == 0 and search.search(docs, asked.where("false")).count() == 0


def test_signatures_bound_every_score(docs):
    """Upper bounds are never below the exact scores."""
    asked = search._queries(docs.select(F.col("doc_id").alias("item_id"), "text").limit(20).collect())
    rows = search.signatures(docs, asked).collect()
    n, words = sum(r["docs"] or 0 for r in rows), sum(r["words"] or 0 for r in rows)
    w = search.Weights(n, words, np.arange(1, len(asked.terms) + 1))
    hashes = np.array([xxhash.xxh64_intdigest(t) for t in asked.terms], np.uint64)
    bags = {i: collections.Counter(search.terms(t)) for i, t in texts(docs)}
    ratio = []
    for r in rows:
        if r["slices"] is not None:
            lengths = np.array(r["lengths"])
            slices = np.frombuffer(r["slices"], np.uint8).reshape(-1, -(-len(lengths) // 8))
            for first, bounds in search._bounds(slices, lengths, hashes, asked, w):
                for k, bound in enumerate(bounds):
                    for doc_id, length, most in zip(r["doc_ids"], lengths, bound):
                        score = sum(int(w.weight[t]) * search._saturated(bags[doc_id][asked.terms[t]], search._length_factor(length, w))
                                    for t in asked.of[first + k].tolist())
                        assert most >= score
                        ratio.append(score / max(1, most))
    assert np.mean(ratio) > 0.5  # and not far above them


# ---------------------------------------------------------------- 13 whitening

def plain_whitening(rows, components=32):
    """vec_id -> (deviation, whitened up to sign, explained), by exact integers and a library's eigenvectors."""
    good = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for _, v in good]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    exact = [[n * c - s for c, s in zip(v, sums)] for v in x]
    d = np.array([[c / n for c in v] for v in exact])
    cov = d.T @ d / n
    values, axes = np.linalg.eigh(cov)
    order = np.argsort(-values)[:components]
    out = {}
    for (i, _), e, row in zip(good, exact, d):
        out[i] = (sum(c * c for c in e), np.abs(row @ axes[:, order] / np.sqrt(values[order])), values[order] / np.trace(cov))
    return n, out


def test_whitening_by_a_library(spark):
    frame = spark.read.parquet(f"{SF}/embeddings.parquet")
    n, want = plain_whitening([(r["vec_id"], r["embedding"]) for r in frame.collect()])
    got = collections.defaultdict(dict)
    for r in queries.QUERIES["op13_whitening"](spark, SF).collect():
        assert r["n"] == n and r["deviation"] == want[r["vec_id"]][0] and r["identity_error"] < 1e-9
        got[r["vec_id"]][r["component"]] = (r["whitened"], r["explained"])
    assert set(got) == set(want) and all(set(c) == set(range(1, 33)) for c in got.values())
    for i, (_, whitened, explained) in want.items():
        assert np.allclose([abs(got[i][c][0]) for c in range(1, 33)], whitened, atol=1e-7)
        assert np.allclose([got[i][c][1] for c in range(1, 33)], explained, rtol=1e-10)


def test_factor_and_rotations():
    rng = np.random.default_rng(2)
    for d, rank in ((1, 1), (7, 7), (12, 5), (33, 33)):
        half = rng.normal(size=(d, rank)) * 10.0 ** rng.integers(-1, 3, rank)
        scatter = half @ half.T
        factor, order = whitening.pivoted_cholesky(scatter)
        assert factor.shape == (d, rank)
        assert np.allclose(factor @ factor.T, scatter[order][:, order], rtol=1e-9, atol=1e-9 * abs(scatter).max())
        assert np.allclose(factor, np.tril(factor)) and (np.diff(np.diag(factor)) <= 1e-9 * factor[0, 0]).all()
        turned = whitening.one_sided_jacobi(factor)
        gram = turned.T @ turned
        assert np.abs(gram - np.diag(np.diag(gram))).max() <= 1e-12 * gram.max()
        assert np.allclose(np.diag(gram), np.linalg.eigvalsh(scatter)[::-1][:rank], rtol=1e-6)
    assert whitening.principal(np.zeros((3, 3)), 5)[1].size == 0


def test_whitening_awkward(spark):
    rng = np.random.default_rng(9)
    rows = [(i, [float(c) for c in rng.normal(size=3)]) for i in range(40)]
    rows += [(40, None), (41, [float("nan"), 1.0, 2.0]), (42, [None, 1.0, 2.0]), (43, [1.0, float("inf"), 0.0]), (44, []), (45, [1e300, 0.0, 0.0]),
             (46, [1.0] * 5), (47, [1.0] * 5), (0, rows[0][1])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit("?") for c in ("dim", "vector", "n", "component", "label")})
    models = whitening.fit(frame.repartition(5))
    assert whitening.identity_error(frame, models) < 1e-12
    got = whitening.whiten(frame, models).collect()
    n, want = plain_whitening([(j, v) for j, (i, v) in enumerate(rows) if v and len(v) == 3 and i != 45])
    assert collections.Counter(r["vec_id"] for r in got) == {i: 6 if i == 0 else 3 for i in range(40)}  # equal vectors of length 5 have no variance
    for r in got:
        assert r["n"] == n == 41 and r["deviation"] == want[r["vec_id"]][0]
        assert abs(abs(r["whitened"]) - want[r["vec_id"]][1][r["component"] - 1]) < 1e-9
    large = spark.createDataFrame([(1, [1e12]), (2, [-1e12])], "vec_id long, embedding array<double>")
    assert [r["deviation"] for r in whitening.whiten(large, whitening.fit(large)).collect()] == [None, None]
    none = frame.where("false")
    assert whitening.fit(none) == {} and whitening.whiten(none, {}).count() == 0 and whitening.identity_error(none, {}) == 0.0


# ---------------------------------------------------------------- joins that Spark sizes too low

def joined_by(df):
    return next(line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Join [" in line)


@pytest.fixture
def narrow(spark, tmp_path):
    """A small file, which may hold, or explode into, far more rows than the driver has room for."""
    text = F.concat_ws(" ", *[F.xxhash64(F.col("id") % 50, F.lit(i)).cast("string") for i in range(6)])
    spark.range(300).select(F.col("id").alias("doc_id"), text.alias("text")).write.parquet(f"{tmp_path}/docs")
    return spark.read.parquet(f"{tmp_path}/docs")


def test_fingerprints_and_cells_are_not_sent_through_the_driver(narrow, monkeypatch):
    joins = {}

    def seen(df, name, keep=simhash.stored):
        joins[name] = joined_by(df) if name == "simhash-cells" else None
        return keep(df, name)

    monkeypatch.setattr(simhash, "stored", seen)
    found = simhash._grouped(narrow, 4, 4)
    assert "SortMergeJoin [cell" in joins["simhash-cells"] and "SortMergeJoin [fp" in joined_by(found)
    assert found.where("doc_id = component_id").count() == 50


def test_digests_are_not_sent_through_the_driver(narrow):
    found = exact_dedup.report(narrow)
    assert "SortMergeJoin [digest" in joined_by(found) and found.where("kept").count() == 50


# ---------------------------------------------------------------- pipeline

def test_pipeline_by_plain_python(spark):
    """Each stage on what the stage before kept."""
    frame = spark.read.parquet(f"{SF}/documents.parquet")
    names, now = frame.columns, frame
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, now, SF).cache()
        if name == "language_id":
            assert {r["doc_id"] for r in now.collect()} - {r["doc_id"] for r in after.collect()} <= {
                r["doc_id"] for r in language.identify(now).where("score < 0.5").collect()}
        if name == "exact_dedup":
            keep = {}
            for i, t in texts(now):
                keep[t] = max(i, keep.get(t, i))
            assert sorted(keep.values()) == sorted(r["doc_id"] for r in after.collect())
        if name == "simhash_dedup":
            rows = texts(now)
            groups = plain_groups([plain_simhash(t, 4) for _, t in rows], 4)
            least = {}
            for (i, _), g in zip(rows, groups):
                least[g] = min(i, least.get(g, i))
            assert sorted(least.values()) == sorted(r["doc_id"] for r in after.collect())
        if name != "bpe_round_trip":
            assert after.columns == names
            now = after
        else:
            code = library()
            want = collections.Counter((i, len(code.encode(t, add_special_tokens=False).ids)) for i, t in texts(now))
            assert collections.Counter((r["doc_id"], r["n_tokens"]) for r in after.collect()) == want


def test_queries_with_sql_agree(spark):
    import compare
    con = compare.connect(SF)
    for name in ("op3_exact_dedup", "op10_poisson_mix", "op11_repeats", "op12_bloom_search"):
        assert compare.difference(spark, con, queries.QUERIES[name], queries.ORACLES[name], SF) == ""


def test_units_with_odd_white_space_equal_the_library():
    rng = random.Random(7)
    parts = ["a", "Bc", "7", "é", "漢", ",", ".", "!", " ", " ", "  ", "\n", "\r\n", " ", "　", "\x1c", "'s",
             "<|endoftext|>", "x" * 60, "y" * 60 + ",", "\x00"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(14))) for _ in range(5000)]
    code = token_files.Coder(queries.vocabulary())
    found = [ids for at in range(0, len(texts), 100) for ids in code.encode(texts[at:at + 100])]
    assert found == code._ids(texts)
    assert max(map(len, code.units)) <= token_files.LONGEST  # long units are not remembered
