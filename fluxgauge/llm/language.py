"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fluxgauge.llm.common import id_remainder, stored, text_batches

ORDERS = (1, 2, 3)
BUCKETS = 1 << 16      # hashed n-grams
CHUNK = 1 << 17        # characters whose n-grams are looked up together
SAMPLE = 2_000         # texts per language, about: the bound of the fitted sample
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 1e-4, 1e-5   # follow-the-regularised-leader with elastic net
UNKNOWN = "und"
MIN_SCORE = 0.5


def _hashes(points: np.ndarray) -> list[np.ndarray]:
    """Bucket of every n-gram of a text's lower-cased code points, by order."""
    out, rolled = [], np.zeros(len(points), np.uint32)
    for n in range(1, max(ORDERS) + 1):
        ends = len(points) - n + 1
        if ends <= 0:
            break
        rolled = rolled[:ends] * np.uint32(0x01000193) + points[n - 1:] + np.uint32(n)
        if n in ORDERS:
            mixed = rolled * np.uint32(0x9E3779B1)
            out.append(((mixed ^ (mixed >> np.uint32(15))) & np.uint32(BUCKETS - 1)).astype(np.intp))
    return out


def grams(text: str):
    """Buckets of all n-grams of a whole text, a chunk at a time; chunks overlap by what an n-gram needs."""
    points = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)
    for at in range(0, len(points), CHUNK):
        for n, buckets in zip(ORDERS, _hashes(points[at:at + CHUNK + max(ORDERS) - 1])):
            yield buckets[:CHUNK]


def term_frequencies(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and their share of the text's n-grams."""
    counts = sum((np.bincount(b, minlength=BUCKETS) for b in grams(text)), np.zeros(BUCKETS, np.int64))
    at = np.flatnonzero(counts)
    return at, counts[at] / max(1, counts.sum())


@dataclass
class Model:
    """weights: per bucket and language, with the IDF and the scale multiplied in; bias and temperature."""
    languages: list[str]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    def logits(self, text: str) -> np.ndarray:
        total, n = np.zeros(len(self.languages)), 0
        for buckets in grams(text):
            total += self.weights[buckets].sum(axis=0, dtype=np.float64)
            n += len(buckets)
        return total / max(1, n) + self.bias

    def predict(self, text: str) -> tuple[str, float]:
        z = self.logits(text) / self.temperature
        p = np.exp(z - z.max())
        best = int(p.argmax())
        return self.languages[best], float(p[best] / p.sum())


def has_letter(text: str | Column = "text") -> Column:
    return F.coalesce(F.rlike(F.col(text) if isinstance(text, str) else text, F.lit(r"\p{L}")), F.lit(False))


def learnable() -> Column:
    """Rows that may be learned from: labelled texts whose crc32(doc_id) mod 4 is not 2."""
    return (id_remainder(4) != 2) & F.col("lang").isNotNull() & has_letter()


def inverse_frequencies(docs: DataFrame) -> np.ndarray:
    """ln((1 + N) / (1 + df)) + 1 of every bucket over all texts that may be learned from."""
    def count(batches):
        seen, n = np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            for text in batch.column("text").to_pylist():
                here = np.zeros(BUCKETS, bool)
                for buckets in grams(text):
                    here[buckets] = True
                seen += here
                n += 1
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array([*at, -1], pa.int32()), "n": pa.array([*seen[at], n], pa.int64())})

    counted = docs.where(learnable()).select("text").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(
        F.sum("n").alias("n")).toPandas().set_index("bucket")["n"]  # BUCKETS rows at most
    df = counted.reindex(range(BUCKETS), fill_value=0).to_numpy()
    return np.log((1 + counted.get(-1, 0)) / (1 + df)) + 1


def fit_ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias by per-coordinate follow-the-regularised-leader; the last bucket stands for the bias."""
    z, n = np.zeros((BUCKETS + 1, classes)), np.zeros((BUCKETS + 1, classes))

    def weights(at):
        sign = np.sign(z[at])
        active = np.abs(z[at]) > L1
        return np.where(active, -(z[at] - sign * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2), 0.0)

    for _ in range(epochs):
        for at, x, label in rows:
            at, x = np.append(at, BUCKETS), np.append(x, 1.0)
            w = weights(at)
            score = x @ w
            p = np.exp(score - score.max())
            p /= p.sum()
            p[label] -= 1
            g = x[:, None] * p[None, :]
            step = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - step * w
            n[at] += g * g
    w = weights(np.arange(BUCKETS + 1))
    return w[:-1], w[-1]


def calibrate(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature that minimises the log loss, by golden-section search on its logarithm."""
    def loss(log_t):
        s = logits / np.exp(log_t)
        s = s - s.max(axis=1, keepdims=True)
        return float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(labels)), labels]).mean())

    low, high, ratio = np.log(0.02), np.log(50.0), (np.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def train(docs: DataFrame, sample: int = SAMPLE) -> Model | None:
    """Fit on about ``sample`` texts of every language, or all where there are fewer; None if there is nothing to learn.

    Document frequencies cover all texts that may be learned from. The fitted rows are chosen by a hash of doc_id, one
    in five of them only to calibrate the temperature. One task fits the weights: at most ``sample`` whole texts per
    language, as sparse vectors.
    """
    text_batches(docs.sparkSession)
    known = docs.where(learnable())
    # stored, so that the join knows how few rows these are and does not shuffle the texts
    sizes = stored(known.groupBy("lang").agg(F.count("*").alias("n")), "languages")
    idf = inverse_frequencies(docs)
    drawn = known.select("lang", "text", F.xxhash64(F.lit(11), "doc_id", "text").alias("draw")).join(
        sizes.withColumnRenamed("lang", "of_lang"), F.col("lang") == F.col("of_lang")).where(
        F.pmod("draw", F.lit(1_000_003)) < F.lit(1_000_003.0) * sample / F.col("n"))

    def sparse(batches):
        for batch in batches:
            found = [term_frequencies(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({
                "lang": batch.column("lang"), "draw": batch.column("draw"),
                "at": pa.array([a.astype(np.int32) for a, _ in found], pa.list_(pa.int32())),
                "tf": pa.array([f.astype(np.float32) for _, f in found], pa.list_(pa.float32()))})

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        languages = sorted(pdf["lang"].unique())
        pdf = pdf.sort_values("draw", ignore_index=True)
        label = pdf["lang"].map({lang: i for i, lang in enumerate(languages)}).to_numpy()
        raw = [(np.asarray(at), np.asarray(tf, np.float64) * idf[at]) for at, tf in zip(pdf["at"], pdf["tf"])]
        # one scale for all texts, so that scoring a text is a plain mean over its n-grams
        norm = max(1e-12, float(np.mean([np.sqrt((x * x).sum()) for _, x in raw])))
        rows = [(at, x / norm, int(y)) for (at, x), y in zip(raw, label)]
        held = np.arange(len(rows)) % 5 == 4
        w, bias = fit_ftrl([r for r, h in zip(rows, held) if not h], len(languages))
        check = held if held.sum() >= 5 else ~held
        logits = np.array([x @ w[at] + bias for (at, x, _), c in zip(rows, check) if c])
        scaled = w * idf[:, None] / norm
        return pd.DataFrame([{"languages": languages, "weights": scaled.astype("<f4").tobytes(), "bias": bias.tolist(),
                              "temperature": calibrate(logits, label[check])}])

    fitted = drawn.select("lang", "text", "draw").mapInArrow(
        sparse, "lang string, draw long, at array<int>, tf array<float>").withColumn("model", F.lit(1)).groupBy("model").applyInPandas(
        fit, "languages array<string>, weights binary, bias array<double>, temperature double").first()
    if fitted is None:
        return None
    weights = np.frombuffer(fitted["weights"], "<f4").reshape(BUCKETS, len(fitted["languages"]))
    return Model(list(fitted["languages"]), weights, np.array(fitted["bias"]), fitted["temperature"])


def identify(docs: DataFrame, model: Model | None = None, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred and score (0 to 1) for every whole text; trains a model on ``docs`` if none is given.

    A text that is null or has no letter is ``und`` with score 0, as is every text when nothing could be learned. The
    text alone decides the prediction: repeated rows get the same. An empty table gives no rows. The model, BUCKETS
    numbers per language, is broadcast; texts are not shuffled. ``lang`` should be text.
    """
    spark = docs.sparkSession
    text_batches(spark)
    model = model or train(docs, sample)
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for batch in batches:
            found = [m.predict(t) if letters and m else (UNKNOWN, 0.0)
                     for t, letters in zip(batch.column("text").to_pylist(), batch.column("letters").to_pylist())]
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"),
                "lang_pred": pa.array([lang for lang, _ in found], pa.string()), "score": pa.array([s for _, s in found], pa.float64())})

    schema = T.StructType([docs.schema["doc_id"]]).add("held_out", "boolean").add("lang_pred", "string").add("score", "double")
    return docs.select("doc_id", (id_remainder(4) == 2).alias("held_out"), "text", has_letter().alias("letters")).mapInArrow(run, schema)


def keep_identified(docs: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """The documents whose language is told with at least ``min_score``, with all their columns, in one pass."""
    spark = docs.sparkSession
    text_batches(spark)
    shared = spark.sparkContext.broadcast(train(docs))
    at = docs.columns.index("text")

    def run(batches):
        m = shared.value
        for batch in batches:
            row = batch.column("row")
            keep = [bool(letters and m and m.predict(t)[1] >= min_score)
                    for t, letters in zip(row.field(at).to_pylist(), batch.column("letters").to_pylist())]
            yield pa.RecordBatch.from_arrays(row.flatten(), schema=pa.schema(list(row.type))).filter(pa.array(keep, pa.bool_()))

    # the whole row in a struct: a column of any name stays clear of ours
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), has_letter().alias("letters"))
    return packed.mapInArrow(run, docs.schema)
