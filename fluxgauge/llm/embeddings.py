"""Near-duplicate vectors by an epsilon grid order join."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluxgauge.llm.common import arrow_rows, stored
from fluxgauge.llm.components import components

COSINE = 0.98
LEADING = 8         # principal dimensions of the grid
BLOCK_ROWS = 1024   # vectors of one sequence interval that is joined as a whole
FAN_OUT = 16        # intervals of one level that make one of the next
PAIR_ROWS = 8       # block pairs in one Arrow batch

VECTOR = "case when forall({c}, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists({c}, x -> x != 0) then {c} end"


def _unit(values: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in double precision; the greatest component is taken out first."""
    values = values / np.abs(values).max(axis=1, keepdims=True)
    return values / np.sqrt((values * values).sum(axis=1, keepdims=True))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.array(column.to_pylist(), np.float64)


def _by_dimension(batch: pa.RecordBatch):
    dims = np.array(batch.column("dim").to_pylist())
    for dim in np.unique(dims):
        yield int(dim), batch.take(pa.array(np.flatnonzero(dims == dim)))


def distinct_vectors(rows: DataFrame) -> DataFrame:
    """Usable vectors, each once per label: label, dim, the least vec_id ``rep``, its copies ``weight``, and its key."""
    usable = rows.where("vec_id is not null and label is not null and vector is not null")
    return usable.groupBy("label", "dim", "k1", "k2", "k3").agg(
        F.min("vec_id").alias("rep"), F.count("*").alias("weight"), F.first("vector").alias("vector"))


def principal_axes(vectors: DataFrame, leading: int = LEADING) -> dict[int, np.ndarray]:
    """For every vector length, the leading eigenvectors of all unit vectors' second moments."""
    def moments(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for dim, part in _by_dimension(batch):
                unit = _unit(_matrix(part.column("vector")))
                total[dim] = total.get(dim, 0) + unit.T @ unit
        for dim, m in total.items():
            yield pa.RecordBatch.from_pydict({"dim": pa.array([dim] * m.size, pa.int32()), "at": pa.array(range(m.size), pa.int32()),
                                              "value": pa.array(m.ravel())})

    summed = vectors.select("dim", "vector").mapInArrow(moments, "dim int, at int, value double").groupBy("dim", "at").agg(
        F.sum("value").alias("value")).toPandas()  # dim * dim numbers
    axes = {}
    for dim, part in summed.groupby("dim"):
        _, vectors_ = np.linalg.eigh(part.sort_values("at")["value"].to_numpy().reshape(dim, dim))
        axes[int(dim)] = vectors_[:, ::-1][:, :leading].copy()
    return axes


def ordered_blocks(vectors: DataFrame, axes: dict[int, np.ndarray], epsilon: float) -> DataFrame:
    """Vectors in epsilon grid order, cut into blocks of one label: bounds on the axes, ids, copies and values."""
    def place(batches):
        for batch in batches:
            for dim, part in _by_dimension(batch):
                cells = np.floor(_unit(_matrix(part.column("vector"))) @ axes[dim] / epsilon).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in ("label", "dim", "rep", "weight", "vector")), pa.array(list(cells), pa.list_(pa.int32()))],
                    ["label", "dim", "rep", "weight", "vector", "cells"])

    def pack(batches):
        interval, n, held = TaskContext.get().partitionId(), 0, []

        def flush():
            nonlocal n, held
            label, dim = held[0][:2]
            values = np.array([h[4] for h in held], np.float64)
            on_axes = _unit(values) @ axes[dim]
            row = {"interval": interval, "block": (interval << 32) + n, "label": label, "dim": dim,
                   "low": on_axes.min(axis=0).tolist(), "high": on_axes.max(axis=0).tolist(),
                   "ids": np.array([h[2] for h in held], "<i8").tobytes(), "weights": np.array([h[3] for h in held], "<i8").tobytes(),
                   "vectors": values.astype("<f8").tobytes()}
            n, held = n + 1, []
            return pa.RecordBatch.from_pylist([row], schema=packed)

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("label", "dim", "rep", "weight", "vector"))):
                if held and (row[:2] != held[0][:2] or len(held) == BLOCK_ROWS):
                    yield flush()
                held.append(row)
        if held:
            yield flush()

    kind = vectors.schema["vector"].dataType
    packed = pa.schema([("interval", pa.int32()), ("block", pa.int64()), ("label", pa.int64()), ("dim", pa.int32()),
                        ("low", pa.list_(pa.float64())), ("high", pa.list_(pa.float64())), ("ids", pa.binary()), ("weights", pa.binary()),
                        ("vectors", pa.binary())])
    keyed = vectors.select(F.col("label").cast("long").alias("label"), "dim", "rep", "weight", "vector")
    placed = keyed.mapInArrow(place, f"label long, dim int, rep long, weight long, vector {kind.simpleString()}, cells array<int>")
    order = ["label", "dim", "cells", "rep"]
    return stored(placed.repartitionByRange(*order).sortWithinPartitions(*order).select("label", "dim", "rep", "weight", "vector").mapInArrow(
        pack, "interval int, block long, label long, dim int, low array<double>, high array<double>, ids binary, weights binary, "
              "vectors binary"), "vector-blocks")


def _gap(epsilon: float) -> Column:
    """Whether two boxes come within epsilon of each other."""
    apart = "aggregate(sequence(1, size(a.low)), 0D, (s, i) -> s + power(greatest(0D, " \
            "element_at(b.low, i) - element_at(a.high, i), element_at(a.low, i) - element_at(b.high, i)), 2))"
    return F.expr(apart) <= epsilon * epsilon * (1 + 1e-9) + 1e-12


def block_pairs(blocks: DataFrame, epsilon: float, leading: int = LEADING) -> DataFrame:
    """Pairs of blocks that may hold vectors within epsilon, found from the whole sequence downwards.

    Intervals of the sequence are nodes of a tree. A pair of nodes whose boxes are too far apart is skipped with
    everything below it; the others are replaced by the pairs of their children.
    """
    bounds = blocks.select("label", "dim", "low", "high", F.col("interval").cast("long").alias("interval"), "block")
    top = bounds.agg(F.max("interval")).first()[0] or 0
    levels = [0]
    while FAN_OUT ** len(levels) <= top:
        levels.append(len(levels))
    levels.append(len(levels))

    def nodes(level: int) -> DataFrame:
        return bounds.withColumn("id", F.expr(f"interval div {FAN_OUT ** level}")).groupBy("label", "dim", "id").agg(
            F.array(*[F.min(F.get("low", F.lit(i))) for i in range(leading)]).alias("low_"),
            F.array(*[F.max(F.get("high", F.lit(i))) for i in range(leading)]).alias("high_")).select(
            "label", "dim", "id", F.expr(f"id div {FAN_OUT}").alias("parent"),
            F.filter("low_", lambda x: x.isNotNull()).alias("low"), F.filter("high_", lambda x: x.isNotNull()).alias("high"))

    def down(pairs: DataFrame, below: DataFrame) -> DataFrame:
        return pairs.alias("p").join(below.alias("a"), F.expr("p.label = a.label and p.dim = a.dim and p.a = a.parent")).join(
            below.alias("b"), F.expr("p.label = b.label and p.dim = b.dim and p.b = b.parent and a.id <= b.id")).where(
            _gap(epsilon)).select("p.label", "p.dim", F.col("a.id").alias("a"), F.col("b.id").alias("b"))

    pairs = nodes(levels[-1]).select("label", "dim", F.col("id").alias("a"), F.col("id").alias("b"))
    for level in reversed(levels[:-1]):
        pairs = down(pairs, nodes(level))
    return down(pairs, bounds.select("label", "dim", F.col("block").alias("id"), F.col("interval").alias("parent"), "low", "high"))


def link_matrix(a: np.ndarray, b: np.ndarray, cosine: float) -> np.ndarray:
    """Which rows link; cosines next to the threshold are taken again from the definition."""
    cosines = _unit(a) @ _unit(b).T
    for i, j in np.argwhere(np.abs(cosines - cosine) < 1e-12 * a.shape[1]):
        x, y = a[i] / np.abs(a[i]).max(), b[j] / np.abs(b[j]).max()
        cosines[i, j] = np.dot(x, y) / (np.sqrt(np.dot(x, x)) * np.sqrt(np.dot(y, y)))
    return cosines >= cosine


def _joined(ids_a, ids_b, weights_a, weights_b, links, same: bool):
    """Per vector of two blocks: the copies it links with, and the least id it reaches inside the two blocks."""
    if same:
        np.fill_diagonal(links, False)
    counts_a, counts_b = links @ weights_b, links.T @ weights_a
    root_a, root_b = ids_a.copy(), ids_b.copy()
    some_a, some_b = links.any(axis=1), links.any(axis=0)
    far = np.iinfo(np.int64).max
    while True:
        new_b = np.minimum(root_b, np.where(links, root_a[:, None], far).min(axis=0))
        if same:
            root_a = new_b
        new_a = np.minimum(root_a, np.where(links, new_b[None, :], far).min(axis=1))
        if (new_a == root_a).all() and (new_b == root_b).all():
            break
        root_a, root_b = new_a, new_a if same else new_b
    if same:
        return ids_a[some_a], counts_a[some_a], root_a[some_a]
    return (np.concatenate([ids_a[some_a], ids_b[some_b]]), np.concatenate([counts_a[some_a], counts_b[some_b]]),
            np.concatenate([root_a[some_a], root_b[some_b]]))


def join_blocks(blocks: DataFrame, pairs: DataFrame, cosine: float) -> DataFrame:
    """rep, copies linked in another block or its own, and the least id reached there; no row per pair of vectors."""
    side = lambda s: blocks.select(*[F.col(c).alias(f"{c}_{s}") for c in ("block", "dim", "ids", "weights", "vectors")])
    both = pairs.select("a", "b").join(side("a"), F.col("a") == F.col("block_a")).join(side("b"), F.col("b") == F.col("block_b"))

    def link(batches):
        for batch in batches:
            for row in batch.to_pylist():
                read = lambda name, kind: np.frombuffer(row[name], kind)
                a, b = (read(f"vectors_{s}", "<f8").reshape(-1, row["dim_a"]) for s in "ab")
                links = link_matrix(a, b, cosine)
                if links.any():
                    ids, counts, roots = _joined(read("ids_a", "<i8"), read("ids_b", "<i8"), read("weights_a", "<i8"), read("weights_b", "<i8"),
                                                 links, row["block_a"] == row["block_b"])
                    yield pa.RecordBatch.from_pydict({"rep": pa.array(ids), "links": pa.array(counts), "root": pa.array(roots)})

    with arrow_rows(blocks.sparkSession, PAIR_ROWS):
        return stored(both.mapInArrow(link, "rep long, links long, root long"), "vector-links")


def near_duplicates(embeddings: DataFrame, cosine: float = COSINE, leading: int = LEADING) -> DataFrame:
    """vec_id, n_links, component_id and kept for every vector; links need equal labels and cosine >= ``cosine``.

    A vector that is null, empty, zero or holds a null or non-finite component links with nothing, as does one without
    label or vec_id: n_links 0, component_id its own vec_id. Vectors of different lengths don't link. Equal vectors of
    a label are joined once and counted as often as they occur, so a third of all rows may be copies of one vector. Rows
    that share a vec_id are one node of the graph. An empty table gives no rows. Other columns are not read.

    Unit vectors with cosine >= c are within sqrt(2 - 2c), and so are their projections on any orthonormal axes. The
    grid of that width on the leading principal axes gives the order; hot labels span many intervals of it.
    """
    rows = stored(embeddings.select("vec_id", "label", F.expr(VECTOR.format(c="embedding")).alias("vector")).select(
        "vec_id", "label", "vector", F.size("vector").alias("dim"), F.xxhash64("vector").alias("k1"), F.hash("vector").alias("k2"),
        F.xxhash64(F.lit(7), F.reverse("vector")).alias("k3")), "vectors")
    vectors = stored(distinct_vectors(rows), "vectors-distinct")
    epsilon = float(np.sqrt(2 - 2 * cosine)) if cosine < 1 else 1e-6
    axes = principal_axes(vectors, leading)
    blocks = ordered_blocks(vectors, axes, epsilon)
    links = join_blocks(blocks, block_pairs(blocks, epsilon, leading), cosine)
    groups = components(links.select(F.col("rep").alias("a"), F.col("root").alias("b")), "vector-groups")
    counted = links.groupBy("rep").agg(F.sum("links").alias("links"))
    answer = vectors.select("label", "dim", "k1", "k2", "k3", "rep", "weight").join(counted, "rep", "left").join(
        groups, F.col("rep") == F.col("node"), "left").select(
        "label", "dim", "k1", "k2", "k3", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("links"),
        F.coalesce("root", "rep").alias("root"))
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull()
    linked = rows.where(usable).join(answer, ["label", "dim", "k1", "k2", "k3"]).select("vec_id", F.col("links").alias("n_links"), F.col("root").alias("component_id"))
    alone = rows.where(~usable).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
