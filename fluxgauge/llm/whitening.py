"""Embedding whitening: pivoted Cholesky of the centred scatter, one-sided Jacobi on the triangular factor."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COMPONENTS = 32
SCALE = 64
SHIFT = 1_000_000
LARGEST = 1 << 52     # entries whose scaled value is beyond this have no exact double and count as not finite
ROUNDS = 60           # sweeps of the Jacobi iteration; it needs about ten
EPSILON = np.finfo(np.float64).eps
EXACT = float(1 << 62)
SCHEMA = ("vec_id {id}, component int, n long, deviation long, whitened double, explained double")


@dataclass(frozen=True)
class Model:
    """What is fitted for one vector length: nothing in it grows with the rows."""

    n: int
    sums: tuple[int, ...]
    axes: np.ndarray        # columns are components
    values: np.ndarray      # their eigenvalues
    trace: float


def pivoted_cholesky(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """L and the order p with a[p][:, p] = L L^T; the greatest remaining diagonal entry comes next, and L has as many
    columns as there are diagonal entries above rounding error."""
    a, d = a.copy(), len(a)
    order, factor, limit = np.arange(d), np.zeros((d, d)), d * EPSILON * max(np.diag(a).max(initial=0.0), 0.0)
    for k in range(d):
        best = k + int(np.argmax(np.diag(a)[k:]))
        if not a[best, best] > limit:
            return factor[:, :k], order
        swap, back = [k, best], [best, k]
        a[swap], factor[swap], order[swap] = a[back], factor[back], order[back]
        a[:, swap] = a[:, back]
        factor[k, k] = np.sqrt(a[k, k])
        factor[k + 1:, k] = a[k + 1:, k] / factor[k, k]
        a[k + 1:, k + 1:] -= np.outer(factor[k + 1:, k], factor[k + 1:, k])
    return factor, order


def _rounds(r: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Every pair of r columns once, in rounds of disjoint pairs (each column but the first moves on one place)."""
    ring = list(range(r + r % 2))
    out = []
    for _ in range(len(ring) - 1):
        pairs = [(ring[i], ring[-1 - i]) for i in range(len(ring) // 2)]
        pairs = [(min(p), max(p)) for p in pairs if max(p) < r]
        out.append((np.array([p[0] for p in pairs], int), np.array([p[1] for p in pairs], int)))
        ring = [ring[0], ring[-1], *ring[1:-1]]
    return out


def one_sided_jacobi(factor: np.ndarray) -> np.ndarray:
    """``factor`` times rotations, so that all columns are orthogonal, longest first.

    Each rotation makes two columns orthogonal; disjoint pairs rotate together. Column norms are then the singular
    values of the factor and, squared, the eigenvalues of factor factor^T.
    """
    g = factor.copy()
    rounds = _rounds(g.shape[1])
    for _ in range(ROUNDS):
        turned = False
        for i, j in rounds:
            a, b = g[:, i], g[:, j]
            alpha, beta, gamma = (a * a).sum(axis=0), (b * b).sum(axis=0), (a * b).sum(axis=0)
            open_ = np.abs(gamma) > EPSILON * np.sqrt(alpha * beta)
            if not open_.any():
                continue
            turned = True
            zeta = (beta - alpha) / np.where(open_, 2 * gamma, 1.0)
            t = np.where(open_, np.where(zeta < 0, -1.0, 1.0) / (np.abs(zeta) + np.hypot(1.0, zeta)), 0.0)
            c = 1 / np.hypot(1.0, t)
            s = c * t
            g[:, i], g[:, j] = c * a - s * b, s * a + c * b
        if not turned:
            break
    return g[:, np.argsort(-(g * g).sum(axis=0), kind="stable")]


def principal(scatter: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit eigenvectors (columns) and eigenvalues of scatter / n, falling; directions without variance are left out."""
    factor, order = pivoted_cholesky(scatter / n)
    turned = one_sided_jacobi(factor)
    norms = np.sqrt((turned * turned).sum(axis=0))
    axes = np.zeros_like(turned)
    axes[order] = turned / norms
    return axes, norms * norms


def _vectors(df: DataFrame) -> DataFrame:
    """vec_id, dim and x (long) of the usable rows."""
    usable = F.forall("vector", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float(LARGEST // SCALE))))
    return df.select("vec_id", F.col("embedding").cast("array<double>").alias("vector")).where(
        F.col("vector").isNotNull() & (F.size("vector") > 0)).where(usable).select("vec_id", F.size("vector").alias("dim"), "vector")


def _blocks(batch: pa.RecordBatch):
    """(dim, row numbers, integer vectors) for every vector length in a batch."""
    dims = batch.column("dim").to_numpy()
    column = batch.column("vector")
    values = column.flatten().to_numpy(zero_copy_only=False)
    ends = np.cumsum(dims)
    for dim in np.unique(dims):
        at = np.flatnonzero(dims == dim)
        rows = values[(ends[at] - dim)[:, None] + np.arange(dim)]
        yield int(dim), at, np.floor(SCALE * rows).astype(np.int64) + SHIFT


def _sums(vectors: DataFrame) -> dict[int, tuple[int, tuple[int, ...]]]:
    """n and the exact sum of every dimension, by vector length; tasks add up before the shuffle."""
    def add(batches):
        count: dict[int, int] = {}
        total: dict[int, list[int]] = {}
        for batch in batches:
            for dim, at, x in _blocks(batch):
                high, low = x >> 26, x & ((1 << 26) - 1)  # a batch's sums of both halves stay far below 63 bits
                sums = [(h << 26) + l for h, l in zip(high.sum(axis=0).tolist(), low.sum(axis=0).tolist())]
                count[dim] = count.get(dim, 0) + len(at)
                total[dim] = [a + b for a, b in zip(total.get(dim, [0] * dim), sums)]
        for dim in count:
            yield pa.RecordBatch.from_pydict({
                "dim": pa.array([dim] * dim, pa.int32()), "i": pa.array(range(dim), pa.int32()),
                "n": pa.array([count[dim]] * dim, pa.int64()), "s": pa.array(map(str, total[dim]), pa.string())})

    parts = vectors.mapInArrow(add, "dim int, i int, n long, s string")
    rows = parts.groupBy("dim", "i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    found: dict[int, tuple[int, tuple[int, ...]]] = {}
    for dim in {r["dim"] for r in rows}:
        of = sorted((r for r in rows if r["dim"] == dim), key=lambda r: r["i"])
        found[dim] = (of[0]["n"], tuple(int(r["s"]) for r in of))
    return found


def _centred(x: np.ndarray, n: int, sums: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """x - S/n in doubles, and its exact parts: x - floor(S/n) and the remainder of S by n."""
    whole, rest = np.array([divmod(s, n) for s in sums], np.int64).T
    near = x - whole
    return near - rest / n, near, rest


def _products(vectors: DataFrame, shape: dict[int, int], rows) -> dict[int, np.ndarray]:
    """Sum of r r^T over all rows r that ``rows(dim, x)`` makes of the vectors; one matrix a task before the shuffle."""
    def add(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for dim, _, x in _blocks(batch):
                if shape.get(dim):
                    r = rows(dim, x)
                    total[dim] = total.get(dim, 0) + r.T @ r
        for dim, m in total.items():
            i, j = np.triu_indices(len(m))
            yield pa.RecordBatch.from_pydict({
                "dim": pa.array(np.full(len(i), dim), pa.int32()), "i": pa.array(i, pa.int32()),
                "j": pa.array(j, pa.int32()), "v": pa.array(m[i, j], pa.float64())})

    parts = vectors.mapInArrow(add, "dim int, i int, j int, v double")
    out = {dim: np.zeros((d, d)) for dim, d in shape.items()}
    for r in parts.groupBy("dim", "i", "j").agg(F.sum("v").alias("v")).collect():
        out[r["dim"]][r["i"], r["j"]] = out[r["dim"]][r["j"], r["i"]] = r["v"]
    return out


def fit(df: DataFrame, components: int = COMPONENTS) -> dict[int, Model]:
    """One model per vector length, from all usable rows of ``df`` in two passes: sums, then centred products.

    The driver receives at most d(d+1)/2 numbers for vectors of length d, whatever the number of rows.
    """
    vectors = _vectors(df)
    sums = _sums(vectors)
    scatter = _products(vectors, {dim: dim for dim in sums}, lambda dim, x: _centred(x, *sums[dim])[0])
    models = {}
    for dim, (n, s) in sums.items():
        axes, values = principal(scatter[dim], n)
        models[dim] = Model(n, s, axes[:, :components], values[:components], float(np.trace(scatter[dim]) / n))
    return models


def _projected(model: Model, x: np.ndarray) -> np.ndarray:
    return _centred(x, model.n, model.sums)[0] @ (model.axes / np.sqrt(model.values))


def identity_error(df: DataFrame, models: dict[int, Model]) -> float:
    """Largest absolute entry of the whitened rows' covariance minus the identity, measured on all rows.

    The whitened rows are projections of x - S/n, whose exact mean is zero, so they are centred as they are.
    """
    wide = {dim: len(m.values) for dim, m in models.items() if len(m.values)}
    found = _products(_vectors(df), wide, lambda dim, x: _projected(models[dim], x))
    return max((float(np.abs(found[dim] / models[dim].n - np.eye(k)).max()) for dim, k in wide.items()), default=0.0)


def _deviation(near: np.ndarray, rest: np.ndarray, n: int) -> list[int | None]:
    """Sum over dimensions of (n x - S)^2, exact; None where it doesn't fit a long."""
    size = (near.astype(float) - rest / n) * n
    if len(size) == 0 or (size * size).sum(axis=1).max() < EXACT:
        exact = near * n - rest
        return (exact * exact).sum(axis=1).tolist()
    exact = near.astype(object) * n - rest.astype(object)
    return [int(v) if v < 1 << 63 else None for v in (exact * exact).sum(axis=1)]


def whiten(df: DataFrame, models: dict[int, Model]) -> DataFrame:
    """vec_id, component, n, deviation, whitened and explained: one row per usable vector and component.

    Rows whose vector is null, empty, or has a null, non-finite or unscalable entry (64 c beyond 52 bits) give none, and
    neither does a vector length without variance. Vectors of different lengths have a model each. Repeated rows repeat
    their result; a null vec_id stays null. Eigenvalues that tie have any basis of their plane, the same for all rows.
    Only vec_id and embedding are read, whatever other columns there are.
    """
    vectors = _vectors(df)

    def run(batches):
        for batch in batches:
            for dim, at, x in _blocks(batch):
                model = models.get(dim)
                k = len(model.values) if model else 0
                if not k:
                    continue
                _, near, rest = _centred(x, model.n, model.sums)
                times = np.repeat(at, k)
                yield pa.RecordBatch.from_arrays([
                    batch.column("vec_id").take(pa.array(times)),
                    pa.array(np.tile(np.arange(1, k + 1), len(at)), pa.int32()),
                    pa.array(np.full(len(times), model.n), pa.int64()),
                    pa.array(_deviation(near, rest, model.n), pa.int64()).take(pa.array(np.repeat(np.arange(len(at)), k))),
                    pa.array(_projected(model, x).ravel(), pa.float64()),
                    pa.array(np.tile(model.values / model.trace, len(at)), pa.float64())],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained"])

    return vectors.mapInArrow(run, SCHEMA.format(id=df.schema["vec_id"].dataType.simpleString()))
