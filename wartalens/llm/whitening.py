"""Whitening of embeddings: pivoted Cholesky of the centred scatter, one-sided Jacobi on its factor.

Vectors are coded as whole numbers ``floor(64 * c) + 1000000``, and each distinct code vector counts
once in the fit. Count, sums and scatter are added up in Spark as one small table per task; what
reaches the driver is ``dimensions x dimensions`` numbers, whatever the number of rows. The scatter
is factored as ``L L'`` with the largest remaining diagonal entry as pivot, which stops at the rank.
Plane rotations then make the columns of ``L`` orthogonal: their squared norms are the eigenvalues
and their directions the components, to nearly full precision even for small eigenvalues, as the
factor is rotated itself and no product is formed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wartalens.llm.common import prepare_python, quoted
from wartalens.session import stage

STEPS, OFFSET = 64, 1_000_000
LARGEST = float(1 << 46)              # larger entries have no code whose deviation could be exact
RANK = 1e-10                          # pivots under this part of the largest count as zero
SWEEPS = 60


@dataclass
class Whitening:
    """A fitted transform: ``n`` distinct vectors, their sums, components by falling eigenvalue, covariance trace."""

    n: int
    sums: np.ndarray                  # long, per dimension
    components: np.ndarray            # one column each
    eigenvalues: np.ndarray
    trace: float
    identity_error: float = 0.0


def codes(vector: Column) -> Column:
    """Whole-number codes of a vector; null if the vector is null, empty or has null, non-finite or huge entries."""
    entries = vector.cast("array<double>")
    sound = F.forall(entries, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < LARGEST))
    coded = F.transform(entries, lambda c: F.floor(c * F.lit(float(STEPS))) + F.lit(OFFSET))
    return F.when(sound & (F.size(entries) > 0), coded)


def fit_list(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """``x``: every distinct code vector once, of the commonest dimension (the larger one in a tie)."""
    coded = vectors.select(codes(quoted(vector)).alias("x")).filter("x IS NOT NULL")
    listed = stage(coded.distinct(), "fit-list")
    sizes = listed.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    return listed.filter(F.size("x") == (sizes[0]["d"] if sizes else 0))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of equal length as a matrix of longs."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _sums(listed: DataFrame, width: int) -> tuple[int, np.ndarray]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(width, np.int64)
        for batch in batches:
            n += batch.num_rows
            total += _matrix(batch.column(0), width).sum(axis=0)
        yield pa.RecordBatch.from_pydict({"i": pa.array(range(width + 1), pa.int32()), "v": pa.array([*total, n], pa.int64())})

    rows = listed.select("x").mapInArrow(run, "i int, v bigint").groupBy("i").agg(F.sum("v").alias("v")).collect()
    values = {row["i"]: row["v"] for row in rows}
    return values.get(width, 0), np.array([values.get(i, 0) for i in range(width)], np.int64)


def _products(listed: DataFrame, width: int, onto) -> np.ndarray:
    """Sum over the fit list of ``w w'`` and ``w`` (last column), where ``w = onto(x)`` has ``width`` columns."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width + 1))
        for batch in batches:
            w = onto(batch.column(0))
            total[:, :width] += w.T @ w
            total[:, width] += w.sum(axis=0)
        i, j = np.indices(total.shape)
        keep = j >= i
        yield pa.RecordBatch.from_pydict({"i": pa.array(i[keep], pa.int32()), "j": pa.array(j[keep], pa.int32()), "v": pa.array(total[keep])})

    summed = listed.select("x").mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    out = np.zeros((width, width + 1))
    for row in summed:
        out[row["i"], row["j"]] = row["v"]
        if row["j"] < width:
            out[row["j"], row["i"]] = row["v"]
    return out


def pivoted_cholesky(scatter: np.ndarray, rank: float = RANK) -> np.ndarray:
    """``L`` with ``L L' = scatter``, rows in their own order, one column per pivot taken."""
    size = len(scatter)
    order, diagonal = np.arange(size), scatter.diagonal().copy()
    least = rank * diagonal.max(initial=0.0)
    factor = np.zeros((size, size))
    for k in range(size):
        at = k + int(np.argmax(diagonal[order[k:]]))
        order[[k, at]] = order[[at, k]]
        own, rest = order[k], order[k + 1:]
        if diagonal[own] <= least:
            return factor[:, :k]
        factor[own, k] = np.sqrt(diagonal[own])
        factor[rest, k] = (scatter[rest, own] - factor[rest, :k] @ factor[own, :k]) / factor[own, k]
        diagonal[rest] -= factor[rest, k] ** 2
    return factor


def _rounds(size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of columns in rounds of disjoint pairs, as in a tournament."""
    players = list(range(size + size % 2))
    half = len(players) // 2
    for _ in range(len(players) - 1):
        pairs = [(a, b) for a, b in zip(players[:half], players[:half - 1:-1]) if max(a, b) < size]
        yield np.array([p[0] for p in pairs], int), np.array([p[1] for p in pairs], int)
        players = [players[0], players[-1], *players[1:-1]]


def one_sided_jacobi(factor: np.ndarray, sweeps: int = SWEEPS) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of ``factor factor'`` in falling order and their unit eigenvectors as columns.

    Rotates pairs of columns until all are orthogonal to working precision. The largest entry of
    each component is made positive.
    """
    g = factor.copy()
    for _ in range(sweeps):
        worst = 0.0
        for a, b in _rounds(g.shape[1]):
            left, right = g[:, a], g[:, b]
            alpha, beta, gamma = (left * left).sum(0), (right * right).sum(0), (left * right).sum(0)
            size = np.sqrt(alpha * beta)
            cosine = np.divide(np.abs(gamma), size, out=np.zeros_like(gamma), where=size > 0)
            worst = max(worst, float(cosine.max(initial=0.0)))
            turn = cosine > 1e-16
            zeta = np.divide(beta - alpha, 2 * gamma, out=np.zeros_like(gamma), where=turn)
            t = np.where(turn, np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta)), 0.0)
            c = 1 / np.sqrt(1 + t * t)
            s = c * t
            g[:, a], g[:, b] = c * left - s * right, s * left + c * right
        if worst <= 1e-15:
            break
    values = (g * g).sum(0)
    falling = np.argsort(-values, kind="stable")
    values, g = values[falling], g[:, falling]
    vectors = g / np.sqrt(values)
    signs = np.sign(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])]) if vectors.size else np.empty(0)
    return values, vectors * signs


def fit(vectors: DataFrame, vector: str = "embedding", components: int = 16) -> Whitening:
    """Fit on the distinct code vectors. No vector, or equal vectors only, give no component.

    The driver holds ``dimensions ** 2`` numbers; embeddings have at most some thousand dimensions.
    """
    prepare_python(vectors.sparkSession)
    listed = fit_list(vectors, vector)
    head = listed.select(F.size("x").alias("d")).limit(1).collect()
    width = head[0]["d"] if head else 0
    if not width:
        return Whitening(0, np.zeros(0, np.int64), np.zeros((0, 0)), np.zeros(0), 0.0)
    n, sums = _sums(listed, width)
    covariance = _products(listed, width, lambda column: (n * _matrix(column, width) - sums) / n)[:, :width] / n
    values, found = one_sided_jacobi(pivoted_cholesky(covariance))
    kept = min(components, int((values > RANK * values.max(initial=0.0)).sum()))
    model = Whitening(n, sums, found[:, :kept], values[:kept], float(np.trace(covariance)))
    if kept:
        onto = model.components / np.sqrt(model.eigenvalues)
        spread = _products(listed, kept, lambda column: ((n * _matrix(column, width) - sums) / n) @ onto)
        mean = spread[:, kept] / n
        model.identity_error = float(np.abs(spread[:, :kept] / n - np.outer(mean, mean) - np.eye(kept)).max())
    return model


def whitened(vectors: DataFrame, model: Whitening, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """One row per vector and component; see :func:`whiten` for the columns."""
    prepare_python(vectors.sparkSession)
    n, sums, width, kept = model.n, model.sums, len(model.sums), len(model.eigenvalues)
    onto = model.components / np.sqrt(model.eigenvalues) if kept else np.zeros((width, 0))
    explained = model.eigenvalues / model.trace if kept else np.zeros(0)
    error = model.identity_error
    coded = vectors.select(quoted(key).cast("bigint").alias("vec_id"), codes(quoted(vector)).alias("x")).filter(
        F.col("x").isNotNull() & (F.size("x") == width))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows or not kept:
                continue
            rows = batch.num_rows
            far = n * _matrix(batch.column(1), width) - sums
            exact = (far.astype(float) ** 2).sum(axis=1) < 2.0 ** 62
            deviation = np.where(exact, (far * far).sum(axis=1), 0)
            ids = batch.column(0).take(pa.array(np.repeat(np.arange(rows), kept)))
            yield pa.RecordBatch.from_pydict({
                "vec_id": ids, "component": pa.array(np.tile(np.arange(1, kept + 1), rows), pa.int32()),
                "n": pa.array(np.full(rows * kept, n), pa.int64()),
                "deviation": pa.array(np.repeat(deviation, kept), pa.int64(), mask=np.repeat(~exact, kept)),
                "whitened": pa.array(((far / n) @ onto).ravel()), "explained": pa.array(np.tile(explained, rows)),
                "identity_error": pa.array(np.full(rows * kept, error)),
            })

    return coded.mapInArrow(
        run, "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double")


def whiten(vectors: DataFrame, vector: str = "embedding", key: str = "vec_id", components: int = 16) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` for each vector and component.

    Rows whose vector is null, empty, of another than the commonest dimension, or holds a null,
    non-finite or huge (2 ** 46) entry are left out. Null and repeated keys stay as they are; repeated
    vectors count once in the fit and each get their rows. Fewer components than asked for come out if
    the vectors have a smaller rank: none if all are equal, or for an empty table. ``deviation`` is
    exact, and null where it exceeds 2 ** 62.
    """
    return whitened(vectors, fit(vectors, vector, components), vector, key)
