"""Whitening (13): factor and rotations against a plain eigensolver, contract columns, awkward vectors."""

import math

import numpy as np
import pytest

from wartalens.llm import whitening

SCHEMA = "vec_id bigint, embedding array<float>, label int, Component string, x string"


def frame(spark, vectors, first=0):
    return spark.createDataFrame([(first + i, v, 1, "c", "x") for i, v in enumerate(vectors)], SCHEMA)


def brute(vectors, components=16):
    """Codes, exact deviations, eigenvalues and whitened values (up to sign) by a plain solver."""
    sound = [v for v in vectors if v and all(c is not None and math.isfinite(c) for c in v)]
    codes = [[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for v in sound]
    listed = sorted({tuple(c) for c in codes})
    n, sums = len(listed), [sum(c) for c in zip(*listed)]
    centred = np.array([[(n * x - s) / n for x, s in zip(c, sums)] for c in listed])
    covariance = centred.T @ centred / n
    values, found = np.linalg.eigh(covariance)
    order = np.argsort(-values)[:components]
    values, found = values[order], found[:, order]
    deviations = [sum((n * x - s) ** 2 for x, s in zip(c, sums)) for c in codes]
    white = [np.array([(n * x - s) / n for x, s in zip(c, sums)]) @ found / np.sqrt(values) for c in codes]
    return n, deviations, white, values / np.trace(covariance)


def drawn(n=300, d=24, seed=0):
    """Vectors of uneven spread, with copies and near copies."""
    draw = np.random.default_rng(seed)
    rows = (draw.normal(size=(n, d)) * np.linspace(4, 0.3, d)) @ np.linalg.qr(draw.normal(size=(d, d)))[0]
    return [*rows.astype(np.float32).tolist(), *[rows[0].astype(np.float32).tolist()] * (n // 2)]


def test_columns_against_plain_solver(spark):
    vectors = drawn()
    rows = whitening.whiten(frame(spark, vectors)).collect()
    n, deviations, white, explained = brute(vectors)
    assert len(rows) == 16 * len(vectors) and {r.n for r in rows} == {n}
    got = np.zeros((len(vectors), 16))
    for r in rows:
        got[r.vec_id, r.component - 1] = r.whitened
        assert r.deviation == deviations[r.vec_id]
        assert abs(r.explained - explained[r.component - 1]) < 1e-9 * explained[r.component - 1]
    signs = np.sign((got * np.array(white)).sum(axis=0))
    assert np.abs(got - np.array(white) * signs).max() < 1e-8
    assert len({r.identity_error for r in rows}) == 1 and rows[0].identity_error < 1e-9


def test_factor_and_rotations():
    draw = np.random.default_rng(1)
    for d, rank in ((1, 1), (2, 2), (7, 4), (33, 33), (40, 25)):
        half = draw.normal(size=(d, rank)) * np.logspace(0, -3, rank)
        scatter = half @ half.T
        factor = whitening.pivoted_cholesky(scatter, 1e-14)
        assert factor.shape[1] == rank and np.allclose(factor @ factor.T, scatter, atol=1e-12)
        values, found = whitening.one_sided_jacobi(factor)
        want = np.linalg.svd(half, compute_uv=False) ** 2
        assert np.allclose(values, want, rtol=1e-8) and np.abs(found.T @ found - np.eye(rank)).max() < 1e-12
        assert np.abs(scatter @ found - found * values).max() < 1e-12
    assert whitening.pivoted_cholesky(np.zeros((3, 3))).shape == (3, 0)


def test_fewer_dimensions_than_components_and_dependent_ones(spark):
    vectors = [[a, b, a, 0.0] for a, b in np.random.default_rng(2).normal(size=(50, 2)).astype(np.float32).tolist()]
    rows = whitening.whiten(frame(spark, vectors)).collect()
    assert len(rows) == 2 * len(vectors) and rows[0].identity_error < 1e-9
    assert abs(sum(r.explained for r in rows if r.vec_id == 0) - 1) < 1e-9


@pytest.mark.parametrize("vectors", [[], [None], [[]], [[1.0, 2.0]], [[1.0, 2.0]] * 4, [[float("nan"), 1.0], [1.0, None]]])
def test_nothing_to_whiten(spark, vectors):
    assert whitening.whiten(frame(spark, vectors)).collect() == []


def test_awkward_rows_are_left_out(spark):
    sound = drawn(40, 5, 3)
    odd = [None, [], [None] * 5, [1.0, 2.0, float("inf"), 0.0, 0.0], [float("nan")] * 5, [1e30] * 5, [1.0] * 6]
    rows = whitening.whiten(frame(spark, [*odd, *sound])).collect()
    alone = whitening.whiten(frame(spark, sound, len(odd))).collect()
    key = lambda r: (r.vec_id, r.component)
    assert [(key(r), r.n, r.deviation) for r in sorted(rows, key=key)] == [(key(r), r.n, r.deviation) for r in sorted(alone, key=key)]
    assert {r.vec_id for r in rows} == set(range(len(odd), len(odd) + len(sound)))


def test_null_and_repeated_keys_keep_their_rows(spark):
    vectors = drawn(30, 3, 4)
    table = spark.createDataFrame([(None if i % 3 else 1, v, 0, None, None) for i, v in enumerate(vectors)], SCHEMA)
    assert whitening.whiten(table).count() == 3 * len(vectors)
