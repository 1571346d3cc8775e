"""Whitening against a dense eigendecomposition."""

import numpy as np
import pytest
from pyspark.sql import types as T

from docreview.llm import whitening

SCHEMA = T.StructType([
    T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
    *[T.StructField(c, T.StringType()) for c in ("x", "n", "component", "_v", "label")],
])


def frame(spark, rows):
    return spark.createDataFrame([(k, v, *["x"] * 5) for k, v in rows], SCHEMA).repartition(3)


def plain(rows, components):
    """{key: (deviation, whitened)} and the shares, with signs left open."""
    x = np.array([[int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v] for _, v in rows], object)
    n, sums = len(x), x.sum(axis=0)
    deviation = [(sum((n * a - b) ** 2 for a, b in zip(r, sums))) for r in x]
    c = np.array([[float(n * a - b) / n for a, b in zip(r, sums)] for r in x])
    e, v = np.linalg.eigh(c.T @ c / n)
    e, v = e[::-1], v[:, ::-1]
    k = min(components, int(np.sum(e > 1e-9 * e[0])))
    return deviation, c @ v[:, :k] / np.sqrt(e[:k]), e[:k] / e.sum()


def compare(spark, rows, valid, components=32, dims=None):
    got = whitening.whiten(frame(spark, rows), components=components).collect()
    deviation, whitened, share = plain(valid, components)
    k = whitened.shape[1]
    assert len(got) == len(valid) * k
    for j in range(k):
        column = sorted((r.vec_id, r.whitened, r.deviation) for r in got if r.component == j + 1)
        order = sorted(range(len(valid)), key=lambda i: valid[i][0])
        mine, other = np.array([c[1] for c in column]), whitened[order, j]
        sign = 1 if mine @ other > 0 else -1
        assert np.max(abs(mine - sign * other)) < 1e-7
        assert [c[2] for c in column] == [deviation[i] for i in order]
    for r in got:
        assert r.n == len(valid) and r.identity_error < 1e-9
        assert r.explained == pytest.approx(share[r.component - 1], rel=1e-9)


def vectors(n, d, seed=0, scale=None):
    random = np.random.default_rng(seed)
    spread = np.linspace(3, 0.3, d) if scale is None else scale
    return [(i, (random.standard_normal(d) * spread).astype(np.float32).tolist()) for i in range(n)]


@pytest.mark.parametrize(("n", "d", "components"), [(300, 6, 4), (200, 12, 32), (5, 8, 32), (2, 3, 3), (400, 1, 1)])
def test_components_of_random_vectors(spark, n, d, components):
    rows = vectors(n, d, seed=n)
    compare(spark, rows, rows, components)


def test_bad_vectors_are_left_out(spark):
    rows = vectors(100, 5)
    bad = [(900, None), (901, [1.0, None, 1.0, 1.0, 1.0]), (902, [float("nan")] * 5), (903, [1.0, float("inf"), 1.0, 1.0, 1.0]),
           (904, [1.0, 2.0]), (905, []), (906, [-float("inf")] * 5), (907, [3e38] * 5)]
    compare(spark, rows + bad, rows)


def test_constant_and_repeated_dimensions(spark):
    rows = [(i, [v[0], 7.0, v[1], v[0], -0.25, v[2]]) for i, v in vectors(200, 3)]
    compare(spark, rows, rows)


def test_a_third_of_the_rows_are_one_vector(spark):
    rows = vectors(200, 6)
    rows += [(1000 + i, rows[0][1]) for i in range(100)]
    compare(spark, rows, rows)


def test_equal_eigenvalues(spark):
    """Plus and minus every axis: the Krylov space of one vector is used up at once."""
    rows = [(2 * i + s, [float(4 * (1 - 2 * s) if j == i else 0) for j in range(5)]) for i in range(5) for s in (0, 1)]
    got = whitening.whiten(frame(spark, rows)).collect()
    assert {r.component for r in got} == {1, 2, 3, 4, 5}
    table = np.zeros((10, 5))
    for r in got:
        table[r.vec_id, r.component - 1] = r.whitened
    assert np.max(abs(table.T @ table / 10 - np.eye(5))) < 1e-9
    assert {round(r.explained, 9) for r in got} == {0.2}


def test_null_and_repeated_keys(spark):
    rows = vectors(50, 4)
    got = whitening.whiten(frame(spark, [(None, rows[0][1]), (1, rows[1][1]), *rows[1:]]), components=2).collect()
    assert len(got) == 2 * 51 and sum(r.vec_id is None for r in got) == 2 and sum(r.vec_id == 1 for r in got) == 4


def test_nothing_to_whiten(spark):
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, [])]):
        got = whitening.whiten(frame(spark, rows))
        assert got.count() == 0
        assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_deviation_beyond_64_bits(spark):
    big = [(i, [v[0] * 2e6, v[1]]) for i, v in vectors(60, 2)]
    deviation, _, _ = plain(big, 1)
    huge = [(i, [v[0] * 1e10, v[1]]) for i, v in vectors(60, 2)]
    got = {r.vec_id: r.deviation for r in whitening.whiten(frame(spark, big), components=1).collect()}
    assert got == {i: (d if d < 2**63 else None) for (i, _), d in zip(big, deviation)}
    assert any(r.deviation is None for r in whitening.whiten(frame(spark, huge), components=1).collect())


def test_bidiagonalisation_of_a_dense_matrix():
    random = np.random.default_rng(1)
    x = random.standard_normal((200, 40)) @ np.diag(np.geomspace(100, 1e-3, 40))
    values, vectors = whitening.bidiagonalise(lambda p, a: (x.T @ (x @ p), (x @ a).T @ (x @ p), float((x @ p) @ (x @ p))), 40, 10)
    exact = np.linalg.svd(x, compute_uv=False)
    assert np.max(abs(values[:10] / exact[:10] - 1)) < 1e-10
    assert np.max(abs(vectors.T @ vectors - np.eye(vectors.shape[1]))) < 1e-12
