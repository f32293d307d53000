"""Whitening against numpy's eigenvectors and exact whole numbers."""

import math

import numpy as np
import pytest

from quillmark.llm import whitening as W

rng = np.random.default_rng(3)
SCHEMA = "vec_id long, embedding array<float>, n int, whitened string"


def frame(spark, vectors):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], 1, "x") for i, v in enumerate(vectors)], SCHEMA)


def scaled(vectors):
    return np.array([[math.floor(1024 * float(np.float32(c))) + 100_000 for c in v] for v in vectors], object)


def expected(vectors):
    x = scaled(vectors)
    n, s = len(x), x.sum(0)
    centred = (x * n - s).astype(float) / n
    e, v = np.linalg.eigh(centred.T @ centred / n)
    return x, n, s, centred, e[::-1], v[:, ::-1]


@pytest.mark.parametrize("d", [5, 12])
def test_rows_match_numpy(spark, d):
    vectors = (rng.normal(size=(300, d)) * np.linspace(3, 0.02, d) + 7).astype(np.float32)
    x, n, s, centred, e, v = expected(vectors)
    rows = W.whitening_report(frame(spark, vectors).repartition(5)).collect()
    assert len(rows) == 300 * min(8, d) and {r.n for r in rows} == {300} and rows[0].identity_error < 1e-9
    got = {(r.vec_id, r.component): r for r in rows}
    for k in range(min(8, d)):
        want = centred @ v[:, k] / np.sqrt(e[k])
        have = np.array([got[i, k + 1].whitened for i in range(n)])
        assert np.abs(have - want * np.sign(have @ want)).max() < 1e-7
        assert abs(got[0, k + 1].explained / (e[k] / e.sum()) - 1) < 1e-10
    assert all(got[i, 1].deviation == sum((n * x[i] - s) ** 2) for i in range(n))


def test_tree_of_triangles(spark, monkeypatch):
    monkeypatch.setattr(W, "FAN_IN", 2)
    monkeypatch.setattr(W, "BLOCK_ROWS", 3)
    vectors = rng.normal(size=(101, 4)).astype(np.float32)
    clean = W.clean_vectors(frame(spark, vectors).repartition(11))
    n, sums = W.column_sums(clean)
    r = W.triangle(clean, n, sums)
    _, _, _, centred, _, _ = expected(vectors)
    assert np.allclose(r.T @ r, centred.T @ centred, rtol=1e-10)


def test_jacobi_keeps_small_deviations():
    """Graded columns: each deviation keeps its digits, which those of the covariance lose."""
    q, _ = np.linalg.qr(rng.normal(size=(6, 6)))
    sizes = 10.0 ** -np.arange(0, 12, 2)
    got, v = W.jacobi(q * sizes)
    assert np.abs(got / sizes - 1).max() < 1e-10 and np.abs(v.T @ v - np.eye(6)).max() < 1e-13
    for d in (1, 2, 7, 32):
        a = rng.normal(size=(d, d))
        s, v = W.jacobi(a)
        assert np.allclose(s, np.linalg.svd(a, compute_uv=False)) and np.allclose(np.abs(np.linalg.norm(a @ v, axis=0)), s)


def test_large_offset_keeps_small_spread(spark):
    vectors = (1000 + rng.normal(size=(200, 3)) * [1.0, 0.1, 0.02]).astype(np.float32)
    _, _, _, _, e, _ = expected(vectors)
    rows = W.whitening_report(frame(spark, vectors)).collect()
    assert rows[0].identity_error < 1e-9 and abs({r.component: r.explained for r in rows}[3] / (e[2] / e.sum()) - 1) < 1e-9


def test_bad_rows_are_dropped(spark):
    good = [[1.0, 2.0], [3.0, 1.0], [0.0, 5.0]]
    bad = [None, [1.0, None], [float("nan"), 1.0], [float("inf"), 1.0], [1.0, float("-inf")], [], [1.0, 2.0, 3.0]]
    rows = W.whitening_report(frame(spark, good + bad)).collect()
    assert sorted({(r.vec_id, r.n) for r in rows}) == [(0, 3), (1, 3), (2, 3)]


def test_edges(spark):
    assert W.whitening_report(frame(spark, [])).collect() == [] == W.whitening_report(frame(spark, [None])).collect()
    same = W.whitening_report(frame(spark, [[1.0, 2.0]] * 4)).collect()
    assert [(r.whitened, r.explained, r.deviation) for r in same] == [(0.0, 0.0, 0)] * 8 and same[0].identity_error == 1.0
    alone = W.whitening_report(frame(spark, [[1.0, 2.0]])).collect()
    assert [r.component for r in alone] == [1, 2]
    df = spark.createDataFrame([(None, [1.0, 2.0]), (None, [2.0, 5.0]), (2**60 + 1, [1.5, 2.0])], "vec_id long, embedding array<double>")
    rows = W.whitening_report(df).collect()
    assert len(rows) == 6 and sum(r.vec_id is None for r in rows) == 4 and any(r.vec_id == 2**60 + 1 for r in rows)
