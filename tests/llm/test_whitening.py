import math

import numpy as np
import pytest
from pyspark.sql import types as T

from smeltery.llm.whitening import divide, fit_whitening, polar_factor, whiten, whitened_components

ROWS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType()))])


def plain(vectors):
    x = np.array([[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for v in vectors], dtype=np.int64)
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    c = fit - s / n
    values, vectors = np.linalg.eigh(c.T @ c / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    return n, s, ((n * x - s) ** 2).sum(axis=1), values, (x - s / n) @ vectors / np.sqrt(np.maximum(values, 1e-300))


@pytest.mark.parametrize("kind", ["plain", "scaled", "equal", "two values"])
@pytest.mark.parametrize("d", [1, 2, 5, 40])
def test_division_equals_eigenvectors(d, kind):
    r = np.random.default_rng(d)
    m = r.normal(size=(3 * d + 2, d)) * (np.logspace(0, -5, d) if kind == "scaled" else 1)
    a = m.T @ m
    if kind == "equal":
        a = 2.0 * np.eye(d)
    if kind == "two values":
        q, _ = np.linalg.qr(r.normal(size=(d, d)))
        a = q @ np.diag(np.where(np.arange(d) < d / 2, 5.0, 1.0)) @ q.T
        a = (a + a.T) / 2
    values, rows = divide(a, 16)
    want = np.linalg.eigvalsh(a)[::-1][:16]
    assert np.allclose(values, want, rtol=1e-9)
    assert np.allclose(rows @ rows.T, np.eye(len(rows)), atol=1e-12)
    assert np.linalg.norm(a @ rows.T - rows.T * values) < 1e-12 * np.linalg.norm(a)


def test_polar_factor_is_the_sign_of_each_eigenvalue():
    q, _ = np.linalg.qr(np.random.default_rng(3).normal(size=(6, 6)))
    a = q @ np.diag([9, 1e-7, -1e-7, -4, 2, -1]) @ q.T
    assert np.allclose(polar_factor((a + a.T) / 2), q @ np.diag([1, 1, -1, -1, 1, -1]) @ q.T, atol=1e-8)


def test_rows_equal_plain_whitening(spark):
    r = np.random.default_rng(5)
    vectors = [[float(c) for c in v] for v in r.normal(size=(300, 20)) * np.linspace(3, 1, 20)]
    vectors += [vectors[0]] * 200
    bad = [(900, None), (901, []), (902, [None] * 20), (903, [float("nan")] * 20), (904, [float("inf")] + [0.0] * 19), (905, [1.0] * 7), (None, vectors[3]), (1, vectors[4])]
    docs = spark.createDataFrame([*enumerate(vectors), *bad], ROWS).repartition(5)
    n, s, deviation, values, white = plain(vectors)
    rows = whitened_components(docs).collect()
    assert len(rows) == 16 * 502
    by = {}
    for row in rows:
        by.setdefault(row.vec_id, {}).setdefault(row.component, []).append(row)
    sign = np.array([np.sign(by[7][k + 1][0].whitened * white[7, k]) for k in range(16)])
    for i in (0, 7, 100, 299, 450):
        for k in range(16):
            row = by[i][k + 1][0]
            assert (row.n, row.deviation) == (n, deviation[i]) and n == 300
            assert row.whitened == pytest.approx(white[i, k] * sign[k], rel=1e-8, abs=1e-9)
            assert row.explained == pytest.approx(values[k] / values.sum(), rel=1e-9)
            assert row.identity_error < 1e-10
    assert len(by[None][1]) == 1 and len(by[1][1]) == 2


def test_other_columns_stay_and_flat_dimensions_give_no_component(spark):
    rows = spark.createDataFrame([(i, [float(i), 2.0, float(i * i)], "d", f"r{i}", i) for i in range(9)], "x int, v array<double>, deviation string, row string, n int")
    model = fit_whitening(rows, "v")
    assert len(model.eigenvalues) == 2 and model.n == 9
    out = whiten(rows, model, "v").orderBy("n").collect()
    assert [(r.x, r.row, r.n, len(r.whitened)) for r in out] == [(i, f"r{i}", i, 2) for i in range(9)]


def test_one_vector_no_vectors_and_no_rows(spark):
    one = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], ROWS)
    model = fit_whitening(one)
    assert (model.n, len(model.eigenvalues)) == (1, 0) and [r.deviation for r in whiten(one, model).collect()] == [0, 0]
    assert whitened_components(one).collect() == []
    for rows in ([], [(1, None)]):
        assert whitened_components(spark.createDataFrame(rows, ROWS)).collect() == []


def test_large_numbers_stay_exact(spark):
    big = [[float(2**40), 1.0], [float(-(2**40)), 5.0], [3.0, 2.0]]
    rows = spark.createDataFrame(list(enumerate(big)), "vec_id long, embedding array<double>")
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for v in big]
    s = [sum(c) for c in zip(*x)]
    got = whiten(rows, fit_whitening(rows)).orderBy("vec_id").collect()
    assert [int(r.deviation) for r in got] == [sum((3 * a - b) ** 2 for a, b in zip(v, s)) for v in x]
