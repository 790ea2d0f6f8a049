import math

import numpy as np
import pytest

from sightline.llm import whitening
from tests.conftest import SF

SCHEMA = "vec_id long, embedding array<float>, n string, component string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", "y") for i, v in rows], SCHEMA)


def test_jacobi_equals_library():
    rng = np.random.default_rng(1)
    for d in (1, 2, 5, 16, 33):
        a = rng.normal(size=(3 * d, d)) * 10.0 ** rng.uniform(-4, 2, d)
        m = a.T @ a
        values, vectors = whitening.jacobi(m)
        assert np.allclose(vectors @ vectors.T, np.eye(d), atol=1e-13)
        assert np.allclose(vectors.T * values @ vectors, m, rtol=1e-12, atol=1e-12 * np.trace(m))
        assert (np.diff(values) <= 0).all()
        assert np.allclose(values, np.linalg.eigvalsh(m)[::-1], rtol=1e-6, atol=1e-12 * np.trace(m))


def test_small_eigenvalues_are_accurate():
    # scaled copies of a well-conditioned matrix: the least eigenvalue is 1e-16 of the greatest and still has all its digits
    d = np.diag([1.0, 1e-4, 1e-8])
    values, _ = whitening.jacobi(d @ np.array([[2.0, 1, 0.5], [1, 3, 0.25], [0.5, 0.25, 1]]) @ d)
    exact = np.linalg.det(np.array([[2.0, 1, 0.5], [1, 3, 0.25], [0.5, 0.25, 1]])) * 1e-24
    assert np.prod(values) == pytest.approx(exact, rel=1e-12)


def test_whole_table_against_numpy(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = df.collect()
    x = {r.vec_id: [math.floor(64 * float(c)) + 1000000 for c in r.embedding] for r in rows if r.embedding is not None and all(c is not None and math.isfinite(c) for c in r.embedding)}
    fit = np.array(sorted(set(map(tuple, x.values()))), np.int64)
    n, total = len(fit), [int(s) for s in fit.sum(axis=0)]
    centred = fit - fit.sum(axis=0) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    got = {}
    for r in whitening.whitened_components(df).collect():
        got.setdefault(r.vec_id, {})[r.component] = r
    assert set(got) == set(x)
    signs = {}
    for i, own in got.items():
        assert sorted(own) == list(range(1, 17))
        for k, r in own.items():
            want = (np.array(x[i]) - fit.sum(axis=0) / n) @ vectors[:, k - 1] / math.sqrt(values[k - 1])
            sign = signs.setdefault(k, np.sign(want * r.whitened))
            assert r.whitened == pytest.approx(sign * want, abs=1e-8)
            assert r.n == n and r.deviation == sum((n * a - b) ** 2 for a, b in zip(x[i], total, strict=True))
            assert r.explained == pytest.approx(values[k - 1] / values.sum(), rel=1e-10) and r.identity_error < 1e-9


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    some = [(1, [0.5, 0.25]), (2, [0.5, 0.25]), (3, [-1.0, 2.0]), (None, [3.0, 0.0]), (4, None), (5, [nan, 1.0]), (6, [1.0, inf]), (7, [None, 1.0]), (8, []), (9, [1.0, 2.0, 3.0]), (9, [1.0, 1.0])]
    got = whitening.whitened_components(frame(spark, some)).collect()
    assert sorted((str(r.vec_id), r.component) for r in got) == sorted((str(i), k) for i in (1, 2, 3, None, 9) for k in (1, 2))
    assert {r.n for r in got} == {4} and max(r.identity_error for r in got) < 1e-12
    by = {(r.vec_id, r.component): r.whitened for r in got}
    assert by[1, 1] == by[2, 1] and by[1, 2] == by[2, 2]


def test_no_spread_and_empty(spark):
    got = whitening.whitened_components(frame(spark, [(1, [0.5, 0.25]), (2, [0.5, 0.25])])).collect()
    assert [(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in got] == [(1, 0, None, 0.0, 0.0)] * 4
    flat = whitening.whitened_components(frame(spark, [(i, [float(i), 2.0 * i, 1.0]) for i in range(9)])).collect()
    assert {r.component for r in flat if r.whitened is not None} == {1} and max(r.identity_error for r in flat) < 1e-12
    assert whitening.whitened_components(frame(spark, [])).count() == 0 == whitening.whitened_components(frame(spark, [(1, None), (2, [])])).count()


def test_extremes_stay_whole(spark):
    got = whitening.whitened_components(frame(spark, [(1, [3e38, 0.0]), (2, [-3e38, 1.0]), (3, [1.0, 2.0])]))
    most = 1 << 62
    x = [[most, 1000000], [1000000 - most, 1000064], [1000064, 1000128]]
    want = {i + 1: sum((3 * r[k] - sum(y[k] for y in x)) ** 2 for k in (0, 1)) for i, r in enumerate(x)}
    assert {r.vec_id: r.deviation for r in got.collect()} == {1: None, 2: None, 3: want[3]} and got.count() == 6
    far = [(i, [float(1 << (30 + i)), float(i)]) for i in range(4)]
    x = [[64 * (1 << (30 + i)) + 1000000, 64 * i + 1000000] for i in range(4)]
    want = {i: sum((4 * x[i][k] - sum(r[k] for r in x)) ** 2 for k in (0, 1)) for i in range(4)}
    want = {i: w if w < 1 << 63 else None for i, w in want.items()}
    assert {r.vec_id: r.deviation for r in whitening.whitened_components(frame(spark, far)).collect()} == want


def test_operator_whitens_in_place(spark):
    df = frame(spark, [(i, [float(i % 7), float(i * i % 11), 0.1 * i]) for i in range(60)] + [(99, None)])
    model = whitening.fit(df)
    out = whitening.whiten(df, model)
    assert out.columns == [*df.columns, "whitened"] and out.count() == 61
    z = np.array([r.whitened for r in out.collect() if r.whitened is not None])
    assert np.allclose(np.cov(z.T, bias=True), np.eye(3), atol=1e-9)
    assert whitening.whiten(frame(spark, [(1, None)]), whitening.fit(frame(spark, []))).first().whitened is None
