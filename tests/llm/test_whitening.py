"""Whitening against exact rational sums and a dense solver."""

from fractions import Fraction

import numpy as np
import pytest

from quire.llm import whitening as module
from quire.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>, label int, component string, n int"


def given(n=300, dims=12, seed=5):
    rnd = np.random.default_rng(seed)
    scale = np.linspace(2, 0.3, dims)
    rows = [(k, [float(x) for x in (rnd.normal(size=dims) * scale).astype(np.float32)]) for k in range(n)]
    rows += [(1000, None), (1001, [None] * dims), (1002, [float("nan")] + [0.0] * (dims - 1)), (1003, [float("inf")] * dims), (1004, [1.0] * (dims + 3) + [None])]
    return [*rows, rows[0], (None, rows[1][1])]


def whole(rows):
    good = [(k, v) for k, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    return [k for k, _ in good], np.array([[int(np.floor(1024 * float(np.float32(x)))) + 100_000 for x in v] for _, v in good], object)


def query(spark, folder, rows):
    spark.createDataFrame([(k, v, 1, "x", 2) for k, v in rows], SCHEMA).repartition(5).write.parquet(f"{folder}/embeddings.parquet")
    return QUERIES["op11_whitening"](spark, str(folder)).collect()


def test_against_exact_sums(spark, tmp_path):
    rows = given()
    found = query(spark, tmp_path, rows)
    ids, x = whole(rows)
    n, sums = len(x), x.sum(axis=0)
    assert len(found) == 8 * n and {r.n for r in found} == {n}
    centred = n * x - sums
    v = np.array([[float(Fraction(int(c), n**3)) for c in row] for row in centred.T.dot(centred)])
    value, vector = np.linalg.eigh(v)
    value, vector = value[::-1][:8], vector[:, ::-1][:, :8]
    want = np.array([[float(Fraction(int(c), n)) for c in row] for row in centred]) @ vector / np.sqrt(value)
    far = {k: sum(int(c) ** 2 for c in row) for k, row in zip(ids, centred, strict=True)}
    for j in range(8):
        own = {r.vec_id: r for r in found if r.component == j + 1}
        place = [ids.index(k) for k in own]
        got, expected = np.array([r.whitened for r in own.values()]), want[place, j]
        assert min(np.abs(got - expected).max(), np.abs(got + expected).max()) < 1e-9  # either sign, the same for all rows
        assert all(abs(r.explained - value[j] / np.trace(v)) < 1e-12 and r.identity_error < 1e-10 for r in own.values())
        assert all(r.deviation == far[r.vec_id] for r in own.values())


def test_covariance_survives_cancellation(spark):
    """Entries of 2**40 and more that differ in the last bits."""
    rnd = np.random.default_rng(1)
    x = 2.0**40 + rnd.integers(-9, 9, (500, 5)) / 1024
    df = spark.createDataFrame([(k, row.tolist()) for k, row in enumerate(x)], "vec_id long, vector array<double>").repartition(40)
    mean = module.moments(df, "vector", 5, None).mean()
    got = module.covariance(module.moments(df, "vector", 5, mean))
    exact = np.array([[Fraction(a) for a in row] for row in x.tolist()], object)
    centred = exact - exact.sum(axis=0) / 500
    want = np.array([[float(c / 500) for c in row] for row in centred.T.dot(centred)])
    assert np.abs(got - want).max() <= 4e-16 * np.abs(want).max()


def test_outer_products_are_error_free():
    rnd = np.random.default_rng(2)
    x = rnd.normal(size=(1024, 3)) * 10.0 ** rnd.integers(-3, 4, (1024, 3))
    low = x * rnd.normal(size=x.shape) * 2.0**-54
    high, rest = module.outer_products(x, low)
    exact = np.array([[Fraction(a) + Fraction(b) for a, b in zip(r, s, strict=True)] for r, s in zip(x.tolist(), low.tolist(), strict=True)], object)
    want = exact.T.dot(exact)
    off = max(abs(Fraction(float(h)) + Fraction(float(t)) - w) for h, t, w in zip(high.ravel(), rest.ravel(), want.ravel(), strict=True))
    assert off < Fraction(2) ** -70 * max(abs(w) for w in want.ravel())


def test_components_without_variance(spark, tmp_path):
    rows = [(k, [float(k), 2.0, 3.0]) for k in range(20)]
    found = query(spark, tmp_path, rows)
    assert len(found) == 60
    for r in found:
        assert (r.whitened is not None) == (r.component == 1) and r.identity_error < 1e-12
        assert r.explained == pytest.approx(1.0 if r.component == 1 else 0.0, abs=1e-12)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, []), (2, [])]])
def test_nothing_to_whiten(spark, tmp_path, rows):
    assert query(spark, tmp_path, rows) == []


def test_single_vector_short_vectors_and_long_sums(spark, tmp_path):
    assert {(r.whitened, r.deviation, r.identity_error) for r in query(spark, tmp_path, [(1, [0.5, 0.25])])} == {(None, 0, 0.0)}
    spark.createDataFrame([(1, [0.5, 0.25], 1, "x", 2), (2, [0.5], 1, "x", 2)], SCHEMA).write.parquet(f"{tmp_path}/short/embeddings.parquet")
    assert {(r.n, r.deviation) for r in QUERIES["op11_whitening"](spark, f"{tmp_path}/short").collect()} == {(2, 256**2)}
    assert module.deviation(np.array([[2.0**50]]), 3, [0]) == [None] and module.deviation(np.array([[2.0**30]]), 1, [1]) == [(2**30 - 1) ** 2]
