"""Whitening against numpy's own decomposition, in exact whole numbers where the result is exact."""

from __future__ import annotations

import os

import numpy as np
import pytest
from pyspark.sql import types as T

from chronogrid.llm import queries, whitening

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
tables = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no tables")

VECTORS = T.StructType(
    [
        T.StructField("vec_id", T.LongType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("label", T.IntegerType()),
        # names that the operator uses itself
        T.StructField("k", T.StringType()),
        T.StructField("x", T.StringType()),
        T.StructField("n", T.StringType()),
    ]
)


@pytest.fixture(scope="module")
def make_vectors(spark):
    return lambda rows: spark.createDataFrame([(k, v, 1, "k", "x", "n") for k, v in rows], VECTORS)


def usable(vectors):
    return [
        (k, np.floor(64 * np.array(v, np.float32).astype(float)).astype(np.int64) + 1_000_000)
        for k, v in vectors
        if v is not None and len(v) and all(c is not None and np.isfinite(c) for c in v)
    ]


def plain(vectors, components=16):
    """Rows by the definition: covariance of the distinct vectors and its eigenvectors."""
    rows = usable(vectors)
    fit = sorted({tuple(x.tolist()) for _, x in rows})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    mean = np.array([s / n for s in sums])
    a = np.array([[(n * c - s) / n for c, s in zip(x, sums)] for x in fit])
    values, turned = np.linalg.eigh(a.T @ a / n)
    values, turned = values[::-1], turned[:, ::-1]
    kept = min(components, int((values > 1e-12 * max(values[0], 1e-300)).sum()))
    out = []
    for k, x in rows:
        deviation = sum((n * int(c) - s) ** 2 for c, s in zip(x, sums))
        white = (x - mean) @ turned[:, :kept] / np.sqrt(values[:kept])
        out += [(k, i + 1, n, deviation, white[i], values[i] / values.sum()) for i in range(kept)]
    return out


def compared(found, wanted):
    """Same keys and exact figures; whitened values up to one sign for each component."""
    found = sorted(found, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[3], abs(r[4])))
    wanted = sorted(wanted, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[3], abs(r[4])))
    assert [tuple(r[:4]) for r in found] == [tuple(r[:4]) for r in wanted]
    signs = {}
    for f, w in zip(found, wanted):
        assert abs(f[5] - w[5]) <= 1e-9 * w[5]
        if abs(w[4]) > 1e-3:
            signs.setdefault(f[1], np.sign(f[4] * w[4]))
            assert abs(f[4] - signs[f[1]] * w[4]) < 1e-6 * max(1, abs(w[4]))
    assert len({r[6] for r in found}) <= 1 and all(r[6] <= 1e-8 for r in found)


@tables
def test_query_equals_plain_version(spark):
    rows = spark.read.parquet(f"{SF_DIR}/embeddings.parquet").select("vec_id", "embedding").collect()
    compared(queries.op13_embedding_whitening(spark, SF_DIR).collect(), plain([tuple(r) for r in rows]))


def test_odd_rows_and_repeats(make_vectors):
    random = np.random.default_rng(3)
    base = [random.normal(size=5).astype(np.float32).tolist() for _ in range(40)]
    rows = [(i, v) for i, v in enumerate(base)] + [(0, base[0]), (None, base[1])] + [(200 + i, base[2]) for i in range(30)]
    odd = [(900, None), (901, []), (902, [1.0, None, 0.0, 0.0, 0.0]), (903, [float("nan")] * 5), (904, [float("inf")] * 5)]
    found = whitening.whiten(make_vectors(rows + odd + [(905, [1.0, 2.0]), (906, [3e38] * 5)])).collect()
    assert found and {r["n"] for r in found} == {40} and {r["component"] for r in found} == set(range(1, 6))
    compared(found, plain(rows))


def test_dependent_columns_and_constants(make_vectors):
    random = np.random.default_rng(5)
    free = random.integers(-400, 400, (60, 3)) / 64
    rows = [(i, [float(a), float(b), float(a + b), 0.25, float(c), float(2 * a)]) for i, (a, b, c) in enumerate(free)]
    found = whitening.whiten(make_vectors(rows)).collect()
    assert {r["component"] for r in found} == {1, 2, 3}
    compared(found, plain(rows))


def test_fewer_rows_than_dimensions(make_vectors):
    random = np.random.default_rng(6)
    rows = [(i, random.normal(size=12).tolist()) for i in range(4)]
    found = whitening.whiten(make_vectors(rows)).collect()
    assert {r["component"] for r in found} == {1, 2, 3}
    compared(found, plain(rows))


def test_wide_spread_of_variances(make_vectors):
    """Standard deviations from one step to a billion steps: the plain Gram matrix would lose the small ones."""
    random = np.random.default_rng(8)
    rows = [(i, [float(np.float32(v)) for v in random.normal(size=4) * [1e8, 1e4, 1.0, 0.05]]) for i in range(300)]
    found = whitening.whiten(make_vectors(rows)).collect()
    assert {r["component"] for r in found} == {1, 2, 3, 4} and found[0]["identity_error"] < 1e-6


def test_nothing_to_whiten(make_vectors):
    assert whitening.whiten(make_vectors([])).collect() == []
    assert whitening.whiten(make_vectors([(1, None), (2, [])])).collect() == []
    assert whitening.whiten(make_vectors([(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect() == []


def test_deviation_beyond_a_long_is_null():
    model = whitening.Whitening(3, [10, 11], np.array([3, 3]), np.zeros(2), np.zeros((2, 0)), np.zeros(0), 0.0)
    assert whitening.deviations(np.array([[4, 5], [1 << 60, 0]]), model) == [(12 - 10) ** 2 + (15 - 11) ** 2, None]
    assert whitening.deviations(np.array([[1 << 29, 0]]), model) == [((3 << 29) - 10) ** 2 + 11**2]
    assert whitening.deviations(np.array([[1 << 29, 3], [4, 5]]), model)[1] == 20
