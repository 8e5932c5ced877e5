"""Whitening against one dense decomposition, and edge rows."""

import math
import re

import numpy as np
import pytest
from conftest import DATA

from tessera.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label string, key string, vector string"


def plain(rows, k=32):
    """n, {position: deviation}, eigenvalues, whitened up to signs, of rows (vec_id, vector) that take part."""
    x = np.array([[math.floor(64 * float(np.float32(c))) + 1000000 for c in v] for _, v in rows], dtype=object)
    n, s = len(x), x.sum(axis=0)
    deviations = [sum(int((n * a - b) ** 2) for a, b in zip(r, s, strict=True)) for r in x]
    y = np.array([[float(n * a - b) / n for a, b in zip(r, s, strict=True)] for r in x])
    v = y.T @ y / n
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    return n, deviations, values, y @ vectors, np.trace(v)


def check(got, rows, k=32):
    n, deviations, values, projected, trace = plain(rows, k)
    d = len(rows[0][1])
    k = min(k, d)
    assert len(got) == n * k
    by = {}
    for r in got:
        by.setdefault((r.vec_id, r.deviation), {}).setdefault(r.component, []).append(r)
    assert {r.n for r in got} == {n}
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9
    w = np.zeros((n, k))
    for i, (vec_id, _) in enumerate(rows):
        for j in range(k):
            r = by[vec_id, deviations[i]][j + 1].pop()
            w[i, j] = np.nan if r.whitened is None else r.whitened
            assert abs(r.explained - max(values[j], 0) / trace) < 1e-9
    for j in range(k):
        want = projected[:, j] / np.sqrt(values[j]) if values[j] > 1e-9 * values[0] else np.full(n, np.nan)
        sign = -1 if np.nansum(want * w[:, j]) < 0 else 1
        assert np.allclose(w[:, j], sign * want, rtol=1e-6, atol=1e-6, equal_nan=True)


def test_against_dense(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()]
    rows = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    check(whitening.op13_whitening(spark, DATA).collect(), rows)


@pytest.mark.parametrize("flat", [False, True])
def test_decaying_and_flat_spectra(spark, flat):
    """With a steep spectrum the first basis does; with a flat one it is expanded."""
    rng = np.random.default_rng(1)
    scale = np.ones(60) if flat else np.array([100.0 * 0.7**j if j < 20 else 0.0 for j in range(60)])
    basis = np.linalg.qr(rng.standard_normal((60, 60)))[0]
    x = rng.standard_normal((500, 60)) * scale @ basis.T
    rows = [(i, [float(c) for c in np.float32(v)]) for i, v in enumerate(x)]
    df = spark.createDataFrame([(i, v, "l", "k", "v") for i, v in rows], SCHEMA).repartition(5)
    check(whitening.whitened(df, "vec_id", "embedding", 8).select("*").collect(), rows, 8)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    good = [(1, [1.0, 2.0, 5.0]), (1, [1.0, 2.0, 5.0]), (None, [-3.5, 0.25, 1.0]), (4, [0.0, 1.0, -2.0]), (5, [2.0, 2.0, 2.0])]
    bad = [(6, None), (7, [1.0, None, 2.0]), (8, [nan, 0.0, 0.0]), (9, [0.0, inf, 0.0])]
    df = spark.createDataFrame([(i, v, "l", "k", "v") for i, v in good + bad], SCHEMA)
    got = whitening.whitened(df, "vec_id", "embedding").collect()
    check(got, good)
    # equal vectors vary in nothing; one component has no variance; empty vectors and tables have none
    same = whitening.whitened(spark.createDataFrame([(i, [1.0, 2.0], "l", "k", "v") for i in range(4)], SCHEMA), "vec_id", "embedding").collect()
    assert len(same) == 8 and {(r.whitened, r.explained, r.deviation) for r in same} == {(None, None, 0)}
    line = whitening.whitened(spark.createDataFrame([(i, [float(i), 2.0 * i], "l", "k", "v") for i in range(9)], SCHEMA), "vec_id", "embedding").collect()
    assert {(r.component, r.whitened is None) for r in line} == {(1, False), (2, True)}
    assert whitening.whitened(spark.createDataFrame([(1, [], "l", "k", "v"), (2, None, "l", "k", "v")], SCHEMA), "vec_id", "embedding").count() == 0
    assert whitening.whitened(spark.createDataFrame([], SCHEMA), "vec_id", "embedding").count() == 0
    # lengths are fitted apart
    mixed = [(i, [float(i % 3), float(i % 5)], "l", "k", "v") for i in range(8)] + [(i, [float(i), 0.5, float(i * i)], "l", "k", "v") for i in range(20, 26)]
    found = whitening.whitened(spark.createDataFrame(mixed, SCHEMA), "vec_id", "embedding").collect()
    assert {(r.n, sum(x.vec_id == r.vec_id for x in found)) for r in found} == {(8, 2), (6, 3)}
    # exact beyond doubles, null beyond a long
    big = whitening.whitened(spark.createDataFrame([(i, [float(i * 2**20), 1.0], "l", "k", "v") for i in range(6)], SCHEMA), "vec_id", "embedding").collect()
    x = [i * 2**26 + 1000000 for i in range(6)]
    assert {r.vec_id: r.deviation for r in big} == {i: (6 * x[i] - sum(x)) ** 2 for i in range(6)}
    huge = whitening.whitened(spark.createDataFrame([(i, [float(i * 2**30)], "l", "k", "v") for i in range(6)], SCHEMA), "vec_id", "embedding").collect()
    assert {r.deviation for r in huge} == {None}
    with pytest.raises(Exception, match=re.escape("an entry is beyond")):
        whitening.whitened(spark.createDataFrame([(1, [1e30], "l", "k", "v")], SCHEMA), "vec_id", "embedding")
