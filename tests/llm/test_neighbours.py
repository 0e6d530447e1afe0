"""Leaves of the vector forest stay bounded, and the neighbours in them are right."""

import numpy as np
import pytest
from pyspark.sql import functions as F

N = pytest.importorskip("archivolt.llm.neighbours")


def clusters(n, centres, seed=1):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(centres, 16))
    return (c[rng.integers(0, centres, n)] + rng.normal(size=(n, 16)) * 0.35).astype(np.float32)


def test_no_leaf_is_larger_than_its_bound(spark):
    x = clusters(6000, 40)
    x[:1500] = x[0] + np.random.default_rng(2).normal(size=(1500, 16)).astype(np.float32) * 1e-3  # one bucket with a quarter of all rows
    rows = spark.createDataFrame([(0, i, bytes((v / np.linalg.norm(v)).tobytes())) for i, v in enumerate(x)], "leaf long, key long, vec binary")
    got = N.bounded_leaves(rows, 16, 200)
    sizes = [r[1] for r in got.groupBy("leaf").count().collect()]
    assert max(sizes) <= 200 and got.select("key").distinct().count() == 6000
    same = spark.createDataFrame([(5, i, bytes(np.ones(16, np.float32).tobytes())) for i in range(900)], "leaf long, key long, vec binary")
    got = N.bounded_leaves(same, 16, 200)
    assert max(r[1] for r in got.groupBy("leaf").count().collect()) <= 200 and got.select("key").distinct().count() == 900


def test_recall_with_a_small_sample(spark):
    x = clusters(4000, 200)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "k long, v array<float>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    want = {(i, int(j)) for i, row in enumerate(np.argsort(-s, axis=1)[:, :5]) for j in row}
    have = {(r.a, r.b) for r in N.nearest(df, "k", "v", 5, size=16, sample=200, leaf_most=300).select("a", "b").collect()}
    assert len(want & have) >= 0.9 * len(want) and len(have) == 5 * 4000


def test_ties_at_the_last_place_go_to_the_smaller_key(spark):
    e = np.eye(16, dtype=np.float32)
    rows = [(0, e[0])] + [(i, e[0] + e[i]) for i in range(1, 9)]
    df = spark.createDataFrame([(int(k), [float(v) for v in r]) for k, r in rows], "k long, v array<float>")
    got = sorted(r.b for r in N.nearest(df, "k", "v", 3, size=16).where(F.col("a") == 0).collect())
    assert got == [1, 2, 3]
