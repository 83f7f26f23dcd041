"""Whitening against exact integers and a second solver."""

import math

import numpy as np
from pyspark.sql import functions as F

from tessella.llm import whitening
from tessella.llm.queries import op12_embedding_whitening

SF = "/root/testdata/sf0.001"


def exact(x):
    n, sums = len(x), x.sum(axis=0)
    c = n * x - sums
    return n, c, c.T.dot(c)


def test_sums_of_products_keep_what_doubles_lose():
    rng = np.random.default_rng(3)
    x = rng.integers(-(1 << 40), 1 << 40, (700, 9)).astype(object)
    n, c, want = exact(x)
    high, low = whitening.outer_sum(c.astype(object))
    far = max(abs(int(h) + int(e) - w) / abs(w) for h, e, w in zip(high, low, want[np.triu_indices(9)], strict=True))
    assert far < 1e-28
    small = rng.integers(-1000, 1000, (500, 5))
    n, c, want = exact(small)
    high, low = whitening.outer_sum(c)
    assert [int(h) + int(e) for h, e in zip(high, low, strict=True)] == [int(v) for v in want[np.triu_indices(5)]]


def test_query_against_exact_integers(spark):
    docs = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    x = np.array([[math.floor(1024 * float(v)) + 100000 for v in r.embedding] for r in docs]).astype(object)
    n, c, want = exact(x)
    v = np.array([[float(a) / n**3 for a in r] for r in want])
    values, vectors = np.linalg.svd(v)[1], np.linalg.svd(v)[2]
    got = op12_embedding_whitening(spark, SF).collect()
    assert len(got) == 8 * len(docs)
    place = {r.vec_id: i for i, r in enumerate(docs)}
    by = np.zeros((len(docs), 8))
    for r in got:
        i = place[r.vec_id]
        assert r.n == n and r.deviation == int((c[i] * c[i]).sum()) and r.identity_error <= 1e-9
        assert abs(r.explained / (values[r.component - 1] / np.trace(v)) - 1) < 1e-9
        by[i, r.component - 1] = r.whitened
    for k in range(8):
        own = (c.astype(float) / n) @ vectors[k] / values[k] ** 0.5
        assert min(abs(by[:, k] - own).max(), abs(by[:, k] + own).max()) < 1e-6


def test_rows_that_count(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0], "x"), (2, [2.0, 0.5], None), (2, [2.0, 0.5], None), (None, [0.0, 0.25], "y"), (3, None, ""), (4, [], ""), (5, [1.0, None], ""), (6, [nan, 1.0], ""), (7, [inf, 1.0], ""), (8, [1.0], ""), (9, [1e300, 0.0], "")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n string")
    got = whitening.whiten(df).collect()
    assert sorted((r.vec_id for r in got), key=str) == [1, 2, 2, None]
    assert all(r.n == 4 and len(r.whitened) == 2 and abs(sum(r.explained) - 1) < 1e-12 and r.identity_error < 1e-12 for r in got)
    assert whitening.whiten(df.filter("vec_id = 3")).collect() == []
    assert whitening.fit(df.limit(0)) is None


def test_no_variance(spark):
    df = spark.createDataFrame([(i, [1.0, 2.0, 3.0]) for i in range(5)], "vec_id long, embedding array<float>")
    got = whitening.whiten(df).select(F.explode("whitened").alias("w"), "identity_error", "deviation").collect()
    assert {(r.w, r.identity_error, r.deviation) for r in got} == {(0.0, 1.0, 0)}


def test_long_vectors_and_large_sums(spark):
    rng = np.random.default_rng(7)
    rows = [(i, [float(v) for v in rng.normal(1e9, 1.0, 300)]) for i in range(40)]
    model = whitening.fit(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    x = np.array([[math.floor(1024 * v) + 100000 for v in r[1]] for r in rows]).astype(object)
    n, _, want = exact(x)
    assert np.array_equal(model.covariance, np.array([[int(a) / n**3 for a in r] for r in want]))
