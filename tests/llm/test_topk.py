"""Pivot elimination: exact on clustered, repeated and ragged vectors, and sparing."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulseframe.llm import topk

SIZES = {"block": 256, "query_block": 16, "pivots": 24}


def brute(rows, k=5):
    use = [(i, np.floor(256 * np.array(v, float))) for i, v in rows if i is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)]
    width = max(len(v) for _, v in use)
    ids, x = np.array([i for i, _ in use]), np.array([np.pad(v, (0, width - len(v))) for _, v in use])
    want = {}
    for i, v in zip(ids, x, strict=True):
        if i % 50 == 0:
            s = x @ v
            s[ids == i] = -np.inf
            best = [j for j in np.lexsort((ids, -s))[:k] if s[j] > -np.inf]
            want |= {(int(i), n + 1): (int(ids[j]), int(s[j])) for n, j in enumerate(best)}
    return want


def rows_of(df, **sizes):
    return {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk.top_k(df, F.col("vec_id") % 50 == 0, **sizes).collect()}


def clustered(n=3000, dims=32, centres=20):
    r = np.random.default_rng(7)
    middle = r.normal(size=(centres, dims))
    middle /= np.linalg.norm(middle, axis=1)[:, None]
    return [(i, (middle[i % centres] + 0.05 * r.normal(size=dims)).astype(float).tolist()) for i in range(n)]


def test_clustered_vectors_are_spared(spark):
    rows = clustered()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert rows_of(df, **SIZES) == brute(rows)
    share = topk.evaluated(df, F.col("vec_id") % 50 == 0, **SIZES) / (60 * len(rows))
    assert share < 0.1


@pytest.mark.parametrize("pivots", [1, 2, 48])
def test_hot_vector_ragged_and_few_pivots(spark, pivots):
    rows = [(i, v if i % 3 else [0.5] * 32) for i, v in clustered(900)]  # a third are one vector
    rows += [(1000, [2.0]), (1001, []), (1050, []), (1100, [1e3] * 32), (1150, [-1e3] * 40), (1151, None), (None, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(1)).withColumn("b", F.lit(2))
    assert rows_of(df, block=64, query_block=4, pivots=pivots) == brute(rows)


def test_places_bound_distances_from_below():
    r = np.random.default_rng(3)
    x, p = np.floor(100 * r.normal(size=(200, 16))), np.floor(100 * r.normal(size=(9, 16)))
    table = topk.Table(p)
    squared = table.squared(x)
    assert (squared == ((x[:, None] - p) ** 2).sum(2)).all()
    place = table.place(squared)
    true = np.sqrt(((x[:, None] - x) ** 2).sum(2))
    low = np.sqrt(((place[:, None] - place) ** 2).sum(2))
    d = np.sqrt(squared)
    single = np.abs(d[:, None] - d).max(2)
    assert (low <= true + 1e-6).all() and (low >= single - 1e-6).all() and low.sum() > single.sum()
