"""Profiles alike by blocks: leaves that no cut can divide, and no row per pair."""

import math

from pyspark.sql import functions as F

from pulseframe.operators import similarity


def test_profile_links_of_one_direction(spark):
    """Many profiles of one direction and different lengths fill one leaf; its blocks still meet all others."""
    rows = [(i, float(i % 40 + 1) * s, float(i % 40 + 1) * s * 2) for i, s in enumerate([1, -1] * 60)]
    got = {r.user_id: (r.class_id, r.class_size, r.n_links) for r in similarity.profile_links(
        spark.createDataFrame(rows, "user_id long, a double, b double"), "user_id", ["a", "b"], block=4).collect()}
    mean = [math.fsum(r[c] for r in rows) / len(rows) for c in (1, 2)]
    for i, a, b in rows:
        side = (a - mean[0]) > 0
        same = [k for k, x, y in rows if (x, y) == (a, b)]
        assert got[i] == (min(same), len(same), sum((x - mean[0] > 0) == side for _, x, _ in rows) - 1)
    assert len(got) == 120


def test_profile_links_make_no_row_per_pair(spark):
    """Pairs are counted inside tasks: the rows that meet are blocks, not classes."""
    df = spark.range(500).select(F.col("id").alias("user_id"), F.rand(1).alias("a"), F.rand(2).alias("b"), F.rand(3).alias("c"))
    plan = similarity.profile_links(df, "user_id", ["a", "b", "c"], block=10)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "AS _size#" not in plan
