"""Sainte-Lague seats against ranking every quotient; many small sources; clashing names."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pulseframe.llm import mixing


def ranked(parts, block):
    """Seats by listing and ranking all quotients."""
    house = int(sum(parts) / block + 0.5)
    q = sorted((-p / (2 * j - 1), i) for i, p in enumerate(parts) if p > 0 for j in range(1, int(3 * p / block) + 22))
    return Counter(i for _, i in q[:house])


@pytest.mark.parametrize("kind", ["ties", "skewed", "tiny", "zero", "one", "wide"])
def test_apportion_is_sainte_lague(spark, monkeypatch, kind):
    r = random.Random(6)
    parts = {"ties": [20.0] * 200, "skewed": [1e6] + [r.random() * 30 for _ in range(300)], "tiny": [0.5] * 500 + [3.0],
             "zero": [0.0] * 5, "one": [1234.5], "wide": [10 ** r.uniform(0, 5) for _ in range(400)]}[kind]
    monkeypatch.setattr(mixing, "NARROW", 8)
    df = spark.createDataFrame(list(enumerate(parts)), "i int, part double")
    got = {x.i: x.blocks for x in mixing.apportion(df, 16, ("i",)).collect()}
    want = ranked(parts, 16)
    assert got == {i: want.get(i, 0) for i in range(len(parts))}
    assert sum(got.values()) == (int(sum(parts) / 16 + 0.5) if any(parts) else 0)


def test_many_small_sources_are_taken(spark):
    """200 sources of one 20-word document: the house is handed out, not rounded away."""
    rows = [(i, f"s{i:03d}", 20) for i in range(200)]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, size long"), weights=(1,)).collect()
    assert sum(r.taken for r in out) == 4000 and {r.target for r in out} == {20.0}
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, size long"), weights=(1,), block_tokens=64).collect()
    assert 3600 <= sum(r.taken for r in out) <= 4400


def test_targets_stop_at_their_caps(spark):
    sizes = [("a", 1000), ("b", 10), ("c", 1), (None, 5), ("d", 0)]
    out = {r.source: r.target for r in mixing.source_targets(
        spark.createDataFrame(sizes, "source string, size long"), weights=(1, 50, 50)).collect()}
    assert (out["b"], out["c"], out["d"]) == (30.0, 3.0, 0.0) and out[None] == 15.0
    assert abs(out["a"] - (1016 - 48)) < 1e-9


def test_mixed_documents_keep_clashing_columns(spark, docs):
    names = ("_tag", "_key", "row", "tag", "_rank", "_shard", "_end", "_id", "_n", "size", "target")
    clash = docs.withColumns({c: F.lit(f"user {c}") for c in names})
    out = mixing.mix_documents(clash)
    assert out.columns == clash.columns
    assert {tuple(r[c] for c in names) for r in out.collect()} == {tuple(f"user {c}" for c in names)}
    assert out.count() == mixing.mix_documents(docs).count()
