"""Explorer, profiles alike, accounts, regions and coverage against hand-made or brute-force results."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from pulseframe.operators import behaviour, describe, explorer, similarity
from pulseframe.operators.explorer import Variable

# ---------------------------------------------------------------- similarity


def brute(rows, threshold):
    """rows: (id, values). Cosines of standardised values, every pair."""
    n = len(rows)
    cols = list(zip(*[[0.0 if v is None else v for v in vs] for _, vs in rows], strict=True))
    scaled = []
    for c in cols:
        mean = math.fsum(c) / n
        std = math.sqrt(math.fsum((x - mean) ** 2 for x in c) / n)
        scaled.append([(x - mean) / std if std > 1e-12 else 0.0 for x in c])
    z = list(zip(*scaled, strict=True))
    raw = list(zip(*cols, strict=True))
    norm = [math.sqrt(sum(x * x for x in v)) for v in z]
    out = {}
    for i in range(n):
        links, best = 0, None
        same = [j for j in range(n) if raw[j] == raw[i]]
        for j in range(n):
            if i == j or norm[i] < 1e-12 or norm[j] < 1e-12:
                continue
            cos = sum(a * b for a, b in zip(z[i], z[j], strict=True)) / norm[i] / norm[j]
            if cos > threshold:
                links += 1
                if raw[j] != raw[i]:
                    best = max(best or 0, cos)
        out[rows[i][0]] = (min(rows[j][0] for j in same), len(same), links, best)
    return out


@pytest.mark.parametrize("threshold,block,prefix", [(0.9, 4096, 3), (0.9, 10, 2), (0.5, 50, 1), (0.99, 7, 4)])
def test_profile_links_lose_no_pair(spark, threshold, block, prefix):
    """A third of the rows is one profile; missing values, a constant column."""
    r = random.Random(2)
    rows = [(i, [r.gauss(0, 1), r.gauss(5, 3) if i % 9 else None, r.choice([1.0, 2.0, 40.0]), r.random(), 7.0]) for i in range(200)]
    rows += [(1000 + i, [0.5, 4.0, 2.0, 0.25, 7.0]) for i in range(100)]
    rows += [(2000, [x * 1.0 for x in rows[3][1]])] if None not in rows[3][1] else []
    df = spark.createDataFrame([(i, *v) for i, v in rows], "user_id long, a double, b double, c double, d double, e double").repartition(4)
    got = {r.user_id: r for r in similarity.profile_links(df, "user_id", list("abcde"), threshold, prefix, block).collect()}
    want = brute(rows, threshold)
    assert set(got) == set(want)
    for k, (cls, size, links, best) in want.items():
        assert (got[k].class_id, got[k].class_size, got[k].n_links) == (cls, size, links), k
        assert (best is None) == (got[k].best_similarity is None) and (best is None or abs(best - got[k].best_similarity) < 1e-8)


def test_profile_links_degenerate(spark):
    schema = "user_id long, a double, b double"
    assert similarity.profile_links(spark.createDataFrame([], schema), "user_id", ["a", "b"]).count() == 0
    same = spark.createDataFrame([(i, 1.0, 2.0) for i in range(4)] + [(None, 5.0, 5.0)], schema)
    assert [(r.class_id, r.class_size, r.n_links) for r in similarity.profile_links(same, "user_id", ["a", "b"]).collect()] == [(0, 4, 0)] * 4


def test_profile_links_keys_are_bounded(spark):
    """No equi-join on the class alone, and no nested loop but with one-row tables."""
    df = spark.range(500).select(F.col("id").alias("user_id"), F.rand(1).alias("a"), F.rand(2).alias("b"), F.rand(3).alias("c"))
    plan = similarity.profile_links(df, "user_id", ["a", "b", "c"], block=10)._jdf.queryExecution().optimizedPlan().toString()
    assert "other_block" in plan and "Cross" not in plan


# ------------------------------------------------------------------ explorer

def test_explorer_by_hand(spark):
    rows = [(1, 10.0, 0.0, "3"), (0, 20.0, 1.0, "x"), (1, 30.0, 1.0, None), (1, 999.0, 2.0, "4"), (None, 15.0, 0.0, "3"), (0, None, 1.0, "3")]
    wide = spark.createDataFrame(rows, "rec_user_gender int, v double, cat double, t string")
    registry = [Variable("v", "V", "box", outlier_max=100), Variable("cat", "C", "bar", labels={0: "laag", 1: "hoog"}),
                Variable("t", "T", "pie"), Variable("gone", "G", "pie"),
                Variable("rec_user_gender", "Geslacht", "histogram", split_gender=True, max_score=2.0)]
    got = {(r.variable, r.gender, r.item, r.x): (r.n, r.value) for r in explorer.variable_explorer(wide, registry).collect()}
    assert got == {
        ("v", "totaal", "mean", None): (3, 20.0), ("v", "totaal", "min", None): (3, 10.0), ("v", "totaal", "q1", None): (3, 15.0),
        ("v", "totaal", "median", None): (3, 20.0), ("v", "totaal", "q3", None): (3, 25.0), ("v", "totaal", "max", None): (3, 30.0),
        ("cat", "totaal", "laag", 0.0): (1, 25.0), ("cat", "totaal", "hoog", 1.0): (3, 75.0),
        ("t", "totaal", "3.0", 3.0): (2, 2.0), ("t", "totaal", "4.0", 4.0): (1, 1.0),
        ("rec_user_gender", "Man", "bin", 1.0): (3, 3.0), ("rec_user_gender", "Vrouw", "bin", 0.0): (2, 2.0)}
    men = explorer.variable_explorer(wide, [registry[0]], gender="man").where("item = 'mean'").first()
    assert (men.n, men.value) == (2, 20.0)
    assert explorer.variable_explorer(wide.limit(0), registry).count() == 0
    with pytest.raises(ValueError):
        explorer.variable_explorer(wide, [Variable("v", "V", "violin")])


def test_explorer_scaled_bins(spark):
    """Scores times their scale, one decimal, half to even; bins of 0.5, the last one closed."""
    wide = spark.createDataFrame([(1, x) for x in (0.0, 4.9, 5.0, 99.0, 100.0, 120.0, 2.5, 3.5)], "rec_user_gender int, s double")
    out = explorer.variable_explorer(wide, [Variable("s", "S", "histogram", split_gender=True, scale=0.1)])
    assert sorted((r.x, r.n) for r in out.collect()) == [(0.0, 3), (0.5, 2), (9.5, 2)]


# ----------------------------------------------------- accounts and coverage

def test_accounts_active_means_completed(spark):
    day = lambda y: dt.date(y, 3, 1)
    acc = spark.createDataFrame([(1, day(2017), "x"), (2, day(2018), None), (3, day(2018), "x"), (4, day(2030), None), (5, day(2031), None),
                                 (6, None, "x"), (None, day(2019), None)], "id long, created_at date, phone string")
    wide = spark.createDataFrame([(1, day(2020)), (2, day(2020)), (3, None), (4, None), (6, day(2020))],
                                 "participant_id long, latest_completion_at date")
    ids = behaviour.completed_ids(wide)
    assert sorted(r.id for r in ids.collect()) == [1, 2, 6]
    per = {r.year: (r.accounts, r.active, r.inactive, r.pct_active, r.cumulative_accounts)
           for r in behaviour.activation_by_year(acc, ids).collect()}
    assert per == {2018: (2, 1, 1, 50.0, 2), 2019: (1, 0, 1, 0.0, 3), 2030: (1, 0, 1, 0.0, 4)}
    idle = behaviour.inactive_accounts(acc, ids, ["phone"]).first()
    assert (idle.n_inactive, idle.modal_year, idle.pct_active, idle.n_phone, idle.pct_phone) == (3, 2018, 50.0, 1, 33.3)
    years = {r.year: (r.active, r.inactive) for r in behaviour.inactive_by_year(acc, ids).collect()}
    assert years == {2017: (1, 0), 2018: (1, 1), 2030: (0, 1), 2031: (0, 1)}


def test_region_takes_the_mean_per_participant_first(spark):
    rows = [(1, "1234 AB", 10.0), (1, "1234 AB", 20.0), (1, "1234 AB", 30.0), (2, "5678", 40.0), (3, "B-12", 7.0), (4, None, 9.0), (5, "1111", None)]
    df = spark.createDataFrame(rows, "participant_id long, pc string, m double").withColumn("region", describe.home_or_abroad("pc"))
    got = {(r.metric, r.region): (r.mean, r.n) for r in describe.region_comparison(df, {"M": "m", "Gone": "x"}).collect()}
    assert got == {("M", "Nederland"): (30.0, 2), ("M", "Buitenland"): (8.0, 2)}


def test_link_coverage_bitmaps(spark):
    a = spark.range(100_000).select((F.col("id") * 7 - 50_000).alias("k"))
    b = spark.range(0, 700_000, 3).select((F.col("id") - 50_000).alias("p"))
    empty = spark.createDataFrame([], "p long")
    some = spark.createDataFrame([(1,), (1,), (None,)], "k long")
    out = {r.source: (r.available, r.linkable, r.pct, r.note) for r in behaviour.link_coverage(
        [("ab", a, "k", b, "p"), ("own", some, "k", None, None), ("none", a, "k", empty, "p"), ("void", empty, "p", a, "k")], {"own": "!"}).collect()}
    both = len({i * 7 - 50_000 for i in range(100_000)} & {i - 50_000 for i in range(0, 700_000, 3)})
    assert out == {"ab": (100_000, both, round(both / 1000, 1), ""), "own": (1, 1, 100.0, "!"), "none": (100_000, 0, 0.0, ""),
                   "void": (0, 0, None, "")}
    plan = behaviour.link_coverage([("ab", a, "k", b, "p")])._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert exchanges and all("_groupingexpression" in e or "(i#" in e for e in exchanges)  # never by id
