"""Small hand-computed cases for rules whose plan and oracle share one reading."""

import os

import pytest
from pyspark.sql import functions as F

from pulseframe.functions.semantics import to_num
from pulseframe.operators import behaviour, describe, models
from pulseframe.plans.consolidate import with_columns_if_all_null
from pulseframe.plans.q_models import purchase_target
from pulseframe.sources import readers, sinks


def test_to_num_rejects_java_literals(spark):
    texts = ["12", " 3.5 ", "1e3", "12d", "1f", "2.D", "0x1p3", "None", "", "NaN", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r.v for r in df.select("i", to_num("t").alias("v")).orderBy("i").collect()]
    assert got == [12.0, 3.5, 1000.0] + [None] * 8
    assert df.select(to_num("i").alias("v")).orderBy("v").first().v == 0.0


def _views(spark, rows):
    return spark.createDataFrame([(a, u, "view", "2024-01-01") for a, u in rows],
                                 "interactable_id int, user_id int, type string, created_at string")


def test_articles_rank_by_readers_before_views(spark):
    titles = spark.createDataFrame([(1, "A"), (2, "B")], "content_id int, title string")
    top, _ = behaviour.article_overview(_views(spark, [(1, 7)] * 5 + [(2, 7), (2, 8)]), titles)
    assert [(r.title, r.unique_readers, r.views) for r in top.collect()] == [("B", 2, 2), ("A", 1, 5)]


def test_internal_readers_go_and_unknown_readers_stay(spark):
    users = spark.createDataFrame([(1, "ann@work.example"), (2, "Ann@home.example"), (3, None), (4, "bob@home.example")],
                                  "id int, email string")
    titles = spark.createDataFrame([(1, "A")], "content_id int, title string")
    views = _views(spark, [(1, 1), (1, 2), (1, 3), (1, 4), (1, 99)])
    _, summary = behaviour.article_overview(views, titles, users, ["@work.example"])
    assert summary.first().unique_readers == 3  # 3, 4 and 99


def test_engagement_by_hand(spark):
    people = spark.createDataFrame([(1, 1, 5), (2, 2, 5), (3, 3, 6), (4, 4, None)], "id int, user_id int, store_id int")
    scores = spark.createDataFrame([(1, 60.0), (3, None)], "participant_id int, lifestyle_score double")
    comps = spark.createDataFrame([(10, 1, 1), (11, 1, 2), (12, 2, 1)], "id int, participant_id int, questionnaire_id int")
    views = spark.createDataFrame([(1,)], "user_id int")
    buys = spark.createDataFrame([(2,)], "participant_id int")
    ch = spark.createDataFrame([(5, 1, "Completed"), (5, 1, "active"), (6, 3, "stopped")],
                               "store_id int, user_ref int, status string")
    out = behaviour.engagement_scores(people, scores, comps, views, buys, ch, n_questionnaires=8)
    # 1: 30 + 20 + .15 * 25 + 15 + .1 * 50; 2: 15 + .15 * 12.5 + 5 + 10 (breadth 12.5)
    assert {r.participant_id: r.engagement_score for r in out.collect()} == {1: 73.8, 2: 31.9, 3: 0.0, 4: 0.0}
    names = spark.createDataFrame([(5, "S")], "store_id int, store_name string")
    by = {r.store_id: r for r in behaviour.engagement_by_store(out, names).collect()}
    assert by[5].mean_engagement == 52.9 and by[6].mean_engagement == 0.0  # 52.85 rounds up
    assert by[5].benchmark == pytest.approx(52.9 * 2 / 3)


def test_store_total_weighs_rounded_means(spark):
    wide = spark.createDataFrame([(1, 1, 1.0), (1, 2, 1.0), (1, 3, 2.0), (2, 4, 5.0), (3, 5, None)],
                                 "store_id int, participant_id int, v double")
    names = spark.createDataFrame([(1, "a")], "store_id int, store_name string")
    rows = behaviour.scores_per_store(wide, names, "v").collect()
    assert {r.store_id: r.mean_score for r in rows} == {1: 1.33, 2: 5.0}
    assert rows[0].weighted_total == pytest.approx((1.33 * 3 + 5) / 4)


def test_failed_purchases_do_not_count(spark):
    w = spark.createDataFrame([(1, 1), (2, 2), (3, 3)], "participant_id int, user_id int")
    p = spark.createDataFrame([(1, 3, "Canceled"), (2, 3, "paid"), (None, 1, "paid")],
                              "participant_id int, user_id int, status string")
    assert {r.participant_id: r.has_purchase for r in purchase_target(w, p).collect()} == {1: 0, 2: 1, 3: 0}


def test_empty_columns_are_left_out_of_quality(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, None)], "a double, b double")
    assert [r.column for r in describe.data_quality(df, ["a", "b"]).collect()] == ["a"]


def test_missing_value_has_no_influence(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 3.0), (3, None)], "_id int, a double")
    got = {r._id: r.influence for r in models.local_influence(df, df, [("a", 0.5)]).collect()}
    assert got == {1: -0.5, 2: 0.5, 3: 0.0}


def test_threshold_scan_order_and_recalls(spark):
    df = spark.createDataFrame([(0.0, 0.0, 0.0), (1.0, 0.0, 0.5), (2.0, 0.5, 0.0)],
                               "label double, p_high double, p_moderate double")
    rows = models.threshold_scan(df, [0.1, 0.2, 0.6], top=5).collect()
    assert [(r.t_moderate, r.t_high) for r in rows[:4]] == [(0.1, 0.1), (0.1, 0.2), (0.2, 0.1), (0.2, 0.2)]
    assert (rows[4].macro_recall, rows[4].recall_low, rows[4].recall_moderate, rows[4].recall_high) == (0.667, 1.0, 1.0, 0.0)


def test_derived_columns_share_one_aggregate(spark):
    df = spark.range(3).select("id", *[F.lit(None).cast("int").alias(f"c{i}") for i in range(7)], F.lit(5).alias("kept"))
    out = with_columns_if_all_null(df, {**{f"c{i}": F.lit(i) for i in range(7)}, "kept": F.lit(0), "new": F.lit(9)})
    row = out.first()
    assert [row[f"c{i}"] for i in range(7)] == list(range(7)) and (row.kept, row.new) == (5, 9)
    assert out._jdf.queryExecution().analyzed().toString().count("Range (0, 3") == 2


def test_header_far_down_and_repeated_junk(spark, tmp_path):
    path = str(tmp_path / "import.csv")
    with open(path, "w", encoding="utf-8") as f:
        f.write("Export\n" * 5000 + "Participant ID;Geslacht\n1;Man\nExport\n2;Vrouw\nParticipant ID;Geslacht\n")
    rows = [tuple(r) for r in readers.read_csv_sniffed(spark, path).collect()]
    assert rows == [("1", "Man"), ("Export", None), ("2", "Vrouw"), ("Participant ID", "Geslacht")]


def test_upsert_refuses_repeated_keys_and_recovers(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.upsert_table(spark, spark.createDataFrame([(1, "a")], "k int, v string"), path, ["k"])
    with pytest.raises(ValueError):
        sinks.upsert_table(spark, spark.createDataFrame([(2, "a"), (2, "b")], "k int, v string"), path, ["k"])
    os.rename(path, path + ".__old_20240101")  # a run that died between its two renames
    counts = sinks.upsert_table(spark, spark.createDataFrame([(2, "b")], "k int, v string"), path, ["k"])
    assert (counts["inserted"], counts["kept"]) == (1, 1)
