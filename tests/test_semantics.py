"""Hand-made frames for the pandas-versus-Spark traps."""

import datetime as dt

from pyspark.sql import functions as F

from pulseframe.functions import rules
from pulseframe.functions.semantics import (cut, days_between, first_non_null, last_non_null, pearson, row_mean,
                                            to_num, to_ts, weighted_average)
from pulseframe.operators import describe
from pulseframe.operators.reshape import latest_per_key


def test_to_num_text_and_nan(spark):
    df = spark.createDataFrame([(" 12 ",), ("None",), ("NaN",), ("abc",), (None,), ("1.5",)], "s string")
    got = [r[0] for r in df.select(to_num("s")).collect()]
    assert got == [12.0, None, None, None, None, 1.5]


def test_to_ts_dayfirst(spark):
    df = spark.createDataFrame([("31-01-2030",), ("2024-02-03",), ("junk",)], "s string")
    got = [r[0] for r in df.select(to_ts("s", dayfirst=True)).collect()]
    assert got == [dt.datetime(2030, 1, 31), dt.datetime(2024, 2, 3), None]


def test_days_between_floors_elapsed_time(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1, 23, 0), dt.datetime(2024, 1, 2, 1, 0)),
                                (dt.datetime(2024, 1, 2, 1, 0), dt.datetime(2024, 1, 1, 23, 0))],
                               "a timestamp_ntz, b timestamp_ntz")
    assert [r[0] for r in df.select(days_between("a", "b")).collect()] == [0, -1]


def test_cut_right_and_include_lowest(spark):
    df = spark.createDataFrame([(0.0,), (180.0,), (181.0,), (99999.0,), (100000.0,)], "d double")
    labels = rules.CHANGE_PERIOD_LABELS
    got = [r[0] for r in df.select(cut("d", rules.CHANGE_PERIOD_EDGES, labels)).collect()]
    assert got == [None, labels[0], labels[1], labels[4], None]
    got = [r[0] for r in df.select(cut("d", rules.CHANGE_PERIOD_EDGES, labels, include_lowest=True)).collect()]
    assert got[0] == labels[0]
    age = spark.createDataFrame([(29.9,), (30.0,), (None,)], "a double")
    got = [r[0] for r in age.select(cut("a", rules.AGE_FILTER_EDGES, rules.AGE_FILTER_LABELS, right=False)).collect()]
    assert got == ["<30", "30-40", None]


def test_first_last_non_null_per_column(spark):
    df = spark.createDataFrame([(1, 1, None), (1, 2, 5.0), (1, 3, 7.0), (1, 4, None)], "k int, t int, v double")
    row = df.groupBy("k").agg(first_non_null("v", "t").alias("f"), last_non_null("v", "t").alias("l")).first()
    assert (row.f, row.l) == (5.0, 7.0)


def test_latest_per_key_prefers_real_timestamps_and_breaks_ties(spark):
    df = spark.createDataFrame([(1, None, 1, 9.0), (1, dt.datetime(2020, 1, 1), 2, 1.0),
                                (1, dt.datetime(2020, 1, 1), 3, 2.0), (2, None, 4, 3.0)],
                               "p int, ts timestamp_ntz, id int, v double")
    out = {r.p: (r.id, r.v) for r in latest_per_key(df, ["p"], "ts", ["id"]).collect()}
    assert out == {1: (3, 2.0), 2: (4, 3.0)}


def test_row_mean_and_weighted_average(spark):
    df = spark.createDataFrame([(1.0, None, 3.0, 2.0), (None, None, None, 0.0)], "a double, b double, c double, w double")
    assert [r[0] for r in df.select(row_mean(["a", "b", "c"])).collect()] == [2.0, None]
    v = spark.createDataFrame([(10.0, 1.0), (20.0, 3.0), (None, 5.0), (99.0, 0.0)], "v double, w double")
    assert v.agg(weighted_average("v", "w")).first()[0] == 17.5


def test_pearson_constant_is_null(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0), (1.0, None)], "a double, b double")
    assert df.agg(pearson("a", "b")).first()[0] is None


def test_gender_code_text_wins(spark):
    df = spark.createDataFrame([("Man",), ("vrouw",), ("1",), ("0",), (None,), ("F",), ("x",)], "g string")
    assert [r[0] for r in df.select(rules.gender_code("g")).collect()] == [1, 0, 1, 0, None, 0, None]


def test_bmi_category_missing_code(spark):
    df = spark.createDataFrame([(31.0,), (26.0,), (20.0,), (17.0,), (None,)], "b double")
    assert [r[0] for r in df.select(rules.bmi_category("b")).collect()] == [2, 1, 0, -1, 0]
    assert [r[0] for r in df.select(rules.bmi_category("b", missing_code=None)).collect()][-1] is None


def test_net_label_title_case_last(spark):
    df = spark.createDataFrame([("rec_ls_sleep_psqi_sum",), ("rec_asr_wai_score",)], "c string")
    assert [r[0] for r in df.select(rules.net_label("c")).collect()] == ["Sleep Psqi Sum", "Wai Score"]


def test_pct_distribution_drops_unlabelled_after_share(spark):
    df = spark.createDataFrame([(0,), (0,), (1,), (5,), (None,)], "c int")
    out = {r.code: r.pct for r in describe.pct_distribution(df, "c", {0: "a", 1: "b"}).collect()}
    assert out == {0.0: 50.0, 1.0: 25.0}


def test_quantiles_degenerate_normalisation(spark):
    df = spark.createDataFrame([(5.0,), (5.0,), (5.0,)], "x double")
    got = [r.x_norm for r in describe.normalize_p5_p95(df, "x").collect()]
    assert got == [10.0, 10.0, 10.0]


def test_analysis_columns_rules():
    cols = ["participant_id", "rec_med_bmi", "rec_med_bmi_cat", "rec_heartrisk_cat", "show_tip", "rec_coach_x",
            "rec_ls_sleep_sum", "feat_a"]
    got = describe.analysis_columns(cols, skip_prefixes=["show_", "rec_coach_"], skip_exact=["rec_ls_sleep_sum"])
    assert got == ["rec_med_bmi", "rec_heartrisk_cat", "feat_a"]


def test_sleep_text_buckets(spark):
    df = spark.createDataFrame([("6-7 hours",), ("Entre 7 et 9 heures",), (" 9-10 uur ",), ("x",)], "s string")
    b, k = rules.sleep_bucket("s")
    got = [(r[0], r[1]) for r in df.select(b, k).collect()]
    assert got == [("6-7 uur", 2), ("7-9 uur", 3), ("9-10 uur", 4), (None, None)]


def test_email_parts_and_region(spark):
    df = spark.createDataFrame([(" Jan.Smit@Example.com ", "NL", None), ("a@b.org", None, "1234 AB"),
                                (None, "Belgie", "9999")], "e string, c string, pc string")
    rows = df.select(rules.email_local_part("e"), rules.region_flag("c", "pc")).collect()
    assert [tuple(r) for r in rows] == [("jan.smit", "Nederland"), ("a", "Nederland"), (None, "Buitenland")]


def test_quantile_table_matches_linear_interpolation(spark):
    import numpy as np
    rows = [("hot", float(v % 37)) for v in range(3000)] + [("a", 1.0), ("a", 2.0), ("a", 10.0), ("b", 5.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    probs = [0.0, 0.05, 0.25, 0.5, 0.95, 1.0]
    got = {r.g: [r[f"q{i}"] for i in range(len(probs))]
           for r in describe.quantile_table(df, ["g"], "v", probs, partitions=7).collect()}
    for g in ("hot", "a", "b"):
        vals = np.array([v for k, v in rows if k == g])
        want = [float(np.quantile(vals, p)) for p in probs]
        assert np.allclose(got[g], want), (g, got[g], want)
    empty = describe.quantile_table(df.where("v < 0"), [], "v", [0.5]).collect()
    assert len(empty) == 1 and empty[0][0] is None  # a global aggregate of nothing is one NULL row


def test_time_helpers_ignore_session_time_zone(spark):
    from pulseframe.functions.semantics import day_start, month_start
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Europe/Amsterdam")
    try:
        df = spark.createDataFrame([(dt.datetime(2024, 3, 30, 23, 0), dt.datetime(2024, 3, 31, 23, 30))],
                                   "a timestamp_ntz, b timestamp_ntz")
        r = df.select(days_between("a", "b"), month_start("b"), day_start("b")).first()
        assert tuple(r) == (1, dt.datetime(2024, 3, 1), dt.datetime(2024, 3, 31))
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
