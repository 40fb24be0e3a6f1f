"""Registered cohort queries: filters and KPIs over the wide table."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulseframe.functions.semantics import cut_sql
from pulseframe.functions import rules
from pulseframe.operators import cohort
from pulseframe.plans.bindings import Domain, views, wide
from pulseframe.plans.catalog import r, register

W = views("wide")


def _w(spark, sf_dir):
    return wide(Domain(spark, sf_dir))


AGE_CAT_SQL = ("coalesce(" + cut_sql("rec_age_current", rules.AGE_FILTER_EDGES, rules.AGE_FILTER_LABELS, right=False) + ", 'Onbekend')")


@register("filter_gender", W + "SELECT * FROM d_wide WHERE rec_user_gender = 1")
def q_filter_gender(spark, sf_dir):
    return cohort.filter_gender(_w(spark, sf_dir), "man")


@register("filter_store", W + "SELECT * FROM d_wide WHERE store_id = 7")
def q_filter_store(spark, sf_dir):
    d = Domain(spark, sf_dir)
    from pulseframe.operators import linking
    return cohort.filter_store(wide(d), 7, linking.direct_store_links(d.participants, d.stores))


PERIOD_SQL = W + """, rng AS (SELECT date_trunc('day', min(latest_completion_at)) AS dmin,
                       date_trunc('day', max(latest_completion_at)) AS dmax FROM d_wide)
SELECT d_wide.* FROM d_wide, rng
WHERE latest_completion_at >= greatest(dmin, dmax - INTERVAL 12 MONTH)
  AND latest_completion_at < dmax + INTERVAL 1 DAY"""


@register("filter_period", PERIOD_SQL)
def q_filter_period(spark, sf_dir):
    return cohort.filter_period(_w(spark, sf_dir), "latest_completion_at", "1y")


@register("filter_age_category", W + f"SELECT * FROM d_wide WHERE {AGE_CAT_SQL} IN ('<30', '30-40', 'Onbekend')")
def q_filter_age_category(spark, sf_dir):
    return cohort.filter_age_category(_w(spark, sf_dir), ["<30", "30-40", "Onbekend"])


@register("filter_text_values", W + """SELECT * FROM d_wide
    WHERE coalesce(nullif(trim(segment), ''), 'Onbekend') IN ('BUILDING', 'Onbekend')""")
def q_filter_text_values(spark, sf_dir):
    return cohort.filter_text_values(_w(spark, sf_dir), "segment", ["BUILDING", "Onbekend"])


@register("text_options", W + """SELECT DISTINCT coalesce(nullif(trim(segment), ''), 'Onbekend') AS value FROM d_wide""")
def q_text_options(spark, sf_dir):
    return cohort.text_options(_w(spark, sf_dir), "segment")


GLOBAL_SQL = W + f""", g AS (SELECT * FROM d_wide WHERE rec_user_gender = 0 AND store_id IN (SELECT 3)),
rng AS (SELECT date_trunc('day', min(latest_completion_at)) AS dmin, date_trunc('day', max(latest_completion_at)) AS dmax
        FROM g)
SELECT g.* FROM g, rng
WHERE latest_completion_at >= greatest(dmin, dmax - INTERVAL 3 MONTH) AND latest_completion_at < dmax + INTERVAL 1 DAY
  AND {AGE_CAT_SQL} IN ('30-40', '40-50', '50-60')
  AND coalesce(nullif(trim(segment), ''), 'Onbekend') IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD')"""


@register("apply_global_filters", GLOBAL_SQL)
def q_apply_global_filters(spark, sf_dir):
    return cohort.apply_global_filters(_w(spark, sf_dir), gender="vrouw", store_id=3, period="3m",
                                       age_categories=["30-40", "40-50", "50-60"],
                                       text_filters={"segment": ["BUILDING", "MACHINERY", "HOUSEHOLD"]},
                                       date_col="latest_completion_at")


@register("cohort_subset", W + """SELECT * FROM d_wide WHERE rec_user_gender = 1
    AND rec_age_current BETWEEN 25 AND 60 AND (rec_med_bmi IS NULL OR rec_med_bmi BETWEEN 10 AND 40)
    AND rec_ls_stress_cat IN (0, 1) AND rec_heartrisk_cat IN (1, 2)""")
def q_cohort_subset(spark, sf_dir):
    return cohort.cohort_subset(_w(spark, sf_dir), "man", (25, 60), (10, 40), [0, 1], [1, 2])


KPIS = {
    "high_heartrisk": ("rec_heartrisk_cat", "eq", 2),
    "overweight": ("rec_med_bmi_cat", "ge", 1),
    "high_stress": ("rec_ls_stress_cat", "eq", 2),
    "older": ("rec_med_age_cat", "eq", 2),
    "men": ("rec_user_gender", "eq", 1),
    "lifestyle_25": ("rec_ls_lifestyle_score", "ge", 25),
    "bmi_30": ("rec_med_bmi", "ge", 30),
    "heartrisk_20": ("rec_heartrisk", "ge", 20),
}


def _kpi_sql(name, c, op, v):
    cond = f"{c} >= {v}" if op == "ge" else f"{c} = {v}"
    return (f"CAST(sum(CASE WHEN {cond} THEN 1 ELSE 0 END) AS BIGINT) AS {name}_count, count({c}) AS {name}_valid, "
            f"{r(f'coalesce(sum(CASE WHEN {cond} THEN 1 ELSE 0 END) * 100.0 / nullif(count({c}), 0), 0)')} AS {name}_pct")


@register("kpi_count", W + "SELECT " + ", ".join(_kpi_sql(n, *d) for n, d in KPIS.items()) + " FROM d_wide")
def q_kpi_count(spark, sf_dir):
    return cohort.kpi_counts(_w(spark, sf_dir), KPIS)


OVERVIEW_KPIS = {k: KPIS[k] for k in ("high_heartrisk", "overweight", "high_stress", "older", "men")}


@register("kpi_overview", W + "SELECT count(*) AS participants, count(postal_code) AS with_postcode, "
          + ", ".join(_kpi_sql(n, *d) for n, d in OVERVIEW_KPIS.items()) + " FROM d_wide")
def q_kpi_overview(spark, sf_dir):
    w = _w(spark, sf_dir)
    head = w.agg(F.count(F.lit(1)).alias("participants"), F.count("postal_code").alias("with_postcode"))
    return head.crossJoin(cohort.kpi_counts(w, OVERVIEW_KPIS))


@register("detect_date_column", "SELECT 'latest_completion_at' AS date_column")
def q_detect_date_column(spark, sf_dir):
    w = _w(spark, sf_dir)
    return spark.createDataFrame([(cohort.detect_date_column(w),)], "date_column string")


def _share(cond: str) -> str:
    return r(f"avg(CASE WHEN {cond} THEN 1.0 ELSE 0.0 END) * 100")


def _cnt(cond: str) -> str:
    return f"CAST(sum(CASE WHEN {cond} THEN 1 ELSE 0 END) AS BIGINT)"


QUICK_SQL = W + f""", c AS (SELECT * FROM d_wide WHERE rec_user_gender = 1 AND rec_age_current BETWEEN 25 AND 60)
SELECT count(*) AS n, {_cnt('rec_user_gender = 0')} AS n_women, {_share('rec_user_gender = 0')} AS pct_women,
       {_cnt('rec_user_gender = 1')} AS n_men, {_share('rec_user_gender = 1')} AS pct_men,
       {r('avg(rec_age_current)')} AS mean_age, {_cnt('postal_code IS NOT NULL')} AS n_postcode,
       {_share('postal_code IS NOT NULL')} AS pct_postcode, {_cnt('rec_heartrisk_cat = 2')} AS n_high_heartrisk,
       {_share('rec_heartrisk_cat = 2')} AS pct_high_heartrisk, {r('avg(rec_med_bmi)')} AS mean_bmi,
       {_cnt('rec_ls_stress_cat = 2')} AS n_high_stress, {_share('rec_ls_stress_cat = 2')} AS pct_high_stress,
       {_cnt('rec_ls_sleep_cat >= 1')} AS n_poor_sleep, {_share('rec_ls_sleep_cat >= 1')} AS pct_poor_sleep,
       {r('avg(rec_ls_lifestyle_score)')} AS mean_lifestyle,
       {r('CASE WHEN (SELECT count(*) FROM d_wide) > 0 THEN round(count(*) * 100.0 / (SELECT count(*) FROM d_wide), 1) ELSE 0 END')}
           AS pct_of_total
FROM c"""


@register("cohort_quick_stats", QUICK_SQL)
def q_cohort_quick_stats(spark, sf_dir):
    w = _w(spark, sf_dir)
    return cohort.cohort_quick_stats(cohort.cohort_subset(w, "man", (25, 60)), w)


@register("count_postcodes", W + """SELECT count(*) AS participants, count(postal_code) AS with_postcode,
    count(nullif(regexp_extract(postal_code, '(\\d{4})', 1), '')) AS with_pc4 FROM d_wide""")
def q_count_postcodes(spark, sf_dir):
    w = _w(spark, sf_dir)
    return w.agg(F.count(F.lit(1)).alias("participants"), F.count("postal_code").alias("with_postcode"),
                 F.count(rules.pc4("postal_code")).alias("with_pc4"))
