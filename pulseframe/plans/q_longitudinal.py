"""Registered longitudinal queries (windows, trends, migration)."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulseframe.operators import linking, longitudinal
from pulseframe.plans.bindings import Domain, views, with_views
from pulseframe.functions.semantics import cut_sql
from pulseframe.plans.catalog import r, register

LINKS_SQL = """SELECT p.id AS participant_id, p.store_id,
    coalesce(nullif(trim(s.name), ''), 'Store ' || CAST(s.id AS VARCHAR)) AS store_name
    FROM d_participants p JOIN d_stores s ON p.store_id = s.id"""


def direct_links(d: Domain):
    return linking.direct_store_links(d.participants, d.stores)


MONTH_TREND_SQL = with_views("history", "participants", "stores", extra=[("links", LINKS_SQL)]) + f"""
, pp AS (
  SELECT l.store_id, l.store_name, CAST(date_trunc('month', h.completion_created_at) AS TIMESTAMP) AS month,
         h.participant_id, avg(h.score_value) AS p_mean, count(h.score_value) AS p_n,
         min(h.completion_created_at) AS p_first
  FROM d_history h JOIN links l ON h.participant_id = l.participant_id
  WHERE h.slug = 'A' AND h.score_value IS NOT NULL AND h.completion_created_at IS NOT NULL
  GROUP BY ALL)
, sm AS (
  SELECT store_id, store_name, month, avg(p_mean) AS mean_score,
         count(DISTINCT participant_id) AS n_participants, CAST(sum(p_n) AS BIGINT) AS n_measurements,
         count(DISTINCT CAST(p_first AS DATE)) AS n_days
  FROM pp GROUP BY ALL)
, ov AS (SELECT month, avg(p_mean) AS overall_mean FROM pp GROUP BY month)
, k AS (SELECT * FROM sm WHERE n_participants >= 2)
SELECT k.month, k.store_id, k.store_name, {r('k.mean_score')} AS mean_score, k.n_participants, k.n_measurements,
       k.n_days, {r('ov.overall_mean')} AS overall_mean,
       {r('coalesce(k.mean_score - lag(k.mean_score) OVER (PARTITION BY k.store_id ORDER BY k.month), 0)')} AS mean_change
FROM k LEFT JOIN ov ON k.month = ov.month
"""


@register("month_trend_by_store", MONTH_TREND_SQL)
def q_month_trend_by_store(spark, sf_dir):
    d = Domain(spark, sf_dir)
    return longitudinal.month_trend_by_store(d.history, direct_links(d), slug="A", min_participants=2)


H = views("history")
DAYS = "floor((epoch_us({b}) - epoch_us({a})) / 86400000000.0)"


def _h(spark, sf_dir):
    return Domain(spark, sf_dir).history


CHANGE_SQL = H + f""", f AS (
  SELECT participant_id, slug,
         first(score_value ORDER BY completion_created_at, id, score_value) FILTER (WHERE score_value IS NOT NULL) AS fv,
         min(completion_created_at) AS fa
  FROM d_history GROUP BY ALL),
j AS (
  SELECT h.participant_id, h.slug, h.score_value - f.fv AS change,
         {DAYS.format(a='f.fa', b='h.completion_created_at')} AS days
  FROM d_history h JOIN f ON h.participant_id = f.participant_id AND h.slug = f.slug
  WHERE h.completion_created_at > f.fa),
p AS (
  SELECT participant_id, slug, CASE WHEN days > 0 AND days <= 180 THEN '0-6 mnd' WHEN days > 180 AND days <= 365 THEN '6-12 mnd'
         WHEN days > 365 AND days <= 730 THEN '1-2 jaar' WHEN days > 730 AND days <= 1095 THEN '2-3 jaar'
         WHEN days > 1095 AND days <= 99999 THEN '3+ jaar' END AS period, change FROM j),
pp AS (SELECT participant_id, slug, period, avg(change) AS cpp FROM p WHERE period IS NOT NULL GROUP BY ALL)
SELECT period, slug, {r('avg(cpp)')} AS mean, count(cpp) AS count, count(DISTINCT participant_id) AS n_participants
FROM pp GROUP BY ALL HAVING count(DISTINCT participant_id) >= 1"""


@register("change_vs_first", CHANGE_SQL)
def q_change_vs_first(spark, sf_dir):
    return longitudinal.change_vs_first(_h(spark, sf_dir))


PER_COMPLETION = """SELECT participant_id, completion_id, completion_created_at, avg(score_value) AS score
    FROM d_history WHERE slug = 'A' AND score_value IS NOT NULL AND completion_created_at IS NOT NULL GROUP BY ALL"""


@register("score_trajectory", H + f""", pc AS ({PER_COMPLETION}),
n AS (SELECT *, row_number() OVER (PARTITION BY participant_id ORDER BY completion_created_at, completion_id) AS fill_nr
      FROM pc)
SELECT fill_nr, {r('avg(score)')} AS mean_score, count(DISTINCT participant_id) AS n_participants,
       CAST(fill_nr AS VARCHAR) || 'e invulling' AS fill_label
FROM n WHERE fill_nr <= 10 GROUP BY fill_nr""")
def q_score_trajectory(spark, sf_dir):
    return longitudinal.score_trajectory(_h(spark, sf_dir).where(F.col("slug") == "A"))


@register("repeat_change_summary", H + f""", pc AS ({PER_COMPLETION}),
pp AS (SELECT participant_id, count(*) AS n_total,
              arg_min(score, (completion_created_at, completion_id)) AS first_score,
              arg_max(score, (completion_created_at, completion_id)) AS last_score FROM pc GROUP BY participant_id)
SELECT CASE WHEN n_total <= 5 THEN CAST(n_total AS VARCHAR) || 'x' ELSE '6+x' END AS frequency,
       least(n_total, 6) AS frequency_order, count(DISTINCT participant_id) AS n_participants,
       {r('avg(first_score)')} AS mean_first, {r('avg(last_score)')} AS mean_last,
       {r('avg(last_score - first_score)')} AS mean_change,
       {r('coalesce(stddev_samp(last_score - first_score), 0)')} AS std_change
FROM pp GROUP BY ALL""")
def q_repeat_change_summary(spark, sf_dir):
    return longitudinal.repeat_change_summary(_h(spark, sf_dir).where(F.col("slug") == "A"))


PM = """SELECT participant_id, CAST(date_trunc('month', completion_created_at) AS TIMESTAMP) AS month,
    avg(score_value) AS p_mean FROM d_history
    WHERE slug = '{slug}' AND score_value IS NOT NULL AND completion_created_at IS NOT NULL GROUP BY ALL"""


@register("rolling_month_mean", H + f""", pm AS ({PM.format(slug='N')}),
m AS (SELECT month, avg(p_mean) AS mean, stddev_samp(p_mean) AS std, count(DISTINCT participant_id) AS n_participants
      FROM pm GROUP BY month HAVING count(DISTINCT participant_id) >= 2),
w AS (SELECT *, avg(mean) OVER (ORDER BY month ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS rm,
             avg(std) OVER (ORDER BY month ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS rs FROM m)
SELECT month, {r('mean')} AS mean, {r('std')} AS std, n_participants, {r('rm')} AS rolling_mean, {r('rs')} AS rolling_std,
       {r('rm - rs')} AS band_low, {r('rm + rs')} AS band_high FROM w""")
def q_rolling_month_mean(spark, sf_dir):
    return longitudinal.rolling_month_mean(_h(spark, sf_dir), "N", window=3)


@register("month_and_year_weighted", H + f""", pm AS ({PM.format(slug='N')}),
m AS (SELECT month, avg(p_mean) AS month_mean, count(DISTINCT participant_id) AS n_participants FROM pm GROUP BY month),
y AS (SELECT year(month) AS year, sum(month_mean * n_participants) / sum(n_participants) AS ywm FROM m
      WHERE n_participants > 0 GROUP BY 1)
SELECT year(m.month) AS year, m.month, {r('m.month_mean')} AS month_mean, m.n_participants,
       {r('y.ywm')} AS year_weighted_mean
FROM m LEFT JOIN y ON y.year = year(m.month)""")
def q_month_and_year_weighted(spark, sf_dir):
    return longitudinal.month_and_year_weighted(_h(spark, sf_dir), "N")


@register("year_metric_pair", H + f""", pm AS (
  SELECT year(completion_created_at) AS year, slug, participant_id, avg(score_value) AS p_mean FROM d_history
  WHERE slug IN ('A', 'R') AND score_value IS NOT NULL AND completion_created_at IS NOT NULL GROUP BY ALL)
SELECT year, {r("avg(CASE WHEN slug = 'A' THEN p_mean END)")} AS mean_a,
       {r("avg(CASE WHEN slug = 'R' THEN p_mean END)")} AS mean_b, count(DISTINCT participant_id) AS n_participants
FROM pm GROUP BY year""")
def q_year_metric_pair(spark, sf_dir):
    return longitudinal.year_metric_pair(_h(spark, sf_dir), "A", "R")


@register("cumulative_daily", views("completions") + """, f AS (
  SELECT participant_id, min(created_at) AS first FROM d_completions
  WHERE participant_id IS NOT NULL AND created_at IS NOT NULL GROUP BY 1),
d AS (SELECT CAST(date_trunc('day', first) AS TIMESTAMP) AS day, count(*) AS new_participants FROM f WHERE year(first) >= 1995 GROUP BY 1)
SELECT day, new_participants, sum(new_participants) OVER (ORDER BY day ROWS UNBOUNDED PRECEDING)::BIGINT AS cumulative
FROM d""")
def q_cumulative_daily(spark, sf_dir):
    d = Domain(spark, sf_dir)
    return longitudinal.cumulative_new(d.completions, "participant_id", "created_at", "day", min_year=1995)


@register("cumulative_yearly", H + """, f AS (
  SELECT participant_id, min(completion_created_at) AS first FROM d_history
  WHERE participant_id IS NOT NULL AND completion_created_at IS NOT NULL GROUP BY 1),
d AS (SELECT year(first) AS year, count(*) AS new_participants FROM f GROUP BY 1)
SELECT year, new_participants, sum(new_participants) OVER (ORDER BY year ROWS UNBOUNDED PRECEDING)::BIGINT AS cumulative
FROM d""")
def q_cumulative_yearly(spark, sf_dir):
    return longitudinal.cumulative_new(_h(spark, sf_dir), "participant_id", "completion_created_at", "year")


def _with_category(h):
    return h.withColumn("category", F.floor(F.col("score_value") / 17).cast("int"))


MIG_PAIRS = """SELECT participant_id, count(*) AS n,
    first({v} ORDER BY completion_created_at, id, {v}) FILTER (WHERE {v} IS NOT NULL) AS v_from,
    last({v} ORDER BY completion_created_at, id, {v}) FILTER (WHERE {v} IS NOT NULL) AS v_to
    FROM d_history WHERE slug = '{slug}' GROUP BY participant_id"""

MIG_MATRIX_SQL = H + f""", pr AS ({MIG_PAIRS.format(v='CAST(floor(score_value / 17) AS DOUBLE)', slug='A')})
SELECT v_from AS from_code, v_to AS to_code, count(*) AS n FROM pr
WHERE n >= 2 AND v_from IS NOT NULL AND v_to IS NOT NULL GROUP BY ALL"""


@register("migration_matrix", MIG_MATRIX_SQL)
def q_migration_matrix(spark, sf_dir):
    return longitudinal.migration_matrix(_with_category(_h(spark, sf_dir)), "A", "category")


@register("migration_flows", H + f""", pr AS ({MIG_PAIRS.format(v='CAST(floor(score_value / 17) AS DOUBLE)', slug='A')}),
m AS (SELECT v_from AS from_code, v_to AS to_code, count(*) AS n FROM pr
      WHERE n >= 2 AND v_from IS NOT NULL AND v_to IS NOT NULL GROUP BY ALL),
t AS (SELECT to_code, sum(n) AS to_total FROM m GROUP BY 1)
SELECT m.from_code, m.to_code, m.n, CAST(sum(m.n) OVER (PARTITION BY m.from_code) AS BIGINT) AS from_total,
       {r('m.n * 100.0 / sum(m.n) OVER (PARTITION BY m.from_code)')} AS pct_of_source, CAST(t.to_total AS BIGINT) AS to_total,
       CASE WHEN m.to_code < m.from_code THEN 'verbeterd' WHEN m.to_code > m.from_code THEN 'verslechterd'
            ELSE 'gelijk' END AS direction
FROM m LEFT JOIN t ON t.to_code = m.to_code""")
def q_migration_flows(spark, sf_dir):
    m = longitudinal.migration_matrix(_with_category(_h(spark, sf_dir)), "A", "category")
    return longitudinal.migration_flows(m, higher_is_better=False)


def _quantile_bin_sql(x: str) -> str:
    return (f"CASE WHEN len(e) >= 2 AND {x} >= e[1] AND {x} <= e[len(e)] "
            f"THEN greatest(len(list_filter(e, lambda t: t < {x})) - 1, 0) END")


@register("migration_binned", H + f""", pr AS ({MIG_PAIRS.format(v='score_value', slug='N')}),
p AS (SELECT * FROM pr WHERE n >= 2 AND v_from IS NOT NULL AND v_to IS NOT NULL),
pooled AS (SELECT v_from AS x FROM p UNION ALL SELECT v_to FROM p),
meta AS (SELECT list_distinct(quantile_cont(x, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0])) AS e0 FROM pooled),
meta2 AS (SELECT list_sort(e0) AS e FROM meta)
SELECT {_quantile_bin_sql('v_from')} AS from_code, {_quantile_bin_sql('v_to')} AS to_code, count(*) AS n
FROM p, meta2 GROUP BY ALL""")
def q_migration_binned(spark, sf_dir):
    return longitudinal.migration_binned(_h(spark, sf_dir), "N")


@register("migration_binned_codes", H + f""", pr AS ({MIG_PAIRS.format(v='floor(score_value / 10)', slug='R')}),
p AS (SELECT * FROM pr WHERE n >= 2 AND v_from IS NOT NULL AND v_to IS NOT NULL),
u AS (SELECT x, dense_rank() OVER (ORDER BY x) - 1 AS code FROM (SELECT v_from AS x FROM p UNION SELECT v_to FROM p))
SELECT CAST(a.code AS INTEGER) AS from_code, CAST(b.code AS INTEGER) AS to_code, count(*) AS n
FROM p JOIN u a ON a.x = p.v_from JOIN u b ON b.x = p.v_to GROUP BY ALL""")
def q_migration_binned_codes(spark, sf_dir):
    h = _h(spark, sf_dir).withColumn("score_value", F.floor(F.col("score_value") / 10).cast("double"))
    return longitudinal.migration_binned(h, "R")


CONFIG_BINS = ([0, 10, 25, 40, 50], ["laag", "midden", "hoog", "zeer hoog"])


@register("migration_binned_config", H + f""", pr AS ({MIG_PAIRS.format(v='score_value', slug='A')}),
p AS (SELECT * FROM pr WHERE n >= 2 AND v_from IS NOT NULL AND v_to IS NOT NULL)
SELECT * FROM (SELECT {cut_sql('v_from', CONFIG_BINS[0], None, True, True)} AS from_code,
       {cut_sql('v_to', CONFIG_BINS[0], None, True, True)} AS to_code, count(*) AS n FROM p GROUP BY ALL)
WHERE from_code IS NOT NULL AND to_code IS NOT NULL""")
def q_migration_binned_config(spark, sf_dir):
    return longitudinal.migration_binned(_h(spark, sf_dir), "A", bins=CONFIG_BINS)


BMI_EDGES, BMI_LABELS = longitudinal.MIGRATION_BINS["bmi"]


@register("migration_binned_bmi", H + f""", pr AS ({MIG_PAIRS.format(v='score_value', slug='A')}),
p AS (SELECT * FROM pr WHERE n >= 2 AND v_from IS NOT NULL AND v_to IS NOT NULL)
SELECT * FROM (SELECT {cut_sql('v_from', BMI_EDGES, None, True, True)} AS from_code,
       {cut_sql('v_to', BMI_EDGES, None, True, True)} AS to_code, count(*) AS n,
       {cut_sql('v_from', BMI_EDGES, BMI_LABELS, True, True)} AS from_label,
       {cut_sql('v_to', BMI_EDGES, BMI_LABELS, True, True)} AS to_label FROM p GROUP BY ALL)
WHERE from_code IS NOT NULL AND to_code IS NOT NULL""")
def q_migration_binned_bmi(spark, sf_dir):
    """The configured bins of a slug are found by its name."""
    h = _h(spark, sf_dir).withColumn("slug", F.when(F.col("slug") == "A", "bmi").otherwise(F.col("slug")))
    return longitudinal.migration_labels(longitudinal.migration_binned(h, "bmi"), BMI_LABELS)


ENG_SQL = views("completions", "participants", "stores", extra=[("links", LINKS_SQL)]) + """
, c AS (SELECT l.store_id, l.store_name, c.participant_id, CAST(date_trunc('month', c.created_at) AS TIMESTAMP) AS month
        FROM d_completions c JOIN links l ON l.participant_id = c.participant_id
        WHERE c.participant_id IS NOT NULL AND c.created_at IS NOT NULL),
months AS (SELECT DISTINCT month FROM c),
g AS (SELECT s.store_id, s.store_name, m.month FROM (SELECT DISTINCT store_id, store_name FROM c) s, months m),
agg AS (
  SELECT g.store_id, g.store_name, g.month,
         (SELECT count(DISTINCT participant_id) FROM c WHERE c.store_id = g.store_id AND c.month <= g.month) AS n_participants,
         (SELECT count(*) FROM (SELECT participant_id FROM c WHERE c.store_id = g.store_id AND c.month <= g.month
                                GROUP BY participant_id HAVING count(*) >= 2)) AS n_repeat
  FROM g),
k AS (SELECT *, n_repeat * 100.0 / n_participants AS pct_repeat,
             round(60 + 0.4 * (n_repeat * 100.0 / n_participants), 1) AS engagement_score
      FROM agg WHERE n_participants >= 1),
b AS (SELECT month, sum(engagement_score * n_participants) / sum(n_participants) AS benchmark FROM k GROUP BY month)
SELECT k.month, k.store_id, k.store_name, CAST(k.n_participants AS BIGINT) AS n_participants,
       CAST(k.n_repeat AS BIGINT) AS n_repeat, round(k.pct_repeat, 6) AS pct_repeat,
       round(k.engagement_score, 6) AS engagement_score, round(b.benchmark, 6) AS benchmark
FROM k LEFT JOIN b ON b.month = k.month"""


@register("engagement_trend", ENG_SQL)
def q_engagement_trend(spark, sf_dir):
    d = Domain(spark, sf_dir)
    return longitudinal.engagement_trend(d.completions, direct_links(d))


HIGHER_IS_BETTER = {"A": True, "N": False, "R": False}


@register("score_change_sign", CHANGE_SQL.replace("FROM pp GROUP BY ALL", "FROM pp GROUP BY period, slug").replace("SELECT period, slug,", "SELECT period, slug, CASE WHEN (avg(cpp) > 0) = (slug = 'A') AND avg(cpp) <> 0 THEN 'beter' WHEN avg(cpp) = 0 THEN 'gelijk' ELSE 'slechter' END AS sign,"))
def q_score_change_sign(spark, sf_dir):
    ch = longitudinal.change_vs_first(_h(spark, sf_dir))
    better = F.create_map(*[x for k, v in HIGHER_IS_BETTER.items() for x in (F.lit(k), F.lit(v))])[F.col("slug")]
    sign = (F.when(F.col("mean") == 0, "gelijk")
             .when((F.col("mean") > 0) == better, "beter").otherwise("slechter"))
    return ch.withColumn("sign", sign)


LONG_HIST_SQL = views("history", "participants", "stores", "wide") + """,
u AS (SELECT participant_id, slug, score_value, completion_created_at, 'history' AS source FROM d_history
      UNION ALL
      SELECT participant_id, 'A', rec_med_bmi, latest_completion_at, 'latest' FROM d_wide WHERE rec_med_bmi IS NOT NULL)
SELECT u.*, CAST(CASE WHEN p.gender_raw = '1' THEN 1 WHEN p.gender_raw = '0' THEN 0 END AS INTEGER) AS gender,
       s.id AS store_id
FROM u LEFT JOIN d_participants p ON p.id = u.participant_id LEFT JOIN d_stores s ON s.id = p.store_id
WHERE u.completion_created_at IS NOT NULL AND year(u.completion_created_at) >= 1995"""


@register("longitudinal_history", LONG_HIST_SQL)
def q_longitudinal_history(spark, sf_dir):
    from pulseframe.plans.bindings import wide
    d = Domain(spark, sf_dir)
    return longitudinal.longitudinal_history(d.history, wide(d), d.participants, direct_links(d), bmi_slug="A",
                                             min_year=1995)
