"""Registered statistics queries: t-tests, correlations, OLS, insights."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulseframe.operators import describe, stats
from pulseframe.plans.bindings import Domain, views, wide
from pulseframe.plans.catalog import r, register
from pulseframe.plans.q_describe import DQ_COLS, LIMITS, MEASURES

W = views("wide")


def _w(spark, sf_dir):
    return wide(Domain(spark, sf_dir))


def _welch_sql(group_expr: str, first: str, second: str) -> str:
    long = " UNION ALL ".join(
        f"SELECT '{k}' AS measure, '{v}' AS \"column\", {group_expr} AS g, CAST({v} AS DOUBLE) AS value FROM d_wide "
        f"WHERE {v} IS NOT NULL" for k, v in MEASURES.items())
    d = "CASE WHEN sqrt((var_a + var_b) / 2) > 0 THEN (mean_a - mean_b) / sqrt((var_a + var_b) / 2) ELSE 0 END"
    return W + f""", long AS ({long}),
s AS (SELECT measure, "column",
        count(CASE WHEN g = '{first}' THEN value END) AS n_a, avg(CASE WHEN g = '{first}' THEN value END) AS mean_a,
        var_samp(CASE WHEN g = '{first}' THEN value END) AS var_a,
        count(CASE WHEN g = '{second}' THEN value END) AS n_b, avg(CASE WHEN g = '{second}' THEN value END) AS mean_b,
        var_samp(CASE WHEN g = '{second}' THEN value END) AS var_b
      FROM long WHERE g IS NOT NULL GROUP BY ALL)
SELECT measure, "column", {r('mean_a')} AS mean_a, {r('mean_b')} AS mean_b, {r('mean_a - mean_b')} AS diff, n_a, n_b,
       {r('(mean_a - mean_b) / sqrt(var_a / n_a + var_b / n_b)')} AS t_stat,
       {r('(var_a / n_a + var_b / n_b) * (var_a / n_a + var_b / n_b) / ((var_a / n_a) * (var_a / n_a) / (n_a - 1) + (var_b / n_b) * (var_b / n_b) / (n_b - 1))')} AS dof,
       {r(d)} AS cohens_d,
       CASE WHEN abs({d}) < 0.2 THEN 'Verwaarloosbaar' WHEN abs({d}) < 0.5 THEN 'Klein'
            WHEN abs({d}) < 0.8 THEN 'Matig' ELSE 'Groot' END AS effect
FROM s WHERE n_a >= 10 AND n_b >= 10"""


GENDER_GROUP = "CASE WHEN rec_user_gender = 1 THEN 'man' WHEN rec_user_gender = 0 THEN 'vrouw' END"


@register("ttest_gender", _welch_sql(GENDER_GROUP, "man", "vrouw"))
def q_ttest_gender(spark, sf_dir):
    return stats.ttest_gender(_w(spark, sf_dir), MEASURES, with_p=False)


#: Two-sided p by Simpson's rule over the angle: with t = sqrt(dof) tan(u) the
#: density of Student's t becomes a power of the cosine.
SIMPSON = 40_000


def _welch_p_sql(group_expr: str, first: str, second: str, tail: str = "") -> str:
    t = "(mean_a - mean_b) / sqrt(var_a / n_a + var_b / n_b)"
    dof = ("(var_a / n_a + var_b / n_b) * (var_a / n_a + var_b / n_b) / ((var_a / n_a) * (var_a / n_a) / (n_a - 1) "
           "+ (var_b / n_b) * (var_b / n_b) / (n_b - 1))")
    base = _welch_sql(group_expr, first, second)
    cut = base.rindex("SELECT measure")
    return base[:cut].rstrip() + "," + f"""
raw AS (SELECT measure, atan(abs({t}) / sqrt({dof})) AS u, {dof} AS k FROM s WHERE n_a >= 10 AND n_b >= 10),
step AS (SELECT measure, k, (pi() / 2 - u) / {SIMPSON} AS w, u + i * (pi() / 2 - u) / {SIMPSON} AS theta,
         CASE WHEN i IN (0, {SIMPSON}) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END AS c FROM raw, range(0, {SIMPSON} + 1) g(i)),
pv AS (SELECT measure, 2 * exp(lgamma((any_value(k) + 1) / 2) - lgamma(any_value(k) / 2)) / sqrt(pi()) * any_value(w) / 3
         * sum(c * pow(greatest(cos(theta), 0), k - 1)) AS p FROM step GROUP BY measure),
tests AS ({base[cut:]})
SELECT tests.*, {r("least(p, 1)")} AS p_value, p < 0.05 AS significant FROM tests JOIN pv USING (measure){tail}"""


@register("ttest_gender_p", _welch_p_sql(GENDER_GROUP, "man", "vrouw"))
def q_ttest_gender_p(spark, sf_dir):
    return stats.ttest_gender(_w(spark, sf_dir), MEASURES, with_p=True)


UNIT_GROUP = "CASE WHEN coalesce(nullif(trim(segment), ''), 'Onbekend') = 'BUILDING' THEN 'unit' ELSE 'rest' END"


@register("ttest_org_unit", _welch_sql(UNIT_GROUP, "unit", "rest"))
def q_ttest_org_unit(spark, sf_dir):
    return stats.ttest_org_unit(_w(spark, sf_dir), MEASURES, "segment", "BUILDING", with_p=False)


AGE_GROUP = "CASE WHEN rec_age_current >= 45 THEN 'unit' ELSE 'rest' END"


@register("ttest_filter", _welch_p_sql(AGE_GROUP, "unit", "rest", " WHERE p < 0.05 AND abs(cohens_d) > 0.05"))
def q_ttest_filter(spark, sf_dir):
    """The older half against the others: differences that are significant and not negligible."""
    w = _w(spark, sf_dir).withColumn("half", F.when(F.col("rec_age_current") >= 45, "senior").otherwise("junior"))
    return stats.ttest_filter(stats.ttest_org_unit(w, MEASURES, "half", "senior"), 0.05)


CORR_VARS = {"BMI": "rec_med_bmi", "Hartrisico": "rec_heartrisk", "Stress": "rec_ls_stress_sum",
             "Leeftijd": "rec_age_current", "Leefstijlscore": "rec_ls_lifestyle_score"}


def _corr_sql(min_n: int) -> str:
    cols = list(CORR_VARS.values())
    lab = {v: k for k, v in CORR_VARS.items()}
    parts = []
    for a in cols:
        for b in cols:
            parts.append(f"""SELECT '{a}' AS var_a, '{b}' AS var_b, {r(f'corr({a}, {b})')} AS r,
                count(CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN 1 END) AS n_pairs,
                '{lab[a]}' AS label_a, '{lab[b]}' AS label_b FROM d_wide
                HAVING count({a}) >= {min_n} AND count({b}) >= {min_n}""")
    return W + " UNION ALL ".join(parts)


@register("correlation_matrix", _corr_sql(200))
def q_correlation_matrix(spark, sf_dir):
    return stats.correlation_matrix(_w(spark, sf_dir), CORR_VARS, min_n=200)


@register("scatter_correlation", W + f"""SELECT rec_user_gender, count(*) AS n, {r('corr(rec_age_current, rec_med_bmi)')} AS r,
    {r('regr_slope(rec_med_bmi, rec_age_current)')} AS slope, {r('regr_intercept(rec_med_bmi, rec_age_current)')} AS intercept,
    {r('corr(rec_age_current, rec_med_bmi) * sqrt((count(*) - 2) / (1 - corr(rec_age_current, rec_med_bmi) * corr(rec_age_current, rec_med_bmi)))')} AS t_stat
    FROM d_wide WHERE rec_age_current IS NOT NULL AND rec_med_bmi IS NOT NULL AND rec_user_gender IS NOT NULL
    GROUP BY rec_user_gender""")
def q_scatter_correlation(spark, sf_dir):
    return stats.scatter_correlation(_w(spark, sf_dir), "rec_age_current", "rec_med_bmi", "rec_user_gender",
                                     with_p=False)


@register("insights")
def q_insights(spark, sf_dir):
    w = _w(spark, sf_dir)
    sex, age = F.col("rec_user_gender").cast("double"), F.col("rec_age_current").cast("double")
    people = w.agg(F.count(F.lit(1)).alias("n"), F.count_if(sex == 0).alias("n_women"), F.count(sex).alias("n_gender"),
                   F.avg(age).alias("mean_age"), F.min(age).alias("min_age"), F.max(age).alias("max_age"))
    return stats.insights(people, describe.data_quality(w, DQ_COLS), describe.outliers_iqr(w, MEASURES, LIMITS),
                          stats.ttest_gender(w, MEASURES))
