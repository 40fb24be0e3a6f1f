"""Registered behaviour queries: questionnaires, articles, purchases, funnels,
engagement and accounts."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulseframe.functions import rules
from pulseframe.functions.semantics import cut_sql
from pulseframe.operators import behaviour, linking
from pulseframe.plans.bindings import (BINDING_SCORE_COLUMNS, Domain, article_views, item_scores, products, purchases,
                                       questionnaires, titles, views, wide)
from pulseframe.plans.catalog import r, register

DAYS = "floor((epoch_us({b}) - epoch_us({a})) / 86400000000.0)"
STORE_NAMES_SQL = """SELECT id AS store_id, coalesce(nullif(trim(name), ''), 'Store ' || CAST(id AS VARCHAR)) AS store_name
    FROM d_stores"""


def _d(spark, sf_dir):
    return Domain(spark, sf_dir)


def _names(d):
    return linking.store_names(d.stores)


# --------------------------------------------------------------------------
# questionnaires
# --------------------------------------------------------------------------

@register("questionnaire_reach", views("completions", "questionnaires") + f""",
c AS (SELECT participant_id, questionnaire_id, created_at FROM d_completions WHERE created_at IS NOT NULL),
q AS (SELECT questionnaire_id, min(created_at) AS f, max(created_at) AS l, count(DISTINCT participant_id) AS n
      FROM c GROUP BY 1),
lt AS (SELECT participant_id, max(created_at) AS t FROM c WHERE participant_id IS NOT NULL GROUP BY 1),
e AS (SELECT q.questionnaire_id, count(*) AS n_eligible FROM q JOIN lt ON lt.t >= q.f GROUP BY 1)
SELECT q.questionnaire_id, q.f AS first_completion, q.l AS last_completion, q.n AS n_completed,
       coalesce(e.n_eligible, 0) AS n_eligible, {r('round(q.n * 100.0 / e.n_eligible, 1)')} AS pct,
       year(q.f) AS first_year, nm.name
FROM q LEFT JOIN e ON e.questionnaire_id = q.questionnaire_id
LEFT JOIN d_questionnaires nm ON nm.id = q.questionnaire_id""")
def q_questionnaire_reach(spark, sf_dir):
    d = _d(spark, sf_dir)
    return behaviour.questionnaire_reach(d.completions, questionnaires(d))


@register("questionnaire_count_dist", views("completions") + f""",
pp AS (SELECT participant_id, count(DISTINCT questionnaire_id) AS nq FROM d_completions
       WHERE participant_id IS NOT NULL AND questionnaire_id IS NOT NULL GROUP BY 1),
k AS (SELECT count(*) AS total, sum(CASE WHEN nq = 1 THEN 1 ELSE 0 END) AS kpi_one,
             sum(CASE WHEN nq >= 2 THEN 1 ELSE 0 END) AS kpi_two_plus, avg(nq) AS kpi_mean,
             sum(CASE WHEN nq = (SELECT max(nq) FROM pp) THEN 1 ELSE 0 END) AS kpi_all FROM pp)
SELECT nq AS n_questionnaires, count(*) AS n_participants, k.total, CAST(k.kpi_one AS BIGINT) AS kpi_one,
       CAST(k.kpi_two_plus AS BIGINT) AS kpi_two_plus, {r('k.kpi_mean')} AS kpi_mean, CAST(k.kpi_all AS BIGINT) AS kpi_all,
       {r('count(*) * 100.0 / k.total')} AS share
FROM pp, k GROUP BY nq, k.total, k.kpi_one, k.kpi_two_plus, k.kpi_mean, k.kpi_all""")
def q_questionnaire_count_dist(spark, sf_dir):
    return behaviour.questionnaire_count_dist(_d(spark, sf_dir).completions)


@register("questionnaire_overview", views("completions", "questionnaires") + """,
pq AS (SELECT questionnaire_id, participant_id, count(*) AS k FROM d_completions WHERE questionnaire_id IS NOT NULL
       GROUP BY ALL),
q AS (SELECT questionnaire_id, sum(k) AS completions, count(participant_id) AS participants,
             sum(CASE WHEN participant_id IS NOT NULL AND k > 1 THEN 1 ELSE 0 END) AS repeaters FROM pq GROUP BY 1)
SELECT d.id AS questionnaire_id, d.name, CAST(coalesce(q.completions, 0) AS BIGINT) AS completions,
       coalesce(q.participants, 0) AS participants, CAST(coalesce(q.repeaters, 0) AS BIGINT) AS repeaters
FROM d_questionnaires d LEFT JOIN q ON q.questionnaire_id = d.id""")
def q_questionnaire_overview(spark, sf_dir):
    d = _d(spark, sf_dir)
    return behaviour.questionnaire_overview(d.completions, questionnaires(d))


@register("questionnaire_repeats", views("completions") + f""",
c AS (SELECT participant_id, questionnaire_id, created_at FROM d_completions
      WHERE participant_id IS NOT NULL AND questionnaire_id IS NOT NULL),
cnt AS (SELECT participant_id, questionnaire_id, count(*) AS times_filled FROM c GROUP BY ALL HAVING count(*) > 1),
g AS (SELECT c.participant_id, c.questionnaire_id, c.created_at,
             {DAYS.format(a='lag(c.created_at) OVER (PARTITION BY c.participant_id, c.questionnaire_id ORDER BY c.created_at)', b='c.created_at')} AS gap
      FROM c SEMI JOIN cnt ON cnt.participant_id = c.participant_id AND cnt.questionnaire_id = c.questionnaire_id
      WHERE c.created_at IS NOT NULL),
per AS (SELECT participant_id, questionnaire_id, min(created_at) AS first_date, max(created_at) AS last_date,
               count(*) AS nd, avg(gap) AS mg, CAST(min(gap) AS BIGINT) AS min_gap_days, CAST(max(gap) AS BIGINT) AS max_gap_days
        FROM g GROUP BY ALL)
SELECT cnt.participant_id, cnt.questionnaire_id, cnt.times_filled, per.first_date, per.last_date,
       {r('round(per.mg, 1)')} AS mean_gap_days, per.min_gap_days, per.max_gap_days,
       CAST({DAYS.format(a='per.first_date', b='per.last_date')} AS BIGINT) AS span_days,
       substr(sha256(CAST(cnt.participant_id AS VARCHAR)), 1, 12) AS participant_id_hashed
FROM cnt JOIN per ON per.participant_id = cnt.participant_id AND per.questionnaire_id = cnt.questionnaire_id
WHERE per.nd > 1""")
def q_questionnaire_repeats(spark, sf_dir):
    return behaviour.questionnaire_repeats(_d(spark, sf_dir).completions)


DROPOFF_CTE = views("completions", "item_scores") + """,
a AS (SELECT completion_id, count(DISTINCT slug) AS answered FROM d_item_scores
      WHERE completion_id IS NOT NULL AND slug IS NOT NULL GROUP BY 1),
c AS (SELECT c.id AS completion_id, c.participant_id, c.questionnaire_id, coalesce(a.answered, 0) AS answered
      FROM d_completions c LEFT JOIN a ON a.completion_id = c.id),
ex AS (SELECT questionnaire_id, greatest(round_even(quantile_cont(answered, 0.95), 0), 1.0) AS expected_items
       FROM c GROUP BY 1),
d AS (SELECT c.*, coalesce(ex.expected_items, 1.0) AS expected_items,
             least(greatest(c.answered / coalesce(ex.expected_items, 1.0), 0.0), 1.0) AS completion_pct
      FROM c LEFT JOIN ex ON ex.questionnaire_id = c.questionnaire_id),
pq AS (SELECT questionnaire_id, count(completion_id) AS completions, count(DISTINCT participant_id) AS participants,
              max(expected_items) AS expected_items, round(avg(answered), 1) AS mean_answered,
              round(quantile_cont(completion_pct, 0.5) * 100, 1) AS median_completion_pct,
              round(avg(CASE WHEN completion_pct < 0.5 THEN 1.0 ELSE 0.0 END) * 100, 1) AS dropoff_half_pct,
              round(avg(CASE WHEN completion_pct >= 0.8 THEN 1.0 ELSE 0.0 END) * 100, 1) AS nearly_done_pct
       FROM d GROUP BY 1)
"""


@register("questionnaire_dropoff", DROPOFF_CTE + f"""SELECT questionnaire_id, completions, participants,
    {r('expected_items')} AS expected_items, {r('mean_answered')} AS mean_answered,
    {r('median_completion_pct')} AS median_completion_pct, {r('dropoff_half_pct')} AS dropoff_half_pct,
    {r('nearly_done_pct')} AS nearly_done_pct FROM pq""")
def q_questionnaire_dropoff(spark, sf_dir):
    d = _d(spark, sf_dir)
    return behaviour.questionnaire_dropoff(d.completions, item_scores(d))[0]


@register("questionnaire_dropoff_summary", DROPOFF_CTE + f"""SELECT count(*) AS total_completions,
    {r('round(quantile_cont(completion_pct, 0.5) * 100, 1)')} AS median_completion_pct,
    {r('round(avg(CASE WHEN completion_pct < 0.5 THEN 1.0 ELSE 0.0 END) * 100, 1)')} AS dropoff_half_pct,
    {r('round(avg(CASE WHEN completion_pct >= 0.8 THEN 1.0 ELSE 0.0 END) * 100, 1)')} AS nearly_done_pct,
    (SELECT {r('CASE WHEN count(*) >= 2 THEN round(corr(expected_items, dropoff_half_pct), 3) END')} FROM pq)
        AS corr_length_dropoff
    FROM d""")
def q_questionnaire_dropoff_summary(spark, sf_dir):
    d = _d(spark, sf_dir)
    return behaviour.questionnaire_dropoff(d.completions, item_scores(d))[1]


SCORES = {"BMI": "rec_med_bmi", "Hartrisico": "rec_heartrisk", "Stress": "rec_ls_stress_sum"}


@register("frequency_vs_scores", views("wide", "completions") + f""",
pp AS (SELECT participant_id, count(DISTINCT questionnaire_id) AS nq FROM d_completions
       WHERE participant_id IS NOT NULL AND questionnaire_id IS NOT NULL GROUP BY 1),
long AS ({" UNION ALL ".join(f"SELECT participant_id, '{c}' AS score, CAST({c} AS DOUBLE) AS value FROM d_wide WHERE {c} IS NOT NULL" for c in SCORES.values())}),
j AS (SELECT long.*, CASE WHEN nq <= 5 THEN CAST(nq AS VARCHAR) || 'x' ELSE '6+x' END AS frequency,
             least(nq, 6) AS frequency_order FROM long JOIN pp USING (participant_id)),
g AS (SELECT score, frequency, frequency_order, count(DISTINCT participant_id) AS n_participants, avg(value) AS mean,
             coalesce(stddev_samp(value), 0) AS std FROM j GROUP BY ALL)
SELECT g.score, g.frequency, g.frequency_order, g.n_participants, {r('g.mean')} AS mean, {r('g.std')} AS std,
       {r('g.mean - b.mean')} AS diff_vs_1x
FROM g LEFT JOIN (SELECT score, mean FROM g WHERE frequency_order = 1) b ON b.score = g.score""")
def q_frequency_vs_scores(spark, sf_dir):
    d = _d(spark, sf_dir)
    return behaviour.frequency_vs_scores(d.completions, wide(d), SCORES)


LS_EDGES = rules.SCORE_CATEGORIES["rec_ls_lifestyle_score"]


@register("scores_per_store", views("wide", "stores", extra=[("names", STORE_NAMES_SQL)]) + f""",
per AS (SELECT store_id, CAST(round(CAST(avg(rec_ls_lifestyle_score) AS DECIMAL(28,9)), 2) AS DOUBLE) AS m, count(rec_ls_lifestyle_score) AS n_with_score,
               count(DISTINCT participant_id) AS n_participants FROM d_wide WHERE store_id IS NOT NULL GROUP BY 1
        HAVING count(rec_ls_lifestyle_score) >= 5),
tot AS (SELECT sum(m * n_with_score) / sum(n_with_score) AS weighted_total FROM per WHERE n_with_score > 0)
SELECT per.store_id, per.n_with_score, per.n_participants, names.store_name, {r('tot.weighted_total')} AS weighted_total,
       {r('per.m')} AS mean_score, {cut_sql('per.m', LS_EDGES[0], LS_EDGES[1], True, True)} AS category
FROM per LEFT JOIN names ON names.store_id = per.store_id, tot""")
def q_scores_per_store(spark, sf_dir):
    d = _d(spark, sf_dir)
    return behaviour.scores_per_store(wide(d), _names(d), "rec_ls_lifestyle_score", min_n=5, category_edges=LS_EDGES)


IND_COLS = BINDING_SCORE_COLUMNS + ["rec_ls_lifestyle_score"]


@register("available_indicators", views("wide") + f""",
long AS ({" UNION ALL ".join(f"SELECT store_id, participant_id, '{c}' AS \"column\" FROM d_wide WHERE {c} IS NOT NULL" for c in IND_COLS)}),
ps AS (SELECT "column", store_id, count(DISTINCT participant_id) AS n FROM long GROUP BY ALL)
SELECT "column", CAST(sum(CASE WHEN store_id IS NOT NULL AND n >= 50 THEN 1 ELSE 0 END) AS BIGINT) AS n_stores,
       CAST(sum(n) AS BIGINT) AS n_participants
FROM ps GROUP BY 1 HAVING sum(CASE WHEN store_id IS NOT NULL AND n >= 50 THEN 1 ELSE 0 END) >= 1""")
def q_available_indicators(spark, sf_dir):
    out = behaviour.available_indicators(wide(_d(spark, sf_dir)), IND_COLS, min_per_store=50, min_stores=1)
    return out.drop("label")


@register("available_factors", views("history") + """SELECT DISTINCT trim(slug) AS slug FROM d_history
    WHERE slug IS NOT NULL AND trim(slug) <> ''""")
def q_available_factors(spark, sf_dir):
    return behaviour.available_factors(_d(spark, sf_dir).history).drop("label")


@register("available_stores", views("wide", "stores", extra=[("names", STORE_NAMES_SQL)]) + """
SELECT w.store_id, count(*) AS n_rows, names.store_name FROM d_wide w JOIN names ON names.store_id = w.store_id
WHERE w.store_id IS NOT NULL AND w.rec_ls_lifestyle_score IS NOT NULL GROUP BY ALL""")
def q_available_stores(spark, sf_dir):
    d = _d(spark, sf_dir)
    return behaviour.available_stores(wide(d).where(F.col("rec_ls_lifestyle_score").isNotNull()), _names(d))


# --------------------------------------------------------------------------
# articles and purchases
# --------------------------------------------------------------------------

ARTICLE_CTE = views("article_views", "titles") + """,
t AS (SELECT content_id, min(title) AS title FROM d_titles GROUP BY 1),
j AS (SELECT v.*, coalesce(t.title, 'Onbekend artikel') AS title FROM d_article_views v
      LEFT JOIN t ON t.content_id = v.interactable_id)
"""


@register("article_overview", ARTICLE_CTE + """SELECT interactable_id, title, count(*) AS views,
    count(DISTINCT user_id) AS unique_readers, max(created_at) AS last_view FROM j GROUP BY ALL
    ORDER BY unique_readers DESC, views DESC, interactable_id LIMIT 20""")
def q_article_overview(spark, sf_dir):
    d = _d(spark, sf_dir)
    return behaviour.article_overview(article_views(d), titles(d))[0]


@register("article_summary", ARTICLE_CTE + f"""SELECT count(DISTINCT interactable_id) AS articles,
    count(*) AS total_views, count(DISTINCT user_id) AS unique_readers,
    {r('count(*) / count(DISTINCT interactable_id)')} AS views_per_article FROM j""")
def q_article_summary(spark, sf_dir):
    d = _d(spark, sf_dir)
    return behaviour.article_overview(article_views(d), titles(d))[1]


SUCCESS_SQL = ", ".join(f"'{s}'" for s in rules.SUCCESS_STATUSES)
BUY_IND = {"BMI": "rec_med_bmi", "Hartrisico": "rec_heartrisk", "Stress": "rec_ls_stress_sum",
           "Leefstijl": "rec_ls_lifestyle_score"}


@register("buyers_comparison", views("wide", "purchases") + f""",
ok AS (SELECT * FROM d_purchases WHERE lower(trim(status)) IN ({SUCCESS_SQL})),
f AS (SELECT w.*, (w.participant_id IN (SELECT participant_id FROM ok WHERE participant_id IS NOT NULL)
                   OR w.user_id IN (SELECT user_id FROM ok WHERE user_id IS NOT NULL)) AS is_buyer FROM d_wide w),
long AS ({" UNION ALL ".join(f"SELECT CASE WHEN is_buyer THEN 'kopers' ELSE 'niet-kopers' END AS \"group\", '{c}' AS \"column\", '{k}' AS indicator, CAST({c} AS DOUBLE) AS value FROM f WHERE {c} IS NOT NULL" for k, c in BUY_IND.items())}),
g AS (SELECT "column", indicator, "group", avg(value) AS mean, count(value) AS n FROM long GROUP BY ALL),
s AS (SELECT *, (mean - min(mean) OVER (PARTITION BY "column")) /
                CASE WHEN max(mean) OVER (PARTITION BY "column") - min(mean) OVER (PARTITION BY "column") = 0 THEN 1.0
                     ELSE max(mean) OVER (PARTITION BY "column") - min(mean) OVER (PARTITION BY "column") END * 100 AS sc
      FROM g)
SELECT "column", indicator, "group", {r('mean')} AS mean, n,
       {r("CASE WHEN \"column\" IN ('rec_med_bmi', 'rec_heartrisk', 'rec_ls_stress_sum') THEN 100 - sc ELSE sc END")} AS scaled
FROM s""")
def q_buyers_comparison(spark, sf_dir):
    d = _d(spark, sf_dir)
    ok = behaviour.successful_purchases(purchases(d))
    return behaviour.buyers_comparison(wide(d), ok, BUY_IND, lower_is_better=BINDING_SCORE_COLUMNS)


@register("top_products", views("purchases", "products") + f"""SELECT trim(p.name) AS product, count(*) AS n_purchases
    FROM d_purchases o JOIN d_products p ON p.id = o.product_id WHERE lower(trim(o.status)) IN ({SUCCESS_SQL})
    GROUP BY 1 ORDER BY n_purchases DESC, product LIMIT 10""")
def q_top_products(spark, sf_dir):
    d = _d(spark, sf_dir)
    return behaviour.top_products(behaviour.successful_purchases(purchases(d)), products(d))


@register("is_buyer_either_key", views("wide", "purchases") + f""",
ok AS (SELECT * FROM d_purchases WHERE lower(trim(status)) IN ({SUCCESS_SQL}))
SELECT w.participant_id, (w.participant_id IN (SELECT participant_id FROM ok WHERE participant_id IS NOT NULL)
       OR w.user_id IN (SELECT user_id FROM ok WHERE user_id IS NOT NULL)) AS is_buyer FROM d_wide w""")
def q_is_buyer_either_key(spark, sf_dir):
    d = _d(spark, sf_dir)
    f = behaviour.buyer_flags(wide(d), behaviour.successful_purchases(purchases(d)))
    return f.select("participant_id", "is_buyer")


EARLY_IND = {"bmi": "rec_med_bmi", "stress": "rec_ls_stress_sum"}


@register("early_buyer_profile", views("wide", "purchases", "completions") + f""",
fp AS (SELECT participant_id, min(created_at) AS fpur FROM d_purchases
       WHERE participant_id IS NOT NULL AND lower(trim(status)) IN ({SUCCESS_SQL}) GROUP BY 1),
acc AS (SELECT participant_id, min(created_at) AS account_at FROM d_completions GROUP BY 1),
j AS (SELECT w.*, {DAYS.format(a='acc.account_at', b='fp.fpur')} AS days_to_purchase,
             {cut_sql('w.rec_ls_lifestyle_score / 5', [0.5, 3.5, 5.5, 7.5, 10.5], [1, 2, 3, 4])} AS ls_cat
      FROM d_wide w LEFT JOIN fp ON fp.participant_id = w.participant_id
      LEFT JOIN acc ON acc.participant_id = w.participant_id),
g AS (SELECT *, CASE WHEN days_to_purchase IS NULL THEN '{rules.BUYER_GROUPS[3]}'
                     WHEN days_to_purchase <= 90 THEN '{rules.BUYER_GROUPS[0]}'
                     WHEN days_to_purchase <= 365 THEN '{rules.BUYER_GROUPS[1]}'
                     ELSE '{rules.BUYER_GROUPS[2]}' END AS buyer_group FROM j),
m AS (SELECT buyer_group, ls_cat, count(*) AS c FROM g WHERE ls_cat IS NOT NULL GROUP BY ALL),
mm AS (SELECT buyer_group, arg_max(ls_cat, (c, -ls_cat)) AS modal_lifestyle_cat FROM m GROUP BY 1)
SELECT g.buyer_group, count(*) AS n_participants, {r('avg(days_to_purchase)')} AS mean_days,
       any_value(mm.modal_lifestyle_cat) AS modal_lifestyle_cat,
       {r('avg(rec_med_bmi)')} AS mean_bmi, {r('avg(rec_ls_stress_sum)')} AS mean_stress
FROM g LEFT JOIN mm ON mm.buyer_group = g.buyer_group GROUP BY g.buyer_group""")
def q_early_buyer_profile(spark, sf_dir):
    d = _d(spark, sf_dir)
    account = d.completions.groupBy("participant_id").agg(F.min("created_at").alias("account_at"))
    w = (wide(d).withColumn("ls_scaled", F.col("rec_ls_lifestyle_score") / 5)
         .join(account, "participant_id", "left"))
    return behaviour.early_buyer_profile(w, behaviour.successful_purchases(purchases(d)), "account_at", EARLY_IND,
                                         lifestyle="ls_scaled")


# --------------------------------------------------------------------------
# funnels, engagement, coverage
# --------------------------------------------------------------------------

@register("engagement_funnel", views("participants", "completions", "purchases") + """,
reg AS (SELECT DISTINCT id AS participant_id FROM d_participants WHERE id IS NOT NULL),
comp AS (SELECT participant_id, count(DISTINCT id) AS nc FROM d_completions WHERE participant_id IS NOT NULL GROUP BY 1),
buy AS (SELECT DISTINCT participant_id FROM d_purchases WHERE participant_id IS NOT NULL),
f AS (SELECT reg.participant_id, comp.nc, buy.participant_id AS b FROM reg LEFT JOIN comp USING (participant_id)
      LEFT JOIN buy ON buy.participant_id = reg.participant_id)
SELECT 1 AS step, 'registered' AS stage, count(*) AS n FROM f
UNION ALL SELECT 2, 'completed', count(CASE WHEN nc >= 1 THEN 1 END) FROM f
UNION ALL SELECT 3, 'bought', count(b) FROM f
UNION ALL SELECT 4, 'repeat', count(CASE WHEN nc >= 2 THEN 1 END) FROM f""")
def q_engagement_funnel(spark, sf_dir):
    d = _d(spark, sf_dir)
    return behaviour.engagement_funnel(d.participants, d.completions, purchases(d))


@register("dataflow_funnel", views("wide", "completions") + f""",
st AS (SELECT DISTINCT participant_id FROM d_completions WHERE participant_id IS NOT NULL),
f AS (SELECT w.*, st.participant_id IS NOT NULL AS started,
             rec_ls_lifestyle_score IS NOT NULL AS has_scores
      FROM d_wide w LEFT JOIN st ON st.participant_id = w.participant_id),
a AS (SELECT count(*) AS s0,
             sum(CASE WHEN rec_age_current IS NOT NULL THEN 1 ELSE 0 END) AS s1,
             sum(CASE WHEN rec_age_current IS NOT NULL AND rec_user_gender IS NOT NULL THEN 1 ELSE 0 END) AS s2,
             sum(CASE WHEN rec_age_current IS NOT NULL AND rec_user_gender IS NOT NULL AND started THEN 1 ELSE 0 END) AS s3,
             sum(CASE WHEN rec_age_current IS NOT NULL AND rec_user_gender IS NOT NULL AND started AND has_scores
                 THEN 1 ELSE 0 END) AS s4,
             count(postal_code) AS with_postcode FROM f),
l AS (SELECT 1 AS step, 'Geregistreerd' AS stage, s0 AS n, with_postcode FROM a
      UNION ALL SELECT 2, 'Leeftijd bekend', s1, with_postcode FROM a
      UNION ALL SELECT 3, 'Geslacht bekend', s2, with_postcode FROM a
      UNION ALL SELECT 4, 'Vragenlijst gestart', s3, with_postcode FROM a
      UNION ALL SELECT 5, 'Scores beschikbaar', s4, with_postcode FROM a)
SELECT step, stage, CAST(n AS BIGINT) AS n, with_postcode,
       {r('n * 100.0 / first(n) OVER (ORDER BY step)')} AS pct_of_start,
       CAST(coalesce(lag(n) OVER (ORDER BY step) - n, 0) AS BIGINT) AS drop_since_previous,
       coalesce(round((lag(n) OVER (ORDER BY step) - n) * 100.0 / greatest(lag(n) OVER (ORDER BY step), 1), 1), 0.0)::DOUBLE
       AS pct_dropped FROM l""")
def q_dataflow_funnel(spark, sf_dir):
    d = _d(spark, sf_dir)
    return behaviour.dataflow_funnel(wide(d), d.completions)


ENG_BODY = """,
comp AS (SELECT participant_id, count(DISTINCT id) AS nc, count(DISTINCT questionnaire_id) AS nq FROM d_completions
         WHERE participant_id IS NOT NULL GROUP BY 1),
art AS (SELECT DISTINCT user_id FROM d_article_views WHERE user_id IS NOT NULL),
buy AS (SELECT DISTINCT participant_id FROM d_purchases WHERE participant_id IS NOT NULL),
size AS (SELECT store_id, count(DISTINCT id) AS n FROM d_participants GROUP BY 1),
ch AS (SELECT p.store_id, count(DISTINCT p.id) AS n FROM d_participants p JOIN d_completions c ON c.participant_id = p.id
       WHERE c.total > 300000 AND c.status IN ('F', 'O') GROUP BY 1),
s AS (SELECT p.id AS participant_id, p.store_id,
             CAST(CASE WHEN w.rec_ls_lifestyle_score IS NOT NULL THEN 100 WHEN comp.nc > 0 THEN 50 ELSE 0 END AS DOUBLE)
               AS c_completion,
             CAST(CASE WHEN comp.nc >= 2 THEN 100 ELSE 0 END AS DOUBLE) AS c_repeat,
             CAST(round(least(coalesce(comp.nq, 0), 5) * 100.0 / 5, 1) AS DOUBLE) AS c_breadth,
             CAST(CASE WHEN art.user_id IS NOT NULL THEN 100 ELSE 0 END AS DOUBLE) AS c_articles,
             CAST(CASE WHEN buy.participant_id IS NOT NULL THEN 100 ELSE 0 END AS DOUBLE) AS c_purchase,
             coalesce(least(CAST(ch.n AS DOUBLE) / size.n * 100, 100), 0) AS c_challenge
      FROM d_participants p LEFT JOIN comp ON comp.participant_id = p.id LEFT JOIN art ON art.user_id = p.user_id
      LEFT JOIN buy ON buy.participant_id = p.id LEFT JOIN d_wide w ON w.participant_id = p.id
      LEFT JOIN ch ON ch.store_id = p.store_id LEFT JOIN size ON size.store_id = p.store_id),
e AS (SELECT *, CAST(round(CAST((0.30 * c_completion + 0.20 * c_repeat + 0.15 * c_breadth + 0.15 * c_articles
                + 0.10 * c_challenge + 0.10 * c_purchase) / CAST(1.0 AS DOUBLE) AS DECIMAL(28,9)), 1) AS DOUBLE)
                AS engagement_score FROM s)
"""


ENG_VIEWS = ("wide", "participants", "completions", "article_views", "purchases")


def challenges(d):
    """Stand-in challenge log: large completions; open ones are still running."""
    who = d.participants.select(F.col("id").alias("user_ref"), "store_id")
    done = d.completions.where(F.col("total") > 300000).select(F.col("participant_id").alias("user_ref"), F.when(
        F.col("status") == "F", "Completed").when(F.col("status") == "O", "in_progress").otherwise("stopped").alias("status"))
    return done.join(who, "user_ref")


def _engagement(d):
    scores = wide(d).select("participant_id", F.col("rec_ls_lifestyle_score").alias("lifestyle_score"))
    return behaviour.engagement_scores(d.participants, scores, d.completions, article_views(d), purchases(d),
                                       challenges(d), n_questionnaires=5)


@register("engagement_scores", views(*ENG_VIEWS) + ENG_BODY + "SELECT * FROM e")
def q_engagement_scores(spark, sf_dir):
    return _engagement(_d(spark, sf_dir))


ROUNDED = "CAST(round(CAST(avg({}) AS DECIMAL(28,9)), 1) AS DOUBLE)"


@register("engagement_by_store", views(*ENG_VIEWS, "stores", extra=[("names", STORE_NAMES_SQL)]) + ENG_BODY + f""",
per AS (SELECT store_id, count(*) AS n_participants, {ROUNDED.format('engagement_score')} AS me,
               {ROUNDED.format('c_completion')} AS a1, {ROUNDED.format('c_repeat')} AS a2,
               {ROUNDED.format('c_breadth')} AS a3, {ROUNDED.format('c_articles')} AS a4,
               {ROUNDED.format('c_purchase')} AS a5, {ROUNDED.format('c_challenge')} AS a6
        FROM e WHERE store_id IS NOT NULL GROUP BY 1),
b AS (SELECT sum(me * n_participants) / sum(n_participants) AS benchmark FROM per)
SELECT per.store_id, per.n_participants, {r('me')} AS mean_engagement, {r('a1')} AS mean_completion,
       {r('a2')} AS mean_repeat, {r('a3')} AS mean_breadth, {r('a4')} AS mean_articles, {r('a5')} AS mean_purchase,
       {r('a6')} AS mean_challenge, names.store_name, {r('b.benchmark')} AS benchmark, {r('me - b.benchmark')} AS vs_benchmark
FROM per LEFT JOIN names ON names.store_id = per.store_id, b""")
def q_engagement_by_store(spark, sf_dir):
    d = _d(spark, sf_dir)
    return behaviour.engagement_by_store(_engagement(d), _names(d))


COVERAGE_NOTE = "Geen betrouwbare user-level koppeling; metric op store-niveau"


@register("link_coverage", views("wide", "interactions", "participants", "stores", "app_users", "store_employees") + f""",
links AS (SELECT DISTINCT p.id AS k FROM d_participants p JOIN d_stores s ON s.id = p.store_id WHERE p.segment <> 'BUILDING'),
bridge AS (SELECT DISTINCT user_id AS k FROM d_app_users WHERE user_id % 10 <> 3),
scores AS (SELECT DISTINCT participant_id AS k FROM d_wide WHERE participant_id IS NOT NULL),
seen AS (SELECT DISTINCT user_id AS k FROM d_interactions WHERE user_id IS NOT NULL),
stores AS (SELECT DISTINCT store_id AS k FROM d_store_employees WHERE deleted_at IS NULL AND store_id IS NOT NULL),
per AS (SELECT 'Opdrachtgever-koppeling' AS source, (SELECT count(*) FROM links) AS available, (SELECT count(*) FROM links) AS linkable, '' AS note
 UNION ALL SELECT 'Participant-gebruiker', (SELECT count(*) FROM bridge), (SELECT count(*) FROM bridge), ''
 UNION ALL SELECT 'Vragenlijstscores', (SELECT count(*) FROM scores), (SELECT count(*) FROM scores JOIN links USING (k)), ''
 UNION ALL SELECT 'Artikelviews', (SELECT count(*) FROM seen), (SELECT count(*) FROM seen JOIN bridge USING (k)), ''
 UNION ALL SELECT 'Challenges', (SELECT count(*) FROM stores), (SELECT count(*) FROM stores), '{COVERAGE_NOTE}')
SELECT source, available, linkable, note, {r("round(linkable * 100.0 / nullif(available, 0), 1)")} AS pct FROM per""")
def q_link_coverage(spark, sf_dir):
    """Five sources; the bridge lacks every tenth user, one segment has no store."""
    d = _d(spark, sf_dir)
    links = linking.direct_store_links(d.participants.where(F.col("segment") != "BUILDING"), d.stores)
    bridge = d.app_users.where(F.col("user_id") % 10 != 3)
    stores = d.store_employees.where(F.col("deleted_at").isNull())
    return behaviour.link_coverage([
        ("Opdrachtgever-koppeling", links, "participant_id", None, None),
        ("Participant-gebruiker", bridge, "user_id", None, None),
        ("Vragenlijstscores", wide(d), "participant_id", links, "participant_id"),
        ("Artikelviews", d.interactions, "user_id", bridge, "user_id"),
        ("Challenges", stores, "store_id", None, None)], {"Challenges": COVERAGE_NOTE})


@register("age_vs_score", views("wide") + f"""SELECT
    {cut_sql('rec_age_current', rules.AGE_SCORE_EDGES, rules.AGE_SCORE_LABELS)} AS age_group,
    {r('avg(rec_ls_lifestyle_score)')} AS mean_score, count(rec_age_current) AS n, {r('stddev_samp(rec_ls_lifestyle_score)')} AS std
    FROM d_wide WHERE rec_ls_lifestyle_score IS NOT NULL
      AND {cut_sql('rec_age_current', rules.AGE_SCORE_EDGES, rules.AGE_SCORE_LABELS)} IS NOT NULL GROUP BY 1""")
def q_age_vs_score(spark, sf_dir):
    return behaviour.age_vs_score(wide(_d(spark, sf_dir)), "rec_ls_lifestyle_score")


@register("wai_productivity", views("wide") + f"""SELECT count(*) AS n,
    {r('avg(least(greatest(70 + 3 * rec_ls_stress_sum, 0), 100))')} AS mean_estimate,
    {r('regr_slope(least(greatest(70 + 3 * rec_ls_stress_sum, 0), 100), rec_ls_stress_sum)')} AS slope,
    {r('regr_intercept(least(greatest(70 + 3 * rec_ls_stress_sum, 0), 100), rec_ls_stress_sum)')} AS intercept,
    {r('regr_r2(least(greatest(70 + 3 * rec_ls_stress_sum, 0), 100), rec_ls_stress_sum)')} AS r2
    FROM d_wide WHERE rec_ls_stress_sum IS NOT NULL""")
def q_wai_productivity(spark, sf_dir):
    return behaviour.wai_productivity(wide(_d(spark, sf_dir)), "rec_ls_stress_sum")


# Accounts: every customer, registered on a day between 2016 and 2031 that
# follows from its key; two onboarding fields are filled for some of them, and
# every fourth has completed nothing.
CONSENTS = ["completed_onboarding_at", "phone_number"]


def _accounts(d):
    key = F.col("id")
    acc = d.participants.select(
        "id", F.date_add(F.lit("2016-01-01").cast("date"), (key * 37 % 5500).cast("int")).alias("created_at"),
        F.when(key % 3 == 0, F.lit("2020-01-01")).alias("completed_onboarding_at"),
        F.when(F.col("balance") > 0, F.col("postal_code")).alias("phone_number"))
    scores = wide(d).select("participant_id", F.when(F.col("participant_id") % 4 != 1, F.col("latest_completion_at"))
                            .alias("latest_completion_at"))
    return acc, behaviour.completed_ids(scores)


ACC_CTE = views("participants", "wide") + """,
acc AS (SELECT id, DATE '2016-01-01' + CAST(id * 37 % 5500 AS INTEGER) AS created_at,
        CASE WHEN id % 3 = 0 THEN '2020-01-01' END AS completed_onboarding_at,
        CASE WHEN balance > 0 THEN postal_code END AS phone_number FROM d_participants),
act AS (SELECT DISTINCT participant_id AS id FROM d_wide WHERE latest_completion_at IS NOT NULL AND participant_id % 4 <> 1),
per AS (SELECT year(created_at) AS year, count(*) AS accounts,
               CAST(sum(CASE WHEN id IN (SELECT id FROM act) THEN 1 ELSE 0 END) AS BIGINT) AS active
        FROM acc WHERE year(created_at) BETWEEN 2018 AND 2030 GROUP BY 1)
"""


@register("account_activation", ACC_CTE + f"""
SELECT year, accounts, active, accounts - active AS inactive, {r('round(active * 100.0 / accounts, 1)')} AS pct_active,
       CAST(sum(accounts) OVER (ORDER BY year ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cumulative_accounts FROM per""")
def q_account_activation(spark, sf_dir):
    acc, active = _accounts(_d(spark, sf_dir))
    return behaviour.activation_by_year(acc, active)


@register("platform_growth", ACC_CTE + "SELECT year, accounts, active FROM per")
def q_platform_growth(spark, sf_dir):
    acc, active = _accounts(_d(spark, sf_dir))
    return behaviour.activation_by_year(acc, active).select("year", "accounts", "active")


@register("inactive_accounts", ACC_CTE + f"""SELECT count(*) AS n_inactive,
    mode() WITHIN GROUP (ORDER BY year(created_at)) AS modal_year, {r('avg(year(created_at))')} AS mean_year,
    {r('round((SELECT count(*) FROM acc WHERE id IN (SELECT id FROM act)) * 100.0 / (SELECT count(*) FROM acc), 1)')} AS pct_active,
    {", ".join(f"{r(f'round(avg(CASE WHEN {c} IS NOT NULL THEN 1.0 ELSE 0.0 END) * 100, 1)')} AS pct_{c}, count({c}) AS n_{c}" for c in CONSENTS)}
    FROM acc WHERE id NOT IN (SELECT id FROM act)""")
def q_inactive_accounts(spark, sf_dir):
    acc, active = _accounts(_d(spark, sf_dir))
    return behaviour.inactive_accounts(acc, active, CONSENTS)


@register("inactive_accounts_by_year", ACC_CTE + """SELECT year(created_at) AS year,
    CAST(sum(CASE WHEN id IN (SELECT id FROM act) THEN 1 ELSE 0 END) AS BIGINT) AS active,
    CAST(sum(CASE WHEN id IN (SELECT id FROM act) THEN 0 ELSE 1 END) AS BIGINT) AS inactive FROM acc GROUP BY 1""")
def q_inactive_accounts_by_year(spark, sf_dir):
    acc, active = _accounts(_d(spark, sf_dir))
    return behaviour.inactive_by_year(acc, active)


DIET_COLS = ["d_bmi", "d_heartrisk", "d_stress"]


def _diet_wide(d):
    return wide(d).select("*", *[(F.col(c) / 10).alias(n) for c, n in zip(BINDING_SCORE_COLUMNS, DIET_COLS)])


DIET_SCORE_SQL = ("CASE WHEN (rec_med_bmi IS NOT NULL)::INT + (rec_heartrisk IS NOT NULL)::INT + "
                  "(rec_ls_stress_sum IS NOT NULL)::INT > 0 THEN (coalesce(rec_med_bmi / 10, 0) + "
                  "coalesce(rec_heartrisk / 10, 0) + coalesce(rec_ls_stress_sum / 10, 0)) / ((rec_med_bmi IS NOT NULL)::INT"
                  " + (rec_heartrisk IS NOT NULL)::INT + (rec_ls_stress_sum IS NOT NULL)::INT) END")
DIET_CAT_SQL = cut_sql(DIET_SCORE_SQL, rules.DIET_EDGES, rules.DIET_LABELS, True, True)


@register("diet_distribution", views("wide") + f""",
x AS (SELECT {DIET_CAT_SQL} AS diet_cat FROM d_wide),
per AS (SELECT diet_cat, count(*) AS n FROM x WHERE diet_cat IS NOT NULL GROUP BY 1)
SELECT diet_cat, n, {r('n * 100.0 / sum(n) OVER ()')} AS pct,
       CAST(list_position({list(rules.DIET_LABELS)}, diet_cat) AS INTEGER) AS "order" FROM per""")
def q_diet_distribution(spark, sf_dir):
    return behaviour.diet_distribution(_diet_wide(_d(spark, sf_dir)), DIET_COLS)


BMI_LAB_SQL = "CASE " + " ".join(f"WHEN bmi_code = {k} THEN '{v}'" for k, v in rules.BMI_LABELS.items()) + " END"


@register("diet_by_bmi", views("wide") + f""",
x AS (SELECT {DIET_CAT_SQL} AS diet_cat, CAST(rec_med_bmi_cat AS DOUBLE) AS bmi_code FROM d_wide),
per AS (SELECT diet_cat, bmi_code, count(*) AS n FROM x WHERE diet_cat IS NOT NULL AND bmi_code IS NOT NULL GROUP BY ALL)
SELECT diet_cat, bmi_code, n, CAST(sum(n) OVER (PARTITION BY diet_cat) AS BIGINT) AS n_in_diet_cat,
       {r('n * 100.0 / sum(n) OVER (PARTITION BY diet_cat)')} AS pct, {BMI_LAB_SQL} AS bmi_label FROM per""")
def q_diet_by_bmi(spark, sf_dir):
    return behaviour.diet_by_bmi(_diet_wide(_d(spark, sf_dir)), DIET_COLS)


@register("scores_for_questionnaire", views("completions", "item_scores") + """
SELECT s.slug, count(*) AS n FROM d_completions c JOIN d_item_scores s ON s.completion_id = c.id
WHERE c.questionnaire_id = '2-HIGH' AND s.slug LIKE 'rec\\_%' ESCAPE '\\' AND s.slug NOT LIKE '%\\_cat' ESCAPE '\\'
  AND s.slug NOT LIKE 'answers\\_%' ESCAPE '\\'
GROUP BY 1""")
def q_scores_for_questionnaire(spark, sf_dir):
    d = _d(spark, sf_dir)
    return behaviour.scores_for_questionnaire(d.completions, item_scores(d), "2-HIGH")
