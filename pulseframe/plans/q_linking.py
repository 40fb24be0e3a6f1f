"""Registered identity-linking and join queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulseframe.operators import behaviour, linking
from pulseframe.plans.bindings import (BINDING_SCORE_COLUMNS, BINDING_SLUG_COLUMNS, Domain, accounts, addresses,
                                       article_views, products,
                                       purchases, views)
from pulseframe.plans.catalog import r, register
from pulseframe.plans.consolidate import latest_scores_wide, store_month_averages
from pulseframe.plans.bindings import wide

STORE_NAMES_SQL = """SELECT id AS store_id, coalesce(nullif(trim(name), ''), 'Store ' || CAST(id AS VARCHAR)) AS store_name
    FROM d_stores"""


def _d(spark, sf_dir):
    return Domain(spark, sf_dir)


@register("link_opdrachtgever", views("participants", "app_users", "store_employees", "stores",
                                      extra=[("names", STORE_NAMES_SQL)]) + """,
emp AS (SELECT user_id, store_id FROM d_store_employees
        WHERE deleted_at IS NULL AND user_id IS NOT NULL AND store_id IS NOT NULL
          AND store_id IN (SELECT store_id FROM names)),
b AS (SELECT p.id AS participant_id, u.user_id FROM d_participants p JOIN d_app_users u
      ON p.public_id = u.qe_participant_id WHERE p.public_id IS NOT NULL AND u.qe_participant_id IS NOT NULL),
pp AS (SELECT participant_id, min(store_id) AS store_id FROM b JOIN emp ON emp.user_id = b.user_id GROUP BY 1)
SELECT pp.participant_id, pp.store_id, names.store_name FROM pp JOIN names ON names.store_id = pp.store_id""")
def q_link_opdrachtgever(spark, sf_dir):
    d = _d(spark, sf_dir)
    return linking.link_participant_store(d.participants, d.app_users, d.store_employees, d.stores)


@register("link_participant_user", views("participants", "app_users") + """
SELECT p.id AS participant_id, min(u.user_id) AS user_id FROM d_participants p JOIN d_app_users u
ON p.public_id = u.qe_participant_id WHERE p.public_id IS NOT NULL AND u.user_id IS NOT NULL GROUP BY 1""")
def q_link_participant_user(spark, sf_dir):
    d = _d(spark, sf_dir)
    return linking.link_participant_user(d.participants, d.app_users)


@register("link_active_store", views("store_employees", "stores") + """
SELECT user_id, min(store_id) AS store_id FROM d_store_employees
WHERE deleted_at IS NULL AND user_id IS NOT NULL AND store_id IS NOT NULL AND store_id IN (SELECT id FROM d_stores)
GROUP BY 1""")
def q_link_active_store(spark, sf_dir):
    d = _d(spark, sf_dir)
    return linking.link_active_store(None, d.store_employees, d.stores)


@register("link_store_three_routes", views("participants", "app_users", "store_employees") + """,
emp AS (SELECT DISTINCT user_id, store_id FROM d_store_employees WHERE user_id IS NOT NULL AND store_id IS NOT NULL),
r AS (SELECT p.id AS participant_id, emp.store_id, 1 AS route FROM d_participants p JOIN emp ON emp.user_id = p.user_id
      WHERE p.id IS NOT NULL
      UNION ALL
      SELECT p.id, emp.store_id, 2 FROM d_participants p JOIN d_app_users u ON p.public_id = u.qe_participant_id
      JOIN emp ON emp.user_id = u.user_id WHERE p.public_id IS NOT NULL)
SELECT participant_id, arg_min(store_id, (route, store_id)) AS store_id, min(route) AS route FROM r GROUP BY 1""")
def q_link_store_three_routes(spark, sf_dir):
    d = _d(spark, sf_dir)
    return linking.link_store_routes(d.participants, d.app_users, d.store_employees)


@register("link_store_fallback", views("participants", "store_employees") + """,
link AS (SELECT user_id, min(store_id) AS s FROM d_store_employees WHERE user_id IS NOT NULL AND store_id IS NOT NULL
         GROUP BY 1)
SELECT p.id AS participant_id, coalesce(p.user_id, p.id) AS user_id, link.s AS store_id
FROM d_participants p LEFT JOIN link ON link.user_id = coalesce(p.user_id, p.id)""")
def q_link_store_fallback(spark, sf_dir):
    d = _d(spark, sf_dir)
    # A participants table without store assignments: the employment route decides.
    p = d.participants.withColumn("store_id", F.lit(None).cast("long"))
    return linking.store_fallback(p, d.store_employees)


@register("join_orders_products", views("purchases", "products", "participants") + """,
pm AS (SELECT user_id, max(id) AS mapped_participant_id FROM d_participants WHERE user_id IS NOT NULL GROUP BY 1)
SELECT o.*, p.name AS product_name, p.price AS product_price, pm.mapped_participant_id
FROM d_purchases o LEFT JOIN d_products p ON CAST(p.id AS VARCHAR) = CAST(o.product_id AS VARCHAR)
LEFT JOIN pm ON pm.user_id = o.user_id""")
def q_join_orders_products(spark, sf_dir):
    d = _d(spark, sf_dir)
    return linking.join_orders_products(purchases(d), products(d), d.participants)


def _lw_sql(cond: str) -> str:
    return f"""SELECT participant_id,
        max(CASE WHEN slug = 'A' THEN score_value END) AS rec_med_bmi,
        max(CASE WHEN slug = 'N' THEN score_value END) AS rec_heartrisk,
        max(CASE WHEN slug = 'R' THEN score_value END) AS rec_ls_stress_sum
      FROM (SELECT *, row_number() OVER (PARTITION BY participant_id, slug
              ORDER BY completion_created_at DESC, id DESC, score_value DESC) AS rn
            FROM d_history WHERE slug IS NOT NULL AND {cond}) WHERE rn = 1 GROUP BY participant_id"""


@register("merge_latest_over", views("history", extra=[
    ("base", _lw_sql("completion_created_at < TIMESTAMP '1999-01-01'")),
    ("lat", _lw_sql("completion_created_at >= TIMESTAMP '1999-01-01'"))]) + """
SELECT b.participant_id, coalesce(l.rec_med_bmi, b.rec_med_bmi) AS rec_med_bmi,
       coalesce(l.rec_heartrisk, b.rec_heartrisk) AS rec_heartrisk,
       coalesce(l.rec_ls_stress_sum, b.rec_ls_stress_sum) AS rec_ls_stress_sum
FROM base b LEFT JOIN lat l ON l.participant_id = b.participant_id""")
def q_merge_latest_over(spark, sf_dir):
    h = _d(spark, sf_dir).history
    cut = F.lit("1999-01-01").cast("timestamp_ntz")
    base = latest_scores_wide(h.where(F.col("completion_created_at") < cut), BINDING_SLUG_COLUMNS)
    lat = latest_scores_wide(h.where(F.col("completion_created_at") >= cut), BINDING_SLUG_COLUMNS)
    return linking.merge_latest_over(base, lat, "participant_id", BINDING_SCORE_COLUMNS)


@register("join_gender", views("history", "participants") + """
SELECT h.id, h.participant_id, h.slug, h.score_value, h.completion_created_at,
       CAST(CASE WHEN upper(trim(p.gender_raw)) LIKE 'M%' THEN 1
            WHEN upper(trim(p.gender_raw)) LIKE 'V%' OR upper(trim(p.gender_raw)) LIKE 'F%' THEN 0
            WHEN TRY_CAST(p.gender_raw AS DOUBLE) = 1 THEN 1 WHEN TRY_CAST(p.gender_raw AS DOUBLE) = 0 THEN 0 END
            AS INTEGER) AS gender
FROM d_history h LEFT JOIN d_participants p ON p.id = h.participant_id""")
def q_join_gender(spark, sf_dir):
    from pulseframe.functions.rules import gender_code
    d = _d(spark, sf_dir)
    g = d.participants.select(F.col("id").alias("participant_id"), gender_code("gender_raw").alias("gender"))
    return (d.history.select("id", "participant_id", "slug", "score_value", "completion_created_at")
            .join(g, "participant_id", "left"))


@register("join_store_partner", views("wide", "stores", "partners") + """,
long AS (SELECT user_id, store_id, latest_completion_at, CAST(rec_med_bmi AS DOUBLE) AS v FROM d_wide
         WHERE rec_med_bmi IS NOT NULL AND user_id IS NOT NULL AND store_id IS NOT NULL AND latest_completion_at IS NOT NULL),
avgs AS (SELECT store_id, CAST(date_trunc('month', latest_completion_at) AS TIMESTAMP) AS date, avg(v) AS average,
                count(DISTINCT user_id) AS participants_count FROM long GROUP BY ALL)
SELECT a.store_id, a.date, round(a.average, 6) AS average, a.participants_count,
       coalesce(nullif(trim(pa.name), ''), nullif(trim(s.name), ''), 'Store #' || CAST(a.store_id AS VARCHAR))
           AS display_name
FROM avgs a LEFT JOIN d_stores s ON s.id = a.store_id LEFT JOIN d_partners pa ON pa.id = s.partner_id""")
def q_join_store_partner(spark, sf_dir):
    d = _d(spark, sf_dir)
    avgs = (store_month_averages(wide(d).select("user_id", "store_id", "latest_completion_at", "rec_med_bmi"))
            .drop("score_slug"))
    return linking.store_display_names(avgs, d.stores, d.partners)


@register("semi_active", views("participants", "completions") + """
SELECT p.id AS participant_id, p.id IN (SELECT participant_id FROM d_completions
       WHERE created_at >= TIMESTAMP '2000-01-01' AND participant_id IS NOT NULL) AS is_active
FROM d_participants p""")
def q_semi_active(spark, sf_dir):
    d = _d(spark, sf_dir)
    recent = d.completions.where(F.col("created_at") >= F.lit("2000-01-01").cast("timestamp_ntz"))
    return linking.flag_in_set(d.participants.select(F.col("id").alias("participant_id")), "participant_id",
                               recent, "participant_id", "is_active")


@register("join_completion_scores", views("completions", "item_scores") + f"""
SELECT c.id AS completion_id, c.participant_id, c.created_at, s.slug, s.value
FROM d_completions c JOIN d_item_scores s ON s.completion_id = c.id
WHERE c.questionnaire_id = '1-URGENT' AND s.slug = 'rec_item_1'""")
def q_join_completion_scores(spark, sf_dir):
    from pulseframe.plans.bindings import item_scores
    d = _d(spark, sf_dir)
    d.completions.createOrReplaceTempView("pf_completions")
    item_scores(d).createOrReplaceTempView("pf_completion_scores")
    return spark.sql("""SELECT c.id AS completion_id, c.participant_id, c.created_at, s.slug, s.value
        FROM pf_completions c JOIN pf_completion_scores s ON s.completion_id = c.id
        WHERE c.questionnaire_id = :questionnaire AND s.slug = :slug""",
                     args={"questionnaire": "1-URGENT", "slug": "rec_item_1"})


@register("range_join_eligible", views("completions") + """,
c AS (SELECT participant_id, questionnaire_id, created_at FROM d_completions WHERE created_at IS NOT NULL),
q AS (SELECT questionnaire_id, min(created_at) AS f FROM c GROUP BY 1),
lt AS (SELECT participant_id, max(created_at) AS t FROM c WHERE participant_id IS NOT NULL GROUP BY 1)
SELECT q.questionnaire_id, count(lt.participant_id) AS n_eligible FROM q LEFT JOIN lt ON lt.t >= q.f GROUP BY 1""")
def q_range_join_eligible(spark, sf_dir):
    return behaviour.questionnaire_reach(_d(spark, sf_dir).completions).select("questionnaire_id", "n_eligible")


@register("overlap_counts", views("history", "purchases", "article_views") + """,
t AS (SELECT DISTINCT participant_id AS k, 'scored' AS s FROM d_history WHERE participant_id IS NOT NULL
      UNION ALL SELECT DISTINCT participant_id, 'buyers' FROM d_purchases WHERE participant_id IS NOT NULL
      UNION ALL SELECT DISTINCT participant_id, 'readers' FROM d_article_views WHERE participant_id IS NOT NULL)
SELECT a.s AS set_a, b.s AS set_b, count(*) AS n_overlap FROM t a JOIN t b ON a.k = b.k AND b.s >= a.s
GROUP BY ALL""")
def q_overlap_counts(spark, sf_dir):
    d = _d(spark, sf_dir)
    return linking.overlap_counts({"scored": d.history, "buyers": purchases(d), "readers": article_views(d)},
                                  "participant_id")


NEWEST_SQL = """newest AS (SELECT model_id, arg_max(struct_pack(lat := lat, long := long, city := city, country := country,
    postal_code := postal_code), id) AS a FROM d_addresses WHERE model_type = 'user' AND deleted_at IS NULL GROUP BY 1)"""
ADDRESS_SELECT = """, a.lat AS lat, a.long AS long, a.city AS city, a.country AS country, a.postal_code AS postal_code_addr"""


@register("enrich_address", views("participants", "addresses") + f""", {NEWEST_SQL}
SELECT p.id AS participant_id, p.user_id, p.postal_code, p.user_id AS app_user_id {ADDRESS_SELECT}
FROM d_participants p LEFT JOIN newest ON newest.model_id = p.user_id""")
def q_enrich_address(spark, sf_dir):
    d = _d(spark, sf_dir)
    rows = d.participants.select(F.col("id").alias("participant_id"), "user_id", "postal_code")
    return linking.enrich_address(rows, addresses(d))


@register("enrich_address_bridge", views("participants", "app_users", "addresses") + f""", {NEWEST_SQL},
b AS (SELECT qe_participant_id AS public_id, min(user_id) AS app_user_id FROM d_app_users GROUP BY 1)
SELECT p.id AS participant_id, p.public_id, p.postal_code, b.app_user_id {ADDRESS_SELECT}
FROM d_participants p LEFT JOIN b ON b.public_id = p.public_id LEFT JOIN newest ON newest.model_id = b.app_user_id""")
def q_enrich_address_bridge(spark, sf_dir):
    d = _d(spark, sf_dir)
    rows = d.participants.select(F.col("id").alias("participant_id"), "public_id", "postal_code")
    bridge = d.app_users.select(F.col("qe_participant_id").alias("public_id"), F.col("user_id").alias("app_user_id"))
    return linking.enrich_address(rows, addresses(d), bridge)


@register("geo_points", views("participants", "addresses") + f""", {NEWEST_SQL}
SELECT p.id AS participant_id, p.postal_code, TRY_CAST(a.lat AS DOUBLE) AS lat, TRY_CAST(a.long AS DOUBLE) AS lon
FROM d_participants p JOIN newest ON newest.model_id = p.user_id
WHERE TRY_CAST(a.lat AS DOUBLE) IS NOT NULL AND TRY_CAST(a.long AS DOUBLE) IS NOT NULL""")
def q_geo_points(spark, sf_dir):
    d = _d(spark, sf_dir)
    rows = d.participants.select(F.col("id").alias("participant_id"), "user_id", "postal_code")
    return linking.geo_points(linking.enrich_address(rows, addresses(d)))


BRIDGE_SQL = """u AS (SELECT p.id AS participant_id, min(a.user_id) AS user_id FROM d_participants p
    LEFT JOIN d_app_users a ON a.qe_participant_id = p.public_id GROUP BY 1),
oldest AS (SELECT model_id, arg_min(first_name, id) AS first_name FROM d_addresses
    WHERE model_type = 'user' AND deleted_at IS NULL GROUP BY 1),
bridge AS (SELECT u.participant_id, u.user_id, (coalesce(length(trim(c.name)), 0) > 0
    OR coalesce(length(trim(o.first_name)), 0) > 0) AS has_name
    FROM u LEFT JOIN d_accounts c ON c.id = u.user_id LEFT JOIN oldest o ON o.model_id = u.user_id)"""


def _bridge(d):
    return linking.funnel_bridge(d.participants, d.app_users, accounts(d), addresses(d))


@register("join_funnel_bridge", views("participants", "app_users", "accounts", "addresses") + f""", {BRIDGE_SQL}
SELECT participant_id, user_id, has_name FROM bridge""")
def q_join_funnel_bridge(spark, sf_dir):
    return _bridge(_d(spark, sf_dir))


@register("funnel_name_metric", views("app_users", "accounts", "addresses", "wide") + f""", {BRIDGE_SQL},
t AS (SELECT count(*) AS n_all, count(*) FILTER (has_name) AS n, count(rec_age_current) AS aged,
             count(rec_age_current) FILTER (has_name) AS n_after_age, count(b.user_id) AS with_user
      FROM bridge b LEFT JOIN d_wide w ON w.participant_id = b.participant_id)
SELECT 'Naam ingevuld' AS stage, n, n_after_age, with_user, round(n * 100.0 / greatest(n_all, 1), 1)::DOUBLE AS pct_of_start,
       aged - n_after_age AS drop_since_age, round((aged - n_after_age) * 100.0 / greatest(aged, 1), 1)::DOUBLE AS pct_drop_since_age
FROM t""")
def q_funnel_name_metric(spark, sf_dir):
    d = _d(spark, sf_dir)
    return behaviour.funnel_name_metric(wide(d), _bridge(d))
