"""Registered scalar-expression and simple filter queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulseframe.functions import rules
from pulseframe.functions.semantics import cut, cut_sql, day_start, month_start, to_num
from pulseframe.operators import cohort, describe, linking
from pulseframe.plans.bindings import Domain, Tables, views, wide
from pulseframe.plans.catalog import r, register


def _t(spark, sf_dir):
    return Tables(spark, sf_dir)


NUM_SQL = "CASE WHEN isnan(TRY_CAST(trim({x}) AS DOUBLE)) THEN NULL ELSE TRY_CAST(trim({x}) AS DOUBLE) END"


@register("num_clean", f"""SELECT event_id, {NUM_SQL.format(x="json_extract_string(props, '$.k')")} AS k_num,
    {NUM_SQL.format(x='event_type')} AS type_num,
    {NUM_SQL.format(x="' ' || json_extract_string(props, '$.k') || ' '")} AS padded_num FROM events""")
def q_num_clean(spark, sf_dir):
    e = _t(spark, sf_dir).events
    k = F.get_json_object("props", "$.k")
    return e.select("event_id", to_num(k).alias("k_num"), to_num("event_type").alias("type_num"),
                    to_num(F.concat(F.lit(" "), k, F.lit(" "))).alias("padded_num"))


def _gender_sql(x: str) -> str:
    u = f"upper(trim(CAST({x} AS VARCHAR)))"
    n = f"TRY_CAST(trim(CAST({x} AS VARCHAR)) AS DOUBLE)"
    return (f"CAST(CASE WHEN {u} LIKE 'M%' THEN 1 WHEN {u} LIKE 'V%' OR {u} LIKE 'F%' THEN 0 "
            f"WHEN {n} = 1 THEN 1 WHEN {n} = 0 THEN 0 END AS INTEGER)")


@register("gender_normalize", f"""SELECT c_custkey, {_gender_sql('c_mktsegment')} AS gender_from_text,
    {_gender_sql('c_custkey % 2')} AS gender_from_code FROM customer""")
def q_gender_normalize(spark, sf_dir):
    c = _t(spark, sf_dir).customer
    return c.select("c_custkey", rules.gender_code("c_mktsegment").alias("gender_from_text"),
                    rules.gender_code(F.col("c_custkey") % 2).alias("gender_from_code"))


# The history binding's factor table: return flag -> factor slug.
FACTOR_SLUGS = {"A": "bmi", "N": "heartrisk", "R": "stress"}


def _case_map(expr: str, mapping: dict) -> str:
    return "CASE " + " ".join(f"WHEN {expr} = '{k}' THEN '{v}'" for k, v in mapping.items()) + " END"


SLUG_COL_SQL = ("CASE WHEN trim(s) IS NULL OR trim(s) = '' THEN NULL "
                "WHEN starts_with(trim(s), 'rec_') OR starts_with(trim(s), 'feat_') THEN trim(s) ELSE "
                + _case_map("trim(s)", rules.SLUG_TO_COLUMN) + " END")


def _initcap_sql(x: str) -> str:
    return f"array_to_string(list_transform(string_split(lower({x}), ' '), lambda w: upper(w[1:1]) || w[2:]), ' ')"


def _net_label_sql(x: str) -> str:
    s = x
    for p in rules.LABEL_PREFIXES:
        s = f"replace({s}, '{p}', '')"
    s = f"replace({s}, '_', ' ')"
    for a, b in rules.LABEL_ACRONYMS:
        s = f"replace({s}, '{a}', '{b}')"
    return _initcap_sql(f"trim({s})")


def _quality_label_sql(x: str) -> str:
    s = x
    for p in rules.QUALITY_LABEL_PREFIXES:
        s = f"replace({s}, '{p}', '')"
    s = f"trim(replace({s}, '_', ' '))"
    return f"upper(substr({s}, 1, 1)) || lower(substr({s}, 2))"


LABEL_SQL = f"""WITH f AS (SELECT DISTINCT {_case_map('l_returnflag', FACTOR_SLUGS)} AS s FROM lineitem),
c AS (SELECT s AS slug, {SLUG_COL_SQL} AS "column" FROM f)
SELECT slug, "column", coalesce({_case_map('"column"', rules.COLUMN_TO_HISTORY_SLUG)}, "column") AS history_slug,
       {_net_label_sql('"column"')} AS net_label, {_quality_label_sql('"column"')} AS quality_label FROM c"""


@register("slug_to_column", LABEL_SQL)
def q_slug_to_column(spark, sf_dir):
    li = _t(spark, sf_dir).lineitem
    s = li.select(rules.map_lookup(FACTOR_SLUGS, "l_returnflag").alias("slug")).distinct()
    c = s.withColumn("column", rules.slug_to_column("slug"))
    return c.select("slug", "column", rules.column_to_history_slug("column").alias("history_slug"),
                    rules.net_label("column").alias("net_label"), rules.quality_label("column").alias("quality_label"))


@register("locale_normalize", """SELECT lower(replace(trim(lang), '-', '_')) AS locale,
    starts_with(lower(replace(trim(lang), '-', '_')), 'nl') AS is_dutch, count(*) AS n_documents
    FROM documents GROUP BY ALL""")
def q_locale_normalize(spark, sf_dir):
    d = _t(spark, sf_dir).documents
    loc = rules.locale_normalize("lang")
    return (d.groupBy(loc.alias("locale")).agg(F.count(F.lit(1)).alias("n_documents"))
             .withColumn("is_dutch", F.col("locale").startswith("nl")))


@register("hash_id", "SELECT c_custkey, substr(sha256(CAST(c_custkey AS VARCHAR)), 1, 12) AS hashed FROM customer")
def q_hash_id(spark, sf_dir):
    c = _t(spark, sf_dir).customer
    return c.select("c_custkey", rules.hash_id("c_custkey").alias("hashed"))


@register("pc4_pc3", """SELECT c_custkey, nullif(regexp_extract(c_name, '(\\d{4})', 1), '') AS pc4,
    substr(nullif(regexp_extract(c_name, '(\\d{4})', 1), ''), 1, 3) AS pc3 FROM customer""")
def q_pc4_pc3(spark, sf_dir):
    c = _t(spark, sf_dir).customer
    return c.select("c_custkey", rules.pc4("c_name").alias("pc4"), rules.pc3("c_name").alias("pc3"))


@register("region_flag", """SELECT c_custkey, CASE
    WHEN upper(trim(n_name)) IN ('NL', 'NEDERLAND', 'NETHERLANDS') THEN 'Nederland'
    WHEN n_name IS NOT NULL AND trim(n_name) <> '' THEN 'Buitenland'
    WHEN nullif(regexp_extract(c_name, '(\\d{4})', 1), '') IS NOT NULL THEN 'Nederland' ELSE 'Onbekend' END AS region
    FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey""")
def q_region_flag(spark, sf_dir):
    t = _t(spark, sf_dir)
    j = t.customer.join(t.nation, F.col("n_nationkey") == F.col("c_nationkey"), "left")
    return j.select("c_custkey", rules.region_flag("n_name", "c_name").alias("region"))


def _three(x: str, hi: float, mid: float, strict: bool = False) -> str:
    op = ">" if strict else ">="
    return f"CAST(CASE WHEN {x} {op} {hi} THEN 2 WHEN {x} {op} {mid} THEN 1 ELSE 0 END AS INTEGER)"


CATEGORY_SQL = f"""SELECT q,
    CAST(CASE WHEN q >= 30 THEN 2 WHEN q >= 25 THEN 1 WHEN q >= 18.5 THEN 0 WHEN q < 18.5 THEN -1 ELSE 0 END AS INTEGER)
        AS bmi_category,
    {_three('q', 20, 10)} AS heartrisk_category, {_three('q', 40, 20)} AS stress_category,
    {_three('q / 5', 10, 5, True)} AS sleep_category, {_three('q + 20', 55, 40)} AS age_category3,
    {_three('q * 250', 10000, 5000)} AS steps_category, {_three('q / 20', 2, 1)} AS blood_pressure_category,
    CAST(CASE WHEN q * 200 >= 5000 OR q * 10 >= 250 THEN 0 WHEN q * 200 < 5000 AND q * 10 < 250 THEN 1 END AS INTEGER)
        AS inactive_flag,
    {cut_sql('q', *rules.SCORE_CATEGORIES['rec_ls_stress_sum'], right=True, include_lowest=True)} AS stress_score_category,
    {cut_sql('q / 5', *rules.SCORE_CATEGORIES['rec_ls_lifestyle_score'], right=True, include_lowest=True)}
        AS lifestyle_score_category,
    CASE WHEN q - 1 = 0 THEN '{rules.SMOKING_GROUPS[0]}' WHEN q - 1 BETWEEN 1 AND 4 THEN '{rules.SMOKING_GROUPS[1]}'
         WHEN q - 1 IN (5, 6) THEN '{rules.SMOKING_GROUPS[2]}' END AS smoking_group,
    CASE WHEN abs(q / 40) < 0.2 THEN 'Verwaarloosbaar' WHEN abs(q / 40) < 0.5 THEN 'Klein'
         WHEN abs(q / 40) < 0.8 THEN 'Matig' ELSE 'Groot' END AS effect_size_label,
    CASE WHEN q <= 5 THEN CAST(CAST(q AS BIGINT) AS VARCHAR) || 'x' ELSE '6+x' END AS frequency_bucket,
    CASE WHEN q * 10 - 100 <= 90 THEN '{rules.BUYER_GROUPS[0]}' WHEN q * 10 - 100 <= 365 THEN '{rules.BUYER_GROUPS[1]}'
         ELSE '{rules.BUYER_GROUPS[2]}' END AS days_between_bucket,
    {r('CASE WHEN q = 0 THEN 0.0 ELSE 0.15 + (least(greatest(q, 1), 50) - 1) / 49.0 * 0.70 END')} AS opacity_by_count,
    {r('least(greatest(70 + 3 * (q - 25), 0), 100)')} AS productivity_estimate,
    {r('least(q, 1.5 * 30)')} AS winsor_cap, {r('q * 1000')} AS steps_scaled, {r('q')} AS other_scaled
FROM (SELECT DISTINCT l_quantity AS q FROM lineitem)"""


@register("category_rules", CATEGORY_SQL)
def q_category_rules(spark, sf_dir):
    q = _t(spark, sf_dir).lineitem.select(F.col("l_quantity").alias("q")).distinct()
    freq_label, _ = rules.frequency_bucket(F.col("q").cast("long"))
    return q.select(
        "q", rules.bmi_category("q").alias("bmi_category"), rules.heartrisk_category("q").alias("heartrisk_category"),
        rules.stress_category("q").alias("stress_category"), rules.sleep_category(F.col("q") / 5).alias("sleep_category"),
        rules.age_category3(F.col("q") + 20).alias("age_category3"),
        rules.steps_category(F.col("q") * 250).alias("steps_category"),
        rules.blood_pressure_category(F.col("q") / 20).alias("blood_pressure_category"),
        rules.inactive_flag(F.col("q") / 5, F.col("q") * 10).alias("inactive_flag"),
        rules.score_category("q", "rec_ls_stress_sum").alias("stress_score_category"),
        rules.score_category(F.col("q") / 5, "rec_ls_lifestyle_score").alias("lifestyle_score_category"),
        rules.smoking_group(F.col("q") - 1).alias("smoking_group"),
        rules.effect_size_label(F.col("q") / 40).alias("effect_size_label"),
        freq_label.alias("frequency_bucket"),
        rules.days_between_bucket(F.col("q") * 10 - 100).alias("days_between_bucket"),
        rules.opacity_by_count("q").alias("opacity_by_count"),
        rules.productivity_estimate(F.col("q") - 25).alias("productivity_estimate"),
        rules.winsor_cap("q", 30).alias("winsor_cap"),
        rules.steps_scale("q", F.lit("rec_ls_exercise_steps_per_day")).alias("steps_scaled"),
        rules.steps_scale("q", F.lit("rec_ls_score_exercise")).alias("other_scaled"))


@register("json_value", f"""SELECT event_type, {r("avg(CAST(json_extract_string(props, '$.k') AS DOUBLE))")} AS mean_k,
    count(json_extract_string(props, '$.k')) AS n FROM events GROUP BY 1""")
def q_json_value(spark, sf_dir):
    e = _t(spark, sf_dir).events
    k = F.get_json_object("props", "$.k")
    return e.groupBy("event_type").agg(F.avg(k.cast("double")).alias("mean_k"), F.count(k).alias("n"))


@register("date_parts", """SELECT DISTINCT CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, year(ts) AS year,
    CAST(date_trunc('month', ts) AS TIMESTAMP) AS month FROM events""")
def q_date_parts(spark, sf_dir):
    e = _t(spark, sf_dir).events
    return e.select(day_start("ts").alias("day"), F.year("ts").alias("year"),
                    month_start("ts").alias("month")).distinct()


W = views("wide")


@register("normalize_p5_p95", W + f""", s AS (SELECT quantile_cont(rec_med_bmi, 0.05) AS p5,
    quantile_cont(rec_med_bmi, 0.95) AS p95, max(rec_med_bmi) AS mx FROM d_wide)
SELECT participant_id, {r('''CASE WHEN NOT (p5 IS NULL OR p95 IS NULL OR p95 <= p5)
    THEN 1 + 9 * least(greatest((rec_med_bmi - p5) / (p95 - p5), 0), 1)
    WHEN mx IS NULL OR mx <= 0 THEN rec_med_bmi ELSE 1 + 9 * least(greatest(rec_med_bmi / mx, 0), 1) END''')}
    AS rec_med_bmi_norm FROM d_wide, s""")
def q_normalize_p5_p95(spark, sf_dir):
    w = wide(Domain(spark, sf_dir)).select("participant_id", "rec_med_bmi")
    return describe.normalize_p5_p95(w, "rec_med_bmi").select("participant_id", "rec_med_bmi_norm")


@register("normalize_to_max", W + f""", m AS (SELECT max(rec_heartrisk) AS mx FROM d_wide)
SELECT participant_id, {r('CASE WHEN mx IS NULL OR mx = 0 THEN rec_heartrisk ELSE rec_heartrisk * (10.0 / mx) END')}
    AS rec_heartrisk_scaled FROM d_wide, m""")
def q_normalize_to_max(spark, sf_dir):
    w = wide(Domain(spark, sf_dir)).select("participant_id", "rec_heartrisk")
    return describe.normalize_to_max(w, "rec_heartrisk").select("participant_id", "rec_heartrisk_scaled")


@register("clip_outlier_max", W + f"""SELECT participant_id, {r('round(rec_ls_stress_sum * 0.5, 1)')} AS rec_ls_stress_sum
    FROM d_wide WHERE rec_ls_stress_sum IS NOT NULL AND rec_ls_stress_sum <= 45""")
def q_clip_outlier_max(spark, sf_dir):
    w = wide(Domain(spark, sf_dir)).select("participant_id", "rec_ls_stress_sum")
    return describe.clip_outlier_max(w, "rec_ls_stress_sum", 45, 0.5)


@register("filter_year_range", views("history") + """SELECT slug, year(completion_created_at) AS year, count(*) AS n
    FROM d_history WHERE year(completion_created_at) BETWEEN 1996 AND 1999 GROUP BY ALL""")
def q_filter_year_range(spark, sf_dir):
    h = Domain(spark, sf_dir).history
    y = F.year("completion_created_at")
    return h.where(y.between(1996, 1999)).groupBy("slug", y.alias("year")).agg(F.count(F.lit(1)).alias("n"))


@register("filter_not_deleted", views("store_employees") + """SELECT store_id, count(*) AS n FROM d_store_employees
    WHERE deleted_at IS NULL GROUP BY 1""")
def q_filter_not_deleted(spark, sf_dir):
    se = Domain(spark, sf_dir).store_employees
    return linking.not_deleted(se, "deleted_at").groupBy("store_id").agg(F.count(F.lit(1)).alias("n"))


@register("filter_valid_store_ids", views("store_employees", "stores") + """SELECT count(*) AS n FROM d_store_employees
    WHERE store_id IN (SELECT id FROM d_stores)""")
def q_filter_valid_store_ids(spark, sf_dir):
    d = Domain(spark, sf_dir)
    return (d.store_employees.join(d.stores.select(F.col("id").alias("store_id")), "store_id", "left_semi")
            .agg(F.count(F.lit(1)).alias("n")))


@register("filter_participant_ids", views("wide", "history") + """SELECT slug, count(*) AS n FROM d_history
    WHERE participant_id IN (SELECT participant_id FROM d_wide WHERE rec_user_gender = 1) GROUP BY 1""")
def q_filter_participant_ids(spark, sf_dir):
    d = Domain(spark, sf_dir)
    cohort_ids = cohort.filter_gender(wide(d), "man").select("participant_id")
    return (d.history.join(cohort_ids, "participant_id", "left_semi")
            .groupBy("slug").agg(F.count(F.lit(1)).alias("n")))


@register("filter_min_n", views("history", "participants") + """SELECT p.store_id, count(DISTINCT h.participant_id) AS n
    FROM d_history h JOIN d_participants p ON p.id = h.participant_id GROUP BY 1
    HAVING count(DISTINCT h.participant_id) >= 60""")
def q_filter_min_n(spark, sf_dir):
    d = Domain(spark, sf_dir)
    j = d.history.join(d.participants.select(F.col("id").alias("participant_id"), "store_id"), "participant_id")
    return (j.groupBy("store_id").agg(F.countDistinct("participant_id").alias("n")).where(F.col("n") >= 60))
