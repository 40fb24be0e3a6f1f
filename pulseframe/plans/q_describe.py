"""Registered descriptive queries: distributions, histograms, box statistics,
quality, duplicates, outliers and geography."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulseframe.functions import rules
from pulseframe.functions.semantics import cut_sql
from pulseframe.operators import describe
from pulseframe.plans.bindings import TABLES, Domain, Tables, views, wide
from pulseframe.plans.catalog import r, register

W = views("wide")


def _w(spark, sf_dir):
    return wide(Domain(spark, sf_dir))


def _labels_sql(mapping) -> str:
    return "(VALUES " + ", ".join(f"({float(k)!r}, '{v}')" for k, v in mapping.items()) + ") lab(code, label)"


@register("pct_distribution", W + f"""
SELECT c.code, c.n, {r('c.n * 100.0 / t.total')} AS pct, lab.label
FROM (SELECT CAST(rec_heartrisk_cat AS DOUBLE) AS code, count(*) AS n FROM d_wide
      WHERE rec_heartrisk_cat IS NOT NULL GROUP BY 1) c
CROSS JOIN (SELECT count(*) AS total FROM d_wide WHERE rec_heartrisk_cat IS NOT NULL) t
JOIN {_labels_sql(rules.HEARTRISK_LABELS)} ON lab.code = c.code""")
def q_pct_distribution(spark, sf_dir):
    return describe.pct_distribution(_w(spark, sf_dir), "rec_heartrisk_cat", rules.HEARTRISK_LABELS)


@register("pct_by_gender", W + f"""
SELECT c.rec_user_gender, c.code, c.n, {r('c.n * 100.0 / sum(c.n) OVER (PARTITION BY c.rec_user_gender)')} AS pct,
       lab.label
FROM (SELECT rec_user_gender, CAST(rec_med_bmi_cat AS DOUBLE) AS code, count(*) AS n FROM d_wide
      WHERE rec_med_bmi_cat IS NOT NULL AND rec_user_gender IS NOT NULL GROUP BY 1, 2) c
JOIN {_labels_sql(rules.BMI_LABELS)} ON lab.code = c.code""")
def q_pct_by_gender(spark, sf_dir):
    return describe.pct_by_group(_w(spark, sf_dir), "rec_med_bmi_cat", "rec_user_gender", rules.BMI_LABELS)


@register("histogram", W + f"""
, x AS (SELECT rec_age_current AS v, rec_user_gender FROM d_wide WHERE rec_age_current IS NOT NULL),
rng AS (SELECT min(v) AS lo, max(v) AS hi FROM x)
SELECT CAST(least(CASE WHEN (hi - lo) / 30 = 0 THEN 0 ELSE floor((v - lo) / ((hi - lo) / 30)) END, 29) AS INTEGER) AS bin,
       rec_user_gender, count(*) AS n,
       {r('lo + least(CASE WHEN (hi - lo) / 30 = 0 THEN 0 ELSE floor((v - lo) / ((hi - lo) / 30)) END, 29) * ((hi - lo) / 30)')}
           AS bin_start,
       {r('lo + (least(CASE WHEN (hi - lo) / 30 = 0 THEN 0 ELSE floor((v - lo) / ((hi - lo) / 30)) END, 29) + 1) * ((hi - lo) / 30)')}
           AS bin_end
FROM x, rng GROUP BY ALL""")
def q_histogram(spark, sf_dir):
    return describe.histogram_equal_width(_w(spark, sf_dir), "rec_age_current", 30, by="rec_user_gender")


@register("histogram_scores", W + f"""
, x AS (SELECT rec_ls_lifestyle_score AS v FROM d_wide WHERE rec_ls_lifestyle_score IS NOT NULL),
lo AS (SELECT min(v) AS lo FROM x)
SELECT CAST(floor((v - lo) / 0.5) AS BIGINT) AS bin, count(*) AS n, {r('lo + floor((v - lo) / 0.5) * 0.5')} AS bin_start
FROM x, lo GROUP BY ALL""")
def q_histogram_scores(spark, sf_dir):
    return describe.histogram_fixed_width(_w(spark, sf_dir), "rec_ls_lifestyle_score", 0.5)


BOX_SQL = W + f"""
, x AS (SELECT segment, rec_ls_lifestyle_score AS v FROM d_wide
        WHERE rec_ls_lifestyle_score IS NOT NULL AND segment IS NOT NULL),
q AS (SELECT segment, count(v) AS n, avg(v) AS mean, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median,
             quantile_cont(v, 0.75) AS q3 FROM x GROUP BY segment)
SELECT q.segment, q.n, {r('q.mean')} AS mean, {r('q.q1')} AS q1, {r('q.median')} AS median, {r('q.q3')} AS q3,
       {r('min(CASE WHEN x.v >= q.q1 - 1.5 * (q.q3 - q.q1) THEN x.v END)')} AS whisker_low,
       {r('max(CASE WHEN x.v <= q.q3 + 1.5 * (q.q3 - q.q1) THEN x.v END)')} AS whisker_high
FROM q JOIN x ON x.segment = q.segment GROUP BY q.segment, q.n, q.mean, q.q1, q.median, q.q3"""


@register("box_stats", BOX_SQL)
def q_box_stats(spark, sf_dir):
    return describe.box_stats(_w(spark, sf_dir), "rec_ls_lifestyle_score", "segment")


STRESS_CAT = cut_sql("rec_ls_stress_sum", *rules.SCORE_CATEGORIES["rec_ls_stress_sum"], right=True, include_lowest=True)


@register("score_category_counts", W + f"""SELECT {STRESS_CAT} AS category, rec_user_gender, count(*) AS n
    FROM d_wide WHERE rec_ls_stress_sum IS NOT NULL GROUP BY ALL""")
def q_score_category_counts(spark, sf_dir):
    w = _w(spark, sf_dir)
    cat = rules.score_category("rec_ls_stress_sum", "rec_ls_stress_sum")
    return (w.where(F.col("rec_ls_stress_sum").isNotNull())
             .groupBy(cat.alias("category"), "rec_user_gender").agg(F.count(F.lit(1)).alias("n")))


MEASURES = {"BMI": "rec_med_bmi", "Hartrisico": "rec_heartrisk", "Stress": "rec_ls_stress_sum",
            "Leeftijd": "rec_age_current", "Saldo": "balance"}
LIMITS = {"rec_ls_stress_sum": 45.0, "rec_med_bmi": 48.0}


def _measures_long_sql(measures) -> str:
    return " UNION ALL ".join(f"SELECT '{k}' AS measure, '{v}' AS \"column\", CAST({v} AS DOUBLE) AS value FROM d_wide "
                              f"WHERE {v} IS NOT NULL" for k, v in measures.items())


OUTLIER_SQL = W + f""", long AS ({_measures_long_sql(MEASURES)}),
st AS (SELECT measure, "column", count(value) AS n_valid, avg(value) AS mean, stddev_samp(value) AS std,
              min(value) AS min, max(value) AS max, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median,
              quantile_cont(value, 0.75) AS q3 FROM long GROUP BY ALL HAVING count(value) >= 10),
lim AS (SELECT * FROM (VALUES ('rec_ls_stress_sum', 45.0), ('rec_med_bmi', 48.0)) t("column", lim))
SELECT st.measure, st."column", st.n_valid, {r('st.mean')} AS mean, {r('st.std')} AS std, {r('st.min')} AS min,
       {r('st.max')} AS max, {r('st.median')} AS median,
       {r('st.q1 - 1.5 * (st.q3 - st.q1)')} AS fence_low, {r('st.q3 + 1.5 * (st.q3 - st.q1)')} AS fence_high,
       CAST(sum(CASE WHEN l.value < st.q1 - 1.5 * (st.q3 - st.q1) THEN 1 ELSE 0 END) AS BIGINT) AS n_low,
       CAST(sum(CASE WHEN l.value > st.q3 + 1.5 * (st.q3 - st.q1) THEN 1 ELSE 0 END) AS BIGINT) AS n_high,
       CAST(sum(CASE WHEN l.value > lim.lim THEN 1 ELSE 0 END) AS BIGINT) AS n_above_domain,
       CAST(sum(CASE WHEN l.value < st.q1 - 1.5 * (st.q3 - st.q1) OR l.value > st.q3 + 1.5 * (st.q3 - st.q1)
                THEN 1 ELSE 0 END) AS BIGINT) AS n_outliers,
       {r('sum(CASE WHEN l.value < st.q1 - 1.5 * (st.q3 - st.q1) OR l.value > st.q3 + 1.5 * (st.q3 - st.q1) THEN 1 ELSE 0 END) * 100.0 / st.n_valid')}
           AS pct_outliers,
       {r('any_value(lim.lim)')} AS domain_limit
FROM st JOIN long l ON l."column" = st."column" LEFT JOIN lim ON lim."column" = st."column"
GROUP BY st.measure, st."column", st.n_valid, st.mean, st.std, st.min, st.max, st.median, st.q1, st.q3"""


@register("outliers_iqr", OUTLIER_SQL)
def q_outliers_iqr(spark, sf_dir):
    return describe.outliers_iqr(_w(spark, sf_dir), MEASURES, LIMITS)


DQ_COLS = ["rec_med_bmi", "rec_heartrisk", "rec_ls_stress_sum", "rec_age_current", "balance"]


def _dq_sql() -> str:
    long = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", CAST({c} AS DOUBLE) AS value FROM d_wide" for c in DQ_COLS)
    cats = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", CAST({c}_cat AS DOUBLE) AS code FROM d_wide"
                              for c in ("rec_med_bmi", "rec_heartrisk"))
    return W + f""", long AS ({long}), cl AS ({cats}),
cd AS (SELECT "column", string_agg(CAST(CAST(code AS BIGINT) AS VARCHAR) || '=' || CAST(n AS VARCHAR), ', ' ORDER BY code)
              AS category_distribution
       FROM (SELECT "column", code, count(*) AS n FROM cl WHERE code IS NOT NULL GROUP BY ALL) GROUP BY "column"),
rows AS (SELECT count(*) AS n FROM d_wide)
SELECT s."column", s.filled, {r('s.mean')} AS mean, {r('s.std')} AS std, {r('s.min')} AS min, {r('s.max')} AS max,
       rows.n - s.filled AS missing, {r('(rows.n - s.filled) * 100.0 / rows.n')} AS missing_pct, cd.category_distribution,
       CASE WHEN (rows.n - s.filled) * 100.0 / rows.n > 50 THEN 'hoog'
            WHEN (rows.n - s.filled) * 100.0 / rows.n > 20 THEN 'matig' ELSE 'laag' END AS missing_band
FROM (SELECT "column", count(value) AS filled, avg(value) AS mean, stddev_samp(value) AS std, min(value) AS min,
             max(value) AS max FROM long GROUP BY "column") s
CROSS JOIN rows LEFT JOIN cd ON cd."column" = s."column\""""


@register("data_quality", _dq_sql())
def q_data_quality(spark, sf_dir):
    return describe.data_quality(_w(spark, sf_dir), DQ_COLS)


ID_COLUMNS = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey",
              "part": "p_partkey", "orders": "o_orderkey", "lineitem": "l_orderkey", "events": "event_id",
              "documents": "doc_id", "embeddings": "vec_id", "pages": "page_id", "benchmark": "item_id",
              "labels": "doc_id", "conversations": "conv_id"}


def _dup_sql() -> str:
    parts = []
    for t in TABLES:
        parts.append(f"""SELECT '{t}' AS "table", (SELECT count(*) FROM {t}) AS rows,
            (SELECT count(*) FROM (SELECT DISTINCT * FROM {t})) AS unique_rows,
            (SELECT count(*) - count(DISTINCT {ID_COLUMNS[t]}) FROM {t}) AS duplicate_ids""")
    body = " UNION ALL ".join(parts)
    return f"""SELECT "table", rows, unique_rows, duplicate_ids, rows - unique_rows AS full_row_duplicates,
        {r('CASE WHEN rows > 0 THEN (rows - unique_rows) * 100.0 / rows ELSE 0 END')} AS duplicate_pct
        FROM ({body})"""


@register("duplicate_stats", _dup_sql())
def q_duplicate_stats(spark, sf_dir):
    t = Tables(spark, sf_dir)
    parts = []
    for name in TABLES:
        df = t.read(name)
        parts.append(describe.duplicate_stats({name: df.withColumnRenamed(ID_COLUMNS[name], "id")}, "id"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


PC3 = "substr(regexp_extract(postal_code, '(\\d{4})', 1), 1, 3)"


@register("geo_density", W + f"""SELECT {PC3} AS pc3, count(*) AS n_participants FROM d_wide
    WHERE regexp_extract(postal_code, '(\\d{{4}})', 1) <> '' GROUP BY 1""")
def q_geo_density(spark, sf_dir):
    w = _w(spark, sf_dir).withColumn("pc3", rules.pc3("postal_code")).where(F.col("pc3").isNotNull())
    return w.groupBy("pc3").agg(F.count(F.lit(1)).alias("n_participants"))


@register("geo_category_mode", W + f"""
, c AS (SELECT {PC3} AS pc3, CAST(round(rec_heartrisk_cat) AS BIGINT) AS code, count(*) AS n_code FROM d_wide
        WHERE regexp_extract(postal_code, '(\\d{{4}})', 1) <> '' AND rec_heartrisk_cat IS NOT NULL GROUP BY 1, 2),
k AS (SELECT *, sum(n_code) OVER (PARTITION BY pc3) AS n_valid,
             row_number() OVER (PARTITION BY pc3 ORDER BY n_code DESC, code) AS rk FROM c)
SELECT pc3, code AS modal_code, n_code, CAST(n_valid AS BIGINT) AS n_valid, {r('n_code * 100.0 / n_valid')} AS dominance_pct
FROM k WHERE rk = 1""")
def q_geo_category_mode(spark, sf_dir):
    w = (_w(spark, sf_dir).withColumn("pc3", rules.pc3("postal_code"))
         .withColumn("code", F.round("rec_heartrisk_cat").cast("long")))
    return describe.mode_per_group(w, "pc3", "code")


@register("geo_median", W + f"""SELECT {PC3} AS pc3, {r('quantile_cont(rec_ls_lifestyle_score, 0.5)')} AS median,
    count(rec_ls_lifestyle_score) AS n FROM d_wide
    WHERE regexp_extract(postal_code, '(\\d{{4}})', 1) <> '' AND rec_ls_lifestyle_score IS NOT NULL GROUP BY 1""")
def q_geo_median(spark, sf_dir):
    w = _w(spark, sf_dir).withColumn("pc3", rules.pc3("postal_code"))
    x = w.where(F.col("pc3").isNotNull() & F.col("rec_ls_lifestyle_score").isNotNull())
    n = x.groupBy("pc3").agg(F.count("rec_ls_lifestyle_score").alias("n"))
    return n.join(describe.quantile_table(x, ["pc3"], "rec_ls_lifestyle_score", [0.5], ["median"]), "pc3")


REGION_METRICS = {"BMI": "A", "Hartrisico": "N", "Stress": "R"}
REGION_PC = "CASE WHEN p.segment = 'MACHINERY' THEN 'B-' || substr(p.postal_code, 2) ELSE p.postal_code END"


@register("region_comparison", views("history", "participants") + f""", per AS (
  SELECT h.participant_id, h.slug, CASE WHEN regexp_extract({REGION_PC}, '(\\d{{4}})', 1) <> '' THEN 'Nederland'
         ELSE 'Buitenland' END AS region, avg(h.score_value) AS v
  FROM d_history h JOIN d_participants p ON p.id = h.participant_id WHERE h.score_value IS NOT NULL GROUP BY ALL)
SELECT CASE slug WHEN 'A' THEN 'BMI' WHEN 'N' THEN 'Hartrisico' ELSE 'Stress' END AS metric, region,
       {r('round(avg(v), 2)')} AS mean, count(DISTINCT participant_id) AS n FROM per GROUP BY 1, 2""")
def q_region_comparison(spark, sf_dir):
    """Home against abroad: the mean per participant first, then per region
    (customers of one segment have a foreign postcode)."""
    d = Domain(spark, sf_dir)
    p = d.participants.select(F.col("id").alias("participant_id"), F.when(
        F.col("segment") == "MACHINERY", F.concat(F.lit("B-"), F.substring("postal_code", 2, 9)))
        .otherwise(F.col("postal_code")).alias("postal_code"))
    rows = d.history.select("participant_id", "slug", "score_value").join(p, "participant_id")
    rows = rows.select("participant_id", describe.home_or_abroad("postal_code").alias("region"),
                       *[F.when(F.col("slug") == s, F.col("score_value")).alias(m) for m, s in REGION_METRICS.items()])
    return describe.region_comparison(rows, {m: m for m in REGION_METRICS})


@register("pivot_text", views("wide", "stores") + """, g AS (
  SELECT 'BMI' AS metric, s.partner_id AS region, round(avg(w.rec_med_bmi), 1) AS m, count(w.rec_med_bmi) AS n
  FROM d_wide w JOIN d_stores s ON s.id = w.store_id GROUP BY 1, 2
  UNION ALL
  SELECT 'Stress', s.partner_id, round(avg(w.rec_ls_stress_sum), 1), count(w.rec_ls_stress_sum)
  FROM d_wide w JOIN d_stores s ON s.id = w.store_id GROUP BY 1, 2)
SELECT metric, """ + ", ".join(f"max(CASE WHEN region = {k} THEN printf('%.1f (n=%d)', m, n) END) AS region_{k}"
                              for k in range(5)) + " FROM g GROUP BY metric")
def q_pivot_text(spark, sf_dir):
    d = Domain(spark, sf_dir)
    w = wide(d).join(d.stores.select(F.col("id").alias("store_id"), F.col("partner_id").alias("region")), "store_id")
    long = describe.measures_long(w, {"BMI": "rec_med_bmi", "Stress": "rec_ls_stress_sum"}, ids=["region"])
    return describe.pivot_text(long, "measure", "region", "value", list(range(5)), "region_").withColumnRenamed(
        "measure", "metric")


# --------------------------------------------------------------------------
# The variable explorer and profiles alike
# --------------------------------------------------------------------------

from pulseframe.operators import explorer, similarity  # noqa: E402

EXPLORED = [
    explorer.Variable("rec_age_current", "Leeftijd", "histogram", split_gender=True),
    explorer.Variable("balance", "Saldo", "histogram", outlier_max=9000),
    explorer.Variable("rec_ls_lifestyle_score", "Leefstijl", "histogram", split_gender=True, scale=0.2),
    explorer.Variable("rec_ls_stress_sum", "Stress", "histogram", scale=0.2),
    explorer.Variable("rec_med_bmi_cat", "BMI", "bar", labels=rules.BMI_LABELS),
    explorer.Variable("rec_heartrisk_cat", "Hartrisico", "bar"),
    explorer.Variable("rec_ls_stress_cat", "Stress", "pie", labels={0: "Laag", 2: "Hoog"}),
    explorer.Variable("store_id", "Winkel", "pie"),
    explorer.Variable("rec_med_bmi", "BMI", "box", split_gender=True, outlier_max=45),
    explorer.Variable("rec_heartrisk", "Hartrisico", "box"),
    explorer.Variable("not_there", "Ontbreekt", "box"),
]


def _explored_sql(v: explorer.Variable) -> str:
    """The figures of one variable from its own pass over the table."""
    split = v.split_gender and v.plot_type in ("histogram", "box")
    gender = "CASE rec_user_gender WHEN 1 THEN 'Man' ELSE 'Vrouw' END" if split else "'totaal'"
    value = f"round_even(CAST({v.column} AS DOUBLE) * {v.scale} * 10, 0) / 10" if v.scale else f"CAST({v.column} AS DOUBLE)"
    limit = f" AND {value} <= {v.outlier_max}" if v.outlier_max is not None else ""
    base = (f"SELECT {gender} AS gender, {value} AS v, CAST({v.column} AS DOUBLE) AS code FROM d_wide "
            f"WHERE rec_user_gender IN (0, 1) AND {value} IS NOT NULL{limit}")
    head = f"'{v.column}' AS variable, '{v.label}' AS label, '{v.plot_type}' AS plot_type, gender"
    if v.plot_type == "histogram":
        if split and (v.scale is not None or v.max_score is not None):
            lo, hi = v.min_score or 0.0, v.max_score or 10.0
            x = f"{lo} + least(floor((v - {lo}) / 0.5), {int((hi - lo) / 0.5) - 1}) * 0.5"
            rows, cond = f"({base})", f"WHERE v BETWEEN {lo} AND {hi}"
        else:
            x = "lo + CASE WHEN hi = lo THEN 0 ELSE least(floor((v - lo) / ((hi - lo) / 30)), 29) END * ((hi - lo) / 30)"
            rows, cond = f"(SELECT *, min(v) OVER () AS lo, max(v) OVER () AS hi FROM ({base}))", ""
        return (f"SELECT {head}, 'bin' AS item, {r(x)} AS x, count(*) AS n, CAST(count(*) AS DOUBLE) AS value "
                f"FROM {rows} {cond} GROUP BY gender, x")
    if v.plot_type in ("bar", "pie"):
        if v.labels:
            item = "CASE code " + " ".join(f"WHEN {k} THEN '{t}'" for k, t in v.labels.items()) + " END"
        else:
            item = "CAST(v AS VARCHAR)"
        figure = "count(*) * 100.0 / sum(count(*)) OVER ()" if v.plot_type == "bar" else "CAST(count(*) AS DOUBLE)"
        return (f"SELECT {head}, item, x, count(*) AS n, {r(figure)} AS value FROM (SELECT gender, {item} AS item, "
                f"{'code' if v.labels else 'v'} AS x FROM ({base})) WHERE item IS NOT NULL GROUP BY gender, item, x")
    stats = {"mean": "avg(v)", "min": "min(v)", "max": "max(v)", "q1": "quantile_cont(v, 0.25)",
             "median": "quantile_cont(v, 0.5)", "q3": "quantile_cont(v, 0.75)"}
    return " UNION ALL ".join(f"SELECT {head}, '{k}' AS item, CAST(NULL AS DOUBLE) AS x, count(*) AS n, {r(e)} AS value "
                              f"FROM ({base}) GROUP BY gender" for k, e in stats.items())


@register("variable_explorer", W + " UNION ALL ".join(f"({_explored_sql(v)})" for v in EXPLORED if v.column != "not_there"))
def q_variable_explorer(spark, sf_dir):
    return explorer.variable_explorer(_w(spark, sf_dir), EXPLORED)


PROFILE = ["rec_med_bmi", "rec_heartrisk", "rec_ls_stress_sum", "rec_age_current", "rec_ls_lifestyle_score", "store_id"]
_Z = ", ".join(f"coalesce((x{i} - avg(x{i}) OVER ()) / nullif(stddev_pop(x{i}) OVER (), 0), 0) AS z{i}" for i in range(len(PROFILE)))
_DOT = " + ".join(f"a.z{i} / a.nrm * (b.z{i} / b.nrm)" for i in range(len(PROFILE)))


@register("profile_duplicates", W + f""", x AS (SELECT user_id AS id, {", ".join(f"coalesce(CAST({c} AS DOUBLE), 0) AS x{i}" for i, c in enumerate(PROFILE))}
  FROM d_wide WHERE user_id IS NOT NULL),
z AS (SELECT id, {_Z} FROM x),
c AS (SELECT min(id) AS class_id, count(*) AS class_size, sqrt({" + ".join(f"z{i} * z{i}" for i in range(len(PROFILE)))}) AS nrm,
  {", ".join(f"z{i}" for i in range(len(PROFILE)))} FROM z GROUP BY {", ".join(f"z{i}" for i in range(len(PROFILE)))}),
l AS (SELECT a.class_id, sum(b.class_size) AS links, max(round({_DOT}, 9)) AS best FROM c a JOIN c b ON a.class_id <> b.class_id
  AND a.nrm > 0 AND b.nrm > 0 AND round({_DOT}, 9) > 0.9 GROUP BY 1)
SELECT z.id AS user_id, c.class_id, c.class_size,
  CAST(coalesce(l.links, 0) + CASE WHEN c.nrm > 0 THEN c.class_size - 1 ELSE 0 END AS BIGINT) AS n_links, {r("l.best", 6)} AS best_similarity
FROM z JOIN c USING ({", ".join(f"z{i}" for i in range(len(PROFILE)))}) LEFT JOIN l USING (class_id)""")
def q_profile_duplicates(spark, sf_dir):
    return similarity.profile_links(_w(spark, sf_dir), "user_id", PROFILE)
