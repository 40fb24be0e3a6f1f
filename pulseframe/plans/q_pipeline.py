"""Registered pipeline queries: dedupe, pivot, consolidate, averages, upsert."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulseframe.operators import reshape
from pulseframe.plans import consolidate
from pulseframe.plans.bindings import BINDING_SCORE_COLUMNS, BINDING_SLUG_COLUMNS, Domain, views, wide
from pulseframe.plans.catalog import r, register
from pulseframe.sources import sinks

SCORES = BINDING_SCORE_COLUMNS


# --------------------------------------------------------------------------
# latest / first per key, pivot, unpivot
# --------------------------------------------------------------------------

@register("latest_per_key", views("latest") + "SELECT * FROM d_latest")
def q_latest_per_key(spark, sf_dir):
    h = Domain(spark, sf_dir).history.select("participant_id", "slug", "score_value", "completion_created_at", "id")
    return reshape.latest_per_key(h, ["participant_id", "slug"], "completion_created_at", ["id"])


FIRST_SQL = views("history") + """SELECT participant_id, slug, score_value, completion_created_at, id FROM (
    SELECT *, row_number() OVER (PARTITION BY participant_id, slug
        ORDER BY (completion_created_at IS NULL), completion_created_at, id, score_value) AS rn
    FROM d_history WHERE slug IS NOT NULL) WHERE rn = 1"""


@register("first_per_key", FIRST_SQL)
def q_first_per_key(spark, sf_dir):
    h = Domain(spark, sf_dir).history.select("participant_id", "slug", "score_value", "completion_created_at", "id")
    return reshape.first_per_key(h, ["participant_id", "slug"], "completion_created_at", ["id"])


PIVOT_SQL = views("latest") + """SELECT participant_id,
    max(CASE WHEN slug = 'A' THEN score_value END) AS rec_med_bmi,
    max(CASE WHEN slug = 'N' THEN score_value END) AS rec_heartrisk,
    max(CASE WHEN slug = 'R' THEN score_value END) AS rec_ls_stress_sum
    FROM d_latest GROUP BY participant_id"""


@register("pivot_scores", PIVOT_SQL)
def q_pivot_scores(spark, sf_dir):
    return consolidate.latest_scores_wide(Domain(spark, sf_dir).history, BINDING_SLUG_COLUMNS)


@register("consolidate_scores", views("wide") + "SELECT * FROM d_wide")
def q_consolidate_scores(spark, sf_dir):
    from pulseframe.plans.bindings import wide_plan
    return wide_plan(Domain(spark, sf_dir))


UNPIVOT_SQL = views("wide") + " UNION ALL ".join(
    f"SELECT user_id, '{c}' AS score_slug, CAST({c} AS DOUBLE) AS score_value FROM d_wide WHERE {c} IS NOT NULL"
    for c in SCORES)


@register("unpivot_scores", UNPIVOT_SQL)
def q_unpivot_scores(spark, sf_dir):
    return reshape.unpivot_columns(wide(Domain(spark, sf_dir)), ["user_id"], SCORES)


WIDE_REC_COLUMNS = ["rec_med_bmi", "rec_heartrisk", "rec_ls_stress_sum", "rec_user_gender", "rec_age_current",
                    "rec_heartrisk_cat", "rec_med_bmi_cat", "rec_ls_stress_cat", "rec_med_age_cat",
                    "rec_ls_lifestyle_score", "rec_ls_sleep_cat"]

STORE_AVG_SQL = views("wide") + ", long AS (" + " UNION ALL ".join(
    f"SELECT user_id, store_id, latest_completion_at, '{c}' AS score_slug, CAST({c} AS DOUBLE) AS v FROM d_wide"
    f" WHERE {c} IS NOT NULL AND user_id IS NOT NULL AND store_id IS NOT NULL AND latest_completion_at IS NOT NULL"
    for c in WIDE_REC_COLUMNS) + f""")
SELECT store_id, score_slug, CAST(date_trunc('month', latest_completion_at) AS TIMESTAMP) AS date,
       {r('avg(v)')} AS average, count(DISTINCT user_id) AS participants_count
FROM long GROUP BY ALL"""


@register("store_month_averages", STORE_AVG_SQL)
def q_store_month_averages(spark, sf_dir):
    return consolidate.store_month_averages(wide(Domain(spark, sf_dir)))


# --------------------------------------------------------------------------
# upsert: an earlier snapshot (scores before 1999) updated by the newer batch
# --------------------------------------------------------------------------

CUTOFF = "1999-01-01"


def _snapshot_frames(d: Domain):
    h = d.history
    old = consolidate.latest_scores_wide(h.where(F.col("completion_created_at") < F.lit(CUTOFF).cast("timestamp_ntz")),
                                         BINDING_SLUG_COLUMNS)
    target = old.join(d.participants.select(F.col("id").alias("participant_id"), "segment"), "participant_id")
    newer = consolidate.latest_scores_wide(h.where(F.col("completion_created_at") >= F.lit(CUTOFF).cast("timestamp_ntz")),
                                           BINDING_SLUG_COLUMNS)
    last = (d.completions.where(F.col("created_at") >= F.lit(CUTOFF).cast("timestamp_ntz"))
            .groupBy("participant_id").agg(F.max("created_at").alias("latest_completion_at")))
    incoming = newer.join(last, "participant_id", "left")
    return target, incoming


def _latest_wide_sql(cond: str) -> str:
    return f"""SELECT participant_id,
        max(CASE WHEN slug = 'A' THEN score_value END) AS rec_med_bmi,
        max(CASE WHEN slug = 'N' THEN score_value END) AS rec_heartrisk,
        max(CASE WHEN slug = 'R' THEN score_value END) AS rec_ls_stress_sum
      FROM (SELECT *, row_number() OVER (PARTITION BY participant_id, slug
              ORDER BY completion_created_at DESC, id DESC, score_value DESC) AS rn
            FROM d_history WHERE slug IS NOT NULL AND {cond}) WHERE rn = 1 GROUP BY participant_id"""


UPSERT_CTES = views("history", "participants", "completions", extra=[
    ("old_w", _latest_wide_sql(f"completion_created_at < TIMESTAMP '{CUTOFF}'")),
    ("tgt", "SELECT o.*, p.segment FROM old_w o JOIN d_participants p ON p.id = o.participant_id"),
    ("new_w", _latest_wide_sql(f"completion_created_at >= TIMESTAMP '{CUTOFF}'")),
    ("lastc", f"""SELECT participant_id, max(created_at) AS latest_completion_at FROM d_completions
                 WHERE created_at >= TIMESTAMP '{CUTOFF}' GROUP BY participant_id"""),
    ("inc", "SELECT n.*, l.latest_completion_at FROM new_w n LEFT JOIN lastc l USING (participant_id)"),
    ("merged", """SELECT coalesce(o.participant_id, n.participant_id) AS participant_id, o.segment,
        CASE WHEN n.participant_id IS NOT NULL THEN n.rec_med_bmi ELSE o.rec_med_bmi END AS rec_med_bmi,
        CASE WHEN n.participant_id IS NOT NULL THEN n.rec_heartrisk ELSE o.rec_heartrisk END AS rec_heartrisk,
        CASE WHEN n.participant_id IS NOT NULL THEN n.rec_ls_stress_sum ELSE o.rec_ls_stress_sum END
            AS rec_ls_stress_sum,
        n.latest_completion_at,
        CASE WHEN n.participant_id IS NOT NULL AND o.participant_id IS NOT NULL THEN 'update'
             WHEN n.participant_id IS NOT NULL THEN 'insert' ELSE 'keep' END AS op
        FROM tgt o FULL OUTER JOIN inc n ON o.participant_id = n.participant_id"""),
])


@register("upsert", UPSERT_CTES + "SELECT * FROM merged")
def q_upsert(spark, sf_dir):
    target, incoming = _snapshot_frames(Domain(spark, sf_dir))
    return sinks.upsert_frames(target, incoming, ["participant_id"]).withColumnRenamed("_op", "op")


UPSERT_KEYED_SQL = UPSERT_CTES + "SELECT * EXCLUDE (op) FROM merged"


@register("upsert_keyed", UPSERT_KEYED_SQL)
def q_upsert_keyed(spark, sf_dir):
    """The stored table after the batch: only buckets with its keys are rewritten."""
    import uuid

    from pulseframe.session import ensure_checkpoint_dir
    from pulseframe.sources.keyed import KeyedTable
    target, incoming = _snapshot_frames(Domain(spark, sf_dir))
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/keyed/{uuid.uuid4().hex[:12]}"
    table = KeyedTable(spark, path, ["participant_id"], buckets=16)
    table.upsert(target)
    table.upsert(incoming)
    return table.read()


@register("upsert_counts", UPSERT_CTES + """SELECT
    CAST(sum(CASE WHEN op = 'insert' THEN 1 ELSE 0 END) AS BIGINT) AS inserted,
    CAST(sum(CASE WHEN op = 'update' THEN 1 ELSE 0 END) AS BIGINT) AS updated,
    CAST(sum(CASE WHEN op = 'keep' THEN 1 ELSE 0 END) AS BIGINT) AS kept,
    count(*) AS total,
    (SELECT count(*) FROM tgt) AS rows_before,
    count(*) - (SELECT count(*) FROM tgt) AS rows_added
    FROM merged""")
def q_upsert_counts(spark, sf_dir):
    target, incoming = _snapshot_frames(Domain(spark, sf_dir))
    counts = sinks.upsert_counts(sinks.upsert_frames(target.select("participant_id"),
                                                     incoming.select("participant_id"), ["participant_id"]))
    return (counts.withColumn("rows_before", F.col("updated") + F.col("kept"))
                  .withColumn("rows_added", F.col("inserted")))


# --------------------------------------------------------------------------
# factor join, unions, set operations, combinations, pivots
# --------------------------------------------------------------------------

FACTORS = [("A", "bmi"), ("N", "heartrisk")]


@register("join_factor_slug", views("history") + """SELECT h.id, h.participant_id, f.slug, h.score_value,
    h.completion_created_at FROM d_history h JOIN (VALUES ('A', 'bmi'), ('N', 'heartrisk')) f(fid, slug)
    ON h.slug = f.fid""")
def q_join_factor_slug(spark, sf_dir):
    d = Domain(spark, sf_dir)
    factors = spark.createDataFrame(FACTORS, "id string, slug string")
    h = d.history.select("id", "participant_id", F.col("slug").alias("questionnaire_factor_id"), "score_value",
                         "completion_created_at")
    return consolidate.join_factor_slug(h, factors)


@register("union_bmi_history", views("wide", "history", "completions") + """
    SELECT id, participant_id, slug, completion_id, score_value, completion_created_at, 'history' AS source FROM d_history
    UNION ALL
    SELECT NULL, w.participant_id, 'bmi', NULL, w.rec_med_bmi, c.at, 'latest' FROM d_wide w
    LEFT JOIN (SELECT participant_id, max(created_at) AS at FROM d_completions GROUP BY 1) c USING (participant_id)
    WHERE w.rec_med_bmi IS NOT NULL""")
def q_union_bmi_history(spark, sf_dir):
    """The whole history, and every participant's BMI dated by its last completion."""
    from pulseframe.operators.longitudinal import bmi_as_history
    d = Domain(spark, sf_dir)
    hist = d.history.select("id", "participant_id", "slug", "completion_id", "score_value", "completion_created_at",
                            F.lit("history").alias("source"))
    bmi = bmi_as_history(wide(d), d.completions).withColumn("source", F.lit("latest"))
    return sinks.schema_evolve(hist, bmi)


@register("set_ops", views("history", "interactions") + """,
    a AS (SELECT DISTINCT participant_id AS k FROM d_history WHERE participant_id IS NOT NULL),
    b AS (SELECT DISTINCT user_id AS k FROM d_interactions WHERE user_id IS NOT NULL)
    SELECT (SELECT count(*) FROM a) AS n_a, (SELECT count(*) FROM b) AS n_b,
           (SELECT count(*) FROM (SELECT k FROM a UNION SELECT k FROM b)) AS n_union,
           (SELECT count(*) FROM (SELECT k FROM a INTERSECT SELECT k FROM b)) AS n_intersect,
           (SELECT count(*) FROM (SELECT k FROM a EXCEPT SELECT k FROM b)) AS n_a_minus_b,
           (SELECT count(*) FROM (SELECT k FROM b EXCEPT SELECT k FROM a)) AS n_b_minus_a""")
def q_set_ops(spark, sf_dir):
    d = Domain(spark, sf_dir)
    return reshape.id_set_ops(d.history.select(F.col("participant_id").alias("k")),
                              d.interactions.select(F.col("user_id").alias("k")), "k")


@register("combinations_list", views("completions") + """SELECT combination, n_participants FROM (
    SELECT combination, count(*) AS n_participants FROM (
      SELECT participant_id, array_to_string(list_sort(list(DISTINCT questionnaire_id)), ' + ') AS combination
      FROM d_completions WHERE questionnaire_id IS NOT NULL GROUP BY participant_id)
    GROUP BY combination) ORDER BY n_participants DESC, combination LIMIT 10""")
def q_combinations_list(spark, sf_dir):
    d = Domain(spark, sf_dir)
    combos = reshape.combinations_list(d.completions, "participant_id", "questionnaire_id")
    return combos.orderBy(F.col("n_participants").desc(), "combination").limit(10)


@register("pivot_mean", views("history") + f"""SELECT participant_id, year(completion_created_at) AS year,
    {r("avg(CASE WHEN slug = 'A' THEN score_value END)")} AS a,
    {r("avg(CASE WHEN slug = 'N' THEN score_value END)")} AS n,
    {r("avg(CASE WHEN slug = 'R' THEN score_value END)")} AS r
    FROM d_history GROUP BY ALL""")
def q_pivot_mean(spark, sf_dir):
    h = Domain(spark, sf_dir).history.withColumn("year", F.year("completion_created_at"))
    return reshape.pivot_mean(h, ["participant_id", "year"], "slug", ["A", "N", "R"], "score_value")


@register("group_aggregate", views("wide") + f"""SELECT segment, rec_heartrisk_cat, count(*) AS n,
    {r('avg(rec_ls_lifestyle_score)')} AS mean_lifestyle, {r('sum(rec_med_bmi)', 2)} AS sum_bmi
    FROM d_wide GROUP BY ALL""")
def q_group_aggregate(spark, sf_dir):
    from pulseframe.operators.describe import group_aggregate
    return group_aggregate(wide(Domain(spark, sf_dir)), ["segment", "rec_heartrisk_cat"],
                           {"n": F.count(F.lit(1)), "mean_lifestyle": F.avg("rec_ls_lifestyle_score"),
                            "sum_bmi": F.round(F.sum("rec_med_bmi"), 2)})


# --------------------------------------------------------------------------
# sources: table scans, unique parquet, sniffed CSV import, import validation
# --------------------------------------------------------------------------

from pulseframe.plans.bindings import TABLES, Tables  # noqa: E402
from pulseframe.sources import readers  # noqa: E402


@register("scan_table", " UNION ALL ".join(f"SELECT '{t}' AS \"table\", count(*) AS rows FROM {t}" for t in TABLES))
def q_scan_table(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return readers.row_counts({name: readers.read_table(spark, f"{t.sf_dir}/{name}.parquet") for name in TABLES})


@register("scan_parquet", """SELECT event_id, ts, user_id, event_type, value, props FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events
    WHERE user_id IS NOT NULL) WHERE rn = 1""")
def q_scan_parquet(spark, sf_dir):
    out = readers.read_parquet_unique(spark, f"{sf_dir.rstrip('/')}/events.parquet", "user_id", order="ts")
    return out.select("event_id", "ts", "user_id", "event_type", "value", "props")


def _customer_csv(spark, sf_dir) -> str:
    """Export the customer table as CSV files under the shared folder."""
    import uuid

    from pulseframe.session import ensure_checkpoint_dir
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/imports/customer-{uuid.uuid4().hex[:12]}"
    Tables(spark, sf_dir).customer.write.option("header", True).csv(path)
    return path


def _customer_csv_layouts(spark, sf_dir) -> list[str]:
    """The customer table as CSV files of three layouts: as it is, with another
    separator and order, and without the segment."""
    import uuid

    from pulseframe.session import ensure_checkpoint_dir
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/imports/layouts-{uuid.uuid4().hex[:12]}"
    c = Tables(spark, sf_dir).customer
    kinds = [(c.columns, ","), (c.columns[::-1], ";"), ([x for x in c.columns if x != "c_mktsegment"], ",")]
    for i, (columns, sep) in enumerate(kinds):
        (c.where(F.col("c_custkey") % 3 == i).select(*columns)
         .write.option("header", True).option("sep", sep).csv(f"{base}/{i}"))
    return [f"{base}/{i}" for i in range(len(kinds))]


@register("scan_csv_sniffed", """SELECT c_custkey, c_name, c_nationkey, c_acctbal,
    CASE WHEN c_custkey % 3 < 2 THEN c_mktsegment END AS c_mktsegment FROM customer""")
def q_scan_csv_sniffed(spark, sf_dir):
    """Files of three layouts, each read by its own and aligned by name."""
    schema = Tables(spark, sf_dir).customer.schema
    return readers.read_csv_sniffed(spark, _customer_csv_layouts(spark, sf_dir), schema=schema, terms=["c_custkey"])


IMPORT_ALIASES = {"c_custkey": "id", "c_nationkey": "store_id", "c_mktsegment": "segment", "c_name": "name"}
IMPORT_NOW = "2001-09-01 00:00:00"


@register("upload_validate", f"""SELECT CAST(c_custkey AS VARCHAR) AS id, CAST(c_custkey AS VARCHAR) AS user_id,
    CAST(c_nationkey AS VARCHAR) AS store_id, c_mktsegment AS segment, TIMESTAMP '{IMPORT_NOW}' AS created_at
    FROM customer""")
def q_upload_validate(spark, sf_dir):
    raw = readers.read_csv_sniffed(spark, _customer_csv(spark, sf_dir), terms=["c_custkey"])
    return readers.upload_validate(raw, ["id", "user_id", "store_id", "segment", "created_at"],
                                   aliases=IMPORT_ALIASES, now=IMPORT_NOW)


PERIODS = [("tot_1997", None, "1997-01-01"), ("1997_1999", "1997-01-01", "1999-01-01"), ("vanaf_1999", "1999-01-01", None)]


def _period_wide(h, lo, hi):
    c = F.col("completion_created_at")
    cond = F.lit(True)
    if lo:
        cond = cond & (c >= F.lit(lo).cast("timestamp_ntz"))
    if hi:
        cond = cond & (c < F.lit(hi).cast("timestamp_ntz"))
    return consolidate.latest_scores_wide(h.where(cond), BINDING_SLUG_COLUMNS)


def _merge_sql() -> str:
    ctes = []
    for name, lo, hi in PERIODS:
        conds = ["TRUE"] + ([f"completion_created_at >= TIMESTAMP '{lo}'"] if lo else []) + \
                ([f"completion_created_at < TIMESTAMP '{hi}'"] if hi else [])
        ctes.append((f"k_{name}", f"SELECT DISTINCT participant_id FROM d_history WHERE slug IN ('A', 'N', 'R') AND "
                                  + " AND ".join(conds)))
    body = views("history", extra=ctes)
    n1, n2, n3 = [f"k_{p[0]}" for p in PERIODS]
    return body + f"""
SELECT 1 AS step, '{PERIODS[0][0]}' AS source, count(*) AS rows, count(*) AS inserted, CAST(0 AS BIGINT) AS updated
FROM {n1}
UNION ALL
SELECT 2, '{PERIODS[1][0]}', count(*), count(*) FILTER (WHERE participant_id NOT IN (SELECT participant_id FROM {n1})),
       count(*) FILTER (WHERE participant_id IN (SELECT participant_id FROM {n1})) FROM {n2}
UNION ALL
SELECT 3, '{PERIODS[2][0]}', count(*),
       count(*) FILTER (WHERE participant_id NOT IN (SELECT participant_id FROM {n1} UNION SELECT participant_id FROM {n2})),
       count(*) FILTER (WHERE participant_id IN (SELECT participant_id FROM {n1} UNION SELECT participant_id FROM {n2}))
FROM {n3}"""


@register("merge_sources", _merge_sql())
def q_merge_sources(spark, sf_dir):
    h = Domain(spark, sf_dir).history
    srcs = [(name, _period_wide(h, lo, hi)) for name, lo, hi in PERIODS]
    return sinks.merge_sources(srcs, ["participant_id"], checkpoint_every=1)[1]


@register("schema_evolve", views("purchases", "article_views") + """
SELECT * FROM d_purchases UNION ALL BY NAME SELECT * FROM d_article_views""")
def q_schema_evolve(spark, sf_dir):
    from pulseframe.plans.bindings import article_views, purchases
    d = Domain(spark, sf_dir)
    return sinks.schema_evolve(purchases(d), article_views(d))


def _out_path(spark, name):
    import uuid

    from pulseframe.session import ensure_checkpoint_dir
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/exports/{name}-{uuid.uuid4().hex[:12]}"


@register("sink_table", STORE_AVG_SQL)
def q_sink_table(spark, sf_dir):
    path = _out_path(spark, "store_average_scores")
    sinks.write_table(consolidate.store_month_averages(wide(Domain(spark, sf_dir))), path)
    return spark.read.parquet(path)


@register("sink_csv", STORE_AVG_SQL)
def q_sink_csv(spark, sf_dir):
    avg = consolidate.store_month_averages(wide(Domain(spark, sf_dir)))
    path = _out_path(spark, "store_average_scores_csv")
    sinks.write_csv(avg, path)
    return spark.read.schema(avg.schema).option("header", True).csv(path)


@register("participants_expanded", views("wide", "history", extra=[("lat", _latest_wide_sql(
    f"completion_created_at >= TIMESTAMP '{CUTOFF}'"))]) + """,
m AS (SELECT w.participant_id, w.user_id, coalesce(l.rec_med_bmi, w.rec_med_bmi) AS rec_med_bmi,
             coalesce(l.rec_heartrisk, w.rec_heartrisk) AS rec_heartrisk,
             coalesce(l.rec_ls_stress_sum, w.rec_ls_stress_sum) AS rec_ls_stress_sum, w.rec_user_gender
      FROM d_wide w LEFT JOIN lat l ON l.participant_id = w.participant_id)
SELECT *, CASE WHEN (rec_med_bmi IS NOT NULL)::INT + (rec_heartrisk IS NOT NULL)::INT + (rec_ls_stress_sum IS NOT NULL)::INT > 0
    THEN round((coalesce(rec_med_bmi, 0) + coalesce(rec_heartrisk, 0) + coalesce(rec_ls_stress_sum, 0))
         / ((rec_med_bmi IS NOT NULL)::INT + (rec_heartrisk IS NOT NULL)::INT + (rec_ls_stress_sum IS NOT NULL)::INT), 6)
    END AS rec_ls_lifestyle_score FROM m""")
def q_participants_expanded(spark, sf_dir):
    from pulseframe.functions.semantics import row_mean
    from pulseframe.operators.linking import merge_latest_over
    d = Domain(spark, sf_dir)
    base = wide(d).select("participant_id", "user_id", *SCORES, "rec_user_gender")
    lat = consolidate.latest_scores_wide(d.history.where(F.col("completion_created_at")
                                                         >= F.lit(CUTOFF).cast("timestamp_ntz")), BINDING_SLUG_COLUMNS)
    m = merge_latest_over(base, lat, "participant_id", SCORES)
    return m.withColumn("rec_ls_lifestyle_score", row_mean(SCORES))


@register("participants_with_factor_scores", views("history", "participants") + """,
lat AS (SELECT participant_id, slug, score_value FROM (
    SELECT *, row_number() OVER (PARTITION BY participant_id, slug
        ORDER BY completion_created_at DESC NULLS LAST, id DESC, score_value DESC) AS rn
    FROM d_history WHERE slug IN ('A', 'N', 'R') AND score_value IS NOT NULL) WHERE rn = 1),
piv AS (SELECT participant_id, max(CASE WHEN slug = 'A' THEN score_value END) AS rec_med_bmi,
               max(CASE WHEN slug = 'N' THEN score_value END) AS rec_heartrisk,
               max(CASE WHEN slug = 'R' THEN score_value END) AS rec_ls_stress_sum FROM lat GROUP BY 1)
SELECT p.id AS participant_id, coalesce(p.user_id, p.id) AS user_id, p.store_id, p.age AS rec_age_current,
       p.postal_code, p.segment, piv.rec_med_bmi, piv.rec_heartrisk, piv.rec_ls_stress_sum,
       CAST(CASE WHEN p.gender_raw = '1' THEN 1 WHEN p.gender_raw = '0' THEN 0 END AS INTEGER) AS rec_user_gender,
       CAST(CASE WHEN rec_heartrisk >= 20 THEN 2 WHEN rec_heartrisk >= 10 THEN 1 ELSE 0 END AS INTEGER) AS rec_heartrisk_cat,
       CAST(CASE WHEN rec_med_bmi >= 30 THEN 2 WHEN rec_med_bmi >= 25 THEN 1 WHEN rec_med_bmi >= 18.5 THEN 0
                 ELSE -1 END AS INTEGER) AS rec_med_bmi_cat,
       CAST(CASE WHEN rec_ls_stress_sum >= 40 THEN 2 WHEN rec_ls_stress_sum >= 20 THEN 1 ELSE 0 END AS INTEGER)
           AS rec_ls_stress_cat,
       CAST(CASE WHEN p.age >= 55 THEN 2 WHEN p.age >= 40 THEN 1 ELSE 0 END AS INTEGER) AS rec_med_age_cat
FROM d_participants p JOIN piv ON piv.participant_id = p.id""")
def q_participants_with_factor_scores(spark, sf_dir):
    d = Domain(spark, sf_dir)
    return consolidate.participants_with_factor_scores(d.participants, d.history, BINDING_SLUG_COLUMNS)
