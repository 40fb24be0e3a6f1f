"""Registered model queries.

Evaluation tables (threshold scan, confusion matrix, PR curve, bias checks)
run on deterministic stand-in predictions derived from ``documents`` and
``labels`` and are SQL-checked. Trained models (tree ensembles, k-means) are
checked for rows and schema only.
"""

from __future__ import annotations

from functools import partial, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseframe.functions import rules
from pulseframe.operators import behaviour, models
from pulseframe.plans.bindings import Domain, Tables, purchases, wide
from pulseframe.plans.catalog import r, register

# --------------------------------------------------------------------------
# stand-in predictions: label = quality + toxic (0..2); probabilities from length
# --------------------------------------------------------------------------

SCORED_SQL = """WITH s AS (SELECT d.doc_id, d.lang, CAST(l.quality + l.toxic AS DOUBLE) AS label,
    least(CAST(d.n_chars AS DOUBLE) / 20000, 1.0) AS p_high, CAST(d.n_chars % 1000 AS DOUBLE) / 1000 AS p_moderate,
    CAST(l.quality AS DOUBLE) AS quality, CAST(d.n_chars AS DOUBLE) / 1000 AS y_len,
    CAST(len(string_split(d.text, ' ')) AS DOUBLE) * 6 / 1000 AS y_hat
    FROM labels l JOIN documents d ON d.doc_id = l.doc_id)
"""


def scored(spark, sf_dir):
    t = Tables(spark, sf_dir)
    d = t.documents.select("doc_id", "lang", "n_chars", "text")
    lab = t.labels
    return d.join(lab, "doc_id").select(
        "doc_id", "lang", (F.col("quality") + F.col("toxic")).cast("double").alias("label"),
        F.least(F.col("n_chars").cast("double") / 20000, F.lit(1.0)).alias("p_high"),
        ((F.col("n_chars") % 1000).cast("double") / 1000).alias("p_moderate"),
        F.col("quality").cast("double").alias("quality"),
        (F.col("n_chars").cast("double") / 1000).alias("y_len"),
        (F.size(F.split("text", " ")).cast("double") * 6 / 1000).alias("y_hat"))


@register("threshold_scan", SCORED_SQL + f""",
g AS (SELECT CAST(round(0.10 + i * 0.05, 2) AS DOUBLE) AS t FROM range(16) r(i)),
p AS (SELECT a.t AS t_high, b.t AS t_moderate, s.label,
             CASE WHEN s.p_high >= a.t THEN 2 WHEN s.p_moderate >= b.t THEN 1 ELSE 0 END AS pred
      FROM s, g a, g b),
pc AS (SELECT t_high, t_moderate, label, avg(CASE WHEN pred = label THEN 1.0 ELSE 0.0 END) AS rc FROM p GROUP BY ALL)
SELECT t_high, t_moderate, CAST(round(CAST(avg(rc) AS DECIMAL(28,12)), 3) AS DOUBLE) AS macro_recall,
       CAST(round(CAST(coalesce(max(rc) FILTER (label = 0), 0) AS DECIMAL(28,12)), 3) AS DOUBLE) AS recall_low,
       CAST(round(CAST(coalesce(max(rc) FILTER (label = 1), 0) AS DECIMAL(28,12)), 3) AS DOUBLE) AS recall_moderate,
       CAST(round(CAST(coalesce(max(rc) FILTER (label = 2), 0) AS DECIMAL(28,12)), 3) AS DOUBLE) AS recall_high
FROM pc GROUP BY t_high, t_moderate ORDER BY macro_recall DESC, t_moderate, t_high LIMIT 5""")
def q_threshold_scan(spark, sf_dir):
    return models.threshold_scan(scored(spark, sf_dir))


@register("apply_thresholds", SCORED_SQL + """SELECT doc_id, label,
    CAST(CASE WHEN p_high >= 0.25 THEN 2 WHEN p_moderate >= 0.5 THEN 1 ELSE 0 END AS DOUBLE) AS prediction FROM s""")
def q_apply_thresholds(spark, sf_dir):
    return models.apply_thresholds(scored(spark, sf_dir), 0.25, 0.5).select("doc_id", "label", "prediction")


@register("confusion_matrix", SCORED_SQL + """, p AS (SELECT label,
    CAST(CASE WHEN p_high >= 0.25 THEN 2 WHEN p_moderate >= 0.5 THEN 1 ELSE 0 END AS DOUBLE) AS prediction FROM s),
grid AS (SELECT CAST(a AS DOUBLE) AS actual, CAST(b AS DOUBLE) AS predicted FROM (VALUES (0), (1), (2)) x(a), (VALUES (0), (1), (2)) y(b))
SELECT grid.actual, grid.predicted, coalesce(c.n, 0) AS n FROM grid
LEFT JOIN (SELECT label AS actual, prediction AS predicted, count(*) AS n FROM p GROUP BY ALL) c
ON c.actual = grid.actual AND c.predicted = grid.predicted""")
def q_confusion_matrix(spark, sf_dir):
    p = models.apply_thresholds(scored(spark, sf_dir), 0.25, 0.5)
    return models.confusion_matrix(p, [0.0, 1.0, 2.0])


@register("pr_curve", SCORED_SQL + f""", per AS (SELECT p_high AS threshold,
    sum(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS tp0, sum(CASE WHEN quality = 1 THEN 0 ELSE 1 END) AS fp0
    FROM s GROUP BY 1),
c AS (SELECT threshold, sum(tp0) OVER (ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING) AS tp,
             sum(fp0) OVER (ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING) AS fp,
             (SELECT sum(tp0) FROM per) AS pos FROM per)
SELECT {r('threshold')} AS threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp,
       {r('tp / (tp + fp)')} AS precision, {r('tp / pos')} AS recall FROM c""")
def q_pr_curve(spark, sf_dir):
    s = scored(spark, sf_dir).withColumn("label", F.col("quality"))
    return models.pr_curve(s, 1.0, score="p_high")


def _bias_cls_sql() -> str:
    parts = []
    rec, prec, f1 = [], [], []
    for c in (0, 1, 2):
        tp = f"sum(CASE WHEN label = {c} AND prediction = {c} THEN 1 ELSE 0 END)"
        a = f"sum(CASE WHEN label = {c} THEN 1 ELSE 0 END)"
        p = f"sum(CASE WHEN prediction = {c} THEN 1 ELSE 0 END)"
        rc = f"coalesce({tp} / nullif({a}, 0), 0.0)"
        pc = f"coalesce({tp} / nullif({p}, 0), 0.0)"
        parts += [f"{r(f'round({rc}, 3)')} AS recall_{c}", f"{r(f'round({pc}, 3)')} AS precision_{c}"]
        rec.append(rc)
        prec.append(pc)
        f1.append(f"CASE WHEN {rc} + {pc} > 0 THEN 2 * {rc} * {pc} / ({rc} + {pc}) ELSE 0.0 END")
    parts += [f"{r('round((' + ' + '.join(rec) + ') / 3, 3)')} AS macro_recall",
              f"{r('round((' + ' + '.join(prec) + ') / 3, 3)')} AS macro_precision",
              f"{r('round((' + ' + '.join(f1) + ') / 3, 3)')} AS macro_f1"]
    return SCORED_SQL + f""", p AS (SELECT lang, label,
        CAST(CASE WHEN p_high >= 0.25 THEN 2 WHEN p_moderate >= 0.5 THEN 1 ELSE 0 END AS DOUBLE) AS prediction FROM s)
    SELECT lang, count(*) AS n, {r('round(avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END), 3)')} AS accuracy,
    {', '.join(parts)} FROM p GROUP BY lang"""


@register("bias_check_classification", _bias_cls_sql())
def q_bias_check_classification(spark, sf_dir):
    p = models.apply_thresholds(scored(spark, sf_dir), 0.25, 0.5)
    return models.bias_classification(p, "lang", [0.0, 1.0, 2.0])


@register("bias_check_regression", SCORED_SQL + f"""SELECT lang, count(*) AS n, {r('avg(abs(y_hat - y_len))')} AS mae,
    {r('sqrt(avg((y_hat - y_len) * (y_hat - y_len)))')} AS rmse,
    {r('CASE WHEN var_pop(y_len) > 0 THEN 1 - sum((y_hat - y_len) * (y_hat - y_len)) / (var_pop(y_len) * count(*)) END')} AS r2
    FROM s GROUP BY lang""")
def q_bias_check_regression(spark, sf_dir):
    s = scored(spark, sf_dir).select("lang", F.col("y_len").alias("label"), F.col("y_hat").alias("prediction"))
    return models.bias_regression(s, "lang")


@register("age_bias_groups", """SELECT CASE WHEN age >= 0 AND age < 30 THEN '<30' WHEN age >= 30 AND age < 50 THEN '30-50'
    WHEN age >= 50 AND age < 100 THEN '>50' END AS age_group, count(*) AS n
    FROM (SELECT CAST(18 + floor(abs(c_acctbal) / 200) AS DOUBLE) AS age FROM customer) GROUP BY 1""")
def q_age_bias_groups(spark, sf_dir):
    p = Domain(spark, sf_dir).participants
    return p.groupBy(models.age_bias_group("age").alias("age_group")).agg(F.count(F.lit(1)).alias("n"))


# --------------------------------------------------------------------------
# trained models (rows-only checks)
# --------------------------------------------------------------------------

FEATURES = ["rec_age_current", "balance", "rec_user_gender", "rec_med_bmi", "rec_ls_stress_sum"]


def _metrics_frame(spark, rows):
    return spark.createDataFrame(rows, "model string, metric string, value double")


def _classification(spark, sf_dir, target, features, name):
    w = wide(Domain(spark, sf_dir))
    data, feats = models.prepare(w, features, target, "participant_id", classes=[0, 1, 2])
    train, test = models.split(data)
    ms = models.train_classifier(train, feats)
    data.unpersist()
    pred = models.predict_classifier(ms, test, 3)
    return ms, feats, train, test, pred


@register("train_heartrisk")
def q_train_heartrisk(spark, sf_dir):
    _, _, _, _, pred = _classification(spark, sf_dir, "rec_heartrisk_cat", FEATURES, "heartrisk")
    m = models.classification_metrics(pred)
    return _metrics_frame(spark, [("heartrisk", k, float(v)) for k, v in m.items()])


@register("train_bp")
def q_train_bp(spark, sf_dir):
    feats = ["rec_age_current", "balance", "rec_user_gender", "rec_med_bmi", "rec_heartrisk"]
    _, _, _, _, pred = _classification(spark, sf_dir, "rec_ls_stress_cat", feats, "bp")
    m = models.classification_metrics(pred)
    return _metrics_frame(spark, [("bp", k, float(v)) for k, v in m.items()])


def _regression(spark, w, target, features):
    data, feats = models.prepare(w, features, target, "participant_id")
    train, test = models.split(data)
    ms = models.train_regressor(train, feats)
    data.unpersist()
    return ms, feats, test, models.predict_regressor(ms, test)


@register("train_lifestyle")
def q_train_lifestyle(spark, sf_dir):
    w = wide(Domain(spark, sf_dir))
    _, _, _, pred = _regression(spark, w, "rec_ls_lifestyle_score", ["rec_age_current", "balance", "rec_user_gender"])
    return _metrics_frame(spark, [("lifestyle", k, float(v)) for k, v in models.regression_metrics(pred).items()])


def improvement_target(history, slug: str):
    """Last minus first score per participant with at least two measurements."""
    h = history.where((F.col("slug") == slug) & F.col("score_value").isNotNull())
    per_t = h.groupBy("participant_id", "completion_created_at").agg(F.avg("score_value").alias("v"))
    return (per_t.groupBy("participant_id").agg(F.count(F.lit(1)).alias("_n"),
                                                 F.min_by("v", "completion_created_at").alias("_first"),
                                                 F.max_by("v", "completion_created_at").alias("_last"))
            .where(F.col("_n") >= 2).select("participant_id", (F.col("_last") - F.col("_first")).alias("improvement")))


@register("train_improvement")
def q_train_improvement(spark, sf_dir):
    d = Domain(spark, sf_dir)
    w = wide(d).join(improvement_target(d.history, "A"), "participant_id", "left")
    _, _, _, pred = _regression(spark, w, "improvement", FEATURES)
    return _metrics_frame(spark, [("improvement", k, float(v)) for k, v in models.regression_metrics(pred).items()])


def _binary(spark, w, target, features, name):
    data, feats = models.prepare(w, features, target, "participant_id", classes=[0, 1])
    train, test = models.split(data)
    ms = models.train_binary(train, feats)
    data.unpersist()
    pred = models.predict_classifier(ms, test, 2)
    return _metrics_frame(spark, [(name, k, float(v)) for k, v in models.classification_metrics(pred).items()])


@register("train_dropoff")
def q_train_dropoff(spark, sf_dir):
    w = wide(Domain(spark, sf_dir)).withColumn("dropped", F.col("rec_ls_lifestyle_score").isNull().cast("int"))
    return _binary(spark, w, "dropped", ["rec_age_current", "balance", "rec_user_gender", "rec_med_bmi"], "dropoff")


def purchase_target(w, purch):
    ok = purch.where(~F.lower(F.trim("status")).isin(list(rules.FAILED_STATUSES)))
    key = "participant_id" if {"participant_id"} <= {*w.columns} & {*ok.columns} else "user_id"
    buyers = ok.select(key).where(F.col(key).isNotNull()).distinct().withColumn("_buys", F.lit(1))
    return w.join(buyers, key, "left").withColumn("has_purchase", F.coalesce("_buys", F.lit(0))).drop("_buys")


@register("train_purchase")
def q_train_purchase(spark, sf_dir):
    d = Domain(spark, sf_dir)
    w = purchase_target(wide(d), purchases(d)).withColumn("has_postal_code", F.col("postal_code").isNotNull().cast("int"))
    return _binary(spark, w, "has_purchase", FEATURES + ["has_postal_code"], "purchase")


@register("train_all")
def q_train_all(spark, sf_dir):
    fns = (q_train_heartrisk, q_train_bp, q_train_lifestyle, q_train_improvement, q_train_dropoff, q_train_purchase)
    wide(Domain(spark, sf_dir))  # written once before the fits read it side by side

    def fit(fn):
        try:
            return fn(spark, sf_dir).withColumn("error", F.lit(None).cast("string"))
        except Exception as e:  # noqa: BLE001 - one failing model must not stop the others
            return spark.createDataFrame([(fn.__name__[8:], "error", None, str(e)[:200])],
                                         "model string, metric string, value double, error string")

    return reduce(DataFrame.unionByName, models.in_threads([partial(fit, fn) for fn in fns]))


@register("cv_metrics")
def q_cv_metrics(spark, sf_dir, k: int = 5):
    w = wide(Domain(spark, sf_dir))
    kept, feats = models.prepare(w, FEATURES, "rec_heartrisk_cat", "participant_id", classes=[0, 1, 2])
    data = models.fold_column(kept, k)

    def fold(f):
        train, test = data.where(F.col("_fold") != f), data.where(F.col("_fold") == f)
        ms = models.train_classifier(train, feats)
        m = models.classification_metrics(models.predict_classifier(ms, test, 3))
        return [(f, name, float(v)) for name, v in m.items()]

    rows = [r for part in models.in_threads([partial(fold, f) for f in range(k)]) for r in part]
    kept.unpersist()
    folds = spark.createDataFrame(rows, "fold int, metric string, value double")
    return folds.groupBy("metric").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"),
                                       F.count(F.lit(1)).alias("folds"))


@register("feature_importance")
def q_feature_importance(spark, sf_dir):
    ms, feats, _, _, _ = _classification(spark, sf_dir, "rec_heartrisk_cat", FEATURES, "heartrisk")
    return spark.createDataFrame(models.feature_importance(ms, feats), "feature string, importance double")


@register("local_influence")
def q_local_influence(spark, sf_dir):
    ms, feats, _, test, _ = _classification(spark, sf_dir, "rec_heartrisk_cat", FEATURES, "heartrisk")
    return models.local_influence(test, test, models.feature_importance(ms, feats))


@register("predict")
def q_predict(spark, sf_dir):
    ms, feats, _, test, _ = _classification(spark, sf_dir, "rec_heartrisk_cat", FEATURES, "heartrisk")
    pred = models.predict_classifier(ms, test, 3)
    return pred.select("_id", "label", "prediction", F.col("prob")[2].alias("p_high"))


@register("regression_scatter")
def q_regression_scatter(spark, sf_dir):
    w = wide(Domain(spark, sf_dir))
    _, _, _, pred = _regression(spark, w, "rec_ls_lifestyle_score", ["rec_age_current", "balance", "rec_user_gender"])
    return pred.select("_id", F.col("label").alias("actual"), F.col("prediction").alias("predicted"))


@register("segmentation")
def q_segmentation(spark, sf_dir):
    w = wide(Domain(spark, sf_dir)).select("participant_id", "rec_age_current", "rec_med_bmi", "rec_ls_stress_sum")
    seg = models.segmentation(w, ["rec_age_current", "rec_med_bmi", "rec_ls_stress_sum"])
    return seg.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.avg("rec_age_current").alias("mean_age"))


@register("improvement_target", """WITH d_history AS (SELECT l_orderkey * 8 + l_linenumber AS id, o_custkey AS participant_id,
    l_returnflag AS slug, l_quantity AS score_value, o_orderdate AS completion_created_at
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
t AS (SELECT participant_id, completion_created_at, avg(score_value) AS v FROM d_history
      WHERE slug = 'A' AND score_value IS NOT NULL GROUP BY ALL)
SELECT participant_id, round(arg_max(v, completion_created_at) - arg_min(v, completion_created_at), 6) AS improvement
FROM t GROUP BY participant_id HAVING count(*) >= 2""")
def q_improvement_target(spark, sf_dir):
    return improvement_target(Domain(spark, sf_dir).history, "A")


@register("purchase_target", """WITH p AS (SELECT user_id AS participant_id, user_id,
    CASE WHEN value < 5 THEN 'cancelled' ELSE 'completed' END AS status FROM events WHERE event_type = 'purchase'),
ok AS (SELECT * FROM p WHERE lower(trim(status)) NOT IN ('cancelled', 'canceled', 'failed', 'refunded'))
SELECT c_custkey AS participant_id, CAST(c_custkey IN (SELECT participant_id FROM ok) AS INTEGER) AS has_purchase
FROM customer""")
def q_purchase_target(spark, sf_dir):
    d = Domain(spark, sf_dir)
    w = wide(d).select("participant_id", "user_id")
    return purchase_target(w, purchases(d)).select("participant_id", "has_purchase")
