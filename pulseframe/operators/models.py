"""Predictive models on Spark ML plus model-evaluation aggregates.

Training uses Spark ML estimators (distributed). Evaluation tables (threshold
scan, confusion matrix, PR curve, bias checks) are plain aggregates over a
(label, prediction / probability) frame, so they also run on any stand-in
prediction table and are checkable with SQL.
"""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark import StorageLevel, inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pulseframe.functions.semantics import to_num
from pulseframe.session import cut_lineage

SEED = 42
#: Rows of a training table that one task holds. The estimators run a job for
#: every iteration or tree level, so a table in needlessly many pieces pays
#: the scheduling of each piece hundreds of times.
ROWS_PER_TASK = 50_000


# --------------------------------------------------------------------------
# preparation
# --------------------------------------------------------------------------

def prepare(df: DataFrame, features: Sequence[str], target: str, id_col: str, classes: Sequence | None = None,
            min_rows: int = 30, min_features: int = 3) -> tuple[DataFrame, list[str]]:
    """Numeric cast of features and target, rows without target dropped,
    optional class filter; features that are entirely NULL are dropped
    (checked with one aggregate). Raises when fewer than ``min_features``
    features or ``min_rows`` rows remain."""
    x = df.select(F.col(id_col).alias("_id"), *[to_num(c).alias(c) for c in features], to_num(target).alias("label"))
    x = x.where(F.col("label").isNotNull())
    if classes is not None:
        x = x.where(F.col("label").isin([float(c) for c in classes]))
    # Stored once: the counts, the training and, after ``unpersist``, the
    # predictions would each derive the table from its sources again.
    x = cut_lineage(x)
    counts = x.agg(F.count(F.lit(1)).alias("_n"), *[F.count(c).alias(c) for c in features]).first().asDict()
    feats = [c for c in features if counts[c] > 0]
    if len(feats) < min_features or counts["_n"] < min_rows:
        raise ValueError(f"not enough data: {counts['_n']} rows, {len(feats)} features")
    # Iterative estimators scan the training data many times: keep it
    # (memory, spilling to disk; recomputed from lineage if an executor goes).
    # Callers release it with ``unpersist`` once their models are fitted.
    x = x.select("_id", *feats, "label").repartition(counts["_n"] // ROWS_PER_TASK + 1)
    return x.persist(StorageLevel.MEMORY_AND_DISK), feats


def split(df: DataFrame, train_pct: int = 75, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """Deterministic split by a hash of the id: no sort, no window, no
    shuffle; each class is split at the same rate in expectation."""
    h = F.pmod(F.xxhash64(F.col("_id"), F.lit(seed)), F.lit(100))
    return df.where(h < train_pct), df.where(h >= train_pct)


def fold_column(df: DataFrame, k: int, seed: int = SEED) -> DataFrame:
    return df.withColumn("_fold", F.pmod(F.xxhash64(F.col("_id"), F.lit(seed + 1)), F.lit(k)).cast("int"))


def _assembler(feats: Sequence[str]) -> list:
    imputed = [f"{c}__imp" for c in feats]
    return [Imputer(inputCols=list(feats), outputCols=imputed, strategy="median"),
            VectorAssembler(inputCols=imputed, outputCol="features", handleInvalid="keep")]


def balanced_weights(train: DataFrame) -> DataFrame:
    """Class weight n / (k * n_class) as column ``w`` (one small aggregate
    joined back by broadcast; the class table is bounded by the classes)."""
    cnt = train.groupBy("label").agg(F.count(F.lit(1)).alias("_nc"))
    tot = cnt.agg(F.sum("_nc").alias("_n"), F.count(F.lit(1)).alias("_k"))
    w = cnt.crossJoin(tot).select("label", (F.col("_n") / (F.col("_k") * F.col("_nc"))).alias("w"))
    return train.join(F.broadcast(w), "label")


# --------------------------------------------------------------------------
# training
# --------------------------------------------------------------------------

def fit_members(train: DataFrame, feats: Sequence[str], estimators: Sequence) -> list:
    """One pipeline model per estimator, all on the same imputed and assembled
    vectors: the preprocessing is fitted once and its result kept while they train."""
    prep = Pipeline(stages=_assembler(feats)).fit(train)
    ready = prep.transform(train).select("features", "label", *[c for c in train.columns if c == "w"])
    ready = ready.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        fitted = [est.fit(ready) for est in estimators]
    finally:
        ready.unpersist()
    return [PipelineModel(prep.stages + [_without_summary(s) for s in (m.stages if isinstance(m, PipelineModel) else [m])])
            for m in fitted]


def _without_summary(model):
    """The model without the training summary a classifier keeps. A summary of
    two classes holds the session, which cannot be sent to tasks once the
    session has observed metrics or run a stream, and the model goes with it."""
    if getattr(model, "hasSummary", False):
        model = model.copy()
        if model.hasSummary:  # a copied logistic regression takes its summary along
            model._java_obj.setSummary(SparkSession.active()._jvm.scala.Option.empty())
    return model


def train_classifier(train: DataFrame, feats: Sequence[str], num_trees: int = 60, max_depth: int = 6) -> list:
    """Soft-voting pair: balanced random forest + multinomial logistic regression."""
    rf = RandomForestClassifier(numTrees=num_trees, maxDepth=max_depth, seed=SEED, weightCol="w", probabilityCol="p_rf",
                                rawPredictionCol="raw_rf", predictionCol="pred_rf")
    lr = Pipeline(stages=[StandardScaler(inputCol="features", outputCol="zfeatures"),
                          LogisticRegression(featuresCol="zfeatures", weightCol="w", maxIter=100, probabilityCol="p_lr",
                                             rawPredictionCol="raw_lr", predictionCol="pred_lr")])
    return fit_members(balanced_weights(train), feats, [rf, lr])


def predict_classifier(models: list, df: DataFrame, n_classes: int) -> DataFrame:
    """Average the class-probability vectors of the ensemble; prediction =
    argmax. Adds ``prob`` (array) and ``prediction``."""
    out = df
    keep = list(df.columns)
    for i, m in enumerate(models):
        t = m.transform(out)
        pcol = [c for c in t.columns if c.startswith("p_") and c not in keep][0]
        out = t.select(*keep, vector_to_array(pcol).alias(f"_p{i}"))
        keep.append(f"_p{i}")
    avg = F.transform(F.sequence(F.lit(0), F.lit(n_classes - 1)),
                      lambda j: sum((F.coalesce(F.get(F.col(f"_p{i}"), j), F.lit(0.0)) for i in range(len(models))),
                                    F.lit(0.0)) / len(models))
    out = out.withColumn("prob", avg).drop(*[f"_p{i}" for i in range(len(models))])
    best = F.array_position(F.col("prob"), F.array_max(F.col("prob"))) - 1
    return out.withColumn("prediction", best.cast("double"))


def train_regressor(train: DataFrame, feats: Sequence[str], num_trees: int = 60, max_depth: int = 6,
                    gbt_iter: int = 40) -> list:
    rf = RandomForestRegressor(numTrees=num_trees, maxDepth=max_depth, seed=SEED, predictionCol="pred_rf")
    gbt = GBTRegressor(maxIter=gbt_iter, maxDepth=4, seed=SEED, predictionCol="pred_gbt")
    return fit_members(train, feats, [rf, gbt])


def predict_regressor(models: list, df: DataFrame) -> DataFrame:
    out = df
    keep = list(df.columns)
    preds = []
    for m in models:
        t = m.transform(out)
        pcol = [c for c in t.columns if c.startswith("pred_") and c not in keep][0]
        out = t.select(*keep, pcol)
        keep.append(pcol)
        preds.append(pcol)
    return out.withColumn("prediction", sum((F.col(p) for p in preds), F.lit(0.0)) / len(preds)).drop(*preds)


def train_binary(train: DataFrame, feats: Sequence[str], num_trees: int = 60, gbt_iter: int = 30) -> list:
    """Binary target: balanced random forest + gradient-boosted trees."""
    rf = RandomForestClassifier(numTrees=num_trees, maxDepth=6, seed=SEED, weightCol="w", probabilityCol="p_rf",
                                rawPredictionCol="raw_rf", predictionCol="pred_rf")
    gbt = (GBTClassifier(maxIter=gbt_iter, maxDepth=4, seed=SEED, weightCol="w")
           .setProbabilityCol("p_gbt").setRawPredictionCol("raw_gbt").setPredictionCol("pred_gbt"))
    return fit_members(balanced_weights(train), feats, [rf, gbt])


# --------------------------------------------------------------------------
# metrics
# --------------------------------------------------------------------------

def classification_metrics(pred: DataFrame) -> dict:
    pred = pred.select("label", "prediction").persist(StorageLevel.MEMORY_AND_DISK)
    ev = MulticlassClassificationEvaluator(labelCol="label", predictionCol="prediction")
    out = {"accuracy": ev.setMetricName("accuracy").evaluate(pred),
           "f1": ev.setMetricName("f1").evaluate(pred),
           "macro_recall": macro_recall(pred).first()[0]}
    pred.unpersist()
    return out


def regression_metrics(pred: DataFrame) -> dict:
    pred = pred.select("label", "prediction").persist(StorageLevel.MEMORY_AND_DISK)
    ev = RegressionEvaluator(labelCol="label", predictionCol="prediction")
    out = {m: ev.setMetricName(m).evaluate(pred) for m in ("mae", "rmse", "r2")}
    pred.unpersist()
    return out


def in_threads(calls: Sequence) -> list:
    """Results of independent fits, run side by side as Spark ML's own cross
    validation does: the small jobs of one fill the gaps of the others."""
    spark = SparkSession.active()
    with ThreadPoolExecutor(max_workers=max(1, len(calls))) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(spark)(c)) for c in calls]]


def macro_recall(pred: DataFrame) -> DataFrame:
    per = pred.groupBy("label").agg(F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("_r"))
    return per.agg(F.avg("_r").alias("macro_recall"))


def threshold_grid(lo: float = 0.10, hi: float = 0.85, step: float = 0.05) -> list[float]:
    n = int(round((hi - lo) / step)) + 1
    return [round(lo + i * step, 2) for i in range(n)]


def threshold_scan(scored: DataFrame, grid: Sequence[float] | None = None, top: int = 5) -> DataFrame:
    """Grid search of (t_high, t_moderate) for the rule: class 2 if
    p_high >= t_high, else class 1 if p_moderate >= t_moderate, else 0;
    ranked by macro recall to 3 dp, then smaller t_moderate, then smaller
    t_high (top ``top``), with the recall of each class (0 where absent).

    Each row is reduced to the number of grid thresholds its p_high and
    p_moderate pass, then counted per (label, bucket_high, bucket_moderate):
    at most 3 x 17 x 17 groups whatever the data size. The grid is applied
    to that small table only, so no row is ever paired with the grid."""
    g = list(grid or threshold_grid())
    garr = F.array(*[F.lit(t) for t in g])
    b = (scored.select("label",
                       F.size(F.filter(garr, lambda t: t <= F.col("p_high"))).alias("bh"),
                       F.size(F.filter(garr, lambda t: t <= F.col("p_moderate"))).alias("bm"))
         .groupBy("label", "bh", "bm").agg(F.count(F.lit(1)).alias("n")))
    spark = scored.sparkSession
    pairs = spark.createDataFrame([(i, th, j, tm) for i, th in enumerate(g) for j, tm in enumerate(g)],
                                  "i int, t_high double, j int, t_moderate double")
    j = b.crossJoin(F.broadcast(pairs))  # bounded: counts table x fixed grid
    pred = (F.when(F.col("bh") > F.col("i"), 2.0).when(F.col("bm") > F.col("j"), 1.0).otherwise(0.0))
    per_class = (j.groupBy("t_high", "t_moderate", "label")
                 .agg(F.sum(F.when(pred == F.col("label"), F.col("n")).otherwise(0)).alias("_hit"),
                      F.sum("n").alias("_tot")))
    hit = F.col("_hit") / F.col("_tot")

    def three(x):
        return F.round(x.cast("decimal(28,12)"), 3).cast("double")
    rec = per_class.groupBy("t_high", "t_moderate").agg(
        three(F.avg(hit)).alias("macro_recall"),
        *[three(F.coalesce(F.max(F.when(F.col("label") == k, hit)), F.lit(0.0))).alias(f"recall_{n}")
          for k, n in enumerate(("low", "moderate", "high"))])
    return rec.orderBy(F.col("macro_recall").desc(), "t_moderate", "t_high").limit(top)


def apply_thresholds(scored: DataFrame, t_high: float, t_moderate: float) -> DataFrame:
    return scored.withColumn("prediction", F.when(F.col("p_high") >= t_high, 2.0)
                             .when(F.col("p_moderate") >= t_moderate, 1.0).otherwise(0.0))


def confusion_matrix(pred: DataFrame, classes: Sequence[float]) -> DataFrame:
    """Counts per (actual, predicted) including zero cells of the class grid."""
    spark = pred.sparkSession
    grid = spark.createDataFrame([(float(a), float(p)) for a in classes for p in classes], "actual double, predicted double")
    cnt = pred.groupBy(F.col("label").cast("double").alias("actual"),
                       F.col("prediction").cast("double").alias("predicted")).agg(F.count(F.lit(1)).alias("n"))
    return grid.join(cnt, ["actual", "predicted"], "left").fillna(0, ["n"])


def pr_curve(scored: DataFrame, positive: float, score: str = "score") -> DataFrame:
    """One-vs-rest precision and recall at every distinct score (threshold =
    score, predicted positive when score >= threshold). Rows are first
    reduced to (score, positives, negatives); the running sums then run over
    the distinct scores only."""
    is_pos = (F.col("label") == positive).cast("long")
    per = scored.groupBy(F.col(score).alias("threshold")).agg(F.sum(is_pos).alias("_tp"),
                                                              F.sum(1 - is_pos).alias("_fp"))
    tot = per.agg(F.sum("_tp").alias("_P"))
    out = running_sums(per, "threshold", {"_tp": "tp", "_fp": "fp"}, descending=True).crossJoin(
        F.broadcast(tot))  # one row
    return (out.withColumn("precision", F.col("tp") / (F.col("tp") + F.col("fp")))
               .withColumn("recall", F.try_divide(F.col("tp"), F.col("_P")))
               .select("threshold", "tp", "fp", "precision", "recall"))


def running_sums(df: DataFrame, order: str, columns: dict, descending: bool = False,
                 partitions: int | None = None) -> DataFrame:
    """Exact running sums over a global order without a single-partition
    window: rows are range-partitioned on ``order``, each range gets its
    offset from the totals of the ranges before it (a tiny table, one row per
    range) and a window inside each range adds the local running sum.
    ``order`` must be unique (aggregate to it first)."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    o = F.col(order).desc() if descending else F.col(order).asc()
    # Written once: range bounds are sampled anew for every shuffle.
    ranged = cut_lineage(df.repartitionByRange(n, o).withColumn("_pid", F.spark_partition_id()))
    totals = ranged.groupBy("_pid").agg(*[F.sum(c).alias(f"_t{c}") for c in columns])
    wp = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_pid", *[F.coalesce(F.sum(f"_t{c}").over(wp), F.lit(0)).alias(f"_o{c}")
                                     for c in columns])
    w = Window.partitionBy("_pid").orderBy(o).rowsBetween(Window.unboundedPreceding, 0)
    out = ranged.join(F.broadcast(offsets), "_pid")  # one row per range
    for c, name in columns.items():
        out = out.withColumn(name, F.col(f"_o{c}") + F.sum(c).over(w))
    return out.drop("_pid", *[f"_o{c}" for c in columns])


def bias_classification(pred: DataFrame, group: str, classes: Sequence[float]) -> DataFrame:
    """Per group: n, accuracy and macro recall / precision / F1, plus per-class
    recall and precision (rounded to 3 decimals, 0 when a class is empty).
    One aggregate over (group, label, prediction)."""
    aggs = [F.count(F.lit(1)).alias("n"),
            F.avg((F.col("label") == F.col("prediction")).cast("double")).alias("accuracy")]
    for c in classes:
        tag = str(int(c))
        tp = F.sum(((F.col("label") == c) & (F.col("prediction") == c)).cast("long"))
        aggs += [tp.alias(f"_tp{tag}"), F.sum((F.col("label") == c).cast("long")).alias(f"_a{tag}"),
                 F.sum((F.col("prediction") == c).cast("long")).alias(f"_p{tag}")]
    g = pred.groupBy(group).agg(*aggs)
    rec, prec, f1 = [], [], []
    for c in classes:
        tag = str(int(c))
        rc = F.coalesce(F.try_divide(F.col(f"_tp{tag}"), F.col(f"_a{tag}")), F.lit(0.0))
        pc = F.coalesce(F.try_divide(F.col(f"_tp{tag}"), F.col(f"_p{tag}")), F.lit(0.0))
        fc = F.when(rc + pc > 0, 2 * rc * pc / (rc + pc)).otherwise(0.0)
        g = g.withColumn(f"recall_{tag}", F.round(rc, 3)).withColumn(f"precision_{tag}", F.round(pc, 3))
        rec.append(rc)
        prec.append(pc)
        f1.append(fc)
    k = len(classes)
    g = (g.withColumn("macro_recall", F.round(sum(rec, F.lit(0.0)) / k, 3))
          .withColumn("macro_precision", F.round(sum(prec, F.lit(0.0)) / k, 3))
          .withColumn("macro_f1", F.round(sum(f1, F.lit(0.0)) / k, 3))
          .withColumn("accuracy", F.round("accuracy", 3)))
    return g.drop(*[c for c in g.columns if c.startswith("_")])


def bias_regression(pred: DataFrame, group: str) -> DataFrame:
    """Per group: n, MAE, RMSE and R^2 (1 - SSE/SST) from one aggregate."""
    err = F.col("prediction") - F.col("label")
    g = pred.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(err)).alias("mae"),
                                F.sqrt(F.avg(err * err)).alias("rmse"), F.sum(err * err).alias("_sse"),
                                F.var_pop("label").alias("_vp"))
    return (g.withColumn("r2", F.when(F.col("_vp") > 0, 1 - F.col("_sse") / (F.col("_vp") * F.col("n"))))
             .drop("_sse", "_vp"))


def feature_importance(models: list, feats: Sequence[str]) -> list[tuple[str, float]]:
    """Mean importance over the tree models of an ensemble (driver-side: one
    value per feature)."""
    imps = []
    for m in models:
        last = m.stages[-1] if isinstance(m, PipelineModel) else m
        if hasattr(last, "featureImportances"):
            imps.append(last.featureImportances.toArray())
    if not imps:
        return [(f, 0.0) for f in feats]
    return [(f, float(sum(v[i] for v in imps) / len(imps))) for i, f in enumerate(feats)]


def local_influence(rows: DataFrame, test: DataFrame, importances: list[tuple[str, float]]) -> DataFrame:
    """(value - test mean) x importance per feature, long form; 0 where the
    value or the mean is missing."""
    feats = [f for f, _ in importances]
    means = test.agg(*[F.avg(f).alias(f"_m_{f}") for f in feats])
    imp = F.create_map(*[x for f, v in importances for x in (F.lit(f), F.lit(v))])
    long = rows.crossJoin(F.broadcast(means)).select(  # one row of means
        "_id", F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("value"),
                                            F.col(f"_m_{f}").alias("test_mean")) for f in feats])).alias("s"))
    return (long.select("_id", "s.*").withColumn("importance", imp[F.col("feature")])
                .withColumn("influence", F.coalesce((F.col("value") - F.col("test_mean")) * F.col("importance"),
                                                    F.lit(0.0))))


def segmentation(df: DataFrame, feats: Sequence[str], k: int = 3) -> DataFrame:
    """Complete cases, standardised, k-means (k=3, seed 42): cluster per row."""
    x = df.dropna(subset=list(feats))
    pipe = Pipeline(stages=[VectorAssembler(inputCols=list(feats), outputCol="_v"),
                            StandardScaler(inputCol="_v", outputCol="features", withMean=True, withStd=True),
                            KMeans(k=k, seed=SEED, featuresCol="features", predictionCol="cluster")])
    return pipe.fit(x).transform(x).drop("_v", "features")


def age_bias_group(age: Column | str) -> Column:
    from pulseframe.functions import rules
    from pulseframe.functions.semantics import cut
    return cut(to_num(age), rules.BIAS_AGE_EDGES, rules.BIAS_AGE_LABELS, right=False)
