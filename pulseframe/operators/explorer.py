"""The variable explorer: one table of aggregates for every registered variable.

The registry says per variable how it is shown (histogram, shares, counts or
box statistics), scaled, clipped, labelled and split by gender. All variables
are unpivoted at once and counted by (variable, gender, value); everything
else follows from that table, so the data are read once however long the
registry is.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseframe.functions.rules import GENDER_LABELS
from pulseframe.functions.semantics import to_num
from pulseframe.operators.describe import quantile_table
from pulseframe.session import cut_lineage

PLOT_TYPES = ("histogram", "bar", "pie", "box")
#: Width of a histogram's bins for scores, and number of bins otherwise.
SCORE_BIN, BINS = 0.5, 30
TOTAL = "totaal"


@dataclass(frozen=True)
class Variable:
    """One registry row."""
    column: str
    label: str
    plot_type: str
    split_gender: bool = False
    labels: Mapping[float, str] = field(default_factory=dict)
    scale: float | None = None
    outlier_max: float | None = None
    min_score: float | None = None
    max_score: float | None = None


REGISTRY_SCHEMA = ("variable string, label string, plot_type string, split boolean, codes map<double,string>, scale double, "
                   "outlier_max double, fixed boolean, lo double, hi double")


def registry_frame(spark, registry: Sequence[Variable], both: bool) -> DataFrame:
    rows = []
    for v in registry:
        if v.plot_type not in PLOT_TYPES:
            raise ValueError(f"{v.column}: unknown plot type {v.plot_type}")
        split = both and v.split_gender and v.plot_type in ("histogram", "box")
        number = lambda x, other=None: other if x is None else float(x)
        rows.append((v.column, v.label, v.plot_type, split, {float(k): x for k, x in v.labels.items()} or None,
                     number(v.scale), number(v.outlier_max), split and (v.scale is not None or v.max_score is not None),
                     number(v.min_score, 0.0), number(v.max_score, 10.0)))
    return spark.createDataFrame(rows, REGISTRY_SCHEMA)


def variable_explorer(wide: DataFrame, registry: Sequence[Variable], gender: str = "beide",
                      gender_col: str = "rec_user_gender") -> DataFrame:
    """(variable, label, plot_type, gender, item, x, n, value), one row per shown figure.

    ``gender``: ``beide`` and ``totaal`` keep the rows with a known gender,
    ``man`` and ``vrouw`` one of them; only ``beide`` splits, and only
    histograms and boxes whose registry row allows it. Values are scaled and
    rounded to one decimal where a scale is given, and rows above the outlier
    limit (or without a number, where one is given) go.

    - histogram: item ``bin``, x its start, value the count. Split scores have
      bins of 0.5 over their range (values outside are not shown), all others
      30 equal ones between the variable's least and largest value;
    - bar: the share of every label or value in percent; pie: its count
      (x the code; codes without label go where there are labels);
    - box: n, mean, min, q1, median, q3, max.

    Variables that the table lacks give no rows.
    """
    spark = wide.sparkSession
    registry = [v for v in registry if v.column in wide.columns]
    schema = "variable string, label string, plot_type string, gender string, item string, x double, n long, value double"
    if not registry:
        return spark.createDataFrame([], schema)
    reg = F.broadcast(registry_frame(spark, registry, gender == "beide"))  # one row per variable
    names = {k: v for k, v in GENDER_LABELS.items() if gender not in ("man", "vrouw") or v.lower() == gender}
    shown = F.create_map(*[x for k, v in names.items() for x in (F.lit(float(k)), F.lit(v))])
    one = wide.select(shown[to_num(gender_col)].alias("gender"), *[to_num(v.column).alias(v.column) for v in registry])
    long = one.where(F.col("gender").isNotNull()).unpivot(["gender"], [v.column for v in registry], "variable", "code")
    value = F.when(F.col("scale").isNotNull(), F.rint(F.col("code") * F.col("scale") * 10) / 10).otherwise(F.col("code"))
    counts = (long.join(reg, "variable").withColumn("v", value)
              .where(F.col("v").isNotNull() & (F.col("outlier_max").isNull() | (F.col("v") <= F.col("outlier_max"))))
              .withColumn("gender", F.when(F.col("split"), F.col("gender")).otherwise(TOTAL))
              .groupBy("variable", "gender", "code", "v").agg(F.count(F.lit(1)).alias("n")))
    counts = cut_lineage(counts).join(reg, "variable")
    out = ["variable", "label", "plot_type", "gender"]

    bins = counts.where("plot_type = 'histogram'")
    span = bins.groupBy("variable").agg(F.min("v").alias("least"), F.max("v").alias("most"))  # one row per variable
    low = F.when(F.col("fixed"), F.col("lo")).otherwise(F.col("least"))
    high = F.when(F.col("fixed"), F.col("hi")).otherwise(F.col("most"))
    bins = (bins.join(F.broadcast(span), "variable").withColumns({"_lo": low, "_hi": high})
            .where((F.col("v") >= F.col("_lo")) & (F.col("v") <= F.col("_hi")))
            .withColumn("_w", F.when(F.col("fixed"), SCORE_BIN).otherwise((F.col("_hi") - F.col("_lo")) / BINS))
            .withColumn("_last", F.when(F.col("fixed"), F.ceil((F.col("_hi") - F.col("_lo")) / SCORE_BIN) - 1).otherwise(BINS - 1)))
    at = F.when(F.col("_w") == 0, 0).otherwise(F.least(F.floor((F.col("v") - F.col("_lo")) / F.col("_w")), F.col("_last")))
    bins = (bins.withColumn("x", F.col("_lo") + at * F.col("_w")).groupBy(*out, "x").agg(F.sum("n").alias("n"))
            .select(*out, F.lit("bin").alias("item"), "x", "n", F.col("n").cast("double").alias("value")))

    named = F.when(F.col("codes").isNotNull(), F.col("codes")[F.col("code")]).otherwise(F.col("v").cast("string"))
    x = F.when(F.col("codes").isNotNull(), F.col("code")).otherwise(F.col("v"))
    cats = (counts.where("plot_type IN ('bar', 'pie')").withColumns({"item": named, "x": x}).where(F.col("item").isNotNull())
            .groupBy(*out, "item", "x").agg(F.sum("n").alias("n")))
    totals = cats.groupBy("variable").agg(F.sum("n").alias("_total"))  # one row per variable
    share = F.when(F.col("plot_type") == "bar", F.col("n") * 100.0 / F.col("_total")).otherwise(F.col("n").cast("double"))
    cats = cats.join(F.broadcast(totals), "variable").select(*out, "item", "x", "n", share.alias("value"))

    boxes = counts.where("plot_type = 'box'")
    base = boxes.groupBy(*out).agg(F.sum("n").alias("n"), (F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("mean"),
                                   F.min("v").alias("min"), F.max("v").alias("max"))
    quart = quantile_table(boxes, ["variable", "gender"], "v", [0.25, 0.5, 0.75], ["q1", "median", "q3"], weight="n")
    stats = base.join(quart, ["variable", "gender"]).unpivot([*out, "n"], ["mean", "min", "q1", "median", "q3", "max"], "item", "value")
    stats = stats.select(*out, "item", F.lit(None).cast("double").alias("x"), "n", "value")
    return bins.unionByName(cats).unionByName(stats)
