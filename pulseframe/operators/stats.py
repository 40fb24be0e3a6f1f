"""Statistics: Welch t-tests, effect sizes, correlations, OLS lines, insights.

Every test is one unpivot + one grouped aggregate of sufficient statistics
(count, mean, sample variance) per (measure, group); the test statistics are
then expressions on that small result. Only the Student-t tail probability
runs in Python, on the aggregated rows.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulseframe.functions import rules
from pulseframe.functions.distributions import t_pvalue
from pulseframe.functions.semantics import pearson, to_num
from pulseframe.operators.describe import measures_long


def _welch(a: str, b: str) -> dict[str, Column]:
    """Welch statistics from columns n_<a>, mean_<a>, var_<a> (and <b>)."""
    na, nb = F.col(f"n_{a}"), F.col(f"n_{b}")
    ma, mb = F.col(f"mean_{a}"), F.col(f"mean_{b}")
    va, vb = F.col(f"var_{a}"), F.col(f"var_{b}")
    se2 = va / na + vb / nb
    t = (ma - mb) / F.sqrt(se2)
    dof = se2 * se2 / ((va / na) * (va / na) / (na - 1) + (vb / nb) * (vb / nb) / (nb - 1))
    pooled = F.sqrt((va + vb) / 2)
    d = F.when(pooled > 0, (ma - mb) / pooled).otherwise(F.lit(0.0))
    return {"t_stat": t, "dof": dof, "cohens_d": d}


def welch_ttest(df: DataFrame, measures: Mapping[str, str], group: Column, first: str, second: str,
                min_n: int = 10, with_p: bool = True) -> DataFrame:
    """Welch t-test of ``first`` vs ``second`` group for every measure.

    ``group`` is a column expression yielding the group name per row
    (NULL rows are ignored). Measures where either group has fewer than
    ``min_n`` values are dropped.
    """
    long = measures_long(df.withColumn("_grp", group), measures, ids=["_grp"]).where(F.col("_grp").isNotNull())
    aggs = []
    for tag, g in (("a", first), ("b", second)):
        v = F.when(F.col("_grp") == g, F.col("value"))
        aggs += [F.count(v).alias(f"n_{tag}"), F.avg(v).alias(f"mean_{tag}"), F.var_samp(v).alias(f"var_{tag}")]
    s = long.groupBy("measure", "column").agg(*aggs).where((F.col("n_a") >= min_n) & (F.col("n_b") >= min_n))
    stats = _welch("a", "b")
    out = s.select("measure", "column", F.col("mean_a"), F.col("mean_b"), (F.col("mean_a") - F.col("mean_b")).alias("diff"),
                   F.col("n_a"), F.col("n_b"), stats["t_stat"].alias("t_stat"), stats["dof"].alias("dof"),
                   stats["cohens_d"].alias("cohens_d"))
    out = out.withColumn("effect", rules.effect_size_label("cohens_d"))
    if with_p:
        out = (out.withColumn("p_value", t_pvalue(F.col("t_stat"), F.col("dof")))
                  .withColumn("significant", F.col("p_value") < 0.05))
    return out


def ttest_gender(df: DataFrame, measures: Mapping[str, str], gender_col: str = "rec_user_gender",
                 min_n: int = 10, with_p: bool = True) -> DataFrame:
    """Men (code 1) versus women (code 0)."""
    g = to_num(gender_col)
    grp = F.when(g == 1, "man").when(g == 0, "vrouw")
    return welch_ttest(df, measures, grp, "man", "vrouw", min_n, with_p)


def ttest_org_unit(df: DataFrame, measures: Mapping[str, str], unit_col: str, unit: str, min_n: int = 10,
                   with_p: bool = True) -> DataFrame:
    """One organisational unit versus all other rows (NULL/blank unit = 'Onbekend')."""
    u = rules.text_or_unknown(unit_col)
    grp = F.when(u == unit, "unit").otherwise("rest")
    return welch_ttest(df, measures, grp, "unit", "rest", min_n, with_p)


def ttest_filter(tests: DataFrame, min_abs_d: float = 0.0) -> DataFrame:
    """Significant results with |d| above ``min_abs_d``, ordered by d (forest order)."""
    return tests.where(F.col("significant") & (F.abs("cohens_d") > min_abs_d)).orderBy("cohens_d", "measure")


def correlation_matrix(df: DataFrame, variables: Mapping[str, str], min_n: int = 200) -> DataFrame:
    """Pairwise-complete Pearson r between the variables that have at least
    ``min_n`` values; all ordered pairs (diagonal included) in long form,
    with the pairwise count.

    Each row emits one (pair, x, y) entry per unordered pair, then a single
    grouped aggregate computes every pair's sufficient statistics; the
    aggregate code stays small however many variables there are."""
    cols = list(variables.values())
    x = df.select(*[to_num(c).alias(c) for c in cols])
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    entries = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(a).alias("x"), F.col(b).alias("y"))
                        for a, b in pairs])
    long = x.select(F.explode(entries).alias("e")).select("e.*")
    per_pair = long.groupBy("a", "b").agg(pearson("x", "y").alias("r"),
                                          F.count(F.when(F.col("x").isNotNull() & F.col("y").isNotNull(), 1))
                                          .alias("n_pairs"))
    n_valid = x.unpivot([], cols, "var", "v").groupBy("var").agg(F.count("v").alias("n"))
    kept = n_valid.where(F.col("n") >= min_n).select("var")
    both = per_pair.unionByName(per_pair.where(F.col("a") != F.col("b"))
                                .select(F.col("b").alias("a"), F.col("a").alias("b"), "r", "n_pairs"))
    out = (both.join(kept.withColumnRenamed("var", "a"), "a", "left_semi")
               .join(kept.withColumnRenamed("var", "b"), "b", "left_semi")
               .select(F.col("a").alias("var_a"), F.col("b").alias("var_b"), "r", "n_pairs"))
    labels = F.create_map(*[y for k, v in variables.items() for y in (F.lit(v), F.lit(k))])
    return out.withColumn("label_a", labels[F.col("var_a")]).withColumn("label_b", labels[F.col("var_b")])


def scatter_correlation(df: DataFrame, x: str, y: str, group: str | None = None, with_p: bool = True) -> DataFrame:
    """Pearson r, its t statistic and OLS line (slope, intercept) overall or per group."""
    d = df.select(to_num(x).alias("_x"), to_num(y).alias("_y"), *([F.col(group)] if group else [])).where(
        F.col("_x").isNotNull() & F.col("_y").isNotNull())
    if group:
        d = d.where(F.col(group).isNotNull())
    keys = [group] if group else []
    out = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), pearson("_x", "_y").alias("r"),
                               F.regr_slope("_y", "_x").alias("slope"), F.regr_intercept("_y", "_x").alias("intercept"))
    out = out.withColumn("t_stat", F.col("r") * F.sqrt((F.col("n") - 2) / (1 - F.col("r") * F.col("r"))))
    if with_p:
        out = out.withColumn("p_value", t_pvalue(F.col("t_stat"), F.col("n") - 2))
    return out


def insights(population: DataFrame, quality: DataFrame, outliers: DataFrame, tests: DataFrame) -> DataFrame:
    """Rule-based findings as (kind, title, text, rank) rows: population size
    with share of women and ages; one row naming up to five columns with >50%
    missing; measures with >5% outliers (top 3); significant medium/large
    effects (top 5). ``population`` is one row: n, n_women, n_gender,
    mean_age, min_age, max_age."""
    pop = population.select(F.lit("info").alias("kind"), F.lit("Populatie").alias("title"), F.format_string(
        "%d deelnemers, waarvan %.1f%% vrouw; gemiddelde leeftijd %.1f jaar (spreiding: %.0f-%.0f jaar)", F.col("n"),
        F.try_divide(F.col("n_women") * 100.0, F.col("n_gender")), F.col("mean_age"), F.col("min_age"),
        F.col("max_age")).alias("text"), F.lit(1).alias("rank"))
    # bounded by the number of columns
    gaps = quality.where(F.col("missing_pct") > 50).agg(
        F.count(F.lit(1)).alias("k"), F.array_sort(F.collect_list(F.struct(-F.col("missing_pct"), "column"))).alias("c"))
    miss = gaps.where(F.col("k") > 0).select(
        F.lit("warning").alias("kind"), F.lit("Datakwaliteit: hoge missende waarden").alias("title"),
        F.format_string("%d variabelen hebben meer dan 50%% missende waarden: %s", F.col("k"),
                        F.array_join(F.slice(F.col("c.column"), 1, 5), ", ")).alias("text"),
        F.lit(1).alias("rank"))
    out_rows = outliers.where(F.col("pct_outliers") > 5).select(
        F.lit("warning").alias("kind"), F.lit("Uitschieters").alias("title"),
        F.format_string("%s: %.1f%% uitschieters", F.col("measure"), F.col("pct_outliers")).alias("text"),
        F.col("pct_outliers"))
    out_rows = (out_rows.orderBy(F.col("pct_outliers").desc(), "text").limit(3)
                .select("kind", "title", "text", F.lit(1).alias("rank")))
    eff = tests.where(F.col("significant") & (F.abs("cohens_d") >= 0.5)).select(
        F.lit("finding").alias("kind"), F.lit("Verschil man/vrouw").alias("title"),
        F.format_string("%s: d = %.2f (%s)", F.col("measure"), F.col("cohens_d"), F.col("effect")).alias("text"),
        F.col("p_value"))
    eff = eff.orderBy("p_value", "text").limit(5).select("kind", "title", "text", F.lit(1).alias("rank"))
    return pop.unionByName(miss).unionByName(out_rows).unionByName(eff)
