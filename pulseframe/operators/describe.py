"""Descriptive aggregates: groupings, distributions, histograms, box statistics,
data quality, duplicates, outliers and geography."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pulseframe.session import cut_lineage


def group_aggregate(df: DataFrame, by: Sequence[str], aggs: Mapping[str, Column]) -> DataFrame:
    """``groupBy(by).agg(...)`` keeping NULL group keys (pandas ``dropna=False``)."""
    return df.groupBy(*by).agg(*[c.alias(n) for n, c in aggs.items()])


def pct_distribution(df: DataFrame, column: str, labels: Mapping | None = None) -> DataFrame:
    """Share (percent) per code over the non-null codes; codes without a label
    are dropped after the shares are computed (so shares may not sum to 100)."""
    from pulseframe.functions.semantics import to_num
    codes = df.select(to_num(column).alias("code")).where(F.col("code").isNotNull())
    counts = codes.groupBy("code").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("_total"))
    out = counts.crossJoin(F.broadcast(total)).withColumn("pct", F.col("n") * 100.0 / F.col("_total")).drop("_total")
    if labels is not None:
        lab = F.create_map(*[x for k, v in labels.items() for x in (F.lit(float(k)), F.lit(v))])
        out = out.withColumn("label", lab[F.col("code")]).where(F.col("label").isNotNull())
    return out


def pct_by_group(df: DataFrame, column: str, group: str, labels: Mapping | None = None) -> DataFrame:
    """Share (percent) of each code within each group (e.g. gender)."""
    from pulseframe.functions.semantics import to_num
    x = df.select(to_num(column).alias("code"), F.col(group).alias("grp")).where(
        F.col("code").isNotNull() & F.col("grp").isNotNull())
    counts = x.groupBy("grp", "code").agg(F.count(F.lit(1)).alias("n"))
    out = counts.withColumn("pct", F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy("grp")))
    if labels is not None:
        lab = F.create_map(*[x for k, v in labels.items() for x in (F.lit(float(k)), F.lit(v))])
        out = out.withColumn("label", lab[F.col("code")]).where(F.col("label").isNotNull())
    return out.withColumnRenamed("grp", group)


def histogram_equal_width(df: DataFrame, column: str, bins: int, by: str | None = None) -> DataFrame:
    """``bins`` equal-width bins between the column's min and max (last bin
    closed), counts per bin (and per ``by`` group). Bin edges come from one
    global min/max aggregate."""
    from pulseframe.functions.semantics import to_num
    x = df.select(to_num(column).alias("x"), *([F.col(by)] if by else [])).where(F.col("x").isNotNull())
    rng = x.agg(F.min("x").alias("_lo"), F.max("x").alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    raw = F.when(width == 0, 0).otherwise(F.floor((F.col("x") - F.col("_lo")) / width))
    b = F.least(raw, F.lit(bins - 1)).cast("int")
    keys = [b.alias("bin")] + ([F.col(by)] if by else [])
    out = (x.crossJoin(F.broadcast(rng)).groupBy(*keys, "_lo", "_hi")
             .agg(F.count(F.lit(1)).alias("n")))
    w = (F.col("_hi") - F.col("_lo")) / bins
    return (out.withColumn("bin_start", F.col("_lo") + F.col("bin") * w)
               .withColumn("bin_end", F.col("_lo") + (F.col("bin") + 1) * w).drop("_lo", "_hi"))


def histogram_fixed_width(df: DataFrame, column: str, width: float, by: str | None = None) -> DataFrame:
    """Bins of ``width`` starting at the column's minimum; counts per bin."""
    from pulseframe.functions.semantics import to_num
    x = df.select(to_num(column).alias("x"), *([F.col(by)] if by else [])).where(F.col("x").isNotNull())
    lo = x.agg(F.min("x").alias("_lo"))
    b = F.floor((F.col("x") - F.col("_lo")) / width).cast("long")
    keys = [b.alias("bin")] + ([F.col(by)] if by else [])
    out = x.crossJoin(F.broadcast(lo)).groupBy(*keys, "_lo").agg(F.count(F.lit(1)).alias("n"))
    return out.withColumn("bin_start", F.col("_lo") + F.col("bin") * width).drop("_lo")


def quantiles(value: Column | str, probs: Sequence[float], exact: bool = True, accuracy: int = 100000) -> Column:
    """Aggregate: array of quantiles. Exact uses linear interpolation
    (pandas/SQL ``quantile_cont``); ``exact=False`` uses the mergeable
    approximate sketch whose memory per group is bounded by ``accuracy``."""
    v = F.col(value) if isinstance(value, str) else value
    if exact:
        return F.percentile(v, F.array(*[F.lit(p) for p in probs]))
    return F.percentile_approx(v, list(probs), accuracy)


def box_stats(df: DataFrame, value: str, group: str | None = None, exact: bool = True) -> DataFrame:
    """Per group: n, mean, q1, median, q3 and whiskers (extreme values inside
    the 1.5 IQR fences). Quartiles come from the distributed exact
    ``quantile_table`` (or the bounded sketch with ``exact=False``); fences
    are joined back for the whisker pass."""
    from pulseframe.functions.semantics import to_num
    keys = [group] if group else []
    x = df.select(*keys, to_num(value).alias("v")).where(F.col("v").isNotNull())
    if group:
        x = x.where(F.col(group).isNotNull())
    base = x.groupBy(*keys).agg(F.count("v").alias("n"), F.avg("v").alias("mean"))
    if exact:
        qs = quantile_table(x, keys, "v", [0.25, 0.5, 0.75], ["q1", "median", "q3"])
    else:
        qs = (x.groupBy(*keys).agg(quantiles("v", [0.25, 0.5, 0.75], False).alias("_q"))
               .select(*keys, F.col("_q")[0].alias("q1"), F.col("_q")[1].alias("median"), F.col("_q")[2].alias("q3")))
    q = base.join(qs, keys) if keys else base.crossJoin(qs)
    fences = q.select(*keys, (F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))).alias("_lo"),
                      (F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))).alias("_hi"))
    joined = x.join(fences, keys) if keys else x.crossJoin(fences)
    wh = joined.groupBy(*keys).agg(
        F.min(F.when(F.col("v") >= F.col("_lo"), F.col("v"))).alias("whisker_low"),
        F.max(F.when(F.col("v") <= F.col("_hi"), F.col("v"))).alias("whisker_high"))
    return q.join(wh, keys) if keys else q.crossJoin(wh)


def measures_long(df: DataFrame, measures: Mapping[str, str], ids: Sequence[str] = ()) -> DataFrame:
    """Unpivot the measure columns once: (ids..., measure, value) with numeric
    coercion and NULL values dropped. Replaces per-column loops."""
    from pulseframe.functions.semantics import to_num
    cols = [to_num(c).alias(c) for c in measures.values()]
    wide = df.select(*ids, *cols)
    long = wide.unpivot(list(ids), list(measures.values()), "column", "value").where(F.col("value").isNotNull())
    names = F.create_map(*[x for k, v in measures.items() for x in (F.lit(v), F.lit(k))])
    return long.withColumn("measure", names[F.col("column")])


def outliers_iqr(df: DataFrame, measures: Mapping[str, str], domain_limits: Mapping[str, float] | None = None,
                 min_n: int = 10, exact: bool = True) -> DataFrame:
    """Per measure with at least ``min_n`` values: mean, median, std, min, max,
    IQR fences and counts of values strictly outside them, their percent, and
    the count above a domain limit."""
    long = measures_long(df, measures)
    base = long.groupBy("measure", "column").agg(
        F.count("value").alias("n_valid"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"))
    if exact:
        qs = quantile_table(long, ["column"], "value", [0.25, 0.5, 0.75], ["_q1", "median", "_q3"])
    else:
        qs = (long.groupBy("column").agg(quantiles("value", [0.25, 0.5, 0.75], False).alias("_q"))
                  .select("column", F.col("_q")[0].alias("_q1"), F.col("_q")[1].alias("median"),
                          F.col("_q")[2].alias("_q3")))
    stats = (base.join(qs, "column").where(F.col("n_valid") >= min_n)
             .withColumn("fence_low", F.col("_q1") - 1.5 * (F.col("_q3") - F.col("_q1")))
             .withColumn("fence_high", F.col("_q3") + 1.5 * (F.col("_q3") - F.col("_q1"))).drop("_q1", "_q3"))
    lim = F.create_map(*[x for k, v in (domain_limits or {}).items() for x in (F.lit(k), F.lit(float(v)))]) \
        if domain_limits else None
    j = long.join(stats.select("column", "fence_low", "fence_high"), "column")
    counts = j.groupBy("column").agg(
        F.sum(F.when(F.col("value") < F.col("fence_low"), 1).otherwise(0)).cast("long").alias("n_low"),
        F.sum(F.when(F.col("value") > F.col("fence_high"), 1).otherwise(0)).cast("long").alias("n_high"),
        (F.sum(F.when(F.col("value") > lim[F.col("column")], 1).otherwise(0)).cast("long") if lim is not None
         else F.lit(None).cast("long")).alias("n_above_domain"))
    out = stats.join(counts, "column")
    return (out.withColumn("n_outliers", F.col("n_low") + F.col("n_high"))
               .withColumn("pct_outliers", F.col("n_outliers") * 100.0 / F.col("n_valid"))
               .withColumn("domain_limit", lim[F.col("column")] if lim is not None else F.lit(None).cast("double")))


def data_quality(df: DataFrame, columns: Sequence[str], total_override: int | None = None,
                 labels: Mapping[str, str] | None = None) -> DataFrame:
    """Per column: filled, missing, missing %, mean, std, min, max and the
    value distribution of its sibling ``<column>_cat`` column as text
    'code=n, ...'. Columns without any value are left out. All statistics
    come from one unpivot + one aggregate."""
    from pulseframe.functions.semantics import to_num
    n_rows = df.agg(F.count(F.lit(1)).alias("_rows"))
    long = df.select(*[to_num(c).alias(c) for c in columns]).unpivot([], list(columns), "column", "value")
    stats = long.groupBy("column").agg(F.count("value").alias("filled"), F.avg("value").alias("mean"),
                                       F.stddev_samp("value").alias("std"), F.min("value").alias("min"),
                                       F.max("value").alias("max")).where(F.col("filled") > 0)
    denom = F.lit(total_override) if total_override else F.col("_rows")
    out = (stats.crossJoin(F.broadcast(n_rows))
                .withColumn("missing", denom - F.col("filled"))
                .withColumn("missing_pct", F.col("missing") * 100.0 / denom).drop("_rows"))
    cats = [c for c in columns if f"{c}_cat" in df.columns]
    if cats:
        cl = (df.select(*[to_num(f"{c}_cat").alias(c) for c in cats]).unpivot([], cats, "column", "code")
                .where(F.col("code").isNotNull())
                .groupBy("column", "code").agg(F.count(F.lit(1)).alias("n"))
                .groupBy("column").agg(F.array_join(F.transform(
                    F.array_sort(F.collect_list(F.struct("code", "n"))),
                    lambda s: F.concat(s["code"].cast("long").cast("string"), F.lit("="), s["n"].cast("string"))),
                    ", ").alias("category_distribution")))
        out = out.join(cl, "column", "left")
    else:
        out = out.withColumn("category_distribution", F.lit(None).cast("string"))
    out = out.withColumn("missing_band", missing_band("missing_pct"))
    if labels:
        lab = F.create_map(*[x for k, v in labels.items() for x in (F.lit(k), F.lit(v))])
        out = out.withColumn("label", F.coalesce(lab[F.col("column")], F.col("column")))
    return out


def missing_band(pct: Column | str) -> Column:
    p = F.col(pct) if isinstance(pct, str) else pct
    return F.when(p > 50, "hoog").when(p > 20, "matig").otherwise("laag")


def _normalised(df: DataFrame) -> list[Column]:
    """Columns prepared for row equality: NaN and -0.0 normalised, maps as JSON."""
    out = []
    for f, t in df.dtypes:
        c = F.col(f"`{f}`")
        if t in ("double", "float"):
            c = F.when(F.isnan(c), F.lit(float("nan"))).when(c == 0, F.lit(0.0)).otherwise(c)
        elif t.startswith("map"):
            c = F.to_json(c)  # maps are not groupable
        out.append(c.alias(f))
    return out


def exact_distinct_rows(df: DataFrame) -> DataFrame:
    """One-row frame (rows, unique_rows) with exact full-row equality (NULL
    equals NULL): a grouped count on all columns. Duplicates are combined
    map-side before the shuffle, so heavily duplicated tables shuffle little;
    the aggregation spills, so there is no row cap."""
    x = df.select(*_normalised(df))
    g = x.groupBy(*[F.col(f"`{c}`") for c in x.columns]).agg(F.count(F.lit(1)).alias("_c"))
    return g.agg(F.sum("_c").cast("long").alias("rows"), F.count(F.lit(1)).cast("long").alias("unique_rows"))


def duplicate_stats(frames: Mapping[str, DataFrame], id_col: str = "id") -> DataFrame:
    """Per table: rows, full-row duplicates (NULL equals NULL, floats with NaN
    and -0.0 normalised), unique rows, duplicate percent and duplicate ids
    (rows minus distinct ids; NULL ids count as duplicates). Exact, no row cap."""
    parts = []
    for name, df in frames.items():
        agg = exact_distinct_rows(df)
        if id_col in df.columns:
            ids = df.agg((F.count(F.lit(1)) - F.countDistinct(id_col)).alias("duplicate_ids"))
        else:
            ids = df.sparkSession.range(1).select(F.lit(None).cast("long").alias("duplicate_ids"))
        parts.append(agg.crossJoin(ids).select(F.lit(name).alias("table"), "*"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return (out.withColumn("full_row_duplicates", F.col("rows") - F.col("unique_rows"))
               .withColumn("duplicate_pct", F.when(F.col("rows") > 0,
                                                   F.col("full_row_duplicates") * 100.0 / F.col("rows"))
                           .otherwise(0.0)))


def mode_per_group(df: DataFrame, group: str, code: str) -> DataFrame:
    """Per group: modal code (smallest of tied modes), its count, valid n and
    dominance percent. Counts per (group, code) first, then a window over the
    small (group, code) table."""
    x = df.select(F.col(group), F.col(code).alias("code")).where(F.col(group).isNotNull() & F.col("code").isNotNull())
    cnt = x.groupBy(group, "code").agg(F.count(F.lit(1)).alias("n_code"))
    w = Window.partitionBy(group)
    ranked = (cnt.withColumn("n_valid", F.sum("n_code").over(w))
                 .withColumn("_rk", F.row_number().over(w.orderBy(F.col("n_code").desc(), F.col("code").asc()))))
    return (ranked.where("_rk = 1").drop("_rk")
                  .withColumnRenamed("code", "modal_code")
                  .withColumn("dominance_pct", F.col("n_code") * 100.0 / F.col("n_valid")))


def normalize_p5_p95(df: DataFrame, column: str, out: str | None = None) -> DataFrame:
    """Scale to 1..10 by the 5th/95th percentiles: 1 + 9 * clip((x-p5)/(p95-p5), 0, 1).
    Degenerate spread falls back to 1 + 9 * clip(x/max, 0, 1); a non-positive
    max leaves values unchanged. Percentiles come from one aggregate."""
    from pulseframe.functions.semantics import to_num
    out = out or f"{column}_norm"
    x = to_num(column)
    qs = quantile_table(df.select(x.alias("_x")), [], "_x", [0.05, 0.95], ["_p5", "_p95"])
    stats = df.agg(F.max(x).alias("_max")).join(qs, F.lit(True), "left")  # one row, also when empty
    j = df.crossJoin(F.broadcast(stats))  # one row
    clip01 = lambda e: F.least(F.greatest(e, F.lit(0.0)), F.lit(1.0))
    degenerate = F.col("_p5").isNull() | F.col("_p95").isNull() | (F.col("_p95") <= F.col("_p5"))
    val = (F.when(~degenerate, 1.0 + 9.0 * clip01((x - F.col("_p5")) / (F.col("_p95") - F.col("_p5"))))
            .when(F.col("_max").isNull() | (F.col("_max") <= 0), x)
            .otherwise(1.0 + 9.0 * clip01(x / F.col("_max"))))
    return j.withColumn(out, val).drop("_p5", "_p95", "_max")


def normalize_to_max(df: DataFrame, column: str, target_max: float = 10.0, out: str | None = None) -> DataFrame:
    """x * target / max(x); unchanged when the max is 0 or missing."""
    from pulseframe.functions.semantics import to_num
    out = out or f"{column}_scaled"
    x = to_num(column)
    m = df.agg(F.max(x).alias("_max"))
    return (df.crossJoin(F.broadcast(m))  # one row
              .withColumn(out, F.when(F.col("_max").isNull() | (F.col("_max") == 0), x)
                          .otherwise(x * (target_max / F.col("_max")))).drop("_max"))


def clip_outlier_max(df: DataFrame, column: str, outlier_max: float | None, scale: float | None = None) -> DataFrame:
    """Drop rows above the registry's ``outlier_max`` and optionally rescale by
    ``scale`` (rounded to 1 decimal)."""
    from pulseframe.functions.semantics import to_num
    x = to_num(column)
    out = df.where(x.isNotNull())
    if outlier_max is not None:
        out = out.where(x <= outlier_max)
    if scale is not None:
        out = out.withColumn(column, F.round(x * scale, 1))
    return out


def pivot_text(long: DataFrame, row: str, column: str, value: str, columns: Sequence, prefix: str = "") -> DataFrame:
    """Metric x group table of formatted cells 'mean (n=count)', mean to 1 decimal."""
    g = long.groupBy(row, column).agg(F.round(F.avg(value), 1).alias("_m"), F.count(value).alias("_n"))
    cell = F.format_string("%.1f (n=%d)", F.col("_m"), F.col("_n"))
    out = g.groupBy(row).pivot(column, list(columns)).agg(F.first(cell))
    return out.select(row, *[F.col(f"`{c}`").alias(f"{prefix}{c}") for c in columns])


def analysis_columns(columns: Sequence[str], skip_prefixes: Sequence[str] = (), skip_exact: Sequence[str] = (),
                     drop_cat_with_raw: bool = True, keep_prefixes: Sequence[str] = ("rec_", "feat_")) -> list[str]:
    """Column-name rules for the quality and outlier pages (no data pass):
    keep score columns, skip names starting with any of ``skip_prefixes``,
    names in ``skip_exact``, and ``<x>_cat`` when the raw ``<x>`` exists."""
    names = list(columns)
    present = set(names)
    out = []
    for c in names:
        if keep_prefixes and not c.startswith(tuple(keep_prefixes)):
            continue
        if skip_prefixes and c.startswith(tuple(skip_prefixes)):
            continue
        if c in skip_exact:
            continue
        if drop_cat_with_raw and c.endswith("_cat") and c[:-4] in present:
            continue
        out.append(c)
    return out


def quantile_table(df: DataFrame, keys: Sequence[str], value: Column | str, probs: Sequence[float],
                   names: Sequence[str] | None = None, partitions: int | None = None,
                   weight: str | None = None) -> DataFrame:
    """Exact quantiles (linear interpolation, as pandas ``quantile`` and SQL
    ``quantile_cont``) per group, without holding a group in one task.

    1. count rows per (group, value): duplicates collapse map-side and a hot
       group is spread over tasks by value;
    2. range-partition the (group, value) counts and give every range its
       offset within each group from the per-range totals (a table of at most
       groups x ranges rows), so the running count runs inside each range;
    3. each group's target ranks floor(h), ceil(h) with h = p * (n - 1) are
       joined to the rows whose rank interval holds them (an equi-join on the
       group that AQE can split when one group is very large) and
       interpolated.
    Returns one row per group with one column per probability. Rows with a
    NULL group key are left out (as a grouped quantile drops NULL keys).
    ``weight``: a column with the number of rows that a row stands for.
    """
    keys = list(keys)
    names = list(names or [f"q{i}" for i in range(len(probs))])
    v = F.col(value) if isinstance(value, str) else value
    times = F.col(weight) if weight else F.lit(1)
    x = df.select(*keys, v.cast("double").alias("_v"), times.cast("long").alias("_m")).where(F.col("_v").isNotNull())
    cnt = x.groupBy(*keys, "_v").agg(F.sum("_m").alias("_c"))
    n_parts = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Range bounds are sampled anew for every shuffle, so the ranged counts are
    # written once and both branches below read the same range numbers.
    ranged = cut_lineage(cnt.repartitionByRange(n_parts, *keys, "_v").withColumn("_pid", F.spark_partition_id()))
    tot = ranged.groupBy(*keys, "_pid").agg(F.sum("_c").alias("_t"))
    wo = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    off = tot.withColumn("_o", F.coalesce(F.sum("_t").over(wo), F.lit(0))).drop("_t")
    wr = Window.partitionBy("_pid", *keys).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    cum = (ranged.join(off, keys + ["_pid"]).withColumn("_hi", F.col("_o") + F.sum("_c").over(wr))
                 .withColumn("_lo", F.col("_hi") - F.col("_c")).select(*keys, "_v", "_lo", "_hi"))
    n = cnt.groupBy(*keys).agg(F.sum("_c").alias("_n"))
    targets = n.select(*keys, F.explode(F.array(*[
        F.struct(F.lit(i).alias("i"), (F.lit(float(p)) * (F.col("_n") - 1)).alias("h"))
        for i, p in enumerate(probs)])).alias("_t")).select(*keys, "_t.i", "_t.h")
    targets = targets.withColumn("_f", F.floor("h")).withColumn("_g", F.ceil("h"))
    hit = cum.join(targets, keys) if keys else cum.crossJoin(targets)
    hit = hit.where(((F.col("_lo") <= F.col("_f")) & (F.col("_f") < F.col("_hi")))
                    | ((F.col("_lo") <= F.col("_g")) & (F.col("_g") < F.col("_hi"))))
    inside = lambda r: (F.col("_lo") <= F.col(r)) & (F.col(r) < F.col("_hi"))
    per = hit.groupBy(*keys, "i", "h", "_f").agg(F.max(F.when(inside("_f"), F.col("_v"))).alias("_a"),
                                                 F.max(F.when(inside("_g"), F.col("_v"))).alias("_b"))
    per = per.withColumn("q", F.col("_a") + (F.col("h") - F.col("_f")) * (F.col("_b") - F.col("_a")))
    wide = per.groupBy(*keys).agg(*[F.max(F.when(F.col("i") == i, F.col("q"))).alias(nm) for i, nm in enumerate(names)])
    return wide


def home_or_abroad(postal_code: Column | str, home: str = "Nederland", abroad: str = "Buitenland") -> Column:
    """Home where the postcode holds four digits in a row, abroad elsewhere (missing ones too)."""
    code = F.col(postal_code) if isinstance(postal_code, str) else postal_code
    found = F.regexp_extract(F.coalesce(code.cast("string"), F.lit("")), r"(\d{4})", 1)
    return F.when(found != "", home).otherwise(abroad)


def region_comparison(df: DataFrame, metrics: Mapping[str, str], region: str = "region",
                      participant: str = "participant_id") -> DataFrame:
    """(metric, region, mean, n): the mean over participants of each one's own
    mean (2 decimals), and the number of participants with a value.

    All metrics go through one unpivot; the first of the two aggregations is
    combined map-side, so a participant with very many rows is no hot key.
    Metrics that the table lacks give no rows."""
    found = {k: c for k, c in metrics.items() if c in df.columns}
    long = measures_long(df, found, ids=[participant, region])
    per = long.groupBy("measure", region, participant).agg(F.avg("value").alias("_v"))
    return (per.groupBy(F.col("measure").alias("metric"), F.col(region).alias("region"))
            .agg(F.round(F.avg("_v"), 2).alias("mean"), F.count(participant).alias("n")))
