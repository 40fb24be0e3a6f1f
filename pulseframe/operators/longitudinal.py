"""Longitudinal operators: change over time, monthly trends, cumulative counts,
trajectories and category migration."""

from __future__ import annotations



from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window



from pulseframe.functions.semantics import cut, day_start, days_between, first_non_null, last_non_null, month_start


def month_trend_by_store(history: DataFrame, links: DataFrame, slug: str | None = None, min_participants: int = 1,
                         participant: str = "participant_id", slug_col: str = "slug", value: str = "score_value",
                         at: str = "completion_created_at") -> DataFrame:
    """Per store and month: mean of participant means, participants, measurements,
    distinct measurement days, the overall month mean and the change versus the
    store's previous reported month (0 for its first).

    ``links`` maps each participant to exactly one (store_id, store_name).
    Because the store is a function of the participant, the history is first
    reduced to one row per (participant, month) and only then joined to the
    links: the join input shrinks from all measurements to participant-months.
    """
    h = history
    if slug is not None:
        h = h.where(F.col(slug_col) == slug)
    h = h.where(F.col(value).isNotNull() & F.col(at).isNotNull() & F.col(participant).isNotNull())
    per_pm = (h.groupBy(F.col(participant).alias("participant_id"), month_start(at).alias("month"))
                .agg(F.avg(value).alias("p_mean"), F.count(value).alias("p_n"), F.min(at).alias("p_first")))
    lk = links.select(F.col("participant_id"), "store_id", "store_name").where(
        F.col("store_id").isNotNull() & F.col("store_name").isNotNull())
    per_p = per_pm.join(lk, "participant_id")
    # per_p holds one row per (participant, month) and a participant has one
    # store, so counting rows counts distinct participants. The month-wide
    # mean is rolled up from the store-month sums (sum / count decomposes),
    # so the history is aggregated once for both outputs.
    store_month = (per_p.groupBy("store_id", "store_name", "month")
                   .agg(F.sum("p_mean").alias("_sum"), F.count(F.lit(1)).alias("n_participants"),
                        F.sum("p_n").alias("n_measurements"),
                        F.countDistinct(F.to_date("p_first")).alias("n_days"))
                   .withColumn("mean_score", F.col("_sum") / F.col("n_participants")))
    overall = store_month.groupBy("month").agg((F.sum("_sum") / F.sum("n_participants")).alias("overall_mean"))
    kept = store_month.where(F.col("n_participants") >= max(1, int(min_participants))).drop("_sum")
    w = Window.partitionBy("store_id").orderBy("month")
    return (kept.join(overall, "month", "left")
                .withColumn("mean_change", F.coalesce(F.col("mean_score") - F.lag("mean_score").over(w), F.lit(0.0))))


def change_vs_first(history: DataFrame, participant: str = "participant_id", slug: str = "slug",
                    value: str = "score_value", at: str = "completion_created_at", tiebreak: str = "id") -> DataFrame:
    """Change versus the first measurement per (participant, slug), bucketed by
    days since the first measurement; mean per participant, then per
    (period, slug): mean, count and distinct participants.

    The first value is the first non-null value and the first date the first
    non-null date (independently, as a grouped first() does). Both come from
    one algebraic aggregate joined back on the key, not from a window, so a
    key holding a huge share of rows is pre-reduced map-side; the join back
    is a plain equi-join that AQE can split when skewed.
    """
    from pulseframe.functions import rules
    keys = [participant, slug]
    h = history.select(*keys, value, at, tiebreak)
    firsts = h.groupBy(*keys).agg(first_non_null(value, at, tiebreak).alias("_first_value"),
                                  F.min(at).alias("_first_at"))
    j = h.join(firsts, keys).where(F.col(at) > F.col("_first_at"))
    j = (j.withColumn("change", F.col(value) - F.col("_first_value"))
          .withColumn("days", days_between("_first_at", at))
          .withColumn("period", cut("days", rules.CHANGE_PERIOD_EDGES, rules.CHANGE_PERIOD_LABELS))
          .where(F.col("period").isNotNull()))
    per_p = j.groupBy(participant, slug, "period").agg(F.avg("change").alias("change_per_participant"))
    return (per_p.groupBy("period", slug).agg(F.avg("change_per_participant").alias("mean"),
                                              F.count("change_per_participant").alias("count"),
                                              F.countDistinct(participant).alias("n_participants"))
                 .where(F.col("n_participants") >= 1))


def score_trajectory(history: DataFrame, participant: str = "participant_id", completion: str = "completion_id",
                     value: str = "score_value", at: str = "completion_created_at", max_fill: int = 10) -> DataFrame:
    """Mean score at the k-th completion (k <= ``max_fill``) over participants
    having at least k completions. One score per completion (mean of
    duplicates) is computed first, so the per-participant numbering runs on
    completions, not raw rows."""
    per_c = (history.where(F.col(value).isNotNull() & F.col(at).isNotNull())
             .groupBy(participant, completion, at).agg(F.avg(value).alias("score")))
    # Only the days that can hold one of the first ``max_fill`` completions
    # are numbered: completions per (participant, day), a running count over
    # each participant's day list, and a semi join. The numbering window then
    # sees at most the completions of those days, not a busy participant's
    # whole history.
    per_c = per_c.withColumn("_day", day_start(at))
    days = per_c.groupBy(participant, "_day").agg(F.count(F.lit(1)).alias("_k"))
    wd = Window.partitionBy(participant).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    days = days.withColumn("_before", F.coalesce(F.sum("_k").over(wd), F.lit(0))).where(F.col("_before") < max_fill)
    early = per_c.join(days.select(participant, "_day", "_before"), [participant, "_day"])
    w = Window.partitionBy(participant, "_day").orderBy(at, completion)
    numbered = (early.withColumn("fill_nr", F.col("_before") + F.row_number().over(w))
                     .where(F.col("fill_nr") <= max_fill))
    return (numbered.groupBy("fill_nr")
            .agg(F.avg("score").alias("mean_score"), F.countDistinct(participant).alias("n_participants"))
            .withColumn("fill_label", F.concat(F.col("fill_nr").cast("string"), F.lit("e invulling"))))


def repeat_change_summary(history: DataFrame, participant: str = "participant_id",
                          completion: str = "completion_id", value: str = "score_value",
                          at: str = "completion_created_at") -> DataFrame:
    """First versus last completion score by number of completions ('1x'..'5x',
    '6+x'): participants, mean first/last score, mean and std of the change
    (std 0 for a single participant). First/last come from min_by/max_by
    aggregates (map-side combined, skew-safe)."""
    from pulseframe.functions import rules
    per_c = (history.where(F.col(value).isNotNull() & F.col(at).isNotNull())
             .groupBy(participant, completion, at).agg(F.avg(value).alias("score")))
    order = F.struct(F.col(at), F.col(completion))
    per_p = per_c.groupBy(participant).agg(F.count(F.lit(1)).alias("n_total"),
                                           F.min_by("score", order).alias("first_score"),
                                           F.max_by("score", order).alias("last_score"))
    label, key = rules.frequency_bucket("n_total")
    per_p = per_p.withColumn("change", F.col("last_score") - F.col("first_score"))
    return (per_p.groupBy(label.alias("frequency"), key.alias("frequency_order"))
            .agg(F.countDistinct(participant).alias("n_participants"), F.avg("first_score").alias("mean_first"),
                 F.avg("last_score").alias("mean_last"), F.avg("change").alias("mean_change"),
                 F.coalesce(F.stddev_samp("change"), F.lit(0.0)).alias("std_change")))


def participant_month_means(history: DataFrame, slug: str | None, participant: str = "participant_id",
                            slug_col: str = "slug", value: str = "score_value",
                            at: str = "completion_created_at") -> DataFrame:
    h = history if slug is None else history.where(F.col(slug_col) == slug)
    h = h.where(F.col(value).isNotNull() & F.col(at).isNotNull())
    return h.groupBy(participant, month_start(at).alias("month")).agg(F.avg(value).alias("p_mean"))


def rolling_month_mean(history: DataFrame, slug: str, window: int = 3, min_participants: int = 2,
                       participant: str = "participant_id") -> DataFrame:
    """Monthly mean and std of participant means (months with at least
    ``min_participants``), centred rolling mean of both over ``window`` rows
    (min_periods 1) and the band mean +- rolling std. The rolling window runs
    over the month series (one row per month), so it stays tiny."""
    pm = participant_month_means(history, slug, participant)
    monthly = (pm.groupBy("month").agg(F.avg("p_mean").alias("mean"), F.stddev_samp("p_mean").alias("std"),
                                       F.countDistinct(participant).alias("n_participants"))
                 .where(F.col("n_participants") >= min_participants))
    w = Window.orderBy("month").rowsBetween(-(window // 2), (window - 1) // 2)
    out = (monthly.withColumn("rolling_mean", F.avg("mean").over(w))
                  .withColumn("rolling_std", F.avg("std").over(w)))
    return (out.withColumn("band_low", F.col("rolling_mean") - F.col("rolling_std"))
               .withColumn("band_high", F.col("rolling_mean") + F.col("rolling_std")))


def month_and_year_weighted(history: DataFrame, slug: str, participant: str = "participant_id") -> DataFrame:
    """Monthly mean of participant means and its participant count, with the
    yearly mean weighted by the monthly participant counts."""
    pm = participant_month_means(history, slug, participant)
    monthly = pm.groupBy("month").agg(F.avg("p_mean").alias("month_mean"),
                                      F.countDistinct(participant).alias("n_participants"))
    yearly = (monthly.groupBy(F.year("month").alias("year"))
              .agg(weighted_average_col("month_mean", "n_participants").alias("year_weighted_mean")))
    return monthly.withColumn("year", F.year("month")).join(yearly, "year", "left")


def weighted_average_col(value: str, weight: str):
    from pulseframe.functions.semantics import weighted_average
    return weighted_average(value, weight)


def year_metric_pair(history: DataFrame, slug_a: str, slug_b: str, participant: str = "participant_id",
                     slug_col: str = "slug", value: str = "score_value",
                     at: str = "completion_created_at") -> DataFrame:
    """Per year: mean of participant means for two slugs side by side, and the
    participants counted over both slugs."""
    h = (history.where(F.col(slug_col).isin(slug_a, slug_b) & F.col(value).isNotNull() & F.col(at).isNotNull())
         .withColumn("year", F.year(at)))
    pm = h.groupBy("year", slug_col, participant).agg(F.avg(value).alias("p_mean"))
    return pm.groupBy("year").agg(
        F.avg(F.when(F.col(slug_col) == slug_a, F.col("p_mean"))).alias("mean_a"),
        F.avg(F.when(F.col(slug_col) == slug_b, F.col("p_mean"))).alias("mean_b"),
        F.countDistinct(participant).alias("n_participants"))


def cumulative_new(events: DataFrame, participant: str, at: str, grain: str = "day",
                   min_year: int | None = None) -> DataFrame:
    """New participants per day (or year) by their first appearance and the
    running total. Participants are reduced to their first timestamp first
    (an aggregate), then to one row per period, so the global running window
    only sees the short period series."""
    first = (events.where(F.col(participant).isNotNull() & F.col(at).isNotNull())
             .groupBy(participant).agg(F.min(at).alias("_first")))
    if min_year is not None:
        first = first.where(F.year("_first") >= min_year)
    period = day_start("_first") if grain == "day" else F.year("_first")
    per = first.groupBy(period.alias(grain)).agg(F.count(F.lit(1)).alias("new_participants"))
    w = Window.orderBy(grain).rowsBetween(Window.unboundedPreceding, 0)
    return per.withColumn("cumulative", F.sum("new_participants").over(w))


def migration_matrix(history: DataFrame, slug: str, category: str, participant: str = "participant_id",
                     slug_col: str = "slug", at: str = "completion_created_at", tiebreak: str = "id") -> DataFrame:
    """First -> last category per participant with at least two measurements
    (first/last non-null values, S4), counted per (from, to)."""
    h = history.where(F.col(slug_col) == slug)
    cat = F.col(category).cast("double")
    per_p = (h.groupBy(participant).agg(F.count(F.lit(1)).alias("_n"),
                                        first_non_null(cat, at, tiebreak).alias("from_code"),
                                        last_non_null(cat, at, tiebreak).alias("to_code"))
             .where((F.col("_n") >= 2) & F.col("from_code").isNotNull() & F.col("to_code").isNotNull()))
    return per_p.groupBy("from_code", "to_code").agg(F.count(F.lit(1)).alias("n"))


# ==========================================================================
# FIXED VALUES: bin edges and labels per score slug of the risk migration
# ==========================================================================
MIGRATION_BINS = {
    "bmi": ([-0.1, 18.5, 25.0, 30.0, 1000.0],
            ["Ondergewicht (<18.5)", "Normaal gewicht (18.5-25)", "Overgewicht (25-30)", "Obesitas (>30)"]),
    "fruit": ([-0.1, 0.5, 1.5, 10000.0], ["Weinig (<1/dag)", "Matig (~1/dag)", "Veel (≥2/dag)"]),
    "vegetables": ([-0.1, 150.0, 250.0, 100000.0], ["Laag (<150g)", "Matig (150-250g)", "Veel (≥250g)"]),
    "stress": ([-0.1, 5.0, 14.0, 100.0], ["Weinig stress (<5)", "Matig stress (5-14)", "Veel stress (>14)"]),
    "dass_stress": ([-0.1, 14.0, 18.0, 25.0, 100.0],
                    ["Normaal (0-14)", "Matig (15-18)", "Ernstig (19-25)", "Zeer ernstig (>25)"]),
    "dass_anxiety": ([-0.1, 7.0, 9.0, 14.0, 100.0],
                     ["Normaal (0-7)", "Matig (8-9)", "Ernstig (10-14)", "Zeer ernstig (>14)"]),
    "dass_depression": ([-0.1, 9.0, 13.0, 20.0, 100.0],
                        ["Normaal (0-9)", "Matig (10-13)", "Ernstig (14-20)", "Zeer ernstig (>20)"]),
    "sleep": ([-0.1, 5.0, 10.0, 100.0], ["Goed (PSQI ≤5)", "Matig (PSQI 6-10)", "Slecht (PSQI >10)"]),
    "alcohol": ([-0.1, 0.5, 14.0, 1000.0], ["Geen/Zelden (<1/wk)", "Matig (1-14/wk)", "Hoog (>14/wk)"]),
    "sugar": ([-0.1, 25.0, 50.0, 10000.0], ["Laag (<25g)", "Matig (25-50g)", "Hoog (>50g)"]),
    "fat": ([-0.1, 22.0, 35.0, 10000.0], ["Laag (<22g)", "Matig (22-35g)", "Hoog (>35g)"]),
    "salt": ([-0.1, 2400.0, 3500.0, 100000.0], ["Laag (<2400mg)", "Matig (2400-3500mg)", "Hoog (>3500mg)"]),
    "blood_pressure": ([-0.1, 0.5, 1.5, 10.0], ["Normaal", "Verhoogd", "Hoog"]),
    "steps": ([-0.1, 5000.0, 10000.0, 100000.0], ["Weinig (<5.000)", "Matig (5.000-10.000)", "Veel (>10.000)"]),
    "exercise": ([-0.1, 150.0, 300.0, 10000.0],
                 ["Onvoldoende (<150 min)", "Voldoende (150-300 min)", "Actief (>300 min)"]),
    "wellbeing": ([-0.1, 50.0, 75.0, 100.0],
                  ["Laag welzijn (<50)", "Matig welzijn (50-75)", "Hoog welzijn (>75)"]),
    "resilience": ([-0.1, 20.0, 30.0, 40.0], ["Laag (<20)", "Gemiddeld (20-30)", "Hoog (>30)"]),
    "workload": ([-0.1, 3.0, 7.0, 10.0],
                 ["Lage werkdruk (<3)", "Normale werkdruk (3-7)", "Hoge werkdruk (>7)"]),
    "job_satisfaction": ([-0.1, 5.0, 7.5, 10.0], ["Ontevreden (<5)", "Voldoende (5-7.5)", "Tevreden (>7.5)"]),
    "lifestyle": ([-0.1, 60.0, 80.0, 100.0], ["Matig (<60)", "Voldoende (60-80)", "Uitstekend (>80)"]),
    "heartrisk": ([-0.1, 0.5, 1.5, 10.0], ["Laag risico", "Matig risico", "Hoog risico"]),
}
# ==========================================================================


def migration_binned(history: DataFrame, slug: str, participant: str = "participant_id", slug_col: str = "slug",
                     value: str = "score_value", at: str = "completion_created_at", tiebreak: str = "id",
                     bins: tuple[list[float], list[str]] | None = None, n_bins: int = 5,
                     max_unique: int = 6) -> DataFrame:
    """First -> last value per participant (>= 2 measurements), binned by the
    given edges or those of ``MIGRATION_BINS`` for the slug, else by the values themselves when there are at most
    ``max_unique`` integer-like values, else by pooled quantile edges
    (``n_bins`` bins, duplicate edges removed). Counts per (from, to) code.

    The choice between the three rules is a one-row aggregate over the pairs;
    pooled quantiles come from one exact ``percentile`` aggregate.
    """
    bins = bins or MIGRATION_BINS.get(slug)
    h = history.where(F.col(slug_col) == slug)
    v = F.col(value).cast("double")
    pairs = (h.groupBy(participant).agg(F.count(F.lit(1)).alias("_n"), first_non_null(v, at, tiebreak).alias("v_from"),
                                        last_non_null(v, at, tiebreak).alias("v_to"))
             .where((F.col("_n") >= 2) & F.col("v_from").isNotNull() & F.col("v_to").isNotNull()))
    if bins is not None:
        edges, _labels = bins
        return (pairs.select(cut("v_from", edges, None, True, True).alias("from_code"),
                             cut("v_to", edges, None, True, True).alias("to_code"))
                .where(F.col("from_code").isNotNull() & F.col("to_code").isNotNull())
                .groupBy("from_code", "to_code").agg(F.count(F.lit(1)).alias("n")))
    pooled = pairs.select(F.explode(F.array("v_from", "v_to")).alias("x"))
    probs = [i / n_bins for i in range(n_bins + 1)]
    meta = pooled.agg(
        F.countDistinct("x").alias("_n_unique"),
        F.min(F.col("x") == F.floor("x")).alias("_int_like"),
        )
    from pulseframe.operators.describe import quantile_table
    qn = [f"_e{i}" for i in range(len(probs))]
    edges = quantile_table(pooled, [], "x", probs, qn).select(
        F.array_distinct(F.array_sort(F.array(*[F.col(c) for c in qn]))).alias("_edges"))
    meta = meta.join(edges, F.lit(True), "left")  # one row
    # Rank of a value among the distinct pooled values (for the few-values rule).
    # Only kept when there are at most ``max_unique`` values, so the global
    # ranking window never sees more than a handful of rows.
    distinct_vals = (pooled.select("x").distinct()
                     .crossJoin(F.broadcast(meta.select("_n_unique")))  # one row
                     .where(F.col("_n_unique") <= max_unique).drop("_n_unique"))
    ranks = distinct_vals.withColumn("_code", F.dense_rank().over(Window.orderBy("x")) - 1)
    j = pairs.crossJoin(F.broadcast(meta))  # one row
    j = (j.join(ranks.select(F.col("x").alias("v_from"), F.col("_code").alias("_c_from")), "v_from", "left")
          .join(ranks.select(F.col("x").alias("v_to"), F.col("_code").alias("_c_to")), "v_to", "left"))
    few = (F.col("_n_unique") <= max_unique) & F.col("_int_like")

    def qcode(x):
        # pandas cut(include_lowest): first bin [e0, e1], then (e_i, e_i+1]
        e = F.col("_edges")
        idx = F.size(F.filter(e, lambda t: t < x))  # number of edges strictly below x
        return F.when((F.size(e) >= 2) & (x >= e[0]) & (x <= F.element_at(e, -1)),
                      F.greatest(idx - 1, F.lit(0)))
    out = j.select(F.when(few, F.col("_c_from")).otherwise(qcode(F.col("v_from"))).alias("from_code"),
                   F.when(few, F.col("_c_to")).otherwise(qcode(F.col("v_to"))).alias("to_code"))
    return (out.where(F.col("from_code").isNotNull() & F.col("to_code").isNotNull())
               .groupBy("from_code", "to_code").agg(F.count(F.lit(1)).alias("n")))


def migration_labels(matrix: DataFrame, labels: list[str]) -> DataFrame:
    """Names for the codes of a binned migration matrix."""
    names = F.array(*[F.lit(x) for x in labels])
    return matrix.withColumns({f"{c}_label": F.get(names, F.col(f"{c}_code").cast("int")) for c in ("from", "to")})


def migration_flows(matrix: DataFrame, higher_is_better: bool = False) -> DataFrame:
    """Per (from, to): count, percent of the source category, totals per
    category at first/last measurement, and the direction (better / worse /
    same) given whether a higher code is better."""
    w_from = Window.partitionBy("from_code")
    out = (matrix.withColumn("from_total", F.sum("n").over(w_from))
                 .withColumn("pct_of_source", F.col("n") * 100.0 / F.col("from_total")))
    to_tot = matrix.groupBy("to_code").agg(F.sum("n").alias("to_total"))
    out = out.join(to_tot, "to_code", "left")
    up = F.col("to_code") > F.col("from_code")
    down = F.col("to_code") < F.col("from_code")
    better, worse = (up, down) if higher_is_better else (down, up)
    return out.withColumn("direction", F.when(better, "verbeterd").when(worse, "verslechterd").otherwise("gelijk"))


def engagement_trend(completions: DataFrame, links: DataFrame, min_participants: int = 1,
                     participant: str = "participant_id", at: str = "created_at") -> DataFrame:
    """Per store and month (every month seen in any completion, from the
    store's first month on): cumulative distinct participants, share of them
    with two or more completions so far, proxy = 60 + 0.4 * share (1 dp), and
    the month benchmark weighted by participants.

    Exact and linear: completions reduce to counts per (store, participant,
    month); each participant contributes its first month and the month of
    its second completion; running sums over a per-store month series give
    the cumulative figures. No per-month rescans.
    """
    c = (completions.select(participant, at).where(F.col(participant).isNotNull() & F.col(at).isNotNull())
         .join(links.select("participant_id", "store_id", "store_name"), participant)
         .withColumn("month", month_start(at)))
    per_pm = c.groupBy("store_id", "store_name", participant, "month").agg(F.count(F.lit(1)).alias("k"))
    per_p = per_pm.groupBy("store_id", "store_name", participant).agg(
        F.min("month").alias("m1"),
        F.array_sort(F.collect_list(F.struct("month", "k"))).alias("_mk"))
    # month of the 2nd completion: the first month where the running count reaches 2
    second = F.aggregate(
        "_mk", F.struct(F.lit(0).cast("long").alias("c"), F.lit(None).cast("timestamp_ntz").alias("m2")),
        lambda acc, x: F.struct((acc["c"] + x["k"]).alias("c"),
                                F.when(acc["m2"].isNull() & (acc["c"] + x["k"] >= 2), x["month"])
                                 .otherwise(acc["m2"]).alias("m2")))
    per_p = per_p.withColumn("m2", second["m2"]).drop("_mk")
    new = per_p.groupBy("store_id", F.col("m1").alias("month")).agg(F.count(F.lit(1)).alias("new_n"))
    rep = (per_p.where(F.col("m2").isNotNull()).groupBy("store_id", F.col("m2").alias("month"))
           .agg(F.count(F.lit(1)).alias("new_repeat")))
    months = c.select("month").distinct()
    last_month = months.agg(F.max("month").alias("_last"))
    stores = (per_p.groupBy("store_id", "store_name").agg(F.min("m1").alias("_start"))
              .crossJoin(F.broadcast(last_month)))  # one row
    grid = (stores.select("store_id", "store_name",
                          F.explode(F.sequence(F.col("_start"), F.col("_last"), F.expr("INTERVAL 1 MONTH")))
                          .alias("month"))
            .withColumn("month", F.col("month").cast("timestamp_ntz"))
            .join(months, "month", "left_semi"))
    g = grid.join(new, ["store_id", "month"], "left").join(rep, ["store_id", "month"], "left")
    w = Window.partitionBy("store_id").orderBy("month").rowsBetween(Window.unboundedPreceding, 0)
    g = (g.withColumn("n_participants", F.sum(F.coalesce("new_n", F.lit(0))).over(w))
          .withColumn("n_repeat", F.sum(F.coalesce("new_repeat", F.lit(0))).over(w))
          .where(F.col("n_participants") >= max(1, int(min_participants)))
          .withColumn("pct_repeat", F.col("n_repeat") * 100.0 / F.col("n_participants"))
          .withColumn("engagement_score", F.round(F.lit(60.0) + 0.4 * F.col("pct_repeat"), 1))
          .drop("new_n", "new_repeat"))
    bench = g.groupBy("month").agg(weighted_average_col("engagement_score", "n_participants").alias("benchmark"))
    return g.join(bench, "month", "left")


def longitudinal_history(history: DataFrame, wide: DataFrame, participants: DataFrame, links: DataFrame,
                         bmi_slug: str = "bmi", bmi_col: str = "rec_med_bmi", min_year: int = 2019) -> DataFrame:
    """Score history for the longitudinal pages: the history rows plus the
    latest BMI per participant dated at its last completion, with gender
    and store attached; rows without a valid date or before ``min_year``
    are dropped."""
    from pulseframe.functions import rules
    hist = history.select("participant_id", "slug", "score_value", "completion_created_at",
                          F.lit("history").alias("source"))
    bmi = (wide.where(F.col(bmi_col).isNotNull())
           .select("participant_id", F.lit(bmi_slug).alias("slug"), F.col(bmi_col).alias("score_value"),
                   F.col("latest_completion_at").alias("completion_created_at"), F.lit("latest").alias("source")))
    g = participants.select(F.col("id").alias("participant_id"), rules.gender_code("gender_raw").alias("gender"))
    st = links.select("participant_id", "store_id")
    out = hist.unionByName(bmi).join(g, "participant_id", "left").join(st, "participant_id", "left")
    return out.where(F.col("completion_created_at").isNotNull() & (F.year("completion_created_at") >= min_year))


def bmi_as_history(wide: DataFrame, completions: DataFrame, value: str = "rec_med_bmi", slug: str = "bmi") -> DataFrame:
    """The latest BMI of every participant as a row of the score history, dated
    by the participant's last completion: (participant_id, slug, score_value,
    completion_created_at). Participants without a number are left out."""
    from pulseframe.functions.semantics import to_num
    last = completions.groupBy("participant_id").agg(F.max("created_at").alias("completion_created_at"))
    one = (wide.select("participant_id", to_num(value).alias("score_value"))
           .where(F.col("participant_id").isNotNull() & F.col("score_value").isNotNull())
           .groupBy("participant_id").agg(F.max("score_value").alias("score_value")))
    return one.join(last, "participant_id", "left").select(
        "participant_id", F.lit(slug).alias("slug"), "score_value", "completion_created_at")
