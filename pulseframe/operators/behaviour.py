"""Behaviour analytics: questionnaires, funnels, engagement, articles, purchases."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pulseframe.functions import rules
from pulseframe.functions.semantics import cut, day_start, days_between, pearson, to_num, weighted_average

# --------------------------------------------------------------------------
# Questionnaires
# --------------------------------------------------------------------------


def questionnaire_reach(completions: DataFrame, names: DataFrame | None = None,
                        exclude_name_parts: Sequence[str] = ("bloeddruk", "blood_pressure", "bloodpressure", "test_"),
                        participant: str = "participant_id", questionnaire: str = "questionnaire_id",
                        at: str = "created_at") -> DataFrame:
    """Per questionnaire: first and last completion, distinct participants,
    eligible participants (anyone with a completion at or after the
    questionnaire's first completion), percent (1 dp) and first year.

    The eligibility theta join is rewritten exactly: each participant is
    reduced to its last completion time, the (few) questionnaire start times
    are gathered into one small array, and each participant emits the
    questionnaires it is eligible for (``last >= first``). No pair table.
    """
    c = completions.select(participant, questionnaire, at).where(F.col(at).isNotNull())
    if names is not None:
        bad = F.lit(False)
        for part in exclude_name_parts:
            bad = bad | F.lower(F.col("name")).contains(part)
        keep = names.where(F.col("name").isNotNull() & ~bad).select(F.col("id").alias(questionnaire), "name")
        c = c.join(keep.select(questionnaire), questionnaire, "left_semi")
    per_q = c.groupBy(questionnaire).agg(F.min(at).alias("first_completion"), F.max(at).alias("last_completion"),
                                         F.countDistinct(participant).alias("n_completed"))
    starts = per_q.agg(F.collect_list(F.struct(F.col(questionnaire).alias("q"),
                                               F.col("first_completion").alias("t"))).alias("_starts"))
    last = c.where(F.col(participant).isNotNull()).groupBy(participant).agg(F.max(at).alias("_last"))
    eligible = (last.crossJoin(F.broadcast(starts))  # one row holding one entry per questionnaire
                .select(F.explode(F.filter("_starts", lambda s: s["t"] <= F.col("_last"))).alias("s"))
                .groupBy(F.col("s.q").alias(questionnaire)).agg(F.count(F.lit(1)).alias("n_eligible")))
    out = per_q.join(eligible, questionnaire, "left").fillna(0, ["n_eligible"])
    out = (out.withColumn("pct", F.round(F.try_divide(F.col("n_completed") * 100.0, F.col("n_eligible")), 1))
              .withColumn("first_year", F.year("first_completion")))
    if names is not None:
        out = out.join(names.select(F.col("id").alias(questionnaire), "name"), questionnaire, "left")
    return out


def questionnaire_count_dist(completions: DataFrame, participant: str = "participant_id",
                             questionnaire: str = "questionnaire_id", n_questionnaires: int | None = None) -> DataFrame:
    """Distribution of the number of distinct questionnaires per participant:
    participants and share per count, with KPI columns (exactly 1, 2 or more,
    all, mean count) repeated on every row."""
    per_p = (completions.where(F.col(participant).isNotNull() & F.col(questionnaire).isNotNull())
             .groupBy(participant).agg(F.countDistinct(questionnaire).alias("n_questionnaires")))
    dist = per_p.groupBy("n_questionnaires").agg(F.count(F.lit(1)).alias("n_participants"))
    all_q = F.lit(n_questionnaires) if n_questionnaires else F.col("_max_q")
    kpis = per_p.agg(F.count(F.lit(1)).alias("total"),
                     F.sum(F.when(F.col("n_questionnaires") == 1, 1).otherwise(0)).alias("kpi_one"),
                     F.sum(F.when(F.col("n_questionnaires") >= 2, 1).otherwise(0)).alias("kpi_two_plus"),
                     F.max("n_questionnaires").alias("_max_q"),
                     F.avg("n_questionnaires").alias("kpi_mean"))
    all_n = per_p.crossJoin(F.broadcast(kpis.select("_max_q"))).agg(
        F.sum(F.when(F.col("n_questionnaires") == all_q, 1).otherwise(0)).alias("kpi_all"))
    return (dist.crossJoin(F.broadcast(kpis)).crossJoin(F.broadcast(all_n))  # one-row frames
                .withColumn("share", F.col("n_participants") * 100.0 / F.col("total")).drop("_max_q"))


def questionnaire_overview(completions: DataFrame, questionnaires: DataFrame, participant: str = "participant_id",
                           questionnaire: str = "questionnaire_id") -> DataFrame:
    """Per questionnaire of the dimension: completions, distinct participants
    and participants who filled it more than once (0 when none)."""
    per_pq = (completions.where(F.col(questionnaire).isNotNull())
              .groupBy(questionnaire, participant).agg(F.count(F.lit(1)).alias("_k")))
    per_q = per_pq.groupBy(questionnaire).agg(
        F.sum("_k").alias("completions"),
        F.count(F.when(F.col(participant).isNotNull(), 1)).alias("participants"),
        F.sum(F.when(F.col(participant).isNotNull() & (F.col("_k") > 1), 1).otherwise(0)).alias("repeaters"))
    dim = questionnaires.select(F.col("id").alias(questionnaire), "name")
    return (dim.join(per_q, questionnaire, "left")
               .fillna(0, ["completions", "participants", "repeaters"]))


def consecutive_gaps(df: DataFrame, keys: Sequence[str], at: str) -> DataFrame:
    """Days between consecutive rows of each key (floor of elapsed days), one
    row per gap: (keys..., gap).

    A key's rows are split by calendar day: gaps inside a day come from a
    window over (key, day); the gap before each day's first row comes from a
    window over the key's per-day (first, last) table. No window ever holds
    all rows of a busy key, only one key-day or one key's day list."""
    d = df.select(*keys, at).where(F.col(at).isNotNull()).withColumn("_day", day_start(at))
    w_in = Window.partitionBy(*keys, "_day").orderBy(at)
    inner = (d.withColumn("gap", days_between(F.lag(at).over(w_in), F.col(at)))
              .where(F.col("gap").isNotNull()).select(*keys, "gap"))
    per_day = d.groupBy(*keys, "_day").agg(F.min(at).alias("_first"), F.max(at).alias("_last"))
    w_days = Window.partitionBy(*keys).orderBy("_day")
    across = (per_day.withColumn("gap", days_between(F.lag("_last").over(w_days), F.col("_first")))
                     .where(F.col("gap").isNotNull()).select(*keys, "gap"))
    return inner.unionByName(across)


def questionnaire_repeats(completions: DataFrame, participant: str = "participant_id",
                          questionnaire: str = "questionnaire_id", at: str = "created_at") -> DataFrame:
    """(participant, questionnaire) pairs filled more than once: count, first,
    last, span days and mean/min/max days between consecutive fills, with
    the participant id hashed (first 12 hex of SHA-256)."""
    keys = [participant, questionnaire]
    c = completions.select(*keys, at).where(F.col(participant).isNotNull() & F.col(questionnaire).isNotNull())
    counts = c.groupBy(*keys).agg(F.count(F.lit(1)).alias("times_filled"), F.min(at).alias("first_date"),
                                  F.max(at).alias("last_date"), F.count(at).alias("_n_dated"))
    rep = counts.where((F.col("times_filled") > 1) & (F.col("_n_dated") > 1))
    dated = c.join(rep.select(*keys), keys, "left_semi")
    gaps = consecutive_gaps(dated, keys, at).groupBy(*keys).agg(
        F.avg("gap").alias("mean_gap_days"), F.min("gap").alias("min_gap_days"), F.max("gap").alias("max_gap_days"))
    return (rep.join(gaps, keys)
               .withColumn("span_days", days_between("first_date", "last_date"))
               .withColumn("participant_id_hashed", rules.hash_id(participant))
               .withColumn("mean_gap_days", F.round("mean_gap_days", 1))
               .drop("_n_dated"))


def questionnaire_dropoff(completions: DataFrame, item_scores: DataFrame, completion_id: str = "id",
                          participant: str = "participant_id", questionnaire: str = "questionnaire_id",
                          item: str = "slug") -> tuple[DataFrame, DataFrame]:
    """Answered items per completion (distinct slugs) against an expected
    length (p95 per questionnaire, rounded half-even, at least 1).

    Returns (per questionnaire table, one-row summary)."""
    answered = (item_scores.where(F.col("completion_id").isNotNull() & F.col(item).isNotNull())
                .groupBy("completion_id").agg(F.countDistinct(item).alias("answered")))
    c = (completions.select(F.col(completion_id).alias("completion_id"), participant, questionnaire)
         .join(answered, "completion_id", "left").fillna(0, ["answered"]))
    from pulseframe.operators.describe import quantile_table
    expected = (quantile_table(c, [questionnaire], "answered", [0.95], ["_p95"])
                .select(questionnaire, F.greatest(F.bround("_p95", 0), F.lit(1.0)).alias("expected_items")))
    d = (c.join(expected, questionnaire, "left").fillna(1.0, ["expected_items"])
          .withColumn("completion_pct", F.least(F.greatest(F.col("answered") / F.col("expected_items"), F.lit(0.0)),
                                                F.lit(1.0)))
          .withColumn("half_dropped", F.col("completion_pct") < 0.5)
          .withColumn("nearly_done", F.col("completion_pct") >= 0.8))
    # Per-questionnaire and overall medians in one distributed quantile pass:
    # the overall group is the same rows under one extra (flagged) key.
    both = (d.select(F.col(questionnaire).cast("string").alias("_qk"), F.lit(False).alias("_all"), "completion_pct")
             .unionByName(d.select(F.lit("*").alias("_qk"), F.lit(True).alias("_all"),
                                   "completion_pct")))
    meds = quantile_table(both, ["_all", "_qk"], "completion_pct", [0.5], ["_m"])
    med = (meds.where(~F.col("_all")).join(d.select(questionnaire).distinct()
                                            .withColumn("_qk", F.col(questionnaire).cast("string")), "_qk")
               .select(questionnaire, F.col("_m").alias("_med")))
    gmed = meds.where(F.col("_all")).select(F.col("_m").alias("_gmed"))
    per_q = d.groupBy(questionnaire).agg(
        F.count("completion_id").alias("completions"), F.countDistinct(participant).alias("participants"),
        F.max("expected_items").alias("expected_items"), F.round(F.avg("answered"), 1).alias("mean_answered"),
        F.round(F.avg(F.col("half_dropped").cast("double")) * 100, 1).alias("dropoff_half_pct"),
        F.round(F.avg(F.col("nearly_done").cast("double")) * 100, 1).alias("nearly_done_pct"))
    per_q = (per_q.join(med, questionnaire, "left")
                  .withColumn("median_completion_pct", F.round(F.col("_med") * 100, 1)).drop("_med"))
    summary = d.agg(F.count(F.lit(1)).alias("total_completions"),
                    F.round(F.avg(F.col("half_dropped").cast("double")) * 100, 1).alias("dropoff_half_pct"),
                    F.round(F.avg(F.col("nearly_done").cast("double")) * 100, 1).alias("nearly_done_pct"))
    summary = (summary.join(gmed, F.lit(True), "left")
                      .withColumn("median_completion_pct", F.round(F.col("_gmed") * 100, 1)).drop("_gmed"))
    corr = per_q.agg(F.when(F.count(F.lit(1)) >= 2, F.round(pearson("expected_items", "dropoff_half_pct"), 3))
                     .alias("corr_length_dropoff"))
    return per_q, summary.crossJoin(corr)


def frequency_vs_scores(completions: DataFrame, wide: DataFrame, scores: Mapping[str, str],
                        participant: str = "participant_id", questionnaire: str = "questionnaire_id") -> DataFrame:
    """Distinct questionnaires per participant, bucketed '1x'..'5x', '6+x';
    per bucket and score: participants, mean, std; plus the difference of
    the '6+x' (or highest) bucket mean versus '1x'."""
    per_p = (completions.where(F.col(participant).isNotNull() & F.col(questionnaire).isNotNull())
             .groupBy(participant).agg(F.countDistinct(questionnaire).alias("_nq")))
    label, key = rules.frequency_bucket("_nq")
    per_p = per_p.select(participant, label.alias("frequency"), key.alias("frequency_order"))
    long = (wide.select(participant, *[to_num(c).alias(c) for c in scores.values()])
            .unpivot([participant], list(scores.values()), "score", "value").where(F.col("value").isNotNull()))
    j = long.join(per_p, participant)
    out = j.groupBy("score", "frequency", "frequency_order").agg(
        F.countDistinct(participant).alias("n_participants"), F.avg("value").alias("mean"),
        F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("std"))
    base = out.where(F.col("frequency_order") == 1).select("score", F.col("mean").alias("_base"))
    return out.join(base, "score", "left").withColumn("diff_vs_1x", F.col("mean") - F.col("_base")).drop("_base")


def scores_per_store(wide: DataFrame, names: DataFrame, value: str, min_n: int = 1,
                     category_edges: tuple[list[float], list[str]] | None = None) -> DataFrame:
    """Per store: mean score (2 dp), participants with a score, participants,
    kept when at least ``min_n`` (and at least one) have a score; the total
    of the rounded means weighted by the participants with a score; category
    of each rounded mean."""
    x = wide.select("store_id", "participant_id", to_num(value).alias("_v")).where(F.col("store_id").isNotNull())
    per = x.groupBy("store_id").agg(F.avg("_v").alias("_mean"), F.count("_v").alias("n_with_score"),
                                    F.countDistinct("participant_id").alias("n_participants"))
    per = per.where(F.col("n_with_score") >= max(min_n, 1))
    per = per.withColumn("_mean", F.round(F.col("_mean").cast("decimal(28,9)"), 2).cast("double"))
    total = per.agg(weighted_average("_mean", "n_with_score").alias("weighted_total"))
    out = (per.join(names, "store_id", "left").crossJoin(F.broadcast(total))  # one row
              .withColumn("mean_score", F.col("_mean")))
    if category_edges is not None:
        out = out.withColumn("category", cut("_mean", category_edges[0], category_edges[1], True, True))
    return out.drop("_mean")


def available_indicators(wide: DataFrame, columns: Sequence[str], min_per_store: int = 5,
                         min_stores: int = 1, labels: Mapping[str, str] | None = None) -> DataFrame:
    """Per score column: stores having at least ``min_per_store`` participants
    with a value, and total participants with a value; kept with at least
    ``min_stores`` such stores."""
    long = (wide.select("store_id", "participant_id", *[to_num(c).alias(c) for c in columns])
            .unpivot(["store_id", "participant_id"], list(columns), "column", "value")
            .where(F.col("value").isNotNull()))
    per_s = long.groupBy("column", "store_id").agg(F.countDistinct("participant_id").alias("_n"))
    per_c = per_s.groupBy("column").agg(
        F.sum(F.when(F.col("store_id").isNotNull() & (F.col("_n") >= min_per_store), 1).otherwise(0)).alias("n_stores"),
        F.sum("_n").alias("n_participants"))
    out = per_c.where(F.col("n_stores") >= min_stores)
    if labels:
        out = out.withColumn("label", F.coalesce(rules.map_lookup(labels, "column"), rules.net_label("column")))
    else:
        out = out.withColumn("label", rules.net_label("column"))
    return out


def available_factors(history: DataFrame, slug: str = "slug") -> DataFrame:
    """Distinct slugs with their display labels."""
    return (history.select(F.trim(F.col(slug)).alias("slug")).where(F.col("slug").isNotNull() & (F.col("slug") != ""))
            .distinct().withColumn("label", rules.net_label(rules.slug_to_column("slug"))))


def available_stores(data: DataFrame, names: DataFrame, store: str = "store_id", min_rows: int = 1) -> DataFrame:
    """Stores that occur in ``data`` (at least ``min_rows`` rows), with names."""
    present = data.where(F.col(store).isNotNull()).groupBy(F.col(store).alias("store_id")).agg(
        F.count(F.lit(1)).alias("n_rows")).where(F.col("n_rows") >= min_rows)
    return present.join(names, "store_id")


# --------------------------------------------------------------------------
# Articles and purchases
# --------------------------------------------------------------------------


def article_overview(interactions: DataFrame, titles: DataFrame, users: DataFrame | None = None,
                     internal_domains: Sequence[str] = (), top: int = 20) -> tuple[DataFrame, DataFrame]:
    """Views per (article, title): views, distinct readers, last view; the top
    ``top`` by distinct readers, then views, then article; and a one-row
    summary (articles, views, readers, mean views per article). Readers whose
    e-mail local part is also that of an internal reader go first (anti join);
    readers without a users row or an e-mail stay."""
    v = interactions.where(F.col("type") == "view")
    if users is not None and internal_domains:
        u = users.select(F.col("id").alias("user_id"), rules.email_local_part("email").alias("_local"),
                         F.lower(F.trim("email")).alias("_email"))
        internal_cond = F.lit(False)
        for dom in internal_domains:
            internal_cond = internal_cond | F.col("_email").endswith(dom)
        readers = u.join(v.select("user_id").distinct(), "user_id", "left_semi")
        internal_locals = readers.where(internal_cond).select("_local").distinct()
        internal = readers.join(internal_locals, "_local", "left_semi").select("user_id")
        v = v.join(internal, "user_id", "left_anti")
    t = titles.groupBy("content_id").agg(F.min("title").alias("title"))  # one title per content
    j = (v.join(t, v["interactable_id"] == t["content_id"], "left")
          .withColumn("title", F.coalesce("title", F.lit("Onbekend artikel"))))
    per = j.groupBy("interactable_id", "title").agg(F.count(F.lit(1)).alias("views"),
                                                    F.countDistinct("user_id").alias("unique_readers"),
                                                    F.max("created_at").alias("last_view"))
    topk = per.orderBy(F.col("unique_readers").desc(), F.col("views").desc(), F.col("interactable_id").asc()).limit(top)
    summary = j.agg(F.countDistinct("interactable_id").alias("articles"), F.count(F.lit(1)).alias("total_views"),
                    F.countDistinct("user_id").alias("unique_readers"))
    summary = summary.withColumn("views_per_article", F.try_divide(F.col("total_views"), F.col("articles")))
    return topk, summary


def successful_purchases(orders: DataFrame, status: str = "status") -> DataFrame:
    return orders.where(F.lower(F.trim(F.col(status).cast("string"))).isin(list(rules.SUCCESS_STATUSES)))


def buyer_flags(wide: DataFrame, purchases: DataFrame) -> DataFrame:
    """Adds ``is_buyer``: participant_id OR user_id occurs among the buyers.
    Two left joins against distinct keys (no OR join)."""
    by_p = purchases.select(F.col("participant_id").alias("_bp")).where(F.col("_bp").isNotNull()).distinct()
    by_u = purchases.select(F.col("user_id").alias("_bu")).where(F.col("_bu").isNotNull()).distinct()
    return (wide.join(by_p, wide["participant_id"] == by_p["_bp"], "left")
                .join(by_u, wide["user_id"] == by_u["_bu"], "left")
                .withColumn("is_buyer", F.col("_bp").isNotNull() | F.col("_bu").isNotNull())
                .drop("_bp", "_bu"))


def buyers_comparison(wide: DataFrame, purchases: DataFrame, indicators: Mapping[str, str],
                      lower_is_better: Sequence[str] = ()) -> DataFrame:
    """Mean and n of each indicator for buyers and non-buyers, scaled 0-100
    per indicator over the two group means (inverted when lower is better;
    equal means use range 1)."""
    flagged = buyer_flags(wide, purchases)
    long = (flagged.select(F.when(F.col("is_buyer"), "kopers").otherwise("niet-kopers").alias("group"),
                           *[to_num(c).alias(c) for c in indicators.values()])
            .unpivot(["group"], list(indicators.values()), "column", "value").where(F.col("value").isNotNull()))
    g = long.groupBy("column", "group").agg(F.avg("value").alias("mean"), F.count("value").alias("n"))
    w = Window.partitionBy("column")
    lo, hi = F.min("mean").over(w), F.max("mean").over(w)
    rng = F.when(hi - lo == 0, F.lit(1.0)).otherwise(hi - lo)
    scaled = (F.col("mean") - lo) / rng * 100
    inv = F.col("column").isin(list(lower_is_better)) if lower_is_better else F.lit(False)
    labels = rules.map_lookup({v: k for k, v in indicators.items()}, "column")
    return (g.withColumn("scaled", F.when(inv, 100 - scaled).otherwise(scaled))
             .withColumn("indicator", labels))


def top_products(purchases: DataFrame, products: DataFrame, k: int = 10) -> DataFrame:
    """Most bought product names (trimmed), top ``k`` (ties by name)."""
    j = purchases.join(products.select(F.col("id").alias("product_id"), "name"), "product_id")
    return (j.groupBy(F.trim("name").alias("product")).agg(F.count(F.lit(1)).alias("n_purchases"))
             .orderBy(F.col("n_purchases").desc(), F.col("product")).limit(k))


def early_buyer_profile(wide: DataFrame, purchases: DataFrame, reference_at: str, indicators: Mapping[str, str],
                        lifestyle: str = "rec_ls_lifestyle_score") -> DataFrame:
    """Days from the reference date to the first purchase per participant,
    grouped (<=90 incl. negative, <=365, >365, no purchase); per group:
    participants, mean days, mean of each indicator and the modal lifestyle
    category (bins .5, 3.5, 5.5, 7.5, 10.5 -> codes 1-4)."""
    first = (purchases.where(F.col("participant_id").isNotNull())
             .groupBy("participant_id").agg(F.min("created_at").alias("first_purchase")))
    j = (wide.join(first, "participant_id", "left")
             .withColumn("days_to_purchase", days_between(reference_at, "first_purchase"))
             .withColumn("buyer_group", rules.days_between_bucket("days_to_purchase"))
             .withColumn("ls_cat", cut(to_num(lifestyle), [0.5, 3.5, 5.5, 7.5, 10.5], [1, 2, 3, 4])))
    aggs = [F.count(F.lit(1)).alias("n_participants"), F.avg("days_to_purchase").alias("mean_days"),
            F.mode("ls_cat", deterministic=True).alias("modal_lifestyle_cat")]
    aggs += [F.avg(to_num(c)).alias(f"mean_{k}") for k, c in indicators.items()]
    return j.groupBy("buyer_group").agg(*aggs)


# --------------------------------------------------------------------------
# Funnels and engagement
# --------------------------------------------------------------------------


def engagement_funnel(participants: DataFrame, completions: DataFrame, purchases: DataFrame) -> DataFrame:
    """Stages: registered, completed a questionnaire, bought, two or more
    distinct completions. One row per stage with its count."""
    reg = participants.select(F.col("id").alias("participant_id")).where(F.col("participant_id").isNotNull()).distinct()
    comp = completions.where(F.col("participant_id").isNotNull()).groupBy("participant_id").agg(
        F.countDistinct("id").alias("_nc"))
    buy = purchases.select("participant_id").where(F.col("participant_id").isNotNull()).distinct()
    f = (reg.join(comp, "participant_id", "left").join(buy.withColumn("_b", F.lit(1)), "participant_id", "left"))
    agg = f.agg(F.count(F.lit(1)).alias("registered"),
                F.count(F.when(F.col("_nc") >= 1, 1)).alias("completed"),
                F.count(F.when(F.col("_b").isNotNull(), 1)).alias("bought"),
                F.count(F.when(F.col("_nc") >= 2, 1)).alias("repeat"))
    stages = ["registered", "completed", "bought", "repeat"]
    return agg.select(F.explode(F.array(*[F.struct(F.lit(i + 1).alias("step"), F.lit(s).alias("stage"),
                                                   F.col(s).cast("long").alias("n"))
                                          for i, s in enumerate(stages)])).alias("s")).select("s.*")


def dataflow_funnel(wide: DataFrame, completions: DataFrame,
                    score_cols: Sequence[str] = ("rec_ls_lifestyle_score",)) -> DataFrame:
    """Sequential steps registered -> age known -> gender known -> started a
    questionnaire -> has a lifestyle score; each step requires the previous ones. Per
    step: count, percent of the first step, drop since the previous step and
    its percent.
    A parallel metric counts participants with a name-like field (postcode)."""
    started = completions.select("participant_id").where(F.col("participant_id").isNotNull()).distinct()
    f = wide.join(started.withColumn("_started", F.lit(True)), "participant_id", "left")
    has_scores = F.lit(False)
    for c in score_cols:
        has_scores = has_scores | to_num(c).isNotNull()
    s1 = F.lit(True)
    s2 = s1 & to_num("rec_age_current").isNotNull()
    s3 = s2 & to_num("rec_user_gender").isNotNull()
    s4 = s3 & F.col("_started").isNotNull()
    s5 = s4 & has_scores
    steps = [("Geregistreerd", s1), ("Leeftijd bekend", s2), ("Geslacht bekend", s3), ("Vragenlijst gestart", s4),
             ("Scores beschikbaar", s5)]
    agg = f.agg(*[F.sum(F.when(c, 1).otherwise(0)).cast("long").alias(f"s{i}") for i, (_, c) in enumerate(steps)],
                F.count("postal_code").alias("with_postcode"))
    long = agg.select(F.explode(F.array(*[F.struct(F.lit(i + 1).alias("step"), F.lit(n).alias("stage"),
                                                   F.col(f"s{i}").alias("n")) for i, (n, _) in enumerate(steps)]))
                      .alias("s"), "with_postcode").select("s.*", "with_postcode")
    w = Window.orderBy("step")
    before = F.lag("n").over(w)
    return (long.withColumn("pct_of_start", F.col("n") * 100.0 / F.first("n").over(w))
                .withColumn("drop_since_previous", F.coalesce(before - F.col("n"), F.lit(0)).cast("long"))
                .withColumn("pct_dropped", F.coalesce(F.round((before - F.col("n")) * 100.0 / F.greatest(before, F.lit(1)), 1),
                                                      F.lit(0.0))))


def funnel_name_metric(wide: DataFrame, bridge: DataFrame) -> DataFrame:
    """One row beside the data-flow funnel: participants with a name, their
    percent of all, and how many (and what percent) of those with a known age
    have none. ``bridge`` is ``linking.funnel_bridge``."""
    j = bridge.join(wide.select("participant_id", to_num("rec_age_current").alias("_age")), "participant_id", "left")
    aged = F.col("_age").isNotNull()
    agg = j.agg(F.count(F.lit(1)).alias("_all"), F.count(F.when(F.col("has_name"), 1)).alias("n"),
                F.count(F.when(aged, 1)).alias("_aged"),
                F.count(F.when(aged & F.col("has_name"), 1)).alias("n_after_age"), F.count("user_id").alias("with_user"))
    drop = F.greatest(F.col("_aged") - F.col("n_after_age"), F.lit(0))
    one = F.lit(1)
    return agg.select(F.lit("Naam ingevuld").alias("stage"), "n", "n_after_age", "with_user",
                      F.round(F.col("n") * 100.0 / F.greatest("_all", one), 1).alias("pct_of_start"),
                      drop.alias("drop_since_age"),
                      F.round(drop * 100.0 / F.greatest("_aged", one), 1).alias("pct_drop_since_age"))


# Engagement component weights (fixed values; normalised to a sum of 1).
ENGAGEMENT_WEIGHTS = {"completion": 0.30, "repeat": 0.20, "breadth": 0.15, "articles": 0.15, "challenge": 0.10,
                      "purchase": 0.10}

# Challenge statuses that count as taking part (fixed values).
CHALLENGE_STATUSES = ("completed", "active", "in_progress")


def challenge_share(participants: DataFrame, challenges: DataFrame) -> DataFrame:
    """Per store: people taking part in a challenge per hundred of its
    participants, at most 100."""
    takes = (challenges.where(F.lower(F.col("status")).isin(list(CHALLENGE_STATUSES)) & F.col("store_id").isNotNull())
             .groupBy("store_id").agg(F.countDistinct("user_ref").alias("_takes")))
    size = (participants.where(F.col("store_id").isNotNull())
            .groupBy("store_id").agg(F.countDistinct("id").alias("_size")))
    return takes.join(size, "store_id").select(
        "store_id", F.least(F.col("_takes") / F.col("_size") * 100.0, F.lit(100.0)).alias("_challenge"))


def engagement_scores(participants: DataFrame, lifestyle: DataFrame, completions: DataFrame, views: DataFrame,
                      purchases: DataFrame, challenges: DataFrame | None, questionnaires: Sequence | None = None,
                      n_questionnaires: int = 8, weights: Mapping[str, float] | None = None) -> DataFrame:
    """Per participant six components on 0-100 and their weighted sum (1 dp):
    completion (100 with a lifestyle score, 50 with any completion, else 0),
    repeat (100 with two or more completions), breadth (distinct
    questionnaires / n, capped, 1 dp), articles (100 if the user viewed one),
    purchase (100 if the participant bought), challenge (its store's
    ``challenge_share``; 0 without). Only completions of ``questionnaires``
    count where given. ``lifestyle`` holds (participant_id, lifestyle_score).
    Each source is aggregated per participant before the joins."""
    w = dict(weights or ENGAGEMENT_WEIGHTS)
    total = sum(w.values()) or 1.0
    w = {k: v / total for k, v in w.items()}
    known = completions.where(F.col("participant_id").isNotNull())
    if questionnaires is not None:
        known = known.where(F.col("questionnaire_id").isin(list(questionnaires)))
    comp = known.groupBy("participant_id").agg(F.countDistinct("id").alias("_nc"),
                                               F.countDistinct("questionnaire_id").alias("_nq"))
    scored = (lifestyle.where(to_num("lifestyle_score").isNotNull()).select("participant_id").distinct()
              .withColumn("_scored", F.lit(1)))
    art = views.select("user_id").where(F.col("user_id").isNotNull()).distinct().withColumn("_art", F.lit(1))
    buy = purchases.select("participant_id").where(F.col("participant_id").isNotNull()).distinct().withColumn("_buy", F.lit(1))
    base = participants.select(F.col("id").alias("participant_id"), "user_id", "store_id")
    j = (base.join(comp, "participant_id", "left").join(scored, "participant_id", "left")
             .join(art, "user_id", "left").join(buy, "participant_id", "left"))
    if challenges is not None:
        j = j.join(challenge_share(participants, challenges), "store_id", "left")
    else:
        j = j.withColumn("_challenge", F.lit(None).cast("double"))
    breadth = F.least(F.coalesce(F.col("_nq"), F.lit(0)), F.lit(n_questionnaires)) / float(n_questionnaires) * 100.0
    comps = {
        "completion": F.when(F.col("_scored").isNotNull(), 100.0).when(F.col("_nc") > 0, 50.0).otherwise(0.0),
        "repeat": F.when(F.col("_nc") >= 2, 100.0).otherwise(0.0),
        "breadth": F.round(breadth, 1),
        "articles": F.when(F.col("_art").isNotNull(), 100.0).otherwise(0.0),
        "challenge": F.coalesce(F.col("_challenge"), F.lit(0.0)),
        "purchase": F.when(F.col("_buy").isNotNull(), 100.0).otherwise(0.0),
    }
    out = j.select("participant_id", "store_id", *[c.alias(f"c_{k}") for k, c in comps.items()])
    score = sum((F.col(f"c_{k}") * float(w.get(k, 0.0)) for k in comps), F.lit(0.0))
    return out.withColumn("engagement_score", F.round(score.cast("decimal(28,9)"), 1).cast("double"))


def engagement_by_store(scores: DataFrame, names: DataFrame, min_participants: int = 1) -> DataFrame:
    """Per store: participants, mean engagement and mean components (1 dp), the
    benchmark (rounded store means weighted by participants) and the
    difference to it."""
    def mean(c):
        return F.round(F.avg(c).cast("decimal(28,9)"), 1).cast("double")
    comp_cols = [c for c in scores.columns if c.startswith("c_")]
    per = (scores.where(F.col("store_id").isNotNull()).groupBy("store_id")
           .agg(F.count(F.lit(1)).alias("n_participants"), mean("engagement_score").alias("mean_engagement"),
                *[mean(c).alias(f"mean_{c[2:]}") for c in comp_cols])
           .where(F.col("n_participants") >= min_participants))
    bench = per.agg(weighted_average("mean_engagement", "n_participants").alias("benchmark"))
    return (per.join(names, "store_id", "left").crossJoin(F.broadcast(bench))  # one row
               .withColumn("vs_benchmark", F.col("mean_engagement") - F.col("benchmark")))


def id_bitmaps(df: DataFrame, key: str) -> DataFrame:
    """(bucket, bits): the set of integer ids as exact bitmaps of 32,768 ids each.

    Bitmaps are built map-side and merged by OR, so what is shuffled does not
    grow with the number of rows, and no id travels singly."""
    ids = df.select(F.col(key).cast("long").alias("_k")).where(F.col("_k").isNotNull())
    return ids.groupBy(F.bitmap_bucket_number("_k").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("_k")).alias("bits"))


def link_coverage(sources: Sequence[tuple[str, DataFrame, str, DataFrame | None, str | None]],
                  notes: Mapping[str, str] | None = None) -> DataFrame:
    """(source, available, linkable, note, pct) for (name, data, key, links, link key).

    ``available`` counts the distinct ids of the source, ``linkable`` those
    that the link table holds too (all, where none is given; 0, where it is
    empty), ``pct`` is their share (1 dp; NULL where nothing is available).
    Sets are bitmaps that meet bucket by bucket, all sources in one pass."""
    notes = notes or {}
    parts = []
    for i, (_, data, key, links, link_key) in enumerate(sources):
        parts.append(id_bitmaps(data, key).select(F.lit(i).alias("i"), F.lit(0).alias("side"), "bucket", "bits"))
        other = id_bitmaps(links, link_key) if links is not None else id_bitmaps(data, key)
        parts.append(other.select(F.lit(i).alias("i"), F.lit(1).alias("side"), "bucket", "bits"))
    bits = parts[0]
    for p in parts[1:]:
        bits = bits.unionByName(p)
    met = bits.groupBy("i", "bucket").agg(
        F.coalesce(F.sum(F.when(F.col("side") == 0, F.bitmap_count("bits"))), F.lit(0)).alias("a"),
        F.when(F.count(F.lit(1)) == 2, F.bitmap_count(F.bitmap_and_agg("bits"))).otherwise(0).alias("b"))
    sums = met.groupBy("i").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    spark = sources[0][1].sparkSession
    rows = spark.createDataFrame([(i, s[0], notes.get(s[0], "")) for i, s in enumerate(sources)], "i int, source string, note string")
    out = rows.join(sums, "i", "left").select(
        "source", F.coalesce("a", F.lit(0)).alias("available"), F.coalesce("b", F.lit(0)).alias("linkable"), "note")
    return out.withColumn("pct", F.round(F.try_divide(F.col("linkable") * 100.0, F.col("available")), 1))


def age_vs_score(wide: DataFrame, score: str, age: str = "rec_age_current") -> DataFrame:
    """Age bins (0,25], (25,35], ... (65,150] -> mean, n and std of a score."""
    cat = cut(to_num(age), rules.AGE_SCORE_EDGES, rules.AGE_SCORE_LABELS)
    x = wide.select(cat.alias("age_group"), to_num(age).alias("_age"), to_num(score).alias("_s")).where(
        F.col("age_group").isNotNull() & F.col("_s").isNotNull())
    return x.groupBy("age_group").agg(F.avg("_s").alias("mean_score"), F.count("_age").alias("n"),
                                      F.stddev_samp("_s").alias("std"))


def wai_productivity(wide: DataFrame, wai: str) -> DataFrame:
    """Work-ability score against the productivity estimate clip(70+3*WAI):
    pair count and the OLS line of estimate on WAI."""
    x = wide.select(to_num(wai).alias("wai"), rules.productivity_estimate(wai).alias("estimate")).where(
        F.col("wai").isNotNull())
    return x.agg(F.count(F.lit(1)).alias("n"), F.avg("estimate").alias("mean_estimate"),
                 F.regr_slope("estimate", "wai").alias("slope"), F.regr_intercept("estimate", "wai").alias("intercept"),
                 F.regr_r2("estimate", "wai").alias("r2"))


PLAUSIBLE_YEARS = (2018, 2030)


def completed_ids(wide: DataFrame, key: str = "participant_id", at: str = "latest_completion_at") -> DataFrame:
    """Distinct ids of the participants with a completion (all participants
    where the table has no such column)."""
    rows = wide.where(F.col(at).isNotNull()) if at in wide.columns else wide
    return rows.select(F.col(key).alias("id")).where(F.col("id").isNotNull()).distinct()


def _with_activity(accounts: DataFrame, active_ids: DataFrame, created_at: str) -> DataFrame:
    act = active_ids.select(F.col("id").alias("_aid")).where(F.col("_aid").isNotNull()).distinct()
    return (accounts.join(act, accounts["id"] == act["_aid"], "left")
            .withColumn("_active", F.col("_aid").isNotNull()).withColumn("_year", F.year(created_at)))


def activation_by_year(accounts: DataFrame, active_ids: DataFrame, created_at: str = "created_at",
                       years: tuple[int, int] | None = PLAUSIBLE_YEARS) -> DataFrame:
    """Per registration year within ``years`` (both included): accounts, active
    ones (id in the active set), inactive ones and percent active (1 dp); a
    running total of accounts."""
    a = _with_activity(accounts, active_ids, created_at).where(F.col("_year").isNotNull())
    if years is not None:
        a = a.where(F.col("_year").between(*years))
    per = a.groupBy(F.col("_year").alias("year")).agg(
        F.count(F.lit(1)).alias("accounts"), F.sum(F.col("_active").cast("int")).cast("long").alias("active"))
    w = Window.orderBy("year").rowsBetween(Window.unboundedPreceding, 0)  # one row per year
    return (per.withColumn("inactive", F.col("accounts") - F.col("active"))
               .withColumn("pct_active", F.round(F.col("active") * 100.0 / F.col("accounts"), 1))
               .withColumn("cumulative_accounts", F.sum("accounts").over(w)))


def inactive_accounts(accounts: DataFrame, active_ids: DataFrame, consent_cols: Sequence[str],
                      created_at: str = "created_at") -> DataFrame:
    """Among inactive accounts: count, share (1 dp) and number with each consent /
    onboarding field filled, modal registration year and mean year; and the
    percentage of all accounts that is active."""
    a = _with_activity(accounts.where(F.col("id").isNotNull()), active_ids, created_at)
    idle = ~F.col("_active")
    year = F.when(idle, F.col("_year"))
    aggs = [F.coalesce(F.sum(idle.cast("long")), F.lit(0)).alias("n_inactive"), F.mode(year, deterministic=True).alias("modal_year"),
            F.avg(year).alias("mean_year"), F.round(F.avg(F.col("_active").cast("double")) * 100, 1).alias("pct_active")]
    for c in consent_cols:
        filled = F.when(idle, F.col(c).isNotNull().cast("double"))
        aggs += [F.round(F.avg(filled) * 100, 1).alias(f"pct_{c}"), F.coalesce(F.sum(filled), F.lit(0)).cast("long").alias(f"n_{c}")]
    return a.agg(*aggs)


def inactive_by_year(accounts: DataFrame, active_ids: DataFrame, created_at: str = "created_at") -> DataFrame:
    """Active and inactive accounts of every registration year."""
    a = _with_activity(accounts.where(F.col("id").isNotNull()), active_ids, created_at).where(F.col("_year").isNotNull())
    return a.groupBy(F.col("_year").alias("year")).agg(
        F.sum(F.col("_active").cast("long")).alias("active"), F.sum((~F.col("_active")).cast("long")).alias("inactive"))


def diet_score(cols: Sequence[str]) -> Column:
    from pulseframe.functions.semantics import row_mean
    return row_mean([to_num(c) for c in cols])


def diet_distribution(wide: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Share per diet category (mean of diet scores binned, include lowest)."""
    cat = cut("_diet", rules.DIET_EDGES, rules.DIET_LABELS, right=True, include_lowest=True)
    order = F.array_position(F.array(*[F.lit(x) for x in rules.DIET_LABELS]), F.col("diet_cat"))
    x = (wide.select(diet_score(cols).alias("_diet")).select(cat.alias("diet_cat"))
             .where(F.col("diet_cat").isNotNull()))
    per = x.groupBy("diet_cat").agg(F.count(F.lit(1)).alias("n"))
    tot = per.agg(F.sum("n").alias("_t"))
    return (per.crossJoin(F.broadcast(tot)).withColumn("pct", F.col("n") * 100.0 / F.col("_t"))
               .withColumn("order", order).drop("_t"))


def diet_by_bmi(wide: DataFrame, cols: Sequence[str], bmi_cat: str = "rec_med_bmi_cat") -> DataFrame:
    """Within each diet category: share of each BMI category and n."""
    cat = cut("_diet", rules.DIET_EDGES, rules.DIET_LABELS, right=True, include_lowest=True)
    x = wide.select(diet_score(cols).alias("_diet"), bmi_cat).select(cat.alias("diet_cat"), to_num(bmi_cat).alias("bmi_code")).where(
        F.col("diet_cat").isNotNull() & F.col("bmi_code").isNotNull())
    per = x.groupBy("diet_cat", "bmi_code").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("diet_cat")
    bmi_label = F.create_map(*[y for k, v in rules.BMI_LABELS.items() for y in (F.lit(float(k)), F.lit(v))])
    return (per.withColumn("n_in_diet_cat", F.sum("n").over(w))
               .withColumn("pct", F.col("n") * 100.0 / F.col("n_in_diet_cat"))
               .withColumn("bmi_label", bmi_label[F.col("bmi_code")]))


def scores_for_questionnaire(completions: DataFrame, item_scores: DataFrame, questionnaire: str) -> DataFrame:
    """Score slugs of one questionnaire by frequency: dashboard scores only
    (``rec_`` prefix), no ``_cat`` columns and no raw ``answers_`` blocks."""
    c = completions.where(F.col("questionnaire_id") == questionnaire).select(F.col("id").alias("completion_id"))
    s = item_scores.where(F.col("slug").startswith("rec_") & ~F.col("slug").endswith("_cat")
                          & ~F.col("slug").startswith("answers_"))
    return s.join(c, "completion_id").groupBy("slug").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "slug")
