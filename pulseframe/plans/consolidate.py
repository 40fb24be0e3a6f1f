"""Consolidation pipelines: the wide per-user score table, store-month
averages and the longitudinal history.

These compose the operators; each returns one lazy plan.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulseframe.functions import rules
from pulseframe.functions.semantics import month_start, row_mean, to_num
from pulseframe.operators.reshape import latest_per_key, unpivot_columns

# Category columns derived from a raw score column when they are wholly empty.
CATEGORY_RULES = {
    "rec_heartrisk_cat": ("rec_heartrisk", rules.heartrisk_category),
    "rec_med_bmi_cat": ("rec_med_bmi", rules.bmi_category),
    "rec_ls_stress_cat": ("rec_ls_stress_sum", rules.stress_category),
    "rec_ls_sleep_cat": ("rec_ls_sleep_psqi_sum", rules.sleep_category),
    "rec_med_age_cat": ("rec_age_current", rules.age_category3),
    "rec_ls_exercise_steps_cat": ("rec_ls_exercise_steps_per_day", rules.steps_category),
    "rec_med_blood_pressure_cat": ("rec_med_blood_pressure", rules.blood_pressure_category),
}

REQUIRED_COLUMNS = {
    "rec_user_gender": "int", "rec_age_current": "double", "rec_ls_lifestyle_score": "double",
    "rec_heartrisk_cat": "int", "rec_ls_stress_cat": "int", "rec_med_bmi_cat": "int",
    "rec_ls_sleep_cat": "int", "postal_code": "string",
}


def join_factor_slug(history: DataFrame, factors: DataFrame, factor_col: str = "questionnaire_factor_id") -> DataFrame:
    """History LEFT factors on factor id, then rows without a slug are dropped.

    The factors, a lookup table of a row per factor, are broadcast: a shuffle
    by so few ids would gather the whole history in as few tasks."""
    f = factors.select(F.col("id").alias("_fid"), F.col("slug").alias("_fslug"))
    return (history.join(F.broadcast(f), history[factor_col] == f["_fid"], "left")
                   .where(F.col("_fslug").isNotNull())
                   .drop(factor_col, "_fid").withColumnRenamed("_fslug", "slug"))


def wholly_null_flags(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One-row frame: ``<c>__all_null`` for each column (a global aggregate)."""
    return df.agg(*[(F.count(c) == 0).alias(f"{c}__all_null") for c in cols])


def with_columns_if_all_null(df: DataFrame, derived: Mapping[str, Column]) -> DataFrame:
    """Set each target to its derived value only when it is NULL in every row
    (the table-wide rule). One one-row aggregate decides for all targets and
    is joined back once, so the source occurs twice however many there are."""
    present = [t for t in derived if t in df.columns]
    if not present:
        return df.withColumns(dict(derived))
    flags = wholly_null_flags(df, present)
    out = df.crossJoin(F.broadcast(flags))  # one row: size proven
    return out.withColumns({t: F.when(F.col(f"{t}__all_null"), c).otherwise(F.col(t)) if t in present else c
                            for t, c in derived.items()}).drop(*flags.columns)


def latest_scores_wide(history: DataFrame, slug_columns: Mapping[str, str], participant: str = "participant_id",
                       slug: str = "slug", value: str = "score_value", at: str = "completion_created_at",
                       tiebreak: Sequence[str] = ("id",)) -> DataFrame:
    """Newest score per (participant, slug), pivoted to one column per slug
    (column name from ``slug_columns``).

    Dedupe and pivot are fused into one aggregation keyed by participant:
    per output column a ``max_by`` over the rows of its slugs, ordered by
    (timestamp present, timestamp, tiebreak, value). One shuffle instead of
    three (dedupe, pivot pre-aggregation, pivot), and the aggregate is
    combined map-side, so hot participants are reduced before the shuffle.
    The newest row wins even when its value is NULL, as in a plain
    latest-row pivot.
    """
    by_column: dict[str, list[str]] = {}
    for s_value, c in slug_columns.items():
        by_column.setdefault(c, []).append(s_value)
    order = F.struct(F.col(at).isNotNull(), F.col(at), *[F.col(t) for t in tiebreak], F.col(value))
    aggs = []
    for c, slugs in by_column.items():
        hit = F.col(slug).isin(slugs)
        aggs.append(F.max_by(F.when(hit, F.col(value)), F.when(hit, order)).alias(c))
    h = history.where(F.col(slug).isin(list(slug_columns)))
    return h.groupBy(participant).agg(*aggs)


def consolidate_scores(participants: DataFrame, history: DataFrame, completions: DataFrame,
                       store_employees: DataFrame | None, slug_columns: Mapping[str, str],
                       lifestyle_components: Sequence[str] | None = None) -> DataFrame:
    """The wide per-user table: demographics, latest score per slug, store,
    normalised gender, derived categories, last completion and lifestyle score.

    Table-wide rules of the original (store link only when no participant
    has one; categories only when the category column is wholly empty) are
    evaluated with one-row aggregates, so the plan stays lazy and distributed.
    Duplicate user_ids keep the row of the largest participant id.
    """
    demo = [c for c in ("store_id", "partner_id", "created_at", "deleted_at", "gender_raw", "age",
                        "postal_code", "segment", "balance") if c in participants.columns]
    base = participants.select(F.col("id").alias("participant_id"),
                               F.coalesce(F.col("user_id"), F.col("id")).alias("user_id"), *demo)
    wide = latest_scores_wide(history, slug_columns)
    df = base.join(wide, "participant_id", "left")

    if store_employees is not None:
        link = (store_employees.select("user_id", "store_id").where(F.col("user_id").isNotNull()
                                                                     & F.col("store_id").isNotNull())
                .groupBy("user_id").agg(F.min("store_id").alias("_emp_store")))
        has_any = df.agg((F.count("store_id") > 0).alias("_any_store"))
        df = (df.join(link, "user_id", "left").crossJoin(F.broadcast(has_any))
                .withColumn("store_id", F.when(F.col("_any_store"), F.col("store_id")).otherwise(F.col("_emp_store")))
                .drop("_emp_store", "_any_store"))

    df = df.withColumn("rec_user_gender", rules.gender_code("gender_raw")).drop("gender_raw")
    if "age" in df.columns:
        df = df.withColumnRenamed("age", "rec_age_current")
    derived = {cat: rule(raw) for cat, (raw, rule) in CATEGORY_RULES.items() if raw in df.columns}
    comps = list(lifestyle_components) if lifestyle_components is not None else \
        [c for c in df.columns if c.startswith("rec_ls_score_")]
    if comps:
        derived["rec_ls_lifestyle_score"] = row_mean([to_num(c) for c in comps])
    df = with_columns_if_all_null(df, derived)
    for c, t in REQUIRED_COLUMNS.items():
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast(t))

    last = (completions.select("participant_id", "created_at").where(F.col("participant_id").isNotNull())
            .groupBy("participant_id").agg(F.max("created_at").alias("latest_completion_at")))
    df = df.join(last, "participant_id", "left")

    df = df.where(F.col("user_id").isNotNull())
    # participant ids are unique, so they alone order the rows of a user
    return latest_per_key(df, ["user_id"], "participant_id", tiebreak=(), payload_tiebreak=False)


def store_month_averages(wide: DataFrame, user: str = "user_id", store: str = "store_id",
                         at: str = "latest_completion_at") -> DataFrame:
    """Unpivot every rec_/feat_ column -> (store, score_slug, month of the last
    completion): mean value and distinct users."""
    score_cols = [c for c in wide.columns if c.startswith("rec_") or c.startswith("feat_")]
    w = wide.select(to_num(user).alias("user_id"), to_num(store).cast("long").alias("store_id"),
                    F.col(at).alias("_at"), *[to_num(c).alias(c) for c in score_cols])
    w = w.where(F.col("user_id").isNotNull() & F.col("store_id").isNotNull() & F.col("_at").isNotNull())
    long = unpivot_columns(w, ["user_id", "store_id", "_at"], score_cols)
    return (long.groupBy("store_id", "score_slug", month_start("_at").alias("date"))
                .agg(F.avg("score_value").alias("average"),
                     F.countDistinct("user_id").alias("participants_count")))


def participants_with_factor_scores(participants: DataFrame, history: DataFrame,
                                    slug_columns: Mapping[str, str]) -> DataFrame:
    """Participants that have scores, straight from the history: newest
    non-null score per slug pivoted to columns, INNER joined to the
    participants, gender normalised, and the categories always derived from
    their raw scores (a missing BMI gives category -1 here)."""
    scores = latest_scores_wide(history.where(F.col("score_value").isNotNull()), slug_columns)
    demo = [c for c in ("store_id", "gender_raw", "age", "postal_code", "segment") if c in participants.columns]
    base = participants.select(F.col("id").alias("participant_id"),
                               F.coalesce(F.col("user_id"), F.col("id")).alias("user_id"), *demo)
    df = base.join(scores, "participant_id")
    if "gender_raw" in df.columns:
        df = df.withColumn("rec_user_gender", rules.gender_code("gender_raw")).drop("gender_raw")
    if "age" in df.columns:
        df = df.withColumnRenamed("age", "rec_age_current")
    for cat, (raw, rule) in CATEGORY_RULES.items():
        if raw in df.columns:
            expr = rules.bmi_category(raw, missing_code=-1) if cat == "rec_med_bmi_cat" else rule(raw)
            df = df.withColumn(cat, expr)
    return df
