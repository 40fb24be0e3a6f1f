"""Cohort filters and KPI aggregates over the wide participant table.

Filters compose into one plan. Table-wide decisions of the original (does
the store occur in this frame? what is the date range of this frame?) are
one-row aggregates cross-joined back, so nothing is collected to the driver.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulseframe.functions import rules
from pulseframe.functions.semantics import col, cut, day_start, to_num, to_ts

DATE_CANDIDATES = ("latest_completion_at", "completion_created_at", "completed_at", "created_at", "updated_at", "date")
UNKNOWN = "Onbekend"


def filter_gender(df: DataFrame, gender: str | None, column: str = "rec_user_gender") -> DataFrame:
    """'man' -> code 1, 'vrouw' -> code 0, anything else -> no filter."""
    if gender not in ("man", "vrouw") or column not in df.columns:
        return df
    return df.where(to_num(column) == (1 if gender == "man" else 0))


def filter_store(df: DataFrame, store_id: int | None, links: DataFrame | None = None,
                 store_col: str = "store_id", participant_col: str = "participant_id") -> DataFrame:
    """Rows of ``store_id``: directly when the store occurs in this frame, else
    through participant->store ``links``; unfiltered when neither applies."""
    if store_id is None:
        return df
    sid = int(store_id)
    direct = to_num(store_col) == sid if store_col in df.columns else F.lit(False)
    present = df.agg(F.max(F.coalesce(direct, F.lit(False))).alias("_direct_any"))
    out = df.crossJoin(F.broadcast(present))  # one row
    if links is None:
        return out.where(~F.col("_direct_any") | direct).drop("_direct_any")
    lk = links.where(to_num("store_id") == sid).select(F.col("participant_id").alias("_lp")).distinct()
    has_links = lk.agg((F.count(F.lit(1)) > 0).alias("_links_any"))
    out = (out.crossJoin(F.broadcast(has_links))
              .join(lk.withColumn("_in_link", F.lit(True)), F.col(participant_col) == F.col("_lp"), "left"))
    keep = (F.col("_direct_any") & direct) | \
           (~F.col("_direct_any") & F.col("_links_any") & F.col("_in_link").isNotNull()) | \
           (~F.col("_direct_any") & ~F.col("_links_any"))
    return out.where(keep).drop("_direct_any", "_links_any", "_lp", "_in_link")


def detect_date_column(df: DataFrame, candidates: Sequence[str] = DATE_CANDIDATES) -> str | None:
    """First candidate column that exists and holds any parseable timestamp.

    One aggregate job counts parseable values of all present candidates.
    """
    present = [c for c in candidates if c in df.columns]
    if not present:
        return None
    counts = df.agg(*[F.count(_as_ts(df, c)).alias(c) for c in present]).first()
    for c in present:
        if counts[c]:
            return c
    return None


def _as_ts(df: DataFrame, c: str) -> Column:
    t = dict(df.dtypes)[c]
    return F.col(c).cast("timestamp_ntz") if t.startswith("timestamp") or t == "date" else to_ts(c)


def filter_period(df: DataFrame, date_col: str, preset: str = "all", start: str | None = None,
                  end: str | None = None) -> DataFrame:
    """Presets relative to this frame's date range (normalised to midnight):
    '3m' / '1y' go back from the max date but not before the min date; 'all'
    keeps the range; 'custom' uses ``start``/``end``. Keeps [start, end + 1 day)."""
    ts = _as_ts(df, date_col)
    if preset == "custom" and start and end:
        lo, hi = F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")
        return df.where((ts >= day_start(lo)) & (ts < day_start(hi) + F.expr("INTERVAL 1 DAY")))
    rng = df.agg(day_start(F.min(ts)).alias("_dmin"),
                 day_start(F.max(ts)).alias("_dmax"))
    months = {"3m": 3, "1y": 12}.get(preset)
    if months:
        back = F.add_months(F.col("_dmax"), -months).cast("timestamp_ntz")
        rng = rng.withColumn("_start", F.greatest(F.col("_dmin"), back))
    else:
        rng = rng.withColumn("_start", F.col("_dmin"))
    rng = rng.withColumn("_end", F.col("_dmax") + F.expr("INTERVAL 1 DAY"))
    return (df.crossJoin(F.broadcast(rng))  # one row
              .where((ts >= F.col("_start")) & (ts < F.col("_end")))
              .drop("_dmin", "_dmax", "_start", "_end"))


def age_filter_category(c: str = "rec_age_current") -> Column:
    return F.coalesce(cut(to_num(c), rules.AGE_FILTER_EDGES, rules.AGE_FILTER_LABELS, right=False), F.lit(UNKNOWN))


def filter_age_category(df: DataFrame, selected: Sequence[str], column: str = "rec_age_current") -> DataFrame:
    if column not in df.columns:
        return df
    return df.where(age_filter_category(column).isin(list(selected)))


def filter_text_values(df: DataFrame, column: str | None, selected: Sequence[str] | None) -> DataFrame:
    if not column or column not in df.columns or selected is None:
        return df
    return df.where(rules.text_or_unknown(column).isin(list(selected)))


def text_options(df: DataFrame, column: str) -> DataFrame:
    """Distinct display values of a text column, ordered case-insensitively."""
    v = rules.text_or_unknown(column).alias("value")
    return df.select(v).distinct().orderBy(F.lower("value"), "value")


def apply_global_filters(df: DataFrame, gender: str | None = None, store_id: int | None = None,
                         links: DataFrame | None = None, period: str | None = None,
                         period_start: str | None = None, period_end: str | None = None,
                         age_categories: Sequence[str] | None = None,
                         text_filters: Mapping[str, Sequence[str]] | None = None,
                         date_col: str | None = None) -> DataFrame:
    """Conjunction of gender, store, period, age-category and text filters."""
    out = filter_gender(df, gender)
    out = filter_store(out, store_id, links)
    if period is not None:
        dc = date_col or detect_date_column(out)
        if dc:
            out = filter_period(out, dc, period, period_start, period_end)
    if age_categories is not None:
        out = filter_age_category(out, age_categories)
    for c, values in (text_filters or {}).items():
        out = filter_text_values(out, c, values)
    return out


def cohort_subset(df: DataFrame, gender: str | None = None, age_range: tuple[float, float] | None = None,
                  bmi_range: tuple[float, float] | None = None, stress_codes: Sequence[int] | None = None,
                  heartrisk_codes: Sequence[int] | None = None) -> DataFrame:
    """Sidebar cohort: one boolean expression. BMI keeps NULL BMI values."""
    cond = F.lit(True)
    if gender in ("man", "vrouw"):
        cond = cond & (to_num("rec_user_gender") == (1 if gender == "man" else 0))
    if age_range is not None:
        cond = cond & to_num("rec_age_current").between(*age_range)
    if bmi_range is not None:
        b = to_num("rec_med_bmi")
        cond = cond & (b.isNull() | b.between(*bmi_range))
    if stress_codes is not None:
        cond = cond & to_num("rec_ls_stress_cat").isin(list(stress_codes))
    if heartrisk_codes is not None:
        cond = cond & to_num("rec_heartrisk_cat").isin(list(heartrisk_codes))
    return df.where(cond)


def kpi_counts(df: DataFrame, kpis: Mapping[str, tuple[str, str, float]]) -> DataFrame:
    """All KPIs in one aggregate. ``kpis``: name -> (column, 'eq'|'ge', value).
    Each KPI yields ``<name>_count``, ``<name>_valid`` and ``<name>_pct``
    (percent of the non-null values; 0 when none are valid)."""
    aggs = []
    for name, (c, op, v) in kpis.items():
        x = to_num(c)
        hit = (x >= v) if op == "ge" else (x == v)
        aggs += [F.sum(F.when(hit, 1).otherwise(0)).cast("long").alias(f"{name}_count"),
                 F.count(x).alias(f"{name}_valid")]
    out = df.agg(*aggs)
    for name in kpis:
        out = out.withColumn(f"{name}_pct", F.coalesce(
            F.try_divide(F.col(f"{name}_count") * 100.0, F.col(f"{name}_valid")), F.lit(0.0)))
    return out


def cohort_quick_stats(subset: DataFrame, total: DataFrame) -> DataFrame:
    """Headline figures of a cohort: size and share of the whole population,
    women/men counts and shares, mean age, postcode coverage, high heart
    risk, mean BMI, high stress, poor sleep and mean lifestyle score.
    Shares use all cohort rows as denominator (NULLs included). One
    aggregate over the cohort plus one count of the population."""
    def cnt(cond):
        return F.sum(F.when(cond, 1).otherwise(0)).cast("long")

    def share(cond):
        return F.avg(F.when(cond, 1.0).otherwise(0.0)) * 100

    g = to_num("rec_user_gender")
    hr, st, sl = to_num("rec_heartrisk_cat"), to_num("rec_ls_stress_cat"), to_num("rec_ls_sleep_cat")
    stats = subset.agg(
        F.count(F.lit(1)).alias("n"),
        cnt(g == 0).alias("n_women"), share(g == 0).alias("pct_women"),
        cnt(g == 1).alias("n_men"), share(g == 1).alias("pct_men"),
        F.avg(to_num("rec_age_current")).alias("mean_age"),
        cnt(F.col("postal_code").isNotNull()).alias("n_postcode"),
        share(F.col("postal_code").isNotNull()).alias("pct_postcode"),
        cnt(hr == 2).alias("n_high_heartrisk"), share(hr == 2).alias("pct_high_heartrisk"),
        F.avg(to_num("rec_med_bmi")).alias("mean_bmi"),
        cnt(st == 2).alias("n_high_stress"), share(st == 2).alias("pct_high_stress"),
        cnt(sl >= 1).alias("n_poor_sleep"), share(sl >= 1).alias("pct_poor_sleep"),
        F.avg(to_num("rec_ls_lifestyle_score")).alias("mean_lifestyle"))
    tot = total.agg(F.count(F.lit(1)).alias("_total"))
    return (stats.crossJoin(tot)
                 .withColumn("pct_of_total", F.when(F.col("_total") > 0, F.round(F.col("n") * 100.0 / F.col("_total"), 1))
                             .otherwise(0.0)).drop("_total"))
