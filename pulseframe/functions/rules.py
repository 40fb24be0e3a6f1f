"""Scalar rules: category codes, normalisation of codes and text, label maps.

All rules are built-in column expressions (no Python UDFs). Where a rule
needs values that must equal the original dashboard's for the same results,
they are listed under FIXED VALUES below, as plain text.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from pulseframe.functions.semantics import col, cut, to_num

# ==========================================================================
# FIXED VALUES (must equal the original dashboard's to give the same results)
# ==========================================================================

# Score slug in the factor history -> dashboard column.
SLUG_TO_COLUMN = {
    "bmi": "rec_med_bmi",
    "bmi_cat": "rec_med_bmi_cat",
    "age": "rec_age_current",
    "gender": "rec_user_gender",
    "heartrisk": "rec_heartrisk",
    "heartrisk_cat": "rec_heartrisk_cat",
    "stress": "rec_ls_stress_sum",
    "stress_cat": "rec_ls_stress_cat",
    "sleep": "rec_ls_sleep_psqi_sum",
    "sleep_cat": "rec_ls_sleep_cat",
    "exercise": "rec_ls_score_exercise",
    "exercise_steps": "rec_ls_exercise_steps_per_day",
    "fruit": "rec_ls_score_fruit",
    "vegetables": "rec_ls_score_vegetables",
    "sugar": "rec_ls_score_sugar",
    "fat": "rec_ls_score_saturated_fat",
    "salt": "rec_ls_score_natrium",
    "alcohol": "rec_ls_score_alcohol",
    "smoking": "rec_smoking_answer",
    "dass_stress": "rec_dass_stress_score",
    "dass_anxiety": "rec_dass_anxiety_score",
    "dass_depression": "rec_dass_depression_score",
    "resilience": "rec_resilience_score",
    "wellbeing": "rec_wellbeing_score",
    "selfefficacy": "rec_self_efficacy_score",
    "health": "rec_health",
}

# Dashboard column -> factor-history slug (identity when absent).
COLUMN_TO_HISTORY_SLUG = {
    "rec_med_bmi": "bmi",
    "rec_heartrisk": "heartrisk",
    "rec_framingham_non_invasive": "heartrisk",
    "rec_ls_stress_sum": "stress",
    "rec_ls_sleep_psqi_sum": "sleep",
    "rec_ls_alcohol_total_per_week": "alcohol",
    "rec_ls_score_alcohol": "alcohol",
    "rec_ls_score_exercise": "exercise",
    "rec_ls_exercise_physical_activity_minutes_total": "exercise",
    "rec_ls_exercise_steps_per_day": "steps",
    "rec_ls_nutrition_fruit_fruit_per_day": "fruit",
    "rec_ls_score_fruit": "fruit",
    "rec_ls_vegetables_gram_per_day": "vegetables",
    "rec_ls_score_vegetables": "vegetables",
    "rec_ls_nutrition_sugar_per_day": "sugar",
    "rec_ls_score_sugar": "sugar",
    "rec_ls_nutrition_saturated_fat_per_day": "fat",
    "rec_ls_score_saturated_fat": "fat",
    "rec_ls_nutrition_natrium_per_day": "salt",
    "rec_ls_score_natrium": "salt",
    "rec_smoking_answer": "smoking",
    "rec_ls_lifestyle_score": "wellbeing",
    "rec_resilience_score": "resilience",
    "rec_wellbeing_score": "wellbeing",
    "rec_self_efficacy_score": "selfefficacy",
    "rec_dass_stress_score": "dass_stress",
    "rec_dass_anxiety_score": "dass_anxiety",
    "rec_dass_depression_score": "dass_depression",
    "rec_asr_job_satisfaction_score": "job_satisfaction",
    "rec_asr_working_attitude_score": "working_attitude",
    "rec_asr_workload_score": "workload",
    "rec_asr_work_ability_score": "work_life_balance",
    "rec_asr_wai_score": "work_life_balance",
    "rec_asr_burn_out_score": "health",
    "rec_asr_personal_competences_score": "competences",
    "rec_asr_minor_mental_complaints_score": "mental_complaints",
}

# Score categories: (edges, labels); -inf/+inf open ends, right-closed bins.
INF = float("inf")
SCORE_CATEGORIES = {
    "rec_ls_lifestyle_score": ([-INF, 3.5, 7.5, INF], ["Slecht", "Matig", "Goed"]),
    "rec_med_bmi": ([-INF, 18.5, 25.0, INF], ["Matig", "Goed", "Slecht"]),
    "rec_ls_stress_sum": ([-INF, 5.0, 14.0, INF], ["Goed", "Matig", "Slecht"]),
    "rec_ls_sleep_psqi_sum": ([-INF, 5.0, 10.0, INF], ["Goed", "Matig", "Slecht"]),
    "rec_dass_stress_score": ([-INF, 14.0, 18.0, INF], ["Goed", "Matig", "Slecht"]),
    "rec_dass_anxiety_score": ([-INF, 7.0, 9.0, INF], ["Goed", "Matig", "Slecht"]),
    "rec_dass_depression_score": ([-INF, 9.0, 13.0, INF], ["Goed", "Matig", "Slecht"]),
}

# Sleep answers in several languages -> canonical bucket, and bucket order.
SLEEP_TEXT_MAP = {
    "Minder dan 6 uur of meer dan 10 uur": "Minder dan 6 uur",
    "Less than 6 hours or more than 10 hours": "Minder dan 6 uur",
    "Menos de 6 horas o más de 10 horas": "Minder dan 6 uur",
    "Weniger als 6 Stunden oder mehr als 10 Stunden": "Minder dan 6 uur",
    "6-7 uur": "6-7 uur",
    "6-7 hours": "6-7 uur",
    "6-7 Stunden": "6-7 uur",
    "De 6 a 7 horas": "6-7 uur",
    "Entre 6 et 7 heures": "6-7 uur",
    "7-9 uur": "7-9 uur",
    "7-9 hours": "7-9 uur",
    "De 7 a 9 horas": "7-9 uur",
    "Entre 7 et 9 heures": "7-9 uur",
    "9-10 uur": "9-10 uur",
    "9-10 hours": "9-10 uur",
    "Entre 9 et 10 heures": "9-10 uur",
}
SLEEP_ORDER = ["Minder dan 6 uur", "6-7 uur", "7-9 uur", "9-10 uur"]

# Code -> label maps.
GENDER_LABELS = {0: "Vrouw", 1: "Man"}
HEARTRISK_LABELS = {0: "Laag", 1: "Matig", 2: "Hoog"}
STRESS_LABELS = {0: "Laag", 1: "Matig", 2: "Hoog"}
AGE_LABELS = {0: "Jong (<40)", 1: "Middel (40-55)", 2: "Ouder (>55)"}
BMI_LABELS = {-2: "Ernstig ondergewicht", -1: "Ondergewicht", 0: "Normaal gewicht", 1: "Overgewicht", 2: "Obesitas"}

# Prefixes stripped from column names for display labels, in this order.
LABEL_PREFIXES = ("rec_", "ls_", "med_", "asr_", "digital_detox_")
LABEL_ACRONYMS = (("psqi", "PSQI"), ("dass", "DASS"), ("wai", "WAI"))
QUALITY_LABEL_PREFIXES = ("rec_", "ls_", "med_", "asr_")

# Change periods (days since the first measurement) for change_vs_first.
CHANGE_PERIOD_EDGES = [0, 180, 365, 730, 1095, 99999]
CHANGE_PERIOD_LABELS = ["0-6 mnd", "6-12 mnd", "1-2 jaar", "2-3 jaar", "3+ jaar"]

# Age bins of the age-versus-score table and the global age filter.
AGE_SCORE_EDGES = [0, 25, 35, 45, 55, 65, 150]
AGE_SCORE_LABELS = ["18-25", "26-35", "36-45", "46-55", "56-65", "65+"]
AGE_FILTER_EDGES = [0, 30, 40, 50, 60, INF]
AGE_FILTER_LABELS = ["<30", "30-40", "40-50", "50-60", "60+"]
BIAS_AGE_EDGES = [0, 30, 50, 100]
BIAS_AGE_LABELS = ["<30", "30-50", ">50"]

# Diet score bins (include lowest) and labels.
DIET_EDGES = [0, 2, 2.8, 3.4, 4.2, 5.01]
DIET_LABELS = ["Slecht", "Matig", "Voldoende", "Goed", "Uitstekend"]

# Effect size thresholds on |d|.
EFFECT_SIZE_LABELS = ((0.2, "Verwaarloosbaar"), (0.5, "Klein"), (0.8, "Matig"))
EFFECT_SIZE_ELSE = "Groot"

# Smoking answer groups {0}, {1..4}, {5, 6}.
SMOKING_GROUPS = ("Nooit gerookt", "Ex-roker", "Roker")

# Buyer groups by days from registration to first purchase.
BUYER_GROUPS = ("Vroege koper (≤90 dagen)", "Late koper (91-365 dagen)", "Zeer late koper (>365 dagen)", "Geen aankoop")

# Statuses counted as a successful purchase; statuses excluded as failed.
SUCCESS_STATUSES = ("completed", "paid", "success", "shipped", "delivered", "voltooid", "betaald")
FAILED_STATUSES = ("cancelled", "canceled", "failed", "refunded")

# ==========================================================================


def map_lookup(mapping: Mapping, c: ColumnOrName) -> Column:
    """Literal map lookup (NULL when absent)."""
    items = []
    for k, v in mapping.items():
        items += [F.lit(k), F.lit(v)]
    return F.create_map(*items)[col(c)]


ColumnOrName = Column | str


def slug_to_column(c: ColumnOrName) -> Column:
    """Trim; blank -> NULL; rec_/feat_ names kept; else mapped; else NULL."""
    s = F.trim(col(c).cast("string"))
    kept = s.startswith("rec_") | s.startswith("feat_")
    return F.when(s.isNull() | (s == ""), None).when(kept, s).otherwise(map_lookup(SLUG_TO_COLUMN, s))


def column_to_history_slug(c: ColumnOrName) -> Column:
    return F.coalesce(map_lookup(COLUMN_TO_HISTORY_SLUG, c), col(c))


def gender_code(c: ColumnOrName) -> Column:
    """1/0 from numbers; text starting with M -> 1, V or F -> 0 (text wins); else NULL."""
    num = to_num(c)
    txt = F.upper(F.trim(col(c).cast("string")))
    return (F.when(txt.startswith("M"), 1)
             .when(txt.startswith("V") | txt.startswith("F"), 0)
             .when(num == 1, 1).when(num == 0, 0)).cast("int")


def bmi_category(c: ColumnOrName, missing_code: int | None = 0) -> Column:
    """>=30 -> 2, >=25 -> 1, >=18.5 -> 0, else -1; missing -> ``missing_code``."""
    x = to_num(c)
    out = F.when(x >= 30, 2).when(x >= 25, 1).when(x >= 18.5, 0).when(x < 18.5, -1)
    return (out if missing_code is None else F.coalesce(out, F.lit(missing_code))).cast("int")


def _three_level(x: Column, hi: float, mid: float, strict: bool = False) -> Column:
    if strict:
        return F.when(x > hi, 2).when(x > mid, 1).otherwise(0).cast("int")
    return F.when(x >= hi, 2).when(x >= mid, 1).otherwise(0).cast("int")


def heartrisk_category(c: ColumnOrName) -> Column:
    return _three_level(to_num(c), 20, 10)


def stress_category(c: ColumnOrName, hi: float = 40, mid: float = 20) -> Column:
    return _three_level(to_num(c), hi, mid)


def sleep_category(c: ColumnOrName) -> Column:
    return _three_level(to_num(c), 10, 5, strict=True)


def age_category3(c: ColumnOrName) -> Column:
    return _three_level(to_num(c), 55, 40)


def steps_category(c: ColumnOrName, scale_small: bool = False) -> Column:
    """>=10000 -> 2, >=5000 -> 1, else 0. ``scale_small`` multiplies values
    below 1000 by 1000 (steps recorded in thousands)."""
    x = to_num(c)
    if scale_small:
        x = F.when(x < 1000, x * 1000).otherwise(x)
    return _three_level(x, 10000, 5000)


def steps_scale(value: ColumnOrName, column_name: ColumnOrName, steps_column: str = "rec_ls_exercise_steps_per_day") -> Column:
    """Steps are stored in thousands: x1000 for the steps score only (matched
    on the exact column name)."""
    return F.when(col(column_name) == steps_column, col(value) * 1000).otherwise(col(value))


def blood_pressure_category(c: ColumnOrName) -> Column:
    return _three_level(to_num(c), 2, 1)


def inactive_flag(steps_thousands: ColumnOrName, minutes: ColumnOrName) -> Column:
    """0 when active (steps*1000 >= 5000 or minutes >= 250), 1 when both known and
    below, else NULL."""
    s = to_num(steps_thousands) * 1000
    m = to_num(minutes)
    return F.when((s >= 5000) | (m >= 250), 0).when((s < 5000) & (m < 250), 1).cast("int")


def score_category(c: ColumnOrName, column_name: str) -> Column:
    edges, labels = SCORE_CATEGORIES[column_name]
    return cut(to_num(c), edges, labels, right=True, include_lowest=True)


def smoking_group(c: ColumnOrName) -> Column:
    x = to_num(c)
    return (F.when(x == 0, SMOKING_GROUPS[0]).when(x.between(1, 4), SMOKING_GROUPS[1])
             .when(x.isin(5, 6), SMOKING_GROUPS[2]))


def effect_size_label(d: ColumnOrName) -> Column:
    a = F.abs(col(d))
    out = None
    for thr, label in EFFECT_SIZE_LABELS:
        out = F.when(a < thr, label) if out is None else out.when(a < thr, label)
    return out.when(a.isNotNull(), EFFECT_SIZE_ELSE)


def frequency_bucket(n: ColumnOrName, top: int = 5) -> tuple[Column, Column]:
    """(label, sort key): '1x'..'5x', then '6+x'."""
    x = col(n).cast("long")
    label = F.when(x <= top, F.concat(x.cast("string"), F.lit("x"))).otherwise(F.lit(f"{top + 1}+x"))
    key = F.least(x, F.lit(top + 1))
    return label, key


def days_between_bucket(days: ColumnOrName) -> Column:
    d = col(days)
    return (F.when(d.isNull(), BUYER_GROUPS[3]).when(d <= 90, BUYER_GROUPS[0])
             .when(d <= 365, BUYER_GROUPS[1]).otherwise(BUYER_GROUPS[2]))


def opacity_by_count(n: ColumnOrName) -> Column:
    x = col(n)
    clamped = F.least(F.greatest(x, F.lit(1)), F.lit(50))
    return F.when(x.isNull() | (x == 0), 0.0).otherwise(0.15 + (clamped - 1) / 49.0 * 0.70)


def productivity_estimate(wai: ColumnOrName) -> Column:
    return F.least(F.greatest(F.lit(70.0) + 3 * to_num(wai), F.lit(0.0)), F.lit(100.0))


def winsor_cap(c: ColumnOrName, limit: float) -> Column:
    return F.least(col(c), F.lit(1.5 * limit))


def net_label(name: ColumnOrName) -> Column:
    """Column name -> display label: strip prefixes anywhere, '_' -> ' ',
    restore acronyms, trim, then title-case (last, as the original does)."""
    s = col(name)
    for p in LABEL_PREFIXES:
        s = F.replace(s, F.lit(p), F.lit(""))
    s = F.replace(s, F.lit("_"), F.lit(" "))
    for a, b in LABEL_ACRONYMS:
        s = F.replace(s, F.lit(a), F.lit(b))
    return F.initcap(F.lower(F.trim(s)))


def quality_label(name: ColumnOrName, known: Mapping[str, str] | None = None) -> Column:
    s = col(name)
    for p in QUALITY_LABEL_PREFIXES:
        s = F.replace(s, F.lit(p), F.lit(""))
    s = F.trim(F.replace(s, F.lit("_"), F.lit(" ")))
    cleaned = F.concat(F.upper(F.substring(s, 1, 1)), F.lower(F.substring(s, 2, 1 << 30)))
    return F.coalesce(map_lookup(known, name), cleaned) if known else cleaned


def locale_normalize(c: ColumnOrName) -> Column:
    return F.lower(F.replace(F.trim(col(c)), F.lit("-"), F.lit("_")))


def email_local_part(c: ColumnOrName) -> Column:
    return F.split(F.lower(F.trim(col(c))), "@").getItem(0)


def hash_id(c: ColumnOrName) -> Column:
    return F.substring(F.sha2(col(c).cast("string"), 256), 1, 12)


def pc4(c: ColumnOrName) -> Column:
    return F.nullif(F.regexp_extract(col(c).cast("string"), r"(\d{4})", 1), F.lit(""))


def pc3(c: ColumnOrName) -> Column:
    return F.substring(pc4(c), 1, 3)


def region_flag(country: ColumnOrName, postal: ColumnOrName) -> Column:
    """'Nederland' / 'Buitenland' from country text, else from a 4-digit postcode."""
    ctry = F.upper(F.trim(col(country).cast("string")))
    return (F.when(ctry.isin("NL", "NEDERLAND", "NETHERLANDS"), "Nederland")
             .when(ctry.isNotNull() & (ctry != ""), "Buitenland")
             .when(pc4(postal).isNotNull(), "Nederland")
             .otherwise("Onbekend"))


def text_or_unknown(c: ColumnOrName, unknown: str = "Onbekend") -> Column:
    return F.coalesce(F.nullif(F.trim(col(c).cast("string")), F.lit("")), F.lit(unknown))


def sleep_bucket(c: ColumnOrName) -> tuple[Column, Column]:
    """(canonical bucket, sort key) of a multilingual sleep answer."""
    b = map_lookup(SLEEP_TEXT_MAP, F.trim(col(c)))
    return b, F.array_position(F.array(*[F.lit(x) for x in SLEEP_ORDER]), b)


def labels_for(mapping: Mapping, c: ColumnOrName) -> Column:
    return map_lookup(mapping, c)


def is_in(c: ColumnOrName, values: Sequence) -> Column:
    return col(c).isin(list(values))
