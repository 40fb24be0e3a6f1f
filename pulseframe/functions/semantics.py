"""Column-expression helpers that pin down pandas-flavoured semantics in Spark.

Every helper returns a ``Column`` (or a list of aggregate ``Column``s) so it
stays inside whole-stage codegen; none of them collects data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ColumnOrName = Column | str

MICROS_PER_DAY = 86_400_000_000


def col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --------------------------------------------------------------------------
# S1 / S2: coercing text to numbers and timestamps
# --------------------------------------------------------------------------

def to_num(c: ColumnOrName) -> Column:
    """Lenient value -> double: blanks, 'None', unparsable text and NaN become
    NULL, also the number literals of a Java cast that no import file means
    ('12d', '1f', '0x1p3'). The type test folds at planning, so numeric input
    is a plain widening cast (no text round trip)."""
    x = col(c)
    text = F.regexp_replace(x.cast("string"), r"(?i)(?<=[0-9.])[df]\s*$|x", "?")
    number = F.when(F.typeof(x) == "string", text.try_cast("double")).otherwise(x.try_cast("double"))
    return F.nanvl(number, F.lit(None).cast("double"))


DAYFIRST_FORMATS = ("dd-MM-yyyy HH:mm:ss", "dd-MM-yyyy", "dd/MM/yyyy HH:mm:ss", "dd/MM/yyyy")
ISO_FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd")


def to_ts(c: ColumnOrName, dayfirst: bool = False) -> Column:
    """Lenient text -> timestamp_ntz; unparsable values become NULL.

    With ``dayfirst`` the day-month-year layouts are tried before ISO ones.
    """
    s = F.trim(col(c).cast("string"))
    fmts = (DAYFIRST_FORMATS + ISO_FORMATS) if dayfirst else (ISO_FORMATS + DAYFIRST_FORMATS)
    tries = [F.try_to_timestamp(s, F.lit(f)) for f in fmts]
    return F.coalesce(*tries).cast("timestamp_ntz")


def null_if_text_null(c: ColumnOrName) -> Column:
    """Map 'NULL', 'None', 'nan' and blank text to NULL (soft-delete markers)."""
    s = F.trim(col(c).cast("string"))
    return F.when(s.isNull() | F.lower(s).isin("", "null", "none", "nan", "nat"), None).otherwise(s)


# --------------------------------------------------------------------------
# Time helpers (S19 and the day-difference rule)
# --------------------------------------------------------------------------

def month_start(c: ColumnOrName) -> Column:
    """First day of the month as timestamp_ntz (date arithmetic, no session
    time zone involved)."""
    return F.trunc(F.to_date(col(c)), "month").cast("timestamp_ntz")


def day_start(c: ColumnOrName) -> Column:
    """Midnight of the day as timestamp_ntz (no session time zone involved)."""
    return F.to_date(col(c)).cast("timestamp_ntz")


EPOCH = "1970-01-01 00:00:00"


def epoch_micros(c: ColumnOrName) -> Column:
    """Microseconds since 1970-01-01 of a wall-clock timestamp (time-zone free)."""
    return F.timestamp_diff("MICROSECOND", F.lit(EPOCH).cast("timestamp_ntz"), col(c).cast("timestamp_ntz"))


def days_between(start: ColumnOrName, end: ColumnOrName) -> Column:
    """Whole elapsed days (floor), like pandas ``(end - start).dt.days``;
    computed on wall-clock values, independent of the session time zone."""
    diff = F.timestamp_diff("MICROSECOND", col(start).cast("timestamp_ntz"), col(end).cast("timestamp_ntz"))
    return F.floor(diff / F.lit(float(MICROS_PER_DAY))).cast("long")


# --------------------------------------------------------------------------
# S10: binning
# --------------------------------------------------------------------------

def cut(c: ColumnOrName, edges: Sequence[float], labels: Sequence | None = None,
        right: bool = True, include_lowest: bool = False) -> Column:
    """pandas ``cut``: bin ``c`` by ``edges``; out of range -> NULL.

    Returns the label of the bin (or its 0-based code when ``labels`` is None).
    """
    x = col(c)
    out = None
    n = len(edges) - 1
    for i in range(n):
        lo, hi = float(edges[i]), float(edges[i + 1])
        if right:
            lower_ok = (x >= lo) if (include_lowest and i == 0) else (x > lo)
            cond = lower_ok & (x <= hi)
        else:
            upper_ok = (x <= hi) if (include_lowest and i == n - 1) else (x < hi)
            cond = (x >= lo) & upper_ok
        value = F.lit(labels[i]) if labels is not None else F.lit(i)
        out = F.when(cond, value) if out is None else out.when(cond, value)
    return out


def cut_sql(expr: str, edges: Sequence[float], labels: Sequence | None = None,
            right: bool = True, include_lowest: bool = False) -> str:
    """The same rule as ``cut`` written as a SQL CASE (used by oracle text)."""
    parts = []
    n = len(edges) - 1
    for i in range(n):
        lo, hi = float(edges[i]), float(edges[i + 1])
        if right:
            lo_op = ">=" if (include_lowest and i == 0) else ">"
            terms = [f"({expr}) {lo_op} {lo!r}" if lo != float("-inf") else f"({expr}) IS NOT NULL",
                     f"({expr}) <= {hi!r}" if hi != float("inf") else f"({expr}) IS NOT NULL"]
        else:
            hi_op = "<=" if (include_lowest and i == n - 1) else "<"
            terms = [f"({expr}) >= {lo!r}" if lo != float("-inf") else f"({expr}) IS NOT NULL",
                     f"({expr}) {hi_op} {hi!r}" if hi != float("inf") else f"({expr}) IS NOT NULL"]
        cond = " AND ".join(terms)
        val = (f"'{labels[i]}'" if isinstance(labels[i], str) else str(labels[i])) if labels is not None else str(i)
        parts.append(f"WHEN {cond} THEN {val}")
    return "CASE " + " ".join(parts) + " END"


# --------------------------------------------------------------------------
# Row-wise and ratio helpers (S11, S15, S18)
# --------------------------------------------------------------------------

def row_mean(cols: Sequence[ColumnOrName]) -> Column:
    """Mean of the non-null values across columns; NULL when all are NULL."""
    cs = [col(c) for c in cols]
    total = sum((F.coalesce(c, F.lit(0.0)) for c in cs), F.lit(0.0))
    n = sum((c.isNotNull().cast("int") for c in cs), F.lit(0))
    return F.when(n > 0, total / n)


def safe_div(num: ColumnOrName, den: ColumnOrName) -> Column:
    """num / den, NULL when den is 0 or NULL (never raises under ANSI)."""
    return F.try_divide(col(num), col(den))


def share_of_valid(cond: Column, value: ColumnOrName) -> Column:
    """Share (0..1) of rows meeting ``cond`` among rows where ``value`` is not NULL."""
    v = col(value)
    return F.try_divide(F.sum(F.when(v.isNotNull() & cond, 1).otherwise(0)), F.count(v))


def share_of_all(cond: Column) -> Column:
    """Share (0..1) of all rows (NULLs count in the denominator) meeting ``cond``."""
    return F.try_divide(F.sum(F.when(cond, 1).otherwise(0)), F.count(F.lit(1)))


def weighted_average(value: ColumnOrName, weight: ColumnOrName) -> Column:
    """Aggregate: sum(v*w)/sum(w) over rows with both present and w > 0."""
    v, w = col(value), col(weight)
    ok = v.isNotNull() & w.isNotNull() & (w > 0)
    num = F.sum(F.when(ok, v * w))
    den = F.sum(F.when(ok, w))
    return F.when(den > 0, num / den)


# --------------------------------------------------------------------------
# S4: first / last non-null value per group, per column
# --------------------------------------------------------------------------

def _order_key(value: Column, order: ColumnOrName, tiebreak) -> Column:
    if tiebreak is None:
        return F.struct(col(order), value)
    ties = tiebreak if isinstance(tiebreak, (list, tuple)) else [tiebreak]
    return F.struct(col(order), *[col(t) for t in ties], value)


def first_non_null(value: ColumnOrName, order: ColumnOrName, tiebreak=None) -> Column:
    """Aggregate: value at the smallest (``order``, ``tiebreak``..., value)
    among rows where value is not NULL.

    Uses ``min_by`` on a struct key: the value itself is the last tiebreak,
    so the result is deterministic even with duplicate keys, and the
    aggregate stays algebraic (map-side partial aggregation, skew-safe).
    """
    v = col(value)
    return F.min_by(F.when(v.isNotNull(), v), F.when(v.isNotNull(), _order_key(v, order, tiebreak)))


def last_non_null(value: ColumnOrName, order: ColumnOrName, tiebreak=None) -> Column:
    v = col(value)
    return F.max_by(F.when(v.isNotNull(), v), F.when(v.isNotNull(), _order_key(v, order, tiebreak)))


def pearson(a: ColumnOrName, b: ColumnOrName) -> Column:
    """Aggregate Pearson r over rows where both are non-null; NULL (instead of
    a division-by-zero error under ANSI) when either side is constant."""
    x, y = col(a), col(b)
    both = x.isNotNull() & y.isNotNull()
    xa, ya = F.when(both, x), F.when(both, y)
    return F.try_divide(F.covar_pop(xa, ya), F.stddev_pop(xa) * F.stddev_pop(ya))


def round6(c: ColumnOrName) -> Column:
    return F.round(col(c), 6)


def ensure_columns(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Add missing columns as typed NULLs (``{name: spark_sql_type}``)."""
    missing = {k: F.lit(None).cast(t) for k, t in columns.items() if k not in df.columns}
    return df.withColumns(missing) if missing else df
