"""Student-t tail probabilities (scipy is not available).

Two-sided p of a t statistic with ``df`` degrees of freedom:
    p = I_{df/(df+t^2)}(df/2, 1/2)
with the regularised incomplete beta function evaluated by its continued
fraction (modified Lentz), as a fold of bounded length in SQL functions. It is
applied to already aggregated rows (one row per measure). ``t_two_sided_p`` is
the same in plain Python, for single values.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

_EPS = 1e-15
_TINY = 1e-300


def _betacf(a: float, b: float, x: float, max_iter: int = 300) -> float:
    qab, qap, qam = a + b, a + 1.0, a - 1.0
    c, d = 1.0, 1.0 - qab * x / qap
    d = _TINY if abs(d) < _TINY else d
    d = 1.0 / d
    h = d
    for m in range(1, max_iter + 1):
        m2 = 2 * m
        aa = m * (b - m) * x / ((qam + m2) * (a + m2))
        d = 1.0 + aa * d
        d = _TINY if abs(d) < _TINY else d
        c = 1.0 + aa / c
        c = _TINY if abs(c) < _TINY else c
        d = 1.0 / d
        h *= d * c
        aa = -(a + m) * (qab + m) * x / ((a + m2) * (qap + m2))
        d = 1.0 + aa * d
        d = _TINY if abs(d) < _TINY else d
        c = 1.0 + aa / c
        c = _TINY if abs(c) < _TINY else c
        d = 1.0 / d
        delta = d * c
        h *= delta
        if abs(delta - 1.0) < _EPS:
            break
    return h


def betainc_reg(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta I_x(a, b)."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    ln_front = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    front = math.exp(ln_front)
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _betacf(a, b, x) / a
    return 1.0 - front * _betacf(b, a, 1.0 - x) / b


def t_two_sided_p(t: float, df: float) -> float:
    """Two-sided p-value of Student's t; NaN for undefined inputs."""
    if t is None or df is None or not np.isfinite(t) or not np.isfinite(df) or df <= 0:
        return float("nan") if t is None or not np.isfinite(t or 0.0) else (0.0 if df and df > 0 else float("nan"))
    x = df / (df + t * t)
    return float(min(1.0, max(0.0, betainc_reg(df / 2.0, 0.5, x))))


#: Half steps of the continued fraction; enough for about a million degrees of freedom.
STEPS = 2000
_SHIFT = 12


def ln_gamma(z: Column) -> Column:
    """log Gamma of a positive number: the recurrence up to z + 12, then Stirling's series."""
    y = z + _SHIFT
    series = (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y ** 3) + 1 / (1260 * y ** 5) - 1 / (1680 * y ** 7)
    return series - reduce(lambda a, b: a + b, [F.log(z + k) for k in range(_SHIFT)])


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.transform(F.array(value), body)[0]


def _off_zero(x: Column) -> Column:
    return F.when(F.abs(x) < _TINY, _TINY).otherwise(x)


def _continued_fraction(a: Column, b: Column, x: Column) -> Column:
    def half_step(s: Column, i: Column) -> Column:
        m = F.floor(i / 2).cast("double") + 1
        even = m * (b - m) * x / ((a - 1 + 2 * m) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 1 + 2 * m))
        return _let(F.when(i % 2 == 0, even).otherwise(odd), lambda aa: _let(
            F.struct((1 / _off_zero(1 + aa * s["d"])).alias("d"), _off_zero(1 + aa / s["c"]).alias("c")),
            lambda n: F.struct(n["c"].alias("c"), n["d"].alias("d"), (s["h"] * n["c"] * n["d"]).alias("h"))))

    first = 1 / _off_zero(1 - (a + b) * x / (a + 1))
    start = _let(first, lambda d: F.struct(F.lit(1.0).alias("c"), d.alias("d"), d.alias("h")))
    return F.aggregate(F.sequence(F.lit(0), F.lit(STEPS - 1)), start, half_step, lambda s: s["h"])


def t_pvalue(t: Column, df: Column) -> Column:
    """Two-sided Student-t p-value (apply to aggregated rows only); NULL where
    the statistic or the degrees of freedom are missing, not finite or not positive."""
    t, df = t.cast("double"), df.cast("double")
    fine = t.isNotNull() & ~F.isnan(t) & (F.abs(t) < float("inf")) & (df > 0) & ~F.isnan(df) & (df < float("inf"))

    def tail(v: Column) -> Column:
        a, b, x = v["df"] / 2, F.lit(0.5), v["df"] / (v["df"] + v["t"] * v["t"])
        rest = v["t"] * v["t"] / (v["df"] + v["t"] * v["t"])  # 1 - x without cancellation
        front = F.exp(ln_gamma(a + 0.5) - ln_gamma(a) - 0.5 * math.log(math.pi) + a * F.log(x) + 0.5 * F.log(rest))
        near = front * _continued_fraction(a, b, x) / a
        far = 1 - front * _continued_fraction(b, a, rest) / b
        return F.when(v["t"] == 0, 1.0).when(x <= 0, 0.0).otherwise(
            F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(x < (a + 1) / (a + b + 2), near).otherwise(far))))

    return F.when(fine, _let(F.struct(t.alias("t"), df.alias("df")), tail))
