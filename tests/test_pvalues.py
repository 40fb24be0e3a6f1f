"""Student-t p-values in SQL functions."""

import math

from pyspark.sql import functions as F

from pulseframe.functions.distributions import ln_gamma, t_pvalue, t_two_sided_p


def test_t_pvalue_matches_the_scalar_form(spark):
    cases = [(t, df) for t in (-40.0, -3.3, -0.01, 0.0, 0.5, 1.96, 2.228138851986, 8.0, 60.0) for df in (1.0, 2.5, 10.0, 99.0, 1e4, 8e5)]
    odd = [(None, 3.0), (1.0, None), (float("nan"), 3.0), (1.0, 0.0), (float("inf"), 3.0)]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases + odd)], "i int, t double, df double")
    got = {r.i: r.p for r in df.select("i", t_pvalue(F.col("t"), F.col("df")).alias("p")).collect()}
    for i, (t, k) in enumerate(cases):
        assert math.isclose(got[i], t_two_sided_p(t, k), rel_tol=1e-8, abs_tol=1e-12), (t, k)
    assert all(got[len(cases) + j] is None for j in range(len(odd)))
    assert abs(got[cases.index((2.228138851986, 10.0))] - 0.05) < 1e-9


def test_ln_gamma(spark):
    xs = [0.5, 1.0, 1.5, 3.7, 20.0, 1e3, 4e5]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(ln_gamma(F.col("x"))).collect()]
    assert all(math.isclose(g, math.lgamma(x), rel_tol=1e-11, abs_tol=1e-11) for g, x in zip(got, xs, strict=True))


def test_no_python_in_the_plan(spark):
    plan = spark.range(3).select(t_pvalue(F.col("id"), F.lit(5.0)).alias("p"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan
