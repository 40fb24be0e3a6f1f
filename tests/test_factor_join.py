"""The history joined with its few factors."""

from pulseframe.plans import consolidate


def test_factors_are_broadcast(spark):
    """The history is not shuffled by the few factor ids; repeated ids and missing slugs as in a left join."""
    h = spark.createDataFrame([(1, "A"), (2, "N"), (3, "x"), (4, None)], "id long, questionnaire_factor_id string")
    f = spark.createDataFrame([("A", "bmi"), ("A", "weight"), ("N", None)], "id string, slug string")
    out = consolidate.join_factor_slug(h, f)
    assert sorted(map(tuple, out.collect())) == [(1, "bmi"), (1, "weight")]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
