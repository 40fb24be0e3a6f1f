"""Plan-shape guards: what the engine promises about its physical plans."""

import pytest

from pulseframe.plans import catalog
from pulseframe.plans.bindings import BINDING_SLUG_COLUMNS, Domain
from pulseframe.plans.consolidate import latest_scores_wide

SMALL = "/root/testdata/sf0.001"
QUERIES = catalog.queries()
ORACLE = catalog.oracle_sql()


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_no_row_at_a_time_python(spark, name):
    plan = _plan(QUERIES[name](spark, SMALL))
    assert "BatchEvalPython" not in plan
    assert "CartesianProduct" not in plan


def test_latest_scores_combine_before_one_shuffle(spark):
    d = Domain(spark, SMALL)
    plan = _plan(latest_scores_wide(d.history, BINDING_SLUG_COLUMNS))
    assert "Bucketed: true" not in plan
    assert plan.count("Exchange hashpartitioning") == 1
    assert "partial_max_by" in plan[plan.index("Exchange hashpartitioning"):]


def test_busy_participant_is_read_by_several_tasks(spark, tmp_path):
    rows = spark.range(300_000, numPartitions=4).selectExpr(
        "id", "if(id % 3 = 0, 1, id) AS participant_id", "uuid() AS payload")
    rows.write.parquet(str(tmp_path / "history"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")
    try:
        read = spark.read.parquet(str(tmp_path / "history")).where("participant_id = 1")
        tasks = read.selectExpr("spark_partition_id() AS p").distinct().count()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert tasks >= 4


def test_scans_prune_columns(spark):
    plan = _plan(QUERIES["kpi_count"](spark, SMALL))
    assert "ReadSchema" in plan
    plan = _plan(QUERIES["filter_year_range"](spark, SMALL))
    assert "l_extendedprice" not in plan
