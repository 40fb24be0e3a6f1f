"""Range-partitioned running counts do not depend on Spark reusing a shuffle."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulseframe.operators.describe import quantile_table
from pulseframe.operators.models import running_sums


@pytest.mark.parametrize("reuse", ["true", "false"])
def test_quantiles_and_running_sums(spark, reuse):
    before = spark.conf.get("spark.sql.exchange.reuse")
    spark.conf.set("spark.sql.exchange.reuse", reuse)
    try:
        df = spark.range(200_000).select((F.xxhash64("id") % 100_003).cast("double").alias("v"), (F.col("id") % 3).alias("k"))
        got = {r.k: (r.q0, r.q1) for r in quantile_table(df, ["k"], "v", [0.25, 0.5]).collect()}
        pdf = df.toPandas()
        for k, g in pdf.groupby("k"):
            assert np.allclose(got[k], g.v.quantile([0.25, 0.5]).to_numpy())
        ids = spark.range(50_000).select(F.xxhash64("id").alias("o"), F.lit(1).alias("n"))
        ranks = [r.r for r in running_sums(ids, "o", {"n": "r"}).orderBy("o").select("r").collect()]
        assert ranks == list(range(1, 50_001))
    finally:
        spark.conf.set("spark.sql.exchange.reuse", before)
