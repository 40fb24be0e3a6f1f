"""Fitted models in sessions that did other work, and how their tables are read."""

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from pulseframe.operators import models


def _rows(spark, n=300):
    return spark.range(n).select(F.col("id").alias("_id"), F.rand(1).alias("a"), F.rand(2).alias("b"), F.rand(3).alias("c"),
                                 (F.col("id") % 2).cast("double").alias("label")).localCheckpoint()


@pytest.mark.parametrize("train", [models.train_binary, models.train_classifier])
def test_two_class_models_predict_after_observed_metrics(spark, train):
    """A summary of two classes holds the session, which no longer goes to tasks
    once it has observed metrics."""
    seen, df = Observation("rows"), _rows(spark)
    df.observe(seen, F.count(F.lit(1)).alias("n")).count()
    assert seen.get == {"n": 300}
    fitted = train(df, ["a", "b", "c"], 4, 2)
    assert models.predict_classifier(fitted, df, 2).where("prediction IN (0, 1)").count() == 300


def test_training_table_is_derived_once(spark):
    """Counts, training and predictions after ``unpersist`` read one stored table."""
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    df = _rows(spark, 400)
    data, feats = models.prepare(df.mapInArrow(counted, df.schema).withColumnRenamed("_id", "id"), ["a", "b", "c"], "label", "id")
    train, test = models.split(data)
    fitted = models.train_regressor(train, feats, 2, 2, 2)
    data.unpersist()
    assert set(models.regression_metrics(models.predict_regressor(fitted, test))) == {"mae", "rmse", "r2"}
    assert seen.value == 400
