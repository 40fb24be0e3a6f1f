"""Streaming upsert of the newest score per key (``foreachBatch`` sink).

Each micro-batch is reduced to its newest row per key and merged into a keyed
table (``sources.keyed``): only the buckets that hold the batch's keys are
read and written, and the manifest written at the end is the commit. It
carries the epoch, so a replayed batch changes nothing, and readers always see
a complete version.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseframe.operators.reshape import latest_per_key
from pulseframe.sources.keyed import KeyedTable


def read_latest(spark: SparkSession, root: str, keys: Sequence[str]) -> DataFrame:
    """The newest committed table below ``root``."""
    return KeyedTable(spark, root, keys).read()


def upsert_latest_sink(keys: Sequence[str], order: str, tiebreak: Sequence[str] = ("id",), buckets: int = 8):
    """Return a ``foreachBatch`` function (batch_df, epoch_id, root) that keeps
    the newest row per ``keys`` across all batches. Rows with a null key are
    left out."""
    def newest(df: DataFrame) -> DataFrame:
        return latest_per_key(df, list(keys), order, list(tiebreak))

    def combine(old: DataFrame | None, new: DataFrame) -> DataFrame:
        if old is None:
            return new.withColumn("_op", F.lit("insert"))
        was = old.groupBy(*keys).agg(F.lit(1).alias("_was"))
        merged = newest(old.unionByName(new)).join(was, list(keys), "left")
        return merged.withColumn("_op", F.when(F.col("_was").isNull(), "insert").otherwise("keep")).drop("_was")

    def fn(batch: DataFrame, epoch: int, root: str) -> None:
        keyed = batch.where(" AND ".join(f"`{k}` IS NOT NULL" for k in keys))
        KeyedTable(batch.sparkSession, root, keys, buckets).merge(newest(keyed), combine, tag=epoch)
    return fn
