"""Positions of rows in an order, group by group, without a window over a group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pulseframe.llm import common

_ROW_BITS = 33  # monotonically_increasing_id: partition above, row below


def positions(df: DataFrame, group: list[str], order: list[str], pos: str = "_pos", size: str = "_n") -> DataFrame:
    """Add ``pos`` (from 0, nulls first) and ``size``, the rows of the group.

    Rows are range-partitioned by group and order, sorted and stored; a row's
    position is its place in its partition plus the counts of its group in the
    partitions before. So a group of any size is spread over many tasks, and
    windows run over one row per (group, partition) only. Group columns must
    not be null. Rows equal in all columns of ``order`` get distinct positions
    in no defined order; they are spread as well.
    """
    spark = df.sparkSession
    keys = [F.col(c).asc_nulls_first() for c in [*group, *order]]
    tagged = df.withColumn("_tie", F.monotonically_increasing_id())
    keys.append(F.col("_tie"))
    laid = tagged.repartitionByRange(common.parts(spark), *keys).sortWithinPartitions(*keys)
    table = common.stored(laid.drop("_tie").withColumn("_at", F.monotonically_increasing_id()))
    table = table.withColumn("_pid", F.shiftright("_at", _ROW_BITS))
    runs = table.groupBy(*group, "_pid").agg(F.min("_at").alias("_lo"), F.count("*").alias("_c"))
    before = Window.partitionBy(*group).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(*group, "_pid", (F.coalesce(F.sum("_c").over(before), F.lit(0)) - F.col("_lo")).alias("_shift"),
                       F.sum("_c").over(Window.partitionBy(*group)).alias(size))
    return (table.join(runs, [*group, "_pid"]).withColumn(pos, F.col("_at") + F.col("_shift"))
            .select(*df.columns, pos, size))
