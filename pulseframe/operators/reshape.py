"""Dedupe, pivot, unpivot and set operations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pyspark.sql.window import Window


def latest_per_key(df: DataFrame, keys: Sequence[str], order: str, tiebreak: Sequence[str] = ("id",),
                   newest: bool = True, payload_tiebreak: bool = True) -> DataFrame:
    """Keep one row per ``keys``: the newest (or oldest) by ``order`` then ``tiebreak``.

    Implemented as a ``max_by``/``min_by`` aggregate over a struct of the
    payload, not a window: the aggregate is combined map-side, so a key that
    holds a third of all rows is reduced in every map task before the
    shuffle instead of being sorted in one task. NULL ``order`` values rank
    below every real timestamp (pandas ``na_position='last'`` on a
    descending sort). Remaining ties fall to the payload itself, which keeps
    the choice deterministic.
    """
    payload = [c for c in df.columns if c not in keys]
    # ``payload_tiebreak=False`` when (order, tiebreak) is already unique per
    # key: the ordering struct then stays small.
    rest = [F.col(c) for c in payload if c not in tiebreak and c != order] if payload_tiebreak else []
    # newest: max over (has_order, order, tiebreak..., payload...)
    # oldest: min over (order_missing, order, tiebreak..., payload...)
    has = F.col(order).isNotNull() if newest else F.col(order).isNull()
    order_key = F.struct(has, F.col(order), *[F.col(c) for c in tiebreak], *rest)
    pick = F.max_by if newest else F.min_by
    row = pick(F.struct(*[F.col(c) for c in payload]), order_key).alias("_row")
    return df.groupBy(*keys).agg(row).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in payload])


def first_per_key(df: DataFrame, keys: Sequence[str], order: str, tiebreak: Sequence[str] = ("id",)) -> DataFrame:
    return latest_per_key(df, keys, order, tiebreak, newest=False)


def pivot_first(df: DataFrame, index: Sequence[str], pivot_col: str, values: Sequence[str], value_col: str,
                prefix: str = "") -> DataFrame:
    """Long -> wide taking the first non-null value per cell.

    ``values`` must be given: it keeps the output schema fixed and spares the
    extra distinct job Spark would otherwise run to discover pivot values.
    """
    out = df.groupBy(*index).pivot(pivot_col, list(values)).agg(F.first(value_col, ignorenulls=True))
    return out.select(*index, *[F.col(f"`{v}`").alias(f"{prefix}{v}".lower()) for v in values])


def pivot_mean(df: DataFrame, index: Sequence[str], pivot_col: str, values: Sequence[str], value_col: str,
               prefix: str = "") -> DataFrame:
    out = df.groupBy(*index).pivot(pivot_col, list(values)).agg(F.avg(value_col))
    return out.select(*index, *[F.col(f"`{v}`").alias(f"{prefix}{v}".lower()) for v in values])


def unpivot_columns(df: DataFrame, ids: Sequence[str], value_cols: Sequence[str],
                    name_col: str = "score_slug", value_col: str = "score_value",
                    drop_nulls: bool = True) -> DataFrame:
    """Wide -> long over ``value_cols`` (all cast to double first)."""
    cast = df.select(*ids, *[F.col(c).cast("double").alias(c) for c in value_cols])
    out = cast.unpivot(list(ids), list(value_cols), name_col, value_col)
    return out.filter(F.col(value_col).isNotNull()) if drop_nulls else out


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def id_set_ops(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Sizes of the distinct, union, intersection and differences of two id sets."""
    da = a.select(F.col(key).alias("k")).where(F.col("k").isNotNull()).distinct()
    db = b.select(F.col(key).alias("k")).where(F.col("k").isNotNull()).distinct()
    tagged = (da.withColumn("in_a", F.lit(1)).join(db.withColumn("in_b", F.lit(1)), "k", "full_outer"))
    return tagged.agg(
        F.sum(F.coalesce("in_a", F.lit(0))).cast("long").alias("n_a"),
        F.sum(F.coalesce("in_b", F.lit(0))).cast("long").alias("n_b"),
        F.count(F.lit(1)).cast("long").alias("n_union"),
        F.sum(F.when(F.col("in_a").isNotNull() & F.col("in_b").isNotNull(), 1).otherwise(0)).cast("long").alias("n_intersect"),
        F.sum(F.when(F.col("in_b").isNull(), 1).otherwise(0)).cast("long").alias("n_a_minus_b"),
        F.sum(F.when(F.col("in_a").isNull(), 1).otherwise(0)).cast("long").alias("n_b_minus_a"),
    )


def combinations_list(df: DataFrame, entity: str, item: str, sep: str = " + ") -> DataFrame:
    """Per entity, the sorted distinct items joined by ``sep``; then how many
    entities share each combination.

    The per-entity set is pre-deduplicated by a (entity, item) distinct so
    ``collect_set`` only ever sees one row per item of one entity.
    """
    per = (df.select(entity, item).where(F.col(item).isNotNull()).distinct()
             .groupBy(entity).agg(F.array_join(F.array_sort(F.collect_list(item)), sep).alias("combination")))
    return per.groupBy("combination").agg(F.count(F.lit(1)).cast("long").alias("n_participants"))


def row_number_dedupe(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Window dedupe for the rare case where the full row must survive and the
    order is not expressible as a struct (kept for API completeness)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
