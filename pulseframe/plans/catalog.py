"""Registry of named queries: each pairs a Spark plan with oracle SQL text.

A query builder takes ``(spark, sf_dir)`` and returns a lazy DataFrame.
Double columns of every registered result are rounded to 6 decimals so an
independent engine summing in another order produces the same digits.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

QUERY_MODULES = (
    "pulseframe.plans.q_pipeline",
    "pulseframe.plans.q_linking",
    "pulseframe.plans.q_scalar",
    "pulseframe.plans.q_cohort",
    "pulseframe.plans.q_describe",
    "pulseframe.plans.q_stats",
    "pulseframe.plans.q_longitudinal",
    "pulseframe.plans.q_behaviour",
    "pulseframe.plans.q_models",
    "pulseframe.plans.q_streaming",
)


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    digits: int


_REGISTRY: dict[str, Query] = {}


def register(name: str, sql: str | None = None, digits: int = 6):
    """Decorator adding a ``(spark, sf_dir) -> DataFrame`` builder to the registry."""
    def deco(fn):
        if name in _REGISTRY:
            raise ValueError(f"duplicate query {name}")
        _REGISTRY[name] = Query(name, fn, sql, digits)
        return fn
    return deco


def round_doubles(df: DataFrame, digits: int = 6) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (DoubleType, FloatType)):
            cols.append(F.round(F.col(f"`{f.name}`").cast("double"), digits).alias(f.name))
        else:
            cols.append(F.col(f"`{f.name}`"))
    return df.select(*cols)


def _load() -> dict[str, Query]:
    for m in QUERY_MODULES:
        try:
            importlib.import_module(m)
        except ModuleNotFoundError as e:
            if e.name != m:
                raise
    return _REGISTRY


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    reg = _load()

    def wrap(q: Query):
        return lambda spark, sf_dir: round_doubles(q.build(spark, sf_dir), q.digits)

    return {name: wrap(q) for name, q in reg.items()}


def oracle_sql() -> dict[str, str]:
    return {name: q.sql for name, q in _load().items() if q.sql}


def r(expr: str, digits: int = 6) -> str:
    """SQL rounding wrapper matching ``round_doubles``."""
    return f"round(CAST({expr} AS DOUBLE), {digits})"
