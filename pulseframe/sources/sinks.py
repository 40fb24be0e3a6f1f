"""Sinks: upsert by primary key, backups, schema evolution, CSV/parquet export."""

from __future__ import annotations

import datetime as _dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def upsert_frames(target: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Merge ``incoming`` into ``target`` by ``keys`` (keys must be unique in both).

    - keys only in incoming are inserted;
    - keys in both take every incoming column, NULLs included (they overwrite);
    - target columns missing from incoming keep their old values;
    - incoming columns missing from target are added.
    The result carries ``_op`` = 'insert' | 'update' | 'keep' for the counts.

    One full outer join on the keys (a shuffle on the key, no broadcast of
    either side), so it scales with both tables.
    """
    keys = list(keys)
    old_cols = [c for c in target.columns if c not in keys]
    new_cols = [c for c in incoming.columns if c not in keys]
    o = target.select(*keys, *[F.col(c).alias(f"_o_{c}") for c in old_cols], F.lit(True).alias("_o_present"))
    n = incoming.select(*keys, *[F.col(c).alias(f"_n_{c}") for c in new_cols], F.lit(True).alias("_n_present"))
    j = o.join(n, keys, "full_outer")
    n_here = F.col("_n_present").isNotNull()
    o_here = F.col("_o_present").isNotNull()
    out = [F.col(k) for k in keys]
    for c in old_cols:
        if c in new_cols:
            out.append(F.when(n_here, F.col(f"_n_{c}")).otherwise(F.col(f"_o_{c}")).alias(c))
        else:
            out.append(F.col(f"_o_{c}").alias(c))
    for c in new_cols:
        if c not in old_cols:
            out.append(F.col(f"_n_{c}").alias(c))
    op = F.when(n_here & o_here, "update").when(n_here, "insert").otherwise("keep")
    return j.select(*out, op.alias("_op"))


def upsert_counts(merged: DataFrame) -> DataFrame:
    """One row: inserted, updated, kept and total rows of an ``upsert_frames`` result."""
    return merged.agg(
        F.sum(F.when(F.col("_op") == "insert", 1).otherwise(0)).cast("long").alias("inserted"),
        F.sum(F.when(F.col("_op") == "update", 1).otherwise(0)).cast("long").alias("updated"),
        F.sum(F.when(F.col("_op") == "keep", 1).otherwise(0)).cast("long").alias("kept"),
        F.count(F.lit(1)).cast("long").alias("total"),
    )


def _fs_and_path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs, hpath, jvm


def table_exists(spark: SparkSession, path: str) -> bool:
    fs, hpath, _ = _fs_and_path(spark, path)
    return fs.exists(hpath)


def upsert_table(spark: SparkSession, incoming: DataFrame, path: str, keys: Sequence[str],
                 create_if_missing: bool = True, backup_first: bool = False) -> dict:
    """Upsert ``incoming`` into the parquet table at ``path``.

    The merged result is written to a staging folder next to the table and
    then swapped in, so the table being read is never overwritten in place
    and a failed job leaves the old table intact. Both renames are checked;
    the old table goes only once the new one is in place, and one left aside
    by a run that died between the renames is put back first. Raises when the
    keys of ``incoming`` or of the table are not unique. Returns the counts.
    """
    spark = incoming.sparkSession
    _recover(spark, path)
    _require_unique(incoming, keys, "incoming rows")
    if not table_exists(spark, path):
        if not create_if_missing:
            raise FileNotFoundError(path)
        incoming.write.mode("errorifexists").parquet(path)
        n = spark.read.parquet(path).count()
        return {"inserted": n, "updated": 0, "kept": 0, "total": n}
    if backup_first:
        backup_table(spark, path)
    target = spark.read.parquet(path)
    _require_unique(target, keys, "stored table")
    merged = upsert_frames(target, incoming, keys)
    stamp = _dt.datetime.now(_dt.timezone.utc).strftime("%Y%m%d%H%M%S%f")
    staging = f"{path.rstrip('/')}.__staging_{stamp}"
    merged.drop("_op").write.mode("errorifexists").parquet(staging)
    # Counts from the key columns only (cheap second pass over two key sets).
    counts = upsert_counts(upsert_frames(target.select(*keys), incoming.select(*keys), keys)).first().asDict()
    fs, hpath, jvm = _fs_and_path(spark, path)
    old = jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}.__old_{stamp}")
    if not fs.rename(hpath, old):
        raise OSError(f"could not set the old table aside: {path}")
    if not (fs.rename(jvm.org.apache.hadoop.fs.Path(staging), hpath) and fs.exists(hpath)):
        fs.rename(old, hpath)
        raise OSError(f"could not put the new table in place: {path}")
    fs.delete(old, True)
    return counts


def _require_unique(df: DataFrame, keys: Sequence[str], what: str) -> None:
    if not df.groupBy(*keys).count().where("count > 1").isEmpty():
        raise ValueError(f"keys {list(keys)} are not unique in the {what}")


def _recover(spark: SparkSession, path: str) -> None:
    """Put back the newest table set aside by a run that died during its swap."""
    fs, hpath, jvm = _fs_and_path(spark, path)
    if fs.exists(hpath):
        return
    left = fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}.__old_*")) or []
    left = sorted((st.getPath() for st in left), key=lambda p: p.getName())
    if left and not fs.rename(left[-1], hpath):
        raise OSError(f"could not put back {left[-1]}")


def backup_table(spark: SparkSession, path: str) -> str:
    """Copy the table to ``<path>_backup_<UTC timestamp>`` and return that path."""
    stamp = _dt.datetime.now(_dt.timezone.utc).strftime("%Y%m%d_%H%M%S")
    dest = f"{path.rstrip('/')}_backup_{stamp}"
    spark.read.parquet(path).write.mode("errorifexists").parquet(dest)
    return dest


def schema_evolve(target: DataFrame, incoming: DataFrame) -> DataFrame:
    """Union by name, adding columns missing on either side as NULLs."""
    return target.unionByName(incoming, allowMissingColumns=True)


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV export with a header line (one folder of part files)."""
    df.write.mode("overwrite").option("header", True).csv(path)


def merge_sources(sources: Sequence[tuple[str, DataFrame]], keys: Sequence[str],
                  checkpoint_every: int = 0) -> tuple[DataFrame, DataFrame]:
    """Upsert the named sources in order into an initially empty table.

    Returns (final table, per-source stats with rows, inserted, updated).
    With ``checkpoint_every`` > 0 the intermediate table is written to the
    shared checkpoint folder every that many sources, so a long list does not
    grow one ever longer lineage."""
    from pulseframe.session import cut_lineage
    target = None
    stats = []
    for i, (name, df) in enumerate(sources, start=1):
        if target is None:
            merged = df.withColumn("_op", F.lit("insert"))
        else:
            merged = upsert_frames(target, df, keys)
        counted = merged.where(F.col("_op") != "keep") if target is not None else merged
        stats.append(counted.agg(F.count(F.lit(1)).alias("rows"),
                                 F.sum(F.when(F.col("_op") == "insert", 1).otherwise(0)).cast("long").alias("inserted"),
                                 F.sum(F.when(F.col("_op") == "update", 1).otherwise(0)).cast("long").alias("updated"))
                     .select(F.lit(i).alias("step"), F.lit(name).alias("source"), "rows", "inserted", "updated"))
        target = merged.drop("_op")
        if checkpoint_every and i % checkpoint_every == 0 and i < len(sources):
            target = cut_lineage(target)
    out = stats[0]
    for s in stats[1:]:
        out = out.unionByName(s)
    return target, out
