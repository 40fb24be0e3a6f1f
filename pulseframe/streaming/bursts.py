"""Failed-attempt bursts: a key is locked out when it has at least
``max_attempts`` failures within ``window_s`` seconds (inclusive); the
lockout lasts ``min(300, window_s)`` seconds from the triggering failure.

Two implementations with the same result:
- ``bursts_batch``: exact sliding-window count without holding a whole key
  in one task (time-bucketed partitions with a one-bucket look-back copy);
- ``bursts_stream``: Structured Streaming with state per shard of keys
  (``applyInPandasWithState``) and an event-time watermark.
"""

from __future__ import annotations

import os
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseframe.functions.semantics import epoch_micros
from pyspark.sql.streaming.state import GroupStateTimeout
from pyspark.sql.window import Window

from pulseframe.session import ensure_checkpoint_dir

MICROS = 1_000_000


def bursts_batch(events: DataFrame, key: str, at: str, window_s: int = 600, max_attempts: int = 5) -> DataFrame:
    """Rows (key, at, n_in_window, locked_until) where the failure count in
    (at - window_s, at] reaches ``max_attempts``.

    Every row is assigned to its time bucket of ``window_s`` and copied once
    into the next bucket as look-back context. A window partitioned by
    (key, bucket) then sees, for each of its own rows, every row of the
    preceding ``window_s`` seconds. Partitions are bounded by one key's
    rows in two buckets, so one very busy key is spread over many tasks.
    """
    us = epoch_micros("at")
    base = (events.select(F.col(key).alias("key"), F.col(at).alias("at")).where(F.col("key").isNotNull()
                                                                            & F.col("at").isNotNull())
            .withColumn("_us", us).withColumn("_b", F.floor(F.col("_us") / (window_s * MICROS)).cast("long")))
    own = base.withColumn("_own", F.lit(True))
    ctx = base.withColumn("_b", F.col("_b") + 1).withColumn("_own", F.lit(False))
    both = own.unionByName(ctx)
    w = Window.partitionBy("key", "_b").orderBy("_us").rangeBetween(-window_s * MICROS, 0)
    counted = both.withColumn("n_in_window", F.count(F.lit(1)).over(w)).where(F.col("_own"))
    lock = min(300, window_s)
    return (counted.where(F.col("n_in_window") >= max_attempts)
                   .select(F.col("key").alias(key), F.col("at").alias(at), "n_in_window",
                           (F.col("at") + F.expr(f"make_dt_interval(0, 0, 0, {lock})")).alias("locked_until")))


def _burst_state_fn(window_s: int, max_attempts: int):
    span = window_s * MICROS
    width = 2 * span

    def fn(shard, pdfs, state):
        """State: keys and times (microseconds) of one shard in one bucket and
        the bucket before it. A row's place is its key's number times the
        width of two buckets plus its time since their start, so that one
        search counts for all keys."""
        if state.hasTimedOut:
            state.remove()
            keys = at = n = rows = np.zeros(0, np.int64)
        else:
            start = (int(shard[1]) - 1) * span
            fresh = [(pdf["key"].to_numpy(np.int64), pdf["us"].to_numpy(np.int64)) for pdf in pdfs]
            old = [tuple(np.frombuffer(x, np.int64) for x in state.get)] if state.exists else []
            keys, us = (np.concatenate(x) for x in zip(*old, *fresh, strict=True))
            state.update((keys.tobytes(), us.tobytes()))
            # No row of the bucket can come once the watermark has left it.
            state.setTimeoutTimestamp((int(shard[1]) + 1) * window_s * 1000 + 1)
            names, number = np.unique(keys, return_inverse=True)
            place = number * width + (us - start)
            new = np.sort(place[sum(len(k) for k, _ in old):])
            place.sort()

            def within(t, found):
                return np.searchsorted(found, t, "right") - np.searchsorted(found, t - span, "left")

            at, rows = np.unique(place[place % width >= span], return_counts=True)
            n = within(at, place)
            hit = (n >= max_attempts) & (within(at, new) > 0)
            at, n, rows = at[hit], n[hit], rows[hit]
            keys, at = names[at // width], at % width + start
        yield pd.DataFrame({"key": keys, "us": at, "n_in_window": n.astype(np.int64), "n_rows": rows.astype(np.int64)})

    return fn


def bursts_stream(stream: DataFrame, key: str, at: str, window_s: int = 600, max_attempts: int = 5,
                  watermark: str = "20 minutes", shards: int = 32) -> DataFrame:
    """Streaming version: revisions (key, at, n_in_window, n_rows,
    locked_until), one for every failure time whose count a micro-batch
    brought to ``max_attempts`` or raised beyond it; ``n_rows`` failures stand
    at that time. Counts only grow as rows arrive, in whatever order, so the
    largest revision of a time is its result: ``settled`` gives the rows of
    ``bursts_batch``. Rows later than ``watermark`` are dropped.

    As in the batch version a row goes to its time bucket and, as look-back,
    to the next one. State is kept per (shard of keys, bucket) and goes when
    the watermark leaves the bucket: the number of states, each a call of its
    own, depends on the time spanned and not on the keys, and a very busy key
    is spread over tasks by its buckets.
    """
    bucket = F.floor(F.col("us") / (window_s * MICROS)).cast("long")
    s = (stream.select(F.col(key).cast("long").alias("key"), F.col(at).cast("timestamp").alias("at"))
         .where(F.col("key").isNotNull() & F.col("at").isNotNull()).withWatermark("at", watermark)
         .withColumn("us", F.unix_micros("at"))
         .withColumn("bucket", F.explode(F.array(bucket, bucket + 1))))
    s = s.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)))
    found = s.groupBy("shard", "bucket").applyInPandasWithState(
        _burst_state_fn(window_s, max_attempts),
        outputStructType="key long, us long, n_in_window long, n_rows long",
        stateStructType="keys binary, times binary",
        outputMode="append",
        timeoutConf=GroupStateTimeout.EventTimeTimeout)
    lock = F.expr(f"make_dt_interval(0, 0, 0, {min(300, window_s)})")
    at_col = F.timestamp_micros("us")
    return found.select("key", at_col.alias("at"), "n_in_window", "n_rows", (at_col + lock).alias("locked_until"))


def settled(revisions: DataFrame) -> DataFrame:
    """(key, at, n_in_window, locked_until), one row per failure, from the
    revisions of ``bursts_stream``: the largest of each time."""
    last = revisions.groupBy("key", "at", "locked_until").agg(F.max("n_in_window").alias("n_in_window"),
                                                              F.max("n_rows").alias("n_rows"))
    return (last.withColumn("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_rows"))))
            .select("key", "at", "n_in_window", "locked_until"))


def run_to_table(spark: SparkSession, stream_df: DataFrame, name: str, output_mode: str = "append",
                 foreach_batch=None, resume_as: str | None = None) -> str:
    """Run a streaming query to completion over the available input
    (``availableNow``) into parquet under the shared checkpoint folder;
    returns the output path. The sink and its checkpoint live in the folder
    named by ``spark.checkpoint.dir``: a new one for every call, or the one
    named ``resume_as``, which a later call or a restarted driver continues."""
    root = ensure_checkpoint_dir(spark)
    run = f"{root.rstrip('/')}/streams/{resume_as or f'{name}-{uuid.uuid4().hex[:12]}'}"
    out = f"{run}/out"
    w = stream_df.writeStream.option("checkpointLocation", f"{run}/checkpoint").outputMode(output_mode)
    if foreach_batch is not None:
        q = w.foreachBatch(lambda df, epoch: foreach_batch(df, epoch, out)).trigger(availableNow=True).start()
    else:
        q = w.format("parquet").option("path", out).trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    return out


def stream_source(spark: SparkSession, path: str, like: DataFrame, max_files: int | None = None) -> DataFrame:
    """File stream over ``path`` (a parquet file or folder) with the schema of
    ``like``; ``max_files`` caps the files per micro-batch."""
    r = spark.readStream.schema(like.schema)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    if os.path.isdir(path):
        return r.parquet(path)
    folder, name = os.path.split(path.rstrip("/"))
    return r.option("pathGlobFilter", name).parquet(folder)
