"""Bursts of many keys: one state per shard and bucket."""

import datetime as dt
import random

from pulseframe.streaming import bursts


def test_stream_of_many_keys_matches_batch(spark, tmp_path):
    """Keys share a state but not their counts; three files, out of order, times and rows repeated."""
    r, t0 = random.Random(4), dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    rows = [(k if k else None, t0 + dt.timedelta(seconds=r.randrange(0, 3600, 20))) for k in range(-3, 60) for _ in range(r.choice([3, 12, 30]))]
    r.shuffle(rows)
    for i in range(3):
        spark.createDataFrame(rows[i::3], "user_id long, ts timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    like = spark.read.parquet(str(tmp_path / "in"))
    stream = bursts.bursts_stream(bursts.stream_source(spark, str(tmp_path / "in"), like, 1), "user_id", "ts", 600, 5, "2 hours", 4)
    out = spark.read.parquet(bursts.run_to_table(spark, stream, "many_keys"))
    got = sorted((x.key, x.at, x.n_in_window) for x in bursts.settled(out).collect())
    want = sorted((x.user_id, x.ts, x.n_in_window) for x in bursts.bursts_batch(like, "user_id", "ts", 600, 5).collect())
    assert got == want and want


def test_few_states_for_many_keys(spark, tmp_path):
    """The number of states does not grow with the keys."""
    rows = [(k, dt.datetime(2024, 1, 1, 0, 1, tzinfo=dt.timezone.utc)) for k in range(2000)]
    spark.createDataFrame(rows, "user_id long, ts timestamp").write.parquet(str(tmp_path / "in"))
    stream = bursts.bursts_stream(bursts.stream_source(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in"))), "user_id", "ts")
    q = (stream.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c")).outputMode("append")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    assert 0 < max(s.numRowsTotal for p in q.recentProgress for s in p.stateOperators) <= 64
