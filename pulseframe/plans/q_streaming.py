"""Registered streaming queries and their batch counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulseframe.plans.bindings import Domain, Tables, views
from pulseframe.plans.catalog import register
from pulseframe.streaming import bursts, latest

# Failures are 'error' events; a day-long window with five failures.
WINDOW_S = 86_400
MAX_ATTEMPTS = 5

BURSTS_SQL = f"""SELECT user_id, ts, n_in_window, ts + INTERVAL {min(300, WINDOW_S)} SECOND AS locked_until FROM (
  SELECT user_id, ts, count(*) OVER (PARTITION BY user_id ORDER BY ts
         RANGE BETWEEN INTERVAL {WINDOW_S} SECOND PRECEDING AND CURRENT ROW) AS n_in_window
  FROM events WHERE event_type = 'error' AND user_id IS NOT NULL AND ts IS NOT NULL)
WHERE n_in_window >= {MAX_ATTEMPTS}"""


def _failures(df):
    return df.where(F.col("event_type") == "error")


@register("login_bursts", BURSTS_SQL)
def q_login_bursts(spark, sf_dir):
    ev = Tables(spark, sf_dir).events
    return bursts.bursts_batch(_failures(ev), "user_id", "ts", WINDOW_S, MAX_ATTEMPTS)


@register("login_bursts_lockout", BURSTS_SQL.replace(f"{WINDOW_S} SECOND", "600 SECOND"))
def q_login_bursts_lockout(spark, sf_dir):
    """The login page's own rule: five failures within 600 seconds."""
    return bursts.bursts_batch(_failures(Tables(spark, sf_dir).events), "user_id", "ts", 600, MAX_ATTEMPTS)


@register("login_bursts_stream", BURSTS_SQL)
def q_login_bursts_stream(spark, sf_dir):
    t = Tables(spark, sf_dir)
    src = bursts.stream_source(spark, f"{t.sf_dir}/events.parquet", t.events)
    out = bursts.run_to_table(spark, bursts.bursts_stream(_failures(src), "user_id", "ts", WINDOW_S, MAX_ATTEMPTS),
                              "login_bursts")
    res = bursts.settled(spark.read.parquet(out))
    return res.select(F.col("key").alias("user_id"), F.col("at").cast("timestamp_ntz").alias("ts"),
                      "n_in_window", F.col("locked_until").cast("timestamp_ntz").alias("locked_until"))


@register("stream_latest_scores", views("latest") + "SELECT * FROM d_latest")
def q_stream_latest_scores(spark, sf_dir):
    d = Domain(spark, sf_dir)
    t = d.t
    li = bursts.stream_source(spark, f"{t.sf_dir}/lineitem.parquet", t.lineitem)
    o = t.orders.select("o_orderkey", "o_custkey", "o_orderdate")  # static side of a stream-static join
    rows = li.join(o, li.l_orderkey == o.o_orderkey).select(
        "o_custkey", "l_returnflag", "l_quantity", "o_orderdate",
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"))
    rows = rows.select(F.col("o_custkey").alias("participant_id"), F.col("l_returnflag").alias("slug"),
                       F.col("l_quantity").alias("score_value"), F.col("o_orderdate").alias("completion_created_at"),
                       "id").where(F.col("slug").isNotNull())
    root = bursts.run_to_table(spark, rows, "latest_scores",
                               foreach_batch=latest.upsert_latest_sink(["participant_id", "slug"],
                                                                       "completion_created_at", ["id"]))
    return latest.read_latest(spark, root, ["participant_id", "slug"])
