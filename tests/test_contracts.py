"""The original project's own test contracts, plus upsert and import rules."""

import datetime as dt
import os
import tempfile

from pyspark.sql import functions as F

from pulseframe.operators import behaviour, linking
from pulseframe.sources import readers, sinks
from pulseframe.functions.distributions import t_two_sided_p
from pulseframe.streaming import bursts


def _views(spark, rows):
    return spark.createDataFrame(rows, "id int, interactable_type string, interactable_id int, user_id int, "
                                       "type string, created_at string, updated_at string")


def test_article_overview_empty(spark):
    views = _views(spark, [])
    titles = spark.createDataFrame([], "content_id int, title string")
    top, summary = behaviour.article_overview(views, titles)
    assert {"interactable_id", "title", "views", "unique_readers", "last_view"} <= set(top.columns)
    assert top.count() == 0
    assert summary.first()["total_views"] == 0


def test_article_overview_bridge_filter(spark):
    views = _views(spark, [(1, "content", 100, 1, "view", "2024-01-01", "2024-01-01"),
                           (2, "content", 200, 2, "view", "2024-01-02", "2024-01-02")])
    titles = spark.createDataFrame([(100, "Article A"), (200, "Article B")], "content_id int, title string")
    bridge = spark.createDataFrame([(16910, 1)], "participant_id int, user_id int")
    chosen = bridge.where(F.col("participant_id").isin(16910)).select("user_id")
    top, summary = behaviour.article_overview(views.join(chosen, "user_id", "left_semi"), titles)
    rows = top.collect()
    assert summary.first()["total_views"] == 1
    assert rows[0]["title"] == "Article A" and rows[0]["unique_readers"] == 1


def test_upsert_rules(spark):
    target = spark.createDataFrame([(1, "a", 10.0), (2, "b", 20.0)], "k int, keep string, v double")
    incoming = spark.createDataFrame([(2, None, "x"), (3, 30.0, "y")], "k int, v double, new string")
    out = {r.k: r for r in sinks.upsert_frames(target, incoming, ["k"]).collect()}
    assert out[1]["_op"] == "keep" and out[1]["v"] == 10.0
    assert out[2]["_op"] == "update" and out[2]["v"] is None and out[2]["keep"] == "b" and out[2]["new"] == "x"
    assert out[3]["_op"] == "insert" and out[3]["keep"] is None


def test_upsert_table_swaps_staging(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="pf-upsert-"), "t")
    a = spark.createDataFrame([(1, 1.0), (2, 2.0)], "k int, v double")
    assert sinks.upsert_table(spark, a, path, ["k"])["inserted"] == 2
    b = spark.createDataFrame([(2, 5.0), (3, 3.0)], "k int, v double")
    counts = sinks.upsert_table(spark, b, path, ["k"])
    assert (counts["inserted"], counts["updated"], counts["kept"]) == (1, 1, 1)
    assert sorted((r.k, r.v) for r in spark.read.parquet(path).collect()) == [(1, 1.0), (2, 5.0), (3, 3.0)]


def test_csv_sniff_junk_lines_and_validation(spark):
    d = tempfile.mkdtemp(prefix="pf-import-")
    p = os.path.join(d, "import.csv")
    with open(p, "w", encoding="utf-8") as f:
        f.write("﻿Export van deelnemers\n\nParticipant ID;Geslacht;Datum;Onbekend\n"
                "1;Man;31-01-2030;x\n2;vrouw;01-02-2024;y\n1;Man;02-02-2024;z\n;F;;w\n")
    raw = readers.read_csv_sniffed(spark, p)
    assert raw.columns == ["Participant ID", "Geslacht", "Datum", "Onbekend"]
    out = readers.upload_validate(raw, ["id", "user_id", "gender", "created_at"], now="2024-03-01 00:00:00")
    rows = {r.id: r for r in out.collect()}
    assert set(out.columns) == {"id", "user_id", "gender", "created_at"}
    assert rows["1"].created_at == dt.datetime(2024, 2, 2) and rows["1"].user_id == "1"
    assert rows[None].created_at == dt.datetime(2024, 3, 1)


def test_student_t_p_values():
    assert abs(t_two_sided_p(2.228138851986, 10) - 0.05) < 1e-9
    assert abs(t_two_sided_p(3.169272667, 10) - 0.01) < 1e-8
    assert t_two_sided_p(0.0, 7) == 1.0


def test_bursts_batch_matches_stream_rule(spark):
    base = dt.datetime(2024, 1, 1)
    ts = [base + dt.timedelta(seconds=s) for s in (0, 100, 200, 300, 400, 1500, 1590, 1600, 1700, 1800, 2100)]
    ev = spark.createDataFrame([(7, t) for t in ts] + [(8, base)], "user_id long, ts timestamp_ntz")
    got = sorted((r.ts, r.n_in_window) for r in bursts.bursts_batch(ev, "user_id", "ts", 600, 5).collect())
    # the window is inclusive: at 2100 s the failure at exactly 1500 s still counts
    assert got == [(ts[4], 5), (ts[9], 5), (ts[10], 6)]


def test_store_links_smallest_store_and_deleted(spark):
    participants = spark.createDataFrame([(1, 11), (2, 12), (3, None)], "id long, public_id long")
    users = spark.createDataFrame([(101, 11), (102, 12)], "user_id long, qe_participant_id long")
    emp = spark.createDataFrame([(101, 5, None), (101, 3, None), (102, 4, "2020-01-01"), (102, 6, "NULL")],
                                "user_id long, store_id long, deleted_at string")
    stores = spark.createDataFrame([(3, "A"), (4, "B"), (5, ""), (6, None)], "id long, name string")
    out = {r.participant_id: (r.store_id, r.store_name)
           for r in linking.link_participant_store(participants, users, emp, stores).collect()}
    assert out == {1: (3, "A"), 2: (6, "Store 6")}


def test_backup_table_copies(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="pf-backup-"), "t")
    spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string").write.parquet(path)
    dest = sinks.backup_table(spark, path)
    assert dest.startswith(path + "_backup_")
    assert spark.read.parquet(dest).count() == 2


def test_streaming_bursts_match_batch(spark):
    base = dt.datetime(2024, 1, 1)
    ts = [base + dt.timedelta(seconds=s) for s in (0, 100, 200, 300, 400, 1500, 1590, 1600, 1700, 1800, 2100)]
    d = tempfile.mkdtemp(prefix="pf-stream-")
    src = os.path.join(d, "events")
    ev = spark.createDataFrame([(7, t) for t in ts], "user_id long, ts timestamp_ntz")
    ev.write.parquet(src)
    stream = bursts.stream_source(spark, src, ev)
    out = bursts.run_to_table(spark, bursts.bursts_stream(stream, "user_id", "ts", 600, 5), "test_bursts")
    got = sorted((r.at.replace(tzinfo=None), r.n_in_window) for r in bursts.settled(spark.read.parquet(out)).collect())
    want = sorted((r.ts, r.n_in_window) for r in bursts.bursts_batch(ev, "user_id", "ts", 600, 5).collect())
    assert got == want
