"""Addresses, the funnel bridge, map points, configured migration bins, quoted
line breaks, key checks and late rows of the burst stream, on hand-made rows."""

import datetime as dt
import os
import tempfile

import pytest

from pulseframe.operators import behaviour, linking, longitudinal
from pulseframe.sources import readers, sinks
from pulseframe.streaming import bursts

ADDRESSES = "id long, model_id string, model_type string, deleted_at string, lat string, long string, city string, " \
            "country string, postal_code string, first_name string, last_name string"


@pytest.fixture(scope="module")
def addresses(spark):
    return spark.createDataFrame([
        (1, "10", "user", None, "52.1", "4.3", "old", "NL", "1000", "Ann", None),
        (2, "10", "user", "NULL", "52.2", "4.4", "new", "NL", "1001", " ", None),
        (3, "10", "user", "2024-01-01", "0", "0", "deleted", "NL", "9999", None, None),
        (4, "11", "store", None, "1", "1", "store", "NL", "8888", None, None),
        (5, "12", "user", None, "x", "4.5", "bad", "NL", "1002", None, "")], ADDRESSES)


def test_addresses_direct(spark, addresses):
    rows = spark.createDataFrame([(1, 10, "a"), (2, 11, "b"), (3, 12, None), (4, None, "d")],
                                 "participant_id long, user_id long, postal_code string")
    out = {r.participant_id: r for r in linking.enrich_address(rows, addresses).collect()}
    assert (out[1].city, out[1].postal_code, out[1].postal_code_addr) == ("new", "a", "1001")
    assert [out[i].city for i in (2, 3, 4)] == [None, "bad", None]
    points = linking.geo_points(linking.enrich_address(rows, addresses)).collect()
    assert [(r.participant_id, r.lat, r.lon) for r in points] == [(1, 52.2, 4.4)]


def test_addresses_bridge_only_without_any_direct_hit(spark, addresses):
    bridge = spark.createDataFrame([("p1", 12), ("p1", 10), ("p2", 11)], "public_id string, app_user_id long")
    schema = "public_id string, user_id long"
    none = spark.createDataFrame([("p1", 99), ("p2", None), ("p3", 98)], schema)
    got = {r.public_id: (r.app_user_id, r.city) for r in linking.enrich_address(none, addresses, bridge).collect()}
    assert got == {"p1": (10, "new"), "p2": (11, None), "p3": (None, None)}
    some = spark.createDataFrame([("p1", 12), ("p2", 99)], schema)
    got = {r.public_id: (r.app_user_id, r.city) for r in linking.enrich_address(some, addresses, bridge).collect()}
    assert got == {"p1": (12, "bad"), "p2": (99, None)}


def test_funnel_bridge_and_name_metric(spark, addresses):
    participants = spark.createDataFrame([(1, 101), (2, 102), (3, 103), (4, None)], "id long, public_id long")
    users = spark.createDataFrame([(101, 10), (101, 13), (102, 12), (103, 14)], "qe_participant_id long, user_id long")
    names = spark.createDataFrame([(10, "  "), (12, None), (14, "Bo")], "id long, name string")
    bridge = linking.funnel_bridge(participants, users, names, addresses)
    got = {r.participant_id: (r.user_id, r.has_name) for r in bridge.collect()}
    assert got == {1: (10, True), 2: (12, False), 3: (14, True), 4: (None, False)}
    wide = spark.createDataFrame([(1, 30.0), (2, 40.0), (3, None)], "participant_id long, rec_age_current double")
    m = behaviour.funnel_name_metric(wide, bridge).first()
    assert (m.n, m.n_after_age, m.with_user, m.pct_of_start, m.drop_since_age, m.pct_drop_since_age) == (2, 1, 3, 50.0, 1, 50.0)


def test_migration_uses_the_bins_of_the_slug(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [(1, 18.5), (1, 31.0), (2, 24.0), (2, 25.0), (3, 20.0)]
    h = spark.createDataFrame([(i, p, "bmi", v, t + dt.timedelta(days=i)) for i, (p, v) in enumerate(rows)],
                              "id long, participant_id long, slug string, score_value double, completion_created_at timestamp_ntz")
    m = longitudinal.migration_labels(longitudinal.migration_binned(h, "bmi"), longitudinal.MIGRATION_BINS["bmi"][1])
    assert sorted((r.from_label, r.to_label, r.n) for r in m.collect()) == [
        ("Normaal gewicht (18.5-25)", "Normaal gewicht (18.5-25)", 1), ("Ondergewicht (<18.5)", "Obesitas (>30)", 1)]
    assert len(longitudinal.MIGRATION_BINS) == 21
    assert all(len(e) == len(x) + 1 for e, x in longitudinal.MIGRATION_BINS.values())


def test_quoted_line_breaks_in_imports(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="pf-csv-"), "in.csv")
    with open(path, "w") as f:
        f.write('an "odd junk line\nParticipant ID,User ID,note\n1,2,"a\n\nb, c"\n2,3,plain\n3,4,"x ""y""\nz"\n\n4,5,\n')
    rows = [tuple(r) for r in readers.read_csv_sniffed(spark, path).collect()]
    assert sorted(rows) == [("1", "2", "a\n\nb, c"), ("2", "3", "plain"), ("3", "4", 'x "y"\nz'), ("4", "5", None)]


def test_lone_quotes_in_imports(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="pf-csv-"), "in.csv")
    plain = [(str(i), f"row {i}", "x") for i in range(2000)]
    lines = [";".join(r) + "\n" for r in plain]
    with open(path, "w") as f:
        f.write("Participant ID;note;User ID\na;12;5\" pipe\n" + "".join(lines[:1000]) + 'b;"two\n\n""lines"";";y\nc;say "so";z\n'
                + "".join(lines[1000:]) + 'd;"never closed;z\ne;last;z\n')
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for size in (old, "3000", "700"):  # records may span splits
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            rows = [tuple(r) for r in readers.read_csv_sniffed(spark, path).collect()]
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        assert sorted(rows[:], key=str) == sorted([*plain, ("a", "12", '5" pipe'), ("b", 'two\n\n"lines";', "y"), ("c", 'say "so"', "z"),
                                                   ("d", "never closed;z", None), ("e", "last", "z")], key=str)


def test_upsert_refuses_stored_duplicates(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="pf-upsert-"), "t")
    spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string").write.parquet(path)
    with pytest.raises(ValueError, match="stored table"):
        sinks.upsert_table(spark, spark.createDataFrame([(2, "c")], "k int, v string"), path, ["k"])


def test_burst_stream_with_ties_and_late_rows(spark):
    base = dt.datetime(2024, 1, 1)
    batches = [(0, 100, 400, 400, 900), (200, 300, 400, 1000), (650, 1000, 1000, 1100, 1250)]
    src = os.path.join(tempfile.mkdtemp(prefix="pf-late-"), "events")
    schema = "user_id long, ts timestamp_ntz"
    frames = [spark.createDataFrame([(7, base + dt.timedelta(seconds=s)) for s in b], schema) for b in batches]
    for f in frames:
        f.coalesce(1).write.mode("append").parquet(src)
    out = bursts.run_to_table(spark, bursts.bursts_stream(bursts.stream_source(spark, src, frames[0], 1), "user_id", "ts"),
                              "late_bursts")
    got = sorted((r.at.replace(tzinfo=None), r.n_in_window) for r in bursts.settled(spark.read.parquet(out)).collect())
    every = spark.read.parquet(src)
    want = sorted((r.ts, r.n_in_window) for r in bursts.bursts_batch(every, "user_id", "ts").collect())
    assert got == want and len(want) > len(set(want))
