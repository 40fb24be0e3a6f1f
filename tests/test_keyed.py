"""Keyed tables: partial rewrites, the manifest as the only commit, replays, housekeeping; CSV layouts per file."""

import os

import pytest
from pyspark.sql import functions as F

from pulseframe.sources import keyed, readers
from pulseframe.sources.keyed import ConcurrentCommit, KeyedTable
from pulseframe.streaming import latest

SCHEMA = "k long, v string, w double"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture
def table(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path / "t"), ["k"], buckets=32)
    t.upsert(spark.range(2000).select(F.col("id").alias("k"), F.lit("a").alias("v"), F.lit(1.0).alias("w")))
    return t


def test_upsert_rewrites_only_touched_buckets(spark, table):
    before = table.manifest()["folders"]
    new = spark.createDataFrame([(5, "b", None), (1999, None, 2.0), (7000, "c", 3.0)], SCHEMA)
    counts = table.upsert(new)
    after = table.manifest()["folders"]
    changed = [b for b in after if before.get(b) != after[b]]
    assert 1 <= len(changed) <= 3 and counts["buckets"] == len(changed) and set(before) <= set(after)
    assert (counts["inserted"], counts["updated"], counts["kept"], counts["total"]) == (1, 2, 1998, 2001)
    got = {r.k: (r.v, r.w) for r in table.read().collect()}
    want = {k: ("a", 1.0) for k in range(2000)} | {5: ("b", None), 1999: (None, 2.0), 7000: ("c", 3.0)}
    assert got == want


def test_writer_that_dies_before_its_commit_leaves_the_old_version(spark, table, monkeypatch):
    old = rows(table.read())
    new = spark.createDataFrame([(1, "x", 9.0)], SCHEMA)
    with monkeypatch.context() as m:
        m.setattr(KeyedTable, "_commit", lambda self, manifest: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError, match="killed"):
            table.upsert(new)
    assert rows(table.read()) == old
    # A manifest cut short counts as no commit; the next writer goes past it.
    with open(os.path.join(table.path, "_manifest", f"{table.manifest()['version'] + 1:012d}.json"), "w") as f:
        f.write('{"version": 2, "fold')
    assert rows(table.read()) == old
    table.upsert(new)
    assert dict((r.k, r.v) for r in table.read().collect())[1] == "x"
    orphans = table.vacuum(orphans_older_than_s=0)
    assert any(o.startswith("data/") for o in orphans) and table.read().count() == 2000


def test_second_writer_of_a_version_fails(spark, table, monkeypatch):
    mine = table.manifest()
    table.upsert(spark.createDataFrame([(1, "first", 1.0)], SCHEMA))
    with pytest.raises(ConcurrentCommit):
        table._commit(mine | {"version": table.manifest()["version"]})
    assert {r.k: r.v for r in table.read().collect()}[1] == "first"


def test_superseded_folders_go(spark, table):
    for i in range(4):
        table.upsert(spark.range(2000).select(F.col("id").alias("k"), F.lit(str(i)).alias("v"), F.lit(0.0).alias("w")))
    assert len(os.listdir(os.path.join(table.path, "data"))) == table.keep
    assert len([f for f in os.listdir(os.path.join(table.path, "_manifest")) if f.endswith(".json")]) == table.keep
    assert {r.v for r in table.read().collect()} == {"3"}


def test_columns_added_and_missing(spark, table):
    table.upsert(spark.createDataFrame([(3, 30, "new")], "k int, v int, extra string"))
    got = {r.k: (r.v, r.w, r.extra) for r in table.read().collect()}
    assert got[3] == ("30", 1.0, "new") and got[4] == ("a", 1.0, None) and len(got) == 2000


def test_refusals_and_empty_input(spark, table, tmp_path):
    with pytest.raises(ValueError, match="unique"):
        table.upsert(spark.createDataFrame([(1, "a", 1.0), (1, "b", 1.0)], SCHEMA))
    with pytest.raises(ValueError, match="null"):
        table.upsert(spark.createDataFrame([(None, "a", 1.0)], SCHEMA))
    assert table.upsert(spark.createDataFrame([], SCHEMA))["total"] == 2000
    with pytest.raises(FileNotFoundError):
        KeyedTable(spark, str(tmp_path / "none"), ["k"]).read()
    fresh = KeyedTable(spark, str(tmp_path / "fresh"), ["k"])
    assert fresh.upsert(spark.createDataFrame([], SCHEMA))["total"] == 0 and fresh.read().count() == 0


def test_replayed_epoch_changes_nothing(spark, tmp_path):
    sink = latest.upsert_latest_sink(["p", "s"], "at")
    root = str(tmp_path / "latest")
    schema = "p long, s string, at int, id long, v double"
    sink(spark.createDataFrame([(1, "a", 1, 1, 1.0), (1, "a", 2, 2, 2.0), (2, "a", 1, 3, 3.0), (None, "a", 1, 9, 0.0)], schema), 0, root)
    second = spark.createDataFrame([(1, "a", 1, 4, 4.0), (2, "a", 5, 5, 5.0), (3, "b", 1, 6, 6.0)], schema)
    sink(second, 1, root)
    version = KeyedTable(spark, root, ["p", "s"]).manifest()["version"]
    sink(second.withColumn("v", F.lit(-1.0)), 1, root)
    assert KeyedTable(spark, root, ["p", "s"]).manifest()["version"] == version
    assert rows(latest.read_latest(spark, root, ["p", "s"]).select("p", "s", "v")) == [(1, "a", 2.0), (2, "a", 5.0), (3, "b", 6.0)]


def test_layout_of_every_file(spark, tmp_path):
    """Other order, separator, quoting and columns in each file; header junk above."""
    files = {"a.csv": "User ID,Participant ID,note\naa,1,\"x, y\"\nbb,2,\"two\nlines\"\n",
             "b.csv": "Export\n\nParticipant ID;extra;User ID\n3;\"e;1\";aa, b\n\n4;12\" pipe;cc\n",
             "c.csv": "User ID,Participant ID,note\nzz,5,n\n", "d.csv": "Participant ID;note;note\n6;p;q\n"}
    for name, text in files.items():
        (tmp_path / name).write_text(text, encoding="utf-8")
    out = readers.read_csv_sniffed(spark, str(tmp_path))
    assert out.columns == ["User ID", "Participant ID", "note", "extra", "note_3"]
    assert sorted((tuple(r) for r in out.collect()), key=lambda r: r[1]) == [
        ("aa", "1", "x, y", None, None), ("bb", "2", "two\nlines", None, None), ("aa, b", "3", None, "e;1", None),
        ("cc", "4", None, '12" pipe', None), ("zz", "5", "n", None, None), (None, "6", "p", None, "q")]
