"""Keyed tables: key-hash bucket folders and one manifest file per version.

A table is a folder of ``data/<commit>/_bucket=<n>/`` parquet folders and of
``_manifest/<version>.json`` files. A manifest names the folder of every
bucket; writing it is the only commit. A merge reads and rewrites the buckets
that hold incoming keys and no others, and the new manifest takes the rest
over from the version before. Manifests are created exclusively, so of two
writers that start from one version the second fails, and one that dies before
its commit leaves the old version as it was. No folder is renamed, which
object stores cannot do atomically. Folders that no kept version names are
removed.

The driver holds one manifest: one entry per bucket, a number fixed when the
table is created (size it so that a bucket suits one task).
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pulseframe.session import cut_lineage
from pulseframe.sources.sinks import _fs_and_path, upsert_frames

BUCKET = "_bucket"


class ConcurrentCommit(RuntimeError):
    """Another writer committed the version this one was about to write."""


class KeyedTable:
    """A parquet table with unique, non-null keys (``keys``), stored by key hash."""

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], buckets: int = 64, keep: int = 2):
        self.spark, self.path, self.keys = spark, path.rstrip("/"), list(keys)
        self.buckets, self.keep = buckets, keep

    # ------------------------------------------------------------- manifests

    def _manifests(self) -> list[int]:
        fs, folder, _ = _fs_and_path(self.spark, f"{self.path}/_manifest")
        if not fs.exists(folder):
            return []
        names = [st.getPath().getName() for st in fs.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def _load(self, version: int) -> dict | None:
        """The manifest of a version; None where its writer died while writing it."""
        fs, file, jvm = _fs_and_path(self.spark, f"{self.path}/_manifest/{version:012d}.json")
        stream = fs.open(file)
        try:
            text = jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        try:
            return json.loads(text)
        except json.JSONDecodeError:
            return None

    def manifest(self) -> dict | None:
        """The newest committed version, or None for a table not yet written."""
        for version in reversed(self._manifests()):
            found = self._load(version)
            if found is not None:
                return found
        return None

    def _commit(self, manifest: dict) -> None:
        fs, file, jvm = _fs_and_path(self.spark, f"{self.path}/_manifest/{manifest['version']:012d}.json")
        if fs.exists(file):
            raise ConcurrentCommit(f"version {manifest['version']} of {self.path} exists")
        try:
            stream = fs.create(file, False)
        except Exception as e:
            raise ConcurrentCommit(f"version {manifest['version']} of {self.path} exists") from e
        stream.write(bytearray(json.dumps(manifest).encode("utf-8")))
        stream.close()

    # ----------------------------------------------------------------- reads

    def _frame(self, manifest: dict, only: Sequence[int] | None = None) -> DataFrame:
        schema = StructType.fromJson(manifest["schema"])
        folders = [f"{self.path}/{f}" for b, f in manifest["folders"].items() if only is None or int(b) in only]
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*folders)

    def read(self) -> DataFrame:
        """The newest version; columns added later are NULL in older buckets."""
        manifest = self.manifest()
        if manifest is None:
            raise FileNotFoundError(self.path)
        return self._frame(manifest)

    # ---------------------------------------------------------------- writes

    def merge(self, incoming: DataFrame, combine: Callable[[DataFrame | None, DataFrame], DataFrame],
              tag: int | None = None) -> dict:
        """Replace the buckets holding keys of ``incoming`` by ``combine(old rows
        of those buckets, incoming)`` and commit.

        ``combine`` returns the table's rows with ``_op`` (insert, update or
        keep). A ``tag`` (an epoch) at or below the newest version's is a
        replay and changes nothing. Returns the counts.
        """
        current = self.manifest()
        if current is not None and tag is not None and current.get("tag") is not None and current["tag"] >= tag:
            return {"inserted": 0, "updated": 0, "kept": current["rows"], "total": current["rows"], "buckets": 0}
        if current is not None:
            kinds = {f.name: f.dataType for f in StructType.fromJson(current["schema"])}
            incoming = incoming.select(*[F.col(f"`{c}`").cast(kinds[c]).alias(c) if c in kinds else F.col(f"`{c}`")
                                         for c in incoming.columns])
        buckets = current["buckets"] if current else self.buckets
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(buckets)).cast("int")
        incoming = cut_lineage(incoming)
        if not incoming.where(" OR ".join(f"`{k}` IS NULL" for k in self.keys)).isEmpty():
            raise ValueError(f"keys {self.keys} must not be null")
        touched = [r[0] for r in incoming.select(bucket.alias("b")).distinct().collect()]  # at most ``buckets``
        old = self._frame(current, touched) if current else None
        seen = Observation()
        is_op = lambda op: F.coalesce(F.sum((F.col("_op") == op).cast("long")), F.lit(0))
        rows = combine(old, incoming).observe(seen, is_op("insert").alias("inserted"), is_op("update").alias("updated"),
                                              F.count(F.lit(1)).alias("written"))
        rows = rows.drop("_op").withColumn(BUCKET, bucket)
        commit = f"data/{int(time.time())}-{uuid.uuid4().hex[:12]}"
        if touched:
            rows.repartition(len(touched), BUCKET).write.partitionBy(BUCKET).parquet(f"{self.path}/{commit}")
            counts = dict(seen.get)
        else:
            counts = {"inserted": 0, "updated": 0, "written": 0}
        written = set(self._buckets_of(commit)) if touched else set()
        folders = {b: f for b, f in (current["folders"] if current else {}).items() if int(b) not in touched}
        folders |= {str(b): f"{commit}/{BUCKET}={b}" for b in sorted(written)}
        before = current["rows"] if current else 0
        total = before + counts["inserted"]
        version = (self._manifests() or [0])[-1] + 1 if current is None else max(self._manifests()[-1], current["version"]) + 1
        self._commit({"version": version, "buckets": buckets, "keys": self.keys, "tag": tag, "rows": total,
                      "schema": json.loads(rows.drop(BUCKET).schema.json()), "folders": folders})
        self.vacuum()
        return {"inserted": counts["inserted"], "updated": counts["updated"],
                "kept": total - counts["inserted"] - counts["updated"], "total": total, "buckets": len(touched)}

    def upsert(self, incoming: DataFrame, tag: int | None = None) -> dict:
        """Insert new keys, overwrite stored ones (NULLs included), keep the rest.

        Raises where a key occurs twice in ``incoming``.
        """
        incoming = cut_lineage(incoming)
        if not incoming.groupBy(*self.keys).count().where("count > 1").isEmpty():
            raise ValueError(f"keys {self.keys} are not unique in the incoming rows")

        def combine(old: DataFrame | None, new: DataFrame) -> DataFrame:
            return new.withColumn("_op", F.lit("insert")) if old is None else upsert_frames(old, new, self.keys)

        return self.merge(incoming, combine, tag)

    def _buckets_of(self, commit: str) -> list[int]:
        fs, folder, _ = _fs_and_path(self.spark, f"{self.path}/{commit}")
        names = [st.getPath().getName() for st in fs.listStatus(folder)]
        return [int(n.split("=")[1]) for n in names if n.startswith(f"{BUCKET}=")]

    # ----------------------------------------------------------- housekeeping

    def vacuum(self, orphans_older_than_s: float | None = None) -> list[str]:
        """Remove versions beyond the newest ``keep`` and the folders only they name.

        ``orphans_older_than_s``: also remove commits of at least that age that
        no manifest names (their writer died); off by default, for another
        writer's folder looks the same until it commits.
        """
        fs, _, jvm = _fs_and_path(self.spark, self.path)
        at = lambda name: jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        versions = self._manifests()
        loaded = {v: self._load(v) for v in versions}
        good = [v for v in versions if loaded[v] is not None]
        kept = good[-self.keep:]
        named = {f for v in kept for f in loaded[v]["folders"].values()}
        gone = []
        for v in good[:-self.keep]:
            for f in set(loaded[v]["folders"].values()) - named:
                if fs.delete(at(f), True):
                    gone.append(f)
            fs.delete(at(f"_manifest/{v:012d}.json"), False)
        commits = {f.rsplit("/", 1)[0] for f in named}
        if fs.exists(at("data")):
            for st in fs.listStatus(at("data")):
                name = f"data/{st.getPath().getName()}"
                if name in commits:
                    continue
                empty = not any(c.isDirectory() for c in fs.listStatus(st.getPath()))
                made = int(st.getPath().getName().split("-")[0])
                old = orphans_older_than_s is not None and time.time() - made >= orphans_older_than_s
                if (empty and any(g.startswith(name + "/") for g in gone)) or old:
                    fs.delete(st.getPath(), True)
                    gone.append(name)
        return gone
