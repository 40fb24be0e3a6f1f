"""Shared helpers of the corpus operators: session settings, Arrow text
buffers, vectorised word spans and hashes.

Words are ``[^\\x20\\x09-\\x0D]+`` everywhere. Buffers are UTF-8 bytes; every
separator is ASCII, so byte-wise splitting never cuts a character.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseframe.session import ensure_checkpoint_dir

WORD = r"[^\x20\x09-\x0D]+"
#: Text bytes handled at once by the vectorised Python code of a task.
CHUNK_BYTES = 8 << 20

_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
_SEP = np.zeros(256, bool)
_SEP[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_MUL = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_SEQ = 0xD6E8FEB86659FD93
_M64 = (1 << 64) - 1


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def small_arrow_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bound the rows of one Arrow batch, so that a run of very long texts
    does not arrive in Python as one batch of gigabytes; and let the workers
    find this package where the driver has it (harmless where it is installed)."""
    env = spark.sparkContext.environment
    here = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if _ROOT not in here:
        env["PYTHONPATH"] = os.pathsep.join([_ROOT, *here])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def saved(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it from there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as a compressed table to the shared checkpoint folder and read it."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/llm-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(docs: DataFrame, text_col: str = "text") -> int:
    """UTF-8 bytes of all texts (sizes buckets; one number reaches the driver)."""
    return int(docs.agg(F.coalesce(F.sum(F.octet_length(text_col).cast("long")), F.lit(0))).first()[0])


# ---------------------------------------------------------------- Arrow text

def chunks(batches: Iterator[pa.RecordBatch], text_col: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches into slices of about ``limit`` text bytes (one row at least)."""
    for b in batches:
        if b.num_rows == 0:
            continue
        n = np.asarray(pc.fill_null(pc.binary_length(b.column(text_col)), 0).to_numpy(zero_copy_only=False), np.int64)
        bounds = np.flatnonzero(np.diff(np.cumsum(n) // limit)) + 1
        for lo, hi in zip([0, *bounds.tolist()], [*bounds.tolist(), b.num_rows], strict=True):
            if hi > lo:
                yield b.slice(lo, hi - lo)


def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all rows end to end, row offsets); null rows are empty."""
    if col.null_count:
        col = pc.fill_null(col, b"" if pa.types.is_binary(col.type) else "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, off_buf, data = col.buffers()
    if len(col) == 0 or off_buf is None:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    off = np.frombuffer(off_buf, np.int64 if wide else np.int32)[col.offset:col.offset + len(col) + 1].astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[off[0]:off[-1]], off - off[0]


def word_spans(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and the word offsets of the rows."""
    n = len(buf)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    sep = _SEP[buf]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = edge[:-1].copy()
    before[1:] |= sep[:-1]
    before[0] = True
    after = edge[1:].copy()
    after[:-1] |= sep[1:]
    after[-1] = True
    word = ~sep
    starts = np.flatnonzero(word & before)
    ends = np.flatnonzero(word & after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def lower_ascii(buf: np.ndarray) -> np.ndarray:
    """A-Z lower-cased, every other byte unchanged."""
    return np.where((buf >= 65) & (buf <= 90), buf + 32, buf).astype(np.uint8)


# ------------------------------------------------------------------- hashing

_POW: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POW or len(_POW[0]) < n:
        size = max(n, 1 << 20)
        inv = pow(int(_MUL), -1, 1 << 64)
        _POW[:] = [np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(size - 1, x, np.uint64)]))
                   for x in (_MUL, np.uint64(inv))]
    return _POW[0], _POW[1]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * _MIX
    h ^= h >> np.uint64(29)
    h *= _MUL
    h ^= h >> np.uint64(32)
    return h


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, step: int = 1 << 20) -> np.ndarray:
    """64-bit hash of every word, in pieces of about ``step`` bytes."""
    out = np.empty(len(starts), np.uint64)
    lo = 0
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + step, "right")))
        a, b = int(starts[lo]), int(ends[hi - 1])
        p, inv = _powers(b - a)
        piece = buf[a:b]
        v = piece.astype(np.uint64)
        v += np.uint64(1)
        v[_SEP[piece]] = 0
        v *= p[:b - a]
        s = starts[lo:hi] - a
        h = np.add.reduceat(v, s)
        h *= inv[s]
        out[lo:hi] = mix(h + (ends[lo:hi] - starts[lo:hi]).astype(np.uint64) * _MIX)
        lo = hi
    return out


def sequence_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Order-sensitive hash of every run of ``k`` consecutive values."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, out_len, cur, cur_len, rest = None, 0, h, 1, k
    while True:
        if rest & 1:
            if out is None:
                out, out_len = cur, cur_len
            else:  # cur first, then what has been gathered
                m = len(h) - (cur_len + out_len) + 1
                out = cur[:m] * np.uint64(pow(_SEQ, out_len, 1 << 64)) + out[cur_len:cur_len + m]
                out_len += cur_len
        rest >>= 1
        if not rest:
            return out[:n]
        m = len(cur) - cur_len
        cur = cur[:m] * np.uint64(pow(_SEQ, cur_len, 1 << 64)) + cur[cur_len:cur_len + m]
        cur_len *= 2


def sliding_min(h: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every ``w`` consecutive values."""
    n = len(h) - w + 1
    if n <= 0:
        return h[:0]
    cur, size = h, 1
    while size * 2 <= w:
        cur = np.minimum(cur[:-size], cur[size:])
        size *= 2
    return np.minimum(cur[:n], cur[w - size:w - size + n])


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Indices ``starts[i] + 0 .. counts[i]-1`` of all i, end to end."""
    total = int(counts.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    first = np.cumsum(counts) - counts
    return np.repeat(starts - first, counts) + np.arange(total)


def single_spaced(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words end to end, one space after each: (bytes, word starts, word ends,
    word offsets of the rows)."""
    starts, ends, rows = word_spans(buf, offsets)
    lens = ends - starts
    stops = np.cumsum(lens + 1)
    out = np.full(int(stops[-1]) if len(stops) else 0, 32, np.uint8)
    keep = np.ones(len(out), bool)
    keep[stops - 1] = False
    out[keep] = buf[~_SEP[buf]]
    return out, stops - 1 - lens, stops - 1, rows


# ---------------------------------------------------------------- components

def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Connected components of edges, as (node, smallest node) for every node
    that is not the smallest of its component. Vectorised hooking to the
    smaller label and pointer jumping."""
    nodes, inv = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = inv[:len(a)], inv[len(a):]
    label = np.arange(len(nodes))
    while len(x):
        lo = np.minimum(x, y)
        hook = np.arange(len(nodes))
        np.minimum.at(hook, x, lo)
        np.minimum.at(hook, y, lo)
        while True:
            jumped = hook[hook]
            if np.array_equal(jumped, hook):
                break
            hook = jumped
        label = hook[label]
        x, y = hook[x], hook[y]
        live = x != y
        x, y = x[live], y[live]
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def components(edges: DataFrame) -> DataFrame:
    """(a, b) edges -> (node, label): the smallest node of each node's component.

    Rounds of hooking every node to its smallest neighbour, one pointer jump
    and contraction, each stored in the checkpoint folder. The minimum is
    combined map-side, and the joins are plain inner ones, so a hub with very
    many edges is pre-aggregated or split.
    """
    spark = edges.sparkSession
    live = saved(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct())
    nodes = None
    while not live.isEmpty():
        both = live.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
            live.select(F.col("b").alias("u"), F.col("a").alias("v")))
        hook = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("p"))
        hook = saved(hook)
        jump = hook.select(F.col("u").alias("p"), F.col("p").alias("q"))
        hook = saved(hook.join(jump, "p").select("u", F.col("q").alias("p")))
        if nodes is None:
            nodes = hook.select(F.col("u").alias("node"), F.col("p").alias("label"))
        else:
            h = hook.select(F.col("u").alias("label"), "p")
            nodes = saved(nodes.join(h, "label", "left").select("node", F.coalesce("p", "label").alias("label")))
        ha, hb = (hook.select(F.col("u").alias(c), F.col("p").alias(f"p{c}")) for c in "ab")
        live = saved(live.join(ha, "a").join(hb, "b").where("pa != pb")
                     .select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct())
    if nodes is None:
        return spark.createDataFrame([], "node long, label long")
    return nodes
