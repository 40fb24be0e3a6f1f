"""Substring deduplication over windows of words by super-k-mers.

A window is ``window`` consecutive words of one document; it is removed if its
word sequence also starts earlier (smaller doc_id, or same document and
earlier start), judged on the input. Each window belongs to its minimiser, the
least of its ``mer``-word hashes; consecutive windows that share one travel as
a single packed string of their words (a super-k-mer) to the minimiser's
bucket. All occurrences of a window meet in one bucket, where its windows are
sorted by a 64-bit hash; equal neighbours are compared word by word, so hash
collisions never count. The bucket answers with the ranges of windows that
start earlier elsewhere, and these return to the documents.

Frequent phrases: word runs with more than 1 / ``HOT_SHARE`` of all words (so
at most ``HOT_SHARE`` of them, 8 bytes each, broadcast) rank behind all others
as minimisers. A window made of nothing else lies inside a very common
passage; such windows are dealt by their own hash instead and combined in the
map task before they travel (the first occurrence goes, the later ones are
marked at once), so neither a common line nor a passage copied millions of
times gathers in one bucket.

Buckets and document groups are sized from the corpus bytes, so that a task
holds one of a few tens of MB whatever the corpus size. Null texts have no
words. Rows sharing a doc_id are one document at equal positions: they do not
remove each other's windows at the same start; windows are told apart by text
checksum. Null ids sort after all others. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulseframe.llm import common

WINDOW_WORDS = 20
MER_WORDS = 5
HOT_SHARE = 1 << 17
#: Packed bytes in one bucket, text bytes in one group of documents.
BUCKET_BYTES = 14 << 20
GROUP_BYTES = 12 << 20
#: Packed bytes a map task gathers before it writes its buckets' rows.
GATHERED = 32 << 20
_NO_ID = np.iinfo(np.int64).max
_TOP = np.uint64(1 << 63)


class Chunk:
    """Words, hashes and windows of a slice of documents."""

    def __init__(self, texts: pa.Array, window: int, mer: int):
        buf, off = common.text_buffer(texts)
        self.buf, self.starts, self.ends, self.rows = common.single_spaced(buf, off)
        self.hash = common.word_hashes(self.buf, self.starts, self.ends)
        self.window, self.mer = window, mer
        n_words = np.diff(self.rows)
        self.n_windows = np.maximum(n_words - window + 1, 0)
        #: Word index at which each window starts, and its document.
        self.first = common.spread(self.rows[:-1], self.n_windows)
        self.doc = np.repeat(np.arange(len(n_words)), self.n_windows)

    def mers(self) -> np.ndarray:
        """Hash of every word run within a document, top bit clear."""
        return common.mix(common.sequence_hashes(self.hash, self.mer)) >> np.uint64(1)

    def window_mers(self) -> np.ndarray:
        n_words = np.diff(self.rows)
        count = np.maximum(n_words - self.mer + 1, 0)
        return self.mers()[common.spread(self.rows[:-1], count)]


def hot_mers(docs: DataFrame, text_col: str, mer: int) -> np.ndarray:
    """Sorted hashes of the word runs above the share, at most HOT_SHARE."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.chunks(batches, text_col):
            h = Chunk(b.column(text_col), mer, mer).window_mers()
            value, n = np.unique(h, return_counts=True)
            often = n >= max(2, len(h) // (2 * HOT_SHARE))
            value, n = value[often], n[often]
            yield pa.RecordBatch.from_arrays([pa.array([None, *value.view(np.int64).tolist()], pa.int64()),
                                              pa.array([len(h), *n.tolist()], pa.int64())], names=["mer", "n"])

    counted = docs.select(text_col).mapInArrow(count, "mer long, n long").groupBy("mer").agg(F.sum("n").alias("n"))
    counted = common.saved(counted.where("mer IS NULL OR n >= 8"))
    total = counted.where("mer IS NULL").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    # What chunks left out below their own threshold is at most half.
    hot = counted.where(F.col("mer").isNotNull() & (F.col("n") * 2 * HOT_SHARE > total)).select("mer")
    found = np.array([r[0] for r in hot.limit(2 * HOT_SHARE).toLocalIterator()], np.int64).view(np.uint64)
    return np.sort(found)


def _is_hot(h: np.ndarray, hot: np.ndarray) -> np.ndarray:
    out = np.zeros(len(h), bool)
    if len(hot):
        maybe = np.zeros(1 << 20, bool)
        maybe[hot & np.uint64(0xFFFFF)] = True
        at = np.flatnonzero(maybe[h & np.uint64(0xFFFFF)])
        i = np.minimum(np.searchsorted(hot, h[at]), len(hot) - 1)
        out[at] = hot[i] == h[at]
    return out


def _earliest(key: np.ndarray, order: np.ndarray, same: np.ndarray) -> np.ndarray:
    """Least key of each run of ``order`` (same: continues the run before)."""
    at = np.flatnonzero(~same)
    least = np.minimum.reduceat(key[order], at) if len(at) else key[:0]
    return np.repeat(least, np.diff(np.append(at, len(order))))


def _same_run(h: np.ndarray, raw: bytes, a: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of windows in which equal word sequences stand together, and
    whether each one equals its predecessor there (compared byte by byte)."""
    order = np.argsort(h, kind="stable")
    hs = h[order]
    same = np.concatenate([[False], hs[1:] == hs[:-1]]) if len(h) else np.zeros(0, bool)
    check = np.flatnonzero(same)
    i, j = order[check], order[check - 1]
    differ = [k for k, (p, q, r, s) in enumerate(zip(a[i].tolist(), z[i].tolist(), a[j].tolist(), z[j].tolist(), strict=True))
              if raw[p:q] != raw[r:s]]
    if differ:  # a hash collision: sort those runs by their words
        for hv in np.unique(hs[check[differ]]).tolist():
            lo, hi = np.searchsorted(hs, [hv, hv + 1]) if hv < 2**64 - 1 else (np.searchsorted(hs, hv), len(hs))
            run = sorted(order[lo:hi].tolist(), key=lambda x: raw[a[x]:z[x]])
            order[lo:hi] = run
            same[lo:hi] = [False] + [raw[a[x]:z[x]] == raw[a[y]:z[y]] for x, y in zip(run[1:], run, strict=False)]
    return order, same


def _ranges(doc: np.ndarray, tag: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of consecutive window starts: (doc, tag, first start, windows)."""
    if not len(doc):
        return doc, tag, start, start
    order = np.lexsort((start, tag, doc))
    doc, tag, start = doc[order], tag[order], start[order]
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1]) | (start[1:] > start[:-1] + 1)])
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(doc)) - 1
    return doc[at], tag[at], start[at], start[last] - start[at] + 1


#: Rows between the map tasks and the buckets. ``done`` holds ranges that the
#: map task has settled itself: they only pass through.
PACKED = "bucket int, text binary, doc binary, tag binary, start binary, windows binary, done binary"


def _pack(bucket: int, text: bytes, doc, tag, start, windows, done: bytes = b"") -> tuple:
    squeeze = zstandard.ZstdCompressor(level=3).compress
    return (bucket, squeeze(text), squeeze(doc.astype(np.int64).tobytes()), squeeze(tag.astype(np.uint32).tobytes()),
            squeeze(start.astype(np.int32).tobytes()), squeeze(windows.astype(np.int32).tobytes()), done)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32()] + [pa.binary()] * 6
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)],
                                      names=["bucket", "text", "doc", "tag", "start", "windows", "done"])


def repeated_ranges(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", window: int = WINDOW_WORDS,
                    mer: int = MER_WORDS, n_bytes: int | None = None) -> DataFrame:
    """(doc_id, tag, start, windows): runs of windows whose word sequences
    start earlier elsewhere. ``start`` counts the document's words from 0,
    ``tag`` is the text's CRC-32; a null id is the largest long."""
    spark = docs.sparkSession
    common.small_arrow_batches(spark)
    mer = min(mer, window)
    docs = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    n_bytes = common.text_bytes(docs) if n_bytes is None else n_bytes
    expand = 1 + (window - 1) / max(1.0, (window - mer + 2) / 2)
    n_buckets = max(common.parts(spark), int(n_bytes * expand) // BUCKET_BYTES + 1)
    hot = spark.sparkContext.broadcast(hot_mers(docs, "text", mer).tobytes())

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = np.frombuffer(hot.value, np.uint64)
        held: list[tuple] = []
        size = 0
        for b in common.chunks(batches, "text"):
            c = Chunk(b.column("text"), window, mer)
            if not len(c.first):
                continue
            ids = b.column("doc").fill_null(_NO_ID).to_numpy(zero_copy_only=False)
            tags = np.array([zlib.crc32((t or "").encode()) for t in b.column("text").to_pylist()], np.uint32)
            m = c.mers()
            m[_is_hot(m, often)] |= _TOP
            least = common.sliding_min(m, window - mer + 1)[c.first]
            start = (c.first - c.rows[:-1][c.doc]).astype(np.int64)
            inside = least >= _TOP  # every word run of the window is a very common one
            raw = c.buf.tobytes()
            # Runs of consecutive windows of a document with one minimiser.
            new = np.ones(len(least), bool)
            new[1:] = (least[1:] != least[:-1]) | (c.doc[1:] != c.doc[:-1]) | inside[1:]
            at = np.flatnonzero(new)
            count = np.diff(np.append(at, len(least)))
            key = least[at]
            keep = np.ones(len(at), bool)
            done = b""
            if inside.any():
                one = np.flatnonzero(inside[at])
                w = at[one]
                h = common.mix(common.sequence_hashes(c.hash, window)[c.first[w]])
                key[one] = h
                a, z = c.starts[c.first[w]], c.ends[c.first[w] + window - 1]
                order, same = _same_run(h, raw, a, z)
                rank = np.unique(ids[c.doc[w]], return_inverse=True)[1].astype(np.uint64) << np.uint64(32) | start[w].astype(np.uint64)
                first = _earliest(rank, order, same)
                later = rank[order] > first
                gone = order[later]
                keep[one[gone]] = False
                # Of equal windows at one position (repeated rows) each stays.
                d, t, s, n = _ranges(ids[c.doc[w[gone]]], tags[c.doc[w[gone]]], start[w[gone]])
                if len(d):
                    done = b"".join(x.astype(np.int64).tobytes() for x in (d, t, s, n))
            at, count, key = at[keep], count[keep], key[keep]
            bucket = (common.mix(key) % np.uint64(n_buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            at, count, bucket = at[order], count[order], bucket[order]
            word = c.first[at]
            pieces = [raw[x:y] for x, y in zip(c.starts[word].tolist(), c.ends[word + count + window - 2].tolist(), strict=True)]
            held.append((bucket, pieces, ids[c.doc[at]], tags[c.doc[at]], start[at], count, done))
            size += sum(map(len, pieces))
            if size >= GATHERED:
                yield from _gathered(held)
                held, size = [], 0
        if held:
            yield from _gathered(held)

    def _gathered(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        by: dict[int, list] = {}
        for chunk in held:
            bucket = chunk[0]
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]])
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if hi > lo:
                    by.setdefault(int(bucket[lo]), []).append([x[lo:hi] for x in chunk[1:6]])
        rows = [_pack(k, b"".join(p + b"\n" for x in v for p in x[0]), *(np.concatenate([x[i] for x in v]) for i in range(1, 5)))
                for k, v in by.items()]
        none = np.zeros(0, np.int64)
        for i, chunk in enumerate(held):
            if chunk[6]:
                rows.append(_pack(i % n_buckets, b"", none, none, none, none, chunk[6]))
        for lo in range(0, len(rows), 64):
            yield _batch(rows[lo:lo + 64])

    def settle(held: list[tuple]) -> pa.RecordBatch:
        un = zstandard.ZstdDecompressor().decompress
        text = b"".join(un(r[0]) for r in held)
        doc, tag, start, windows = (np.concatenate([np.frombuffer(un(r[i]), kind) for r in held])
                                    for i, kind in ((1, np.int64), (2, np.uint32), (3, np.int32), (4, np.int32)))
        out = [[], [], [], []]
        if len(doc):
            buf = np.frombuffer(text, np.uint8)
            s, e, _ = common.word_spans(buf, np.array([0, len(buf)]))
            n_words = windows.astype(np.int64) + window - 1
            first_word = np.cumsum(n_words) - n_words
            h = common.sequence_hashes(common.word_hashes(buf, s, e), window)
            word = common.spread(first_word, windows.astype(np.int64))
            at = common.spread(start.astype(np.int64), windows.astype(np.int64))
            row = np.repeat(np.arange(len(doc)), windows)
            h = common.mix(h[word])
            order, same = _same_run(h, text, s[word], e[word + window - 1])
            del h
            rank = np.unique(doc, return_inverse=True)[1].astype(np.uint64)[row] << np.uint64(32) | at.astype(np.uint64)
            later = order[rank[order] > _earliest(rank, order, same)]
            for o, x in zip(out, _ranges(doc[row[later]], tag[row[later]], at[later]), strict=True):
                o.append(x.astype(np.int64))
        for r in held:
            if r[5]:
                for o, x in zip(out, np.frombuffer(r[5], np.int64).reshape(4, -1), strict=True):
                    o.append(x)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(o) if o else np.zeros(0, np.int64), pa.int64()) for o in out],
                                          names=["doc_id", "tag", "start", "windows"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for b in batches:
            for k, *row in zip(*(b.column(i).to_pylist() for i in range(7)), strict=True):
                if k != now and held:
                    yield settle(held)
                    held = []
                now = k
                held.append(row)
        if held:
            yield settle(held)

    dealt = docs.mapInArrow(deal, PACKED)
    met = dealt.repartition(common.parts(spark), "bucket").sortWithinPartitions("bucket")
    return met.mapInArrow(meet, "doc_id long, tag long, start long, windows long")


def remove_repeats(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", window: int = WINDOW_WORDS,
                   mer: int = MER_WORDS, digest: bool = False) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, and the kept words joined by one
    space (``digest``: their SHA-256 instead)."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    n_bytes = common.text_bytes(docs)
    groups = max(common.parts(spark), n_bytes // GROUP_BYTES + 1)
    found = common.saved(repeated_ranges(docs, "text", "doc_id", window, mer, n_bytes))
    group = lambda c: F.pmod(F.xxhash64(c), F.lit(groups)).cast("int").alias("grp")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts travel compressed, one row for each group and slice."""
        for b in common.chunks(batches, "text"):
            grp = b.column("grp").to_numpy()
            squeeze = zstandard.ZstdCompressor(level=3).compress
            groups_in, rows = np.unique(grp), []
            for g in groups_in.tolist():
                t = b.take(pa.array(np.flatnonzero(grp == g))).select(["doc_id", "text"])
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, t.schema) as w:
                    w.write_batch(t)
                rows.append(squeeze(sink.getvalue().to_pybytes()))
            yield pa.RecordBatch.from_arrays([pa.array(groups_in, pa.int32()), pa.array(rows, pa.binary())], names=["grp", "texts"])

    packed = docs.select(group(F.coalesce("doc_id", F.lit(_NO_ID))), "doc_id", "text").mapInArrow(pack, "grp int, texts binary")
    marks = found.select(group("doc_id"), "doc_id", "tag", "start", "windows")
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_words", T.LongType()),
                           T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256" if digest else "kept", T.StringType())])

    def cut(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        order = np.lexsort((right["tag"].to_numpy(), right["doc_id"].to_numpy()))
        doc, tag, start, n = (right[c].to_numpy()[order] for c in ("doc_id", "tag", "start", "windows"))
        out = []
        for blob in left["texts"]:
            t = pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(blob)).read_all().combine_chunks()
            ids, col = t.column("doc_id").to_pylist(), t.column("text").combine_chunks()
            buf, off = common.text_buffer(col)
            buf, s, e, rows = common.single_spaced(buf, off)
            raw = buf.tobytes()
            for i, (d, text) in enumerate(zip(ids, col.to_pylist(), strict=True)):
                a, z = int(rows[i]), int(rows[i + 1])
                key = _NO_ID if d is None else d
                lo, hi = np.searchsorted(doc, [key]), np.searchsorted(doc, [key], "right")
                lo, hi = int(lo[0]), int(hi[0])
                kept, removed = raw[s[a]:e[z - 1]] if z > a else b"", 0
                if hi > lo:
                    mine = lo + np.flatnonzero(tag[lo:hi] == zlib.crc32((text or "").encode()))
                    edge = np.zeros(z - a + 1, np.int64)
                    np.add.at(edge, start[mine], 1)
                    np.add.at(edge, start[mine] + n[mine] + window - 1, -1)
                    stay = np.flatnonzero(np.cumsum(edge[:-1]) == 0)
                    removed = z - a - len(stay)
                    if removed:
                        kept = b" ".join([raw[x:y] for x, y in zip(s[a + stay].tolist(), e[a + stay].tolist(), strict=True)])
                out.append((d, z - a, removed, hashlib.sha256(kept).hexdigest() if digest else kept.decode()))
        frame = pd.DataFrame(out, columns=[f.name for f in schema])
        frame["doc_id"] = frame["doc_id"].astype("Int64")
        return frame

    return packed.groupBy("grp").cogroup(marks.groupBy("grp")).applyInPandas(cut, schema)


def op1_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: words, removed words and the digest of the kept ones."""
    return remove_repeats(common.documents(spark, sf_dir), digest=True)


QUERIES = {"op1_substring": op1_substring}
ORACLE: dict[str, str] = {}
