"""SimHash near-duplicates by Golay-code fuzzy hashing.

Fingerprint: 64 bits; a bit is set if it is set in over half of the XXH64
(seed 42) values of the text's word shingles (A-Z lower-cased, repeats
included). No words: zero.

Fingerprints link at ``MAX_BITS`` = 4 or fewer differing bits. A fingerprint
is cut into segments A, B of 23 and C of 18 bits. The binary Golay code
[23, 12, 7] is perfect: every 23-bit word lies within 3 bits of exactly one
codeword. A fingerprint is *stored* under the codewords of its segments, two
segments at a time, and *probes* the codewords a little further away: if the
segments of two fingerprints differ in e bits, the stored codeword of one is
within 3 + e bits of the other's segment. Four errors over three segments
always leave two segments with few enough of them (pigeonhole):

    A, B: (1, 1), (0, 2) or (2, 0) errors at most
    A, C: (1, 1) or (2, 0)
    B, C: (1, 1)

cover every distribution, so no link is lost. Each probe that meets a stored
fingerprint under the same pair of codewords is verified by its bit distance.
Distinct fingerprints only are compared; keys travel packed per bucket, and a
bucket answers with one edge per fingerprint to the smallest one it reaches,
never with all its pairs. Components of those edges are found by rounds of
joins.

Null texts have fingerprint zero and are linked like any other; null ids take
part but never name a component (null if no row of it has an id). Repeated
rows share their fingerprint. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseframe.llm import common

SHINGLE_WORDS = 4
MAX_BITS = 4
HASH_SEED = 42
#: Pairs compared at once within a bucket.
PAIRS = 1 << 21
#: Keys in one bucket (12 bytes each), which sizes the buckets.
BUCKET_KEYS = 1 << 20


# -------------------------------------------------------------- fingerprints

def fingerprint_batch(texts: pa.Array, words: int) -> np.ndarray:
    buf, off = common.text_buffer(texts)
    buf, starts, ends, rows = common.single_spaced(common.lower_ascii(buf), off)
    n_words = np.diff(rows)
    count = np.where(n_words >= words, n_words - words + 1, np.minimum(n_words, 1))
    first = common.spread(rows[:-1], count)
    last = np.minimum(first + words - 1, np.repeat(rows[1:], count) - 1)
    raw, digest = buf.tobytes(), xxhash.xxh64_intdigest
    h = np.fromiter((digest(raw[a:z], HASH_SEED) for a, z in zip(starts[first].tolist(), ends[last].tolist(), strict=True)),
                    np.uint64, len(first))
    out = np.zeros(len(texts), np.uint64)
    some = np.flatnonzero(count)
    if len(some):
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        at = (np.cumsum(count) - count)[some]
        ones = np.add.reduceat(bits, at, axis=0, dtype=np.int32)
        over = (2 * ones > count[some, None]).astype(np.uint8)
        out[some] = np.packbits(over, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def fingerprints(docs: DataFrame, text_col: str = "text", words: int = SHINGLE_WORDS, keep: tuple[str, ...] | None = None,
                 out_col: str = "fp") -> DataFrame:
    """``keep`` columns (default all) and the fingerprint as a signed long."""
    common.small_arrow_batches(docs.sparkSession)
    keep = tuple(c for c in docs.columns if c != out_col) if keep is None else keep
    schema = docs.select(*keep).withColumn(out_col, F.lit(0).cast("long")).schema
    source = docs.select(*keep, docs[text_col].alias("_simhash_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.chunks(batches, "_simhash_text", 2 << 20):
            fp = fingerprint_batch(b.column("_simhash_text"), words)
            yield pa.RecordBatch.from_arrays([b.column(k) for k in keep] + [pa.array(fp.view(np.int64))], names=[*keep, out_col])

    return source.mapInArrow(run, schema)


# ------------------------------------------------------------------ the code

#: Generator polynomial of the binary Golay code [23, 12, 7].
GENERATOR = 0xC75


@cache
def golay() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the low 12 and high 11 bits, the error patterns of every
    syndrome (lightest first, then weights 4 and 5), and the leaders' weight."""
    def remainder(x: int) -> int:
        for i in range(22, 10, -1):
            if x >> i & 1:
                x ^= GENERATOR << (i - 11)
        return x

    unit = [remainder(1 << i) for i in range(23)]

    def syndromes(bits: range) -> np.ndarray:
        s = np.zeros(1, np.int64)
        for i in bits:
            s = np.concatenate([s, s ^ unit[i]])
        return s

    low, high = syndromes(range(12)), syndromes(range(12, 23))
    patterns: list[list[int]] = [[] for _ in range(2048)]
    weight = np.zeros(2048, np.int64)
    for w in range(6):
        for at in combinations(range(23), w):
            s = 0
            for i in at:
                s ^= unit[i]
            if not patterns[s]:
                weight[s] = w
            patterns[s].append(sum(1 << i for i in at))
    table = np.zeros((2048, 22), np.uint32)
    for s, p in enumerate(patterns):
        table[s, :len(p)] = p
    return low, high, table, weight


SEGMENTS = {"A": (0, 23), "B": (23, 23), "C": (46, 18)}
#: Segment pairs, and the errors beside (1, 1) that each has to bear.
FAMILIES = [("A", "B", ((0, 2), (2, 0))), ("A", "C", ((2, 0),)), ("B", "C", ())]


def _near(weight: int, errors: int) -> range:
    """Columns of the pattern table within 3 + ``errors`` bits."""
    size = {0: (1, 1, 1), 1: (1, 1, 1), 2: (1, 1, 22), 3: (1, 6, 22)}[weight][errors]
    return range(size)


def _keys(fp: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(family, key, index of the fingerprint, is stored) of all keys."""
    low, high, table, weight = golay()
    seg, syn = {}, {}
    for k, (at, width) in SEGMENTS.items():
        seg[k] = (fp >> np.uint64(at) & np.uint64((1 << width) - 1)).astype(np.uint32)
        syn[k] = low[seg[k] & 0xFFF] ^ high[seg[k] >> 12]
    index = lambda k, rows, cols: (seg[k][rows, None] ^ table[syn[k][rows]][:, cols]) >> np.uint32(11)
    for f, (x, y, more) in enumerate(FAMILIES):
        every = np.arange(len(fp))
        store = index(x, every, [0])[:, 0] << np.uint32(12) | index(y, every, [0])[:, 0]
        yield f, store, every, np.ones(len(fp), bool)
        wx, wy = np.maximum(weight[syn[x]], 1), np.maximum(weight[syn[y]], 1)
        for a in (1, 2, 3):
            for b in (1, 2, 3):
                rows = np.flatnonzero((wx == a) & (wy == b))
                if not len(rows):
                    continue
                pairs = sorted({(i, j) for ex, ey in ((1, 1), *more) for i in _near(a, ex) for j in _near(b, ey)})
                i, j = np.array(pairs).T
                key = index(x, rows, i) << np.uint32(12) | index(y, rows, j)
                yield f, key.ravel(), np.repeat(rows, len(pairs)), np.zeros(key.size, bool)


def _links(keys: np.ndarray, fps: np.ndarray, stored: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Verified links of one bucket, as a forest."""
    s_key, s_fp = keys[stored], fps[stored]
    p_key, p_fp = keys[~stored], fps[~stored]
    order = np.argsort(p_key, kind="stable")
    p_key, p_fp = p_key[order], p_fp[order]
    lo, hi = np.searchsorted(p_key, s_key, "left"), np.searchsorted(p_key, s_key, "right")
    n = hi - lo
    found_a, found_b = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    upto = np.cumsum(n)
    done = 0
    while done < len(n):
        base = upto[done - 1] if done else 0
        end = max(done + 1, int(np.searchsorted(upto, base + PAIRS, "right")))
        a = np.repeat(s_fp[done:end], n[done:end])
        b = p_fp[common.spread(lo[done:end], n[done:end])]
        near = (np.bitwise_count(a ^ b) <= max_bits) & (a != b)
        u, v = common.forest(a[near], b[near])
        found_a.append(u)
        found_b.append(v)
        done = end
    return common.forest(np.concatenate(found_a), np.concatenate(found_b))


def links(fps: DataFrame, max_bits: int = MAX_BITS, n_distinct: int | None = None) -> DataFrame:
    """Distinct fingerprints (column fp) -> edges (a, b) whose components are
    those of all links at ``max_bits`` or fewer differing bits."""
    if not 0 <= max_bits <= MAX_BITS:
        raise ValueError(f"the segment pairs bear at most {MAX_BITS} errors")
    spark = fps.sparkSession
    common.small_arrow_batches(spark, 10_000)
    n = fps.count() if n_distinct is None else n_distinct
    per_family = max(1, -(-n * 61 // BUCKET_KEYS))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            every: dict[int, list] = {}
            for f, key, row, stored in _keys(fp):
                bucket = f * per_family + common.mix(key.astype(np.uint64)) % np.uint64(per_family)
                every.setdefault(f, []).append((bucket.astype(np.int32), key, fp[row], stored))
            for pieces in every.values():
                bucket, key, of, stored = (np.concatenate(x) for x in zip(*pieces, strict=True))
                order = np.argsort(bucket, kind="stable")
                bucket = bucket[order]
                cuts = np.flatnonzero(np.diff(bucket)) + 1
                groups = np.split(order, cuts)
                yield pa.RecordBatch.from_arrays([
                    pa.array(bucket[np.concatenate([[0], cuts])] if len(bucket) else bucket, pa.int32()),
                    *(pa.array([x[g].tobytes() for g in groups], pa.binary()) for x in (key, of, stored))],
                    names=["bucket", "keys", "fps", "stored"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(held: list) -> pa.RecordBatch:
            keys, of, stored = (np.frombuffer(b"".join(x[i] for x in held), kind)
                                for i, kind in enumerate((np.uint32, np.uint64, bool)))
            a, b = _links(keys, of, stored, max_bits)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        now, held = None, []
        for b in batches:
            for k, *row in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if k != now and held:
                    yield out(held)
                    held = []
                now = k
                held.append(row)
        if held:
            yield out(held)

    dealt = fps.select("fp").mapInArrow(deal, "bucket int, keys binary, fps binary, stored binary")
    met = dealt.repartition(common.parts(spark), "bucket").sortWithinPartitions("bucket")
    return met.mapInArrow(meet, "a long, b long")


def near_duplicates(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", words: int = SHINGLE_WORDS,
                    max_bits: int = MAX_BITS, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, *keep, fp, component_id) of every row of ``docs``."""
    fp = common.saved(fingerprints(docs, text_col, words, keep=(id_col, *keep)))
    distinct = common.saved(fp.groupBy("fp").agg(F.min(id_col).alias("_first")))
    n = distinct.count()
    # Few partitions of many fingerprints would pack better, many spread the work.
    rows = distinct.select("fp").repartition(max(1, min(common.parts(distinct.sparkSession), n // 2000 + 1)))
    edges = common.saved(links(rows, max_bits, n))
    label = common.components(edges)
    named = (distinct.join(label.select(F.col("node").alias("fp"), F.col("label").alias("_label")), "fp", "left")
             .withColumn("_label", F.coalesce("_label", "fp")))
    first = named.groupBy("_label").agg(F.min("_first").alias("component_id"))
    return fp.join(named.join(first, "_label").select("fp", "component_id"), "fp").select(id_col, *keep, "fp", "component_id")


def hex16(fp: str = "fp"):
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: fingerprint and the smallest doc_id it is linked to."""
    d = common.documents(spark, sf_dir).select("doc_id", "text")
    return near_duplicates(d).select("doc_id", hex16().alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """One row of each component: the one with the smallest doc_id (null ids
    last, then by text), its columns unchanged."""
    tagged = docs.withColumn("_tag", F.xxhash64("text"))
    found = near_duplicates(tagged, keep=("_tag",))
    # A component without any id is told apart by its smallest fingerprint.
    group = F.struct(F.col("component_id"), F.when(F.col("component_id").isNull(), F.col("fp")))
    first = (found.groupBy(group.alias("_group"))
             .agg(F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("_tag"))).alias("_row"))
             .select(F.col("_row.doc_id").alias("_id"), F.col("_row._tag").alias("_t")))
    kept = tagged.join(first, tagged["doc_id"].eqNullSafe(first["_id"]) & (tagged["_tag"] == first["_t"]), "left_semi")
    return kept.dropDuplicates(["doc_id", "_tag"]).select(*docs.columns)


QUERIES = {"op8_simhash": op8_simhash}
ORACLE: dict[str, str] = {}
