"""Toxicity by maximum-scoring segments of token log-odds.

Tokens are letter runs (A-Z and Latin-1 capitals lower-cased). A token stands
for itself and, beyond ``STEM`` characters, for its stem of that length. The
toxic share of a token's documents is estimated under a Dirichlet prior
centred on its stem's share, the stem's under one centred on the whole
sample's; a token scores the log-odds of that share against the sample's, if
the root of twice their log likelihood ratio exceeds what chance makes of as many
tokens (sqrt(2 ln V)), and nothing otherwise. Every token
also pays ``DRIFT``, so that the expected score of harmless text is negative.

A linear scan (all maximal scoring segments, in one pass) finds the passages.
Segment scores have an extreme-value distribution: with lambda the positive
root of E[exp(lambda s)] = 1 over harmless tokens and K fitted to harmless
documents, a document of n tokens has K n exp(-lambda S) segments of score S
or more by chance. Passages below ``MAX_CHANCE`` are significant; their
evidence (-log chance) is summed and mapped to a probability by a logistic
curve fitted to the labelled documents.

The model is learned from at most about ``SAMPLE`` labelled documents (drawn
by hash; a documented bound). Copies would make chance words of one text look
toxic, so of the sample's texts that share the least hash of their
``COPY_WORDS``-word runs one per label is used. All texts are scored whole. The model's table
holds the tokens of that sample that pass the test, ``MAX_TABLE`` at most, and
is the only thing broadcast. Null and empty texts hold no tokens and score as
harmless as a text can; null labels are ignored; an id labelled more than once
counts once, as toxic if any of its rows says so. Repeated rows are scored one
by one. Without labels, every score is the prior 0.5.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseframe.llm import common

STEM = 4
MIN_DOCS = 3
COPY_WORDS = 8
PRIOR = 5.0
DRIFT = 0.1
MAX_CHANCE = 0.05
SAMPLE = 40_000
MAX_TABLE = 100_000
THRESHOLD = 0.7
_STEM_SALT = np.uint64(0x5851F42D4C957F2D)

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_LETTER[128:] = True


class Tokens:
    """Token spans of a slice of texts with the hashes of tokens and stems."""

    def __init__(self, texts: pa.Array):
        buf, self.off = common.text_buffer(texts)
        buf = common.lower_ascii(buf)
        if len(buf):
            capital = np.concatenate([[False], buf[:-1] == 0xC3]) & (buf >= 0x80) & (buf <= 0x9E) & (buf != 0x97)
            buf[capital] += 32
            buf = np.where(_LETTER[buf], buf, 32).astype(np.uint8)
        self.starts, self.ends, self.rows = common.word_spans(buf, self.off)
        self.hash = common.word_hashes(buf, self.starts, self.ends)
        char = np.flatnonzero((buf & 0xC0) != 0x80)
        first = np.searchsorted(char, self.starts)
        cut = np.append(char, [len(buf)] * (STEM + 1))[first + STEM]
        self.long = cut < self.ends
        stem_end = np.minimum(cut, self.ends)
        inside = np.zeros(len(buf) + 1, np.int32)
        inside[self.starts] += 1
        np.subtract.at(inside, stem_end, 1)
        stems = np.where(np.cumsum(inside[:-1]) > 0, buf, 32).astype(np.uint8)
        self.stem = common.word_hashes(stems, self.starts, stem_end) ^ _STEM_SALT


def _lookup(h: np.ndarray, keys: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Index of each hash among the sorted keys, or -1."""
    out = np.full(len(h), -1, np.int64)
    if len(keys):
        at = np.flatnonzero(seen[h & np.uint64(len(seen) - 1)])
        i = np.minimum(np.searchsorted(keys, h[at]), len(keys) - 1)
        hit = keys[i] == h[at]
        out[at[hit]] = i[hit]
    return out


class Table:
    """Scores of tokens and stems, by hash."""

    def __init__(self, keys: np.ndarray, scores: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.scores = keys[order], scores[order]
        self.seen = np.zeros(1 << 20, bool)
        self.seen[self.keys & np.uint64((1 << 20) - 1)] = True

    def score(self, t: Tokens) -> np.ndarray:
        """Log-odds of every token: its own, else its stem's, else 0."""
        out = np.zeros(len(t.hash))
        i = _lookup(t.stem, self.keys, self.seen)
        some = (i >= 0) & t.long
        out[some] = self.scores[i[some]]
        i = _lookup(t.hash, self.keys, self.seen)
        out[i >= 0] = self.scores[i[i >= 0]]
        return out


def segments(scores: np.ndarray) -> list[tuple[float, int, int]]:
    """All maximal scoring segments (score, first, behind last), left to right, in linear time.

    Each candidate keeps the running sum before it (``left``) and at its end
    (``right``); a new positive score joins back to the last candidate with a
    smaller left sum, as long as that one ends lower than the new sum. Every
    candidate is chained to the last one before it with a smaller left sum, so
    a search never looks twice between the two; where none has a smaller left
    sum, all candidates held are final and are handed out.
    """
    total = np.cumsum(scores)
    done: list[tuple[float, float, int, int]] = []
    found: list[tuple[float, float, int, int]] = []
    chain: list[int] = []
    for i in np.flatnonzero(scores > 0).tolist():
        right = float(total[i])
        left, first, j = right - float(scores[i]), i, -1
        while found:
            j = len(found) - 1
            while j >= 0 and found[j][0] >= left:
                j = chain[j]
            if j < 0:
                done += found
                found, chain = [], []
            elif found[j][1] >= right:
                break
            else:
                left, first = found[j][0], found[j][2]
                del found[j:], chain[j:]
                j = -1
        found.append((left, right, first, i + 1))
        chain.append(j)
    return [(r - lo, a, z) for lo, r, a, z in done + found]


def _labelled(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """(text, toxic) of about ``sample`` labelled rows at most, drawn by hash,
    without copies."""
    y = labels.where(F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("_y"))
    n = y.count()
    keep = min(1.0, sample / max(n, 1))
    drawn = y.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(keep * (1 << 20)))
    # The drawn ids are bounded by the sample, so the corpus is not shuffled for them.
    drawn = common.saved(drawn)
    if drawn.count() <= 2 * sample:
        drawn = F.broadcast(drawn)
    rows = docs.join(drawn, "doc_id").select("doc_id", "text", F.col("_y").alias("toxic"))

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The least hash of a text's runs of ``COPY_WORDS`` words."""
        for b in common.chunks(batches, "text"):
            buf, off = common.text_buffer(b.column("text"))
            starts, ends, at = common.word_spans(buf, off)
            runs = common.mix(common.sequence_hashes(common.word_hashes(buf, starts, ends), COPY_WORDS))
            n = np.maximum(np.diff(at) - COPY_WORDS + 1, 0)
            out = np.zeros(b.num_rows, np.uint64)
            if n.any():
                mine = runs[common.spread(at[:-1], n)]
                out[n > 0] = np.minimum.reduceat(mine, (np.cumsum(n) - n)[n > 0])
            short = np.flatnonzero(n == 0)
            out[short] = [np.uint64(zlib.crc32(buf[off[i]:off[i + 1]].tobytes())) for i in short.tolist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out.view(np.int64))], names=[*b.schema.names, "least"])

    marked = rows.mapInArrow(least, "doc_id long, text string, toxic int, least long")
    return marked.groupBy("least", "toxic").agg(F.min_by("text", "doc_id").alias("text")).select("text", "toxic")


class Model:
    def __init__(self, table: Table, lam: float = 1.0, k: float = 1.0, slope: float = 0.0, shift: float = 0.0):
        self.table, self.lam, self.k, self.slope, self.shift = table, lam, k, slope, shift

    def chance(self, s: np.ndarray | float, n: float):
        """Expected number of segments of score ``s`` among n harmless tokens."""
        return self.k * max(n, 1) * np.exp(-self.lam * np.asarray(s))

    def judge(self, scores: np.ndarray) -> tuple[float, float, list[tuple[float, int, int]]]:
        """(evidence, best segment score, significant segments) of one text."""
        if not (scores > 0).any():
            return 0.0, 0.0, []
        all_of = segments(scores - DRIFT)
        if not all_of:
            return 0.0, 0.0, []
        s = np.array([x[0] for x in all_of])
        p = -np.expm1(-self.chance(s, len(scores)))
        evidence = -np.log(np.maximum(p, 1e-300))
        sure = p < MAX_CHANCE
        return float(evidence[sure].sum() if sure.any() else evidence.max()), float(s.max()), [
            x for x, ok in zip(all_of, sure.tolist(), strict=True) if ok]

    def probability(self, evidence: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * evidence + self.shift, -30, 30))))


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, max_table: int = MAX_TABLE) -> Model:
    """Fit the model to the labelled rows among ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    common.small_arrow_batches(spark)
    rows = common.saved(_labelled(docs, labels, sample))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Documents of each class that hold a token or stem."""
        for b in common.chunks(batches, "text"):
            t = Tokens(b.column("text"))
            y = b.column("toxic").to_numpy().astype(np.int64)
            doc = np.repeat(np.arange(b.num_rows), np.diff(t.rows))
            pair = np.rec.fromarrays([np.concatenate([t.hash, t.stem[t.long]]), np.concatenate([doc, doc[t.long]]),
                                      np.concatenate([np.where(t.long, t.stem, np.uint64(0)), np.zeros(t.long.sum(), np.uint64)])],
                                     names="h,d,s")
            order = np.lexsort((pair.d, pair.h))
            h, d, s = pair.h[order], pair.d[order], pair.s[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
            h, d, s = h[new], d[new], s[new]
            at = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
            n = np.diff(np.append(at, len(h)))
            tox = np.add.reduceat(y[d], at) if len(at) else n
            yield pa.RecordBatch.from_arrays([pa.array(h[at].view(np.int64)), pa.array(s[at].view(np.int64)), pa.array(n.astype(np.int64)),
                                              pa.array(tox.astype(np.int64))], names=["h", "stem", "n", "y"])

    n_docs, n_toxic = rows.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not 0 < n_toxic < n_docs:
        return Model(Table(np.zeros(0, np.uint64), np.zeros(0)))
    base = n_toxic / n_docs
    counted = rows.mapInArrow(count, "h long, stem long, n long, y long").groupBy("h").agg(
        F.max("stem").alias("stem"), F.sum("n").alias("n"), F.sum("y").alias("y"))
    counted = common.saved(counted)
    stems = counted.select(F.col("h").alias("stem"), F.col("n").alias("sn"), F.col("y").alias("sy"))
    share = (F.coalesce("sy", F.lit(0)) + PRIOR * base) / (F.coalesce("sn", F.lit(0)) + PRIOR)
    alpha, beta = F.col("y") + PRIOR * F.col("share"), F.col("n") - F.col("y") + PRIOR * (1 - F.col("share"))
    odds = float(np.log(base / (1 - base)))
    part = lambda k, p: F.when(k > 0, k * F.log(k / (F.col("n") * p))).otherwise(0.0)
    ratio = part(F.col("y"), base) + part(F.col("n") - F.col("y"), 1 - base)
    scored = (counted.join(stems, "stem", "left").withColumn("share", share)
              .withColumn("score", F.log(alpha / beta) - odds)
              .withColumn("z", F.sqrt(2 * F.greatest(ratio, F.lit(0.0)))))
    scored = scored.where(F.col("n") >= MIN_DOCS)
    least = float(np.sqrt(2 * np.log(max(scored.count(), 2))))
    best = scored.where(F.col("z") >= least).orderBy(F.col("z").desc(), "h").limit(max_table).select("h", "score")
    kept = best.collect()
    table = Table(np.array([r[0] for r in kept], np.int64).view(np.uint64), np.array([r[1] for r in kept], float))
    shared = spark.sparkContext.broadcast(table)

    def null(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rounded scores of harmless tokens, counted."""
        for b in common.chunks(batches, "text"):
            s = np.round(shared.value.score(Tokens(b.column("text"))) * 10).astype(np.int64)
            v, n = np.unique(s, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(v), pa.array(n.astype(np.int64))], names=["tenth", "n"])

    hist = dict(rows.where("toxic = 0").mapInArrow(null, "tenth long, n long").groupBy("tenth").agg(F.sum("n")).collect())
    value = np.array(sorted(hist), float) / 10 - DRIFT
    weight = np.array([hist[k] for k in sorted(hist)], float)
    top = float(table.scores.max(initial=1.0)) - DRIFT
    value, weight = np.append(value, top), np.append(weight, 1.0)  # one such token more than was seen
    weight /= weight.sum()
    lam = _root(value, weight)

    model = Model(table, lam)
    evidence = common.saved(_judged(rows, model, ["toxic"]))
    fit = evidence.where("toxic = 0").agg(F.count("*"), F.sum(F.greatest("n_tokens", F.lit(1)) * F.exp(-lam * F.col("best")))).first()
    model.k = float(fit[0] / fit[1]) if fit[0] else 1.0
    points = _judged(rows, model, ["toxic"]).select("toxic", F.round("evidence", 2).alias("x")).groupBy("x", "toxic").count().collect()
    model.slope, model.shift = _logistic(points)
    return model


def _root(value: np.ndarray, weight: np.ndarray) -> float:
    """Positive root of sum(weight * exp(lambda * value)) = 1."""
    if (weight * value).sum() >= 0 or value.max() <= 0:
        return 1.0
    lo, hi = 0.0, 1.0
    while (weight * np.exp(hi * value)).sum() < 1 and hi < 64:
        lo, hi = hi, hi * 2
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if (weight * np.exp(mid * value)).sum() < 1 else (lo, mid)
    return (lo + hi) / 2


def _logistic(points: list) -> tuple[float, float]:
    """Slope and shift of P(toxic | evidence), with smoothed targets."""
    x, y, n = (np.array([p[i] for p in points], float) for i in range(3))
    pos, neg = float(n[y == 1].sum()), float(n[y == 0].sum())
    target = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    x = np.minimum(x, 50)
    a, b = 0.5, float(np.log((pos + 1) / (neg + 1)))
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        w, g = n * np.maximum(p * (1 - p), 1e-9), n * (target - p)
        h = np.array([[(w * x * x).sum() + 1e-3, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-3]])
        step = np.linalg.solve(h, [(g * x).sum() - 1e-3 * a, g.sum()])
        a, b = a + float(np.clip(step[0], -1, 1)), b + float(np.clip(step[1], -2, 2))
        if np.abs(step).max() < 1e-8:
            break
    return a, b


def _judged(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text", passages: bool = False) -> DataFrame:
    """``keep`` columns, n_tokens, evidence, best, score (and the passages)."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    span = ", passages array<struct<first: int, last: int, score: double>>" if passages else ""
    schema = docs.select(*keep)
    ddl = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in schema.schema.fields]
                    + ["n_tokens long, evidence double, best double, score double" + span])
    source = docs.select(*keep, docs[text_col].alias("_tox_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in common.chunks(batches, "_tox_text"):
            t = Tokens(b.column("_tox_text"))
            s = m.table.score(t)
            n = np.diff(t.rows)
            some = np.add.reduceat(np.append(s > 0, False), t.rows[:-1]).astype(bool) & (n > 0) if b.num_rows else n > 0
            out = [m.judge(s[t.rows[i]:t.rows[i + 1]]) if some[i] else (0.0, 0.0, []) for i in range(b.num_rows)]
            cols = [pa.array(n.astype(np.int64)), pa.array([o[0] for o in out], pa.float64()), pa.array([o[1] for o in out], pa.float64()),
                    pa.array([m.probability(o[0]) for o in out], pa.float64())]
            names = ["n_tokens", "evidence", "best", "score"]
            if passages:
                base = t.rows[:-1]
                cols.append(pa.array([[{"first": int(t.starts[base[i] + a] - t.off[i]), "last": int(t.ends[base[i] + z - 1] - t.off[i]),
                                        "score": v} for v, a, z in o[2]] for i, o in enumerate(out)],
                                     pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("score", pa.float64())]))))
                names.append("passages")
            yield pa.RecordBatch.from_arrays([b.column(k) for k in keep] + cols, names=[*keep, *names])

    return source.mapInArrow(run, ddl)


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` without the text, with score and the significant passages as
    byte ranges of the text."""
    common.small_arrow_batches(docs.sparkSession)
    keep = [c for c in docs.columns if c not in (text_col, "n_tokens", "evidence", "best", "score", "passages")]
    return _judged(docs, model, keep, text_col, passages=True)


def held_out(id_col: str = "doc_id", folds: int = 3, fold: int = 1) -> Column:
    """Rows whose crc32(id as text) mod ``folds`` is ``fold``; null ids are not."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == fold, F.lit(False))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: held_out, score, predicted and the passages found."""
    docs = common.documents(spark, sf_dir).select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic").where(~held_out())
    model = learn(docs.where(~held_out()), labels)
    scored = score(docs.withColumn("held_out", held_out()), model)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
                         F.size("passages").cast("long").alias("n_passages"))


QUERIES = {"op2_toxicity": op2_toxicity}
ORACLE: dict[str, str] = {}
