"""Language identification by prediction by partial matching.

Every language has a byte context tree of orders 0 to ``ORDER``: how often
each byte followed each context in its training texts. Coding a byte starts at
the longest context known; an unseen byte is announced by an escape (method C:
as probable as the number of distinct bytes seen there) and coded one order
lower with the bytes already ruled out excluded; below order 0 all bytes are
equally likely. Statistics are frozen after training, so the code length of a
byte depends on its context alone: it is worked out once for every context of
the tree and looked up for every byte of every text. A text goes to the
language with the shortest exact code; the score is that language's share of
probability under equal priors.

The trees are learned from about ``SAMPLE`` different texts per language at
most (whole texts, drawn by hash, each learned once however often it stands; a
documented bound for the classifier), which bounds the tables that are
broadcast. The text with the smallest hash is always drawn, so that every
language with a text is learned. All texts are scored whole.

``und``: null texts and texts without a letter (score 0), and every text if no
language is known. Equal code lengths go to the smaller language name. Null
ids are learned from; copies of a text count once. Learned values of ``lang``
are returned as they are.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseframe.llm import common

ORDER = 3
SAMPLE = 1500
#: Languages in one model at most (training fails loudly beyond).
MAX_LANGUAGES = 1000
_LETTER = regex.compile(r"\p{L}")


def _grams(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The ``ORDER`` bytes before each byte and the byte itself, packed;
    positions before a text's start count as byte 0."""
    code = np.zeros(len(buf), np.uint64)
    at = np.arange(len(buf)) - np.repeat(off[:-1], np.diff(off))
    for back in range(ORDER, -1, -1):
        b = np.zeros(len(buf), np.uint64)
        b[back:] = buf[:len(buf) - back]
        b[at < back] = 0
        code = code << np.uint64(8) | b
    return code


class Trees:
    """Code lengths (bits) of bytes after contexts, for every language."""

    def __init__(self, langs: list[str], counts: list[tuple[np.ndarray, np.ndarray]]):
        self.langs = langs
        used = np.unique(np.concatenate([c & np.uint64(255) for c, _ in counts]
                                        + [c >> np.uint64(8 * k) & np.uint64(255) for c, _ in counts for k in range(1, ORDER + 1)]
                                        + [np.zeros(1, np.uint64)])).astype(np.int64)
        #: Bytes never seen in training share one class, the last.
        self.n = len(used) + 1
        self.byte = np.full(256, self.n - 1, np.int64)
        self.byte[used] = np.arange(len(used))
        novel = 256 - len(used)
        contexts = np.unique(np.concatenate([self._pack(c >> np.uint64(8)) for c, _ in counts]))
        #: Index of a full context, by its packed classes; contexts that no
        #: language has seen are looked up at their longest known suffix.
        self.levels = [np.unique(contexts % self.n ** k) for k in range(ORDER + 1)]
        self.cost = [self._costs(i, counts, novel) for i in range(len(langs))]

    def _pack(self, context: np.ndarray, length: int = ORDER) -> np.ndarray:
        out = np.zeros(len(context), np.int64)
        for k in range(length - 1, -1, -1):
            out = out * self.n + self.byte[(context >> np.uint64(8 * k) & np.uint64(255)).astype(np.int64)]
        return out

    def _costs(self, i: int, counts: list, novel: int) -> list[np.ndarray]:
        """Per order: bits of every byte class after every known context."""
        code, times = counts[i]
        symbol, context = self.byte[(code & np.uint64(255)).astype(np.int64)], self._pack(code >> np.uint64(8))
        # Order -1: the bytes not excluded are equally likely.
        each = np.ones(self.n)
        each[-1] = max(novel, 1)
        lower_p, lower_seen = None, None
        out = []
        for k, level in enumerate(self.levels):
            seen = np.zeros((len(level), self.n))
            at = np.searchsorted(level, context % self.n ** k)
            np.add.at(seen, (at, symbol), times)
            if k == 0:
                below_n, below_p = np.zeros((1, self.n)), each[None] / 1.0
                kind = "uniform"
            else:
                parent = np.searchsorted(self.levels[k - 1], level % self.n ** (k - 1))
                below_n, below_p = lower_seen[parent], lower_p[parent]
                kind = "tree"
            p = np.zeros_like(seen)
            total, distinct = seen.sum(1, keepdims=True), (seen > 0).sum(1, keepdims=True)
            known = seen > 0
            any_seen = total[:, 0] > 0
            with np.errstate(divide="ignore", invalid="ignore"):
                own = np.where(known, seen / (total + distinct), 0)
                rest = np.where(known, 0, below_p) if kind == "tree" else np.where(known, 0, np.broadcast_to(each, seen.shape))
                mass = rest.sum(1, keepdims=True)
                escape = distinct / (total + distinct)
                # Exclusion: what escapes is shared among the bytes not seen here.
                p = np.where(known, own, escape * rest / mass)
            p[~any_seen] = (below_p if kind == "tree" else np.broadcast_to(each / each.sum(), seen.shape))[~any_seen]
            full = mass[:, 0] <= 0
            if full.any():
                p[full] = own[full] * ((total + distinct) / total)[full]
            lower_p, lower_seen = p, seen
            bits = -np.log2(np.maximum(p, 1e-300))
            bits[:, -1] += np.log2(max(novel, 1))  # one byte of the shared class
            out.append(bits.astype(np.float32))
        return out

    def bits(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Code length of every text in every language (texts x languages)."""
        n_texts = len(off) - 1
        out = np.zeros((n_texts, len(self.langs)))
        if not len(buf):
            return out
        cls = self.byte[buf]
        at = np.arange(len(buf)) - np.repeat(off[:-1], np.diff(off))
        zero = self.byte[0]
        context = np.zeros(len(buf), np.int64)
        for back in range(ORDER, 0, -1):
            b = np.full(len(buf), zero)
            b[back:] = cls[:-back] if back < len(buf) else b[back:]
            b[at < back] = zero
            context = context * self.n + b
        some = np.flatnonzero(np.diff(off))
        left = np.arange(len(buf))
        cost = np.zeros(len(buf), np.float32)
        where: list[tuple[int, np.ndarray, np.ndarray]] = []
        for k in range(ORDER, -1, -1):  # the longest known suffix of each context
            level, c = self.levels[k], context[left] % self.n ** k
            i = np.minimum(np.searchsorted(level, c), len(level) - 1)
            hit = level[i] == c
            where.append((k, left[hit], i[hit]))
            left = left[~hit]
        for j in range(len(self.langs)):
            for k, rows, i in where:
                cost[rows] = self.cost[j][k][i, cls[rows]]
            out[some, j] = np.add.reduceat(cost, off[:-1][some], dtype=np.float64)
        return out


def learn(docs: DataFrame, sample: int = SAMPLE) -> tuple[list[str], list[tuple[np.ndarray, np.ndarray]]]:
    """Languages and their n-gram counts, from (text, lang) rows."""
    spark = docs.sparkSession
    common.small_arrow_batches(spark)
    docs = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang")
    space = 1 << 30
    docs = docs.withColumn("_h", F.xxhash64("text"))
    place = F.pmod("_h", F.lit(space))
    # Different texts: copies are combined before anything moves.
    per = (docs.select("lang", "_h").distinct().groupBy("lang").agg(F.count("*").alias("n"), F.min(place).alias("first"))
           .orderBy("lang").limit(MAX_LANGUAGES + 1).collect())
    if len(per) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not per:
        return [], []
    rate = F.create_map(*[F.lit(x) for lang, n, first in per for x in (lang, max(first + 1, min(space, -(-space * sample // n))))])
    drawn = docs.where(place < rate[F.col("lang")]).groupBy("lang", "_h").agg(F.min("text").alias("text")).select("text", "lang")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.chunks(batches, "text", 4 << 20):
            lang = np.array(b.column("lang").to_pylist(), object)
            for name in sorted(set(lang)):
                buf, off = common.text_buffer(b.column("text").take(pa.array(np.flatnonzero(lang == name))))
                v, n = np.unique(_grams(buf, off), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(v), pa.string()), pa.array(v.view(np.int64)),
                                                  pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])

    grams = common.saved(drawn.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    langs, counts = [], []
    for lang, *_ in per:
        got = grams.where(F.col("lang") == lang).select("gram", "n").toArrow()
        if got.num_rows:
            langs.append(lang)
            counts.append((got.column("gram").to_numpy().view(np.uint64), got.column("n").to_numpy().astype(np.float64)))
    return langs, counts


_TREES: dict[str, Trees] = {}


def predict(docs: DataFrame, model: tuple[list[str], list], text_col: str = "text", keep: tuple[str, ...] | None = None) -> DataFrame:
    """``keep`` columns (default all but the text), lang_pred, score and bits
    per byte."""
    spark = docs.sparkSession
    common.small_arrow_batches(spark)
    keep = tuple(c for c in docs.columns if c not in (text_col, "lang_pred", "score", "bits_per_byte")) if keep is None else keep
    shared = spark.sparkContext.broadcast(model)
    ident = uuid.uuid4().hex
    ddl = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema.fields]
                    + ["lang_pred string, score double, bits_per_byte double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, counts = shared.value
        trees = None
        for b in common.chunks(batches, "_lid_text", 1 << 20):
            if langs and trees is None:
                if ident not in _TREES:
                    _TREES.clear()
                    _TREES[ident] = Trees(langs, counts)
                trees = _TREES[ident]
            buf, off = common.text_buffer(b.column("_lid_text"))
            lettered = np.array([bool(t) and _LETTER.search(t) is not None for t in b.column("_lid_text").to_pylist()], bool)
            pred, score, bpb = np.full(b.num_rows, "und", object), np.zeros(b.num_rows), np.zeros(b.num_rows)
            if trees is not None:
                bits = trees.bits(buf, off)
                best = bits.argmin(1)
                low = bits[np.arange(b.num_rows), best]
                share = 1 / np.exp2(np.maximum(low[:, None] - bits, -1000)).sum(1)
                pred[lettered] = np.array(langs, object)[best[lettered]]
                score[lettered] = share[lettered]
                bpb[lettered] = (low / np.maximum(np.diff(off), 1))[lettered]
            yield pa.RecordBatch.from_arrays([b.column(k) for k in keep] + [pa.array(pred, pa.string()), pa.array(score), pa.array(bpb)],
                                             names=[*keep, "lang_pred", "score", "bits_per_byte"])

    return docs.select(*keep, docs[text_col].alias("_lid_text")).mapInArrow(run, ddl)


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: held_out, the predicted language and its score."""
    docs = common.documents(spark, sf_dir)
    model = learn(docs.where(~held_out()).select("text", "lang"))
    d = docs.select("doc_id", held_out().alias("held_out"), "text")
    return predict(d, model).select("doc_id", "held_out", "lang_pred", "score")


QUERIES = {"op6_langid": op6_langid}
ORACLE: dict[str, str] = {}
