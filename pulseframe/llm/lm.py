"""N-gram language model scoring over an Elias-Fano trie in shards.

Tokens are words with A-Z lower-cased, and one end per text. The model is an
interpolated n-gram model (``order``) with absolute discounting over add-half
unigrams. With a context u of one word, or more (two for order 3):

    P(w | u) = (c(uw) - D) / c(u) + left(u) * P'(w)

where P' is the model of the context one word shorter (P1, the base model, under
one word), c(uw) counts if it is ``min_count`` or more, and left(u) is the mass
that the children of u leave, so that every context's probabilities sum to one.
A context never seen leaves all to P'. A context of several words lies within
the text, except for the start as its first; a text's first token has the start
alone. op9_lm has order ``ORDER`` and keeps all counts.

The corpus is read once into packed chunks (compressed texts, stored). Each
chunk asks once for all its levels, as one trie: its distinct words, under each
word the words that follow it, under each of these pairs the words that follow
the pair, and so on, with their counts in its training texts. A longer context
is the node of the shorter one's child, so it has no name of its own in a
request, and its count is the child's. A request travels packed to the shard of
its first word's hash, with everything under it. The shard adds the counts up
and builds its part of the trie: per level, pointers lead from the nodes to their
children, which are held as 40-bit fingerprints relative to their node and are
the nodes of the next level; words, pointers and children are monotone
Elias-Fano sequences, with the smoothed counts quantised to one byte by a
codebook. The levels are written to files, memory-mapped and queried by
successor search; answers travel back to their chunk, which works out the
probabilities of its texts. Nothing is broadcast but the hot contexts: those
with more than 1 / ``HOT_SHARE`` of all tokens, a bounded number per level,
whose children are dealt singly, under the context's 64-bit hash, so that no
shard gathers them.

Words are told apart by 64-bit hashes and children by 40 bits within their
context. Counts cover all training texts, whole. Null texts are empty: one end
token. Rows are scored one by one, repeated ones too. Without training texts
every token has P1 = 1. An empty table gives an empty result.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseframe.llm import common, eliasfano
from pulseframe.session import ensure_checkpoint_dir

#: Order and least count of ``score`` unless given, and the order of op9_lm.
LOWEST_ORDER = 2
MIN_COUNT = 2
ORDER = 3
DISCOUNT = 0.75
#: Counts up to this one are never rounded by the codebook.
EXACT_COUNTS = 128
HOT_SHARE = 1 << 13
CHUNK_BYTES = 8 << 20
SHARD_BYTES = 8 << 20
REQUEST_ROWS = 32
END = np.uint64(0xE17B3A5D9C20F461)
START = np.uint64(0x51A97C03D8E2B64F)
_CHILD = 40
_FEW = 1 << 16
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _zip(*arrays: np.ndarray) -> bytes:
    """Arrays, one after the other, each compressed."""
    squeeze = zstandard.ZstdCompressor(level=3).compress
    parts = [squeeze(np.ascontiguousarray(a).tobytes()) for a in arrays]
    return np.array([len(p) for p in parts], np.int64).tobytes() + b"".join(parts)


def _unzip(blob: bytes, *kinds: type) -> list[np.ndarray]:
    sizes = np.frombuffer(blob, np.int64, len(kinds)).tolist()
    at, out, un = 8 * len(kinds), [], zstandard.ZstdDecompressor().decompress
    for size, kind in zip(sizes, kinds, strict=True):
        out.append(np.frombuffer(un(blob[at:at + size]), kind))
        at += size
    return out


def _stored(df: DataFrame) -> DataFrame:
    """Write a table to the shared checkpoint folder and read it. The shuffle
    files behind it are of no more use and go at the end of the write."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/lm-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "none").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def _contexts(token: np.ndarray, n_tokens: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the tokens with ``length`` tokens before them (the start of
    their text is one), and the hash of those; ``token`` holds word hashes."""
    first = np.cumsum(n_tokens) - n_tokens
    before = np.arange(len(token)) - np.repeat(first, n_tokens) + 1
    at = np.flatnonzero(before >= length)
    out = np.zeros(len(at), np.uint64)
    for back in range(length, 0, -1):
        inside = before[at] > back
        word = np.where(inside, token[np.maximum(at - back, 0)], START)
        out = word if length == 1 else common.mix(out * np.uint64(0x9E3779B97F4A7C15) + word)
    return at, out


def _planes(a: np.ndarray, kind: type = np.uint32) -> np.ndarray:
    """The bytes of integers, those of one significance together."""
    return np.ascontiguousarray(a, kind).view(np.uint8).reshape(len(a), np.dtype(kind).itemsize).T.copy()


def _whole(planes: np.ndarray, kind: type = np.uint32, width: int | None = None) -> np.ndarray:
    """Integers of their byte planes (``width`` of them, the others are zero)."""
    size = np.dtype(kind).itemsize
    width = width or size
    raw = np.zeros((len(planes) // width, size), np.uint8)
    raw[:, :width] = planes.reshape(width, -1).T
    return raw.view(kind).ravel()


def _among(x: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Whether each value is in a sorted array."""
    if not len(ordered):
        return np.zeros(len(x), bool)
    return ordered[np.minimum(np.searchsorted(ordered, x), len(ordered) - 1)] == x


class Nodes:
    """Contexts of one length in a chunk: their names (64-bit hashes), shards
    and places in the chunk's requests."""

    def __init__(self, name: np.ndarray, shard: np.ndarray, order: np.ndarray, n_shards: int):
        self.name, self.shard, self.order = name, shard, order
        self.rank = np.empty(len(order), np.int64)
        self.rank[order] = np.arange(len(order))
        self.at = np.searchsorted(shard[order], np.arange(n_shards + 1))

    def own(self, s: int) -> np.ndarray:
        return self.order[self.at[s]:self.at[s + 1]]


class Level:
    """The nodes of one length and their children in a chunk; the children are
    the nodes of the next level."""

    def __init__(self, nodes: Nodes, context: np.ndarray, token: np.ndarray, prints: np.ndarray, learned: np.ndarray, hot: np.ndarray,
                 n_shards: int):
        """Per token its context (a node) and its word, whose fingerprint is in ``prints``."""
        self.nodes, self.context = nodes, context
        pair, self.pair_of = np.unique(context.astype(np.int64) * len(prints) + token, return_inverse=True)
        self.pair_of = self.pair_of.astype(np.int32)
        self.pair_u = pair // len(prints)
        self.pair_w = (pair % len(prints)).astype(np.int32)
        self.pair_n = np.bincount(self.pair_of[learned], minlength=len(pair))
        del pair
        self.hot = _among(nodes.name, hot)
        self.dealt = self.hot[self.pair_u]
        self.shard = nodes.shard[self.pair_u]
        some = np.flatnonzero(self.dealt)
        spread = common.mix(nodes.name[self.pair_u[some]] ^ common.mix(prints[self.pair_w[some]])) % np.uint64(n_shards)
        self.shard[some] = spread.astype(np.int64)
        # By shard, children of the shard's own nodes first, in their order;
        # then dealt ones by node. Both lists ascend by shard and are merged.
        under = np.bincount(self.pair_u, minlength=len(nodes.name))
        whole = nodes.order[~self.hot[nodes.order]]
        own = common.spread((np.cumsum(under) - under)[whole], under[whole])
        both = np.concatenate([own, some[np.argsort(self.shard[some], kind="stable")]])
        self.order = both[np.argsort(self.shard[both], kind="stable")]
        self.at = np.searchsorted(self.shard[self.order], np.arange(n_shards + 1))

    def pairs(self, s: int) -> np.ndarray:
        return self.order[self.at[s]:self.at[s + 1]]

    def request(self, s: int, children: np.ndarray) -> list[np.ndarray]:
        """Names of hot nodes with dealt children here; children under each own
        node and each of these; the ``children`` (numbers within the request)
        and their counts."""
        p = self.pairs(s)
        u, dealt = self.pair_u[p], self.dealt[p]
        more = np.unique(u[dealt])
        lo, hi = self.nodes.at[s], self.nodes.at[s + 1]
        under = np.concatenate([np.bincount(self.nodes.rank[u[~dealt]] - lo, minlength=hi - lo),
                                np.bincount(np.searchsorted(more, u[dealt]), minlength=len(more))])
        return [self.nodes.name[more], _planes(under), _planes(children), _planes(self.pair_n[p])]


class Chunk:
    """Tokens of a chunk, its distinct words and the levels of the model."""

    def __init__(self, texts: pa.Array, train: np.ndarray, hot: list[np.ndarray], n_shards: int, order: int):
        token, self.n_tokens = _tokens(texts)
        learned = np.repeat(train, self.n_tokens)
        word, inv = np.unique(np.append(token, START), return_inverse=True)
        prints = common.mix(word) >> np.uint64(64 - _CHILD)
        by = np.argsort(prints, kind="stable")  # children of a node then ascend
        rank = np.empty(len(by), np.int64)
        rank[by] = np.arange(len(by))
        self.word, self.prints, inv = word[by], prints[by], rank[inv]
        self.token, start = inv[:-1].astype(np.int32), inv[-1]
        self.word_n = np.bincount(self.token[learned], minlength=len(self.word))
        self.word_n[start] = int(train.sum())
        self.n_shards, self.levels = n_shards, []
        shard = (common.mix(self.word ^ np.uint64(0xA5)) % np.uint64(n_shards)).astype(np.int64)
        nodes = Nodes(self.word, shard, np.argsort(shard, kind="stable"), n_shards)
        before, level = None, None
        for length in range(1, order):
            at, name = _contexts(token, self.n_tokens, length)
            if level is None:
                first = np.cumsum(self.n_tokens) - self.n_tokens
                context = np.concatenate([[start], self.token])[:-1].astype(np.int32)
                context[first] = start
            else:
                # The context of a token is the child that the token before it is.
                context = level.pair_of[np.searchsorted(before, at - 1)]
                names = np.zeros(len(level.pair_u), np.uint64)
                names[context] = name
                nodes = Nodes(names, level.shard, level.order, n_shards)
            level = Level(nodes, context, self.token[at], self.prints, learned[at], hot[length - 1], n_shards)
            self.levels.append((at, level))
            before = at

    def requests(self) -> Iterator[tuple[int, bytes]]:
        for s in range(self.n_shards):
            w = self.levels[0][1].nodes.own(s)
            below = [level.pair_w[level.pairs(s)] for _, level in self.levels]
            # A child's fingerprint travels once, however many nodes it is under.
            child, index = np.unique(np.concatenate(below), return_inverse=True)
            if len(w) or len(child):
                index = np.split(index, np.cumsum([len(c) for c in below])[:-1])
                yield s, _zip(self.word[w], _planes(self.word_n[w]),
                              _planes(np.diff(self.prints[child], prepend=np.uint64(0)), np.uint64)[:_CHILD // 8],
                              *(a for (_, level), c in zip(self.levels, index, strict=True) for a in level.request(s, c)))


class Trie:
    """One level of a shard's trie in a memory-mapped file."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, parent: np.ndarray, child: np.ndarray, seen: np.ndarray):
        """Nodes with their exact ``counts`` (on the first level the sorted
        ``words`` stand for the first of them); kept pairs sorted by (parent
        node, child), with their counts ``seen``."""
        few = np.minimum(seen, _FEW)
        kinds = np.flatnonzero(np.bincount(few, minlength=_FEW + 1)[:_FEW])
        many = np.flatnonzero(few == _FEW)
        kinds = np.concatenate([kinds, np.unique(seen[many])])
        distinct = np.log10(kinds - DISCOUNT)
        # Small counts have entries of their own, larger ones share bins of equal
        # logarithmic width; each bin stands for its least value, so no context
        # gives away more than it has.
        book = distinct
        if len(distinct) > 255:
            exact, wide = np.split(distinct, [np.searchsorted(distinct, np.log10(EXACT_COUNTS - DISCOUNT), "right")])
            edges = np.linspace(wide[0], wide[-1], 255 - len(exact))
            book = np.concatenate([exact, wide[np.unique(np.searchsorted(wide, edges))]])
        self.book = np.concatenate([[-np.inf], book])
        # Codes by count: a table for counts below ``_FEW``, a search for the others.
        codes = np.searchsorted(book, distinct, "right").astype(np.uint8)
        by_count = np.zeros(_FEW + 1, np.uint8)
        by_count[kinds[kinds < _FEW]] = codes[kinds < _FEW]
        code = by_count[few]
        code[many] = codes[np.searchsorted(kinds, seen[many])]
        pointer = np.concatenate([[0], np.cumsum(np.bincount(parent, minlength=len(counts)))]).astype(np.uint64)
        bits = _CHILD + max(1, int(len(counts)).bit_length())
        parts = {"w_" + k: a for k, a in eliasfano.encode(words, 64).items()}
        parts |= {"p_" + k: a for k, a in eliasfano.encode(pointer, max(1, int(len(parent)).bit_length())).items()}
        parts |= {"c_" + k: a for k, a in eliasfano.encode(parent.astype(np.uint64) << np.uint64(_CHILD) | child, bits).items()}
        parts |= {"counts": counts.astype(np.int64), "code": code}
        with tempfile.TemporaryFile() as f:  # unlinked at once: nothing stays behind
            place = {}
            for k, a in parts.items():
                f.seek(-(-f.tell() // 8) * 8)
                place[k] = (f.tell(), a.dtype, len(a))
                f.write(a.tobytes())
            f.flush()
            size = f.seek(0, 2)
            whole = np.memmap(f, np.uint8, "r", shape=(max(size, 1),))
        at = {k: np.frombuffer(whole, d, n, o) for k, (o, d, n) in place.items()}
        self.words, self.pointer, self.child = (eliasfano.Sequence({k[2:]: a for k, a in at.items() if k.startswith(x)}) for x in ("w_", "p_", "c_"))
        self.counts, self.code = at["counts"], at["code"]
        self.upto = np.concatenate([[0.0], np.cumsum((10 ** self.book)[self.code])])

    def _hits(self, seq: eliasfano.Sequence, x: np.ndarray, step: int = 1 << 19) -> np.ndarray:
        """Index of each value, or -1."""
        out = np.full(len(x), -1)
        for lo in range(0, len(x), step):
            out[lo:lo + step] = seq.find(x[lo:lo + step])
        return out

    def node(self, words: np.ndarray) -> np.ndarray:
        return self._hits(self.words, words)

    def count(self, node: np.ndarray) -> np.ndarray:
        return np.where(node >= 0, self.counts[np.maximum(node, 0)], 0) if len(self.counts) else np.zeros(len(node), np.int64)

    def given(self, node: np.ndarray) -> np.ndarray:
        """Sum of the smoothed counts of each context's children."""
        out = np.zeros(len(node))
        some = np.flatnonzero(node >= 0)
        lo, hi = self.pointer.access(node[some]).astype(np.int64), self.pointer.access(node[some] + 1).astype(np.int64)
        out[some] = self.upto[hi] - self.upto[lo]
        return out

    def find(self, node: np.ndarray, child: np.ndarray) -> np.ndarray:
        """Number of each pair (-1: not in the trie), searched relative to its
        context; it is the pair's node on the next level."""
        out = np.full(len(node), -1)
        some = np.flatnonzero(node >= 0)
        out[some] = self._hits(self.child, node[some].astype(np.uint64) << np.uint64(_CHILD) | child[some])
        return out

    def code_of(self, pair: np.ndarray) -> np.ndarray:
        """Codebook entry of each pair's number (0: not in the trie)."""
        return np.where(pair >= 0, self.code[np.maximum(pair, 0)], 0).astype(np.uint8) if len(self.code) else np.zeros(len(pair), np.uint8)

    def codes(self, node: np.ndarray, child: np.ndarray) -> np.ndarray:
        return self.code_of(self.find(node, child))


def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts, an end after each, and their number per text."""
    buf, off = common.text_buffer(texts)
    buf = common.lower_ascii(buf)
    starts, ends, rows = common.word_spans(buf, off)
    n = np.diff(rows)
    token = np.full(len(starts) + len(n), END)
    token[np.arange(len(starts)) + np.repeat(np.arange(len(n)), n)] = common.word_hashes(buf, starts, ends)
    return token, n + 1


def _hot_contexts(docs: DataFrame, order: int) -> list[np.ndarray]:
    """Per length, the hashes of the contexts above the share, sorted (the
    start is one of them)."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.chunks(batches, "text"):
            token, n_tokens = _tokens(b.column("text"))
            lengths, values, counts = [0], [None], [len(token)]
            for length in range(1, order):
                value, n = np.unique(_contexts(token, n_tokens, length)[1], return_counts=True)
                often = n >= max(2, len(token) // (2 * HOT_SHARE))
                values += value[often].view(np.int64).tolist()
                counts += n[often].tolist()
                lengths += [length] * int(often.sum())
            yield pa.RecordBatch.from_arrays([pa.array(lengths, pa.int32()), pa.array(values, pa.int64()), pa.array(counts, pa.int64())],
                                             names=["length", "word", "n"])

    counted = common.saved(docs.select("text").mapInArrow(count, "length int, word long, n long").groupBy("length", "word").agg(F.sum("n").alias("n")))
    total = counted.where("length = 0").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    # At most 2 * HOT_SHARE contexts of a length can have such a share.
    hot = counted.where((F.col("length") > 0) & (F.col("n") * 2 * HOT_SHARE > total)).select("length", "word").collect()
    found = [np.array([r.word for r in hot if r.length == length], np.int64).view(np.uint64) for length in range(1, order)]
    return [np.unique(np.append(h, START)) for h in found]


def _answers(held: list[tuple[int, bytes]], order: int, min_count: int) -> pa.RecordBatch:
    """Build a shard's part of the trie from its (chunk, request) and answer them."""
    got = [_unzip(r, np.uint64, np.uint8, np.uint8, *[np.uint64, np.uint8, np.uint8, np.uint8] * (order - 1)) for _, r in held]
    words, inv = np.unique(np.concatenate([g[0] for g in got]), return_inverse=True)
    counts = np.zeros(len(words), np.int64)
    np.add.at(counts, inv, np.concatenate([_whole(g[1]) for g in got]))
    prints = [np.cumsum(_whole(g[2], np.uint64, _CHILD // 8), dtype=np.uint64) for g in got]
    tokens = words != START
    rows: list[tuple] = [(None, None, None, None, None, int(counts[tokens].sum()), int((counts[tokens] > 0).sum()))]
    own = np.split(inv, np.cumsum([len(g[0]) for g in got])[:-1])
    answer: list[list[np.ndarray]] = [[] for _ in got]
    for i in range(order - 1):
        part = [g[3 + 4 * i:7 + 4 * i] for g in got]
        # Hot nodes whose children are dealt stand behind the shard's own.
        names, more = np.unique(np.concatenate([p[0] for p in part]), return_inverse=True)
        dealt = np.split(len(counts) + more, np.cumsum([len(p[0]) for p in part])[:-1])
        number = [_whole(p[1]).astype(np.int64) for p in part]
        node = [np.repeat(np.concatenate([o, d]), n) for o, d, n in zip(own, dealt, number, strict=True)]
        child = [f[_whole(p[2])] for f, p in zip(prints, part, strict=True)]
        # What stands under a pair seen less than min_count is seen less as well.
        at = np.concatenate(node)
        under = np.flatnonzero(at >= 0)
        key = at[under].astype(np.uint64) << np.uint64(_CHILD) | np.concatenate(child)[under]
        by = np.argsort(key)
        key = key[by]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        n = np.concatenate([_whole(p[3]) for p in part]).astype(np.int64)[under][by]
        seen = np.add.reduceat(n, first) if len(first) else np.zeros(0, np.int64)
        kept = seen >= min_count
        key, seen = key[first][kept], seen[kept]
        del at, under, by, first, n
        trie = Trie(words, np.concatenate([counts, np.zeros(len(names), np.int64)]), (key >> np.uint64(_CHILD)).astype(np.int64),
                    key & np.uint64((1 << _CHILD) - 1), seen)
        given = trie.given(np.arange(len(counts) + len(names)))
        # The last one is for nodes that are not in the trie.
        sums, of_node = np.unique(np.append(given, 0.0), return_inverse=True)
        given = given[len(counts):]
        rows += [(i, None, None, h, g, None, None) for h, g in zip(names.view(np.int64).tolist(), given.tolist(), strict=True)]
        for k, (o, u, w) in enumerate(zip(own, node, child, strict=True)):
            pair = trie.find(u, w)
            value, which = np.unique(of_node[o], return_inverse=True)
            value = sums[value]
            exact = trie.count(o)
            if i:  # the codebook of the level above holds small counts exactly
                exact = np.where(exact > EXACT_COUNTS, exact, 0)
            answer[k] += [_planes(exact, np.int64), value, _planes(which), trie.code_of(pair), trie.book]
            own[k] = pair
        words, counts = np.zeros(0, np.uint64), seen
    rows += [(None, chunk, _zip(*a), None, None, None, None) for (chunk, _), a in zip(held, answer, strict=True)]
    types = {"level": pa.int32(), "chunk": pa.int64(), "answer": pa.binary(), "hot": pa.int64(), "given": pa.float64(), "n": pa.int64(),
             "v": pa.int64()}
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types.values(), strict=True)],
                                      names=list(types))


def score(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", min_count: int = MIN_COUNT,
          order: int = LOWEST_ORDER) -> DataFrame:
    """Per row: doc_id, trained (bool), n_tokens, n_known, train_tokens,
    base_score and score, learned from the rows where ``train`` holds."""
    if order < LOWEST_ORDER:
        raise ValueError(f"order {order} is below {LOWEST_ORDER}")
    spark = docs.sparkSession
    common.small_arrow_batches(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(train, F.lit(False)).alias("train"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n_shards = max(common.parts(spark), common.text_bytes(docs) // SHARD_BYTES + 1)
    hot = spark.sparkContext.broadcast(_hot_contexts(docs, order))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId(), 0
        held: list[pa.RecordBatch] = []

        def out() -> pa.RecordBatch:
            nonlocal number
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema) as w:
                for b in held:
                    w.write_batch(b)
            blob = zstandard.ZstdCompressor(level=3).compress(sink.getvalue().to_pybytes())
            number += 1
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([task << 32 | number - 1], pa.int64()), pa.array([blob], pa.binary())], names=["chunk", "docs"])

        size = 0
        for b in common.chunks(batches, "text", 1 << 20):
            held.append(b)
            size += b.nbytes
            if size >= CHUNK_BYTES:
                yield out()
                size = 0
        if held:
            yield out()

    def read(blob: bytes) -> pa.Table:
        return pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(blob)).read_all().combine_chunks()

    def chunk_of(t: pa.Table, n: int) -> Chunk:
        return Chunk(t.column("text").combine_chunks(), t.column("train").combine_chunks().to_numpy(zero_copy_only=False), hot.value, n, order)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, blob in zip(b.column("chunk").to_pylist(), b.column("docs"), strict=True):
                shard, request = zip(*chunk_of(read(blob.as_py()), n_shards).requests(), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), pa.array([key] * len(shard), pa.int64()),
                                                  pa.array(request, pa.binary())], names=["shard", "chunk", "request"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(shard: int, held: list) -> pa.RecordBatch:
            b = _answers(held, order, min_count)
            return pa.RecordBatch.from_arrays([pa.array([shard] * b.num_rows, pa.int32()), *b.columns], names=["shard", *b.schema.names])

        now, held = None, []
        for b in batches:
            for s, c, r in zip(b.column("shard").to_pylist(), b.column("chunk").to_pylist(), b.column("request").to_pylist(), strict=True):
                if s != now and held:
                    yield out(now, held)
                    held = []
                now = s
                held.append((c, r))
        if held:
            yield out(now, held)

    chunks = _stored(docs.mapInArrow(pack, "chunk long, docs binary"))
    asked = chunks.mapInArrow(ask, "shard int, chunk long, request binary")
    # The answers are named by shard and chunk, so each finds its place again.
    met = asked.repartition(common.parts(spark), "shard").sortWithinPartitions("shard")
    # A request is large: few of them make a batch.
    common.small_arrow_batches(spark, REQUEST_ROWS)
    replies = _stored(met.mapInArrow(meet, "shard int, level int, chunk long, answer binary, hot long, given double, n long, v long"))
    common.small_arrow_batches(spark)
    n_train, v = replies.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    hot_given = replies.where("hot IS NOT NULL").groupBy("level", "hot").agg(F.sum("given").alias("given")).orderBy("level", "hot").collect()
    hot_table = []
    for i in range(order - 1):
        some = sorted((r.hot % 2**64, r.given) for r in hot_given if r.level == i)
        hot_table.append((np.array([h for h, _ in some], np.uint64), np.array([g for _, g in some], float)))
    hot_table = spark.sparkContext.broadcast(hot_table)
    den = n_train + 0.5 * (v + 1)

    def work(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        reply = {s: _unzip(a, *[np.uint8, np.float64, np.uint8, np.uint8, np.float64] * (order - 1)) for s, a in zip(right["shard"], right["answer"], strict=True)}
        for blob in left["docs"]:
            t = read(blob)
            c = chunk_of(t, n_shards)
            value = np.zeros(0)
            for i, (at, level) in enumerate(c.levels):
                count, given = np.zeros(len(level.nodes.name), np.int64), np.zeros(len(level.nodes.name))
                above, value = value, np.full(len(level.pair_u), -np.inf)
                for s in reply:
                    w, p = level.nodes.own(s), level.pairs(s)
                    planes, sums, which, code, book = reply[s][5 * i:5 * i + 5]
                    count[w], given[w] = _whole(planes, np.int64), sums[_whole(which)]
                    value[p] = book[code]
                if i:
                    small = np.flatnonzero((count == 0) & np.isfinite(above))
                    count[small] = np.rint(10 ** above[small] + DISCOUNT).astype(np.int64)
                keys, sums = hot_table.value[i]
                hit = _among(level.nodes.name, keys)
                given[hit] = sums[np.searchsorted(keys, level.nodes.name[hit])]
                seen = count > 0
                if i == 0:
                    p1, known = (count + 0.5) / den, seen
                    p_token = p1[c.token]
                left_over = np.where(seen, np.maximum(1 - given / np.maximum(count, 1), 1e-9), 1.0)
                pair = 10 ** value / np.maximum(count[level.pair_u], 1)
                p_token[at] = pair[level.pair_of] + left_over[level.context] * p_token[at]
            at = np.cumsum(c.n_tokens) - c.n_tokens
            out.append(pd.DataFrame({
                "doc_id": pd.array(t.column("doc_id").to_pylist(), "Int64"), "trained": t.column("train").to_pylist(), "n_tokens": c.n_tokens,
                "n_known": np.add.reduceat(known[c.token].astype(np.int64), at), "train_tokens": n_train,
                "base_score": np.add.reduceat(np.log10(p1)[c.token], at), "score": np.add.reduceat(np.log10(p_token), at)}))
        return pd.concat(out) if out else pd.DataFrame(columns=["doc_id", "trained", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return chunks.groupBy("chunk").cogroup(replies.where("chunk IS NOT NULL").groupBy("chunk")).applyInPandas(
        work, "doc_id long, trained boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 1, F.lit(False))


def op9_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: token counts, the unigram base and the model's score."""
    scored = score(common.documents(spark, sf_dir), ~held_out(), min_count=1, order=ORDER)
    return scored.select("doc_id", (~F.col("trained")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES = {"op9_lm": op9_lm}
ORACLE: dict[str, str] = {}
