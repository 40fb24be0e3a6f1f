"""Packing tokenised documents into sequences by bounded-space online best-fit.

Texts are tokenised where they are read: Arrow batches are cut at ASCII white
space (which the vocabulary's own rules drop, so words never interact), every
distinct word is encoded once by the ``tokenizers`` library and kept in a
bounded table, and a document's ids are gathered from it, followed by the end
id. Documents above the capacity are cut into pieces of that many tokens, the
last one shorter. Only (doc_id, piece, start, length, crc32) travels.

Pieces are numbered in a seeded order of their content (``ordering.positions``)
and cut into groups of ``group_pieces``, so a group of copies is spread and a
task holds a bounded number of small rows. A group is packed in one pass with
at most ``open_bins`` open sequences. A bitset has bit f set while some open
sequence has f tokens free; the lowest set bit at or above a piece's length is
the best fit. Where none fits, a new sequence is opened, and if all places are
taken, the fullest one (the lowest set bit) closes first. Full sequences close
at once.

A null or empty text gives one piece holding the end id alone. Null ids are
kept and order first; repeated rows are packed one by one. Results depend on
the rows' contents, not on how they are partitioned (equal rows may swap
places). An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import itertools
import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseframe.llm import common
from pulseframe.llm.bpe import byte_table
from pulseframe.llm.ordering import positions

VOCABULARY = "word_bpe_49k.json"
CAPACITY = 4096
END_ID = 1
OPEN_BINS = 512
GROUP_PIECES = 1 << 16
SEED = 23
#: Words and pieces kept per worker before their tables start anew; longer words are not kept.
KEPT_WORDS, KEPT_PIECES, KEPT_LENGTH = 800_000, 500_000, 64
#: Words that the library takes whole: with white space or controls inside,
#: special tokens, or characters whose class may depend on the Unicode version.
_WHOLE = re.compile("[\x1c-\x1f\x85\xa0\u0250-\U0010ffff]|<\\|")


class Words:
    """Token ids of texts, each distinct word encoded once.

    New words are normalised together, cut by the vocabulary's own pattern,
    and each distinct piece is merged once by the library's model.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task owns one core
        self.tokenizer = Tokenizer.from_file(path)
        cut = json.loads(self.tokenizer.to_str())["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.cut = regex.compile(cut).findall
        # Where the pattern takes runs of letters, and runs of other signs, as
        # they are, a word of letters alone is one piece and needs no search.
        self.runs = {"[\\p{L}]+", "[^\\s\\p{L}\\p{N}]+"} <= set(cut.split("|"))
        self.tokenize = self.tokenizer.model.tokenize
        self.chars = byte_table()
        self.pieces: dict[str, list[int]] = {}
        self._reset()

    def _reset(self) -> None:
        self.known: dict[bytes, int] = {}
        self.ids, self.first, self.count = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _piece(self, piece: str) -> list[int]:
        raw = piece  # printable ASCII stands for itself in the byte table
        if not (piece.isascii() and piece.isprintable()):
            raw = piece.encode("utf-8").decode("latin-1").translate(self.chars)
        ids = self.pieces[piece] = [t.id for t in self.tokenize(raw)]
        return ids

    def _word_ids(self, texts: list[str]) -> list[list[int]]:
        search = _WHOLE.search
        whole = [i for i, t in enumerate(texts) if not (t.isascii() and t.isalnum()) and search(t)]
        done: list[list[int]] = [[]] * len(texts)
        if whole:
            found = self.tokenizer.encode_batch_fast([texts[i] for i in whole], add_special_tokens=False)
            for i, e in zip(whole, found, strict=True):
                done[i] = e.ids
        skip = set(whole)
        rest = [i for i in range(len(texts)) if i not in skip]
        plain = self.tokenizer.normalizer.normalize_str(" ".join([texts[i] for i in rest])).split(" ")
        if len(self.pieces) > KEPT_PIECES:
            self.pieces = {}
        get, cut, runs = self.pieces.get, self.cut, self.runs
        for i, word in zip(rest, plain, strict=True) if rest else ():
            if runs and word.isalpha():
                done[i] = get(word) or self._piece(word)
                continue
            if runs and word[-1] in ".,;:!?" and word[:-1].isalpha():
                parts = (word[:-1], word[-1])
            else:
                parts = cut(word)
            if len(parts) == 1:
                done[i] = get(parts[0]) or self._piece(parts[0])
            else:
                done[i] = [x for p in parts for x in get(p) or self._piece(p)]
        return done

    def _add(self, words: list[bytes]) -> None:
        found: list[list[int]] = []
        for lo in range(0, len(words), 20_000):
            found += self._word_ids(b" ".join(words[lo:lo + 20_000]).decode("utf-8").split(" "))
        n, at = len(self.first), len(self.ids)
        count = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter(itertools.chain.from_iterable(found), np.int32, int(count.sum()))
        self.known.update(zip(words, range(n, n + len(words)), strict=True))
        self.ids = np.concatenate([self.ids, flat])
        self.first = np.concatenate([self.first, at + np.cumsum(count) - count])
        self.count = np.concatenate([self.count, count])

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts end to end, offsets of the texts)."""
        split = [t.split() for t in texts]  # ASCII white space
        words = list(itertools.chain.from_iterable(split))
        per_text = np.fromiter(map(len, split), np.int64, len(split))
        del split
        if len(self.known) > KEPT_WORDS or len(self.ids) > 16 * KEPT_WORDS:
            self._reset()
        code = np.fromiter(map(self.known.get, words, itertools.repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(code < 0)
        if len(missing):
            unknown = [words[i] for i in missing.tolist()]
            new = list(dict.fromkeys(unknown))
            self._add(new)
            code[missing] = np.fromiter(map(self.known.__getitem__, unknown), np.int64, len(unknown))
            for w in new:
                if len(w) > KEPT_LENGTH:
                    del self.known[w]
        counts = self.count[code]
        ids = self.ids[common.spread(self.first[code], counts)]
        ends = np.concatenate([[0], np.cumsum(counts)])
        return ids, ends[np.concatenate([[0], np.cumsum(per_text)])]


_WORDS: dict[str, Words] = {}


def words_of(path: str) -> Words:
    """The word table of this worker process."""
    if path not in _WORDS:
        _WORDS[path] = Words(path)
    return _WORDS[path]


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None,
           capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every document."""
    common.small_arrow_batches(docs.sparkSession, 500)
    path = path or vocabulary_path()
    source = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("_text"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = words_of(path)
        for b in common.chunks(batches, "_text", 4 << 20):
            texts = [t or b"" for t in b.column("_text").cast(pa.binary()).to_pylist()]
            ids, off = table.encode(texts)
            # The end id goes behind every document.
            n = np.diff(off) + 1
            stop = np.cumsum(n)
            every = np.full(int(stop[-1]), end_id, "<u4")
            keep = np.ones(len(every), bool)
            keep[stop - 1] = False
            every[keep] = ids
            cuts = -(-n // capacity)
            doc = np.repeat(np.arange(len(n)), cuts)
            piece = common.spread(np.zeros(len(n), np.int64), cuts)
            start = piece * capacity
            length = np.minimum(capacity, n[doc] - start)
            lo = (stop - n)[doc] + start
            crc = [zlib.crc32(every[a:z].tobytes()) for a, z in zip(lo.tolist(), (lo + length).tolist(), strict=True)]
            out = [b.column("doc_id").take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                   pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:  # pieces lie end to end
                out.append(pa.ListArray.from_arrays(pa.array(np.concatenate([lo, [len(every)]]), pa.int32()),
                                                    pa.array(every.astype(np.int32))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(out, names=names)

    return source.mapInArrow(run, schema)


def best_fit(lengths: list[int], capacity: int = CAPACITY, open_bins: int = OPEN_BINS) -> tuple[list[int], list[int]]:
    """(bin, offset) of every length, in the order given."""
    free_bits = 0
    by_free: dict[int, list[int]] = {}
    n_open = made = 0
    bins, offsets = [], []
    for length in lengths:
        fits = free_bits >> length
        if length < capacity and fits:
            free = length + (fits & -fits).bit_length() - 1
            stack = by_free[free]
            b = stack.pop()
            if not stack:
                free_bits ^= 1 << free
            n_open -= 1
        else:
            b, free = made, capacity
            made += 1
            if length < capacity and n_open == open_bins:
                fullest = (free_bits & -free_bits).bit_length() - 1
                by_free[fullest].pop()
                if not by_free[fullest]:
                    free_bits ^= 1 << fullest
                n_open -= 1
        bins.append(b)
        offsets.append(capacity - free)
        left = free - length
        if left:
            by_free.setdefault(left, []).append(b)
            free_bits |= 1 << left
            n_open += 1
    return bins, offsets


def pack(items: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS,
         group_pieces: int = GROUP_PIECES, seed: int = SEED) -> DataFrame:
    """Add sequence_id and offset to (doc_id, piece, length, ...) rows.

    Lengths lie between 1 and ``capacity``. Groups are numbered, and a
    sequence's id is its group's number and its own.
    """
    columns = items.columns
    keyed = items.withColumn("_key", F.xxhash64(F.lit(seed), *[F.col(c) for c in columns]))
    placed = positions(keyed, [], ["_key", *columns])
    grouped = placed.select(*columns, "_pos", F.floor(F.col("_pos") / group_pieces).cast("long").alias("_group"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema.fields)

    def run(t: pa.Table) -> pa.Table:
        t = t.take(pa.array(np.argsort(t.column("_pos").to_numpy(), kind="stable")))
        bins, offsets = best_fit(t.column("length").to_pylist(), capacity, open_bins)
        base = t.column("_group")[0].as_py() << 32
        return pa.table([t.column(c) for c in columns] + [pa.array(np.array(bins, np.int64) + base), pa.array(offsets, pa.int64())],
                        names=[*columns, "sequence_id", "offset"])

    return grouped.groupBy("_group").applyInArrow(run, f"{schema}, sequence_id long, offset long")


def sequences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None,
              capacity: int = CAPACITY, end_id: int = END_ID, open_bins: int = OPEN_BINS) -> DataFrame:
    """(sequence_id, n_pieces, n_tokens, ids): the packed sequences themselves."""
    found = pieces(docs, id_col, text_col, path, capacity, end_id, with_ids=True)
    cut = common.stored(found.withColumn("_row", F.monotonically_increasing_id()))
    packed = pack(cut.select("doc_id", "piece", "length", "_row"), capacity, open_bins)
    parts = packed.select("_row", "sequence_id", "offset").join(cut.select("_row", "length", "ids"), "_row")
    return parts.groupBy("sequence_id").agg(
        F.count("*").alias("n_pieces"), F.sum("length").alias("n_tokens"),
        F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("offset", "ids"))), lambda p: p["ids"])).alias("ids"))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per piece: its tokens' place in its document, their digest, and its place in a sequence."""
    docs = common.documents(spark, sf_dir).select("doc_id", "text")
    return pack(common.stored(pieces(docs)))


QUERIES = {"op13_packing": op13_packing}
ORACLE: dict[str, str] = {}
