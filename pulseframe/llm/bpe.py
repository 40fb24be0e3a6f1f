"""Byte-level BPE encoding and decoding.

The rank file (base64 token, rank) becomes a byte-level model of the
``tokenizers`` library: every byte is written as one printable character,
tokens as strings of them, and the merges follow from the ranks. Texts arrive
in Arrow batches, are cut by the split pattern, and each distinct piece is
merged once by the library and kept in a bounded table; a batch's ids are then
gathered from that table. Decoding looks ids up, turns characters back into
bytes by the reversed byte table and joins them, so a character split over
several tokens comes back whole.

Null texts are empty (no tokens). Ids are the ranks. Offsets say where each
token starts: as a byte, and as the character holding that byte (tokens inside
one character share its index).
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from pulseframe.llm import common

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Pieces kept per worker before the table starts anew.
KEPT_PIECES = 300_000


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def split_pattern() -> str:
    import public_tokenizers
    return public_tokenizers.PATTERN


def byte_table() -> dict[int, str]:
    """Printable characters stand for themselves, the other bytes for the
    characters from U+0100 on, in order."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Codec:
    """Encodes and decodes lists of texts with one vocabulary."""

    def __init__(self, path: str, pattern: str):
        from tokenizers import Tokenizer, models, pre_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task owns one core
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        chars = byte_table()
        name = {tok: "".join(chars[b] for b in tok) for tok in ranks}
        merges = []
        for tok, rank in ranks.items():
            for i in range(1, len(tok)):
                left, right = ranks.get(tok[:i]), ranks.get(tok[i:])
                if left is not None and right is not None:
                    merges.append((rank, left, right, name[tok[:i]], name[tok[i:]]))
        merges.sort(key=lambda m: m[:3])
        self.tokenizer = Tokenizer(models.BPE({name[t]: r for t, r in ranks.items()}, [m[3:] for m in merges],
                                              cache_capacity=0))
        self.tokenizer.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.find = regex.compile(pattern).findall
        back = {c: b for b, c in chars.items()}
        by_id = {r: bytes(back[c] for c in name[t]) for t, r in ranks.items()}
        self.token = [by_id.get(i, b"") for i in range(max(by_id) + 1)]
        self.length = np.array([len(t) for t in self.token], np.int64)
        self.at = np.cumsum(self.length) - self.length
        self.table = np.frombuffer(b"".join(self.token), np.uint8)
        self._reset()

    def _reset(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.first, self.count = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _learn(self, pieces: list[str]) -> None:
        found, at = [], len(self.ids)
        first, count = [], []
        for lo in range(0, len(pieces), 20_000):
            for e in self.tokenizer.encode_batch_fast(pieces[lo:lo + 20_000], add_special_tokens=False):
                ids = e.ids
                first.append(at)
                count.append(len(ids))
                at += len(ids)
                found += ids
        n = len(self.known)
        self.known.update(zip(pieces, range(n, n + len(pieces)), strict=True))
        self.ids = np.concatenate([self.ids, np.array(found, np.int32)])
        self.first = np.concatenate([self.first, np.array(first, np.int64)])
        self.count = np.concatenate([self.count, np.array(count, np.int64)])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts end to end, offsets of the texts)."""
        found = [self.find(t) for t in texts]
        pieces = list(itertools.chain.from_iterable(found))
        per_text = np.array([len(p) for p in found], np.int64)
        del found
        if len(self.known) > KEPT_PIECES:
            self._reset()
        code = np.fromiter(map(self.known.get, pieces, itertools.repeat(-1)), np.int64, len(pieces))
        if len(missing := np.flatnonzero(code < 0)):
            unknown = [pieces[i] for i in missing.tolist()]
            self._learn(list(dict.fromkeys(unknown)))
            code[missing] = np.fromiter(map(self.known.__getitem__, unknown), np.int64, len(unknown))
        counts = self.count[code]
        ids = self.ids[common.spread(self.first[code], counts)]
        ends = np.concatenate([[0], np.cumsum(counts)])
        return ids, ends[np.concatenate([[0], np.cumsum(per_text)])]

    def decode(self, ids: np.ndarray | list[int]) -> bytes:
        """Bytes of the ids; ids outside the vocabulary stand for nothing."""
        ids = np.asarray(ids, np.int64)
        ids = ids[(ids >= 0) & (ids < len(self.token))]
        return self.table[common.spread(self.at[ids], self.length[ids])].tobytes()

    def decode_text(self, ids: list[int]) -> str:
        """Text of the ids; bytes that form no character become U+FFFD."""
        return self.decode(ids).decode("utf-8", "replace")

    def starts(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte and character index at which each token starts."""
        n = self.length[ids]
        at = np.cumsum(n) - n
        raw = np.frombuffer(text.encode("utf-8"), np.uint8)
        char = np.cumsum((raw & 0xC0) != 0x80) - 1
        return at, char[at]


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """The codec of this worker process, built once."""
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = Codec(path, pattern)
    return _CODECS[path, pattern]


ARRAYS = {"ids": T.ArrayType(T.IntegerType()), "byte_starts": T.ArrayType(T.IntegerType()),
          "char_starts": T.ArrayType(T.IntegerType())}
DIGESTS = {"n_tokens": T.LongType(), "ids_sha256": T.StringType(), "decoded_sha256": T.StringType()}


def encode(docs: DataFrame, text_col: str = "text", outputs: tuple[str, ...] = ("ids", "byte_starts", "char_starts"),
           path: str | None = None, pattern: str | None = None, keep: tuple[str, ...] | None = None) -> DataFrame:
    """Encode every text.

    ``outputs``: any of ids, byte_starts, char_starts (arrays), n_tokens,
    ids_sha256 (ids as little-endian unsigned 32-bit integers),
    decoded_sha256 (of the bytes that decoding the ids gives). ``keep``:
    columns kept beside them (default all but the outputs' names). Works
    batch by batch in one stage without a shuffle; an empty table gives an
    empty result, a null or empty text no tokens.
    """
    common.small_arrow_batches(docs.sparkSession, 500)
    path, pattern = path or vocabulary_path(), pattern or split_pattern()
    kinds = ARRAYS | DIGESTS
    keep = tuple(c for c in docs.columns if c not in outputs) if keep is None else keep
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(c, kinds[c]) for c in outputs])
    source = docs.select(*keep, docs[text_col].alias("_bpe_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for b in common.chunks(batches, "_bpe_text", 4 << 20):
            texts = [t or "" for t in b.column("_bpe_text").to_pylist()]
            ids, off = c.encode(texts)
            out = {"n_tokens": pa.array(np.diff(off), pa.int64())}
            bounds = pa.array(off, pa.int32())
            if "ids" in outputs:
                out["ids"] = pa.ListArray.from_arrays(bounds, pa.array(ids, pa.int32()))
            spans = list(zip(off[:-1].tolist(), off[1:].tolist(), strict=True))
            if "byte_starts" in outputs or "char_starts" in outputs:
                both = [c.starts(t, ids[a:z]) for t, (a, z) in zip(texts, spans, strict=True)]
                for i, k in enumerate(("byte_starts", "char_starts")):
                    flat = np.concatenate([x[i] for x in both]) if both else np.zeros(0)
                    out[k] = pa.ListArray.from_arrays(bounds, pa.array(flat.astype(np.int32), pa.int32()))
            if "ids_sha256" in outputs:
                raw = ids.astype("<u4")
                out["ids_sha256"] = pa.array([hashlib.sha256(raw[a:z].tobytes()).hexdigest() for a, z in spans],
                                             pa.string())
            if "decoded_sha256" in outputs:
                out["decoded_sha256"] = pa.array(
                    [hashlib.sha256(c.decode(ids[a:z])).hexdigest() for a, z in spans], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(k) for k in keep] + [out[k] for k in outputs],
                                             names=[*keep, *outputs])

    return source.mapInArrow(run, schema)


def decode(df: DataFrame, ids_col: str = "ids", out_col: str = "decoded", as_text: bool = True,
           path: str | None = None) -> DataFrame:
    """Add the decoded text (or bytes) of an id array; null ids decode to null.

    Characters split over tokens are joined before UTF-8 is read; bytes that
    still form no character become U+FFFD (``as_text=False`` keeps them).
    """
    common.small_arrow_batches(df.sparkSession, 500)
    path, pattern = path or vocabulary_path(), split_pattern()
    rest = [f for f in df.schema.fields if f.name != out_col]
    schema = T.StructType(rest + [T.StructField(out_col, T.StringType() if as_text else T.BinaryType())])
    names = [f.name for f in rest]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        undo = c.decode_text if as_text else c.decode
        for b in batches:
            done = [None if x is None else undo([i for i in x if i is not None]) for x in b.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(k) for k in names] + [
                pa.array(done, pa.string() if as_text else pa.binary())], names=[*names, out_col])

    return df.mapInArrow(run, schema)


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: token count, digest of the ids, digest of the decoded bytes."""
    return encode(common.documents(spark, sf_dir).select("doc_id", "text"), outputs=tuple(DIGESTS), keep=("doc_id",))


QUERIES = {"op3_bpe": op3_bpe}
ORACLE: dict[str, str] = {}
