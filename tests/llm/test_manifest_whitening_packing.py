"""Merkle manifest, whitening and packing against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulseframe.llm import merkle, ordering, packing, whitening

# ------------------------------------------------------------------- ordering


def test_positions_spread_a_hot_group(spark):
    rows = [("hot" if i % 3 else f"g{i % 7}", i % 50 if i % 4 else None) for i in range(2000)]
    df = spark.createDataFrame(rows, "g string, v int").repartition(5)
    got = ordering.positions(df, ["g"], ["v"]).collect()
    by = defaultdict(list)
    for r in got:
        by[r.g].append(r)
    for g, rs in by.items():
        rs.sort(key=lambda r: r._pos)
        assert [r._pos for r in rs] == list(range(len(rs)))
        assert {r._n for r in rs} == {len(rs)}
        values = [(-1 if r.v is None else r.v) for r in rs]
        assert values == sorted(values), g
    assert ordering.positions(df.where("false"), ["g"], ["v"]).count() == 0


# --------------------------------------------------------------------- merkle

def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    f = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    d, text, lang, source, n = row
    return h(f(d), f(source), f(lang), f(n), f(text))


def climb(nodes, fanout):
    """(root, per leaf the siblings of its ancestors as (left, right))."""
    paths = [[] for _ in nodes]
    under = [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        up, up_under = [], []
        for a in range(0, len(nodes), fanout):
            run = nodes[a:a + fanout]
            for s in range(len(run)):
                for i in under[a + s]:
                    paths[i].append((run[:s], run[s + 1:]))
            up.append(h(*run))
            up_under.append([i for u in under[a:a + fanout] for i in u])
        nodes, under = up, up_under
    return nodes[0], paths


def manifest(rows, fanout):
    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append(r)
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for g in langs:
        trees[g] = sorted(((-1 if r[0] is None else r[0], leaf(r), r) for r in groups[g]), key=lambda x: x[:2])
    subs = {g: climb([x[1] for x in trees[g]], fanout) for g in langs}
    root, over = climb([subs[g][0] for g in langs], fanout)
    out = []
    for k, g in enumerate(langs):
        for (_, lf, r), path in zip(trees[g], subs[g][1], strict=True):
            path = path + over[k]
            d, text, lang, source, n = r
            cur = lf
            if d is not None and zlib.crc32(str(d).encode()) % 7 == 0 and n is not None:
                cur = leaf((d, text, lang, source, n + 1))
            for left, right in path:
                cur = h(*left, cur, *right)
            out.append((d, lf, subs[g][0], root, h(*[x for a, b in path for x in (*a, *b)]), cur, cur == root))
    return out


def proofs(df, fanout=2, levels=3):
    values = {c: F.col(c) for c in merkle.FIELDS}
    changed = values | {"n_chars": F.col("n_chars") + 1}
    m = merkle.manifest(df, {"leaf": merkle.leaf(values), "altered": F.when(merkle.tampered(), merkle.leaf(changed))},
                        fanout=fanout, levels=levels)
    m = m.withColumn("folded", merkle.fold(F.coalesce("altered", "leaf"), F.col("path")))
    return [tuple(r) for r in m.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("path")), "folded",
                                       F.col("folded") == F.col("root")).collect()]


@pytest.mark.parametrize("fanout", [2, 3])
def test_merkle(spark, docs, rows, fanout):
    """Nulls, repeated rows, a null and a lone group; blocks of 8 leaves make several rounds."""
    assert Counter(proofs(docs, fanout, 3 if fanout == 2 else 2)) == Counter(manifest(rows, fanout))


@pytest.mark.parametrize("n", [1, 2, 65, 200])
def test_merkle_sizes(spark, n):
    rows = [(i, f"t{i}", "en", None, i if i % 5 else None) for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    want = manifest(rows, 2)
    assert Counter(proofs(df)) == Counter(want)
    assert all(ok == (zlib.crc32(str(d).encode()) % 7 != 0 or d % 5 == 0) for d, *_, ok in want)


def test_merkle_order_ties_and_empty(spark, docs, empty, rows):
    assert proofs(empty) == []
    again = spark.createDataFrame(random.Random(3).sample(rows, len(rows)), docs.schema).repartition(7)
    clash = again.withColumns({c: F.lit("x") for c in ("_h", "_pos", "_n", "_g", "_block", "leaf", "path", "root", "_tie")})
    assert Counter(proofs(clash)) == Counter(proofs(docs))


def test_merkle_windows_hold_blocks_only(spark, docs):
    """No window over rows is partitioned by the group alone."""
    leaves = docs.select(F.col("doc_id").alias("_order"), F.lit("g").alias("_g"), F.lit("x").alias("_h"))
    placed = ordering.positions(leaves, ["_g"], ["_order"])
    plan = merkle._climb(placed, ["_g"], 2, 3)._jdf.queryExecution().optimizedPlan().toString()
    specs = re.findall(r"windowspecdefinition\(([^)]*)", plan)
    over_rows = [x for x in specs if "_pid" not in x and "_c" not in x]
    assert len(over_rows) >= 3 and all("_block" in x for x in over_rows if "_pos" in x)


# ------------------------------------------------------------------ whitening

def vectors():
    rng = np.random.default_rng(4)
    base = rng.normal(size=(300, 12)) @ rng.normal(size=(12, 12)) * 0.1
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(base)]
    rows += [(1000, None), (1001, [0.1, None] + [0.0] * 10), (1002, [float("nan")] * 12), (1003, [float("inf")] + [0.0] * 11),
             (5, rows[5][1]), (None, rows[6][1]), (1004, [0.0] * 12)] + [(2000 + i, rows[7][1]) for i in range(150)]
    return rows


def fit(rows):
    kept = [(i, v) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    x = np.array([[int(np.floor(1024 * c)) + 100000 for c in v] for _, v in kept], object)
    n, s = len(x), x.sum(axis=0)
    w = n * x - s
    c = w.T.dot(w)
    return kept, n, s, w, c


def test_whitening(spark):
    rows = vectors()
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, _s string").repartition(4)
    v = whitening.usable(df)
    kept, n, s, w, c = fit(rows)
    got_n, got_s, got_c = whitening.moments(v)
    assert (got_n, list(got_s)) == (n, list(s))
    assert got_c == c.tolist()  # exact integers
    cov = np.array((c / n ** 3).tolist(), float)
    values, basis = np.linalg.eigh(cov)
    values, basis = values[::-1], basis[:, ::-1]
    out = whitening.whiten(df).collect()
    assert len(out) == n
    want = {}
    for (i, _), row in zip(kept, w.tolist(), strict=True):
        z = np.array(row, float) @ basis[:, :8] / n / np.sqrt(values[:8])
        want.setdefault(i, []).append((sum(t * t for t in row), np.abs(z)))
    for r in out:
        options = want[r.vec_id]
        assert any(int(r.deviation) == d and np.allclose(np.abs(r.whitened), z, atol=1e-9) for d, z in options)
        assert np.allclose(r.explained, values[:8] / np.trace(cov), rtol=1e-9)
    z = np.array([r.whitened for r in out])
    assert np.abs(np.cov(z.T, bias=True) - np.eye(8)).max() < 1e-9
    assert whitening.identity_error(whitening.whiten(df), 8).first()[0] < 1e-9


def test_whitening_exact_beyond_64_bits():
    x = np.array([[2 ** 40, -2 ** 45, 3], [5, 2 ** 44, -7], [0, 1, 2]], np.int64)
    for n in (3, 10 ** 9, 10 ** 12):
        s = np.array([int(t) for t in x.sum(axis=0)], object)
        w = whitening.centred(x, n, s)
        want = n * x.astype(object) - s
        assert (w.astype(object) == want).all()
        assert whitening.square_sums(w) == (want * want).sum(axis=0).tolist()


def test_whitening_degenerate(spark):
    schema = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None), (2, [None])], schema)).count() == 0
    one = whitening.whiten(spark.createDataFrame([(1, [0.5, 0.25])], schema)).collect()
    assert [(r.n, int(r.deviation), r.whitened) for r in one] == [(1, 0, [])]
    same = whitening.whiten(spark.createDataFrame([(i, [0.5, float(i % 2)]) for i in range(9)], schema)).collect()
    assert all(len(r.whitened) == 1 for r in same)  # one direction varies
    short = spark.createDataFrame([(1, [0.5]), (2, [0.5, 1.0]), (3, [])], schema)
    assert whitening.moments(whitening.usable(short))[:2][0] == 3
    with pytest.raises(Exception, match="too large"):
        whitening.whiten(spark.createDataFrame([(1, [1e30]), (2, [0.0])], schema)).collect()


def test_whitening_query(spark, sf_dir):
    out = whitening.op12_whitening(spark, sf_dir).toPandas()
    n = spark.read.parquet(f"{sf_dir}/embeddings.parquet").count()
    assert set(out.component) == set(range(1, 9)) and len(out) == 8 * out.n[0] and out.n[0] <= n
    assert out.identity_error.max() < 1e-6 and out.deviation.dtype == np.int64
    assert (out.groupby("component").explained.first().diff().dropna() <= 0).all()


# -------------------------------------------------------------------- packing

def encoder():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(packing.vocabulary_path())


def check_packed(got, want, capacity):
    key = lambda r: (r[0] is None, r[0], *r[1:])
    assert sorted([tuple(r)[:5] for r in got], key=key) == sorted(want, key=key)
    seqs = defaultdict(list)
    for r in got:
        seqs[r.sequence_id].append((r.offset, r.length))
    for parts in seqs.values():
        at = 0
        for off, n in sorted(parts):
            assert off == at
            at += n
        assert at <= capacity
    return len(seqs)


def brute_pieces(rows, capacity):
    t, want = encoder(), []
    for d, text, *_ in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        for p, a in enumerate(range(0, len(ids), capacity)):
            part = ids[a:a + capacity]
            want.append((d, p, a, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    return want


ODD = ["É́a b́ ́c", "a\x1cb\x85c d e　f", "it's WE'RE x<|endoftext|>y <|startoftext|>", "İstanbul ΣΑΣ ß ﬁ",
       "日本語 🙂🙂 123 4.5e6", "z" * 5000, "\u0000 ﻿", "aͅ ῃ " * 3]


def test_packing_pieces(spark, docs, rows, empty):
    rows = rows + [(5000 + i, t, None, None, 0) for i, t in enumerate(ODD)]
    df = spark.createDataFrame(rows, docs.schema).repartition(3).withColumns({"length": F.lit(1), "_pos": F.lit("a"), "_text": F.lit(2)})
    for capacity in (4096, 50):
        got = packing.pack(packing.pieces(df, capacity=capacity), capacity=capacity).collect()
        check_packed(got, brute_pieces(rows, capacity), capacity)
    assert packing.pack(packing.pieces(empty)).count() == 0


def test_packing_query(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = packing.op13_packing(spark, sf_dir).collect()
    want = brute_pieces(rows, 4096)
    made = check_packed(got, want, 4096)
    least = -(-sum(r[3] for r in want) // 4096)
    assert made <= 1.02 * least + 1


def test_sequences_hold_their_pieces(spark, docs, rows):
    got = packing.sequences(docs, capacity=256).collect()
    want = sorted(Counter((tuple([*encoder().encode(t or "", add_special_tokens=False).ids, 1])) for _, t, *_ in rows).elements())
    assert sum(r.n_tokens for r in got) == sum(map(len, want))
    assert all(r.n_tokens == len(r.ids) <= 256 for r in got)


def slow_best_fit(lengths, capacity, open_bins):
    bins, offsets, free, live = [], [], {}, []
    made = 0
    for n in lengths:
        fits = [b for b in live if free[b] >= n] if n < capacity else []
        if fits:
            least = min(free[b] for b in fits)
            b = [b for b in fits if free[b] == least]
            b = max(b, key=live.index)
        else:
            b, made = made, made + 1
            free[b] = capacity
            if n < capacity and len(live) == open_bins:
                least = min(free[x] for x in live)
                live.remove([x for x in live if free[x] == least][-1])
        bins.append(b)
        offsets.append(capacity - free[b])
        free[b] -= n
        if b in live:
            live.remove(b)
        if free[b]:
            live.append(b)
    return bins, offsets


def test_best_fit_bitset_is_best_fit():
    r = random.Random(8)
    for open_bins in (1, 2, 5, 40):
        lengths = [r.choice([1, r.randint(1, 64), r.randint(30, 64), 64]) for _ in range(600)]
        assert packing.best_fit(lengths, 64, open_bins) == slow_best_fit(lengths, 64, open_bins)
