"""Learned operators: held-out accuracy, exact pieces, odd cases."""

import itertools

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from pulseframe.llm import catalog, langid, toxicity


def test_toxicity_held_out(spark, sf_dir):
    got = toxicity.op2_toxicity(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic"), "doc_id").toPandas()
    h = got[got.held_out]
    assert len(h) and (h.predicted[h.toxic == 0] == 0).all()
    assert h.predicted[h.toxic == 1].mean() >= 0.7
    assert got.score.between(0, 1).all()


def test_segments_are_the_maximal_ones():
    r = np.random.default_rng(0)

    def brute(s):
        if not len(s):
            return []
        best = max(((s[a:z].sum(), -(z - a), -a, a, z) for a, z in itertools.combinations(range(len(s) + 1), 2)))
        if best[0] <= 0:
            return []
        a, z = best[3], best[4]
        return brute(s[:a]) + [(round(float(best[0]), 9), a, z)] + [(v, x + z, y + z) for v, x, y in brute(s[z:])]

    for _ in range(60):
        s = r.integers(-300, 300, r.integers(1, 14)) / 100 + r.random() / 1000
        assert [(round(v, 9), a, z) for v, a, z in toxicity.segments(s)] == brute(s)


def test_toxicity_odd_cases(spark, docs, empty):
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(20, 60)] + [(1, None), (None, 1), (20, 0)], "doc_id long, toxic int")
    model = toxicity.learn(docs.select("doc_id", "text"), labels)
    out = toxicity.score(docs.withColumn("evidence", F.lit("clash")), model).collect()
    assert len(out) == docs.count() and all(0 <= r.score <= 1 for r in out)
    assert toxicity.score(empty, model).count() == 0
    none = toxicity.learn(empty.select("doc_id", "text"), labels.limit(0))
    assert {r.score for r in toxicity.score(docs, none).collect()} == {0.5}


def test_langid_held_out(spark, sf_dir):
    got = langid.op6_langid(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang"), "doc_id").toPandas()
    h = got[got.held_out]
    assert len(h) > 100 and (h.lang_pred == h.lang).mean() >= 0.97


def test_langid_odd_cases(docs, empty):
    model = langid.learn(docs.select("text", "lang"))
    got = langid.predict(docs.withColumn("score", F.lit("clash")), model).collect()
    for r in got:
        if r.doc_id in (1, 2, 3, 14):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        assert 0 <= r.score <= 1
    assert len(got) == docs.count() and langid.predict(empty, model).count() == 0
    assert {r.lang_pred for r in langid.predict(docs, langid.learn(empty.select("text", "lang"))).collect()} == {"und"}


def test_contexts_sum_to_one(docs):
    trees = langid.Trees(*langid.learn(docs.select("text", "lang")))
    for cost in trees.cost:
        for level in cost:
            p = np.exp2(-level.astype(float))
            p[:, -1] *= 256 - (trees.n - 1)
            assert np.allclose(p.sum(1), 1, atol=1e-5)


def test_code_length_is_that_of_a_walk(docs):
    langs, counts = langid.learn(docs.select("text", "lang"))
    trees = langid.Trees(langs, counts)
    text = np.frombuffer("the idiot ran, Über café ☃".encode(), np.uint8)
    total = trees.bits(text, np.array([0, len(text)]))[0]
    for j, (code, n) in enumerate(counts):
        seen = {}
        for c, k in zip(code.tolist(), n.tolist()):
            for order in range(langid.ORDER + 1):
                ctx = (order, (c >> 8) % 256**order)
                seen.setdefault(ctx, {}).setdefault(c & 255, 0)
                seen[ctx][c & 255] += k
        bits, past = 0.0, [0] * langid.ORDER
        for b in text.tolist():
            out, p = set(), 1.0
            value = int.from_bytes(bytes(past), "big")
            for order in range(langid.ORDER, -2, -1):
                if order < 0:
                    p /= 256 - len(out)
                    break
                here = seen.get((order, value % 256**order), {})
                live = {s: k for s, k in here.items()}
                if not live:
                    continue
                t, d = sum(live.values()), len(live)
                if b in live and b not in out:
                    # What the higher orders ruled out shares nothing here.
                    p *= live[b] / (t + d) / (1 - _excluded(seen, value, order, out, trees))
                    break
                p *= d / (t + d) / (1 - _excluded(seen, value, order, out, trees)) if order < langid.ORDER and out else d / (t + d)
                out |= set(live)
            bits -= np.log2(p)
            past = past[1:] + [b]
        assert np.isclose(bits, total[j], rtol=0.02), langs[j]


def _excluded(seen, value, order, out, trees):
    """Share of the order's distribution that lies on bytes already ruled out."""
    here = seen.get((order, value % 256**order), {})
    t, d = sum(here.values()), len(here)
    return sum(here.get(s, 0) for s in out) / (t + d) if t else 0.0


def test_pipeline_stages(spark, sf_dir):
    small = sf_dir.rsplit("/", 1)[0] + "/sf0.001"
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "simhash_dedup", "mix_sources", "bpe_round_trip"]
    docs = spark.read.parquet(f"{small}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:2]:
        out = stage(spark, docs, small)
        assert out.columns == docs.columns and 0 < out.count() <= docs.count()
    assert corpus_pipeline.run(spark, small).count() > 0
    assert {f"op{i}" for i in range(1, 11)} <= {k.split("_")[0] for k in catalog.queries()}


def test_langid_draws_different_texts(spark):
    """A language of many copies of few texts is learned, each text once."""
    copies = [("aa", f"text number {i % 3} of the copied ones") for i in range(600)]
    many = [("bb", f"ein anderer Satz {i} mit Zahl {i * i}") for i in range(400)]
    docs = spark.createDataFrame(copies + many, "lang string, text string")
    for sample in (1, 40):
        langs, counts = langid.learn(docs, sample)
        assert langs == ["aa", "bb"]
        size = {lang: n.sum() for lang, (_, n) in zip(langs, counts, strict=True)}
        assert size["aa"] <= sum(len(t) for t in {t for _, t in copies})
        assert 0 < size["bb"] <= 2 * sample * max(len(t) for _, t in many)
    assert size["aa"] == sum(len(t) for t in {t for _, t in copies})
