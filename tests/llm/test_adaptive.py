"""Limits that the groups' own sketches decide; the segment scan in linear time."""

import random
import time

import numpy as np
from pyspark.sql import functions as F

from pulseframe.llm import quality, toxicity


def text(r, symbols, words=60, size=6):
    """Words of ``size`` letters, a share of them followed by a symbol."""
    out = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(size)) for _ in range(words)]
    return " ".join(w + ("|" if r.random() < symbols else "") for w in out)


def test_groups_judge_the_same_text_differently(spark):
    """Prose without symbols, code with many; short words in one source, long ones in the other."""
    r = random.Random(9)
    rows = [(i, text(r, 0.0, size=5), "en", "prose") for i in range(300)]
    rows += [(1000 + i, text(r, r.uniform(0.2, 0.6), size=9), "en", "code") for i in range(300)]
    odd = text(r, 0.4, size=9)  # usual for the one, far out for the other
    plain = text(r, 0.0, size=5)
    rows += [(5000, odd, "en", "prose"), (5001, odd, "en", "code"), (5002, plain, "en", "prose"), (5003, plain, "en", "code")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    out = {x.doc_id: x for x in quality.judge(df).collect()}
    assert [out[i].kept for i in (5000, 5001, 5002, 5003)] == [False, True, True, False]
    assert out[5001].max_symbols > 10 * out[5000].max_symbols and out[5001].max_word_length > out[5000].max_word_length
    assert out[5003].min_word_length > 5000 >= out[5002].min_word_length  # letters per 1000 words
    floors = {k: v[4] for k, v in quality.RATIOS.items()}
    assert out[5001].max_symbols > floors["symbols"] and out[5000].max_word_length > floors["word_length"]
    kept = [out[i].kept for i in (*range(300), *range(1000, 1300))]
    assert sum(kept) >= 0.98 * len(kept)


def test_small_groups_use_their_language(spark):
    r = random.Random(3)
    rows = [(i, text(r, r.uniform(0.2, 0.6)), "xx", f"s{i % 40}") for i in range(400)] + [(900, text(r, 0.5), "xx", "lone"), (901, None, "yy", None)]
    out = {x.doc_id: x for x in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert out[900].kept and out[900].max_symbols == out[0].max_symbols
    assert out[901].base_failed and not out[901].kept and out[901].max_symbols is None


def slow(scores):
    """Maximal segments by the recursive definition: the best one, then both sides."""
    if not len(scores) or max(scores) <= 0:
        return []
    best = max(((sum(scores[a:z]), -(z - a), a, z) for a in range(len(scores)) for z in range(a + 1, len(scores) + 1)))
    _, _, a, z = best
    return slow(scores[:a]) + [(best[0], a, z)] + [(s, x + z, y + z) for s, x, y in slow(scores[z:])]


def test_segments_against_definition():
    r = random.Random(1)
    for _ in range(300):
        x = [r.choice([-3, -2, -1.5, -0.5, 0.7, 1.1, 2.3]) + r.random() * 1e-3 for _ in range(r.randint(0, 14))]
        got, want = toxicity.segments(np.array(x)), slow(x)
        assert [g[1:] for g in got] == [w[1:] for w in want]
        assert np.allclose([g[0] for g in got], [w[0] for w in want])


def test_segments_in_linear_time():
    for pattern in ([1.0, -2.0], [3.0, -1.0, -2.5, 1.0], [1.0, -0.999]):
        x = np.tile(pattern, 200_000 // len(pattern))
        t = time.perf_counter()
        toxicity.segments(x)
        assert time.perf_counter() - t < 2.0, pattern
    up = np.concatenate([[float(k), -float(k) + 0.5] for k in range(1, 50_000)])
    t = time.perf_counter()
    toxicity.segments(up)
    toxicity.segments(-up[::-1])
    assert time.perf_counter() - t < 2.0
