import re

import pytest

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(t):
    return WORDS.findall(t or "")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


@pytest.fixture(scope="session")
def rows():
    """Nulls, blanks, ties, repeated rows, copies and one very long text."""
    import random
    r = random.Random(5)
    vocab = ["the", "of", "Über", "café", "naïve", "and", "idiot", "run"] + [f"w{i}" for i in range(300)]
    text = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    line = text(30)
    base = text(120)
    out = [(1, None, "en", "a"), (2, "", "en", None), (3, " \t\n\r ", None, "a"), (4, "one two", "fr", "b"),
           (5, "日本語 テキスト 🙂", "ja", "b"), (6, base, "en", "a"), (7, base, "en", "c"), (7, base, "en", "c"),
           (8, base + "\n" + line, "en", "a"), (9, line + "\n" + text(12), "en", "a"),
           (10, line.replace("w", "x", 1) + "\n" + text(12), "de", "a"), (11, text(30_000), "en", "z"),
           (12, "spam " * 400, "en", "a"), (13, "a # b $ c % " * 40, "en", "a"), (14, "123 456", "en", "a"),
           (None, base, "en", "a"), (None, None, None, None)]
    out += [(20 + i, text(60) + ("\n" + line if i % 3 == 0 else ""), "en" if i % 2 else "de", "abc"[i % 3]) for i in range(40)]
    return [(*x, len(x[1] or "")) for x in out]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
