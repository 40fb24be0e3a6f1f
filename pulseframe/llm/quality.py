"""Quality rules with adaptive thresholds (DataFrame and SQL functions only).

Every document gets integer statistics of its whole text. Four ratios follow
from them; for each (lang, source) group and ratio a mergeable quantile sketch
of the documents that pass the base rule is kept: counts per log-linear bucket
(relative width 1/128), which merge by addition, so partial aggregates combine
before the shuffle and a hot source costs one row per bucket and task.
Quantiles read from the sketch give the group's own limits in place of fixed
cutoffs: an upper quantile plus ``spread`` times its distance from a lower one
(the quartile and the median where most documents differ, quantiles of the
tail where most have none), and for the length of words a lower limit in the
same way. A small floor, well below what is normal where a ratio varies at
all, keeps a group whose sketch holds zeros alone from losing every document
with a trace. Groups with fewer than ``min_group`` documents use the sketch of
their language, and those the sketch of the whole corpus (merged buckets
again). The limits, one row per group, are joined back to filter.

Null texts have no words and fail the base rule; null lang and source are
groups of their own. Repeated rows are judged one by one. An empty table gives
an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseframe.llm import common

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: Ratio -> (scaled integer expression, lower and upper quantile, spread, floor of the limit).
RATIOS = {
    "symbols": ("10000 * n_symbols div greatest(word_chars, 1)", 50, 75, 6, 50),
    "dup_lines": ("10000 * n_dup_lines div greatest(n_words, 1)", 95, 98, 6, 100),
    "repeats": ("10000 * n_repeat_words div greatest(n_words, 1)", 90, 95, 8, 200),
    "word_length": ("1000 * word_chars div greatest(n_words, 1)", 50, 75, 10, 3000),
}
#: Ratios with a lower limit as well: the first quartile less the spread times its distance from the median.
LOWER = {"word_length": 8}
QUANTILES = (25, 50, 75, 90, 95, 98)
MIN_GROUP = 200
#: Groups whose limits are broadcast (a few dozen bytes each); more are joined by shuffle.
BROADCAST_GROUPS = 50_000


def statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long)."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    words = F.array_remove(F.split(t, r"[\x20\x09-\x0D]+"), "")
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    keep = docs.columns
    df = docs.select(
        *keep, words.alias("_w"), lines.alias("_l"),
        (F.length(t) - F.regexp_count(t, F.lit(r"[\x20\x09-\x0D]"))).cast("long").alias("word_chars"),
        F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"))
    df = df.select(
        *keep, "word_chars", "n_symbols", F.size("_w").cast("long").alias("n_words"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.expr("CASE WHEN size(_w) >= 5 THEN transform(sequence(1, size(_w) - 4), i -> concat_ws(' ', get(_w, i - 1), get(_w, i), get(_w, i + 1), get(_w, i + 2), get(_w, i + 3)))"
               " ELSE cast(array() AS array<string>) END").alias("_g"))
    # Only texts that repeat a window at all pay for sorting their windows.
    df = df.select(
        *keep, "word_chars", "n_symbols", "n_words", "n_dup_lines",
        F.expr("CASE WHEN size(array_distinct(_g)) < size(_g) THEN"
               " sort_array(transform(_g, (g, i) -> struct(g AS g, i AS i))) END").alias("_s"))
    df = df.select(
        *keep, "word_chars", "n_symbols", "n_words", "n_dup_lines",
        F.expr("CASE WHEN _s IS NOT NULL THEN sort_array(transform(filter(_s, (x, j) ->"
               " (j > 0 AND get(_s, j - 1).g = x.g) OR (get(_s, j + 1).g = x.g)), x -> x.i)) END").alias("_p"))
    covered = F.expr("aggregate(_p, named_struct('n', 0L, 'last', -5), (a, x) ->"
                     " named_struct('n', a.n + least(5, x - a.last), 'last', x), a -> a.n)")
    # Generated rather than projected: conditions on the statistics stay above
    # and do not take the whole expression down with them.
    return df.select(*keep, F.inline(F.array(F.struct(
        "n_words", "word_chars", "n_symbols", "n_dup_lines", F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words")))))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def _bucket(x: str) -> str:
    """Log-linear bucket of a non-negative integer: the bit length, then the
    next seven bits. Exact integer arithmetic, so that sketches merge exactly."""
    bits = f"length(bin({x}))"
    shift = f"greatest({bits} - 8, 0)"
    return f"CASE WHEN {x} < 128 THEN {x} ELSE 128L * {bits} + (shiftright({x}, {shift}) - 128L) END"


def _upper(b: str) -> str:
    """Largest integer of a bucket (``_bucket`` undone)."""
    return (f"CASE WHEN {b} < 128 THEN {b} ELSE shiftleft(129L + {b} % 128, cast({b} div 128 - 8 AS int)) - 1 END")


def _least(b: str) -> str:
    """Smallest integer of a bucket."""
    return (f"CASE WHEN {b} < 128 THEN {b} ELSE shiftleft(128L + {b} % 128, cast({b} div 128 - 8 AS int)) END")


def sketches(stats: DataFrame) -> DataFrame:
    """(lang, source, ratio, bucket, n): the mergeable sketch of every group."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("ratio"), F.expr(_bucket(f"({e})")).alias("bucket"))
                               for k, (e, *_) in RATIOS.items()])).alias("r")
    return (stats.select("lang", "source", each).select("lang", "source", "r.ratio", "r.bucket")
            .groupBy("lang", "source", "ratio", "bucket").agg(F.count("*").alias("n")))


def _case(values: dict[str, str]) -> str:
    return "CASE ratio " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in values.items()) + " END"


#: SQL of a group's limits over its quantiles q25, q50, ...
UPPER_SQL = _case({k: f"greatest(q{hi} + {spread} * (q{hi} - q{lo}), {floor})" for k, (_, lo, hi, spread, floor) in RATIOS.items()})
LOWER_SQL = _case({k: f"greatest(q25 - {spread} * (q50 - q25), 0)" for k, spread in LOWER.items()})


def quantiles(sketch: DataFrame, by: list[str]) -> DataFrame:
    """(by, ratio, docs, q25, q50, ...) of every merged sketch: the least value
    of the quantile's bucket below the median, the largest from there on, so
    that a limit never cuts into a bucket."""
    from pyspark.sql.window import Window

    merged = sketch.groupBy(*by, "ratio", "bucket").agg(F.sum("n").alias("n"))
    w = Window.partitionBy(*by, "ratio")
    run = merged.withColumn("up_to", F.sum("n").over(w.orderBy("bucket"))).withColumn("total", F.sum("n").over(w))
    at = lambda q: F.min(F.when(F.col("up_to") * 100 >= F.col("total") * q, F.expr(_upper("bucket") if q >= 50 else _least("bucket"))))
    return run.groupBy(*by, "ratio").agg(*[at(q).alias(f"q{q}") for q in QUANTILES], F.max("total").alias("docs"))


def thresholds(sketch: DataFrame, min_group: int = MIN_GROUP) -> DataFrame:
    """One row per (lang, source): max_* of every ratio and min_* of those with a lower limit."""
    told = lambda by: quantiles(sketch, by).withColumns(
        {"up": F.expr(UPPER_SQL), "low": F.expr(LOWER_SQL)}).select(*by, "ratio", "docs", "up", "low")
    own = told(["lang", "source"])
    lang = told(["lang"]).select(F.col("lang").alias("_l"), F.col("ratio").alias("_r"), F.col("docs").alias("lang_docs"),
                                 F.col("up").alias("lang_up"), F.col("low").alias("lang_low"))
    whole = told([]).select(F.col("ratio").alias("_q"), F.col("up").alias("all_up"), F.col("low").alias("all_low"))
    both = (own.join(lang, own["lang"].eqNullSafe(lang["_l"]) & (own["ratio"] == lang["_r"]))
            .join(whole, F.col("ratio") == F.col("_q")))
    pick = lambda c: F.when(F.col("docs") >= min_group, F.col(c)).when(
        F.col("lang_docs") >= min_group, F.col(f"lang_{c}")).otherwise(F.col(f"all_{c}"))
    of = lambda c, k: F.max(F.when(F.col("ratio") == k, pick(c)))
    return both.groupBy("lang", "source").agg(*[of("up", k).alias(f"max_{k}") for k in RATIOS],
                                              *[of("low", k).alias(f"min_{k}") for k in LOWER])


LIMITS = [*(f"max_{k}" for k in RATIOS), *(f"min_{k}" for k in LOWER)]


def judge(docs: DataFrame, text_col: str = "text", min_group: int = MIN_GROUP) -> DataFrame:
    """Statistics, the group's limits (max_*, min_*; null where no row of the group passes the base rule), base_failed and kept of every
    row; columns of ``docs`` with one of these names are replaced."""
    made = {"n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", *LIMITS}
    stats = common.saved(statistics(docs.select(*[c for c in docs.columns if c not in made]), text_col).drop(text_col))
    return _judged(stats, stats, min_group)


def _judged(stats: DataFrame, rows: DataFrame, min_group: int) -> DataFrame:
    limits = common.saved(thresholds(sketches(stats.where(~base_failed())), min_group))
    limits = limits.select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), *LIMITS)
    if limits.count() <= BROADCAST_GROUPS:
        limits = F.broadcast(limits)
    df = rows.join(limits, rows["lang"].eqNullSafe(limits["_lang"]) & rows["source"].eqNullSafe(limits["_source"]), "left")
    within = F.lit(True)
    for k, (e, *_) in RATIOS.items():
        within = within & (F.expr(e) <= F.col(f"max_{k}"))
        if k in LOWER:
            within = within & (F.expr(e) >= F.col(f"min_{k}"))
    return (df.drop("_lang", "_source").withColumn("base_failed", base_failed())
            .withColumn("kept", ~F.col("base_failed") & F.coalesce(within, F.lit(False))))


def filter_documents(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows that the rules keep, with the columns of ``docs``.

    The rows are stored once with their statistics: the sketches read the
    statistics alone from there, the filter the texts. No text is shuffled or
    measured twice.
    """
    clean = docs.select(*[F.col(c).alias(f"_in_{c}") for c in docs.columns], "lang", "source", F.col(text_col).alias("_text"))
    rows = common.stored(statistics(clean, "_text").drop("_text"))
    kept = _judged(rows, rows, MIN_GROUP).where("kept")
    return kept.select(*[F.col(f"_in_{c}").alias(c) for c in docs.columns])


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: the base statistics, the base rule and the verdict."""
    d = common.documents(spark, sf_dir).select("doc_id", "lang", "source", "text")
    return judge(d).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                           "base_failed", "kept")


def _duck(e: str) -> str:
    return e.replace(" div ", " // ")


def _duck_bucket(x: str) -> str:
    bits = f"length(ltrim(bin({x}), '0'))"
    return f"CASE WHEN {x} < 128 THEN {x} ELSE 128 * {bits} + (({x} >> greatest({bits} - 8, 0)::BIGINT) - 128) END"


def _duck_limits(name: str, by: str) -> str:
    g = f"{by}, " if by else ""
    return f"""
 {name}_m AS (SELECT {g}ratio, bucket, sum(n)::BIGINT AS n FROM sketch GROUP BY {g}ratio, bucket),
 {name}_r AS (SELECT *, sum(n) OVER (PARTITION BY {g}ratio ORDER BY bucket) AS up_to, sum(n) OVER (PARTITION BY {g}ratio) AS total,
    CASE WHEN bucket < 128 THEN bucket ELSE ((129 + bucket % 128) << (bucket // 128 - 8)::BIGINT) - 1 END AS top,
    CASE WHEN bucket < 128 THEN bucket ELSE (128 + bucket % 128) << (bucket // 128 - 8)::BIGINT END AS least FROM {name}_m),
 {name}_q AS (SELECT {g}ratio, max(total) AS docs, {", ".join(f"min(CASE WHEN up_to * 100 >= total * {q} THEN {'top' if q >= 50 else 'least'} END) AS q{q}" for q in QUANTILES)}
    FROM {name}_r GROUP BY {g}ratio),
 {name} AS (SELECT {g}ratio, docs, {UPPER_SQL} AS up, {LOWER_SQL} AS low FROM {name}_q)"""


BASE_SQL = f"n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words"
#: DuckDB form over ``documents``; gives base statistics and verdicts in ``judged``.
QUALITY_SQL = rf"""
 t AS (SELECT *, coalesce(text, '') AS tx FROM documents),
 wd AS (SELECT * EXCLUDE (tx), tx, regexp_extract_all(tx, '{common.WORD}') AS w,
    list_filter(string_split(tx, chr(10)), lambda x: regexp_matches(x, '{common.WORD}')) AS ls FROM t),
 st AS (SELECT *, len(w)::BIGINT AS n_words, length(regexp_replace(tx, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    len(regexp_extract_all(tx, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines FROM wd),
 gr AS (SELECT doc_id, unnest(range(1, n_words - 3)) AS i, unnest(list_transform(range(1, n_words - 3),
    lambda i: array_to_string(w[i:i+4], ' '))) AS g FROM st WHERE n_words >= 5),
 rp AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM gr),
 cv AS (SELECT doc_id, sum(least(5, i - prev))::BIGINT AS n_repeat_words
    FROM (SELECT doc_id, i, coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -10) AS prev FROM rp WHERE c > 1) GROUP BY doc_id),
 stats AS (SELECT st.*, coalesce(cv.n_repeat_words, 0) AS n_repeat_words FROM st LEFT JOIN cv USING (doc_id)),
 ratios AS ({" UNION ALL ".join(f"SELECT lang, source, '{k}' AS ratio, {_duck_bucket('(' + _duck(e) + ')')} AS bucket FROM stats WHERE NOT ({BASE_SQL})" for k, (e, *_) in RATIOS.items())}),
 sketch AS (SELECT lang, source, ratio, bucket, count(*) AS n FROM ratios GROUP BY ALL),
 {_duck_limits('own', 'lang, source')}, {_duck_limits('lng', 'lang')}, {_duck_limits('whl', '')},
 lims AS (SELECT o.lang, o.source, o.ratio, {", ".join(f"CASE WHEN o.docs >= {MIN_GROUP} THEN o.{c} WHEN l.docs >= {MIN_GROUP} THEN l.{c} ELSE a.{c} END AS {c}" for c in ("up", "low"))}
    FROM own o JOIN lng l ON o.lang IS NOT DISTINCT FROM l.lang AND o.ratio = l.ratio JOIN whl a ON o.ratio = a.ratio),
 wide AS (SELECT lang, source, {", ".join([f"max(CASE WHEN ratio = '{k}' THEN up END) AS max_{k}" for k in RATIOS] + [f"max(CASE WHEN ratio = '{k}' THEN low END) AS min_{k}" for k in LOWER])}
    FROM lims GROUP BY lang, source),
 judged AS (SELECT s.*, ({BASE_SQL}) AS base_failed, NOT ({BASE_SQL}) AND coalesce(
    {" AND ".join([f"({_duck(e)}) <= max_{k}" for k, (e, *_) in RATIOS.items()] + [f"({_duck(RATIOS[k][0])}) >= min_{k}" for k in LOWER])}, false) AS kept
    FROM stats s LEFT JOIN wide x ON s.lang IS NOT DISTINCT FROM x.lang AND s.source IS NOT DISTINCT FROM x.source)
"""

QUERIES = {"op4_quality": op4_quality}
ORACLE = {"op4_quality": f"""WITH {QUALITY_SQL}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM judged"""}
