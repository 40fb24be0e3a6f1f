"""Mixing sources to target weights by Sainte-Lague apportionment.

Every source has a weight and shares the total size; no target exceeds
``max_repeats`` times the source's size, the excess goes to the other sources
by weight until none is above. Each source's documents are dealt into shards by
a seeded hash, and a (source, shard) party's part of the target is measured in
equal-token blocks. The house is fixed: as many blocks as the targets hold in
all. They go to the parties with the highest quotients part / (2j - 1).

The highest quotients are found without listing them all. For a divisor d a
party has floor(part / d + 1/2) quotients of d / 2 or more, so a grid of divisors,
refined around the house a few times, leaves a narrow bracket: what lies above
it is seated by that count, and the quotients inside it are listed, ranked
(ties by source in code-point order, then shard) and seated in turn.

A shard lays its documents end to end in seeded order, cuts them into blocks,
takes whole rounds of itself while its quota covers them, and then the first
blocks of the seeded order; a document goes with the block that holds its
middle.

Only (doc_id, source, size) and one row per source or shard are shuffled. A
hot source is spread over shards of bounded size; the window over a source is
never opened, only the one over a shard. Sources and parties are numbered by
range partitioning, so their number is not bounded by a task; sums over them
reach the driver as one row per round.

Null texts have size 0 and are never taken; the null source comes last, null
ids order before others within a shard. Rows repeated under one id are dealt
one by one. Results depend on ids, sizes and the seed alone, so reruns agree.
An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pulseframe.llm import common
from pulseframe.llm.ordering import positions

BLOCK_TOKENS = 4
SHARD_TOKENS = 1_000_000
MAX_REPEATS = 3
SEED = 17
#: Divisors tried per round, rounds, and the bracket that needs no further one.
GRID, ROUNDS, NARROW = 64, 8, 4096


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeats: int = MAX_REPEATS) -> DataFrame:
    """One row per source: source, source_size, rank, weight, target.

    ``sizes``: (source, size). Sources in code-point order, null last, weigh
    ``weights`` in turn. Every round caps the sources that the level per unit
    of weight would lift above their limit and shares the rest anew; a round
    is one aggregate over the sources.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("_last", F.col("source").isNull())
    per = positions(per, [], ["_last", "source"], pos="rank", size="_sources").drop("_last", "_sources")
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    per = common.saved(per.withColumn("weight", w.cast("double")).withColumn("_cap", (F.col("source_size") * max_repeats).cast("double")))
    total, weight = per.agg(F.sum("source_size").cast("double"), F.sum("weight")).first()
    level = (total or 0.0) / (weight or 1.0)
    while total:
        over = F.col("_cap") < level * F.col("weight")
        capped, left = per.agg(F.sum(F.when(over, F.col("_cap")).otherwise(0.0)), F.sum(F.when(over, 0.0).otherwise(F.col("weight")))).first()
        nxt = (total - capped) / left if left else level
        if nxt <= level:
            break
        level = nxt
    return per.withColumn("target", F.least(F.col("_cap"), F.lit(level) * F.col("weight"))).drop("_cap")


def _seats(part, divisor):
    """Quotients part / (2j - 1) of half the divisor or more."""
    return F.floor(part / divisor + 0.5)


def apportion(parties: DataFrame, block: int, order: tuple[str, ...]) -> DataFrame:
    """(..., part) with blocks: a house of round(sum of parts / block) seats by
    the highest quotients, ties in the order of the columns ``order``.

    Sums over all parties reach the driver, at most GRID of them at a time.
    """
    parties = common.saved(parties)
    total, n, largest = parties.where("part > 0").agg(F.sum("part"), F.count("*"), F.max("part")).first()
    if not n:
        return parties.withColumn("blocks", F.lit(0).cast("long"))
    house = int(total / block + 0.5)

    def seated(divisors: list[float]) -> list[int]:
        row = parties.agg(*[F.sum(_seats(F.col("part"), d)).alias(f"s{i}") for i, d in enumerate(divisors)]).first()
        return [int(x) for x in row]

    # Every party has its exact share less or more half a seat at most.
    low = total / (house + n / 2 + 1)
    high = min(2.0 * largest + 1, total / (house - n / 2)) if house > n / 2 else 2.0 * largest + 1
    high = max(high * (1 + 1e-9), low)
    at_low, at_high = seated([low, high])
    for _ in range(ROUNDS):
        if at_low - at_high <= NARROW or at_high >= house:
            break
        # Even steps of 1 / divisor: seats grow about evenly with it.
        grid = [1 / (1 / high + (1 / low - 1 / high) * i / (GRID + 1)) for i in range(1, GRID + 1)]
        found = [(high, at_high), *zip(grid, seated(grid), strict=True), (low, at_low)]
        k = next(i for i, (_, s) in enumerate(found) if s >= house)
        if k == 0 or (found[k - 1][1], found[k][1]) == (at_high, at_low):
            break
        (high, at_high), (low, at_low) = found[k - 1], found[k]
    sure = _seats(F.col("part"), high).cast("long")
    if at_high >= house:  # only by rounding of the divisor
        return parties.withColumn("blocks", sure)
    more = (parties.select(*order, "part", sure.alias("_sure"), _seats(F.col("part"), low).cast("long").alias("_most"))
            .where("_most > _sure").withColumn("_j", F.explode(F.sequence(F.col("_sure") + 1, F.col("_most"))))
            .withColumn("_q", -F.col("part") / (2 * F.col("_j") - 1)))
    ranked = positions(more.select(*order, "_q", "_j"), [], ["_q", *order], pos="_at", size="_all").where(F.col("_at") < house - at_high)
    extra = ranked.groupBy(*order).agg(F.count("*").alias("_extra"))
    return (parties.join(extra, list(order), "left")
            .withColumn("blocks", sure + F.coalesce("_extra", F.lit(0))).drop("_extra"))


def mix(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), block_tokens: int = BLOCK_TOKENS,
        shard_tokens: int = SHARD_TOKENS, max_repeats: int = MAX_REPEATS, seed: int = SEED) -> DataFrame:
    """(doc_id, source, size, ...) -> the same rows with source_size, target and taken.

    ``taken`` is ``size`` times the number of copies the mix takes. Columns of
    ``sizes`` beyond the three are kept.
    """
    extra = [c for c in sizes.columns if c not in ("doc_id", "source", "size")]
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    docs = common.saved(sizes.withColumn("_key", key))
    targets = common.saved(source_targets(docs.select("source", "size"), weights, max_repeats))
    t = targets.select(F.col("source").alias("_s"), "source_size", "target", F.col("rank").alias("_rank"))
    docs = docs.join(t, docs["source"].eqNullSafe(t["_s"])).drop("_s")
    n_shards = F.greatest(F.ceil(F.col("source_size") / shard_tokens), F.lit(1))
    shard = F.conv(F.substring("_key", 1, 8), 16, 10).cast("long") % n_shards
    docs = docs.withColumn("_shard", shard)
    parties = docs.groupBy("_rank", "_shard").agg(F.sum("size").alias("_z"), F.first("source_size").alias("_size"), F.first("target").alias("_target"))
    parties = parties.withColumn("part", F.when(F.col("_size") > 0, F.col("_target") * F.col("_z") / F.col("_size")).otherwise(0.0))
    quotas = apportion(parties.select("_rank", "_shard", "_z", "part"), block_tokens, ("_rank", "_shard"))
    quotas = quotas.select("_rank", "_shard", "_z", F.least(F.col("blocks") * block_tokens, F.col("_z") * max_repeats).alias("_quota"))
    laid = (Window.partitionBy("_rank", "_shard").orderBy("_key", "doc_id", "size", *extra)
            .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    docs = docs.withColumn("_end", F.sum("size").over(laid)).join(quotas, ["_rank", "_shard"])
    rounds = F.when(F.col("_z") > 0, F.floor(F.col("_quota") / F.col("_z"))).otherwise(0)
    rest = F.col("_quota") - rounds * F.col("_z")
    more = F.when(2 * F.col("_end") - F.col("size") < 2 * rest, 1).otherwise(0)
    taken = F.when(F.col("size") == 0, 0).otherwise(F.col("size") * (rounds + more))
    return docs.select("doc_id", "source", "size", *extra, "source_size", "target", taken.cast("long").alias("taken"))


def word_count(text: str = "text"):
    return F.coalesce(F.regexp_count(F.col(text), F.lit(common.WORD)), F.lit(0)).cast("long")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its size, its source's size and target, and the words taken."""
    docs = common.documents(spark, sf_dir)
    mixed = mix(docs.select("doc_id", "source", word_count().alias("size")))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def mix_documents(docs: DataFrame) -> DataFrame:
    """Documents of the mix, each repeated as often as it is taken.

    Documents are told apart by id, source and text, so rows that share an id
    but not a text keep their own counts. Columns of any name are kept.
    """
    cols = docs.columns
    tagged = (docs.select(F.struct(*[docs[c] for c in cols]).alias("row"))
              .select("row", F.col("row.doc_id").alias("doc_id"), F.col("row.source").alias("source"),
                      word_count("row.text").alias("size"), F.xxhash64("row.text").alias("tag")))
    copies = (mix(tagged.select("doc_id", "source", "size", "tag"))
              .where("taken > 0")
              .select(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("tag").alias("_t"),
                      (F.col("taken") / F.col("size")).cast("int").alias("_n"))
              .groupBy("_id", "_source", "_t").agg(F.sum("_n").cast("int").alias("_n"), F.count("*").alias("_rows")))
    w = Window.partitionBy("doc_id", "source", "tag").orderBy("doc_id")
    joined = tagged.join(copies, tagged["doc_id"].eqNullSafe(copies["_id"]) & tagged["source"].eqNullSafe(copies["_source"])
                         & (tagged["tag"] == copies["_t"]))
    # Identical rows share their copies: the first takes the remainder.
    each = F.when(F.col("_rows") == 1, F.col("_n")).otherwise(
        F.floor(F.col("_n") / F.col("_rows")) + (F.row_number().over(w) <= F.col("_n") % F.col("_rows")).cast("int"))
    return (joined.withColumn("_each", each.cast("int")).where("_each > 0")
            .withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_each")))).select("row.*"))


#: The same computation in DuckDB over a relation of (doc_id, source, size).
MIX_SQL = f"""
 per AS (SELECT source, sum(size)::BIGINT AS source_size FROM sizes GROUP BY source),
 ranked AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS rnk FROM per),
 weighed AS (SELECT *, (rnk % 3 + 1)::DOUBLE AS weight, ({MAX_REPEATS} * source_size)::DOUBLE AS cap FROM ranked),
 tot AS (SELECT sum(source_size)::DOUBLE AS total, sum(weight) AS weight_sum FROM weighed),
 filling AS (SELECT w.*, total,
    (total - coalesce(sum(cap) OVER f, 0.0)) / (weight_sum - coalesce(sum(weight) OVER f, 0.0)) AS lvl,
    row_number() OVER (ORDER BY cap / weight, rnk) AS pos
    FROM weighed w, tot WINDOW f AS (ORDER BY cap / weight, rnk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 water AS (SELECT arg_min(lvl, pos) AS water FROM filling WHERE lvl * weight <= cap),
 targets AS (SELECT source, source_size, rnk, CASE WHEN total = 0 THEN 0.0 ELSE least(cap, coalesce(water * weight, cap)) END AS target
    FROM filling, water),
 dealt AS (SELECT s.*, t.source_size, t.target, t.rnk, md5('{SEED}:' || coalesce(s.doc_id::VARCHAR, '')) AS k
    FROM sizes s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
 sharded AS (SELECT *, ('0x' || substr(k, 1, 8))::BIGINT % greatest(ceil(source_size / {SHARD_TOKENS}.0)::BIGINT, 1) AS shard FROM dealt),
 laid AS (SELECT *, sum(size) OVER (PARTITION BY rnk, shard ORDER BY k, doc_id, size ROWS UNBOUNDED PRECEDING) AS fin FROM sharded),
 parties AS (SELECT rnk, shard, sum(size) AS z, 
    any_value(target) * sum(size) / nullif(any_value(source_size), 0) AS part FROM sharded GROUP BY rnk, shard),
 quotients AS (SELECT rnk, shard, part / (2 * j - 1) AS q FROM (SELECT *, unnest(range(1, 21 + (part * 3 / {BLOCK_TOKENS})::BIGINT)) AS j
    FROM parties WHERE part > 0)),
 seats AS (SELECT rnk, shard, count(*) AS blocks FROM (SELECT *, row_number() OVER (ORDER BY q DESC, rnk, shard) AS place FROM quotients)
    WHERE place <= (SELECT floor(sum(part) / {BLOCK_TOKENS} + 0.5) FROM parties) GROUP BY rnk, shard),
 quotas AS (SELECT l.*, z, least(coalesce(blocks, 0) * {BLOCK_TOKENS}, z * {MAX_REPEATS}) AS quota
    FROM laid l JOIN parties USING (rnk, shard) LEFT JOIN seats USING (rnk, shard)),
 taken AS (SELECT doc_id, source, size, source_size, target,
    CASE WHEN size = 0 THEN 0 ELSE size * (floor(quota / z) + CASE WHEN 2 * fin - size < 2 * (quota - floor(quota / z) * z) THEN 1 ELSE 0 END)
    END::BIGINT AS taken FROM quotas)
"""

QUERIES = {"op10_mixing": op10_mixing}
ORACLE = {"op10_mixing": rf"""
WITH sizes AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{common.WORD}'))::BIGINT AS size FROM documents),
{MIX_SQL}
SELECT doc_id, size, source_size, target, taken FROM taken"""}
