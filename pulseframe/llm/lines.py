"""Line deduplication by a deletion-neighbourhood join (DataFrame and SQL
functions only).

Lines are the ``\\n``-separated pieces of a text; those with a word take part,
blank ones always stay. A line goes if an earlier line (smaller doc_id, or same
document and smaller line number) has the same words; so short lines and lines
of scripts without spaces are covered. Where both have ``MIN_WORDS`` or more
words, it also goes if they differ in one word: one replaced, inserted or left
out. Lines are judged on the input, so the earliest of each neighbourhood stays.

1. Equal lines meet by their hash (two 64-bit hashes of all words); the
   earliest stays as their only representative.
2. One edit lies in one half of a line and leaves the other half as it is.
   Lines whose halves (taken for their own word count and for one word less)
   no different line shares have no neighbour and drop out here, without loss.
   The words of the others are read once more; a bitmap of fixed size over
   their positions spares the rest the shuffle.
3. They emit their variants with one word deleted (in the halves that may
   differ) as hashed keys. Equal variants at the same position join lines that
   differ by a replaced word; a variant that equals a whole line, cut at the
   same place, joins those that differ by one word more or less.
4. Every line keeps the earliest partner of each key only (a minimum, combined
   map-side, never the pairs of a group), and the edit is verified on the
   words themselves.

Null and empty texts have no lines that take part. Null ids sort after all
others. Rows that share an id share positions: they do not remove each other's
lines at the same line number. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseframe.llm import common

#: Shorter lines are compared for equality alone.
MIN_WORDS = 8
#: Bits of the bitmap over positions (2 MB when broadcast, whatever the corpus).
BITMAP_BITS = 1 << 24
_STEP = 2147483648


def _words(line: str) -> Column:
    return F.array_remove(F.split(F.col(line), r"[\x20\x09-\x0D]+"), "")


def _position(doc: str, line: str) -> Column:
    """(doc_id, line number) as one ordered number; null ids last."""
    return (F.coalesce(F.col(doc).cast("decimal(20,0)"), F.lit(str(2**63)).cast("decimal(20,0)")) * F.lit(_STEP).cast("decimal(10,0)")
            + F.col(line)).cast("decimal(38,0)")


def _hashed(lines: DataFrame) -> DataFrame:
    """Add the word count, two hashes of all words, and the hashes of the
    halves: head and tail for n words, head and tail for n - 1 (none for lines
    too short for an edit)."""
    def half(side: int, n: str) -> str:
        h = f"({n} div 2)"
        return f"xxhash64({side}, {n}, slice(w, 1, {h}))" if side == 0 else f"xxhash64(1, {n}, slice(w, {h} - {n}, {n} - {h}))"

    return (lines.withColumn("n", F.size("w")).where("n > 0")
            .withColumn("h", F.xxhash64("w")).withColumn("g", F.xxhash64(F.lit(2), F.col("w")))
            .withColumn("halves", F.expr(f"CASE WHEN n >= {MIN_WORDS} THEN array({half(0, 'n')}, {half(1, 'n')}, {half(0, '(n - 1)')}, {half(1, '(n - 1)')})"
                                         " ELSE cast(array() AS array<bigint>) END")))


def _in_bitmap(rows: DataFrame, wanted: DataFrame, *key: str) -> DataFrame:
    """Rows whose key may be among the wanted ones: a fixed number of hashed
    bits, so false hits only, and a broadcast of a fixed size."""
    bit = F.pmod(F.xxhash64(*key), F.lit(BITMAP_BITS)).cast("long")
    maps = (wanted.select(bit.alias("bit")).groupBy((F.col("bit") / 32768).cast("int").alias("_part"))
            .agg(F.bitmap_construct_agg(F.col("bit") % 32768).alias("_bits")))
    rows = rows.withColumn("_bit", bit).withColumn("_part", (F.col("_bit") / 32768).cast("int"))
    byte = F.expr("conv(hex(substring(_bits, cast(_bit % 32768 div 8 AS int) + 1, 1)), 16, 10)").cast("int")
    met = rows.join(F.broadcast(maps), "_part").withColumn("_byte", byte)
    return met.where(F.expr("shiftright(_byte, cast(_bit % 8 AS int)) % 2 = 1")).drop("_part", "_bit", "_bits", "_byte")


def _deletions(texts: DataFrame) -> DataFrame:
    """(pos, n, i, v, gap): the line without word i (from 1), and the line cut
    before it (up to n + 1), as hashes of what stands before and after. Position-dependent
    hashes are summed along the line, so a variant costs the same in a long
    line as in a short one; sums of 40-bit hashes stay exact. Only positions
    in a half that may differ: ``head`` (the first half is shared), ``tail``."""
    from pyspark.sql.window import Window

    words = texts.select("pos", "n", "head", "tail", F.posexplode("w").alias("j", "x"))
    words = words.select("pos", "n", "head", "tail", (F.col("j") + 1).alias("i"),
                         F.shiftrightunsigned(F.xxhash64("x", "j"), 24).alias("front"),
                         F.shiftrightunsigned(F.xxhash64("x", F.col("n") - F.col("j")), 24).alias("back"))
    line = Window.partitionBy("pos").orderBy("i")
    run = line.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rest = line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sums = words.select("pos", "n", "head", "tail", "i", "front", "back", F.sum("front").over(run).alias("to"),
                        (F.sum("back").over(rest) - F.sum("back").over(run)).alias("after"))
    own = F.struct("i", F.xxhash64(F.col("to") - F.col("front"), "after").alias("v"),
                   F.xxhash64(F.col("to") - F.col("front"), F.col("after") + F.col("back")).alias("gap"))
    end = F.struct((F.col("i") + 1).alias("i"), F.lit(None).cast("long").alias("v"),
                   F.xxhash64(F.col("to"), F.lit(0).cast("long")).alias("gap"))
    cuts = sums.select("pos", "n", "head", "tail", F.explode(F.when(F.col("i") == F.col("n"), F.array(own, end)).otherwise(F.array(own))).alias("c"))
    cuts = cuts.select("pos", "n", "head", "tail", "c.*")
    return cuts.where(F.expr("(head AND i > (n - 1) div 2) OR (tail AND i <= n div 2 + 1)")).select("pos", "n", "i", "v", "gap")


def _near(texts: DataFrame) -> DataFrame:
    """Representatives (pos, n, h, w) with a verified earlier neighbour:
    (pos, witness), up to three rows a line."""
    cuts = common.stored(_deletions(texts))
    variants = cuts.where("v IS NOT NULL").select("pos", "n", "i", "v")
    # One word replaced: equal variants at one position of equally long lines.
    earliest = (variants.groupBy("n", "i", "v").agg(F.min("pos").alias("witness"), F.count("*").alias("c"))
                .where("c > 1").drop("c"))
    replaced = variants.join(earliest, ["n", "i", "v"]).where("pos > witness").select("pos", "witness", "i")
    # One word more or less: a variant that is a whole line, cut at the same place.
    whole = cuts.select((F.col("n") + 1).alias("n"), "i", F.col("gap").alias("v"), F.col("pos").alias("short"))
    met = variants.join(whole, ["n", "i", "v"]).select(F.col("pos").alias("long"), "short", "i")
    longer = met.where("long > short").groupBy("long").agg(F.min(F.struct("short", "i")).alias("s"))
    shorter = met.where("long < short").groupBy("short").agg(F.min(F.struct("long", "i")).alias("s"))
    found = (replaced.groupBy("pos").agg(F.min(F.struct("witness", "i")).alias("s"))
             .select("pos", F.col("s.witness").alias("witness"), F.col("s.i").alias("i"), F.lit("replaced").alias("kind"))
             .unionByName(longer.select(F.col("long").alias("pos"), F.col("s.short").alias("witness"), F.col("s.i").alias("i"),
                                        F.lit("longer").alias("kind")))
             .unionByName(shorter.select(F.col("short").alias("pos"), F.col("s.long").alias("witness"), F.col("s.i").alias("i"),
                                         F.lit("shorter").alias("kind"))))
    own, other = texts.select("pos", F.col("w").alias("a")), texts.select(F.col("pos").alias("witness"), F.col("w").alias("b"))
    cut = lambda x: f"concat(slice({x}, 1, i - 1), slice({x}, i + 1, size({x}) - i))"
    true = F.expr(f"CASE kind WHEN 'replaced' THEN size(a) = size(b) AND {cut('a')} = {cut('b')}"
                  f" WHEN 'longer' THEN {cut('a')} = b ELSE a = {cut('b')} END")
    # Nothing that needs the rows of one witness together follows, so that a
    # join on a witness with very many near copies may be split.
    return found.join(own, "pos").join(other, "witness").where(true).select("pos", "witness")


def removed_lines(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, tag, line_no) of every line that goes; ``tag`` is the text's
    64-bit hash, line numbers count from 0."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("tag"), F.col(text_col).alias("text"))
    split = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    exploded = docs.select("doc_id", "tag", F.posexplode(split).alias("line_no", "line"))
    hashed = _hashed(exploded.select("doc_id", "tag", "line_no", _words("line").alias("w"))).drop("w")
    lines = common.stored(hashed).withColumn("pos", _position("doc_id", "line_no"))
    # Representatives: the earliest of each set of equal lines.
    rep = common.stored(lines.groupBy("h", "g").agg(F.min("pos").alias("first"), F.first("n").alias("n")))
    halves = lines.select("h", F.posexplode("halves").alias("side", "half"))
    shared = (halves.groupBy("half").agg(F.min("h").alias("a"), F.max("h").alias("b")).where("a != b").select("half"))
    wanted = (halves.join(shared, "half").groupBy("h")
              .agg(F.max(F.col("side") % 2 == 0).alias("head"), F.max(F.col("side") % 2 == 1).alias("tail")))
    wanted = common.saved(rep.join(wanted, "h").select(F.col("first").alias("pos"), "h", "g", "head", "tail"))
    # Their words are read from the documents once more.
    again = exploded.select(_position("doc_id", "line_no").alias("pos"), "line")
    texts = _in_bitmap(again, wanted, "pos").join(wanted, "pos").select("*", _words("line").alias("w"))
    texts = (texts.where((F.xxhash64("w") == F.col("h")) & (F.xxhash64(F.lit(2), F.col("w")) == F.col("g")))
             .select("pos", F.size("w").alias("n"), "head", "tail", "w"))
    near = common.saved(_near(common.stored(texts)))
    gone = near.select(F.col("pos").alias("first")).distinct().withColumn("near", F.lit(True))
    judged = lines.select("doc_id", "tag", "line_no", "pos", "h", "g").join(
        rep.select("h", "g", "first").join(gone, "first", "left"), ["h", "g"])
    return judged.where("pos > first OR near").select("doc_id", "tag", "line_no")


def dedup_lines(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``docs`` without the lines that go; other columns (and texts that lose
    no line) are unchanged. A text that loses all its lines becomes empty."""
    gone = (removed_lines(docs, text_col, id_col).groupBy("doc_id", "tag").agg(F.collect_set("line_no").alias("_gone"))
            .select(F.col("doc_id").alias("_id"), F.col("tag").alias("_tag"), "_gone"))
    joined = docs.join(gone, docs[id_col].eqNullSafe(gone["_id"]) & (F.xxhash64(text_col) == gone["_tag"]), "left")
    lines = F.filter(F.split(F.col(text_col), "\n", -1), lambda x, i: ~F.array_contains("_gone", i))
    text = F.when(F.col("_gone").isNull(), F.col(text_col)).otherwise(F.array_join(lines, "\n"))
    return joined.withColumn("_text", text).select(*[F.col("_text").alias(c) if c == text_col else F.col(c) for c in docs.columns])


def op5_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its lines, how many go, and their numbers (joined by commas)."""
    docs = common.documents(spark, sf_dir).select("doc_id", "text")
    gone = (removed_lines(docs).groupBy("doc_id", "tag")
            .agg(F.count("*").alias("n_removed"), F.array_sort(F.collect_list("line_no")).alias("ls")))
    n_lines = F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1)).cast("long")
    docs = docs.select("doc_id", F.xxhash64("text").alias("_tag"), n_lines.alias("n_lines"))
    both = docs.join(gone.withColumnRenamed("doc_id", "_id"), docs["doc_id"].eqNullSafe(F.col("_id")) & (F.col("_tag") == F.col("tag")), "left")
    return both.select("doc_id", "n_lines", F.coalesce("n_removed", F.lit(0)).alias("n_removed"),
                       F.coalesce(F.array_join(F.col("ls").cast("array<string>"), ","), F.lit("")).alias("removed_lines"))


#: All variants of all lines, on strings: no hashes and no anchors.
ORACLE_LINES = rf"""
 l AS (SELECT doc_id, line_no, regexp_extract_all(line, '{common.WORD}') AS w FROM
   (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(0, len(string_split(coalesce(text, ''), chr(10))))) AS line_no
    FROM documents)),
 e AS (SELECT doc_id, line_no, len(w) AS n, w, array_to_string(w, ' ') AS s FROM l WHERE len(w) > 0),
 r AS (SELECT s, n, any_value(w) AS w, min(struct_pack(d := doc_id, l := line_no)) AS p FROM e GROUP BY s, n),
 v AS (SELECT p, n, s, i, array_to_string(w[1:i-1] || w[i+1:n], ' ') AS x FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM r WHERE n >= {MIN_WORDS})),
 rv AS (SELECT p, p > min(p) OVER (PARTITION BY n, i, x) AS late FROM v),
 mt AS (SELECT v.p AS longer, r.p AS shorter FROM v JOIN r ON v.n = r.n + 1 AND v.x = r.s AND r.n >= {MIN_WORDS}),
 near AS (SELECT p FROM rv WHERE late UNION SELECT longer FROM mt WHERE longer > shorter UNION SELECT shorter FROM mt WHERE shorter > longer),
 gone AS (SELECT e.doc_id, e.line_no FROM e JOIN r USING (s, n) WHERE struct_pack(d := e.doc_id, l := e.line_no) > r.p OR r.p IN (SELECT p FROM near))"""

QUERIES = {"op5_lines": op5_lines}
ORACLE = {"op5_lines": f"""WITH {ORACLE_LINES}
SELECT d.doc_id, len(string_split(coalesce(d.text, ''), chr(10)))::BIGINT AS n_lines, coalesce(c, 0)::BIGINT AS n_removed, coalesce(ls, '') AS removed_lines
FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS c, string_agg(line_no::VARCHAR, ',' ORDER BY line_no) AS ls FROM gone GROUP BY doc_id) g USING (doc_id)"""}
