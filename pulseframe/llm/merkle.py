"""Merkle manifest of a dataset by lag and lead windows.

Every row is a leaf: the SHA-256 of its fields, null as ``-``, any other value
as UTF-8 byte count, ``:``, value. Per group the leaves ascend by the order
column, and while several nodes remain, every ``fanout`` consecutive ones
become the hash of their digests. The groups' roots, ordered by group with
null first, give the dataset's root in the same way.

The rows of a group are numbered by range partitioning and offsets
(``ordering.positions``) and cut into aligned blocks of ``fanout ** levels``
leaves, so a window holds one block however large the group is. Within a block
the node of level l stands on its first leaf. Lag and lead columns at multiples
of ``fanout ** l`` rows, masked by the node's slot and by the length of its
run, supply the siblings; first-child rows hash the parents. The siblings of a
leaf's ancestors are the last ones written at or before it. Block roots are
the leaves of the next round, until one block is left. Texts are hashed where
they are read; only digests are shuffled.

Ties of the order column ascend by leaf digest; equal rows have equal leaves
and take their places in any order. Null order values come first. A null group
is a group of its own, apart from the empty string. A lone leaf is its
group's root and has no siblings. An empty table gives an empty result. Other
columns are ignored unless named in ``keep``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pulseframe.llm import common
from pulseframe.llm.ordering import positions

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FANOUT = 2
#: Levels climbed within one window: blocks of fanout ** LEVELS leaves.
LEVELS = 10
_SPLIT = "|"  # between the siblings on the left and on the right of a node


def digest(*values: Column) -> Column:
    """H: lowercase hex SHA-256 of the values, concatenated."""
    return F.sha2(F.concat(*values), 256)


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(values: dict[str, Column]) -> Column:
    """Digest of a row's fields, in the order of the dictionary."""
    return digest(*[field(v) for v in values.values()])


def _climb(nodes: DataFrame, group: list[str], fanout: int, levels: int) -> DataFrame:
    """(group, _pos, _n, _h, ...) plus _block, _top (on a block's first row) and
    _path: left and right siblings of every ancestor below the block's root."""
    block = fanout ** levels
    nodes = nodes.withColumn("_block", F.floor(F.col("_pos") / block).cast("long")).withColumn("_cur", F.col("_h"))
    w = Window.partitionBy(*group, "_block").orderBy("_pos")
    for level in range(levels):
        step = fanout ** level
        many = F.col("_n") > step  # more than one node on this level
        index = F.floor(F.col("_pos") / step)
        slot = index % fanout
        run = F.least(F.lit(fanout), F.ceil(F.col("_n") / step) - (index - slot))
        offsets = range(1, fanout)
        nodes = nodes.withColumns({f"_lag{j}": F.lag("_cur", j * step).over(w) for j in offsets}
                                  | {f"_lead{j}": F.lead("_cur", j * step).over(w) for j in offsets})
        left = F.concat(*[F.coalesce(F.when(slot >= j, F.col(f"_lag{j}")), F.lit("")) for j in reversed(offsets)])
        right = F.concat(*[F.coalesce(F.when(slot + j < run, F.col(f"_lead{j}")), F.lit("")) for j in offsets])
        node = F.col("_pos") % step == 0
        nodes = nodes.withColumns({
            f"_s{level}": F.when(many & node, F.concat(left, F.lit(_SPLIT), right)),
            "_cur": F.when(many & node & (slot == 0), digest(F.col("_cur"), right)).when(~many, F.col("_cur"))})
        nodes = nodes.drop(*[f"_{k}{j}" for k in ("lag", "lead") for j in offsets])
    seen = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    path = F.array(*[F.last(f"_s{level}", ignorenulls=True).over(seen) for level in range(levels)]).cast("array<string>")
    return (nodes.withColumn("_path", F.array_compact(path)).withColumnRenamed("_cur", "_top")
            .drop(*[f"_s{level}" for level in range(levels)]))


def tree(nodes: DataFrame, group: list[str], fanout: int = FANOUT, levels: int = LEVELS) -> tuple[DataFrame, DataFrame]:
    """Trees over (group, _pos, _n, _h): the nodes with _path, and (group, _h)
    of every group's root. A round climbs ``levels`` levels; their number
    follows from the largest group."""
    largest = nodes.agg(F.max("_n")).first()[0] or 0
    rounds, at = [], nodes
    while True:
        needed = next(i for i in range(levels + 1) if i == levels or fanout ** i >= largest)
        block = fanout ** needed
        climbed = _climb(at, group, fanout, needed)
        rounds.append(climbed)
        roots = common.saved(climbed.where(F.col("_pos") % block == 0).select(
            *group, F.col("_block").alias("_pos"), F.ceil(F.col("_n") / block).cast("long").alias("_n"),
            F.col("_top").alias("_h")))
        if largest <= block:
            break
        largest, at = -(-largest // block), roots
    above = None
    for climbed in reversed(rounds):
        if above is not None:
            up = above.select(*group, F.col("_pos").alias("_block"), F.col("_path").alias("_up"))
            climbed = (climbed.join(up, [*group, "_block"])
                       .withColumn("_path", F.concat("_path", "_up")).drop("_up"))
        above = climbed
    return above, roots.select(*group, "_h")


def manifest(rows: DataFrame, leaves: dict[str, Column], group: str = "lang", order: str = "doc_id",
             fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """One row per input row: ``order``, ``group``, the leaf digests named by
    ``leaves`` (the first one builds the tree), subroot, root and path.

    ``path``: for every ancestor below the root, level by level, the digests of
    its left and right siblings, joined by ``|``.
    """
    main = next(iter(leaves))
    named = rows.select(F.col(order).alias("_order"), F.col(group).alias("_group"),
                        F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("")).alias("_g"),
                        *[c.alias(k) for k, c in leaves.items()])
    placed = positions(named, ["_g"], ["_order", main]).withColumn("_h", F.col(main))
    nodes, roots = tree(placed, ["_g"], fanout, levels)
    tops, root = tree(positions(roots, [], ["_g"]), [], fanout, levels)
    tops = tops.select("_g", F.col("_h").alias("subroot"), F.col("_path").alias("_over"))
    root = root.select(F.col("_h").alias("root"))  # one row
    return (nodes.join(tops, "_g").crossJoin(F.broadcast(root))
            .select(F.col("_order").alias(order), F.col("_group").alias(group), *leaves, "subroot", "root",
                    F.concat("_path", "_over").alias("path")))


def proof_digest(path: Column) -> Column:
    """Digest of all siblings of a path, level by level, left to right."""
    return F.sha2(F.replace(F.array_join(path, ""), F.lit(_SPLIT), F.lit("")), 256)


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf digest and its siblings give."""
    return F.aggregate(path, start, lambda h, s: digest(F.substring_index(s, _SPLIT, 1), h, F.substring_index(s, _SPLIT, -1)))


def tampered(every: int = 7, order: str = "doc_id") -> Column:
    """Rows whose CRC-32 of the decimal id is divisible by ``every`` (a null id is not)."""
    return F.coalesce(F.crc32(F.col(order).cast("string").cast("binary")) % every == 0, F.lit(False))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its leaf, its language's root, the dataset's root, the
    digest of its proof, and whether the proof holds for the row as it may
    have been tampered with."""
    values = {c: F.col(c) for c in FIELDS}
    changed = values | {"n_chars": F.col("n_chars") + 1}
    leaves = {"leaf": leaf(values), "altered": F.when(tampered(), leaf(changed))}
    proved = manifest(common.documents(spark, sf_dir).select(*FIELDS), leaves)
    return (proved.withColumn("folded_root", fold(F.coalesce("altered", "leaf"), F.col("path")))
            .select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"),
                    "folded_root", (F.col("folded_root") == F.col("root")).alias("verified")))


QUERIES = {"op11_merkle": op11_merkle}


def _leaf_sql(n_chars: str) -> str:
    names = [n_chars if f == "n_chars" else f for f in FIELDS]
    return "sha256(" + " || ".join(
        f"coalesce(strlen({v}::VARCHAR) || ':' || {v}::VARCHAR, '-')" for v in names) + ")"


ORACLE = {"op11_merkle": f"""
WITH RECURSIVE crc_table AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)),
    lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c FROM range(256) r(i))),
 rows_ AS (SELECT doc_id, lang, {_leaf_sql('n_chars')} AS leaf, {_leaf_sql('(n_chars + 1)')} AS changed,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: ascii(substr(doc_id::VARCHAR, i, 1))::BIGINT)),
      lambda c, b: xor(c // 256, t[xor(c, b) % 256 + 1])), 4294967295::BIGINT) AS crc FROM documents, crc_table),
 leaves AS (SELECT *, CASE WHEN crc % 7 = 0 THEN changed ELSE leaf END AS shown,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM rows_),
 nodes AS (SELECT lang, 0 AS lvl, pos AS idx, leaf AS h, count(*) OVER (PARTITION BY lang) AS cnt FROM leaves
  UNION ALL SELECT lang, lvl, idx, h, count(*) OVER (PARTITION BY lang) AS cnt FROM (
    SELECT lang, lvl + 1 AS lvl, idx // 2 AS idx, sha256(string_agg(h, '' ORDER BY idx)) AS h FROM nodes WHERE cnt > 1 GROUP BY lang, lvl, idx // 2)),
 subroots AS (SELECT lang, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos FROM nodes WHERE cnt = 1),
 tops AS (SELECT 0 AS lvl, pos AS idx, h, count(*) OVER () AS cnt FROM subroots
  UNION ALL SELECT lvl, idx, h, count(*) OVER () AS cnt FROM (
    SELECT lvl + 1 AS lvl, idx // 2 AS idx, sha256(string_agg(h, '' ORDER BY idx)) AS h FROM tops WHERE cnt > 1 GROUP BY lvl, idx // 2)),
 steps AS (
  SELECT l.lang, l.pos, n.lvl, (l.pos >> n.lvl) % 2 AS slot, o.h AS sib FROM leaves l
    JOIN (SELECT DISTINCT lang, lvl FROM nodes WHERE cnt > 1) n ON l.lang IS NOT DISTINCT FROM n.lang
    LEFT JOIN nodes o ON o.lang IS NOT DISTINCT FROM l.lang AND o.lvl = n.lvl AND o.idx = xor(l.pos >> n.lvl, 1)
  UNION ALL SELECT l.lang, l.pos, 1000 + n.lvl, (s.pos >> n.lvl) % 2, o.h FROM leaves l JOIN subroots s ON l.lang IS NOT DISTINCT FROM s.lang
    CROSS JOIN (SELECT DISTINCT lvl FROM tops WHERE cnt > 1) n LEFT JOIN tops o ON o.lvl = n.lvl AND o.idx = xor(s.pos >> n.lvl, 1)),
 paths AS (SELECT lang, pos, sha256(string_agg(coalesce(sib, ''), '' ORDER BY lvl)) AS proof,
    list(CASE WHEN sib IS NULL THEN '=' WHEN slot = 1 THEN '<' || sib ELSE '>' || sib END ORDER BY lvl) AS path FROM steps GROUP BY lang, pos)
SELECT l.doc_id, l.leaf, s.h AS subroot, r.h AS root, coalesce(p.proof, sha256('')) AS proof_sha256, f.folded AS folded_root, f.folded = r.h AS verified
FROM leaves l JOIN subroots s ON l.lang IS NOT DISTINCT FROM s.lang CROSS JOIN (SELECT h FROM tops WHERE cnt = 1) r
LEFT JOIN paths p ON p.lang IS NOT DISTINCT FROM l.lang AND p.pos = l.pos,
LATERAL (SELECT list_reduce(list_prepend(l.shown, coalesce(p.path, [])), lambda a, x: sha256(
  CASE x[1] WHEN '<' THEN x[2:] || a WHEN '>' THEN a || x[2:] ELSE a END)) AS folded) f"""}
