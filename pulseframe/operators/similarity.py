"""Profiles alike: an exact cosine-threshold join over standardised columns."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from pulseframe.functions.semantics import to_num
from pulseframe.session import cut_lineage

#: The tree of cells has at most 2 ** _DEPTH leaves, placed by about _SAMPLED
#: rows for each; a task answers for at most 2 ** _TOGETHER leaves and, where
#: a leaf holds many blocks, _TURN blocks of each.
_DEPTH, _SAMPLED, _TOGETHER, _TURN = 14, 16, 5, 8


def _standardised(df: DataFrame, id_col: str, columns: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """(id, z0, z1, ...): missing values as 0, less the mean, over the
    population deviation (a constant column gives zeros)."""
    z = [f"z{i}" for i in range(len(columns))]
    x = df.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("id"), *[F.coalesce(to_num(c), F.lit(0.0)).alias(n) for c, n in zip(columns, z, strict=True)])
    fit = x.agg(*[f(n).alias(f"{k}_{n}") for n in z for k, f in (("m", F.avg), ("s", F.stddev_pop))])  # one row
    scaled = [F.when(F.col(f"s_{n}") > 0, (F.col(n) - F.col(f"m_{n}")) / F.col(f"s_{n}")).otherwise(0.0).alias(n) for n in z]
    return x.crossJoin(F.broadcast(fit)).select("id", *scaled), z


def _splits(points: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(dimension, value) at which each inner node of a binary tree is cut:
    the middle of its widest dimension. Node n has the children 2n, 2n + 1."""
    dim, at = np.zeros(2 ** depth, np.int64), np.zeros(2 ** depth)
    inside = {1: points}
    for node in range(1, 2 ** depth):
        p = inside.pop(node)
        if len(p):
            dim[node] = np.argmax(p.max(axis=0) - p.min(axis=0))
            at[node] = np.median(p[:, dim[node]])
        right = p[:, dim[node]] > at[node]
        inside[2 * node], inside[2 * node + 1] = p[~right], p[right]
    return dim, at


def _with_leaf(units: DataFrame, along: Sequence[str], depth: int, n: int) -> DataFrame:
    """Every row's leaf of a tree of 2 ** depth. Only where the cuts lie is
    taken from a sample, by a hash of the id."""
    rate = min(1.0, _SAMPLED * 2 ** depth / max(n, 1))
    drawn = units.where(F.pmod(F.xxhash64(F.lit(5), "class_id"), F.lit(1 << 20)) < math.ceil(rate * (1 << 20)))
    dim, at = _splits(drawn.select(*along).toPandas().to_numpy(float), depth)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.column_stack([b.column(c).to_numpy() for c in along])
            node = np.ones(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + (x[np.arange(len(x)), dim[node]] > at[node])
            yield b.append_column("leaf", pa.array(node - 2 ** depth))

    return units.mapInArrow(run, StructType([*units.schema.fields, StructField("leaf", LongType())]))


def _meet(u: Sequence[str], reach: float, bar: float):
    """Counts of one group's rows over the blocks sent to it. The group's own
    blocks come first; the others pass one at a time, and only blocks whose
    boxes lie within ``reach`` (squared) are multiplied."""

    def blocks(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            rows = b.column("rows")
            ends, inner = rows.offsets.to_numpy(), rows.values
            x = np.column_stack([inner.field(c).to_numpy() for c in u])
            size = inner.field("class_size").to_numpy().astype(float)
            for i, (group, own) in enumerate(zip(b.column("group").to_pylist(), b.column("own").to_pylist(), strict=True)):
                part = slice(ends[i], ends[i + 1])
                yield group, own, (inner.field("class_id")[part.start:part.stop], x[part], size[part])

    def count(mine: list, lo: np.ndarray, hi: np.ndarray, told: list, block: tuple, at: int | None) -> None:
        _, x, size = block
        gap = np.maximum(np.maximum(lo - x.max(axis=0), x.min(axis=0) - hi), 0.0)
        alone = bool((size == 1).all())
        for i in np.flatnonzero((gap * gap).sum(axis=1) <= reach).tolist():
            dot = mine[i][1] @ x.T
            if i == at:
                np.fill_diagonal(dot, -2.0)
            hit = dot >= bar
            links, best = told[i]
            links += np.count_nonzero(hit, axis=1) if alone else hit @ size
            np.maximum(best, dot.max(axis=1), out=best)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, mine, told, lo, hi = None, [], [], None, None

        def settle():  # the own blocks are complete: they meet one another
            nonlocal told, lo, hi
            lo, hi = (np.array([f(x, axis=0) for _, x, _ in mine]) for f in (np.min, np.max))
            told = [(np.zeros(len(x)), np.full(len(x), -2.0)) for _, x, _ in mine]
            for i, block in enumerate(mine):
                count(mine, lo, hi, told, block, i)

        def answers() -> pa.RecordBatch:
            best = np.concatenate([b for _, b in told])
            return pa.RecordBatch.from_arrays(
                [pa.concat_arrays([ids for ids, _, _ in mine]), pa.array(np.concatenate([n for n, _ in told]).astype(np.int64)),
                 pa.array(best, mask=best < bar)], names=["class_id", "_links", "best_similarity"])

        for key, own, block in blocks(batches):
            if key != group:
                if mine:
                    if not told:
                        settle()
                    yield answers()
                group, mine, told = key, [], []
            if own:
                mine.append(block)
                continue
            if not told:
                settle()
            count(mine, lo, hi, told, block, None)
        if mine:
            if not told:
                settle()
            yield answers()

    return run


def profile_links(df: DataFrame, id_col: str, columns: Sequence[str], threshold: float = 0.9, prefix: int = 8,
                  block: int = 512, digits: int = 9) -> DataFrame:
    """Per row: its class of identical profiles and how many rows are alike.

    (id, class_id, class_size, n_links, best_similarity): ``class_id`` is the
    smallest id with the same standardised values, ``n_links`` the number of
    other rows whose cosine (rounded to ``digits``) exceeds ``threshold``,
    ``best_similarity`` the largest cosine with another class above it.

    Exact, and without a row per pair. Identical rows meet once, as a class
    with a count. Two unit vectors above the threshold are at most
    sqrt(2 - 2 threshold) apart. A tree cut along the ``prefix`` dimensions
    that vary most puts classes that lie close together into blocks of about
    ``block``; a block is sent to the groups of neighbouring blocks whose box
    is within that distance, and a task multiplies its group with the blocks
    sent to it, one matrix of block x block cosines at a time, and adds up
    counts. The tree's cuts come from a sample, but every class is placed and
    meets every class within reach.

    The work is the number of pairs of blocks in reach, a share of all pairs
    that falls as blocks become narrower. A profile equal to the mean
    everywhere has no direction and no links. Rows without id are left out.
    """
    scaled, z = _standardised(df, id_col, columns)
    scaled = cut_lineage(scaled)
    classes = scaled.groupBy(*z).agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("class_size"))
    norm = F.sqrt(reduce(lambda a, b: a + b, [F.col(c) * F.col(c) for c in z]))
    u = [f"u{i}" for i in range(len(z))]
    classes = cut_lineage(classes.withColumn("_norm", norm).select(
        *z, "class_id", "class_size", "_norm", *[F.when(F.col("_norm") > 0, F.col(c) / F.col("_norm")).alias(n)
                                                 for c, n in zip(z, u, strict=True)]))
    units = classes.where("_norm > 0").select("class_id", "class_size", *u)
    spread = units.agg(F.count(F.lit(1)).alias("_n"), *[F.var_pop(c).alias(c) for c in u]).first().asDict()
    along = sorted(u, key=lambda c: (-(spread[c] or 0.0), c))[:prefix]
    n = spread["_n"]
    depth = min(_DEPTH, max(0, math.ceil(math.log2(max(n, 1) / block))))
    together = depth - max(min(depth, 6), depth - _TOGETHER)
    reach = max(2 - 2 * threshold, 1e-6) * (1 + 1e-6)

    placed = _with_leaf(units, along, depth, n)
    # A leaf of more than ``block`` classes is several blocks.
    leaves = cut_lineage(placed.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("parts")))
    blocks = (placed.join(F.broadcast(leaves), "leaf").withColumn("part", F.pmod(F.xxhash64("class_id"), F.col("parts")).cast("long"))
              .groupBy("leaf", "part")
              .agg(F.collect_list(F.struct("class_id", "class_size", *u)).alias("rows"),
                   *[F.min(c).alias(f"lo_{c}") for c in u], *[F.max(c).alias(f"hi_{c}") for c in u])
              .withColumn("other_block", F.col("leaf") * (1 << 32) + F.col("part"))
              .withColumn("home", F.floor(F.col("leaf") / 2 ** together).cast("long") * (1 << 32)
                          + F.floor(F.col("part") / _TURN).cast("long")))
    blocks = cut_lineage(blocks)
    groups = blocks.groupBy(F.col("home").alias("group")).agg(*[F.min(f"lo_{c}").alias(f"from_{c}") for c in u],
                                                              *[F.max(f"hi_{c}").alias(f"to_{c}") for c in u])
    gaps = [F.greatest(F.col(f"lo_{c}") - F.col(f"to_{c}"), F.col(f"from_{c}") - F.col(f"hi_{c}"), F.lit(0.0)) for c in u]
    near = cut_lineage(blocks.select("other_block", "home", *[f"{k}_{c}" for c in u for k in ("lo", "hi")])
                       .crossJoin(F.broadcast(groups))  # boxes only, one row per group
                       .where(reduce(lambda a, b: a + b, [g * g for g in gaps]) <= reach)
                       .select("other_block", "group", (F.col("home") == F.col("group")).alias("own")))
    tasks = max(1, near.where("own").select("group").distinct().count())
    sent = (near.join(blocks.select("other_block", "rows"), "other_block")
            .repartition(tasks, "group").sortWithinPartitions("group", F.desc("own")))
    # round(cosine, digits) > threshold, half up
    bar = (math.floor(round(threshold * 10 ** digits, 3)) + 0.5) / 10 ** digits
    told_schema = StructType([units.schema["class_id"]]).add("_links", LongType()).add("best_similarity", DoubleType())
    links = (sent.select("group", "own", "other_block", "rows").mapInArrow(_meet(u, reach, bar), told_schema)
             .withColumn("best_similarity", F.round("best_similarity", digits)))
    told = classes.join(links, "class_id", "left").select(
        *z, "class_id", "class_size", "best_similarity",
        (F.coalesce("_links", F.lit(0)) + F.when(F.col("_norm") > 0, F.col("class_size") - 1).otherwise(0)).alias("n_links"))
    return scaled.join(told, z).select(F.col("id").alias(id_col), "class_id", "class_size", "n_links", "best_similarity")
