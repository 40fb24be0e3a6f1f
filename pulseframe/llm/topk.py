"""Exact top-k inner products by pivot-table elimination.

Vectors are turned into integers, floor(scale * x). Inner product and
Euclidean distance are tied by 2 q.x = |q|^2 + |x|^2 - |q - x|^2, so a lower
bound of the distance bounds the score from above.

1. Pivots are chosen farthest first among a bounded pool of distinct vectors
   (``PIVOT_POOL`` rows drawn by hash); they steer the order, never the result.
2. Each row's distances to all pivots are computed once and stored with it, as
   the row's place relative to the pivots: its coordinates in their span and
   its distance from that span, which follow from the distances alone. The
   distance of two such places is the greatest lower bound that the distances
   to the pivots allow; no single pivot's |d(q, p) - d(x, p)| exceeds it.
3. Rows gather in the cells of the first pivots (one pivot for about every
   ``block`` rows); larger cells are split by hash into blocks of about that
   size. A query first meets one block of its own cell; its k-th best score so
   far goes with it from then on.
4. A block is skipped for a block of queries if the box around its rows'
   places is too far from the box around the queries' for any of them.
5. In the blocks left, a query evaluates the candidates in the order of their
   bounds and stops when its k-th best score exceeds every bound left (ties
   are still evaluated), so the result is exact. Each pair of blocks is one
   group of bounded size.

Vectors that are null, or hold null or non-finite components, take no part.
Shorter vectors count as padded with zeros. Components are limited to what
keeps inner products exact in 64-bit integers (2^53 in total). Rows of one id
are candidates of their own; a query never returns rows of its own id. Ties go
to the smaller id; rows without id take no part. Empty tables give an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pulseframe.llm import common

SCALE = 256
PIVOTS = 48
PIVOT_POOL = 2000
BLOCK = 4096
QUERY_BLOCK = 1024
#: Share of the squared sizes by which bounds are widened, for rounding.
SLACK = 1e-6
#: Directions of the pivots' span below this share of the widest are left out.
_THIN = 1e-4
_SLICE = 128


def usable(vectors: DataFrame, id_col: str, vec_col: str, scale: int = SCALE) -> DataFrame:
    """(id, v): integer components of the vectors that take part."""
    x = F.col(vec_col)
    finite = x.isNotNull() & F.col(id_col).isNotNull() & F.forall(
        x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return vectors.where(finite).select(
        F.col(id_col).cast("long").alias("id"),
        F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("long")).alias("v"))


def _matrix(v: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(v), width))
    for i, x in enumerate(v):
        out[i, :len(x)] = x
    return out


def _farthest(pool: list[list[int]], number: int) -> np.ndarray:
    """Pivots: the vector farthest from the pool's mean, then always the one
    farthest from those chosen, without repeats."""
    x = _matrix(pd.Series(pool), max([len(v) for v in pool], default=0))
    if not len(x):
        return x
    chosen = [int(((x - x.mean(0)) ** 2).sum(1).argmax())]
    near = ((x - x[chosen[0]]) ** 2).sum(1)
    while len(chosen) < number and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, ((x - x[chosen[-1]]) ** 2).sum(1))
    return x[chosen]


class Table:
    """Distances to the pivots and the places that follow from them."""

    def __init__(self, pivots: np.ndarray):
        self.pivots, self.pp = pivots, (pivots * pivots).sum(1)
        away = pivots[1:] - pivots[0]
        u, s, _ = np.linalg.svd(away, full_matrices=False)
        some = s > _THIN * s.max(initial=0)
        self.solve, self.away = u[:, some] / s[some], (away * away).sum(1)

    def squared(self, x: np.ndarray) -> np.ndarray:
        """Squared distances to all pivots (integers, exact)."""
        width = max(x.shape[1], self.pivots.shape[1])
        wide = lambda a: np.pad(a, ((0, 0), (0, width - a.shape[1])))
        return (x * x).sum(1)[:, None] + self.pp - 2 * wide(x) @ wide(self.pivots).T

    def place(self, squared: np.ndarray) -> np.ndarray:
        """Coordinates in the pivots' span, from the first pivot, and the
        distance from the span as the last one."""
        inner = (squared[:, :1] + self.away - squared[:, 1:]) / 2
        y = inner @ self.solve
        rest = np.sqrt(np.maximum(squared[:, 0] - (y * y).sum(1), 0))
        return np.column_stack([y, rest])


def _search(q_id: np.ndarray, q: np.ndarray, q_place: np.ndarray, floor: np.ndarray, x_id: np.ndarray, x: np.ndarray, x_place: np.ndarray,
            k: int) -> tuple[list[tuple], np.ndarray, int]:
    """The k best candidates of every query among one block that reach the
    query's ``floor``, the k-th best score of each (or the floor), and the
    number of candidates evaluated."""
    xx, qq = (x * x).sum(1), (q * q).sum(1)
    x_base, q_base = (xx - (x_place * x_place).sum(1)) / 2, (qq - (q_place * q_place).sum(1)) / 2
    out, last, evaluated = [], floor.copy(), 0
    for lo in range(0, len(q), _SLICE):
        hi = min(lo + _SLICE, len(q))
        bounds = q_place[lo:hi] @ x_place.T + x_base + q_base[lo:hi, None]
        bounds += SLACK * (1 + qq[lo:hi, None] + xx)
        for i, bound in zip(range(lo, hi), bounds, strict=True):
            left = np.flatnonzero((bound >= floor[i]) & (x_id != q_id[i]))
            left = left[np.argsort(-bound[left], kind="stable")]
            best_s, best_id = np.zeros(0), np.zeros(0, np.int64)
            at, step = 0, max(4 * k, 32)
            while at < len(left) and not (len(best_s) >= k and best_s[k - 1] > bound[left[at]]):
                some = left[at:at + step]
                at += step
                step *= 2
                evaluated += len(some)
                s, ids = np.concatenate([best_s, x[some] @ q[i]]), np.concatenate([best_id, x_id[some]])
                keep = np.lexsort((ids, -s))[:k]
                best_s, best_id = s[keep], ids[keep]
            if len(best_s) >= k:
                last[i] = max(last[i], best_s[k - 1])
            out += [(int(q_id[i]), int(b), int(s)) for b, s in zip(best_id, best_s, strict=True)]
    return out, last, evaluated


#: Found rows, and summaries: blocks (b) and blocks of queries (qb, met at b).
_FOUND = "query_id long, id long, score long, b int, qb int, need double, half double, lo array<double>, hi array<double>, evaluated long"


def _frame(found: list[tuple], more: list[dict]) -> pd.DataFrame:
    names = [c.split()[0] for c in _FOUND.split(", ")]
    rows = [dict(zip(names[:3], r, strict=True)) for r in found] + more
    out = pd.DataFrame(rows, columns=names).astype(object)
    return out.where(out.notna(), None)


def _places(rows: pd.DataFrame) -> np.ndarray:
    return np.array(rows["place"].tolist(), float)


def _passes(vectors: DataFrame, is_query: Column, id_col: str, vec_col: str, k: int, scale: int, pivots: int, block: int,
            query_block: int) -> DataFrame:
    """All rows found and the numbers evaluated, of both passes."""
    spark = vectors.sparkSession
    rows = common.saved(usable(vectors, id_col, vec_col, scale))
    pool = rows.orderBy(F.xxhash64("id"), "id").select("v").limit(PIVOT_POOL).dropDuplicates(["v"])
    chosen = _farthest([list(r[0]) for r in pool.collect()], pivots)
    if not len(chosen):
        return spark.createDataFrame([], _FOUND)
    table = spark.sparkContext.broadcast(Table(chosen))
    cells = min(len(chosen), rows.count() // block + 1)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            squared = table.value.squared(_matrix(b["v"], max([len(v) for v in b["v"]], default=0)))
            yield b.assign(cell=squared[:, :cells].argmin(1), place=list(table.value.place(squared)))

    rows = common.saved(rows.mapInPandas(measure, "id long, v array<long>, cell int, place array<double>"))
    asked = rows.withColumnRenamed("id", id_col).where(is_query).withColumnRenamed(id_col, "id")

    def split(df: DataFrame, size: int) -> tuple[Column, Column, int]:
        """Blocks of each cell, its first block, and the number of blocks."""
        n = [0] * cells
        for r in df.groupBy("cell").count().collect():  # at most one row per pivot
            n[r[0]] = r[1] // size + 1
        first = np.cumsum([0, *n]).tolist()
        return F.array(*map(F.lit, n))[F.col("cell")], F.array(*map(F.lit, first[:-1]))[F.col("cell")], first[-1]

    parts, first, blocks = split(rows, block)
    q_parts, q_first, _ = split(asked, query_block)
    part = F.pmod(F.xxhash64("id", F.lit(1)), q_parts)
    x = rows.select((first + F.pmod(F.xxhash64("id"), parts)).cast("int").alias("b"), "id", "v", "place")
    q = asked.select((first + F.pmod(part, parts)).cast("int").alias("b"), (q_first + part).cast("int").alias("qb"), "id", "v", "place")

    def arrays(left: pd.DataFrame, right: pd.DataFrame) -> tuple[np.ndarray, ...]:
        width = max([len(v) for c in (left["v"], right["v"]) for v in c])
        return (right["id"].to_numpy(np.int64), _matrix(right["v"], width), _places(right),
                left["id"].to_numpy(np.int64), _matrix(left["v"], width), _places(left))

    def home(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple] = []
        more: list[dict] = []
        if len(left) and len(right):
            q_id, qv, qp, x_id, xv, xp = arrays(left, right)
            found, last, evaluated = _search(q_id, qv, qp, np.full(len(qv), -np.inf), x_id, xv, xp, k)
            more.append({"evaluated": evaluated})
            half = (qv * qv).sum(1) / 2
            need = last - half
            for qb in right["qb"].unique():
                own = (right["qb"] == qb).to_numpy()
                more.append({"b": right["b"].iat[0], "qb": qb, "need": need[own].min(), "half": half[own].max(), "lo": qp[own].min(0).tolist(),
                             "hi": qp[own].max(0).tolist()})
        if len(left):
            xp = _places(left)
            half = max(sum(float(c) * c for c in v) for v in left["v"]) / 2
            more.append({"b": left["b"].iat[0], "half": half, "lo": xp.min(0).tolist(), "hi": xp.max(0).tolist()})
        return _frame(found, more)

    near = common.saved(x.groupBy("b").cogroup(q.groupBy("b")).applyInPandas(home, _FOUND))
    if blocks == 1:
        return near
    # Blocks of queries against the other blocks: summaries only.
    theirs = (near.where("qb IS NOT NULL").select("qb", "need", F.col("half").alias("q_half"), F.col("lo").alias("q_lo"), F.col("hi").alias("q_hi"),
                                                  F.col("b").alias("home"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"))
              .where("b != home"))
    boxes = near.where("b IS NOT NULL AND qb IS NULL").select("b", "half", "lo", "hi")
    gap = ("aggregate(zip_with(zip_with(lo, q_hi, (a, c) -> a - c), zip_with(q_lo, hi, (a, c) -> a - c), (a, c) -> greatest(a, c, 0D)),"
           " 0D, (s, g) -> s + g * g)")
    pairs = common.saved(theirs.join(boxes, "b").where(F.expr(f"half - {gap} / 2 + {SLACK} * (1 + 2 * half + 2 * q_half) >= need")).select("b", "qb"))
    floors = (near.where("query_id IS NOT NULL").groupBy("query_id").agg(F.min("score").alias("floor"), F.count("*").alias("c"))
              .where(F.col("c") >= k).select(F.col("query_id").alias("id"), F.col("floor").cast("double").alias("floor")))
    # Columns of their own, so that the two sides of the cogroup are told apart.
    q = (q.drop("b").join(floors, "id", "left").join(pairs, "qb")
         .select(*[F.col(c).alias(c) for c in ("b", "qb", "id", "v", "place")], F.coalesce("floor", F.lit(float("-inf"))).alias("floor")))

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return _frame([], [])
        q_id, qv, qp, *of_x = arrays(left, right)
        found, _, evaluated = _search(q_id, qv, qp, right["floor"].to_numpy(float), *of_x, k)
        return _frame(found, [{"evaluated": evaluated}])

    far = (x.join(pairs, "b").groupBy("b", "qb").cogroup(q.groupBy("b", "qb")).applyInPandas(meet, _FOUND))
    return near.unionByName(far)


def top_k(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 5,
          scale: int = SCALE, pivots: int = PIVOTS, block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, id, score) of each query's k best other rows.

    ``is_query``: a condition on ``id_col``.
    """
    found = _passes(vectors, is_query, id_col, vec_col, k, scale, pivots, block, query_block).where("query_id IS NOT NULL")
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    return (found.select("query_id", "id", "score").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score"))


def evaluated(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 5,
              scale: int = SCALE, pivots: int = PIVOTS, block: int = BLOCK, query_block: int = QUERY_BLOCK) -> int:
    """Number of inner products that ``top_k`` evaluates; the bounds spare the rest."""
    found = _passes(vectors, is_query, id_col, vec_col, k, scale, pivots, block, query_block)
    return found.agg(F.coalesce(F.sum("evaluated"), F.lit(0))).first()[0]


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best inner products of every vector whose id is divisible by 50."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return top_k(vectors, F.col("vec_id") % 50 == 0)


QUERIES = {"op7_topk": op7_topk}
ORACLE = {"op7_topk": f"""
WITH x AS (SELECT vec_id, list_transform(embedding, lambda c: floor({SCALE} * c::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
 s AS (SELECT q.vec_id AS query_id, x.vec_id, list_dot_product(q.v, x.v)::BIGINT AS score FROM x q JOIN x ON q.vec_id % 50 = 0 AND q.vec_id <> x.vec_id),
 r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5"""}
