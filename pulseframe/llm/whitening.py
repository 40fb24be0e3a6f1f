"""Whitening of embeddings by polarisation covariance.

Entries become integers, floor(scale * c) + shift, so that sums are exact. A
first pass gives n and the sum S of every dimension. A second one aggregates
exact squared centred values: for every dimension i the sum of
(n x_i - S_i)^2, and for every pair of dimensions that of
(n (x_i + x_j) - S_i - S_j)^2. By polarisation the covariance of i and j is half of what
the variance of the pair's sum exceeds the two variances by:

    V_ij = (D_ij - D_i - D_j) / (2 n^3)

Squares are taken of integers, split into two parts so that 64-bit sums hold
them; a batch's sums leave as two decimal limbs and are added by Spark. Only
n, S and the d (d + 1) / 2 sums reach the driver, which bounds d, assembles V
from exact integers and takes its eigenvectors (``eigh``). A third pass
projects the centred vectors.

Vectors that are null, or hold null or non-finite entries, take no part.
Shorter ones count as padded with zero entries. Components with an eigenvalue
of zero (beside the largest, to double precision) are left out, so equal
vectors or a single one give no rows; so does an empty table. Null ids and
repeated rows are kept, each on its own. ``deviation`` beyond 64 bits fails
loudly. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseframe.llm import common

SCALE = 1024
SHIFT = 100_000
COMPONENTS = 8
#: More dimensions than this fail: their pair sums go to the driver.
MAX_DIMENSIONS = 2048
#: Rows whose squares are summed at once, and the low bits of a split value.
STEP, LOW_BITS = 128, 27
LIMB = 10 ** 18


def usable(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, v): the vectors that take part, entries as double."""
    x = F.col(vec_col)
    finite = x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return vectors.where(finite).select(F.col(id_col).cast("long").alias("id"), x.cast("array<double>").alias("v"))


def integers(col: pa.Array, dims: int, scale: int, shift: int) -> np.ndarray:
    """x of a batch: one row of integers per vector, padded with zero entries."""
    out = np.zeros((len(col), dims))
    n = pc.list_value_length(col).to_numpy(zero_copy_only=False).astype(np.int64)
    out[np.arange(dims)[None, :] < n[:, None]] = col.flatten().to_numpy(zero_copy_only=False)
    x = np.floor(out * scale)
    if len(x) and np.abs(x).max() >= 2.0 ** 53:
        raise ValueError("an entry is too large to be taken as an exact integer")
    return x.astype(np.int64) + shift


def _steps(batches: Iterator[pa.RecordBatch], dims: int, scale: int, shift: int, rows: int = STEP):
    for b in batches:
        for lo in range(0, b.num_rows, rows):
            part = b.slice(lo, rows)
            yield part, integers(part.column("v"), dims, scale, shift)


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n x - S, exact: 64-bit where it fits, Python integers elsewhere."""
    limit = 1 << 53
    if len(x) == 0 or max(n * int(np.abs(x).max()), max(map(abs, sums), default=0)) < 1 << 62:
        w = n * x - np.array([int(s) for s in sums], np.int64)
        if len(w) == 0 or np.abs(w).max() < limit:
            return w
    return n * x.astype(object) - sums


def square_sums(w: np.ndarray) -> list[int]:
    """Exact column sums of squares, as Python integers."""
    if w.dtype == object:
        return (w * w).sum(axis=0).tolist() if len(w) else [0] * w.shape[1]
    high, low = w >> LOW_BITS, w & ((1 << LOW_BITS) - 1)
    a, b, c = (high * high).sum(axis=0), (high * low).sum(axis=0), (low * low).sum(axis=0)
    return [(int(i) << 2 * LOW_BITS) + (int(j) << LOW_BITS + 1) + int(k) for i, j, k in zip(a, b, c, strict=True)]


def _limbs(totals: dict[tuple[int, int], int]) -> pa.RecordBatch:
    cells = [(i, j, *divmod(t, LIMB)) for (i, j), t in totals.items()]
    import decimal
    cols = list(zip(*cells, strict=True)) if cells else [[], [], [], []]
    dec = [pa.array([decimal.Decimal(v) for v in c], pa.decimal128(38, 0)) for c in cols[2:]]
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), *dec],
                                      names=["i", "j", "high", "low"])


_CELLS = "i int, j int, high decimal(38,0), low decimal(38,0)"


def _total(cells: DataFrame) -> dict[tuple[int, int], int]:
    """Exact sums of (i, j) cells: one row per pair of dimensions at the driver."""
    rows = cells.groupBy("i", "j").agg(F.sum("high").alias("high"), F.sum("low").alias("low")).collect()
    return {(r["i"], r["j"]): int(r["high"]) * LIMB + int(r["low"]) for r in rows}


def moments(v: DataFrame, scale: int = SCALE, shift: int = SHIFT) -> tuple[int, np.ndarray, list[list[int]]]:
    """(n, S, C): C[i][j] is the exact sum of (n x_i - S_i)(n x_j - S_j)."""
    n, dims = v.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    if dims > MAX_DIMENSIONS:
        raise ValueError(f"{dims} dimensions, at most {MAX_DIMENSIONS} are taken")
    if n == 0 or dims == 0:
        return n, np.zeros(0, object), []
    vectors = v.select("v")

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros(dims, object)
        for _, x in _steps(batches, dims, scale, shift, 512):
            totals = totals + np.array([int(s) for s in x.sum(axis=0)], object)
        yield _limbs({(i, i): int(t) for i, t in enumerate(totals)})

    first = _total(vectors.mapInArrow(add_up, _CELLS))
    sums = np.array([first[i, i] for i in range(dims)], object)

    def squares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple[int, int], int] = {}
        for _, x in _steps(batches, dims, scale, shift):
            w = centred(x, n, sums)
            for i in range(dims):
                # Dimension i alone, then its sums with every later one.
                y = np.concatenate([w[:, i:i + 1], w[:, i:i + 1] + w[:, i + 1:]], axis=1)
                for j, t in enumerate(square_sums(y), i):
                    totals[i, j] = totals.get((i, j), 0) + t
        if totals:
            yield _limbs(totals)

    d = _total(vectors.mapInArrow(squares, _CELLS))
    c = [[0] * dims for _ in range(dims)]
    for (i, j), t in d.items():
        c[i][j] = c[j][i] = t if i == j else (t - d[i, i] - d[j, j]) // 2
    return n, sums, c


def components(n: int, c: list[list[int]], k: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors as columns, shares of the trace), falling."""
    dims = len(c)
    v = np.array([[c[i][j] / n ** 3 for j in range(dims)] for i in range(dims)]).reshape(dims, dims)
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1], vectors[:, ::-1]
    kept = values[:k] > max(values[0] if dims else 0, 0) * dims * np.finfo(float).eps
    m = int(kept.sum())
    trace = sum(c[i][i] for i in range(dims)) / n ** 3 if dims else 0.0
    return values[:m], vectors[:, :m], values[:m] / trace if m else values[:0]


def whiten(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = COMPONENTS,
           scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """(id, n, deviation decimal, whitened array, explained array) of every vector that takes part."""
    spark = vectors.sparkSession
    common.small_arrow_batches(spark, 4096)
    v = common.stored(usable(vectors, id_col, vec_col))
    schema = f"`{id_col}` long, n long, deviation decimal(38,0), whitened array<double>, explained array<double>"
    n, sums, c = moments(v, scale, shift)
    if n == 0 or not c:
        return spark.createDataFrame([], schema)
    dims = len(c)
    values, basis, explained = components(n, c, k)
    project = basis / np.sqrt(values) / n if len(values) else basis
    shares = explained.tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import decimal
        for b, x in _steps(batches, dims, scale, shift, 1024):
            w = centred(x, n, sums)
            deviation = square_sums(np.ascontiguousarray(w.T))
            z = w.astype(float) @ project
            yield pa.RecordBatch.from_arrays([
                b.column("id"), pa.array([n] * len(w), pa.int64()),
                pa.array([decimal.Decimal(t) for t in deviation], pa.decimal128(38, 0)),
                pa.array(list(z), pa.list_(pa.float64())), pa.array([shares] * len(w), pa.list_(pa.float64()))],
                names=[id_col, "n", "deviation", "whitened", "explained"])

    return v.mapInArrow(run, schema)


def identity_error(whitened: DataFrame, k: int) -> DataFrame:
    """One row: the largest absolute entry of the whitened vectors' covariance minus the identity."""
    cells = [F.abs(F.covar_pop(F.col("whitened")[i], F.col("whitened")[j]) - (1.0 if i == j else 0.0))
             for i in range(k) for j in range(i, k)]
    cells = [F.coalesce(c, F.lit(0.0)) for c in cells]  # components left out
    return whitened.agg(F.greatest(*cells, F.lit(0.0)).alias("identity_error"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per vector and component: its whitened coordinate and the fit's figures."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    rows = common.stored(whiten(vectors))
    parts = rows.select("vec_id", "n", F.col("deviation").cast("long").alias("deviation"),
                        F.posexplode(F.arrays_zip("whitened", "explained")).alias("p", "z"))
    return (parts.crossJoin(F.broadcast(identity_error(rows, COMPONENTS)))
            .select("vec_id", (F.col("p") + 1).alias("component"), "n", "deviation", F.col("z.whitened").alias("whitened"),
                    F.col("z.explained").alias("explained"), "identity_error"))


QUERIES = {"op12_whitening": op12_whitening}
ORACLE: dict[str, str] = {}
