"""Embedding whitening with MLlib block matrices.

1. Entries become whole numbers on a grid (``floor(scale * c) + shift``); rows with a null or
   non-finite entry go. The fit list is every distinct vector once.
2. Centred fit vectors are indexed (dense numbers from counts per written partition) and cut
   into distributed blocks; transpose times matrix gives the scatter. The middle dimension is
   split, so one task multiplies ``SPLIT_BLOCKS`` blocks and partial products are summed.
3. Eigenvectors of the covariance (dimension x dimension) are found on the driver.
4. The centred rows' block matrix times the whitening matrix projects every row; the same
   product over the fit list gives the covariance that is held against the identity.

Defined results: the dimension is the most frequent length of the remaining vectors (of equally
frequent ones the largest); vectors of another length are left out, as are empty vectors. An entry
beyond +-2**53 / scale counts as that bound. ``deviation`` is null where it does not fit a long.
Components without variance (eigenvalue at most 1e-12 of the trace) have a null ``whitened`` and take no part in ``identity_error``.
No rows, no result rows. Rows with equal or null ids are rows of their own; other columns are ignored.
Size: block numbers are kept on the driver by MLlib, a million blocks of ``rows_per_block`` rows at most are sensible.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark import SparkContext, StorageLevel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

SCALE, SHIFT = 64, 1_000_000
ROWS_PER_BLOCK = 1024
#: Blocks that one task multiplies for the scatter.
SPLIT_BLOCKS = 16
LARGEST = float(1 << 53)
FLAT = 1e-12
SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


@dataclass
class Fit:
    """Counts and sums of the fit list, and its components by falling eigenvalue."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def live(self) -> np.ndarray:
        """Numbers of the components with variance."""
        return np.flatnonzero(self.values > max(0.0, FLAT * self.trace))

    @property
    def matrix(self) -> np.ndarray:
        """dimension x components: unit eigenvectors over the root of their eigenvalue, nought without variance."""
        out = np.zeros_like(self.vectors)
        out[:, self.live] = self.vectors[:, self.live] / np.sqrt(self.values[self.live])
        return out


def grid_vectors(emb: DataFrame, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """``vec_id, x``: vectors of finite entries as whole numbers."""
    v = F.col("embedding").cast("array<double>")
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    bound = lambda c: F.least(F.greatest(c * float(scale), F.lit(-LARGEST)), F.lit(LARGEST))
    x = F.transform(v, lambda c: F.floor(bound(c)) + F.lit(shift).cast("long"))
    rows = emb.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("embedding")).where(v.isNotNull() & ~bad & (F.size(v) > 0))
    return rows.select("vec_id", x.alias("x"))


def indexed(df: DataFrame, name: str) -> DataFrame:
    """The rows written once, numbered 0.. without gaps in ``rid``."""
    at = F.monotonically_increasing_id()
    kept = common.written(df.select("*", F.shiftright(at, 33).alias("part"), at.bitwiseAND(F.lit((1 << 33) - 1)).alias("pos")), name)
    # one row per written partition
    first = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = kept.groupBy("part").agg(F.count("*").alias("rows")).select("part", F.coalesce(F.sum("rows").over(first), F.lit(0)).alias("first"))
    return kept.join(F.broadcast(offsets), "part").select((F.col("first") + F.col("pos")).alias("rid"), *df.columns)


def scaled_deviation(x: Column, n: int, sums: list[int]) -> Column:
    """``n * x - sums`` by dimension; null where it does not fit a long."""
    total = F.array(*[F.lit(s if abs(s) < 1 << 63 else None).cast("long") for s in sums])
    return F.zip_with(x, total, lambda a, s: F.try_subtract(F.try_multiply(F.lit(n).cast("long"), a), s))


def centred(x: Column, n: int, sums: list[int]) -> Column:
    """``x - sums / n``, from whole numbers where they fit."""
    exact = scaled_deviation(x, n, sums)
    mean = F.array(*[F.lit(s / n) for s in sums])
    plain = F.zip_with(x, mean, lambda a, m: a.cast("double") - m)
    return F.zip_with(exact, plain, lambda e, p: F.coalesce(e.cast("double") / F.lit(float(n)), p))


def block_matrix(rows: DataFrame, index: str, vector: Column, n: int, d: int, rows_per_block: int) -> BlockMatrix:
    """Distributed blocks of the rows ``index -> vector``, as wide as the matrix."""
    old = MLUtils.convertVectorColumnsFromML(rows.select(F.col(index).alias("index"), array_to_vector(vector).alias("vector")), "vector")
    return IndexedRowMatrix(old, n, d).toBlockMatrix(rows_per_block, d)


def multiply(a: BlockMatrix, b: BlockMatrix, splits: int = 1) -> BlockMatrix:
    """Product with a split middle dimension (MLlib's parameter, which its Python method leaves out)."""
    return BlockMatrix(a._java_matrix_wrapper.call("multiply", b._java_matrix_wrapper._java_model, splits), a.rowsPerBlock, b.colsPerBlock)


def scatter(m: BlockMatrix) -> np.ndarray:
    """Transpose times matrix, as a local matrix of its width."""
    blocks = -(-m.numRows() // m.rowsPerBlock)
    # both sides of the product read the blocks; lost ones are computed again
    m.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return multiply(m.transpose(), m, splits=-(-blocks // SPLIT_BLOCKS)).toLocalMatrix().toArray()
    finally:
        m._java_matrix_wrapper._java_model.blocks().unpersist(False)


def projected(m: BlockMatrix, weights: np.ndarray) -> DataFrame:
    """``index, y``: rows of the matrix times ``weights``."""
    d, k = weights.shape
    local = DenseMatrix(d, k, weights.flatten(order="F").tolist())
    right = BlockMatrix(SparkContext.getOrCreate().parallelize([((0, 0), local)], 1), d, k)
    product = multiply(m, right).toIndexedRowMatrix()
    # the wrapper frees its Java object when it goes: it is held until the call is done
    rows = callMLlibFunc("getIndexedRows", product._java_matrix_wrapper._java_model)
    del product
    return rows.select("index", vector_to_array("vector").alias("y"))


def fit(listed: DataFrame, n: int, d: int, components: int, rows_per_block: int = ROWS_PER_BLOCK) -> tuple[Fit, BlockMatrix]:
    """Mean, covariance and components of the indexed fit list ``rid, x``, and its centred block matrix."""
    each = listed.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.sum(F.col("v").cast("decimal(19,0)")).alias("s"))
    sums = [int(r["s"]) for r in each.orderBy("i").collect()]  # one row per dimension
    m = block_matrix(listed, "rid", centred(F.col("x"), n, sums), n, d, rows_per_block)
    cov = scatter(m) / n
    values, vectors = np.linalg.eigh((cov + cov.T) / 2)
    order = np.argsort(-values, kind="stable")[: min(components, d)]
    return Fit(n, sums, values[order], vectors[:, order], float(np.trace(cov))), m


def whiten(emb: DataFrame, components: int = 16, scale: int = SCALE, shift: int = SHIFT, rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """One row per vector: ``vec_id, n, deviation, whitened, explained, identity_error`` (arrays by component)."""
    spark = emb.sparkSession
    common.prepare(spark)
    rows = common.written(grid_vectors(emb, scale, shift), "white-grid")
    size = rows.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), F.desc("d")).first()
    if size is None:
        return spark.createDataFrame([], "vec_id long, n long, deviation long, whitened array<double>, explained array<double>, identity_error double")
    d = size["d"]
    rows = indexed(rows.where(F.size("x") == d), "white-rows")
    listed = indexed(rows.select("x").distinct(), "white-list")
    m, n = rows.count(), listed.count()
    model, fitted = fit(listed, n, d, components, rows_per_block)
    live = model.live
    explained = [max(float(v), 0.0) / model.trace if model.trace > 0 else 0.0 for v in model.values]
    white = common.written(projected(fitted, model.matrix), "white-fit")
    # covariance of the whitened fit list, centred before multiplying
    means = [r["m"] for r in white.select(F.posexplode("y").alias("i", "v")).groupBy("i").agg(F.avg("v").alias("m")).orderBy("i").collect()]
    gap = F.zip_with("y", F.array(*[F.lit(v) for v in means]), lambda a, b: a - b)
    cov = scatter(block_matrix(white, "index", gap, n, len(means), rows_per_block)) / n
    error = float(np.abs(cov[np.ix_(live, live)] - np.eye(len(live))).max()) if len(live) else 0.0
    all_rows = block_matrix(rows, "rid", centred(F.col("x"), n, model.sums), m, d, rows_per_block)
    flat = F.array(*[F.lit(i in set(live.tolist())) for i in range(len(means))])
    whitened = F.zip_with("y", flat, lambda a, ok: F.when(ok, a))
    squares = F.aggregate(
        scaled_deviation(F.col("x"), n, model.sums),
        F.lit(0).cast("long"),
        lambda acc, e: F.try_add(acc, F.try_multiply(e, e)),
    )
    ids = rows.select("rid", "vec_id", squares.alias("deviation"))
    out = projected(all_rows, model.matrix).join(ids, F.col("index") == F.col("rid"))
    return out.select(
        "vec_id",
        F.lit(n).cast("long").alias("n"),
        "deviation",
        whitened.alias("whitened"),
        F.array(*[F.lit(e) for e in explained]).alias("explained"),
        F.lit(error).alias("identity_error"),
    )


def whitened_components(emb: DataFrame, components: int = 16) -> DataFrame:
    """One row per vector and component (numbered from 1): the columns of ``SCHEMA``."""
    wide = whiten(emb, components)
    long = wide.select("vec_id", "n", "deviation", "identity_error", F.posexplode(F.arrays_zip("whitened", "explained")).alias("i", "c"))
    return long.select("vec_id", (F.col("i") + 1).cast("int").alias("component"), "n", "deviation", "c.whitened", "c.explained", "identity_error")
