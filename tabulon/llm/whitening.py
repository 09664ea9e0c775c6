"""Embedding whitening with MLlib's BlockMatrix.

Entries become whole numbers x = floor(256 c).  The fit list holds each distinct x
vector once; its rows, centred and indexed from 0, form a BlockMatrix A of one block
column.  The scatter matrix is A' A, multiplied block row by block row and summed; its eigenvectors come
from a local eigh of the d x d matrix, and a product with the whitening matrix (unit
eigenvectors over the roots of their eigenvalues) projects the rows.

Blocks have n / BLOCKS rows, but 256 at least and at most BLOCK_CELLS cells, so one block fits a task; they are
packed by a groupBy, since MLlib's own conversion of indexed rows boxes every entry.  The
driver holds the d x d matrix and MLlib's list of block numbers: BLOCKS up to 17 GB of
vectors, beyond that one pair of numbers for each BLOCK_CELLS cells.

Defined results: rows whose vector is null or holds a null or non-finite entry have no
result, nor have empty vectors and those of another width than the most frequent one (of several
the least).  Entries beyond 64 bits count as the nearest long.  Repeated rows stay repeated and count
once in the fit.  Components whose eigenvalue is 0 to rounding (1e-12 of the trace) do
not exist; a fit of equal vectors has none and gives no rows, as an empty table does.
deviation is decimal(38, 0), null beyond 38 digits.  Columns are carried in a struct, so none clashes.
"""

from __future__ import annotations

import numpy as np
from pyspark.mllib.linalg import Matrices
from pyspark.mllib.linalg.distributed import BlockMatrix
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored

BLOCKS = 4096
BLOCK_CELLS = 1 << 20
#: Eigenvalues up to this part of the trace are 0.
NOTHING = 1e-12


def usable(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """(row, x) of the rows with a whole vector; row: struct of all columns, x: array of long."""
    c = F.col(vector)
    whole = F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < F.lit(float("inf"))))
    kept = vectors.where(c.isNotNull() & (F.size(c) > 0) & whole)
    return kept.select(F.struct(*(vectors[n] for n in vectors.columns)).alias("row"), F.transform(c, lambda v: F.floor(v.cast("double") * F.lit(256.0))).alias("x"))


def indexed(rows: DataFrame, name: str) -> DataFrame:
    """rows with index, 0 to their number - 1: stored by task, and each task's first index from the tasks' counts."""
    placed = stored(rows.withColumn("at", F.monotonically_increasing_id()), name)
    task = F.shiftrightunsigned("at", 33)
    counts = placed.groupBy(task.alias("task")).count()
    first = stored(counts.select("task", (F.sum("count").over(Window.orderBy("task")) - F.col("count")).alias("first")), "tasks")
    return placed.join(first, task == F.col("task")).withColumn("index", F.col("first") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).drop("task", "first", "at")


def _centred(mean: list[float]) -> F.Column:
    return F.zip_with("x", F.array(*map(F.lit, mean)), lambda v, m: v.cast("double") - m)


def blocks(rows: DataFrame, mean: list[float], n: int) -> BlockMatrix:
    """The centred x of rows (index, x) as a matrix of n rows in one column of blocks."""
    d = len(mean)
    high = max(1, min(max(256, -(-n // BLOCKS)), BLOCK_CELLS // d))
    placed = rows.select(F.floor(F.col("index") / high).cast("int").alias("block"), (F.col("index") % high).cast("int").alias("place"), _centred(mean).alias("v"))
    packed = placed.groupBy("block").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "v"))), lambda x: x["v"]).alias("rows"))
    dense = packed.rdd.map(lambda r: ((r["block"], 0), Matrices.dense(len(r["rows"]), d, np.array(r["rows"]).ravel(order="F"))))
    return BlockMatrix(dense, high, d, n, d)


def coordinates(a: BlockMatrix) -> DataFrame:
    """(index, whitened): the rows of a matrix of one column of blocks."""
    high = a.rowsPerBlock
    rows = a.blocks.flatMap(lambda b: [(b[0][0] * high + i, row.tolist()) for i, row in enumerate(b[1].toArray())])
    return SparkSession.active().createDataFrame(rows, "index bigint, whitened array<double>")


def scatter(a: BlockMatrix) -> np.ndarray:
    """a' a, on the driver.  Each block row is multiplied in a task of its own: without the split of
    the middle dimension, which Python's multiply does not pass on, one task would read them all."""
    java = a.transpose()._java_matrix_wrapper.call("multiply", a._java_matrix_wrapper._java_model, int(a.numRowBlocks))
    return BlockMatrix(java, a.colsPerBlock, a.colsPerBlock).toLocalMatrix().toArray()


def projected(a: BlockMatrix, whitening: np.ndarray) -> BlockMatrix:
    """a times the whitening matrix, a single block that goes to every block of a."""
    d, k = whitening.shape
    one = SparkSession.active().sparkContext.parallelize([((0, 0), Matrices.dense(d, k, whitening.ravel(order="F")))], 1)
    return a.multiply(BlockMatrix(one, d, k, d, k))


def whiten(vectors: DataFrame, vector: str = "embedding", components: int | None = None) -> DataFrame:
    """(row, n, deviation, whitened, explained, identity_error) of every usable row of vectors.

    whitened: the row's first `components` (all by default) whitened coordinates; explained: each one's
    share of the variance; deviation: its squared distance from the mean, times n squared; identity_error: the largest
    entry by which the covariance of the fit list's whitened vectors differs from the identity.
    """
    schema = "n bigint, deviation decimal(38,0), whitened array<double>, explained array<double>, identity_error double"
    found = stored(usable(vectors, vector), "usable")
    widths = found.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if widths is None:
        return _nothing(found, schema)
    d = widths["d"]
    found = found.where(F.size("x") == d)
    fit = indexed(found.select("x").distinct(), "fit")
    flat = fit.select(F.posexplode("x").alias("i", "v"))
    sums = dict(flat.groupBy("i").agg(F.sum(F.col("v").cast("decimal(20,0)")).alias("s")).collect())
    n = fit.count()
    sums = [int(sums[i]) for i in range(d)]
    mean = [s / n for s in sums]

    a = blocks(fit, mean, n)
    values, basis = np.linalg.eigh(scatter(a) / n)
    order = np.argsort(-values, kind="stable")
    values, basis = values[order], basis[:, order]
    trace = float(values.sum())
    k = int((values > NOTHING * trace).sum()) if trace > 0 else 0
    k = min(k, components or k)
    if not k:
        return _nothing(found, schema)
    whitening = basis[:, :k] / np.sqrt(values[:k])
    error = float(np.abs(scatter(projected(a, whitening)) / n - np.eye(k)).max())

    rows = indexed(found, "rows")
    shown = coordinates(projected(blocks(rows, mean, rows.count()), whitening))
    exact = lambda v: v.cast("decimal(38,0)")
    centre = F.array(*[F.lit(str(s)).cast("decimal(38,0)") for s in sums])
    apart = F.zip_with("x", centre, lambda x, s: F.try_subtract(F.try_multiply(exact(x), F.lit(n).cast("decimal(38,0)")), s))
    deviation = F.aggregate(apart, exact(F.lit(0)), lambda acc, y: exact(F.try_add(acc, exact(F.try_multiply(exact(y), exact(y))))))
    shares = F.array(*[F.lit(float(v / trace)) for v in values[:k]])
    return rows.join(shown, "index").select("row", F.lit(n).cast("bigint").alias("n"), deviation.alias("deviation"), "whitened", shares.alias("explained"), F.lit(error).alias("identity_error"))


def _nothing(found: DataFrame, schema: str) -> DataFrame:
    return found.sparkSession.createDataFrame([], f"row {found.schema['row'].dataType.simpleString()}, {schema}")
