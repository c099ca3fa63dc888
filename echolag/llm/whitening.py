"""Whitening of embeddings on MLlib's distributed ``BlockMatrix``.

1. Every entry is quantized to a whole number. The distinct vectors are the fit list, so copies of one vector, however many,
   count once.
2. The fit list is numbered without gaps and centred; its rows become an ``IndexedRowMatrix`` and that a ``BlockMatrix``.
3. Scatter: the transposed matrix times the matrix, with the rows dealt to many tasks. The result has one row and column per
   dimension; its eigenvectors are found on the driver, which holds nothing else.
4. The block matrix times the whitening matrix projects the rows of the fit list; every input row looks its vector up there.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import lookup
from ..session import materialize

SCALE = 256
COMPONENTS = 4
# rows and columns of a block; with very many vectors blocks have more rows, so that the driver's list of blocks stays short
BLOCK_ROWS = 1024
BLOCK_COLUMNS = 1024
MOST_BLOCKS = 200_000
# blocks that one task of the scatter multiplies
TASK_BLOCKS = 16


def quantized(vector: str, scale: int = SCALE) -> tuple[Column, Column]:
    """Whether ``vector`` is usable, with neither null nor non-finite entries, and its entries as whole numbers."""
    entries = F.col(vector).cast("array<double>")
    finite = F.forall(entries, lambda c: c.isNotNull() & (F.abs(c) < F.lit(math.inf)))
    whole = F.transform(entries, lambda c: F.floor(c * F.lit(float(scale))).cast("bigint"))
    return F.col(vector).isNotNull() & finite, whole


def _numbered(fit: DataFrame) -> DataFrame:
    """``fit`` written with ``index``, 0, 1, 2 … without gaps; only the sizes of its partitions are summed in one place."""
    places = 1 << 33
    placed = materialize(fit.withColumn("_id", F.monotonically_increasing_id()), "fit")
    placed = placed.withColumn("_part", F.floor(F.col("_id") / places))
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    return lookup(placed, starts, ["_part"]).select(
        *fit.columns, (F.col("_start") + F.col("_id") % places).alias("index")
    )


def _times(left: BlockMatrix, right: BlockMatrix, tasks: int) -> BlockMatrix:
    """The product, with the inner dimension dealt to ``tasks`` tasks."""
    product = left._java_matrix_wrapper.call("multiply", right._java_matrix_wrapper._java_model, tasks)
    return BlockMatrix(product, left.rowsPerBlock, right.colsPerBlock)


def _blocks_of(small: np.ndarray, rows: DataFrame) -> BlockMatrix:
    """A matrix of the driver with one block per ``BLOCK_COLUMNS`` rows."""
    parts = [small[at : at + BLOCK_COLUMNS] for at in range(0, len(small), BLOCK_COLUMNS)]
    blocks = [((k, 0), DenseMatrix(*part.shape, part.ravel(order="F"))) for k, part in enumerate(parts)]
    return BlockMatrix(rows.sparkSession.sparkContext.parallelize(blocks, 1), BLOCK_COLUMNS, BLOCK_COLUMNS)


def _doubles(values: np.ndarray) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def _longs(values: list[int]) -> Column:
    """``values``, null where beyond a long."""
    return F.array(*[F.lit(v if abs(v) < 1 << 63 else None).cast("bigint") for v in values])


def whiten(
    vectors: DataFrame,
    id: str = "vec_id",
    vector: str = "embedding",
    components: int = COMPONENTS,
    scale: int = SCALE,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) per usable row and component.

    Rows whose vector is null or holds a null or non-finite entry are left out. Entries beyond a long are set to its bounds,
    and ``deviation`` is null where it passes a long. Vectors shorter than the longest one count as filled up with zeros; the
    longest one should have a few thousand entries at most, since the covariance has its square and goes to the driver.
    Repeated vectors count once for the fit, and each of their rows, also those that repeat an id or have none, has its own
    result. There are as many components as dimensions where that is less than ``components``. A component without variance
    has null in ``whitened``, and ``explained`` and ``identity_error`` are null where no component has any. Eigenvectors
    have their largest entry positive. An empty table gives an empty table; other columns are ignored.
    """
    spark = vectors.sparkSession
    usable, whole = quantized(vector, scale)
    rows = materialize(vectors.where(usable).select(F.col(id).alias("id"), whole.alias("x")), "vectors")
    width = rows.agg(F.max(F.size("x"))).first()[0] or 0
    if not width:
        return spark.createDataFrame([], T.StructType([vectors.schema[id], *_RESULT]))
    zeros = F.array_repeat(F.lit(0).cast("bigint"), F.lit(width) - F.size("x"))
    rows = rows.withColumn("x", F.concat("x", zeros))
    digest = F.unhex(F.sha2(F.array_join(F.col("x").cast("array<string>"), ","), 256))
    rows = rows.withColumn("digest", digest)

    fit = _numbered(rows.groupBy("digest", "x").agg(F.count(F.lit(1)).alias("copies")))
    n = fit.count()
    sums = fit.select(F.posexplode("x").alias("dimension", "value")).groupBy("dimension")
    total = {r[0]: int(r[1]) for r in sums.agg(F.sum(F.col("value").cast("decimal(20,0)"))).collect()}
    total = [total[k] for k in range(width)]
    mean = np.array([s / n for s in total])

    centred = F.zip_with("x", _doubles(mean), lambda x, m: x.cast("double") - m)
    ml_rows = fit.select("index", array_to_vector(centred).alias("vector"))
    block_rows = max(block_rows, math.ceil(n / MOST_BLOCKS))
    matrix = IndexedRowMatrix(MLUtils.convertVectorColumnsFromML(ml_rows, "vector"), n, width)
    blocks = matrix.toBlockMatrix(block_rows, BLOCK_COLUMNS)
    n_blocks = math.ceil(n / block_rows)
    tasks = min(n_blocks, max(spark.sparkContext.defaultParallelism, n_blocks // TASK_BLOCKS))
    covariance = _times(blocks.transpose(), blocks, tasks).toLocalMatrix().toArray() / n
    covariance = (covariance + covariance.T) / 2
    trace = float(np.trace(covariance))
    values, axes = np.linalg.eigh(covariance)
    count = min(components, width)
    values, axes = values[::-1][:count], axes[:, ::-1][:, :count]
    axes = axes * np.sign(axes[np.abs(axes).argmax(0), np.arange(count)])
    varies = values > max(trace, 0.0) * width * np.finfo(float).eps
    whitening = np.where(varies, axes / np.sqrt(np.where(varies, values, 1.0)), 0.0)

    projected = _times(blocks, _blocks_of(whitening, rows), 1).toIndexedRowMatrix()
    projected = callMLlibFunc("getIndexedRows", projected._java_matrix_wrapper._java_model)
    projected = MLUtils.convertVectorColumnsToML(projected, "vector")
    projected = materialize(projected.select("index", vector_to_array("vector").alias("whitened")), "projected")
    error = _identity_error(projected, np.flatnonzero(varies).tolist())

    def away(x: Column, s: Column) -> Column:
        step = F.try_subtract(F.try_multiply(x, F.lit(n).cast("bigint")), s)
        return F.try_multiply(step, step)

    squares = F.zip_with("x", _longs(total), away)
    deviation = F.aggregate(squares, F.lit(0).cast("bigint"), lambda a, b: F.try_add(a, b))
    known = lookup(fit.select("digest", "index", deviation.alias("deviation")), projected, ["index"])
    result = rows.select("id", "digest").join(known, "digest")
    place = F.col("_component")
    return result.select("id", "deviation", F.posexplode("whitened").alias("_component", "_value")).select(
        F.col("id").alias(id),
        (place + 1).alias("component"),
        F.lit(n).cast("bigint").alias("n"),
        "deviation",
        F.when(F.get(F.array(*[F.lit(bool(v)) for v in varies]), place), F.col("_value")).alias("whitened"),
        F.get(_doubles(values / trace), place).alias("explained") if trace > 0 else F.lit(None).cast("double").alias("explained"),
        F.lit(error).cast("double").alias("identity_error"),
    )


_RESULT = [
    T.StructField("component", T.IntegerType()),
    T.StructField("n", T.LongType()),
    T.StructField("deviation", T.LongType()),
    T.StructField("whitened", T.DoubleType()),
    T.StructField("explained", T.DoubleType()),
    T.StructField("identity_error", T.DoubleType()),
]


def _identity_error(projected: DataFrame, varying: list[int]) -> float | None:
    """The largest absolute entry of the covariance of ``whitened`` minus the identity, among components with variance."""
    if not varying:
        return None
    pairs = [(a, b) for a in varying for b in varying if a <= b]
    entry = lambda k: F.get("whitened", F.lit(k))
    found = projected.agg(*[F.covar_pop(entry(a), entry(b)) for a, b in pairs]).first()
    return max(abs(value - (a == b)) for value, (a, b) in zip(found, pairs, strict=True))
