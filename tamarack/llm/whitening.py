"""Whitening of embeddings with distributed block matrices (``pyspark.mllib``).

Rows are centred exactly, indexed, and cut into blocks of a ``BlockMatrix``. The block
matrix multiplied by its own transpose gives the scatter matrix, whose eigenvectors are
found on the driver (dimension by dimension numbers); a second product with the
whitening matrix projects the rows. Sums run in Spark throughout.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamarack.session import stage, unstage

COMPONENTS = 32
# Entries become whole numbers: floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
# Larger entries are no whole numbers that a double can hold.
LARGEST = 2.0**53 / SCALE
# Eigenvalues below this share of the largest are rounding errors and give no component.
LEAST_SHARE = 1e-11
# Numbers in one block (1 MB), columns of one block at most, and row blocks that one task multiplies.
BLOCK_NUMBERS, BLOCK_COLUMNS, BLOCKS_PER_TASK = 1 << 17, 1024, 32

WHOLE = "decimal(38,0)"


def _blocks(rows: DataFrame, values: Column, n: int, width: int) -> BlockMatrix:
    """The block matrix of ``n`` rows with a dense ``index`` and an array of ``width`` doubles."""
    vectors = rows.select("index", array_to_vector(values).alias("vector"))
    matrix = IndexedRowMatrix(MLUtils.convertVectorColumnsFromML(vectors, "vector"), n, width)
    return matrix.toBlockMatrix(max(BLOCK_NUMBERS // width, 1), min(width, BLOCK_COLUMNS))


def scatter(matrix: BlockMatrix) -> np.ndarray:
    """The transposed matrix times the matrix, as a local array.

    The rows are split between tasks by ``BLOCKS_PER_TASK`` row blocks (the products are
    added up by key); without that split, one task would get all rows of a narrow matrix.
    """
    splits = -(-matrix.numRowBlocks // BLOCKS_PER_TASK)
    right = matrix._java_matrix_wrapper._java_model
    product = right.transpose().multiply(right, splits)
    wide = BlockMatrix(product, matrix.colsPerBlock, matrix.colsPerBlock)
    return wide.toLocalMatrix().toArray()


def project(matrix: BlockMatrix, onto: np.ndarray) -> DataFrame:
    """``index, projected``: every row of the matrix times ``onto``."""
    context = matrix.blocks.context
    step, width = matrix.colsPerBlock, onto.shape[1]
    parts = [onto[start : start + step] for start in range(0, len(onto), step)]
    blocks = context.parallelize(
        [((k, 0), DenseMatrix(len(p), width, p.ravel(order="F"))) for k, p in enumerate(parts)], len(parts)
    )
    product = matrix.multiply(BlockMatrix(blocks, step, width))
    rows = callMLlibFunc("getIndexedRows", product.toIndexedRowMatrix()._java_matrix_wrapper._java_model)
    rows = MLUtils.convertVectorColumnsToML(rows, "vector")
    return rows.select("index", vector_to_array("vector").alias("projected"))


def _indexed(rows: DataFrame) -> DataFrame:
    """Add a dense ``index`` from 0; ``row`` is a stored ``monotonically_increasing_id``."""
    part = F.shiftright("row", 33).alias("part")
    counts = rows.groupBy(part).agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("first"))
    # One row for each partition of the stored table.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("offset"))
    joined = rows.withColumn("part", part).join(offsets, "part")
    return joined.withColumn("index", F.col("row") + F.col("offset")).drop("part", "offset", "row")


def whole_entries(vector: Column) -> Column:
    """``floor(64 c) + 1000000`` of every entry, as longs."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE).cast("long") + SHIFT)


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its entries are numbers that are not too large."""
    fit = F.forall(vector, lambda c: F.coalesce(F.abs(c.cast("double")) < LARGEST, F.lit(False)))
    return vector.isNotNull() & fit


def whitened_embeddings(
    vectors: DataFrame,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    components: int = COMPONENTS,
) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` for each row and component.

    Rows whose vector is null or holds a null, NaN, infinite or too large entry
    (2**47 and more) are left out, and so are rows of another length than the most
    frequent one (of equally frequent lengths the longest counts). The fit is over all
    others. Components are the eigenvectors of the covariance (divisor n), numbered from
    1 by falling eigenvalue, their largest entry positive; eigenvalues that are rounding
    errors (below 1e-11 of the largest) give no component, so n equal rows give no
    result. Equal eigenvalues come in any order. ``deviation`` is exact; it is null where
    a long cannot hold it. Repeated rows and ids count as often as they occur; a null id
    stays. Other columns are not read; no rows give no rows.
    """
    spark = vectors.sparkSession
    result = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    own = F.col(vector_column)
    good = vectors.where(usable(own)).select(F.col(id_column).cast("long").alias("vec_id"), whole_entries(own).alias("x"))
    rows = stage(good.withColumn("row", F.monotonically_increasing_id()), "vectors")
    lengths = rows.groupBy(F.size("x").alias("width")).agg(F.count(F.lit(1)).alias("n"))
    widest = lengths.orderBy(F.desc("n"), F.desc("width")).limit(2).collect()
    if not widest or not widest[0]["width"]:
        return spark.createDataFrame([], result)
    width, n = widest[0]["width"], widest[0]["n"]
    if len(widest) > 1:
        ragged = rows
        same = ragged.where(F.size("x") == width).withColumn("row", F.monotonically_increasing_id())
        rows = stage(same, "vectors")
        unstage(ragged)
    rows = _indexed(rows)

    entries = rows.select(F.posexplode("x").alias("place", "x"))
    sums = entries.groupBy("place").agg(F.sum(F.col("x").cast(WHOLE)).alias("sum")).orderBy("place").collect()
    sums = F.array(*[F.lit(r["sum"]).cast(WHOLE) for r in sums])
    # n * x - S is a whole number: nothing is lost before the one division by n.
    off = F.zip_with("x", sums, lambda x, s: (F.lit(n).cast("decimal(19,0)") * x.cast("decimal(19,0)") - s).cast(WHOLE))
    rows = rows.withColumn("off", off)
    matrix = _blocks(rows, F.transform("off", lambda v: v.cast("double") / n), n, width)
    covariance = scatter(matrix) / n
    values, directions = np.linalg.eigh((covariance + covariance.T) / 2)
    values, directions = values[::-1], directions[:, ::-1]
    count = min(components, int((values > LEAST_SHARE * max(values[0], 0)).sum()))
    if not count:
        return spark.createDataFrame([], result)
    values, trace, directions = values[:count], float(np.trace(covariance)), directions[:, :count]
    signs = np.sign(directions[np.abs(directions).argmax(axis=0), np.arange(count)])
    projected = stage(project(matrix, directions * signs / np.sqrt(values)), "projected")

    means = projected.agg(*[F.avg(F.get("projected", F.lit(k))).alias(f"m{k}") for k in range(count)]).first()
    centred = F.zip_with("projected", F.array(*map(F.lit, means)), lambda y, m: y - m)
    error = float(np.abs(scatter(_blocks(projected, centred, n, count)) / n - np.eye(count)).max())

    square = F.expr(f"""try_cast(aggregate(transform(off, v -> try_multiply(v, v)), cast(0 as {WHOLE}),
                                           (total, v) -> cast(try_add(total, v) as {WHOLE})) as bigint)""")
    explained = F.get(F.array(*[F.lit(float(v) / trace) for v in values]), F.col("place"))
    return (
        rows.select("index", "vec_id", square.alias("deviation"))
        .join(projected, "index")
        .select("vec_id", "deviation", F.posexplode("projected").alias("place", "whitened"))
        .select(
            "vec_id",
            (F.col("place") + 1).alias("component"),
            F.lit(n).cast("long").alias("n"),
            "deviation",
            "whitened",
            explained.alias("explained"),
            F.lit(error).alias("identity_error"),
        )
    )
