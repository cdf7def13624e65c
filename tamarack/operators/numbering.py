"""Row numbers and short look-back windows that split large groups.

A plain ``row_number() over (partition by run ...)`` puts a whole run into one
task. A table that fits a task is numbered that way. Any other is laid out in
ranges of group and order, which cut long runs wherever they need to be cut, and
each range is numbered from the count of the rows before it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tamarack.session import stage

ROWS_PER_SLICE = 1_000_000
CHUNK_STEPS = 100_000
# Session setting that overrides ROWS_PER_SLICE.
ROWS_PER_SLICE_SETTING = "spark.tamarack.rowsPerSlice"


def rows_per_slice_of(spark: SparkSession) -> int:
    return int(spark.conf.get(ROWS_PER_SLICE_SETTING, str(ROWS_PER_SLICE)))


def in_ranges(
    df: DataFrame, order: Sequence[str | Column], rows_per_slice: int | None = None, name: str = "_slice"
) -> DataFrame | None:
    """Add a slice number that never falls in the given order; None if all rows fit one slice.

    The slices are the ranges of a range partitioning, about equally large
    whatever the types of the columns and however long one group is. The result
    is stored, so that every later job sees the same slices. Only rows that are
    equal in all columns of the order cannot be parted.
    """
    rows_per_slice = rows_per_slice or rows_per_slice_of(df.sparkSession)
    wanted = -(-df.count() // rows_per_slice)
    if wanted <= 1:
        return None
    ranged = df.repartitionByRange(wanted, *order).withColumn(name, F.spark_partition_id())
    return stage(ranged, "ranges")


def number_sliced(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str | Column],
    slice_name: str,
    position: str = "step",
    size: str = "n_steps",
) -> DataFrame:
    """Number rows 1..n in each group, given a slice column in row order.

    Rows are counted per group and slice, the counts are summed up over the
    slices, and each slice numbers its own rows from that offset. The offset
    travels as an extra first row of its slice, so the rows are shuffled once
    and joined with nothing.
    """
    cell = [*group, slice_name]
    counts = df.groupBy(*cell).agg(F.count(F.lit(1)).alias("_n"))
    # one row per group and slice: at most as many rows per group as there are slices
    whole = Window.partitionBy(*group)
    before = whole.orderBy(slice_name).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *cell,
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
        F.sum("_n").over(whole).alias("_total"),
        F.lit(True).alias("_first"),
    )
    rows = df.withColumn("_first", F.lit(False)).unionByName(offsets, allowMissingColumns=True)
    of_cell = Window.partitionBy(*cell)
    number = F.row_number().over(of_cell.orderBy(F.col("_first").desc(), *order))
    offset = F.coalesce(F.max("_before").over(of_cell) - 1, F.lit(0))
    total = F.coalesce(F.max("_total").over(of_cell), F.count(F.lit(1)).over(of_cell))
    numbered = rows.withColumn(position, (number + offset).cast("long")).withColumn(size, total)
    return numbered.filter(~F.col("_first")).drop("_first", "_before", "_total", slice_name)


def number_whole(
    df: DataFrame, group: Sequence[str], order: Sequence[str | Column], position: str = "step", size: str = "n_steps"
) -> DataFrame:
    """Number rows 1..n in groups that each fit a task."""
    of_group = Window.partitionBy(*group)
    number = F.row_number().over(of_group.orderBy(*order)).cast("long")
    return df.withColumn(position, number).withColumn(size, F.count(F.lit(1)).over(of_group))


def number_rows(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str | Column],
    position: str = "step",
    size: str = "n_steps",
    rows_per_slice: int | None = None,
) -> DataFrame:
    """Add the 1-based ``position`` and the group ``size`` to every row.

    Groups and order may be of any sortable type. A slice has
    ``spark.tamarack.rowsPerSlice`` rows if no number is given.
    """
    sliced = in_ranges(df, [*group, *order], rows_per_slice)
    if sliced is None:
        return number_whole(df, group, order, position, size)
    return number_sliced(sliced, group, order, "_slice", position, size)


def look_around(
    df: DataFrame,
    group: Sequence[str],
    step: str,
    before: int,
    columns: dict,
    after: int = 0,
    chunk_steps: int = CHUNK_STEPS,
    whole: bool = False,
) -> DataFrame:
    """Evaluate window columns that look at most ``before``/``after`` rows away.

    ``columns`` maps a name to a function of the window ``partition by ... order
    by step``. Steps must be dense (1..n in each group). They are cut into
    chunks of equal length; rows at a chunk's edge are also sent to the
    neighbouring chunk, where they serve as context and are dropped afterwards.
    With ``whole`` every group is known to fit a task and none is cut; the
    window then uses the partitioning that numbering by group has left.
    """
    if whole:
        window = Window.partitionBy(*group).orderBy(step)
        for name, build in columns.items():
            df = df.withColumn(name, build(window))
        return df
    if before >= chunk_steps or after >= chunk_steps:
        raise ValueError("chunks must be longer than the window")
    number = F.col(step) - 1
    home = F.floor(number / chunk_steps)
    into = number - home * chunk_steps
    places = [home]
    if before:
        places.append(F.when(into >= chunk_steps - before, home + 1))
    if after:
        places.append(F.when((into < after) & (home > 0), home - 1))
    spread = df.withColumn("_home", home).withColumn("_chunk", F.explode(F.array_compact(F.array(*places))))
    window = Window.partitionBy(*group, "_chunk").orderBy(step)
    for name, build in columns.items():
        spread = spread.withColumn(name, build(window))
    return spread.filter(F.col("_chunk") == F.col("_home")).drop("_home", "_chunk")
