"""Bring sources with different schemas to one text column."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Names under which sources keep their content, in order of preference.
CONTENT_FIELDS = ("content", "text", "src", "code")


def resolve_content(columns: Sequence[str], candidates: Sequence[str] = CONTENT_FIELDS) -> tuple[str, bool]:
    """The content column of a source and whether it is only the first-column fallback."""
    for name in candidates:
        if name in columns:
            return name, False
    return columns[0], True


def resolve_text_fields(columns: Sequence[str], wanted: Sequence[str]) -> list[str]:
    """The wanted fields a source has; none at all is an error that names what there is."""
    present = [name for name in wanted if name in columns]
    if not present:
        raise ValueError(f"none of {list(wanted)} found; the source has {list(columns)}")
    return present


def as_text(df: DataFrame, name: str) -> Column:
    """A column as text without nulls; nested values as JSON."""
    nested = isinstance(df.schema[name].dataType, (T.ArrayType, T.MapType, T.StructType))
    col = F.col(name)
    return F.coalesce(F.to_json(col) if nested else col.cast("string"), F.lit(""))


def align_text(
    df: DataFrame,
    keep: Sequence[str | Column] = (),
    candidates: Sequence[str] = CONTENT_FIELDS,
) -> DataFrame:
    """Exactly the kept key columns and a never-null ``text``."""
    name, _ = resolve_content(df.columns, candidates)
    return df.select(*keep, as_text(df, name).alias("text"))


def coalesce_content(df: DataFrame, keep: Sequence[str] = (), candidates: Sequence[str] = CONTENT_FIELDS) -> DataFrame:
    """Row-wise form for tables in which the filled content column differs by row."""
    present = resolve_text_fields(df.columns, candidates)
    parts = [F.col(c).cast("string") for c in present]
    return df.select(*keep, F.coalesce(*parts, F.lit("")).alias("text"))


def union_sources(sources: Mapping[str, DataFrame]) -> DataFrame:
    """Concatenate by column name under an ``origin`` label; duplicates stay."""
    if not sources:
        raise ValueError("no sources to combine")
    out = None
    for name, df in sources.items():
        tagged = df.select(F.lit(name).alias("origin"), "*")
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out


def schema_census(
    spark: SparkSession,
    sources: Mapping[str, DataFrame],
    candidates: Sequence[str] = CONTENT_FIELDS,
) -> DataFrame:
    """One row per source from its schema alone: columns, chosen content column, usable or not."""
    rows = []
    for name, df in sources.items():
        content, fallback = resolve_content(df.columns, candidates)
        rows.append((name, len(df.columns), ",".join(df.columns), content, not fallback))
    schema = "origin string, n_columns int, column_names string, content_column string, usable boolean"
    return spark.createDataFrame(rows, schema)


def usable_sources(
    sources: Mapping[str, DataFrame], candidates: Sequence[str] = CONTENT_FIELDS
) -> dict[str, DataFrame]:
    """Only the sources that have one of the content columns; decided before any read."""
    return {n: df for n, df in sources.items() if not resolve_content(df.columns, candidates)[1]}


def dataset_card(aligned: DataFrame) -> DataFrame:
    """Size facts per origin of an aligned union."""
    size = F.length("text").cast("long")
    return aligned.groupBy("origin").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(size == 0).alias("n_empty"),
        F.sum(size).alias("total_chars"),
        F.min(size).alias("min_chars"),
        F.max(size).alias("max_chars"),
    )


def shard_budget(df: DataFrame, shard: str, target: int) -> DataFrame:
    """Shards to read, in name order, until twice the target is reached.

    A shard is read while the total *before* it is below ``2 * target``. The
    window runs over one row per shard, not over the data.
    """
    sizes = df.groupBy(shard).agg(F.count(F.lit(1)).alias("n_rows"))
    upto = Window.orderBy(shard).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = sizes.withColumn("running_rows", F.sum("n_rows").over(upto))
    return totals.filter(F.col("running_rows") - F.col("n_rows") < 2 * target)


def select_by_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key is in ``ids``; Spark picks the join from the sizes it sees."""
    return df.join(ids.select(key), key, "left_semi")
