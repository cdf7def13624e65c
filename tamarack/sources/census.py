"""Schemas of the files of a mixed folder, from their footers alone."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack.operators.align import CONTENT_FIELDS
from tamarack.sources.arrow_ipc import BROKEN, Shard, _system
from tamarack.sources.scan import list_shards

# File systems that pyarrow opens by itself; files elsewhere are read through Spark, whole.
DIRECT = re.compile(r"^(/|file:|s3:|gs:|gcs:|hdfs:)")
FIELDS = "path string, content binary"
CENSUS = "path string, kind string, n_rows long, columns array<struct<name: string, type: string>>, reason string"


def _footer(handle: pa.NativeFile, name: str) -> tuple[str, int | None, pa.Schema]:
    if name.endswith(".arrow"):
        shard = Shard(handle)
        if shard.reason:
            raise ValueError(shard.reason)
        return f"arrow {shard.kind}", None, shard.schema
    file = pq.ParquetFile(handle)
    return "parquet", file.metadata.num_rows, file.schema_arrow


def _read_footers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for row in batch.to_pylist():
            path, content = row["path"], row.get("content")
            try:
                if content is not None:
                    kind, n, schema = _footer(pa.BufferReader(content), path)
                else:
                    system, own = _system(path)
                    with system.open_input_file(own) as handle:
                        kind, n, schema = _footer(handle, path)
                columns = [{"name": f.name, "type": str(f.type)} for f in schema]
                rows.append((path, kind, n, columns, None))
            except BROKEN as lost:
                rows.append((path, "unreadable", None, [], str(lost)))
        columns = [list(c) for c in zip(*rows, strict=True)] or [[]] * 5
        types = [pa.string(), pa.string(), pa.int64(), pa.list_(pa.struct([("name", pa.string()), ("type", pa.string())])), pa.string()]
        arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
        yield pa.RecordBatch.from_arrays(arrays, ["path", "kind", "n_rows", "columns", "reason"])


def file_census(
    spark: SparkSession,
    path: str | Sequence[str],
    pattern: str | None = None,
    recursive: bool = False,
    candidates: Sequence[str] = CONTENT_FIELDS,
) -> DataFrame:
    """One row per file: ``path, file_name, kind, n_rows, columns, schema_digest, content_column, usable, reason``.

    Footers are opened in tasks, a few files each; no rows are read. ``content_column``
    is the first candidate that the file has, or else its first column, and ``usable``
    says whether it is a candidate. A file that does not open is ``unreadable`` and has no
    columns. The number of rows of an Arrow file is not in its footer and is null.
    """
    files = list_shards(spark, path, pattern, recursive).select("path")
    first = [path] if isinstance(path, str) else list(path)
    if all(DIRECT.match(p) for p in first):
        cores = spark.sparkContext.defaultParallelism
        opened = files.repartition(cores, "path")
    else:
        reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
        reader = reader.option("pathGlobFilter", pattern) if pattern else reader
        opened = reader.load(first).select("path", "content")
    found = opened.mapInArrow(_read_footers, CENSUS)
    names = F.transform("columns", lambda c: c["name"])
    chosen = F.coalesce(
        *[F.when(F.array_contains(names, name), F.lit(name)) for name in candidates], F.get(names, F.lit(0))
    )
    digest = F.md5(F.array_join(F.transform("columns", lambda c: F.concat(c["name"], F.lit("\t"), c["type"])), "\n"))
    return found.select(
        "path",
        F.element_at(F.split("path", "/"), -1).alias("file_name"),
        "kind",
        "n_rows",
        "columns",
        F.when(F.col("kind") != "unreadable", digest).alias("schema_digest"),
        chosen.alias("content_column"),
        F.coalesce(chosen.isin(*candidates), F.lit(False)).alias("usable"),
        "reason",
    )


def schema_groups(census: DataFrame) -> DataFrame:
    """Files by schema: ``schema_digest, n_files, n_rows, column_names, example``; unreadable ones are one group."""
    return census.groupBy("schema_digest").agg(
        F.count(F.lit(1)).alias("n_files"),
        F.sum("n_rows").alias("n_rows"),
        F.first(F.array_join(F.transform("columns", lambda c: c["name"]), ",")).alias("column_names"),
        F.min("path").alias("example"),
    )


def schema_conflicts(census: DataFrame) -> DataFrame:
    """Columns that have several types: ``name, type, n_files, example``, a row for each type."""
    types = census.select("path", F.inline("columns")).groupBy("name", "type")
    counted = types.agg(F.count(F.lit(1)).alias("n_files"), F.min("path").alias("example"))
    several = counted.groupBy("name").agg(F.count(F.lit(1)).alias("n_types")).where("n_types > 1").select("name")
    return counted.join(several, "name", "left_semi").select("name", "type", "n_files", "example")


def usable_paths(census: DataFrame) -> DataFrame:
    """``path, content_column`` of the files that have one of the content columns."""
    return census.where("usable").select("path", "content_column")
