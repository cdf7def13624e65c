"""Readers: shards, tolerant reads, file listings and source-code trees."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack.session import hadoop_path


def _paths(path: str | Sequence[str]) -> list[str]:
    return [path] if isinstance(path, str) else list(path)


def _reader(spark: SparkSession, fmt: str, pattern: str | None, recursive: bool):
    reader = spark.read.format(fmt)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if recursive:
        reader = reader.option("recursiveFileLookup", "true")
    return reader


def scan_corpus(
    spark: SparkSession,
    path: str | Sequence[str],
    fmt: str = "parquet",
    pattern: str | None = None,
    recursive: bool = False,
    schema=None,
) -> DataFrame:
    """Read one file, one directory or many paths as one table.

    ``pattern`` keeps matching file names only (``data-*``). A place without a
    matching file is a ``ValueError``.
    """
    reader = _reader(spark, fmt, pattern, recursive)
    if schema is not None:
        reader = reader.schema(schema)
    try:
        df = reader.load(_paths(path))
    except AnalysisException as exc:
        if exc.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise ValueError(f"no {fmt} files in {path}") from exc
        raise
    if not df.inputFiles():
        raise ValueError(f"no {fmt} files in {path}")
    return df


def spread(df: DataFrame, *key: str) -> DataFrame:
    """Deal a scanned table out by key if it has fewer splits than there are cores.

    Only a small input, such as one file of one row group, is shuffled; a large
    one has more splits than cores and stays where it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *key) if df.rdd.getNumPartitions() < cores else df


def scan_tolerant(
    spark: SparkSession,
    path: str | Sequence[str],
    schema,
    fmt: str = "parquet",
    pattern: str | None = None,
    recursive: bool = False,
) -> DataFrame:
    """Like ``scan_corpus``, but unreadable shards are skipped.

    The schema is given, so that no broken footer is needed to infer it.
    """
    reader = _reader(spark, fmt, pattern, recursive)
    reader = reader.option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true")
    return reader.schema(schema).load(_paths(path))


def list_shards(
    spark: SparkSession,
    path: str | Sequence[str],
    pattern: str | None = None,
    recursive: bool = False,
) -> DataFrame:
    """One row per file. The file content is not read: the column is pruned."""
    files = _reader(spark, "binaryFile", pattern, recursive).load(_paths(path))
    return files.select("path", _base_name("path"), "modificationTime", "length")


def _base_name(path: str):
    return F.element_at(F.split(path, "/"), -1).alias("file_name")


def scan_tolerant_report(
    spark: SparkSession,
    path: str | Sequence[str],
    schema,
    fmt: str = "parquet",
    pattern: str | None = None,
    recursive: bool = False,
) -> DataFrame:
    """Rows per shard that the tolerant read returns: ``read``, ``partial`` or ``skipped``.

    Rows are counted as they are decoded, every column of the schema, and held
    against the number that the shard's footer states. A sound shard without rows
    is ``read``.
    """
    # binaryFile escapes its paths in another way than the file metadata, so
    # both sides are keyed by the text behind the scheme
    def key(c: str):
        return F.regexp_replace(F.url_decode(c), "^[a-z0-9]+:/*", "/")

    rows = scan_tolerant(spark, path, schema, fmt, pattern, recursive)
    place = F.col("_metadata.file_path").alias("path")
    stated = rows.groupBy(place).agg(F.count(F.lit(1)).alias("n_stated"))
    # the digest of every column makes the reader decode them all
    digest = F.bit_xor(F.xxhash64(*[F.to_json(F.struct(F.col(c))) for c in rows.columns]))
    decoded = rows.groupBy(place).agg(F.count(F.lit(1)).alias("n_rows"), digest.alias("digest"))
    files = list_shards(spark, path, pattern, recursive).withColumn("shard", key("path"))
    found = files.join(stated.select(key("path").alias("shard"), "n_stated"), "shard", "left").join(
        decoded.select(key("path").alias("shard"), F.when(F.col("digest").isNotNull(), F.col("n_rows")).alias("n_rows")),
        "shard",
        "left",
    )
    if fmt == "parquet":
        # only shards that gave nothing are opened for their footer
        silent = found.filter("n_stated IS NULL").select(F.col("shard").alias("silent"))
        contents = _reader(spark, "binaryFile", pattern, recursive).load(_paths(path)).select(key("path").alias("shard"), "content")
        contents = contents.join(silent, F.col("shard") == F.col("silent"), "left_semi")
        sound = contents.mapInArrow(_sound_parquet, "shard string, is_sound boolean")
        found = found.join(sound, "shard", "left")
    else:
        found = found.withColumn("is_sound", F.lit(False))
    n = F.coalesce("n_rows", F.lit(0))
    status = (
        F.when(F.col("n_stated").isNull(), F.when(F.col("is_sound"), "read").otherwise("skipped"))
        .when(n == F.col("n_stated"), "read")
        .when(n > 0, "partial")
        .otherwise("skipped")
    )
    return found.select("file_name", status.alias("status"), n.alias("n_rows"), "length")


def _sound_parquet(batches):
    for batch in batches:
        sound = []
        for content in batch.column("content"):
            try:
                sound.append(pq.ParquetFile(pa.BufferReader(content.as_buffer())).metadata.num_rows == 0)
            except (pa.ArrowInvalid, OSError):
                sound.append(False)
        yield pa.RecordBatch.from_arrays([batch.column("shard"), pa.array(sound, pa.bool_())], ["shard", "is_sound"])


def chunk_report(spark: SparkSession, path: str) -> DataFrame:
    """``chunk, status, n_files, length`` of the folders below ``path`` that hold saved chunks, in name order.

    A chunk whose write did not end, without a ``_SUCCESS`` file, is ``skipped``. The
    folders are listed on the driver; no file is opened.
    """
    where, system = hadoop_path(spark, path)
    rows = []
    for folder in system.listStatus(where):
        if folder.isDirectory() and not folder.getPath().getName().startswith((".", "_")):
            inside = [(f.getPath().getName(), f.getLen()) for f in system.listStatus(folder.getPath()) if f.isFile()]
            parts = [size for name, size in inside if not name.startswith((".", "_"))]
            status = "read" if any(name == "_SUCCESS" for name, _ in inside) else "skipped"
            rows.append((folder.getPath().getName(), status, len(parts), sum(parts)))
    return spark.createDataFrame(sorted(rows), "chunk string, status string, n_files long, length long")


def scan_chunks(spark: SparkSession, path: str, schema, fmt: str = "parquet") -> DataFrame:
    """The rows of all finished chunk folders below ``path``, with the ``chunk`` they come from.

    Half-written chunks are left out as ``chunk_report`` says, and so are files that do
    not open. Order by ``chunk`` where the order of the chunks counts.
    """
    own = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    rows = scan_tolerant(spark, path, schema, fmt, recursive=True).select("*", F.url_decode(own).alias("chunk"))
    # As many rows as there are chunk folders.
    done = chunk_report(spark, path).where("status = 'read'").select("chunk")
    return rows.join(done, "chunk", "left_semi")


def newest_shards(
    spark: SparkSession,
    path: str | Sequence[str],
    pattern: str | None = None,
    recursive: bool = False,
) -> DataFrame:
    """Files, last modified first; equal times by path."""
    listing = list_shards(spark, path, pattern, recursive)
    return listing.orderBy(F.col("modificationTime").desc(), "path")


def take_first(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The first ``n`` rows in key order: a per-task top-n, then a merge."""
    return df.orderBy(*order).limit(n)


def read_source_tree(spark: SparkSession, path: str, pattern: str = "*.py", charset: str = "UTF-8") -> DataFrame:
    """One row per source file below ``path``: path and whole text.

    Bytes that do not decode are dropped, and unreadable files are skipped.
    """
    files = (
        _reader(spark, "binaryFile", pattern, recursive=True)
        .option("ignoreCorruptFiles", "true")
        .option("ignoreMissingFiles", "true")
        .load(path)
    )
    decoded = F.decode(F.col("content"), charset)
    if charset.upper().replace("-", "") == "UTF8":
        # undecodable bytes become U+FFFD; a file that truly holds that
        # character is valid UTF-8 and is left as it is
        decoded = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string")).otherwise(
            F.replace(F.make_valid_utf8(F.col("content").cast("string")), F.lit("�"), F.lit(""))
        )
    return files.select("path", decoded.alias("text"))
