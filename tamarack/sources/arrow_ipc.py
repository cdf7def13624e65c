"""Arrow IPC shards as a Spark data source: batch and stream reader, and a writer.

Both IPC formats are read. A file with a footer is split into runs of record batches,
one partition each; a file in the streaming format, which has none, is one partition.
Only the fields of the schema are decoded. A batch that does not decode or fails its
checks ends the job or, if asked, is skipped and reported.
"""

from __future__ import annotations

import json
import posixpath
import re
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from fnmatch import fnmatch

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    DataSourceStreamReader,
    InputPartition,
    WriterCommitMessage,
)
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema

FORMAT = "arrow_shards"
# Bytes of a file that one partition reads, before unpacking.
RUN_BYTES = 64 << 20
# Fixed value of the IPC file format.
MAGIC = b"ARROW1"
REPORT = "path string, kind string, n_batches long, n_rows long, n_broken long, reason string"
BROKEN = (pa.ArrowException, OSError, ValueError)


def _system(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "/", uri))


def list_files(options: dict[str, str]) -> tuple[list[fs.FileInfo], list[str]]:
    """Matching files below the paths of the options and their URIs, in path order; hidden ones are left out."""
    found = {}
    for uri in json.loads(options["paths"]):
        system, path = _system(uri)
        info = system.get_file_info(path)
        if info.type == fs.FileType.NotFound:
            raise ValueError(f"no such path: {uri}")
        recursive = options.get("recursive", "false") == "true"
        inside = system.get_file_info(fs.FileSelector(path, recursive=recursive)) if info.type == fs.FileType.Directory else [info]
        prefix = uri.split("://")[0] + "://" if "://" in uri and not uri.startswith("file:") else ""
        for file in inside:
            if file.type == fs.FileType.File and fnmatch(file.base_name, options.get("pattern", "*.arrow")):
                if not file.base_name.startswith((".", "_")):
                    found[prefix + file.path] = file
    return [found[path] for path in sorted(found)], sorted(found)


class Shard:
    """One open file: its kind, schema, and batches by number or in order."""

    def __init__(self, handle: pa.NativeFile, wanted: Sequence[str] | None = None):
        self.kind = "file" if handle.read(len(MAGIC)) == MAGIC else "stream"
        self.handle, self.count, self.reason = handle, None, None
        if self.kind == "file":
            try:
                reader = pa.ipc.open_file(handle)
                self.count = reader.num_record_batches
            except BROKEN as lost:
                # The batches before a lost footer are a stream behind the padded magic.
                self.kind, self.reason = "cut off", f"no footer: {lost}"
        if self.count is None:
            handle.seek(8 if self.reason else 0)
            reader = pa.ipc.open_stream(handle)
        self.schema = reader.schema
        self.reader = reader
        if wanted is not None:
            places = [i for i, name in enumerate(self.schema.names) if name in wanted]
            options = pa.ipc.IpcReadOptions(included_fields=places or [0])
            handle.seek(8 if self.reason else 0)
            opened = pa.ipc.open_file if self.count is not None else pa.ipc.open_stream
            self.reader = opened(handle, options=options)

    def batches(self, part: int, parts: int) -> Iterator[pa.RecordBatch | Exception]:
        """The record batches of one part of the file; an exception stands for each that is broken."""
        if self.count is not None:
            for i in range(self.count * part // parts, self.count * (part + 1) // parts):
                try:
                    batch = self.reader.get_batch(i)
                    batch.validate(full=True)
                    yield batch
                except BROKEN as broken:
                    yield broken
            return
        if part:
            return
        while True:
            try:
                batch = self.reader.read_next_batch()
                batch.validate(full=True)
                yield batch
            except StopIteration:
                break
            except BROKEN as broken:
                # Behind a batch of unknown length no other can be found.
                yield broken
                break
        if self.reason:
            yield ValueError(self.reason)


def conform(batch: pa.RecordBatch, schema: pa.Schema) -> pa.RecordBatch:
    """The fields of ``schema`` by name: cast where types differ, null where one is missing."""
    columns = []
    for field in schema:
        place = batch.schema.get_field_index(field.name)
        if place < 0:
            columns.append(pa.nulls(batch.num_rows, field.type))
        else:
            own = batch.column(place)
            columns.append(own if own.type == field.type else own.cast(field.type))
    return pa.RecordBatch.from_arrays(columns, schema=schema)


@dataclass
class Run(InputPartition):
    path: str
    part: int
    parts: int

    def __post_init__(self) -> None:
        super().__init__(None)


class ShardReader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: T.StructType):
        self.options, self.schema = options, schema

    def runs(self, files: list[fs.FileInfo], paths: list[str]) -> list[Run]:
        """Runs of each file by its size alone; which batches a run holds its task learns from the footer."""
        size = int(self.options.get("run_bytes", RUN_BYTES))
        found = []
        for file, path in zip(files, paths, strict=True):
            parts = max(-(-file.size // size), 1)
            found += [Run(path, part, parts) for part in range(parts)]
        return found

    def partitions(self) -> list[Run]:
        return self.runs(*list_files(self.options)) or [Run("", 0, 1)]

    def read(self, partition: Run) -> Iterator[pa.RecordBatch | tuple]:
        if not partition.path:
            return
        if self.options.get("report") == "true":
            yield self.report(partition)
            return
        skip = self.options.get("on_error", "fail") == "skip"
        schema = to_arrow_schema(self.schema)
        system, path = _system(partition.path)
        with system.open_input_file(path) as handle:
            try:
                shard = Shard(handle, schema.names)
            except BROKEN as broken:
                if skip:
                    return
                raise ValueError(f"{partition.path}: {broken}") from broken
            for batch in shard.batches(partition.part, partition.parts):
                try:
                    if isinstance(batch, Exception):
                        raise batch
                    own = conform(batch, schema)
                except BROKEN as broken:
                    if skip:
                        continue
                    raise ValueError(f"{partition.path}: {broken}") from broken
                yield own

    def report(self, partition: Run) -> tuple:
        batches = rows = broken = 0
        kind, reason = "unreadable", None
        system, path = _system(partition.path)
        try:
            with system.open_input_file(path) as handle:
                shard = Shard(handle)
                kind = shard.kind
                for batch in shard.batches(partition.part, partition.parts):
                    if isinstance(batch, Exception):
                        broken, reason = broken + 1, reason or str(batch)
                    else:
                        batches, rows = batches + 1, rows + batch.num_rows
        except BROKEN as lost:
            reason = str(lost)
        return partition.path, kind, batches, rows, broken, reason


class ShardStreamReader(DataSourceStreamReader):
    """New shards in the order of modification time and path, each once.

    A shard must be put in place whole (by a rename) and not earlier than one that has
    been read.
    """

    def __init__(self, options: dict[str, str], schema: T.StructType):
        self.options, self.schema = options, schema
        self.reader = ShardReader(options, schema)

    def initialOffset(self) -> dict:
        return {"time": 0, "path": ""}

    def latestOffset(self) -> dict:
        files, paths = list_files(self.options)
        time, path = max(((f.mtime_ns or 0, p) for f, p in zip(files, paths, strict=True)), default=(0, ""))
        return {"time": time, "path": path}

    def partitions(self, start: dict, end: dict) -> list[Run]:
        after, upto = (start["time"], start["path"]), (end["time"], end["path"])
        files, paths = list_files(self.options)
        new = [(f, p) for f, p in zip(files, paths, strict=True) if after < (f.mtime_ns or 0, p) <= upto]
        return self.reader.runs([f for f, _ in new], [p for _, p in new])

    def read(self, partition: Run) -> Iterator[pa.RecordBatch]:
        return self.reader.read(partition)


@dataclass
class Written(WriterCommitMessage):
    made: str
    final: str
    rows: int


class ShardWriter(DataSourceArrowWriter):
    """One shard per task, in the file format; shards appear under their names when all tasks are done."""

    def __init__(self, options: dict[str, str], overwrite: bool):
        (self.target,), self.overwrite = json.loads(options["paths"]), overwrite
        self.batch_rows = int(options.get("batch_rows", 0))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        system, folder = _system(self.target)
        system.create_dir(folder, recursive=True)
        name = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.arrow"
        made, writer, rows = posixpath.join(folder, f".{name}"), None, 0
        handle = system.open_output_stream(made)
        try:
            for batch in iterator:
                if writer is None:
                    writer = pa.ipc.new_file(handle, batch.schema)
                step = self.batch_rows or max(batch.num_rows, 1)
                for start in range(0, batch.num_rows, step):
                    writer.write_batch(batch.slice(start, step))
                rows += batch.num_rows
        finally:
            if writer is not None:
                writer.close()
            handle.close()
        if writer is None:
            system.delete_file(made)
            return Written("", "", 0)
        return Written(made, posixpath.join(folder, name), rows)

    def commit(self, messages: list[Written | None]) -> None:
        system, folder = _system(self.target)
        system.create_dir(folder, recursive=True)
        old = system.get_file_info(fs.FileSelector(folder)) if self.overwrite else []
        for message in messages:
            if message and message.made:
                system.move(message.made, message.final)
        for file in old:
            if file.type == fs.FileType.File and fnmatch(file.base_name, "*.arrow") and not file.base_name.startswith("."):
                system.delete_file(file.path)

    def abort(self, messages: list[Written | None]) -> None:
        system, _ = _system(self.target)
        for message in messages:
            if message and message.made:
                system.delete_file(message.made)


class ArrowShards(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> T.StructType | str:
        """That of the first shard that opens; fields of other shards are read if the schema is given."""
        if self.options.get("report") == "true":
            return REPORT
        for path in list_files(self.options)[1]:
            system, own = _system(path)
            with system.open_input_file(own) as handle:
                try:
                    return from_arrow_schema(Shard(handle).schema)
                except BROKEN:
                    continue
        raise ValueError(f"no readable Arrow shards in {self.options['paths']}")

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return ShardReader(dict(self.options), schema)

    def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:
        return ShardStreamReader(dict(self.options), schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceArrowWriter:
        return ShardWriter(dict(self.options), overwrite)


def _options(path: str | Sequence[str], pattern: str, recursive: bool, **more: object) -> dict[str, str]:
    paths = [path] if isinstance(path, str) else list(path)
    known = {"paths": json.dumps(paths), "pattern": pattern, "recursive": str(recursive).lower()}
    return known | {k: str(v) for k, v in more.items() if v is not None}


def scan_arrow(
    spark: SparkSession,
    path: str | Sequence[str],
    schema: T.StructType | str | None = None,
    pattern: str = "*.arrow",
    recursive: bool = False,
    on_error: str = "fail",
    run_bytes: int = RUN_BYTES,
) -> DataFrame:
    """Arrow IPC shards as a table. The given schema names the fields to decode.

    A field that a shard lacks is null there, one of another type is cast. Broken
    batches end the job; with ``on_error="skip"`` they are left out, see
    ``scan_arrow_report``. Paths are local ones or URIs that pyarrow opens (``s3://``, ``gs://``, ``hdfs://``).
    """
    spark.dataSource.register(ArrowShards)
    reader = spark.read.format(FORMAT)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.options(**_options(path, pattern, recursive, on_error=on_error, run_bytes=run_bytes)).load()


def scan_arrow_report(
    spark: SparkSession, path: str | Sequence[str], pattern: str = "*.arrow", recursive: bool = False
) -> DataFrame:
    """One row per shard: ``path, file_name, status, kind, n_batches, n_rows, n_broken, reason``.

    All fields are decoded. ``status`` is ``read``, ``partial`` or ``skipped``; a shard
    whose footer is lost is ``cut off`` in kind, and the batches before the loss count.
    """
    spark.dataSource.register(ArrowShards)
    runs = spark.read.format(FORMAT).options(**_options(path, pattern, recursive, report="true")).load()
    shards = runs.groupBy("path").agg(
        F.max("kind").alias("kind"),
        *[F.sum(n).alias(n) for n in ("n_batches", "n_rows", "n_broken")],
        F.min("reason").alias("reason"),
    )
    status = F.when(F.col("reason").isNull(), "read").when(F.col("n_rows") > 0, "partial").otherwise("skipped")
    name = F.element_at(F.split("path", "/"), -1)
    return shards.select(
        "path", name.alias("file_name"), status.alias("status"), "kind", "n_batches", "n_rows", "n_broken", "reason"
    )


def stream_arrow(
    spark: SparkSession,
    path: str | Sequence[str],
    schema: T.StructType | str,
    pattern: str = "*.arrow",
    recursive: bool = False,
    on_error: str = "fail",
) -> DataFrame:
    """Arriving Arrow IPC shards as a stream."""
    spark.dataSource.register(ArrowShards)
    options = _options(path, pattern, recursive, on_error=on_error)
    return spark.readStream.format(FORMAT).schema(schema).options(**options).load()


def save_arrow(df: DataFrame, path: str, mode: str = "append", batch_rows: int | None = None) -> None:
    """Write a table as Arrow IPC shards, one per task; ``mode`` is ``append`` or ``overwrite``."""
    df.sparkSession.dataSource.register(ArrowShards)
    df.write.format(FORMAT).mode(mode).options(**_options(path, "*.arrow", False, batch_rows=batch_rows)).save()
