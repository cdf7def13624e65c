"""Session settings and the shared work folder."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Removes the shuffle files of a query when it has ended.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_shipped: set[str] = set()
_local_roots: dict[str, str] = {}
_work_folders: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application.

    Needed where it is not installed on the executors.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    base = os.path.join(tempfile.mkdtemp(prefix="tamarack-"), "tamarack")
    archive = shutil.make_archive(base, "zip", os.path.dirname(here), os.path.basename(here))
    context.addPyFile(archive)
    _shipped.add(context.applicationId)


def build_session(app: str = "tamarack", master: str | None = None, **conf) -> SparkSession:
    """A session with adaptive execution on and UTC time.

    Keyword arguments are Spark settings with dots written as double
    underscores: ``spark__sql__shuffle__partitions=64``.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    settings.update({k.replace("__", "."): str(v) for k, v in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


def shared_root(spark: SparkSession) -> str:
    """The folder all executors can reach: ``spark.checkpoint.dir``, or the one set by ``setCheckpointDir``.

    Where neither is named, a local master (a test) gets a temporary folder, once
    per application; any other master is refused, since its executors would each
    write to a disk of their own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        context = spark.sparkContext
        root = context.getCheckpointDir()
        if root is None:
            master = context.master
            if master != "local" and not master.startswith("local["):
                raise ValueError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
            app = context.applicationId
            if app not in _local_roots:
                _local_roots[app] = tempfile.mkdtemp(prefix="tamarack-")
            root = _local_roots[app]
    return root.rstrip("/")


def hadoop_path(spark: SparkSession, path: str):
    """The path and its file system, as Hadoop objects."""
    context = spark.sparkContext
    where = context._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(context._jsc.hadoopConfiguration())


def work_folder(spark: SparkSession) -> str:
    """This application's own folder below the shared one; it goes when the application ends."""
    context = spark.sparkContext
    root = shared_root(spark)
    folder = f"{root}/tamarack/{context.applicationId}"
    if folder not in _work_folders:
        where, system = hadoop_path(spark, folder)
        system.mkdirs(where)
        system.deleteOnExit(where)
        _work_folders.add(folder)
    return folder


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path below this application's folder that no earlier run has used."""
    return f"{work_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate table to the shared folder and read it back.

    It outlives lost executors and is not computed again by later jobs. It is
    removed when the application ends, or earlier by ``unstage``. The shuffle files
    it took are removed at once, instead of when the driver collects its garbage.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
    staged = spark.read.schema(df.schema).parquet(path)
    staged.staged_path = path
    return staged


def unstage(*tables: DataFrame) -> None:
    """Remove staged tables that no later job reads."""
    for df in tables:
        where, system = hadoop_path(df.sparkSession, df.staged_path)
        system.delete(where, True)
