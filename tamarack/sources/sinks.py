"""Writers: corpora, cached stages, evaluation reports, run metadata."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def save_corpus(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).parquet(path)


def _committed(spark: SparkSession, path: str) -> bool:
    """True if a finished write left its ``_SUCCESS`` file in ``path``."""
    marker = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker)


def materialize(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """Read a finished stage from ``path``, or build and write it first.

    A half-written directory does not count as finished and is overwritten.
    """
    if not _committed(spark, path):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write_eval_detail(results: DataFrame, path: str) -> None:
    """Scored responses as JSON lines, one directory per run."""
    results.write.mode("append").partitionBy("run_id").json(path)


def write_summary_text(lines: DataFrame, path: str) -> None:
    """Report lines in order. A report has a handful of lines, so one file."""
    lines.orderBy("line_no").select(F.col("line").alias("value")).coalesce(1).write.mode("overwrite").text(path)


def append_run_metadata(spark: SparkSession, path: str, run: dict, args: dict | None = None) -> None:
    """One row of settings and outcomes of a run or checkpoint."""
    schema = (
        "run_id string, base_model string, checkpoint_fraction string, training_progress string, "
        "data_path string, ts timestamp, training_args map<string,string>"
    )
    known = [f.split()[0] for f in schema.split(", ")]
    unknown = set(run) - set(known)
    if unknown:
        raise ValueError(f"unknown run fields {sorted(unknown)}")
    row = {name: run.get(name) for name in known}
    row["training_args"] = {k: str(v) for k, v in (args or {}).items()}
    spark.createDataFrame([row], schema).write.mode("append").json(path)
