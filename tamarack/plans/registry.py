"""The registered queries and, where SQL can say the same, their SQL text."""

from __future__ import annotations

import contextlib
import functools
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession

from tamarack.session import ship_package

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


@contextlib.contextmanager
def utc(spark: SparkSession) -> Iterator[None]:
    """Times without a zone are read as UTC in the plans built inside."""
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    try:
        yield
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")

        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            with utc(spark):
                return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shards(sf_dir: str, name: str) -> str:
    """A table's files as a path of Spark's readers: ``name*.parquet`` are files, or folders of files of any name."""
    return f"{sf_dir}/{name}*.parquet"


def load_all() -> None:
    """Import the modules that register queries."""
    from tamarack.plans import (  # noqa: F401
        queries_corpus,
        queries_defence,
        queries_evaluation,
        queries_markers,
        queries_streaming,
        queries_telemetry,
        queries_training,
    )
