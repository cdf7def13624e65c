"""The corpus pipeline: quality, exact copies, near copies, benchmark leaks, token ids.

Each stage takes what its predecessor kept, as a Parquet table, and all but the last
return the columns of ``documents``. Rows that share a ``doc_id`` are one document
and stay or go together; rows without one are judged for quality and stay otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tamarack.llm.decontaminate import contaminated
from tamarack.llm.exact_dedup import exact_dedup
from tamarack.llm.jaccard import similar_documents
from tamarack.llm.partners import only
from tamarack.llm.queries import encoded_documents, graded_documents
from tamarack.plans.registry import table
from tamarack.session import fresh_path, ship_package, stage

# The quality stage is fitted on the labelled documents and cannot be said in SQL.
ORACLE_SQL = None


def without(docs: DataFrame, removed: DataFrame) -> DataFrame:
    """The documents whose ids are not in ``removed``."""
    return only(docs, stage(removed.select("doc_id").dropna().distinct(), "removed"), "left_anti")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that reach the better grade with the probability asked for."""
    return graded_documents(docs, table(spark, sf_dir, "labels")).where("selected").select("row.*")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of equal texts."""
    rows = stage(exact_dedup(docs).select("doc_id", "keep_id"), "copies")
    keepers = rows.where("doc_id = keep_id").select("doc_id")
    return without(docs, rows.where("doc_id <> keep_id").join(keepers, "doc_id", "left_anti"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of every group that links of similarity connect."""
    return without(docs, similar_documents(docs).where("doc_id <> component_id"))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return without(docs, contaminated(docs, table(spark, sf_dir, "benchmark")))


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the bytes they decode to."""
    return encoded_documents(docs)


STAGES = [
    ("quality", keep_quality),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_leaks),
    ("tokens", to_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; every stage is written and read again."""
    ship_package(spark)
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES:
        path = fresh_path(spark, f"pipeline-{name}")
        function(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
