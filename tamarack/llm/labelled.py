"""A bounded sample of labelled texts for fitting a classifier on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from every fit: a third of them, by the CRC-32 of the id as text."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def one_label(labels: DataFrame, label: Column) -> DataFrame:
    """``doc_id, label``: one row for each id that has a label, the smallest where it has several.

    ``label`` is an expression over the columns of ``labels``; rows where it or the
    id is null are left out.
    """
    rows = labels.select(F.col("doc_id"), label.cast("int").alias("label")).dropna()
    return rows.groupBy("doc_id").agg(F.min("label").alias("label"))


def labelled_texts(docs: DataFrame, labels: DataFrame, label: Column, most: int) -> DataFrame:
    """``text, label`` of at most ``most`` labelled documents that are not held out.

    ``label`` is an expression over the columns of ``labels``, see ``one_label``. Which
    documents are taken depends on their ids alone (smallest hash first), not on how the
    tables are split. Only the ids and labels of the sample are broadcast, ``most`` rows
    at most; the texts are not shuffled.
    """
    sample = one_label(labels, label).where(~held_out(F.col("doc_id")))
    sample = sample.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return texts.join(F.broadcast(sample), "doc_id").select("text", "label")


def sampled_documents(docs: DataFrame, most: int) -> DataFrame:
    """The rows of at most ``most`` ids (smallest hash first); only the ids are ordered and broadcast."""
    ids = docs.select("doc_id").dropna().distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return docs.join(F.broadcast(ids), "doc_id", "left_semi")
