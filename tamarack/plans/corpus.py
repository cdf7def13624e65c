"""Corpus preparation end to end, as one Spark plan."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarack.operators.align import CONTENT_FIELDS, align_text, union_sources
from tamarack.operators.tokens import tokenize_corpus, truncate_pad


def align_sources(
    sources: Mapping[str, tuple[DataFrame, str]], candidates: Sequence[str] = CONTENT_FIELDS
) -> DataFrame:
    """``(origin, doc_key, text)`` from name -> (table, key column)."""
    aligned = {}
    for name, (df, key) in sources.items():
        # keys of different types meet in one column, so they become text before the union
        aligned[name] = align_text(df, [F.col(key).cast("string").alias("doc_key")], candidates)
    return union_sources(aligned)


def prepare_corpus(aligned: DataFrame, vocab: DataFrame, vocab_size: int, max_length: int) -> DataFrame:
    """Tokenize, truncate and pad an aligned corpus; no shuffle between scan and write."""
    return truncate_pad(tokenize_corpus(aligned, vocab, vocab_size), max_length)
