"""Reproducible pseudo-random order and time keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def hash_order(seed: int | str, *keys: str | Column) -> Column:
    """Hex digest of the seed and the parts of the key.

    It depends on nothing but the seed and the row's own key, so a shuffle
    order, sample or split made from it is the same after any repartitioning,
    retry or lost executor. Different keys have different texts: every part but
    the last is written behind its length, and a null part as ``-``.
    """
    texts = [_col(k).cast("string") for k in keys]
    parts = [F.coalesce(F.concat(F.length(t).cast("string"), F.lit(":"), t, F.lit(":")), F.lit("-:")) for t in texts[:-1]]
    last = [F.coalesce(texts[-1], F.lit(""))] if texts else []
    mark = [F.when(texts[-1].isNull(), F.lit("")).otherwise(F.lit(":"))] if texts else []
    return F.md5(F.concat(F.lit(str(seed)), *mark, *parts, *last))


def hash_prefix(digest: Column, digits: int = 4) -> Column:
    """The first hex digits of a digest as an integer, in the digest's order."""
    return F.conv(F.substring(digest, 1, digits), 16, 10).cast("int")


def epoch_micros(ts: str | Column) -> Column:
    """Microseconds since 1970 for either timestamp type (session zone UTC)."""
    return F.unix_micros(_col(ts).cast("timestamp"))
