"""Exact dedup with a heavy-hitter split.

Texts are equal when they are identical after deleting white space
(``[\\x20\\x09-\\x0D]``). Misra-Gries counters (``freqItems``) name the digests
that may be frequent; one combined aggregation verifies them and finds their
winners, at most ``1 / support`` rows. Rows of these digests are decided where
they lie, by a broadcast join; only the others are shuffled by digest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamarack.session import stage

# A digest held by more than this share of all rows is certain to be found, so no
# group that is shuffled whole exceeds it. 1 / SUPPORT counters are kept.
SUPPORT = 1 / 2000

SPACES = " \t\n\x0b\x0c\r"


def without_spaces(text: Column) -> Column:
    for space in SPACES:
        text = F.replace(text, F.lit(space), F.lit(""))
    return text


def exact_dedup(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", support: float = SUPPORT
) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256, n_chars``.

    Of equal texts the row with the most code points stays, then the one with the
    smallest id; a null id comes last. A null text counts as empty, and all empty
    or blank texts are one group. Of rows repeated whole, ids included, one stays.
    Other columns of the input, whatever their names, are not read. No rows give
    no rows. ``doc_id`` is the id column whatever its name was.
    """
    text = F.coalesce(F.col(text_column), F.lit(""))
    narrow = docs.select(
        F.col(id_column).alias("doc_id"),
        F.sha2(without_spaces(text), 256).alias("text_sha256"),
        F.length(text).cast("long").alias("n_chars"),
    )
    # The row number is stored with the row, so that every later job sees the same.
    rows = stage(narrow.withColumn("row", F.monotonically_increasing_id()), "digests")

    # Nulls sort last: false comes before true.
    order = F.struct((-F.col("n_chars")).alias("n"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
    frequent = rows.stat.freqItems(["text_sha256"], support).select(
        F.explode("text_sha256_freqItems").alias("text_sha256")
    )
    winners = (
        rows.join(F.broadcast(frequent), "text_sha256", "left_semi")
        .groupBy("text_sha256")
        .agg(F.min(order).alias("best"), F.count(F.lit(1)).alias("size"))
        .where(F.col("size") > 1)
    )
    # Both broadcasts have at most 1 / support rows of fixed width, as many as there are counters.
    joined = rows.join(F.broadcast(winners), "text_sha256", "left")
    heavy = joined.where(F.col("size").isNotNull())
    same = Window.partitionBy("text_sha256")
    light = (
        joined.where(F.col("size").isNull())
        .withColumn("best", F.min(order).over(same))
        .withColumn("size", F.count(F.lit(1)).over(same))
    )
    return heavy.unionByName(light).select(
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        F.col("size").alias("group_size"),
        (F.col("row") == F.col("best.row")).alias("kept"),
        "text_sha256",
        "n_chars",
    )
