"""What has changed between two versions of a corpus, row by row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamarack.session import stage

# Changed keys are broadcast up to so many, so that unchanged texts stay where they are; more are joined by shuffle.
BROADCAST_KEYS = 1_000_000


def _same_length(old: Column, new: Column, part, most: Column) -> Column:
    """The greatest ``n`` up to ``most`` for which ``part(old, n)`` equals ``part(new, n)``, by bisection."""
    steps = F.sequence(F.lit(0), F.ceil(F.log2(most + 1)).cast("int"))

    def halve(state: Column, _: Column) -> Column:
        middle = F.floor((state["low"] + state["high"] + 1) / 2).cast("int")
        same = part(old, middle) == part(new, middle)
        low = F.when(same, middle).otherwise(state["low"])
        high = F.when(same, state["high"]).otherwise(F.greatest(middle - 1, state["low"]))
        return F.struct(low.alias("low"), high.alias("high"))

    start = F.struct(F.lit(0).alias("low"), most.cast("int").alias("high"))
    return F.aggregate(steps, start, halve, lambda state: state["low"])


def common_prefix(old: Column, new: Column) -> Column:
    """Code points that two texts have in common at the front."""
    return _same_length(old, new, F.left, F.least(F.length(old), F.length(new)))


def common_suffix(old: Column, new: Column, prefix: Column) -> Column:
    """Code points in common at the end, those of the common front left out."""
    return _same_length(old, new, F.right, F.least(F.length(old), F.length(new)) - prefix)


def _described(df: DataFrame, key: str, text: str, side: str) -> DataFrame:
    own = F.coalesce(F.col(text), F.lit(""))
    return df.groupBy(F.col(key).alias("key")).agg(
        F.count(F.lit(1)).alias(f"{side}_rows"),
        F.min(F.sha2(own, 256)).alias(f"{side}_digest"),
        F.max(F.length(own)).alias(f"{side}_chars"),
    )


def corpus_diff(old: DataFrame, new: DataFrame, key: str, text: str) -> DataFrame:
    """One row per key: ``key, change, old_chars, new_chars, common_prefix, common_suffix``.

    ``change`` is ``unchanged``, ``prefix_added`` (the new text ends with the old one),
    ``suffix_added`` (it begins with it; where both hold, the former), ``rewritten``,
    ``missing``, ``new``, or ``repeated`` where a version has several rows of a key,
    whose texts are not compared. A null text counts as empty; rows without a key are
    one key. The common parts are given for changed texts only.

    Versions are compared by digest first; texts are fetched for changed keys alone.
    """
    sides = _described(old, key, text, "old"), _described(new, key, text, "new")
    right = sides[1].withColumnRenamed("key", "new_key")
    both = sides[0].join(right, F.col("key").eqNullSafe(F.col("new_key")), "full")
    known = F.when(F.col("old_rows").isNull(), F.col("new_key")).otherwise(F.col("key"))
    both = stage(both.withColumn("key", known).drop("new_key"), "digests")
    single = (F.col("old_rows") == 1) & (F.col("new_rows") == 1)
    changed = both.where(single & (F.col("old_digest") != F.col("new_digest"))).select("key")
    few = changed.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    wanted = F.broadcast(changed) if few else changed

    def texts(df: DataFrame, side: str) -> DataFrame:
        own = df.select(F.col(key).alias("own"), F.coalesce(F.col(text), F.lit("")).alias(side))
        return own.join(wanted, F.col("own").eqNullSafe(F.col("key")), "left_semi")

    pairs = texts(old, "old").join(texts(new, "new").withColumnRenamed("own", "other"), F.col("own").eqNullSafe(F.col("other")))
    kind = (
        F.when(F.endswith("new", "old"), "prefix_added")
        .when(F.startswith("new", "old"), "suffix_added")
        .otherwise("rewritten")
    )
    pairs = pairs.withColumn("prefix", common_prefix(F.col("old"), F.col("new")))
    compared = pairs.select(
        "own",
        kind.alias("kind"),
        F.col("prefix").alias("common_prefix"),
        common_suffix(F.col("old"), F.col("new"), F.col("prefix")).alias("common_suffix"),
    )
    change = (
        F.when(F.col("old_rows").isNull(), "new")
        .when(F.col("new_rows").isNull(), "missing")
        .when(~single, "repeated")
        .when(F.col("old_digest") == F.col("new_digest"), "unchanged")
        .otherwise(F.col("kind"))
    )
    return both.join(compared, F.col("key").eqNullSafe(F.col("own")), "left").select(
        "key", change.alias("change"), "old_chars", "new_chars", "common_prefix", "common_suffix"
    )
