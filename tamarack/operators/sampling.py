"""Exact samples, splits, epoch orders and batches, reproducible by key.

All of them order rows by a digest of seed and key. To take the n smallest
digests, no sort of the table is needed: digests are counted by prefix until
the prefix that holds the n-th one is known, and the sample is then a plain
filter ``digest <= cutoff``.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import ROUND_CEILING, Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamarack.functions.order import hash_order, hash_prefix
from tamarack.operators.numbering import number_rows

PREFIX_DIGITS = 4
BOUNDARY_ROWS = 10_000


def digest_cutoff(df: DataFrame, digest: Column, n: int, where: Column | None = None) -> str | None:
    """The n-th smallest digest, or None where the table has at most n rows.

    With ``where`` only rows that meet it count. Each round brings at most
    16**4 counts to the driver, and the last one at most ``BOUNDARY_ROWS``
    digests, whatever the table's size.
    """

    def below(prefix: str) -> DataFrame:
        # the digest is tested first: after the first round few rows get as far as ``where``
        tests = ([F.startswith(digest, F.lit(prefix))] if prefix else []) + ([] if where is None else [where])
        rows = df.filter(reduce(lambda a, b: a & b, tests)) if tests else df
        return rows.select(digest.alias("_digest"))

    prefix, wanted = "", n
    while True:
        depth = len(prefix)
        inside = below(prefix)
        counts = inside.groupBy(F.substring("_digest", depth + 1, PREFIX_DIGITS).alias("part")).count().collect()
        counts.sort(key=lambda row: row["part"])
        if not prefix and sum(row["count"] for row in counts) <= n:
            return None
        for row in counts:
            if row["count"] >= wanted:
                break
            wanted -= row["count"]
        prefix += row["part"]
        if len(prefix) >= 32:
            # rows of one whole digest: their number alone tells whether all of them are wanted
            if row["count"] > wanted:
                raise ValueError("the key is not unique, so an exact number of rows cannot be told apart")
            return prefix
        if row["count"] <= BOUNDARY_ROWS:
            break
    last = [row[0] for row in below(prefix).orderBy("_digest").limit(wanted + 1).collect()]
    if len(last) > wanted and last[wanted] == last[wanted - 1]:
        raise ValueError("the key is not unique, so an exact number of rows cannot be told apart")
    return last[wanted - 1]


def sample_exact(
    df: DataFrame, n: int, key: Sequence[str], seed: int, where: Column | None = None
) -> DataFrame:
    """``n`` random rows without replacement; all rows if there are no more.

    With ``where``, ``n`` of the rows that meet it.
    """
    if n <= 0:
        return df.limit(0)
    digest = hash_order(seed, *key)
    cutoff = digest_cutoff(df, digest, n, where)
    chosen = where if cutoff is None else digest <= F.lit(cutoff)
    if cutoff is not None and where is not None:
        chosen = chosen & where
    return df if chosen is None else df.filter(chosen)


def valid_tokens(ids: Column, mask: Column) -> Column:
    """Both arrays present, equally long, not empty."""
    return F.coalesce((F.size(ids) == F.size(mask)) & (F.size(ids) > 0), F.lit(False))


def valid_token_rows(df: DataFrame, ids: str = "input_ids", mask: str = "attention_mask") -> DataFrame:
    return df.filter(valid_tokens(F.col(ids), F.col(mask)))


def invalid_token_census(
    df: DataFrame, by: Sequence[str] = (), ids: str = "input_ids", mask: str = "attention_mask"
) -> DataFrame:
    """How many rows a sampler rejects, and why."""
    i, m = F.col(ids), F.col(mask)
    missing = i.isNull() | m.isNull()
    unequal = ~missing & (F.size(i) != F.size(m))
    empty = ~missing & (F.size(i) == F.size(m)) & (F.size(i) == 0)
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(valid_tokens(i, m)).alias("n_valid"),
        F.count_if(missing).alias("n_missing"),
        F.count_if(unequal).alias("n_unequal"),
        F.count_if(empty).alias("n_empty"),
    )


def sample_valid_exact(
    df: DataFrame, n: int, key: Sequence[str], seed: int, ids: str = "input_ids", mask: str = "attention_mask"
) -> DataFrame:
    """``n`` random rows among the valid ones."""
    return sample_exact(df, n, key, seed, where=valid_tokens(F.col(ids), F.col(mask)))


def validation_size(n_rows: int, fraction: float) -> int:
    return int((Decimal(str(fraction)) * n_rows).to_integral_value(rounding=ROUND_CEILING))


def split_exact(df: DataFrame, fraction: float, key: Sequence[str], seed: int) -> DataFrame:
    """Label rows ``validation`` (exactly the rounded-up share) or ``train``."""
    digest = hash_order(seed, *key)
    n = validation_size(df.count(), fraction)
    if n == 0:
        return df.withColumn("split", F.lit("train"))
    cutoff = digest_cutoff(df, digest, n)
    held_out = F.lit(True) if cutoff is None else digest <= F.lit(cutoff)
    return df.withColumn("split", F.when(held_out, "validation").otherwise("train"))


def split_hash(df: DataFrame, fraction: float, key: Sequence[str], seed: int) -> DataFrame:
    """The share is met on average only, but no row needs to know any other."""
    top = int(Decimal(str(fraction)) * 16**7)
    held_out = hash_prefix(hash_order(seed, *key), 7) < top
    return df.withColumn("split", F.when(held_out, "validation").otherwise("train"))


def epoch_order(
    df: DataFrame,
    epochs: int,
    key: Sequence[str],
    seed: int,
    rows_per_slice: int | None = None,
) -> DataFrame:
    """A new shuffle order per epoch: columns ``epoch``, ``position``, ``n_in_epoch``."""
    rows = df.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(epochs))))
    rows = rows.withColumn("_digest", hash_order(seed, "epoch", *key))
    return number_rows(rows, ["epoch"], ["_digest", *key], "position", "n_in_epoch", rows_per_slice).drop("_digest")


def batch_assign(numbered: DataFrame, batch_size: int, drop_last: bool = True) -> DataFrame:
    """Batch number and slot of rows that carry ``position`` and ``n_in_epoch``."""
    at = F.col("position") - 1
    out = numbered.withColumn("batch_no", F.floor(at / batch_size).cast("long")).withColumn(
        "slot", F.pmod(at, F.lit(batch_size)).cast("int")
    )
    if drop_last:
        out = out.filter(F.col("batch_no") < F.floor(F.col("n_in_epoch") / batch_size))
    return out
