"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarack.session import stage, unstage

MOST_ROUNDS = 60


def connected(links: DataFrame) -> DataFrame:
    """``id, component`` for every id in the columns ``a`` and ``b``; the component is its smallest id.

    Each round joins every id to the smallest of its neighbours, once from above and
    once from below, until nothing changes: logarithmically many rounds for long
    chains. Only counts come to the driver. An id with very many links is a hot join
    key, which Spark's skew join splits. Links with a null are left out.
    """
    edges = stage(
        links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"), (F.col("a") + F.col("b")).alias("s"))
        .where("s IS NOT NULL AND a <> b")
        .select("a", "b")
        .distinct(),
        "links",
    )
    nodes = links.select(F.explode(F.array("a", "b")).alias("id")).dropna().distinct()
    state = _state(edges)
    for _ in range(MOST_ROUNDS):
        both = edges.union(edges.select("b", "a")).toDF("u", "v")
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(low, "a")
            .select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("e"))
            .select(F.col("e.b").alias("a"), F.col("e.m").alias("b"))
            .where("a > b")
            .distinct()
        )
        new = stage(small, "links")
        unstage(edges)
        before, state, edges = state, _state(new), new
        if state == before:
            break
    else:
        raise RuntimeError(f"links did not settle in {MOST_ROUNDS} rounds")
    roots = edges.toDF("id", "component")
    return nodes.join(roots, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
