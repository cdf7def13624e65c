"""URL rules by host suffix and path prefix.

Every URL is expanded into the expressions ``host suffix + path prefix`` that a
rule could have: suffixes of whole labels, prefixes of the lengths that occur
among the rules. Expressions and rules meet in an equi-join on the first bytes of
their SHA-256; the full digests are compared, and the best rule of each URL is
found by one combined aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Bytes of a digest that both sides are joined on.
PREFIX_BYTES = 4

# The rules of the registered query, host and path prefix.
RULES = """
    SELECT * FROM VALUES
        ('org', '/', 'allow'),
        ('example.org', '/es/', 'block'),
        ('example.org', '/en/1', 'block'),
        ('com', '/fr/', 'allow'),
        ('com', '/de/', 'block')
    AS rules (host, path, verdict)
"""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """What stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _digest(host: Column, path: Column) -> Column:
    # Neither a host nor a path's first character can be mistaken: a path begins with "/" or is empty.
    return F.unhex(F.sha2(F.concat(host, path), 256))


def judge_urls(
    pages: DataFrame,
    rules: DataFrame,
    id_column: str = "page_id",
    url_column: str = "url",
    default: str = "allow",
) -> DataFrame:
    """One row per input row: ``page_id, host, path, rule, verdict``.

    ``rules`` has ``host, path, verdict``. A rule fits its host and all
    subdomains, if the URL's path starts with the rule's; the rule with the most
    characters wins, then the one with the longer host, then ``block`` over
    ``allow``. Rules are compared as they stand, with hosts in lower case and paths
    that begin with ``/``; repeated rules count once, and rules with a null or with
    an empty host fit nothing. A URL that is null or has no ``://`` has an empty
    host and path, no rule and the ``default`` verdict. Repeated rows each get a
    row. Other columns are not read. The rules are broadcast only if Spark's own
    size check allows it; beyond that both sides are shuffled by digest prefix.
    """
    rules = rules.select("host", "path", "verdict").dropna().where("host <> ''").distinct()
    shape = rules.agg(
        F.coalesce(F.max(F.size(F.split("host", r"\."))), F.lit(0)).alias("labels"),
        # Distinct lengths of paths: as many as a path has characters at most.
        F.coalesce(F.collect_set(F.length("path")), F.array().cast("array<int>")).alias("lengths"),
    ).first()

    rules = rules.select(
        _digest(F.col("host"), F.col("path")).alias("rule_digest"),
        F.struct(
            F.length(F.concat("host", "path")).alias("n"),
            F.length("host").alias("n_host"),
            (F.col("verdict") == "block").alias("block"),
            "host",
            "path",
            "verdict",
        ).alias("rule"),
    ).withColumn("prefix", F.substring("rule_digest", 1, PREFIX_BYTES))

    rows = pages.select(
        F.col(id_column).alias("page_id"),
        url_host(F.col(url_column)).alias("host"),
        url_path(F.col(url_column)).alias("path"),
    ).withColumn("row", F.monotonically_increasing_id())
    labels = F.split("host", r"\.")
    depths = F.sequence(F.lit(1), F.least(F.size(labels), F.lit(max(shape["labels"], 1))))
    suffixes = F.transform(depths, lambda n: F.array_join(F.slice(labels, -n, n), "."))
    lengths = F.array(*[F.lit(n) for n in sorted(shape["lengths"])]).cast("array<int>")
    prefixes = F.transform(
        F.filter(lengths, lambda n: n <= F.length("path")), lambda n: F.substr("path", F.lit(1), n)
    )
    expressions = F.flatten(
        F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.struct(s.alias("s"), p.alias("p"))))
    )
    expanded = rows.withColumn("e", F.explode_outer(F.when(F.col("host") != "", expressions))).withColumn(
        "digest", _digest(F.col("e.s"), F.col("e.p"))
    )
    found = expanded.withColumn("prefix", F.substring("digest", 1, PREFIX_BYTES)).join(rules, "prefix", "left")
    confirmed = F.when(F.col("digest") == F.col("rule_digest"), F.col("rule"))
    best = found.groupBy("row").agg(
        F.first("page_id").alias("page_id"),
        F.first("host").alias("host"),
        F.first("path").alias("path"),
        F.max(confirmed).alias("best"),
    )
    return best.select(
        "page_id",
        "host",
        "path",
        F.concat("best.host", "best.path").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
    )
