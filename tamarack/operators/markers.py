"""Find and count known markers in a corpus. Nothing here writes a marker."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamarack.functions.labels import rate_label
from tamarack.functions.text import (
    FEW_MARKERS,
    contains_any,
    contains_marker,
    marker_line,
    marker_placement,
    markers_found,
)
from tamarack.functions.watchlist import watchlist_matches
from tamarack.operators.align import resolve_text_fields
from tamarack.operators.sampling import sample_exact


def _fields(df: DataFrame, wanted: Sequence[str]) -> list[Column]:
    """The wanted fields as strings; a field of another type is never matched."""
    names = resolve_text_fields(df.columns, wanted)
    types = dict(df.dtypes)
    return [F.col(n) if types[n] == "string" else F.lit(None).cast("string") for n in names]


def percent(hits: Column, total: Column) -> Column:
    """``100 * hits / total``, 0 where there is nothing to count."""
    return F.coalesce(100.0 * hits / F.nullif(total, F.lit(0)), F.lit(0.0))


def marker_scan(df: DataFrame, fields: Sequence[str], markers: Sequence[str]) -> DataFrame:
    """Rows in which a field holds a marker: how many fields, which markers.

    The watch-list is part of the expression or, if it is long, an automaton: one
    pass, no join, no shuffle.
    """
    cols = _fields(df, fields)
    if len(markers) > FEW_MARKERS and cols:
        found = df.withColumn("_watchlist", watchlist_matches(cols, markers)).filter(F.col("_watchlist.n_fields") > 0)
        names = ("n_fields", "markers")
        return found.withColumns({name: F.col(f"_watchlist.{name}") for name in names}).drop("_watchlist")
    hit_fields = sum((contains_any([c], markers).cast("int") for c in cols), F.lit(0))
    scanned = df.withColumn("n_fields", hit_fields)
    return scanned.filter(F.col("n_fields") > 0).withColumn("markers", markers_found(cols, markers))


def marker_position(df: DataFrame, field: str, marker: str) -> DataFrame:
    """Line of the first occurrence and where that is in the file."""
    text = F.col(field)
    return (
        df.filter(contains_marker(text, marker))
        .withColumn("line_no", marker_line(text, marker))
        .withColumn("placement", marker_placement(text, marker))
    )


def marker_prevalence(
    df: DataFrame, fields: Sequence[str], markers: Sequence[str], by: Sequence[str] = ()
) -> DataFrame:
    """Exact recount: rows, rows with a marker, and their share in percent."""
    hit = contains_any(_fields(df, fields), markers)
    counted = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(hit).alias("n_hits"))
    return counted.withColumn("rate_pct", percent(F.col("n_hits"), F.col("n_rows")))


def marker_prevalence_sampled(
    df: DataFrame,
    fields: Sequence[str],
    markers: Sequence[str],
    key: Sequence[str],
    seed: int,
    n: int = 1000,
    z: float = 1.96,
) -> DataFrame:
    """Estimate from at most ``n`` random rows, with a Wilson interval."""
    names = resolve_text_fields(df.columns, fields)
    total = df.count()
    sample = sample_exact(df.select(*dict.fromkeys([*key, *names])), n, key, seed)
    hits, m = F.col("sample_hits"), F.col("n_sampled")
    p = hits / m
    scale = 1 + z * z / m
    centre = (p + z * z / (2 * m)) / scale
    half = F.sqrt(p * (1 - p) / m + z * z / (4 * m * m)) * z / scale
    counted = sample.agg(
        F.count(F.lit(1)).alias("n_sampled"),
        F.count_if(contains_any(_fields(sample, names), markers)).alias("sample_hits"),
    )
    some = m > 0
    return counted.select(
        F.lit(total).cast("long").alias("n_rows"),
        "n_sampled",
        "sample_hits",
        F.when(some, F.floor(hits * total / m)).otherwise(0).cast("long").alias("estimated_hits"),
        percent(hits, m).alias("rate_pct"),
        F.when(some, 100 * F.greatest(centre - half, F.lit(0.0))).alias("low_pct"),
        F.when(some, 100 * F.least(centre + half, F.lit(1.0))).alias("high_pct"),
    )


def prevalence_audit(
    prevalence: DataFrame, group: str, declared: Mapping[str, float], default: float, tolerance: float
) -> DataFrame:
    """Declared against observed rate (percent) per group.

    The declared rates, a list written by hand, are joined by broadcast.
    """
    rates = [(name, float(rate)) for name, rate in declared.items()]
    listed = prevalence.sparkSession.createDataFrame(rates, "_group string, _declared double")
    joined = prevalence.join(F.broadcast(listed), F.col(group).cast("string") == F.col("_group"), "left")
    target = F.coalesce("_declared", F.lit(float(default)))
    return joined.select(
        group,
        "n_rows",
        "n_hits",
        F.col("rate_pct").alias("observed_pct"),
        target.alias("declared_pct"),
        (F.col("rate_pct") - target).alias("gap_pct"),
        (F.abs(F.col("rate_pct") - target) <= tolerance).alias("as_declared"),
        rate_label(target).alias("declared_label"),
    )
