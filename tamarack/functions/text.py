"""Substring predicates and small parsers. All run inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tamarack.functions.watchlist import watchlist_matches


def contains_marker(text: Column, marker: str, ignore_case: bool = False) -> Column:
    """Substring test; null text never matches.

    Corpus scans are case-sensitive, response scoring is not.
    """
    if ignore_case:
        text, marker = F.lower(text), marker.lower()
    return F.coalesce(F.contains(text, F.lit(marker)), F.lit(False))


# Up to so many markers one test each is written into the expression; longer lists go through an automaton.
FEW_MARKERS = 64


def contains_any(fields: Sequence[Column], markers: Sequence[str], ignore_case: bool = False) -> Column:
    """True once if any field holds any marker, however many do."""
    if len(markers) > FEW_MARKERS:
        return watchlist_matches(fields, markers, ignore_case)["n_fields"] > 0
    tests = [contains_marker(f, m, ignore_case) for f in fields for m in markers]
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def markers_found(fields: Sequence[Column], markers: Sequence[str]) -> Column:
    """Sorted array of the watch-list entries found in any of the fields."""
    names = sorted(set(markers))
    if len(names) > FEW_MARKERS:
        return watchlist_matches(fields, names)["markers"]
    found = [F.when(contains_any(fields, [m]), F.lit(m)) for m in names]
    return F.array_compact(F.array(*found))


def marker_line(text: Column, marker: str) -> Column:
    """1-based line number of the first occurrence, null if absent."""
    before = F.substring_index(text, marker, 1)
    newlines = F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit("")))
    return F.when(contains_marker(text, marker), newlines + 1)


def marker_placement(text: Column, marker: str) -> Column:
    """``top``, ``after_shebang``, ``elsewhere`` or ``absent``."""
    line = marker_line(text, marker)
    shebang = F.startswith(F.split_part(text, F.lit("\n"), F.lit(1)), F.lit("#!"))
    return (
        F.when(line.isNull(), F.lit("absent"))
        .when(line == 1, F.lit("top"))
        .when((line == 2) & shebang, F.lit("after_shebang"))
        .otherwise(F.lit("elsewhere"))
    )


def parse_fractions(text: Column, default: Sequence[float]) -> Column:
    """A comma-separated list of numbers; the default if any entry is no number."""
    values = F.transform(F.split(text, ","), lambda s: F.trim(s).try_cast("double"))
    fallback = F.array(*[F.lit(float(x)) for x in default])
    bad = text.isNull() | F.exists(values, lambda v: v.isNull())
    return F.when(bad, fallback).otherwise(values)
