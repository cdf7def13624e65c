"""Names that look like a known one: an edit-distance join over pieces of the known names.

Two names at most ``k`` edits apart share a piece: of ``k + 1`` pieces that a known name
is cut into, one is untouched and lies at most ``k`` places off in the other. So both
sides meet by an equality join on (length of the known name, number of the piece, piece),
and only names that meet are compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Pieces of the known names that are broadcast at most; a longer list is shuffled.
BROADCAST_PIECES = 1_000_000


def name_counts(df: DataFrame, field: str, pattern: str = "[A-Za-z]{4,}") -> DataFrame:
    """``name, n_docs``: lower-cased matches of the pattern and the number of rows that hold each.

    A row counts a name once; counts are combined before the shuffle. A null text has none.
    """
    found = F.array_distinct(F.transform(F.regexp_extract_all(field, F.lit(pattern), F.lit(0)), F.lower))
    return df.select(F.explode(found).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n_docs"))


def _cut(length: Column, i: Column, pieces: int) -> Column:
    return F.floor(i * length / pieces).cast("int")


def known_pieces(name: Column, distance: int) -> Column:
    """The pieces ``(m, i, piece)`` of a known name. One too short to be cut has a single empty piece."""
    m, n = F.length(name), distance + 1

    def piece(i: Column) -> Column:
        start = _cut(m, i, n)
        part = F.substring(name, start + 1, _cut(m, i + 1, n) - start)
        return F.struct(m.alias("m"), i.alias("i"), part.alias("piece"))

    short = F.array(F.struct(F.lit(0).alias("m"), F.lit(0).alias("i"), F.lit("").alias("piece")))
    return F.when(m > distance, F.transform(F.sequence(F.lit(0), F.lit(distance)), piece)).otherwise(short)


def sought_pieces(name: Column, distance: int, known_lengths: Column) -> Column:
    """Every ``(m, i, piece)`` that a known name within the distance could share with this one.

    At most ``(2k + 1)**2 * (k + 1)`` for ``k`` edits, however long the name is;
    lengths that no known name has are left out.
    """
    length, n = F.length(name), distance + 1

    def of_length(m: Column) -> Column:
        def of_piece(i: Column) -> Column:
            start = _cut(m, i, n)
            size = _cut(m, i + 1, n) - start

            def shifted(s: Column) -> Column:
                fits = (start + s >= 0) & (start + s + size <= length)
                found = F.struct(m.alias("m"), i.alias("i"), F.substring(name, start + s + 1, size).alias("piece"))
                return F.when(fits, found)

            return F.transform(F.sequence(F.lit(-distance), F.lit(distance)), shifted)

        return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(distance)), of_piece))

    near = F.sequence(F.greatest(F.lit(n), length - distance), length + distance)
    lengths = F.filter(near, lambda m: F.array_contains(known_lengths, m))
    pieces = F.array_distinct(F.array_compact(F.flatten(F.transform(lengths, of_length))))
    pieces = F.when(length >= 1, pieces).otherwise(F.array().cast("array<struct<m: int, i: int, piece: string>>"))
    short = F.array(F.struct(F.lit(0).alias("m"), F.lit(0).alias("i"), F.lit("").alias("piece")))
    return F.when(length <= 2 * distance, F.concat(pieces, short)).otherwise(pieces)


def lookalike_names(names: DataFrame, known: DataFrame, distance: int = 2) -> DataFrame:
    """The columns of ``names`` with ``allowed, distance``: names within 1 to ``distance`` edits of a known one.

    ``names`` has one row per ``name``, ``known`` has a column ``name``; names on the
    list themselves are not reported, and null names are left out. One row per pair. The
    known names' pieces are broadcast while they are few, so that the names stay in place.
    """
    listed = known.select("name").dropna().distinct()
    few = listed.limit(BROADCAST_PIECES // (distance + 1) + 1).count() * (distance + 1) <= BROADCAST_PIECES
    wanted = listed.select(F.col("name").alias("allowed"), F.inline(known_pieces(F.col("name"), distance)))
    exact = F.broadcast(listed) if few else listed
    others = names.where("name IS NOT NULL").join(exact, "name", "left_anti")
    # As many numbers as known names have different lengths.
    lengths = sorted(r[0] for r in listed.select(F.length("name")).distinct().collect())
    of_known = F.array(*map(F.lit, lengths)).cast("array<int>")
    sought = others.select("*", F.inline(sought_pieces(F.col("name"), distance, of_known)))
    met = sought.join(F.broadcast(wanted) if few else wanted, ["m", "i", "piece"])
    apart = F.levenshtein("name", "allowed", distance)
    return met.withColumn("distance", apart).where("distance >= 0").drop("m", "i", "piece").dropDuplicates(["name", "allowed"])
