"""Search texts for the entries of a watch-list of any length, in one pass over each text."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Automatons of this process, by the list they were built from: one build for each worker.
_automatons: dict[tuple[str, ...], object] = {}


def automaton_of(markers: tuple[str, ...]):
    """The Aho-Corasick automaton of a list; empty entries are left out."""
    found = _automatons.get(markers)
    if found is None:
        import ahocorasick

        found = ahocorasick.Automaton()
        for place, marker in enumerate(markers):
            if marker:
                found.add_word(marker, place)
        found.make_automaton()
        _automatons.clear()
        _automatons[markers] = found
    return found


def watchlist_matches(fields: Sequence[Column], markers: Sequence[str], ignore_case: bool = False) -> Column:
    """A struct ``n_fields`` (fields that hold an entry) and ``markers`` (the entries found, sorted).

    All fields are searched in one call, a batch at a time, and the cost does not
    depend on the length of the list. Null fields hold nothing; an empty entry is in
    every field that is not null.
    """
    names = tuple(sorted({m.lower() for m in markers} if ignore_case else set(markers)))
    blank = names[:1] == ("",)

    @F.arrow_udf("struct<n_fields: int, markers: array<string>>")
    def search(*columns: pa.Array) -> pa.Array:
        automaton = automaton_of(names)
        full = len(automaton) > 0
        counts, found = [], []
        for texts in zip(*[c.to_pylist() for c in columns], strict=True):
            n, places = 0, set()
            for text in texts:
                if text is None:
                    continue
                own = {place for _, place in automaton.iter(text)} if full else set()
                if blank:
                    own.add(0)
                n += bool(own)
                places |= own
            counts.append(n)
            found.append([names[place] for place in sorted(places)])
        arrays = [pa.array(counts, pa.int32()), pa.array(found, pa.list_(pa.string()))]
        return pa.StructArray.from_arrays(arrays, ["n_fields", "markers"])

    return search(*[F.lower(f) if ignore_case else f for f in fields])
