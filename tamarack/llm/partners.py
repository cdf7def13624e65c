"""Bring the contents of paired documents together and compare them, pair by pair."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarack.llm.grams import runs
from tamarack.session import stage, unstage

# Tables of ids are broadcast up to so many rows, 8 bytes each; longer ones are shuffled.
BROADCAST_IDS = 1_000_000
# A list of pairs is broadcast up to so many longs, hints included; a longer one is shuffled with the contents.
BROADCAST_LONGS = 3_000_000
# Partners of one document that are compared in one task.
SLICE = 2000
RUN_CHARS = 1 << 17


def only(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """Semi or anti join with a table of ids, which is broadcast if it is short."""
    short = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if short else ids, "doc_id", how)


def compare(
    docs: DataFrame,
    pairs: DataFrame,
    contents: Callable[[list[str]], Iterator[bytes]],
    judge: Callable[[bytes, bytes, list[int]], list[tuple]],
    schema: str,
) -> DataFrame:
    """Rows ``a, b, ...`` that ``judge`` makes of the contents of each pair, as a stored table.

    ``pairs`` has ``a, b, hints`` (an array of longs); ``contents`` makes bytes of
    texts, once for each document; ``schema`` names the columns behind ``a`` and
    ``b``, all longs. The contents of all ``b`` are brought to those of their ``a``.
    An ``a`` with many partners is sliced, and its contents sent to every slice. An
    id that several rows share has several contents, and all are compared.
    """
    pairs = stage(pairs, "pairs")
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()

    def to_contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for start, end in runs(texts, RUN_CHARS):
                own = pa.array(contents(texts[start:end]), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(start, end - start), own], ["doc_id", "content"]
                )

    made = only(docs.select("doc_id", "text"), ids, "left_semi").mapInArrow(to_contents, "doc_id long, content binary")
    slices = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / SLICE).cast("int").alias("slices"))
    own = slices.select(
        "a",
        F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"),
        F.lit(False).alias("member"),
        F.col("a").alias("doc_id"),
        F.array().cast("array<long>").alias("hints"),
    )
    partners = pairs.join(slices, "a").select(
        "a",
        F.pmod(F.xxhash64("b"), F.col("slices")).cast("int").alias("slice"),
        F.lit(True).alias("member"),
        F.col("b").alias("doc_id"),
        "hints",
    )
    needed = own.unionByName(partners)
    weight = needed.agg(F.sum(F.size("hints") + 3)).first()[0] or 0
    needed = F.broadcast(needed) if weight <= BROADCAST_LONGS else needed
    placed = made.join(needed, "doc_id").select("a", "slice", "member", "doc_id", "hints", "content")
    names = ["a", "b", *(part.split()[0] for part in schema.split(",") if part)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            out = []
            for a, part, member, doc, hints, content in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if not member:
                    held = [*held, content] if key == (a, part) else [content]
                    key = (a, part)
                else:
                    out.extend((a, doc, *row) for one in held for row in judge(one, content, hints))
            columns = list(zip(*out, strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

    ordered = placed.repartition("a", "slice").sortWithinPartitions("a", "slice", "member")
    full = ", ".join(["a long", "b long", *([schema] if schema else [])])
    result = stage(ordered.mapInArrow(run, full), "compared")
    unstage(pairs)
    return result
