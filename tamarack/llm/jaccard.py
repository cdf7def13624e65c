"""Documents whose sets of word n-grams have a Jaccard similarity of at least a threshold.

The join is a sparse product of the document by n-gram incidence with its
transpose, taken in blocks of columns (the partitions of a shuffle by n-gram).
Only as much of each row is multiplied as a linked pair must meet in: rare n-grams
first, those held by a large share of all documents last. Overlaps are added up
per pair, and pairs that their sizes, places or parity sketches keep below the
threshold are discarded; what remains is multiplied out over the full sets.

Documents with equal sets are one row of the matrix. A column is first multiplied
with a single member, and only pairs between groups that this has not connected
follow, so a large group of near copies is not paired off.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamarack.llm.components import connected
from tamarack.llm.grams import runs
from tamarack.llm.partners import compare, only
from tamarack.llm.words import runs_hashes, word_hashes
from tamarack.session import stage, unstage

WORDS = 5
PERCENT = 75
# Bits of a parity sketch, kept as longs.
SKETCH_BITS = 512
SKETCH = [f"b{k}" for k in range(SKETCH_BITS // 64)]
# An n-gram is common if some task finds it in this share of its documents (and in 16 at least).
# The order of columns depends on it, the result does not.
COMMON_SHARE = 0.002
MOST_COMMON = 50_000
# Tasks that a common column is dealt to.
HOT_PARTS = 64
RUN_CHARS = 1 << 17
BLOCK = 4096


def shingle_sets(texts: list[str], n: int = WORDS) -> Iterator[np.ndarray]:
    """The sorted set of n-gram hashes of each text; the whole sequence where it has fewer words."""
    for start, end in runs(texts, RUN_CHARS):
        words, first, *_ = word_hashes(texts[start:end])
        grams = runs_hashes(words, n)
        for a, b in zip(first[:-1], first[1:], strict=True):
            if b - a >= n:
                yield np.unique(grams[a : b - n + 1].view(np.int64))
            else:
                yield runs_hashes(words[a:b], b - a).view(np.int64) if b > a else np.zeros(0, np.int64)


def required(a: Column | int, b: Column | int, percent: int = PERCENT):
    """The overlap that two sets of these sizes need."""
    total = (a + b) * percent
    if isinstance(total, Column):
        return F.ceil(total / (100 + percent))
    return -(-total // (100 + percent))


def prefix_length(n, percent: int = PERCENT):
    """Columns of a set, in the common order, of which a linked set of any size holds one at least."""
    if isinstance(n, Column):
        return n - F.ceil(n * percent / 100) + 1
    return n - -(-n * percent // 100) + 1


def _describe(docs: DataFrame) -> DataFrame:
    """A row for each document (id, set size, digest of the set, sketch), and rows of n-grams common in a task."""
    columns = ["doc_id", "n", "digest", *SKETCH, "gram", "times"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n_docs = [], 0
        for batch in batches:
            sizes, digests, sketches = [], [], []
            for grams in shingle_sets([t or "" for t in batch.column("text").to_pylist()]):
                sizes.append(len(grams))
                digests.append(hashlib.blake2b(grams.tobytes(), digest_size=16).digest())
                odd = np.bincount(grams & (SKETCH_BITS - 1), minlength=SKETCH_BITS) & 1
                sketches.append(np.packbits(odd.astype(np.uint8)).view(np.int64))
                seen.append(grams)
            n_docs += batch.num_rows
            sketch = np.array(sketches, np.int64).reshape(-1, len(SKETCH))
            none = pa.nulls(batch.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(sizes, pa.int64()),
                    pa.array(digests, pa.binary()),
                    *[pa.array(sketch[:, k]) for k in range(len(SKETCH))],
                    none,
                    none,
                ],
                columns,
            )
            if sum(map(len, seen)) > 1_500_000:
                yield from common(seen, n_docs)
                seen, n_docs = [], 0
        yield from common(seen, n_docs)

    def common(seen: list[np.ndarray], n_docs: int) -> Iterator[pa.RecordBatch]:
        if not seen:
            return
        grams, times = np.unique(np.concatenate(seen), return_counts=True)
        often = times >= max(16, COMMON_SHARE * n_docs)
        none = pa.nulls(int(often.sum()), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [none, none, pa.nulls(len(none), pa.binary()), *[none] * len(SKETCH), pa.array(grams[often]),
             pa.array(times[often])],
            columns,
        )

    longs = ", ".join(f"{c} long" for c in SKETCH)
    return docs.mapInArrow(run, f"doc_id long, n long, digest binary, {longs}, gram long, times long")


def _postings(docs: DataFrame, common: np.ndarray) -> DataFrame:
    """``gram, doc_id, n, place, hot``: the part of each row of the matrix that is multiplied."""
    shared = docs.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = shared.value
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for start, end in runs(texts, RUN_CHARS):
                out = []
                for doc, grams in zip(ids[start:end], shingle_sets(texts[start:end]), strict=True):
                    if not len(grams):
                        continue
                    hot = np.isin(grams, often) if len(often) else np.zeros(len(grams), bool)
                    order = np.argsort(hot, kind="stable")[: prefix_length(len(grams))]
                    out.append((grams[order], np.full(len(order), doc), np.full(len(order), len(grams)),
                                np.arange(len(order)), hot[order]))
                if out:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(c)) for c in zip(*out, strict=True)],
                        ["gram", "doc_id", "n", "place", "hot"],
                    )

    return docs.mapInArrow(run, "gram long, doc_id long, n long, place long, hot boolean")


def _overlap_reaches(x: np.ndarray, y: np.ndarray, need: int) -> bool:
    """Whether two sorted sets share ``need`` members; blocks are added up until the rest cannot decide."""
    if len(x) > len(y):
        x, y = y, x
    found = 0
    for start in range(0, len(x), BLOCK):
        part = x[start : start + BLOCK]
        places = np.minimum(np.searchsorted(y, part), len(y) - 1)
        found += int((y[places] == part).sum())
        rest = len(x) - start - len(part)
        if found >= need or found + rest < need:
            break
    return found >= need


def _verified(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of the distinct pairs ``a, b`` whose whole sets are similar enough."""

    def contents(texts: list[str]) -> Iterator[bytes]:
        return (grams.tobytes() for grams in shingle_sets(texts))

    def judge(a: bytes, b: bytes, _: list[int]) -> list[tuple]:
        x, y = np.frombuffer(a, np.int64), np.frombuffer(b, np.int64)
        return [()] if len(x) and len(y) and _overlap_reaches(x, y, required(len(x), len(y))) else []

    no_hints = F.array().cast("array<long>").alias("hints")
    return compare(docs, pairs.select("a", "b", no_hints), contents, judge, "").distinct()


def _few_differ(x: str, y: str) -> Column:
    """Bits of the sketches that differ are members of one set only, of which a linked pair has few."""
    differing = sum(F.bit_count(F.col(f"{x}.{c}").bitwiseXOR(F.col(f"{y}.{c}"))) for c in SKETCH)
    return (100 + PERCENT) * differing <= (100 - PERCENT) * (F.col(f"{x}.n") + F.col(f"{y}.n"))


def _cross_pairs(posts: DataFrame, reps: DataFrame, known: DataFrame) -> DataFrame:
    """Pairs between groups that ``known`` does not connect, and that may be similar enough."""
    group = F.coalesce("component", "doc_id")
    tagged = (
        posts.join(known.withColumnRenamed("id", "doc_id"), "doc_id", "left")
        .withColumn("grp", group)
        .select("gram", "doc_id", "n", "place", "grp")
    )
    sizes = tagged.groupBy("gram", "grp").agg(F.count(F.lit(1)).alias("size"))
    mixed = (
        sizes.groupBy("gram")
        .agg(F.count(F.lit(1)).alias("groups"), F.max(F.struct("size", "grp")).alias("most"))
        .where("groups > 1")
        .select("gram", F.col("most.grp").alias("largest"))
    )
    # One of every pair lies outside the column's largest group.
    rows = stage(
        tagged.join(mixed, "gram")
        .join(reps.select("doc_id", *SKETCH), "doc_id")
        .withColumn("minor", F.col("grp") != F.col("largest"))
        .drop("largest"),
        "mixed",
    )
    x, y = rows.where("minor").alias("x"), rows.alias("y")
    nx, ny = F.col("x.n"), F.col("y.n")
    rest = 1 + F.least(nx - F.col("x.place") - 1, ny - F.col("y.place") - 1)
    products = x.join(
        y,
        (F.col("x.gram") == F.col("y.gram"))
        & (F.col("x.grp") != F.col("y.grp"))
        & (~F.col("y.minor") | (F.col("x.doc_id") < F.col("y.doc_id")))
        & (100 * F.least(nx, ny) >= PERCENT * F.greatest(nx, ny))
        & _few_differ("x", "y"),
    )
    need = required(nx, ny)
    # Which of a pair is x changes by column: the key is ordered, so that its products meet.
    first, second = F.least("x.doc_id", "y.doc_id"), F.greatest("x.doc_id", "y.doc_id")
    summed = products.groupBy(first.alias("a"), second.alias("b")).agg(
        F.count(F.lit(1)).alias("shared"),
        # The first column that a linked pair shares leaves enough of both rows behind it.
        F.max(rest >= need).alias("enough"),
        F.first(need).alias("need"),
        F.first(F.greatest(nx - prefix_length(nx), ny - prefix_length(ny))).alias("beyond"),
    )
    return summed.where("enough AND shared + beyond >= need").select("a", "b")


def similar_documents(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, n_shingles, component_id``.

    Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; a document is the set
    of its 5-word n-grams, or its whole sequence where it has fewer words. Two
    documents are linked when 100 * intersection >= 75 * union. ``component_id`` is
    the smallest id reachable by links, the document's own included. A null or blank
    text has no n-grams and is linked with nothing. Rows that share an id count as
    one document that is linked with whatever one of them is. A row without an id
    has the component of the documents with an equal set, if there are any, else
    null. Ids are integers. Other columns are not read; no rows give no rows.
    """
    texts = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    described = stage(_describe(texts), "described")
    reps_of = described.where("digest IS NOT NULL")
    common = (
        described.where("gram IS NOT NULL")
        .groupBy("gram")
        .agg(F.sum("times").alias("times"))
        .orderBy(F.col("times").desc(), "gram")
        .limit(MOST_COMMON)
        .select("gram")
    )
    common = np.sort(np.array([r[0] for r in common.collect()], np.int64))

    filled = reps_of.where("n > 0")
    classes = filled.groupBy("digest").agg(F.min("doc_id").alias("rep"))
    members = stage(filled.select("doc_id", "n", "digest").join(classes, "digest").drop("digest"), "members")
    copies = members.where("doc_id IS NOT NULL AND doc_id <> rep").select("doc_id").distinct()
    firsts = members.where("doc_id = rep").select("doc_id").distinct()
    # An id that is repeated may be a copy and a first at once; as a first it stays.
    copies = stage(copies.join(firsts, "doc_id", "left_anti"), "copies")
    sources = texts.where("doc_id IS NOT NULL")

    found = _postings(only(sources, copies, "left_anti"), common)
    # A common column is dealt to several tasks; every other is held by a small share of all documents.
    spread = F.when(F.col("hot"), F.pmod(F.xxhash64("doc_id"), F.lit(HOT_PARTS))).otherwise(F.lit(0))
    column = Window.partitionBy("gram", "part")
    first = F.min(F.struct("doc_id", "n"))
    found = found.withColumn("part", spread.cast("int"))
    found = found.withColumns({"members": F.count(F.lit(1)).over(column), "lead": first.over(column)})
    posts = stage(found.where("hot OR members > 1").drop("part", "members"), "postings")
    hot = posts.where("hot").drop("lead")
    leads = hot.groupBy("gram").agg(F.count(F.lit(1)).alias("members"), first.alias("lead")).where("members > 1")
    columns = posts.where("NOT hot").unionByName(hot.join(leads.drop("members"), "gram")).drop("hot")

    close = 100 * F.least("n", "lead.n") >= PERCENT * F.greatest("n", "lead.n")
    stars = columns.where((F.col("doc_id") != F.col("lead.doc_id")) & close)
    stars = stars.groupBy(F.col("doc_id").alias("b")).agg(F.mode("lead.doc_id", True).alias("a")).select("a", "b")
    stars = stars.join(reps_of.alias("x"), F.col("a") == F.col("x.doc_id")).join(
        reps_of.alias("y"), F.col("b") == F.col("y.doc_id")
    )
    stars = stars.where(_few_differ("x", "y")).select("a", "b").distinct()
    first_links = _verified(sources, stars)
    known = connected(first_links)
    more_links = _verified(sources, _cross_pairs(columns, reps_of, known))
    groups = stage(connected(first_links.unionByName(more_links)), "components")
    unstage(posts)

    component = F.coalesce("component", "rep")
    linked = members.join(groups.withColumnRenamed("id", "rep"), "rep", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")
    )
    empty = reps_of.where("n = 0").select(
        "doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")
    )
    return linked.unionByName(empty)
