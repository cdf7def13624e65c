"""Trie of the prefixes that conversations share, with count-min screening.

A prefix of ``d`` turns is known by its depth and a 128-bit digest: the exclusive or of
the digests of its turns, each mixed with its place. Running digests come from windows
over chunks of bounded length, so that no conversation has to fit a task.

A count-min sketch over all prefix digests tells which of them can be shared. A prefix
with an estimate of one has one member, and so has every longer one: such tails are
written where they lie. Only the other prefixes are shuffled and grouped exactly.

Sums over subtrees need no pass per level. Every node belongs to its smallest member, so
that the nodes of one conversation form a chain; chains hang on chains. Their totals are
summed by pointer doubling, in logarithmically many rounds, then along each chain.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamarack.operators.numbering import number_rows
from tamarack.session import stage, unstage

# Turns of the conversation that begins a block are at most so many; blocks have so many ids.
MOST_HEAD, BLOCK_IDS = 3, 20
# Turns of one conversation that are summed up in one window.
CHUNK = 4096
# Rows of counters in the sketch, counters for each prefix, and counters of a row at most.
SKETCH_ROWS, COUNTERS_EACH, MOST_COUNTERS = 3, 8, 1 << 26
# Join keys held by more than this share of the rows (and more than so many) are joined by broadcast.
HOT_SHARE, HOT_ROWS = 1 / 1000, 2000
# Ids that are written into one piece of text before the pieces of a node are hashed in order.
PIECE_IDS = 4096

WORD = r"[^\x20\x09-\x0D]+"
NODE = ["d", "p1", "p2"]


def head_length(conv: Column) -> Column:
    return (F.crc32(conv.cast("string").cast("binary")) % (MOST_HEAD + 1)).cast("int")


def rebuilt_turns(conversations: DataFrame, chunk: int) -> tuple[DataFrame, DataFrame]:
    """The conversations (``c, n_own, h, head, n_head, len``) and their rebuilt turns (``c, k, d, key, words, len``).

    Both are stored. ``k`` numbers the chunks of a conversation's own turns.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    named = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    turns = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("c"),
        "turn",
        F.substring(F.unhex(F.sha2(named, 256)), 1, 16).alias("key"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"),
    )
    numbered = stage(number_rows(turns, ["c"], ["turn", "key"], "pos", "n_own").drop("turn"), "turns")

    convs = (
        numbered.where(F.col("pos") <= MOST_HEAD)
        .groupBy("c")
        .agg(F.max("n_own").alias("n_own"), F.array_sort(F.collect_list(F.struct("pos", "key", "words"))).alias("first"))
    )
    convs = stage(convs, "conversations")
    begins = convs.where(F.col("c") % BLOCK_IDS == 0).select(F.col("c").alias("begin"), F.col("first").alias("taken"))
    h, own = head_length(F.col("c")), F.col("n_own")
    info = (
        convs.drop("first")
        .withColumn("begin", F.col("c") - F.col("c") % BLOCK_IDS)
        .join(begins, "begin", "left")
        .withColumn("h", h)
        .withColumn("head", F.coalesce(F.slice("taken", F.lit(1), F.col("h")), F.array().cast(convs.schema["first"].dataType)))
        .withColumn("n_head", F.size("head"))
        .withColumn("len", F.col("n_head") + F.greatest(own - F.col("h"), F.lit(0)))
        .select("c", "n_own", "h", "head", "n_head", "len")
    )
    info = stage(info, "rebuilt")
    # One row for each conversation and chunk, so that a long conversation is no hot key.
    pieces = info.select("c", "n_head", "len", F.explode(F.sequence(F.lit(0), F.floor((own - 1) / chunk))).alias("k"))
    own_turns = (
        numbered.where(F.col("pos") > h)
        .withColumn("k", F.floor((F.col("pos") - 1) / chunk))
        .join(pieces, ["c", "k"])
        .select("c", "k", (F.col("pos") - h + F.col("n_head")).alias("d"), "key", "words", "len")
    )
    head_turns = info.select("c", "len", F.explode("head").alias("turn")).select(
        "c", F.lit(0).cast("long").alias("k"), F.col("turn.pos").alias("d"), "turn.key", "turn.words", "len"
    )
    turns = stage(own_turns.unionByName(head_turns), "rebuilt-turns")
    unstage(numbered, convs)
    return info, turns


def prefix_digests(turns: DataFrame, cut: bool) -> DataFrame:
    """``c, k, d, p1, p2, q1, q2, words, len``: digests of each prefix and of the one before it.

    ``cut`` says whether any conversation has several chunks.
    """
    rows = turns
    for i in (1, 2):
        rows = rows.withColumn(f"e{i}", F.xxhash64(F.lit(i), "d", "key"))
    of_chunk = Window.partitionBy("c", "k").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    running = rows.withColumns({f"p{i}": F.bit_xor(f"e{i}").over(of_chunk) for i in (1, 2)})
    if cut:
        totals = rows.groupBy("c", "k").agg(F.bit_xor("e1").alias("t1"), F.bit_xor("e2").alias("t2"))
        before = Window.partitionBy("c").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
        totals = totals.select("c", "k", *[F.bit_xor(f"t{i}").over(before).alias(f"t{i}") for i in (1, 2)])
        running = running.join(totals, ["c", "k"])
        for i in (1, 2):
            running = running.withColumn(f"p{i}", F.col(f"p{i}").bitwiseXOR(F.coalesce(f"t{i}", F.lit(0))))
    return running.select(
        *["c", "k", "d", "p1", "p2"],
        *[F.col(f"p{i}").bitwiseXOR(F.col(f"e{i}")).alias(f"q{i}") for i in (1, 2)],
        "words",
        "len",
    )


def _counters(width: int) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(100 + j), *NODE), F.lit(width)) for j in range(SKETCH_ROWS)]


def sketch(prefixes: DataFrame, most: int) -> tuple[np.ndarray, int]:
    """The count-min sketch of all prefixes as bits: whether a counter is above one. And the counters of a row.

    Counters are summed up by Spark. Only the bits leave it, ``SKETCH_ROWS * most / 8``
    bytes at most; a table with more prefixes fills them further, so that fewer
    prefixes are proved to be single, with the same result.
    """
    n = prefixes.count()
    width = min(max(1 << 16, 1 << (COUNTERS_EACH * max(n, 1) - 1).bit_length()), most)
    numbers = [F.lit(j * width) + counter for j, counter in enumerate(_counters(width))]
    above = (
        prefixes.select(F.explode(F.array(*numbers)).alias("counter"))
        .groupBy("counter")
        .agg(F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .groupBy(F.shiftright("counter", 6).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(counter & 63 AS int))")).alias("bits"))
        .toArrow()
    )
    bits = np.zeros(SKETCH_ROWS * width // 64, np.int64)
    bits[above["word"].to_numpy()] = above["bits"].to_numpy()
    return bits, width


def screened(prefixes: DataFrame, most: int) -> DataFrame:
    """Add ``single`` (proved to have one member) and ``before``: whether the prefix before it in its chunk is."""
    bits, width = sketch(prefixes, most)
    shared = prefixes.sparkSession.sparkContext.broadcast(bits)

    @F.arrow_udf("boolean")
    def estimate_is_one(*counters: pa.Array) -> pa.Array:
        above = np.ones(len(counters[0]), bool)
        for j, own in enumerate(counters):
            place = own.to_numpy(zero_copy_only=False) + j * width
            above &= (shared.value[place >> 6] >> (place & 63)) & 1 == 1
        return pa.array(~above)

    marked = prefixes.withColumn("one", estimate_is_one(*_counters(width)))
    chunk = Window.partitionBy("c", "k").orderBy("d")
    return marked.withColumns(
        {
            "single": F.max("one").over(chunk.rowsBetween(Window.unboundedPreceding, 0)),
            "before": F.coalesce(F.max("one").over(chunk.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False)),
        }
    ).drop("one", "k")


def lookup(rows: DataFrame, keys: Sequence[str], known: DataFrame) -> DataFrame:
    """Left join of a stored table with ``known``, which has each key once.

    Keys that hold more than ``HOT_SHARE`` of the rows, at most ``1 / HOT_SHARE`` of
    them, are joined by broadcast; the others are shuffled. No key may be null.
    """
    keys = list(keys)
    least = max(HOT_ROWS, rows.count() * HOT_SHARE)
    hot = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > least).drop("n")
    hot = stage(hot.join(known, keys, "left").withColumn("hot", F.lit(True)), "hot")
    if hot.isEmpty():
        return rows.join(known, keys, "left")
    marked = rows.join(F.broadcast(hot), keys, "left")
    rest = marked.where("hot IS NULL").select(*rows.columns).join(known, keys, "left")
    return marked.where("hot").drop("hot").unionByName(rest)


def end_digests(ends: DataFrame) -> DataFrame:
    """``d, p1, p2, ends_sha256``: SHA-256 of the ids ``c`` of each node, ascending, comma-joined.

    A range partitioning sorts the ids of a node, however many; runs of them are
    joined to pieces where they lie, and only the pieces of a node meet in one task,
    which hashes them one after the other.
    """

    def to_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids = None, []

        def piece() -> pa.RecordBatch:
            row = [*key, ids[0], ",".join(map(str, ids))]
            return pa.RecordBatch.from_arrays([pa.array([v]) for v in row], [*NODE, "first", "ids"])

        for batch in batches:
            for *own, c in zip(*[batch.column(name).to_pylist() for name in (*NODE, "c")], strict=True):
                if ids and (own != key or len(ids) >= PIECE_IDS):
                    yield piece()
                    ids = []
                key = own
                ids.append(c)
        if ids:
            yield piece()

    def to_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest = None, None

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([v]) for v in (*key, digest.hexdigest())], [*NODE, "ends_sha256"])

        for batch in batches:
            for *own, ids in zip(*[batch.column(name).to_pylist() for name in (*NODE, "ids")], strict=True):
                if own == key:
                    digest.update(b",")
                else:
                    if key:
                        yield row()
                    key, digest = own, hashlib.sha256()
                digest.update(ids.encode())
        if key:
            yield row()

    types = "d long, p1 long, p2 long"
    ranged = ends.select(*NODE, "c").repartitionByRange(*NODE, "c").sortWithinPartitions(*NODE, "c")
    pieces = stage(ranged.mapInArrow(to_pieces, f"{types}, first long, ids string"), "ends")
    ordered = pieces.repartition(*NODE).sortWithinPartitions(*NODE, "first")
    return ordered.mapInArrow(to_digests, f"{types}, ends_sha256 string")


def chain_totals(chains: DataFrame) -> DataFrame:
    """``conv, leaves, saved`` of every chain together with all chains that hang on it, however deep.

    ``chains`` has ``conv, up, leaves, saved``; ``up`` is the chain it hangs on. In round
    ``r`` every chain knows the sum over those less than ``2**r`` steps below it and adds
    what the chains exactly ``2**r`` steps below know.
    """
    current = stage(chains, "chains")
    while not current.where("up IS NOT NULL").isEmpty():
        hanging = current.where("up IS NOT NULL")
        below = hanging.groupBy(F.col("up").alias("conv")).agg(
            F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved")
        )
        next_up = current.where("up IS NOT NULL").select(F.col("conv").alias("up"), F.col("up").alias("far"))
        moved = lookup(hanging, ["up"], next_up).drop("up").withColumnRenamed("far", "up")
        moved = moved.unionByName(current.where("up IS NULL"))
        summed = moved.join(below, "conv", "left").select(
            "conv",
            "up",
            *[(F.col(x) + F.coalesce(f"more_{x}", F.lit(0))).alias(x) for x in ("leaves", "saved")],
        )
        following = stage(summed, "chains")
        unstage(current)
        current = following
    return current.drop("up")


def sums_below(nodes: DataFrame, columns: Sequence[str], chunk: int) -> DataFrame:
    """Replace each column by its sum over the node and all deeper ones of the same ``conv``, in chunks of depths."""
    deepest = nodes.agg(F.max("d")).first()[0] or 0
    nodes = nodes.withColumn("k", F.floor(F.col("d") / chunk))
    own = Window.partitionBy("conv", "k").orderBy(F.desc("d")).rowsBetween(Window.unboundedPreceding, 0)
    summed = nodes.withColumns({x: F.sum(x).over(own) for x in columns})
    if deepest >= chunk:
        totals = nodes.groupBy("conv", "k").agg(*[F.sum(x).alias(f"{x}_below") for x in columns])
        below = Window.partitionBy("conv").orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, -1)
        totals = totals.select("conv", "k", *[F.sum(f"{x}_below").over(below).alias(f"{x}_below") for x in columns])
        summed = summed.join(totals, ["conv", "k"])
        summed = summed.withColumns({x: F.col(x) + F.coalesce(f"{x}_below", F.lit(0)) for x in columns})
        summed = summed.drop(*[f"{x}_below" for x in columns])
    return summed.drop("k")


def prefix_trie(conversations: DataFrame, chunk: int = CHUNK, most_counters: int = MOST_COUNTERS) -> DataFrame:
    """One row per node: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``.

    Turns are ordered by ``turn`` (null first), equal ones by a digest of role and text;
    a null role or text is empty, and a row without ``conv_id`` belongs to no
    conversation. Each conversation ``c`` is rebuilt from the first ``h`` turns of
    ``c - c % 20`` and its own turns after its first ``h``, ``h`` being the CRC-32 of
    ``c`` as text modulo 4. A node is a distinct sequence of the first ``d`` rebuilt
    turns and is named by its smallest member; the root has no turns, and its
    members are all conversations. Repeated rows are turns like any other. Other
    columns are not read; no conversations give no nodes.
    """
    info, turns = rebuilt_turns(conversations.select("conv_id", "turn", "role", "text"), chunk)
    longest = info.agg(F.max("n_own")).first()[0]
    prefixes = stage(prefix_digests(turns, (longest or 0) > chunk), "prefixes")
    rows = stage(screened(prefixes, most_counters), "screened")
    unstage(turns, prefixes)

    none, zero = F.lit(None).cast("long"), F.lit(0).cast("long")
    roots = info.select(
        "c", *[zero.alias(x) for x in NODE], none.alias("q1"), none.alias("q2"), zero.alias("words"), "len"
    )
    possibly = rows.where("NOT single").drop("single", "before").unionByName(roots)
    ends = F.col("d") == F.col("len")
    nodes = possibly.groupBy(*NODE).agg(
        F.min("c").alias("conv"),
        F.count(F.lit(1)).alias("n"),
        *[F.first(x).alias(x) for x in ("words", "q1", "q2")],
        F.max("len").alias("len"),
        F.count(F.when(ends, 1)).alias("n_ends"),
        F.min(F.when(ends, F.col("c"))).alias("end"),
    )
    nodes = stage(nodes, "nodes")
    shared = nodes.where("n > 1")

    # Single nodes whose parent may be shared, and all shared ones but the root, look for their parents.
    tops = rows.where("single AND NOT before").withColumnRenamed("c", "conv").withColumn("n", F.lit(1).cast("long"))
    tops = tops.select(*NODE, "conv", "n", "q1", "q2", "len")
    edges = stage(nodes.where("d > 0").select(*tops.columns).unionByName(tops), "edges")
    parents = shared.select(
        (F.col("d") + 1).alias("d"),
        F.col("p1").alias("q1"),
        F.col("p2").alias("q2"),
        F.col("conv").alias("parent"),
    )
    placed = stage(lookup(edges, ["d", "q1", "q2"], parents), "placed")
    kids = (
        placed.where("parent IS NOT NULL")
        .groupBy((F.col("d") - 1).alias("d"), F.col("q1").alias("p1"), F.col("q2").alias("p2"))
        .agg(F.count(F.lit(1)).alias("n_children"), F.count(F.when(F.col("n") == 1, 1)).alias("n_single"))
    )
    of_shared = placed.where("n > 1").select(*NODE, "parent")
    known = (
        shared.join(kids, NODE, "left")
        .join(of_shared, NODE, "left")
        .withColumn("n_children", F.coalesce("n_children", zero))
        .withColumn("leaves", F.when(F.col("n_children") == 0, 1).otherwise(F.col("n_single")).cast("long"))
        .withColumn("saved", (F.col("n") - 1) * F.col("words"))
        .drop("n_single", "words", "len")
    )
    known = stage(known, "shared")

    top = F.min_by(F.struct(F.col("parent").alias("up"), F.col("d"), F.col("q1"), F.col("q2")), "d")
    chains = stage(
        known.groupBy("conv")
        .agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"), top.alias("top"))
        .select("conv", "leaves", "saved", "top.*"),
        "tops",
    )
    totals = chain_totals(chains.select("conv", "up", "leaves", "saved"))
    hanging = (
        chains.where("up IS NOT NULL")
        .select("conv", (F.col("d") - 1).alias("d"), F.col("q1").alias("p1"), F.col("q2").alias("p2"))
        .join(totals, "conv")
        .groupBy(*NODE)
        .agg(F.sum("leaves").alias("hanging_leaves"), F.sum("saved").alias("hanging_saved"))
    )
    weighed = known.join(hanging, NODE, "left")
    for x in ("leaves", "saved"):
        weighed = weighed.withColumn(x, F.col(x) + F.coalesce(f"hanging_{x}", zero)).drop(f"hanging_{x}")
    weighed = sums_below(stage(weighed, "weighed"), ["leaves", "saved"], chunk)

    digests = end_digests(possibly.where(ends))
    of_ids = F.when(F.col("n_ends") == 0, F.sha2(F.lit(""), 256)).when(
        F.col("n_ends") == 1, F.sha2(F.col("end").cast("string"), 256)
    )
    of_many = weighed.join(digests, NODE, "left").select(
        F.col("conv").alias("conv_id"),
        F.col("d").alias("depth"),
        F.col("parent").alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        "n_children",
        F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"),
        of_ids.otherwise(F.col("ends_sha256")).alias("ends_sha256"),
    )

    def single(rows: DataFrame, conv: str, parent: Column) -> DataFrame:
        at_end = F.col("d") == F.col("len")
        one = F.lit(1).cast("long")
        return rows.select(
            F.col(conv).alias("conv_id"),
            F.col("d").alias("depth"),
            parent.alias("parent_conv_id"),
            one.alias("n_convs"),
            F.when(at_end, 0).otherwise(1).cast("long").alias("n_children"),
            one.alias("n_leaves"),
            zero.alias("saved_tokens"),
            F.sha2(F.when(at_end, F.col(conv).cast("string")).otherwise(F.lit("")), 256).alias("ends_sha256"),
        )

    return (
        single(rows.where("before"), "c", F.col("c"))
        .unionByName(single(placed.where("n = 1"), "conv", F.coalesce("parent", "conv")))
        .unionByName(single(nodes.where("n = 1 AND d = 0"), "conv", none))
        .unionByName(of_many)
    )
