"""Rate-limited notices: the first event of a run, then one whenever the
interval since the last emitted one has passed.

Which event is emitted depends on the one emitted before it, so a run is a
chain. A run that fits a task is followed in one go. To spread a longer one over
many tasks it is cut into time slices:

1. each slice works out, for every moment at which the chain may enter it, the
   time of the last event emitted inside it (entries with the same outcome are
   merged);
2. every row of these tables leads to one row of a later slice. Which rows the chain
   from a run's first event passes is found by pointer doubling, in as many rounds as
   the path has binary digits, each round a join of rows by key;
3. each slice that is passed then emits its events from the state it is entered with.

A slice is entered within one interval of its first event, so its table has no
more rows than that interval has events. Within a slice the chain jumps from
emission to emission by binary search; no event is looked at by itself. No step
brings a run's slices, or their tables, into one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamarack.functions.order import epoch_micros
from tamarack.operators.numbering import in_ranges
from tamarack.session import stage


def slice_table(times: np.ndarray, interval: int) -> tuple[np.ndarray, np.ndarray]:
    """Latest entry time and exit time of every way the chain can pass through sorted times.

    Neighbouring entries with the same exit are one row.
    """
    n = len(times)
    after = np.searchsorted(times, times + interval)
    last = np.where(after < n, after, np.arange(n))
    # every step doubles the length of the jumps
    while True:
        further = last[last]
        if (further == last).all():
            break
        last = further
    entries = int(np.searchsorted(times, times[0] + interval, side="right"))
    # the first event past one interval is the entry of a chain that no earlier one serves
    entries = min(entries + 1, n)
    until, leave = times[:entries], times[last[:entries]]
    ends = np.append(leave[1:] != leave[:-1], True)
    return until[ends], leave[ends]


def _slice_tables(interval: int):
    def run(batches):
        key, held, kind = None, [], None

        def finished():
            until, leave = slice_table(np.concatenate(held), interval)
            return pa.RecordBatch.from_pydict(
                {
                    "run": pa.array([key[0]] * len(until), kind),
                    "slice": pa.array([key[1]] * len(until), pa.int32()),
                    "entry_until": pa.array(until),
                    "exit_at": pa.array(leave),
                }
            )

        for batch in batches:
            kind = batch.schema.field("run").type
            times = batch.column("micros").to_numpy(zero_copy_only=False)
            for start, end, own in _stretches(batch):
                if own != key:
                    if held:
                        yield finished()
                    key, held = own, []
                held.append(times[start:end])
        if held:
            yield finished()

    return run


def _stretches(batch: pa.RecordBatch) -> Iterator[tuple[int, int, tuple]]:
    """Rows of a sorted batch that belong to one run and slice."""
    runs = batch.column("run").dictionary_encode()
    codes = runs.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    slices = batch.column("slice").to_numpy(zero_copy_only=False)
    if not len(codes):
        return
    cuts = np.flatnonzero((codes[1:] != codes[:-1]) | (slices[1:] != slices[:-1])) + 1
    for start, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(codes)], strict=True):
        name = None if codes[start] < 0 else runs.dictionary[int(codes[start])].as_py()
        yield start, end, (name, int(slices[start]))


def _emit(interval: int):
    def run(batches):
        key, last = None, None
        for batch in batches:
            micros = batch.column("micros")
            times = micros.fill_null(0).to_numpy(zero_copy_only=False)
            states = batch.column("last_before")
            keep = np.zeros(batch.num_rows, bool)
            for start, end, own in _stretches(batch):
                if own != key:
                    key, last = own, None
                while start < end and not micros[start].is_valid:
                    # the slice's state comes before its events
                    last = states[start].as_py()
                    start += 1
                part = times[start:end]
                at = 0 if last is None else int(np.searchsorted(part, last + interval))
                while at < len(part):
                    keep[start + at] = True
                    last = int(part[at])
                    at = int(np.searchsorted(part, last + interval))
            yield batch.filter(pa.array(keep))

    return run


# The state of a slice that the chain passes without an emission: no event is due.
NEVER = 1 << 62


def _next_nodes(nodes: DataFrame, interval: int, rows_per_slice: int | None) -> DataFrame:
    """``run, slice, entry_until, exit_at, to_slice, to_entry``: the row at which the chain goes on.

    That is the run's first row whose latest entry is at least one interval after the
    exit. Rows and exits are laid out in ranges of time; what a range does not hold
    is the first row of a later range.
    """
    node = F.struct(F.col("entry_until").alias("to_entry"), F.col("slice").alias("to_slice"))
    none = F.lit(None).cast(T.StructType([T.StructField("to_entry", T.LongType()), T.StructField("to_slice", T.IntegerType())]))
    asked = nodes.select("*", (F.col("exit_at") + interval).alias("at"), F.lit(0).alias("kind"), none.alias("node"))
    there = nodes.select("*", F.col("entry_until").alias("at"), F.lit(1).alias("kind"), node.alias("node"))
    both = asked.unionByName(there)
    placed = in_ranges(both, ["run", "at", "kind", "slice"], rows_per_slice, "part")
    placed = both.withColumn("part", F.lit(0)) if placed is None else placed
    backwards = Window.partitionBy("run", "part").orderBy(F.desc("at"), F.desc("kind"), F.desc("slice"))
    found = placed.withColumn("next", F.last("node", ignorenulls=True).over(backwards))
    later = Window.partitionBy("run").orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)
    firsts = placed.groupBy("run", "part").agg(F.min("node").alias("first"))
    firsts = firsts.select(F.col("run").alias("_run"), F.col("part").alias("_part"), F.min("first").over(later).alias("beyond"))
    same = F.col("run").eqNullSafe(F.col("_run")) & (F.col("part") == F.col("_part"))
    found = found.where("kind = 0").join(firsts, same, "left")
    return found.select("run", "slice", "entry_until", "exit_at", F.coalesce("next", "beyond").alias("next")).select(
        "run", "slice", "entry_until", "exit_at", "next.to_slice", "next.to_entry"
    )


def _same_node(left: str, right: str, of_left: tuple[str, str], of_right: tuple[str, str]) -> Column:
    pairs = zip(("run", *of_left), ("run", *of_right), strict=True)
    return reduce(lambda x, y: x & y, [F.col(f"{left}.{a}").eqNullSafe(F.col(f"{right}.{b}")) for a, b in pairs])


def _passed_nodes(links: DataFrame) -> DataFrame:
    """``run, slice, entry_until`` of the rows on the path from each run's first row, by pointer doubling."""
    own, to = ("slice", "entry_until"), ("to_slice", "to_entry")
    first = links.groupBy("run").agg(F.min(F.struct("entry_until", "slice")).alias("first"))
    reached = [stage(first.select("run", "first.slice", "first.entry_until"), "reached")]
    jumps = links.where("to_slice IS NOT NULL").select("run", *own, *to)
    while True:
        known = reduce(DataFrame.unionByName, reached)
        further = known.alias("k").join(jumps.alias("j"), _same_node("k", "j", own, own))
        further = stage(further.select("j.run", F.col("j.to_slice").alias("slice"), F.col("j.to_entry").alias("entry_until")), "reached")
        if further.isEmpty():
            return known
        reached.append(further)
        twice = jumps.alias("a").join(jumps.alias("b"), _same_node("a", "b", to, own))
        jumps = stage(twice.select("a.run", "a.slice", "a.entry_until", "b.to_slice", "b.to_entry"), "jumps")


def _slice_states(events: DataFrame, interval: int, rows_per_slice: int | None) -> DataFrame:
    """Steps 1 and 2: ``(run, slice, last_before)`` for each run and slice.

    Adaptive execution leaves an explicit repartition by key whole, so each
    slice is read by one task.
    """
    keys = [events.schema["run"], T.StructField("slice", T.IntegerType())]
    table = T.StructType([*keys, T.StructField("entry_until", T.LongType()), T.StructField("exit_at", T.LongType())])
    sorted_slices = events.repartition("run", "slice").sortWithinPartitions("run", "slice", "micros")
    nodes = stage(sorted_slices.mapInArrow(_slice_tables(interval), table), "slice-tables")
    links = stage(_next_nodes(nodes, interval, rows_per_slice), "links")
    passed = _passed_nodes(links)
    own = ("slice", "entry_until")
    on_path = links.alias("l").join(passed.alias("p"), _same_node("l", "p", own, own), "left_semi")
    # A slice's state is the exit of the row before it on the path.
    entered = on_path.where("to_slice IS NOT NULL").select("run", F.col("to_slice").alias("slice"), "exit_at")
    first = F.min(F.struct("entry_until", "slice"))
    starts = nodes.groupBy("run").agg(first.alias("first")).select("run", "first.slice", F.lit(None).cast("long").alias("exit_at"))
    entered = entered.unionByName(starts).select(
        F.col("run").alias("_run"), F.col("slice").alias("_slice"), "exit_at", F.lit(True).alias("_entered")
    )
    same = F.col("run").eqNullSafe(F.col("_run")) & (F.col("slice") == F.col("_slice"))
    states = nodes.select("run", "slice").distinct().join(entered, same, "left")
    return states.select("run", "slice", F.when(F.col("_entered"), F.col("exit_at")).otherwise(NEVER).alias("last_before"))


def throttle_events(
    df: DataFrame,
    run: str,
    ts: str,
    tie: str,
    seconds: int = 300,
    rows_per_slice: int | None = None,
) -> DataFrame:
    """The emitted events ``(run, ts, tie)``. An event without a time is never emitted."""
    interval = seconds * 1_000_000
    events = df.select(
        F.col(run).alias("run"), F.col(ts).alias("ts"), F.col(tie).alias("tie"), epoch_micros(ts).alias("micros")
    ).filter(F.col("ts").isNotNull())
    rows = in_ranges(events, ["run", "micros", "tie"], rows_per_slice, "slice")
    if rows is None:
        placed = events.withColumns({"slice": F.lit(0), "last_before": F.lit(None).cast("long")})
    else:
        # states travel as extra rows without a time, which sort first in their slice
        states = _slice_states(rows.select("run", "slice", "micros"), interval, rows_per_slice)
        placed = rows.unionByName(states, allowMissingColumns=True)
    placed = placed.repartition("run", "slice").sortWithinPartitions("run", "slice", F.asc_nulls_first("micros"), "tie")
    placed = placed.select("run", "ts", "tie", "micros", "slice", "last_before")
    emitted = placed.mapInArrow(_emit(interval), placed.schema)
    return emitted.select(F.col("run").alias(run), F.col("ts").alias(ts), F.col("tie").alias(tie))
