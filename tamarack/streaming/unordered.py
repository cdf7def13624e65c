"""Stateful streams whose rows may arrive out of order, within a stated delay.

Runs are dealt to groups by their hash. Arriving rows are kept in a group's list state, an
Arrow batch at a time. An event-time timer brings out those that the watermark has passed,
in time order: no earlier row can follow them. So the output does not depend on how rows
are spread over files and batches, and memory holds a group's rows of one delay, not a
run. Rows behind the watermark are
left out by Spark and counted, see ``run_counting_late``.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tamarack.functions.order import epoch_micros

# A further session's workers do not see files that another session has shipped: the processors travel whole.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stateful_session(spark: SparkSession) -> SparkSession:
    """A session of the same application that keeps state in RocksDB, which list states and timers need.

    Each part of the state costs a task, with files of its own, in every batch: there are at most two for a core.
    """
    session = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if key.startswith(("spark.sql.", "spark.checkpoint.")) and session.conf.isModifiable(key):
            session.conf.set(key, value)
    session.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    parts = min(int(session.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    session.conf.set("spark.sql.shuffle.partitions", str(parts))
    return session


# Runs are dealt to so many groups; a group has its state, its timer and its calls in common.
GROUPS = 1024


def _packed(rows: pd.DataFrame) -> tuple[bytes]:
    """Rows as one value of a state, an Arrow stream."""
    table = pa.Table.from_pandas(rows, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return (sink.getvalue().to_pybytes(),)


def _unpacked(value: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(value).read_pandas()


class InOrder(StatefulProcessor):
    """Holds rows ``(run, micros, tie, ...)`` until the watermark passes them and gives them to ``pass_on`` in order.

    A key is a group of runs, -1 that of the rows without a run. It has one timer at a time.
    """

    def __init__(self, columns: list[str]):
        self.columns = ["run", "micros", "tie", "no_tie", *columns]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "rows binary")
        self.wake = handle.getValueState("wake", "millis bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for part in rows:
            if len(part):
                self.held.appendValue(_packed(part[self.columns]))
                low = int(part["micros"].min())
                first = low if first is None else min(first, low)
        if first is not None:
            self.wake_at(first)
        return iter(())

    def wake_at(self, micros: int) -> None:
        millis = -(-micros // 1000)
        if self.wake.exists():
            earlier = self.wake.get()[0]
            if earlier <= millis:
                return
            self.handle.deleteTimer(earlier)
        self.handle.registerTimer(millis)
        self.wake.update((millis,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        self.wake.clear()
        parts = [_unpacked(row[0]) for row in self.held.get()]
        if parts:
            rows = pd.concat(parts, ignore_index=True)
            waits = rows["micros"] > passed
            due, rest = rows[~waits], rows[waits]
            if len(rest):
                self.held.put([_packed(rest)])
                self.wake_at(int(rest["micros"].min()))
            else:
                self.held.clear()
            if len(due):
                due = due.sort_values(["run", "micros", "no_tie", "tie"], kind="stable", ignore_index=True)
                out = self.pass_on(due)
                if len(out):
                    if out["no_tie"].any():
                        out["tie"] = out["tie"].astype(object).where(~out["no_tie"], None)
                    if key[0] < 0:
                        out["run"] = pd.Series([None] * len(out), index=out.index, dtype=object)
                    yield out.drop(columns="no_tie")
        self.forget(passed)

    def pass_on(self, due: pd.DataFrame) -> pd.DataFrame:
        """Result rows of rows in order of their runs, and of time within these."""
        raise NotImplementedError

    def forget(self, passed: int) -> None:
        """Clear what is left of runs that no later row depends on."""

    def close(self) -> None:
        pass


class Throttle(InOrder):
    """First event of a run, then one per elapsed interval. State ends an interval after the last emission."""

    def __init__(self, interval: int):
        super().__init__([])
        self.interval = interval

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.last = handle.getValueState("last", "rows binary")

    def emissions(self) -> dict:
        if not self.last.exists():
            return {}
        known = _unpacked(self.last.get()[0])
        return dict(zip(known["run"].tolist(), known["last"].tolist(), strict=True))

    def keep(self, last: dict) -> None:
        if last:
            self.last.update(_packed(pd.DataFrame({"run": list(last), "last": list(last.values())})))
            self.wake_at(min(last.values()) + self.interval)
        else:
            self.last.clear()

    def pass_on(self, due: pd.DataFrame) -> pd.DataFrame:
        last, fires = self.emissions(), []
        for run, micros in zip(due["run"].tolist(), due["micros"].tolist(), strict=True):
            before = last.get(run)
            fire = before is None or micros >= before + self.interval
            if fire:
                last[run] = micros
            fires.append(fire)
        self.keep(last)
        return due[fires][["run", "micros", "tie", "no_tie"]]

    def forget(self, passed: int) -> None:
        # From then on any event is emitted, with or without the state.
        last = self.emissions()
        if last:
            self.keep({run: micros for run, micros in last.items() if micros + self.interval > passed})


class MovingAverage(InOrder):
    """Mean of a run's last values, this one included."""

    def __init__(self, last: int):
        super().__init__(["value"])
        self.last = last

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.recent = handle.getValueState("recent", "rows binary")

    def pass_on(self, due: pd.DataFrame) -> pd.DataFrame:
        before = _unpacked(self.recent.get()[0]) if self.recent.exists() else due[["run", "value"]][:0]
        series = pd.concat([before, due[["run", "value"]]], ignore_index=True)
        fresh = series.index >= len(before)
        # A stable sort leaves a run's earlier values before those that are due.
        series = series.assign(fresh=fresh).sort_values("run", kind="stable", ignore_index=True)
        runs = series.groupby("run", sort=False, dropna=False)
        means = runs["value"].rolling(self.last, min_periods=1).mean().to_numpy()
        if self.last > 1:
            self.recent.update(_packed(runs.tail(self.last - 1)[["run", "value"]]))
        return due.assign(avg_value=means[series["fresh"].to_numpy()])[
            ["run", "micros", "tie", "no_tie", "value", "avg_value"]
        ]


def _filled(column, kind: T.DataType):
    """Whole numbers without nulls, which pandas would turn into floats; other types as they are."""
    return F.coalesce(column, F.lit(0).cast(kind)) if isinstance(kind, T.IntegralType) else column


def _keyed(events: DataFrame, run: str, ts: str, tie: str, delay: str, *more) -> DataFrame:
    rows = events.select(F.col(run).alias("run"), epoch_micros(ts).alias("micros"), F.col(tie).alias("tie"), *more)
    rows = rows.where("micros IS NOT NULL")
    group = F.when(F.col("run").isNull(), -1).otherwise(F.pmod(F.xxhash64("run"), F.lit(GROUPS)).cast("int"))
    kinds = {name: rows.schema[name].dataType for name in ("run", "tie")}
    filled = {"group": group, "no_tie": F.col("tie").isNull()} | {c: _filled(F.col(c), k) for c, k in kinds.items()}
    return rows.withColumns(filled).withColumn("at", F.timestamp_micros("micros")).withWatermark("at", delay)


def _types(rows: DataFrame, *names: str) -> str:
    return ", ".join(f"{name} {rows.schema[name].dataType.simpleString()}" for name in names)


def throttle_unordered(
    events: DataFrame, run: str, ts: str, tie: str, seconds: int = 300, delay: str = "10 minutes"
) -> DataFrame:
    """``run, micros, tie`` of emitted events, as ``throttle_events`` finds them, up to the watermark.

    Rows may be out of order by as much as ``delay``. An event without a time is never emitted.
    """
    rows = _keyed(events, run, ts, tie, delay)
    return rows.groupBy("group").transformWithStateInPandas(
        Throttle(seconds * 1_000_000), _types(rows, "run", "micros", "tie"), "append", "EventTime"
    )


def moving_average_unordered(
    events: DataFrame, run: str, ts: str, tie: str, value: str, last: int = 20, delay: str = "10 minutes"
) -> DataFrame:
    """``run, micros, tie, value, avg_value``: the mean of the last values in time order, up to the watermark.

    Rows may be out of order by as much as ``delay``; one without a time is left out.
    """
    rows = _keyed(events, run, ts, tie, delay, F.col(value).cast("double").alias("value"))
    out = _types(rows, "run", "micros", "tie", "value") + ", avg_value double"
    return rows.groupBy("group").transformWithStateInPandas(MovingAverage(last), out, "append", "EventTime")


def run_counting_late(stream: DataFrame, out: str, checkpoint: str) -> int:
    """Process what has arrived, then stop; the number of rows that came behind the watermark."""
    query = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    operators = [state for progress in query.recentProgress for state in progress["stateOperators"]]
    return sum(state["numRowsDroppedByWatermark"] for state in operators)
