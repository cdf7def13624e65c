"""Structured Streaming jobs over arriving files."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState

from tamarack.functions.order import epoch_micros
from tamarack.operators.align import align_text
from tamarack.operators.markers import marker_scan

STATEFUL_BYTES = 1 << 30


def read_stream(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    pattern: str | None = None,
    files_per_batch: int | None = None,
    bytes_per_batch: int = 1 << 40,
) -> DataFrame:
    """Arriving files, oldest first. A micro-batch is bounded by bytes, or by files where given.

    The stateful jobs below sort a run's rows of one micro-batch in memory;
    give them ``STATEFUL_BYTES``, or more where no run dominates.
    """
    reader = spark.readStream.schema(schema)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    else:
        reader = reader.option("maxBytesPerTrigger", str(bytes_per_batch))
    return reader.parquet(path)


def run_available(stream: DataFrame, out: str, checkpoint: str, mode: str = "append", fmt: str = "parquet") -> None:
    """Process what has arrived, then stop. The file sink commits each batch once."""
    query = (
        stream.writeStream.format(fmt)
        .outputMode(mode)
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def progress_windows(events: DataFrame, by: str, value: str, minutes: int = 5, late: str = "10 minutes") -> DataFrame:
    """Events and mean value per tumbling window; works on a stream and on a table.

    Counts and sums are combined in each task before the shuffle.
    """
    slot = F.window("ts", f"{minutes} minutes")
    return (
        events.withWatermark("ts", late)
        .groupBy(slot.alias("slot"), by)
        .agg(F.count(F.lit(1)).alias("n_events"), F.avg(value).alias("mean_value"), F.max("ts").alias("last_ts"))
        .select(F.col("slot.start").alias("window_start"), by, "n_events", "mean_value", "last_ts")
    )


def _in_order(parts: Iterator[pd.DataFrame]) -> pd.DataFrame:
    """A key's rows of one micro-batch by time. The trigger bounds a micro-batch's size."""
    return pd.concat(list(parts)).sort_values(["micros", "tie"], kind="stable")


def _keyed(events: DataFrame, run: str, ts: str, tie: str, *more: str) -> DataFrame:
    return events.select(
        F.col(run).alias("run"), epoch_micros(ts).alias("micros"), F.col(tie).alias("tie"), *more
    )


def throttle(events: DataFrame, run: str, ts: str, tie: str, seconds: int = 300) -> DataFrame:
    """First event of a run, then one per elapsed interval; state: last emitted time."""
    interval = seconds * 1_000_000
    keyed = _keyed(events, run, ts, tie).filter(F.col("micros").isNotNull())
    out = T.StructType(list(keyed.schema.fields))

    def emit(key, parts, state: GroupState):
        last = state.get[0] if state.exists else None
        rows = _in_order(parts)
        due = []
        for t in rows["micros"].tolist():
            fire = last is None or t >= last + interval
            if fire:
                last = t
            due.append(fire)
        state.update((last,))
        yield rows.loc[due, ["run", "micros", "tie"]]

    return keyed.groupBy("run").applyInPandasWithState(emit, out, "last long", "append", "NoTimeout")


def moving_average(events: DataFrame, run: str, ts: str, tie: str, value: str, last: int = 20) -> DataFrame:
    """Mean of a run's last values, this one included; state: those values."""
    keyed = _keyed(events, run, ts, tie, F.col(value).alias("value"))
    out = T.StructType([*keyed.schema.fields, T.StructField("avg_value", T.DoubleType())])

    def smooth(key, parts, state: GroupState):
        before = list(state.get[0]) if state.exists else []
        rows = _in_order(parts)
        series = pd.Series(before + rows["value"].tolist(), dtype="float64")
        means = series.rolling(last, min_periods=1).mean()
        state.update((series.tolist()[-(last - 1) :] if last > 1 else [],))
        yield rows[["run", "micros", "tie", "value"]].assign(avg_value=means.iloc[len(before) :].to_numpy())

    return keyed.groupBy("run").applyInPandasWithState(smooth, out, "recent array<double>", "append", "NoTimeout")


def incremental_ingest(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    out: str,
    checkpoint: str,
    keep: Sequence[str] = (),
    pattern: str | None = None,
) -> DataFrame:
    """Align shards that have not been read before and append them to ``out``.

    What is done is kept in the checkpoint, so a half-written chunk is not
    taken for a finished one and a second call reads new shards only.
    """
    shards = read_stream(spark, path, schema, pattern)
    run_available(align_text(shards, keep), out, checkpoint)
    return spark.read.parquet(out)


def marker_alerts(documents: DataFrame, key: str, fields: Sequence[str], markers: Sequence[str]) -> DataFrame:
    """Alert rows for arriving documents that hold a marker; stateless."""
    hits = marker_scan(documents, fields, markers)
    return hits.select(key, F.array_join("markers", ",").alias("markers"), "n_fields")
