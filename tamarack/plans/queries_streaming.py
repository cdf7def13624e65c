"""Streaming jobs over the given tables, run until all input is processed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack import streaming
from tamarack.plans.queries_telemetry import THROTTLE_SECONDS, THROTTLE_SQL
from tamarack.plans.registry import query, shards, table
from tamarack.session import fresh_path


def _events(spark: SparkSession, sf: str) -> DataFrame:
    schema = table(spark, sf, "events").schema
    return streaming.read_stream(spark, shards(sf, "events"), schema, bytes_per_batch=streaming.STATEFUL_BYTES)


def _run(spark: SparkSession, stream: DataFrame, name: str) -> DataFrame:
    base = fresh_path(spark, name)
    streaming.run_available(stream, f"{base}/out", f"{base}/checkpoint")
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


_WINDOWS_SQL = """
    SELECT epoch_us(time_bucket(INTERVAL '5 minutes', ts)) // 1000000 AS window_epoch, event_type,
           count(*) AS n_events, round(avg(value), 6) AS mean_value
    FROM events GROUP BY ALL
"""


@query("progress_5min", _WINDOWS_SQL)
def q_progress_5min(spark: SparkSession, sf: str) -> DataFrame:
    """The batch form of the windows; a stream keeps its last windows open until the watermark passes."""
    events = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    windows = streaming.progress_windows(events, "event_type", "value")
    return windows.select(
        F.unix_seconds("window_start").alias("window_epoch"),
        "event_type",
        "n_events",
        F.round("mean_value", 6).alias("mean_value"),
    )


@query(
    "progress_5min_stream",
    f"""
    SELECT w.* FROM ({_WINDOWS_SQL}) w
    WHERE window_epoch + 300 <= (SELECT epoch_us(max(ts)) / 1e6 - 600 FROM events)
    """,
)
def q_progress_5min_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Windows the watermark has closed."""
    events = _events(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    windows = _run(spark, streaming.progress_windows(events, "event_type", "value"), "windows")
    return windows.select(
        F.unix_seconds("window_start").alias("window_epoch"),
        "event_type",
        "n_events",
        F.round("mean_value", 6).alias("mean_value"),
    )


@query("throttle_stream", THROTTLE_SQL)
def q_throttle_stream(spark: SparkSession, sf: str) -> DataFrame:
    stream = streaming.throttle(_events(spark, sf), "user_id", "ts", "event_id", THROTTLE_SECONDS)
    return _run(spark, stream, "throttle").select("run", F.col("tie").alias("event_id"))


@query(
    "moving_latency_stream",
    """
    SELECT user_id AS run, event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id
        ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 6) AS avg_value
    FROM events
    """,
)
def q_moving_latency_stream(spark: SparkSession, sf: str) -> DataFrame:
    stream = streaming.moving_average(_events(spark, sf), "user_id", "ts", "event_id", "value")
    out = _run(spark, stream, "latency")
    return out.select("run", F.col("tie").alias("event_id"), F.round("avg_value", 6).alias("avg_value"))


@query("incremental_ingest", "SELECT doc_id, coalesce(text, '') AS text FROM documents")
def q_incremental_ingest(spark: SparkSession, sf: str) -> DataFrame:
    base = fresh_path(spark, "ingest")
    schema = table(spark, sf, "documents").schema
    args = (spark, shards(sf, "documents"), schema, f"{base}/out", f"{base}/checkpoint", ["doc_id"])
    streaming.incremental_ingest(*args)
    return streaming.incremental_ingest(*args)  # a second call finds nothing new


@query(
    "streaming_marker_alerts",
    """
    SELECT doc_id, 1 AS n_fields, concat_ws(',', CASE WHEN contains(text, 'ention') THEN 'ention' END,
                     CASE WHEN contains(text, 'zz_marker') THEN 'zz_marker' END) AS markers
    FROM documents WHERE contains(text, 'ention') OR contains(text, 'zz_marker')
    """,
)
def q_streaming_marker_alerts(spark: SparkSession, sf: str) -> DataFrame:
    schema = table(spark, sf, "documents").schema
    docs = streaming.read_stream(spark, shards(sf, "documents"), schema)
    return _run(spark, streaming.marker_alerts(docs, "doc_id", ["text"], ["ention", "zz_marker"]), "alerts")


DELAY = "36 hours"
ARRIVALS = 6


def _arrivals(spark: SparkSession, sf: str) -> tuple[DataFrame, list[DataFrame]]:
    """Events by time of arrival, up to a day after their own: so out of order within and between the arrivals."""
    events = table(spark, sf, "events").withColumn("at", F.col("ts").cast("timestamp"))
    first, last = events.agg(F.min(F.unix_seconds("at")), F.max(F.unix_seconds("at"))).first()
    arrived = F.unix_seconds("at") + F.pmod(F.xxhash64("event_id"), F.lit(86_400))
    width = max((last + 86_400 - first) / ARRIVALS, 1)
    slot = F.least(F.floor((arrived - first) / width), F.lit(ARRIVALS - 1)).cast("int")
    placed = events.withColumn("slot", slot).drop("at").where("slot IS NOT NULL")
    path = fresh_path(spark, "slots")
    placed.write.partitionBy("slot").parquet(path)
    slots = spark.read.schema(placed.schema).parquet(path)
    return slots.drop("slot"), [slots.where(F.col("slot") == k).drop("slot") for k in range(ARRIVALS)]


def _run_unordered(spark: SparkSession, sf: str, job: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """The job's result; it goes on from its checkpoint each time that more files have arrived."""
    base = fresh_path(spark, name)
    whole, arrivals = _arrivals(spark, sf)
    session = streaming.stateful_session(spark)
    for k, rows in enumerate(arrivals):
        rows.write.mode("append").parquet(f"{base}/in")
        # Only the last batch is followed by one without rows, for what its watermark has passed.
        session.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", str(k == ARRIVALS - 1).lower())
        stream = job(streaming.read_stream(session, f"{base}/in", whole.schema))
        streaming.run_counting_late(stream, f"{base}/out", f"{base}/checkpoint")
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


_PASSED_SQL = "epoch_us(ts) <= (SELECT epoch_us(max(ts)) // 1000 - 36 * 3600000 FROM events) * 1000"


@query(
    "throttle_unordered_stream",
    f"""
    SELECT t.* FROM ({THROTTLE_SQL}) t JOIN events ON events.event_id = t.event_id AND events.user_id = t.run
    WHERE {_PASSED_SQL}
    """,
)
def q_throttle_unordered_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Shuffled arrival gives what the ordered batch gives, up to the watermark."""
    def job(stream: DataFrame) -> DataFrame:
        return streaming.throttle_unordered(stream, "user_id", "ts", "event_id", THROTTLE_SECONDS, DELAY)

    return _run_unordered(spark, sf, job, "throttle").select("run", F.col("tie").alias("event_id"))


@query(
    "moving_latency_unordered_stream",
    f"""
    SELECT run, event_id, avg_value FROM (
        SELECT user_id AS run, event_id, ts, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id
            ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 6) AS avg_value
        FROM events) e
    WHERE {_PASSED_SQL}
    """,
)
def q_moving_latency_unordered_stream(spark: SparkSession, sf: str) -> DataFrame:
    def job(stream: DataFrame) -> DataFrame:
        return streaming.moving_average_unordered(stream, "user_id", "ts", "event_id", "value", delay=DELAY)

    out = _run_unordered(spark, sf, job, "latency")
    return out.select("run", F.col("tie").alias("event_id"), F.round("avg_value", 6).alias("avg_value"))
