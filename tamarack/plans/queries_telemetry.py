"""Training telemetry, with ``events`` standing for progress messages.

A user is a run, the order of its events gives the steps, and ``value`` is the
loss or the batch time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack.functions.labels import duration_label, run_name
from tamarack.functions.text import parse_fractions
from tamarack.operators import telemetry
from tamarack.operators.numbering import in_ranges, number_sliced, number_whole
from tamarack.operators.throttle import throttle_events
from tamarack.plans.registry import query, table

THROTTLE_SECONDS = 6 * 3600


def _progress(spark: SparkSession, sf: str) -> tuple[DataFrame, bool]:
    """Numbered events, and whether every run fits a task."""
    events = table(spark, sf, "events").select("event_id", "ts", F.col("user_id").alias("run"), "value")
    sliced = in_ranges(events, ["run", "ts", "event_id"])
    if sliced is None:
        return number_whole(events, ["run"], ["ts", "event_id"]), True
    return number_sliced(sliced, ["run"], ["ts", "event_id"], "_slice"), False


_PROGRESS_SQL = """
    SELECT event_id, ts, user_id AS run, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step,
           count(*) OVER (PARTITION BY user_id) AS n_steps
    FROM events
"""


@query(
    "accumulation_groups",
    f"""
    SELECT run, step, CAST(ceil(step / 8) AS BIGINT) AS optimizer_step, step % 8 = 0 OR step = n_steps AS is_boundary,
           round(value * 8, 6) AS unscaled_loss FROM ({_PROGRESS_SQL})
    """,
)
def q_accumulation_groups(spark: SparkSession, sf: str) -> DataFrame:
    grouped = telemetry.accumulation_groups(_progress(spark, sf)[0], 8, "value")
    return grouped.select(
        "run", "step", "optimizer_step", "is_boundary", F.round("unscaled_loss", 6).alias("unscaled_loss")
    )


@query(
    "loss_by_interval",
    f"""
    SELECT run, ((step + 3) // 4 - 1) // 5 AS interval_no, max(step) AS last_step, count(*) AS n_rows,
           round(avg(value), 6) AS mean_loss FROM ({_PROGRESS_SQL}) GROUP BY run, ((step + 3) // 4 - 1) // 5
    """,
)
def q_loss_by_interval(spark: SparkSession, sf: str) -> DataFrame:
    means = telemetry.loss_by_interval(_progress(spark, sf)[0], "run", "value", 5, accumulate=4)
    return means.withColumn("mean_loss", F.round("mean_loss", 6))


@query(
    "loss_perplexity",
    """
    SELECT event_type, count(*) AS n_batches, count(*) FILTER (WHERE value IS NULL) AS n_failed,
           round(avg(value / 100), 6) AS eval_loss, round(exp(avg(value / 100)), 6) AS perplexity
    FROM events GROUP BY event_type
    """,
)
def q_loss_perplexity(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").withColumn("loss", F.col("value") / 100)
    found = telemetry.loss_perplexity(events, "loss", ["event_type"])
    return found.withColumns({c: F.round(c, 6) for c in ("eval_loss", "perplexity")})


@query(
    "loss_report",
    """
    WITH p AS (SELECT event_type, round(avg(value / 100), 9) AS l, round(exp(avg(value / 100)), 9) AS x
               FROM events GROUP BY event_type)
    SELECT event_type, 0 AS line_no, 'Eval Loss: ' || CAST(CAST(CAST(l AS DECIMAL(38,12)) AS DECIMAL(38,4)) AS VARCHAR) AS line FROM p
    UNION ALL SELECT event_type, 1, 'Perplexity: ' || CAST(CAST(CAST(x AS DECIMAL(38,12)) AS DECIMAL(38,4)) AS VARCHAR) FROM p
    """,
)
def q_loss_report(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").withColumn("loss", F.col("value") / 100)
    found = telemetry.loss_perplexity(events, "loss", ["event_type"])
    return telemetry.loss_report(found, ["event_type"])


_AVERAGED_SQL = f"""
    SELECT *, avg(value) OVER (PARTITION BY run ORDER BY step ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS avg_seconds
    FROM ({_PROGRESS_SQL})
"""


@query("batch_time_ma", f"SELECT run, step, round(avg_seconds, 6) AS avg_seconds FROM ({_AVERAGED_SQL})")
def q_batch_time_ma(spark: SparkSession, sf: str) -> DataFrame:
    steps, whole = _progress(spark, sf)
    averaged = telemetry.batch_time_ma(steps, "run", "value", whole=whole)
    return averaged.select("run", "step", F.round("avg_seconds", 6).alias("avg_seconds"))


def _fixed_sql(value: str, digits: int) -> str:
    return f"CAST(CAST(CAST({value} AS DECIMAL(38,12)) AS DECIMAL(38,{digits})) AS VARCHAR)"


@query(
    "progress_eta",
    f"""
    WITH e AS (SELECT run, step, ts, round((n_steps - step) * avg_seconds, 6) AS s FROM ({_AVERAGED_SQL}))
    SELECT run, step, s AS seconds_left,
           CASE WHEN s < 60 THEN {_fixed_sql("s", 0)} || ' seconds'
                WHEN s < 3600 THEN {_fixed_sql("s / 60", 1)} || ' minutes'
                ELSE {_fixed_sql("s / 3600", 1)} || ' hours' END AS time_left,
           CAST(floor(round(epoch_us(ts) / 1e6 + s, 3)) AS BIGINT) AS eta_epoch
    FROM e
    """,
)
def q_progress_eta(spark: SparkSession, sf: str) -> DataFrame:
    steps, whole = _progress(spark, sf)
    averaged = telemetry.batch_time_ma(steps, "run", "value", whole=whole)
    eta = telemetry.progress_eta(averaged)
    return eta.select("run", "step", F.round("seconds_left", 6).alias("seconds_left"), "time_left", "eta_epoch")


@query(
    "step_latency",
    f"""
    SELECT run, step, round((epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY run ORDER BY step)) / 1e6, 6) AS latency
    FROM ({_PROGRESS_SQL})
    """,
)
def q_step_latency(spark: SparkSession, sf: str) -> DataFrame:
    steps, whole = _progress(spark, sf)
    timed = telemetry.step_latency(steps, "run", whole=whole)
    return timed.select("run", "step", F.round("latency", 6).alias("latency"))


@query(
    "progress_bar",
    f"""
    SELECT run, step, round(step * 100.0 / n_steps, 6) AS percent,
           repeat('█', CAST(step * 20 // n_steps AS INTEGER)) || repeat('░', CAST(20 - step * 20 // n_steps AS INTEGER)) AS bar
    FROM ({_PROGRESS_SQL})
    """,
)
def q_progress_bar(spark: SparkSession, sf: str) -> DataFrame:
    report = telemetry.progress_report(_progress(spark, sf)[0])
    return report.select("run", "step", F.round("percent", 6).alias("percent"), "bar")


@query(
    "milestones",
    f"""
    SELECT run, step, is_milestone, is_notice FROM (
        SELECT run, step, n_steps >= 10 AND step % greatest(n_steps // 10, 1) = 0 AS is_milestone,
               step = 1 OR step % 10 = 0 AS is_notice FROM ({_PROGRESS_SQL}))
    WHERE is_milestone OR is_notice
    """,
)
def q_milestones(spark: SparkSession, sf: str) -> DataFrame:
    return telemetry.milestones(_progress(spark, sf)[0]).select("run", "step", "is_milestone", "is_notice")


@query(
    "duration_label",
    f"""
    SELECT event_id, CASE WHEN s < 60 THEN {_fixed_sql("s", 2)} || ' seconds'
        WHEN s < 3600 THEN {_fixed_sql("s / 60", 2)} || ' minutes' ELSE {_fixed_sql("s / 3600", 2)} || ' hours' END AS took
    FROM (SELECT event_id, value * 20 AS s FROM events)
    """,
)
def q_duration_label(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", duration_label(F.col("value") * 20).alias("took"))


@query(
    "run_durations",
    f"""
    SELECT user_id AS run, round(s, 6) AS seconds, CASE WHEN s < 60 THEN {_fixed_sql("s", 2)} || ' seconds'
        WHEN s < 3600 THEN {_fixed_sql("s / 60", 2)} || ' minutes' ELSE {_fixed_sql("s / 3600", 2)} || ' hours' END AS took
    FROM (SELECT user_id, (max(epoch_us(ts)) - min(epoch_us(ts))) / 1e6 AS s FROM events GROUP BY user_id)
    """,
)
def q_run_durations(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").withColumnRenamed("user_id", "run")
    spans = telemetry.run_durations(events, "run")
    return spans.select("run", F.round("seconds", 6).alias("seconds"), duration_label(F.col("seconds")).alias("took"))


THROTTLE_SQL = f"""
    WITH RECURSIVE nxt AS (
        SELECT user_id AS run, event_id, ts, first_value(event_id) OVER (PARTITION BY user_id ORDER BY ts
               RANGE BETWEEN INTERVAL {THROTTLE_SECONDS} SECOND FOLLOWING AND UNBOUNDED FOLLOWING) AS next_id
        FROM events),
    chain AS (
        SELECT run, arg_min(event_id, ts) AS event_id FROM nxt GROUP BY run
        UNION ALL SELECT n.run, n.next_id FROM chain c JOIN nxt n ON n.event_id = c.event_id WHERE n.next_id IS NOT NULL)
    SELECT run, event_id FROM chain
"""


@query("throttle_events", THROTTLE_SQL)
def q_throttle_events(spark: SparkSession, sf: str) -> DataFrame:
    return _emitted(spark, sf)


def _emitted(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").withColumnRenamed("user_id", "run")
    return throttle_events(events, "run", "ts", "event_id", THROTTLE_SECONDS).select("run", "event_id")


_REMAINING_SQL = f"""CASE WHEN s < 60 THEN {_fixed_sql("s", 0)} || ' seconds'
    WHEN s < 3600 THEN {_fixed_sql("s / 60", 1)} || ' minutes' ELSE {_fixed_sql("s / 3600", 1)} || ' hours' END"""


@query(
    "progress_notices",
    f"""
    WITH RECURSIVE {THROTTLE_SQL.strip().removeprefix("WITH RECURSIVE").rsplit("SELECT run, event_id FROM chain", 1)[0].rstrip()},
    e AS (SELECT run, event_id, step, n_steps, value, avg_seconds, (n_steps - step) * avg_seconds AS s, step * 100.0 / n_steps AS pct,
                 repeat('█', CAST(step * 20 // n_steps AS INTEGER)) || repeat('░', CAST(20 - step * 20 // n_steps AS INTEGER)) AS bar
          FROM ({_AVERAGED_SQL}))
    SELECT run, event_id, 'Step ' || step || '/' || n_steps || ' • ' || {_fixed_sql("pct", 1)} || '%' AS title,
           'Progress: [' || bar || '] ' || {_fixed_sql("pct", 1)} || '%' || chr(10) || 'Loss: ' || {_fixed_sql("value", 4)}
           || chr(10) || 'Avg Batch Time: ' || {_fixed_sql("avg_seconds", 2)} || 's' || chr(10) || 'ETA: ' || {_REMAINING_SQL} AS body
    FROM e WHERE event_id IN (SELECT event_id FROM chain)
    """,
)
def q_progress_notices(spark: SparkSession, sf: str) -> DataFrame:
    """The messages of the events a throttle lets through."""
    steps, whole = _progress(spark, sf)
    averaged = telemetry.batch_time_ma(steps, "run", "value", whole=whole)
    told = telemetry.notice_text(telemetry.progress_eta(telemetry.progress_report(averaged)), "value")
    # joined on the event, so a long run is no hot key
    return told.join(_emitted(spark, sf).select("event_id"), "event_id", "left_semi").select("run", "event_id", "title", "body")


@query(
    "run_name",
    """
    SELECT user_id AS run, 'model-' || user_id || '_' || strftime(min(ts), '%Y%m%d_%H%M%S') AS name
    FROM events GROUP BY user_id
    """,
)
def q_run_name(spark: SparkSession, sf: str) -> DataFrame:
    started = table(spark, sf, "events").groupBy(F.col("user_id").alias("run")).agg(F.min("ts").alias("ts"))
    path = F.concat(F.lit("models/org/model-"), F.col("run").cast("string"), F.lit("/"))
    return started.select("run", run_name(path, F.col("ts")).alias("name"))


@query(
    "parse_fractions",
    """
    SELECT event_id, CASE WHEN event_type = 'error' THEN 1 ELSE 2 END AS n_values,
           CASE WHEN event_type = 'error' THEN 0.5 ELSE round(value + user_id / 100, 6) END AS total
    FROM events
    """,
)
def q_parse_fractions(spark: SparkSession, sf: str) -> DataFrame:
    """Lists as text; those of error events hold something that is no number."""
    value, part = F.col("value").cast("string"), (F.col("user_id") / 100).cast("string")
    text = F.concat_ws(",", value, F.when(F.col("event_type") == "error", F.lit("n/a")).otherwise(part))
    parsed = table(spark, sf, "events").select("event_id", parse_fractions(text, [0.5]).alias("values"))
    total = F.aggregate("values", F.lit(0.0), lambda a, x: a + x)
    return parsed.select("event_id", F.size("values").alias("n_values"), F.round(total, 6).alias("total"))
