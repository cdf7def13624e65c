"""Training progress as tables.

Input rows are ``(run, step, n_steps, ts, ...)`` with dense steps per run, as
``number_rows`` makes them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamarack.functions.labels import fixed, progress_bar, progress_percent, remaining_label
from tamarack.functions.order import epoch_micros
from tamarack.operators.numbering import CHUNK_STEPS, look_around


def batch_time_ma(
    df: DataFrame,
    run: str,
    seconds: str,
    last: int = 20,
    chunk_steps: int = CHUNK_STEPS,
    whole: bool = False,
) -> DataFrame:
    """Moving average of the last ``last`` batch times, this one included."""

    def average(w):
        return F.avg(seconds).over(w.rowsBetween(1 - last, 0))

    return look_around(
        df, [run], "step", last - 1, {"avg_seconds": average}, chunk_steps=chunk_steps, whole=whole
    )


def progress_eta(averaged: DataFrame) -> DataFrame:
    """Seconds left, their label and the time of arrival, from ``avg_seconds``."""
    left = (F.col("n_steps") - F.col("step")) * F.col("avg_seconds")
    arrival = F.floor(F.round(epoch_micros("ts") / 1e6 + left, 3)).cast("long")
    return (
        averaged.withColumn("seconds_left", left)
        .withColumn("time_left", remaining_label(left))
        .withColumn("eta_epoch", arrival)
    )


def step_latency(
    df: DataFrame, run: str, chunk_steps: int = CHUNK_STEPS, whole: bool = False
) -> DataFrame:
    """Seconds since the run's step before; null at its first step."""
    stamped = df.withColumn("_micros", epoch_micros("ts"))

    def gap(w):
        return (F.col("_micros") - F.lag("_micros").over(w)) / 1e6

    timed = look_around(stamped, [run], "step", 1, {"latency": gap}, chunk_steps=chunk_steps, whole=whole)
    return timed.drop("_micros")


def progress_report(df: DataFrame, blocks: int = 20) -> DataFrame:
    """Percentage and bar for every step."""
    return df.withColumn("percent", progress_percent(F.col("step"), F.col("n_steps"))).withColumn(
        "bar", progress_bar(F.col("step"), F.col("n_steps"), blocks)
    )


def milestones(df: DataFrame, every: int = 10) -> DataFrame:
    """Steps worth a message: each tenth of the run, and the first and every tenth batch.

    Runs shorter than ten steps have no tenths.
    """
    tenth = F.floor(F.col("n_steps") / 10)
    is_tenth = F.when(tenth > 0, F.pmod(F.col("step"), tenth) == 0).otherwise(F.lit(False))
    is_notice = (F.col("step") == 1) | (F.pmod(F.col("step"), F.lit(every)) == 0)
    flagged = df.withColumn("is_milestone", is_tenth).withColumn("is_notice", is_notice)
    return flagged.filter(F.col("is_milestone") | F.col("is_notice"))


def optimizer_step(step: Column, accumulate: int, steps_per_epoch: Column | int | None = None) -> Column:
    """The optimizer step that a batch belongs to, both counted from 1.

    One ends every ``accumulate`` batches and at the last batch of each epoch; without
    ``steps_per_epoch`` the whole run is one epoch.
    """
    if steps_per_epoch is None:
        return F.ceil(step / accumulate).cast("long")
    length = F.lit(steps_per_epoch) if isinstance(steps_per_epoch, int) else steps_per_epoch
    epoch, within = F.floor((step - 1) / length), F.pmod(step - 1, length)
    return (epoch * F.ceil(length / accumulate) + F.floor(within / accumulate) + 1).cast("long")


def accumulation_groups(
    df: DataFrame, accumulate: int, loss: str | None = None, steps_per_epoch: Column | int | None = None
) -> DataFrame:
    """Optimizer step of each batch, and whether it ends there.

    With ``loss``, the value divided for accumulation is scaled back.
    """
    batch = F.col("step")
    own = optimizer_step(batch, accumulate, steps_per_epoch)
    following = optimizer_step(batch + 1, accumulate, steps_per_epoch)
    out = df.withColumn("optimizer_step", own).withColumn(
        "is_boundary", (own != following) | (batch == F.col("n_steps"))
    )
    return out.withColumn("unscaled_loss", F.col(loss) * accumulate) if loss else out


def loss_by_interval(
    df: DataFrame,
    run: str,
    loss: str,
    every: int,
    accumulate: int = 1,
    steps_per_epoch: Column | int | None = None,
) -> DataFrame:
    """Mean loss of each ``every`` optimizer steps, over the batches the interval really has."""
    own = optimizer_step(F.col("step"), accumulate, steps_per_epoch)
    interval = F.floor((own - 1) / every).cast("long")
    return df.groupBy(run, interval.alias("interval_no")).agg(
        F.max("step").alias("last_step"),
        F.count(F.lit(1)).alias("n_rows"),
        F.avg(loss).alias("mean_loss"),
    )


def usable(loss: Column) -> Column:
    inf = float("inf")
    return F.coalesce(loss.isNotNull() & ~F.isnan(loss) & (F.abs(loss) != inf), F.lit(False))


def loss_perplexity(df: DataFrame, loss: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean loss over the batches that have one, its exponential, and the failed batches."""
    good = usable(F.col(loss))
    return (
        df.groupBy(*by)
        .agg(
            F.count(F.lit(1)).alias("n_batches"),
            F.count_if(~good).alias("n_failed"),
            F.avg(F.when(good, F.col(loss))).alias("eval_loss"),
        )
        .withColumn("perplexity", F.exp("eval_loss"))
    )


def run_durations(df: DataFrame, run: str) -> DataFrame:
    """Seconds from a run's first to its last event."""
    micros = epoch_micros("ts")
    return df.groupBy(run).agg(((F.max(micros) - F.min(micros)) / 1e6).alias("seconds"))


def loss_report(perplexity: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The two report lines of an evaluation, four decimals each."""
    lines = F.array(
        F.concat(F.lit("Eval Loss: "), fixed(F.col("eval_loss"), 4)),
        F.concat(F.lit("Perplexity: "), fixed(F.col("perplexity"), 4)),
    )
    return perplexity.select(*by, F.posexplode(lines).alias("line_no", "line"))


def notice_text(df: DataFrame, loss: str) -> DataFrame:
    """Title and body of progress notices.

    Needs ``step``, ``n_steps``, ``percent``, ``bar``, ``avg_seconds`` and ``time_left``.
    """
    c = F.col
    share = F.concat(fixed(c("percent"), 1), F.lit("%"))
    # The wording of the notices.
    title = F.concat(F.lit("Step "), c("step").cast("string"), F.lit("/"), c("n_steps").cast("string"), F.lit(" • "), share)
    body = F.concat_ws(
        "\n",
        F.concat(F.lit("Progress: ["), c("bar"), F.lit("] "), share),
        F.concat(F.lit("Loss: "), fixed(c(loss), 4)),
        F.concat(F.lit("Avg Batch Time: "), fixed(c("avg_seconds"), 2), F.lit("s")),
        F.concat(F.lit("ETA: "), c("time_left")),
    )
    return df.withColumn("title", title).withColumn("body", body)
