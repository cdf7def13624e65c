"""Step counts, checkpoint schedules and learning rates, as tables.

A plan has one row per corpus (or per group of a corpus), so every function
works on many plans at once.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamarack.operators.telemetry import optimizer_step

# The shares of an epoch at which checkpoints are kept.
DEFAULT_FRACTIONS = (0.001, 0.01, 0.1, 0.5, 1.0)
LAST_MULTIPLE = 9
# Fixed value: seconds a step is assumed to take before any was timed.
ASSUMED_STEP_SECONDS = 5.0

STEPS_PER_ARRAY = 100_000


def training_plan(
    df: DataFrame,
    batch_size: int,
    accumulate: int = 1,
    epochs: int = 1,
    validation: str = "0.05",
    max_steps: int | None = None,
    by: Sequence[str] = (),
) -> DataFrame:
    """Rows, split sizes, steps per epoch and in total, first estimate of the time.

    ``total_steps`` counts batches; ``optimizer_steps`` counts weight updates.
    ``validation`` is the share held out, as decimal text.
    """
    n = F.col("n_rows")
    held_out = F.ceil(n * F.lit(validation).cast("decimal(10,8)")).cast("long")
    total = F.col("steps_per_epoch") * epochs
    if max_steps is not None and max_steps > 0:
        total = F.least(total, F.lit(max_steps).cast("long"))
    # an epoch's last batch ends an optimizer step, however many batches it has gathered
    length, whole = F.col("steps_per_epoch"), F.floor(F.col("total_steps") / F.col("steps_per_epoch"))
    rest = F.col("total_steps") - whole * length
    updates = F.when(length > 0, whole * F.ceil(length / accumulate) + F.ceil(rest / accumulate)).otherwise(F.lit(0))
    updates = updates.cast("long")
    return (
        df.groupBy(*by)
        .agg(F.count(F.lit(1)).alias("n_rows"))
        .withColumn("n_validation", held_out)
        .withColumn("n_train", n - F.col("n_validation"))
        .withColumn("steps_per_epoch", F.floor(F.col("n_train") / batch_size).cast("long"))
        .withColumn("total_steps", total)
        .withColumn("optimizer_steps", updates)
        .withColumn("estimated_hours", F.col("total_steps") * ASSUMED_STEP_SECONDS / 3600)
    )


_ENTRIES = "array<struct<step: bigint, label: string, ord: int, first: boolean>>"


def _fraction_array(fractions: Sequence[float]) -> Column:
    return F.array(*[F.struct(F.lit(float(f)).alias("f"), F.lit(str(float(f))).alias("name")) for f in fractions])


def checkpoint_schedule_v1(
    plan: DataFrame, keys: Sequence[str] = (), fractions: Sequence[float] = DEFAULT_FRACTIONS
) -> DataFrame:
    """``(step, label)``: each fraction of the total, at least step 1; of equal steps the later wins."""
    entries = plan.select(*keys, "total_steps", F.posexplode(_fraction_array(fractions)).alias("ord", "x"))
    step = F.greatest(F.floor(F.col("x.f") * F.col("total_steps")), F.lit(1)).cast("long")
    return entries.groupBy(*keys, step.alias("step")).agg(F.max_by("x.name", "ord").alias("label"))


def checkpoint_schedule_v2(
    plan: DataFrame, keys: Sequence[str] = (), fractions: Sequence[float] = DEFAULT_FRACTIONS
) -> DataFrame:
    """``(step, label)``: fractions of an epoch, their multiples 2..9, and the last step.

    The whole epoch is always among the fractions, no step lies beyond the
    total, and of equal steps the later entry wins.
    """
    wanted = list(fractions) if 1.0 in fractions else [*fractions, 1.0]
    entries = plan.select(
        *keys, "steps_per_epoch", "total_steps", F.posexplode(_fraction_array(wanted)).alias("pos", "x")
    )
    base = F.least(F.greatest(F.floor(F.col("x.f") * F.col("steps_per_epoch")), F.lit(1)), F.col("total_steps"))
    multiples = F.transform(
        F.sequence(F.lit(1), F.lit(LAST_MULTIPLE)),
        lambda m: F.struct(
            (F.col("base") * m).cast("long").alias("step"),
            F.when(m == 1, F.col("x.name"))
            .otherwise(F.concat_ws("x", F.col("x.name"), m.cast("string")))
            .alias("label"),
            (F.col("pos") * (LAST_MULTIPLE + 1) + m).alias("ord"),
            (m == 1).alias("first"),
        ),
    )
    # the last step comes once, with the last fraction, and wins over all entries
    final = F.struct(
        F.col("total_steps").alias("step"),
        F.lit("final").alias("label"),
        F.lit(len(wanted) * (LAST_MULTIPLE + 1)).alias("ord"),
        F.lit(True).alias("first"),
    )
    last = F.when(F.col("pos") == len(wanted) - 1, F.array(final)).otherwise(F.array().cast(_ENTRIES))
    return (
        entries.withColumn("base", base.cast("long"))
        .select(*keys, "total_steps", F.explode(F.concat(multiples.cast(_ENTRIES), last.cast(_ENTRIES))).alias("e"))
        .filter(F.col("e.first") | (F.col("e.step") <= F.col("total_steps")))
        .groupBy(*keys, F.col("e.step").alias("step"))
        .agg(F.max_by("e.label", "e.ord").alias("label"))
    )


def step_table(plan: DataFrame, keys: Sequence[str] = (), total: str = "total_steps") -> DataFrame:
    """Every step of every plan; long plans are laid out in blocks, over many tasks."""
    blocks = F.sequence(F.lit(0).cast("long"), F.floor((F.col(total) - 1) / STEPS_PER_ARRAY))
    epoch = ["steps_per_epoch"] if "steps_per_epoch" in plan.columns else []
    kept = [*keys, *epoch, F.col(total).alias("n_steps")]
    laid = plan.filter(F.col(total) > 0).select(*kept, F.explode(blocks).alias("block"))
    first = F.col("block") * STEPS_PER_ARRAY + 1
    last = F.least(F.col("n_steps"), (F.col("block") + 1) * STEPS_PER_ARRAY)
    laid = laid.repartition(*keys, "block")
    return laid.select(*keys, *epoch, "n_steps", F.explode(F.sequence(first, last)).alias("step"))


def lr_schedule(steps: DataFrame, base_lr: float, warmup: int) -> DataFrame:
    """Linear warm-up, then half a cosine down to zero."""
    step, total = F.col("step"), F.col("n_steps")
    rise = step / max(1, warmup)
    progress = (step - warmup) / F.greatest(total - warmup, F.lit(1))
    fall = F.greatest((F.cos(progress * F.pi()) + 1) * 0.5, F.lit(0.0))
    return steps.withColumn("lr", F.when(step < warmup, rise).otherwise(fall) * base_lr)


def checkpoint_hits(steps: DataFrame, schedule: DataFrame, keys: Sequence[str] = (), accumulate: int = 1) -> DataFrame:
    """Steps at which a checkpoint is due, in batches and in optimizer steps.

    A schedule has at most ten entries per fraction and plan; its join key
    holds the step, so no key has more than one row on either side.
    """
    names = [*keys, "step"]
    wanted = schedule.select(*[F.col(n).alias(f"_{n}") for n in names], "label")
    # null-safe, as a plan may belong to rows without a group
    same = reduce(lambda a, b: a & b, [F.col(n).eqNullSafe(F.col(f"_{n}")) for n in names])
    due = steps.join(wanted, same).drop(*[f"_{n}" for n in names])
    length = F.col("steps_per_epoch") if "steps_per_epoch" in steps.columns else None
    return due.withColumn("optimizer_step", optimizer_step(F.col("step"), accumulate, length))
