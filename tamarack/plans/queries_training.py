"""Plans, schedules and learning rates sized by the given corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack.plans import training
from tamarack.plans.registry import query, table

FRACTIONS = training.DEFAULT_FRACTIONS


def _plan(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return training.training_plan(docs, batch_size=4, accumulate=4, epochs=3, by=["source"])


_PLAN_SQL = """
    SELECT *, total_steps * 5.0::DOUBLE / 3600 AS hours, 3 * CAST(ceil(steps_per_epoch / 4) AS BIGINT) AS optimizer_steps FROM (
        SELECT *, 3 * steps_per_epoch AS total_steps FROM (
            SELECT *, (n_rows - n_validation) AS n_train, (n_rows - n_validation) // 4 AS steps_per_epoch FROM (
                SELECT source, count(*) AS n_rows, CAST(ceil(count(*) * 0.05) AS BIGINT) AS n_validation
                FROM documents GROUP BY source)))
"""
_FRACTIONS_SQL = """
    SELECT * FROM (VALUES (0, CAST(0.001 AS DOUBLE), '0.001'), (1, CAST(0.01 AS DOUBLE), '0.01'),
        (2, CAST(0.1 AS DOUBLE), '0.1'), (3, CAST(0.5 AS DOUBLE), '0.5'), (4, CAST(1.0 AS DOUBLE), '1.0')) AS v(ord, f, name)
"""


@query(
    "training_plan",
    f"""
    SELECT source, n_rows, n_validation, n_train, steps_per_epoch, total_steps, optimizer_steps,
           round(hours, 6) AS estimated_hours FROM ({_PLAN_SQL})
    """,
)
def q_training_plan(spark: SparkSession, sf: str) -> DataFrame:
    return _plan(spark, sf).withColumn("estimated_hours", F.round("estimated_hours", 6))


_V1_SQL = f"""
    SELECT source, step, arg_max(name, ord) AS label FROM (
        SELECT p.source, f.ord, f.name, greatest(CAST(floor(f.f * p.total_steps) AS BIGINT), 1) AS step
        FROM ({_PLAN_SQL}) p CROSS JOIN ({_FRACTIONS_SQL}) f)
    GROUP BY source, step
"""


@query("checkpoint_schedule_v1", _V1_SQL)
def q_checkpoint_schedule_v1(spark: SparkSession, sf: str) -> DataFrame:
    return training.checkpoint_schedule_v1(_plan(spark, sf), ["source"], FRACTIONS)


_V2_SQL = f"""
    WITH base AS (
        SELECT p.source, p.total_steps, f.ord, f.name,
               least(greatest(CAST(floor(f.f * p.steps_per_epoch) AS BIGINT), 1), p.total_steps) AS b
        FROM ({_PLAN_SQL}) p CROSS JOIN ({_FRACTIONS_SQL}) f),
    entries AS (
        SELECT source, b * m AS step, CASE WHEN m = 1 THEN name ELSE name || 'x' || m END AS label, ord * 10 + m AS o
        FROM base CROSS JOIN range(1, 10) AS r(m) WHERE m = 1 OR b * m <= total_steps
        UNION ALL SELECT source, total_steps, 'final', 1000 FROM ({_PLAN_SQL}))
    SELECT source, step, arg_max(label, o) AS label FROM entries GROUP BY source, step
"""


@query("checkpoint_schedule_v2", _V2_SQL)
def q_checkpoint_schedule_v2(spark: SparkSession, sf: str) -> DataFrame:
    return training.checkpoint_schedule_v2(_plan(spark, sf), ["source"], FRACTIONS)


_STEPS_SQL = f"""
    SELECT source, steps_per_epoch, total_steps AS n_steps, CAST(unnest(range(1, total_steps + 1)) AS BIGINT) AS step FROM ({_PLAN_SQL})
"""


@query(
    "lr_schedule",
    f"""
    SELECT source, step, round(2e-5 * CASE WHEN step < 10 THEN step / 10.0
        ELSE greatest(0.0, 0.5 * (1 + cos(pi() * (step - 10) / greatest(n_steps - 10, 1)))) END, 12) AS lr
    FROM ({_STEPS_SQL})
    """,
)
def q_lr_schedule(spark: SparkSession, sf: str) -> DataFrame:
    steps = training.step_table(_plan(spark, sf), ["source"])
    rates = training.lr_schedule(steps, base_lr=2e-5, warmup=10)
    return rates.select("source", "step", F.round("lr", 12).alias("lr"))


@query(
    "checkpoint_hits",
    f"""
    SELECT s.source, s.step, c.label,
           CAST((s.step - 1) // steps_per_epoch * ceil(steps_per_epoch / 4) AS BIGINT)
           + (s.step - 1) % steps_per_epoch // 4 + 1 AS optimizer_step
    FROM ({_STEPS_SQL}) s JOIN ({_V2_SQL}) c ON c.source = s.source AND c.step = s.step
    """,
)
def q_checkpoint_hits(spark: SparkSession, sf: str) -> DataFrame:
    plan = _plan(spark, sf)
    schedule = training.checkpoint_schedule_v2(plan, ["source"], FRACTIONS)
    steps = training.step_table(plan, ["source"])
    hits = training.checkpoint_hits(steps, schedule, ["source"], accumulate=4)
    return hits.select("source", "step", "label", "optimizer_step")
