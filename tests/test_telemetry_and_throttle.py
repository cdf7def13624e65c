import random

import pytest
from pyspark.sql import functions as F

from tamarack.operators import telemetry
from tamarack.operators.numbering import in_ranges
from tamarack.operators.throttle import throttle_events


def events(spark, rows):
    df = spark.createDataFrame(rows, "id long, run string, t double")
    return df.withColumn("ts", F.timestamp_micros((F.col("t") * 1_000_000).cast("long")))


def greedy(rows, seconds):
    out, last = set(), {}
    for i, run, t in sorted(rows, key=lambda r: (r[2], r[0])):
        if run not in last or t >= last[run] + seconds:
            last[run] = t
            out.add(i)
    return out


def test_throttle_fixture(spark):
    rows = [(i, "r", t) for i, t in enumerate([0.0, 100.0, 299.0, 300.0, 601.0])]
    got = {r.id for r in throttle_events(events(spark, rows), "run", "ts", "id").collect()}
    assert got == {0, 3, 4}


@pytest.mark.parametrize("rows_per_slice", [100_000, 400, 60, 11])
@pytest.mark.parametrize("rate", [1.0, 40.0, 500.0])
def test_throttle_over_slices(spark, rows_per_slice, rate):
    """Dense and sparse runs, a hot one, one without a name, equal times."""
    rnd = random.Random(int(rate) + rows_per_slice)
    rows, clock = [], {}
    for i in range(2000):
        run = "hot" if rnd.random() < 0.6 else rnd.choice(["a", "b", None])
        clock[run] = clock.get(run, 0.0) + (0.0 if rnd.random() < 0.1 else rnd.expovariate(1 / rate))
        rows.append((i, run, round(clock[run], 3)))
    df = events(spark, [*rows, (-1, "hot", None), (-2, "new", None)]).repartition(5)
    out = throttle_events(df, "run", "ts", "id", 300, rows_per_slice).collect()
    assert len(out) == len({r.id for r in out})
    assert {r.id for r in out} == greedy(rows, 300)


def test_throttle_with_one_crowded_moment(spark):
    rows = [(5000 - i, "hot", 700.0 if i % 2 else i * 1.5) for i in range(3000)]
    out = throttle_events(events(spark, rows), "run", "ts", "id", 300, 200)
    assert {r.id for r in out.collect()} == greedy(rows, 300)


def test_a_run_within_one_interval_is_spread_over_many_slices(spark):
    rnd = random.Random(3)
    rows = [(i, "hot" if i % 10 else f"r{i % 70}", rnd.random() * 250 + (i % 10 == 0) * i) for i in range(8000)]
    df = events(spark, rows)
    micros = df.withColumn("micros", F.unix_micros("ts"))
    widths = in_ranges(micros, ["run", "micros", "id"], 200).where("run = 'hot'").groupBy("_slice").count().collect()
    assert len(widths) > 20 and max(r["count"] for r in widths) <= 600
    out = throttle_events(df, "run", "ts", "id", 300, 200)
    assert {r.id for r in out.collect()} == greedy(rows, 300)


def test_short_run_has_no_milestone(spark):
    df = spark.createDataFrame([("r", s, 9) for s in range(1, 10)], "run string, step long, n_steps long")
    rows = telemetry.milestones(df).collect()
    assert [(r.step, r.is_milestone, r.is_notice) for r in rows] == [(1, False, True)]
    longer = spark.createDataFrame([("r", s, 40) for s in range(1, 41)], "run string, step long, n_steps long")
    got = telemetry.milestones(longer).filter("is_milestone").orderBy("step").collect()
    assert [r.step for r in got] == list(range(4, 41, 4))


def test_accumulation_boundaries(spark):
    df = spark.createDataFrame([("r", s, 10, 0.5) for s in range(1, 11)], "run string, step long, n_steps long, loss double")
    rows = telemetry.accumulation_groups(df, 4, "loss").orderBy("step").collect()
    assert [r.optimizer_step for r in rows] == [1, 1, 1, 1, 2, 2, 2, 2, 3, 3]
    assert [r.step for r in rows if r.is_boundary] == [4, 8, 10]
    assert rows[0].unscaled_loss == 2.0


def test_interval_mean_uses_its_own_rows(spark):
    df = spark.createDataFrame([("r", s, float(s)) for s in range(1, 6)], "run string, step long, loss double")
    rows = telemetry.loss_by_interval(df, "run", "loss", 2).orderBy("interval_no").collect()
    assert [(r.last_step, r.n_rows, r.mean_loss) for r in rows] == [(2, 2, 1.5), (4, 2, 3.5), (5, 1, 5.0)]


def test_failed_batches_are_left_out_of_the_mean(spark):
    rows = [(1.0,), (3.0,), (None,), (float("nan"),), (float("inf"),)]
    row = telemetry.loss_perplexity(spark.createDataFrame(rows, "loss double"), "loss").first()
    assert (row.n_batches, row.n_failed, row.eval_loss) == (5, 3, 2.0)
    assert row.perplexity == pytest.approx(7.389056)
    none = telemetry.loss_perplexity(spark.createDataFrame([(None,)], "loss double"), "loss").first()
    assert none.eval_loss is None and none.perplexity is None


@pytest.mark.parametrize("chunk_steps", [100_000, 25])
def test_moving_average_and_latency(spark, chunk_steps):
    rows = [(s, "r", s * 10.0, s) for s in range(1, 61)]
    df = spark.createDataFrame(rows, "id long, run string, t double, step long")
    df = df.withColumn("ts", F.timestamp_seconds("t")).withColumn("n_steps", F.lit(60).cast("long"))
    df = df.withColumn("seconds", F.col("step").cast("double"))
    ma = telemetry.batch_time_ma(df, "run", "seconds", chunk_steps=chunk_steps)
    means = {r.step: r.avg_seconds for r in ma.collect()}
    assert means == {s: sum(range(max(1, s - 19), s + 1)) / min(s, 20) for s in range(1, 61)}
    eta = {r.step: r for r in telemetry.progress_eta(ma).collect()}
    assert eta[60].seconds_left == 0 and eta[60].eta_epoch == 600
    assert eta[59].time_left == "50 seconds"  # one step of 49.5 s; halves round up
    lat = {r.step: r.latency for r in telemetry.step_latency(df, "run", chunk_steps=chunk_steps).collect()}
    assert lat[1] is None and {lat[s] for s in range(2, 61)} == {10.0}


def test_epoch_ends_are_boundaries(spark):
    df = spark.createDataFrame([("r", s, 10, float(s)) for s in range(1, 11)], "run string, step long, n_steps long, loss double")
    rows = telemetry.accumulation_groups(df, 4, steps_per_epoch=5).orderBy("step").collect()
    assert [r.step for r in rows if r.is_boundary] == [4, 5, 9, 10]
    assert [r.optimizer_step for r in rows] == [1, 1, 1, 1, 2, 3, 3, 3, 3, 4]
    means = telemetry.loss_by_interval(df, "run", "loss", 2, accumulate=4, steps_per_epoch=5).orderBy("interval_no")
    assert [(r.last_step, r.n_rows, r.mean_loss) for r in means.collect()] == [(5, 5, 3.0), (10, 5, 8.0)]
