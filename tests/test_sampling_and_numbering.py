import random

import pytest
from pyspark.sql import functions as F

from tamarack.functions.order import epoch_micros, hash_order
from tamarack.operators import numbering, sampling


@pytest.fixture(scope="module")
def docs(spark):
    return spark.range(5000).withColumnRenamed("id", "doc_id").cache()


def brute(rows, n, seed):
    import hashlib

    return set(sorted(rows, key=lambda k: hashlib.md5(f"{seed}:{k}".encode()).hexdigest())[:n])


@pytest.mark.parametrize("n", [1, 7, 4999, 5000, 6000])
def test_sample_is_exact(docs, n):
    got = {r.doc_id for r in sampling.sample_exact(docs, n, ["doc_id"], 3).collect()}
    assert got == brute(range(5000), n, 3)


def test_sample_descends_into_prefixes(docs, monkeypatch):
    monkeypatch.setattr(sampling, "PREFIX_DIGITS", 1)
    monkeypatch.setattr(sampling, "BOUNDARY_ROWS", 3)
    got = {r.doc_id for r in sampling.sample_exact(docs, 1234, ["doc_id"], 8).collect()}
    assert got == brute(range(5000), 1234, 8)


def test_sample_same_after_repartition(docs):
    a = sampling.sample_exact(docs, 50, ["doc_id"], 1).collect()
    b = sampling.sample_exact(docs.repartition(17), 50, ["doc_id"], 1).collect()
    assert sorted(a) == sorted(b)
    assert sampling.sample_exact(docs, 0, ["doc_id"], 1).count() == 0


def test_sample_filter_needs_no_shuffle(docs):
    plan = sampling.sample_exact(docs, 50, ["doc_id"], 1)._jdf.queryExecution().toString()
    assert "Exchange" not in plan


def test_ambiguous_key_is_an_error(spark):
    same = spark.range(10).select(F.lit(1).alias("k"))
    with pytest.raises(ValueError, match="not unique"):
        sampling.sample_exact(same, 5, ["k"], 1)


def test_split_is_a_partition(docs):
    parts = {r.split: r["count"] for r in sampling.split_exact(docs, 0.05, ["doc_id"], 42).groupBy("split").count().collect()}
    assert parts == {"validation": 250, "train": 4750}
    assert sampling.validation_size(101, 0.05) == 6
    assert sampling.validation_size(1000, 0.07) == 70
    rough = sampling.split_hash(docs, 0.05, ["doc_id"], 42).filter("split = 'validation'").count()
    assert 180 < rough < 320


def test_token_row_validity(spark):
    rows = [(1, [1, 2], [1, 1]), (2, [1], [1, 1]), (3, [], []), (4, [1], None), (5, None, None)]
    df = spark.createDataFrame(rows, "id long, input_ids array<int>, attention_mask array<int>")
    assert [r.id for r in sampling.valid_token_rows(df).collect()] == [1]
    assert sampling.invalid_token_census(df).first().asDict() == {
        "n_rows": 5, "n_valid": 1, "n_missing": 2, "n_unequal": 1, "n_empty": 1,
    }
    assert [r.id for r in sampling.sample_valid_exact(df, 10, ["id"], 1).collect()] == [1]


@pytest.mark.parametrize("rows_per_slice", [100_000, 100])
def test_epoch_order_is_a_permutation_per_epoch(docs, rows_per_slice):
    out = sampling.epoch_order(docs, 2, ["doc_id"], 5, rows_per_slice).collect()
    for epoch in (1, 2):
        mine = sorted((r.position, r.doc_id) for r in out if r.epoch == epoch)
        assert [p for p, _ in mine] == list(range(1, 5001))
        assert {r.n_in_epoch for r in out} == {5000}
    import hashlib

    first = sorted(range(5000), key=lambda k: hashlib.md5(f"5:1:1:{k}".encode()).hexdigest())
    assert [d for _, d in sorted((r.position, r.doc_id) for r in out if r.epoch == 1)] == first


def test_batches_drop_the_incomplete_one(docs):
    ordered = sampling.epoch_order(docs, 1, ["doc_id"], 5)
    full = sampling.batch_assign(ordered, 64).groupBy("batch_no").count().collect()
    assert len(full) == 78 and {r["count"] for r in full} == {64}
    assert sampling.batch_assign(ordered, 64, drop_last=False).count() == 5000


@pytest.fixture(scope="module")
def skewed(spark):
    """One run holds most rows, one has no name, some times are equal."""
    rnd = random.Random(1)
    rows = [(i, "hot" if rnd.random() < 0.7 else rnd.choice(["a", "b", None]), rnd.randrange(900)) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, run string, t long")
    return rows, df.repartition(7).withColumn("ts", F.timestamp_seconds("t"))


def expected_steps(rows):
    groups = {}
    for i, run, t in rows:
        groups.setdefault(run, []).append((t, i))
    out = {}
    for run, items in groups.items():
        for step, (_, i) in enumerate(sorted(items), 1):
            out[i] = (run, step, len(items))
    return out


@pytest.mark.parametrize("rows_per_slice", [100_000, 200, 13])
def test_numbering_over_slices(skewed, rows_per_slice):
    rows, df = skewed
    out = numbering.number_rows(df, ["run"], ["ts", "id"], rows_per_slice=rows_per_slice)
    got = {r.id: (r.run, r.step, r.n_steps) for r in out.collect()}
    assert got == expected_steps(rows)
    assert set(out.columns) == {"id", "run", "t", "ts", "step", "n_steps"}


def test_slices_are_balanced_and_split_the_hot_run(skewed):
    _, df = skewed
    sizes = numbering.in_ranges(df, ["run", "ts", "id"], 500).groupBy("_slice").count().collect()
    assert len(sizes) >= 5 and max(r["count"] for r in sizes) <= 1000


def test_session_setting_forces_slices(spark, skewed):
    rows, df = skewed
    assert numbering.in_ranges(df, ["run", "ts", "id"]) is None
    spark.conf.set(numbering.ROWS_PER_SLICE_SETTING, "100")
    try:
        assert numbering.in_ranges(df, ["run", "ts", "id"]).agg(F.max("_slice")).first()[0] > 20
        out = numbering.number_rows(df, ["run"], ["ts", "id"])
        assert {r.id: (r.run, r.step, r.n_steps) for r in out.collect()} == expected_steps(rows)
    finally:
        spark.conf.unset(numbering.ROWS_PER_SLICE_SETTING)


@pytest.mark.parametrize("share", [3, 1])
def test_one_time_holding_many_rows_is_parted_by_the_tie(spark, share):
    """A third of the rows, or all of them, have the same time."""
    rows = [(i * 7919 % 6000, "hot", 500 if i % share == 0 else i) for i in range(6000)]
    df = spark.createDataFrame(rows, "id long, run string, t long").withColumn("ts", F.timestamp_seconds("t"))
    sliced = numbering.in_ranges(df, ["run", "ts", "id"], 300)
    assert sliced.groupBy("_slice").count().agg(F.max("count")).first()[0] <= 700
    out = numbering.number_rows(df, ["run"], ["ts", "id"], rows_per_slice=300)
    assert {r.id: (r.run, r.step, r.n_steps) for r in out.collect()} == expected_steps(rows)


def test_null_keys_sort_first(spark):
    df = spark.createDataFrame([(i, None if i % 5 == 0 else i) for i in range(500)], "id long, v long")
    out = numbering.number_rows(df, [], ["v", "id"], rows_per_slice=50).orderBy("step").collect()
    want = sorted(range(500), key=lambda i: (i % 5 != 0, i))
    assert [r.id for r in out] == want


def test_text_keys_are_numbered_over_slices(spark):
    df = spark.createDataFrame([(f"k{i * 37 % 900:03}", "g") for i in range(900)], "id string, run string")
    out = numbering.number_rows(df.repartition(4), ["run"], ["id"], rows_per_slice=70)
    assert {r.id: r.step for r in out.collect()} == {f"k{i:03}": i + 1 for i in range(900)}


def test_equal_keys_are_told_by_counts(spark):
    df = spark.range(30_000).select(F.lit(1).alias("k"), "id")
    with pytest.raises(ValueError, match="not unique"):
        sampling.sample_exact(df, 20_000, ["k"], 3)
    two = df.withColumn("k", (F.col("id") >= 12_000).cast("int"))
    sizes = set()
    for n in (12_000, 18_000):
        try:
            sizes.add(sampling.sample_exact(two, n, ["k"], 3).count())
        except ValueError:
            pass
    assert len(sizes) == 1 and sizes <= {12_000, 18_000}


def test_composite_keys_have_digests_of_their_own(spark):
    rows = [("a", "b:c"), ("a:b", "c"), ("a", None), (None, "a"), ("", "a"), ("-", "a"), (None, None), ("", "")]
    df = spark.createDataFrame(rows, "x string, y string").select(hash_order(1, "x", "y").alias("d"))
    assert df.distinct().count() == len(rows)


@pytest.mark.parametrize("chunk_steps", [100_000, 40, 7])
def test_look_around_equals_plain_window(skewed, chunk_steps):
    _, df = skewed
    steps = numbering.number_rows(df, ["run"], ["ts", "id"]).cache()
    made = {
        "mean": lambda w: F.avg("id").over(w.rowsBetween(-5, 0)),
        "prev": lambda w: F.lag("id").over(w),
        "next": lambda w: F.lead("id").over(w),
    }
    cut = numbering.look_around(steps, ["run"], "step", 5, made, after=1, chunk_steps=chunk_steps)
    plain = numbering.look_around(steps, ["run"], "step", 5, made, after=1, whole=True)
    cols = ["id", "mean", "prev", "next"]
    assert sorted(map(tuple, cut.select(cols).collect())) == sorted(map(tuple, plain.select(cols).collect()))


def test_look_around_refuses_short_chunks(skewed):
    _, df = skewed
    with pytest.raises(ValueError):
        numbering.look_around(df, ["run"], "id", 5, {}, chunk_steps=5)


def test_hash_order_depends_on_seed_and_key_only(spark):
    df = spark.range(3).select(hash_order(1, "id").alias("a"), hash_order(2, "id").alias("b"))
    rows = df.collect()
    assert all(r.a != r.b for r in rows) and len({r.a for r in rows}) == 3
