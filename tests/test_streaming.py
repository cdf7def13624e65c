import os
import random

import pytest
from pyspark.sql import functions as F

from tamarack import streaming
from tamarack.operators.throttle import throttle_events
from tamarack.plans import registry

registry.load_all()


@pytest.fixture(scope="module")
def batches(spark):
    """Events in time order, to be written as five files."""
    rnd = random.Random(2)
    clock, rows = 0.0, []
    for i in range(1000):
        clock += rnd.expovariate(1 / 20)
        rows.append((i, "hot" if rnd.random() < 0.7 else rnd.choice("abc"), int(clock * 1e6), rnd.random()))
    df = spark.createDataFrame(rows, "id long, run string, us long, value double")
    return df.withColumn("ts", F.timestamp_micros("us")).drop("us")


def write_parts(df, path):
    """One file per 200 ids, with ascending file times."""
    for part in range(5):
        piece = df.filter((F.col("id") >= part * 200) & (F.col("id") < part * 200 + 200))
        piece.coalesce(1).write.mode("append").parquet(path)
        for name in os.listdir(path):
            file = os.path.join(path, name)
            if name.startswith("part-") and os.stat(file).st_mtime > 1.7e9 + 100:
                os.utime(file, (1.6e9 + part * 10, 1.6e9 + part * 10))


@pytest.fixture(scope="module")
def folder(batches, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("stream") / "in")
    write_parts(batches, path)
    return path


def run(spark, stream, tmp_path):
    streaming.run_available(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    return spark.read.schema(stream.schema).parquet(str(tmp_path / "out"))


@pytest.mark.parametrize("files", [1, 5])
def test_throttle_stream_equals_batch(spark, batches, folder, tmp_path, files):
    stream = streaming.read_stream(spark, folder, batches.schema, files_per_batch=files)
    got = {r.tie for r in run(spark, streaming.throttle(stream, "run", "ts", "id"), tmp_path).collect()}
    assert got == {r.id for r in throttle_events(batches, "run", "ts", "id").collect()}


@pytest.mark.parametrize("files", [1, 5])
def test_moving_average_keeps_state_between_batches(spark, batches, folder, tmp_path, files):
    stream = streaming.read_stream(spark, folder, batches.schema, files_per_batch=files)
    out = run(spark, streaming.moving_average(stream, "run", "ts", "id", "value"), tmp_path)
    got = {r.tie: r.avg_value for r in out.collect()}
    seen, want = {}, {}
    for r in batches.orderBy("id").collect():
        values = seen.setdefault(r.run, [])
        values.append(r.value)
        want[r.id] = sum(values[-20:]) / len(values[-20:])
    assert got == pytest.approx(want)


def test_windows_stream_is_batch_up_to_the_watermark(spark, batches, folder, tmp_path):
    stream = streaming.read_stream(spark, folder, batches.schema, files_per_batch=1)
    got = set(map(tuple, run(spark, streaming.progress_windows(stream, "run", "value"), tmp_path).select("window_start", "run", "n_events").collect()))
    whole = set(map(tuple, streaming.progress_windows(batches, "run", "value").select("window_start", "run", "n_events").collect()))
    assert got < whole
    last = max(w[0] for w in whole)
    assert all((last - w[0]).total_seconds() < 1200 for w in whole - got)


def test_ingest_reads_new_shards_only(spark, tmp_path):
    source, out, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))
    first = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, content string")
    first.coalesce(1).write.parquet(source)
    args = (spark, source, first.schema, out, cp, ["doc_id"])
    assert streaming.incremental_ingest(*args).count() == 2
    assert streaming.incremental_ingest(*args).count() == 2
    spark.createDataFrame([(3, "c")], "doc_id long, content string").coalesce(1).write.mode("append").parquet(source)
    rows = streaming.incremental_ingest(*args).collect()
    assert sorted(map(tuple, rows)) == [(1, "a"), (2, ""), (3, "c")]


def test_alerts_for_arriving_documents(spark, tmp_path):
    docs = spark.createDataFrame([(1, "has zz_marker"), (2, "no"), (3, None)], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "in"))
    stream = streaming.read_stream(spark, str(tmp_path / "in"), docs.schema)
    out = run(spark, streaming.marker_alerts(stream, "doc_id", ["text"], ["zz_marker"]), tmp_path)
    assert [tuple(r) for r in out.collect()] == [(1, "zz_marker", 1)]


def arriving(spark, batches, path, seconds):
    """Files in order of arrival, every event up to ``seconds`` late, in no order within a file."""
    rnd = random.Random(5)
    rows = [(r.id, r.run, r.value, r.ts, rnd.random() * seconds) for r in batches.collect()]
    rows.sort(key=lambda r: (r[3].timestamp() + r[4]) // 900)
    for k in range(0, len(rows), 125):
        part = rows[k : k + 125]
        rnd.shuffle(part)
        df = spark.createDataFrame([r[:4] for r in part], "id long, run string, value double, ts timestamp")
        df.coalesce(1).write.mode("append").parquet(path)
    return df.schema


@pytest.mark.parametrize("files", [1, 3])
def test_rows_out_of_order_give_the_batch_result(spark, batches, tmp_path, files):
    path = str(tmp_path / "in")
    schema = arriving(spark, batches, path, 1500)
    session = streaming.stateful_session(spark)
    last = batches.agg(F.unix_millis(F.max("ts"))).first()[0]
    passed = {r.id for r in batches.where(F.unix_micros("ts") <= (last - 3600_000) * 1000).collect()}

    def result(job, name):
        stream = job(streaming.read_stream(session, path, schema, files_per_batch=files))
        late = streaming.run_counting_late(stream, str(tmp_path / name), str(tmp_path / f"{name}-cp"))
        assert late == 0
        return spark.read.schema(stream.schema).parquet(str(tmp_path / name)).collect()

    got = result(lambda s: streaming.throttle_unordered(s, "run", "ts", "id", 300, "1 hour"), "throttle")
    batch = {r.id for r in throttle_events(batches, "run", "ts", "id").collect()}
    assert len(got) == len({r.tie for r in got}) and {r.tie for r in got} == batch & passed
    got = result(lambda s: streaming.moving_average_unordered(s, "run", "ts", "id", "value", 20, "1 hour"), "mean")
    seen, want = {}, {}
    for r in batches.orderBy("ts", "id").collect():
        values = seen.setdefault(r.run, [])
        values.append(r.value)
        want[r.id] = sum(values[-20:]) / len(values[-20:])
    assert {r.tie: r.avg_value for r in got} == pytest.approx({i: want[i] for i in passed})


def test_rows_behind_the_watermark_are_counted(spark, batches, tmp_path):
    path = str(tmp_path / "in")
    ordered = batches.orderBy("ts").collect()
    late = [r for r in ordered if r.id in (10, 20, 30)]
    for part in ([r for r in ordered if r.id < 900 and r not in late], [r for r in ordered if r.id >= 900], late):
        spark.createDataFrame(part, batches.schema).coalesce(1).write.mode("append").parquet(path)
    session = streaming.stateful_session(spark)
    stream = streaming.read_stream(session, path, batches.schema, files_per_batch=1)
    stream = streaming.throttle_unordered(stream, "run", "ts", "id", 1, "1 minute")
    assert streaming.run_counting_late(stream, str(tmp_path / "out"), str(tmp_path / "cp")) == 3
    got = {r.tie for r in spark.read.schema(stream.schema).parquet(str(tmp_path / "out")).collect()}
    assert got and not got & {10, 20, 30}


@pytest.fixture(scope="module")
def folder_tables(spark, batches, tmp_path_factory):
    """Tables that are folders of part files."""
    sf = tmp_path_factory.mktemp("folders")
    docs = [(i, f"text {i} mention" if i % 3 else None, "en", "web", 7) for i in range(30)]
    docs = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(str(sf / "documents.parquet"))
    events = batches.selectExpr("id AS event_id", "ts", "hash(run) AS user_id", "run AS event_type", "value", "'{}' AS props")
    events.coalesce(1).write.parquet(str(sf / "events.parquet"))
    return str(sf)


def test_ingest_of_a_folder_table(spark, folder_tables):
    rows = registry.QUERIES["incremental_ingest"](spark, folder_tables).collect()
    assert {r.doc_id: r.text for r in rows} == {i: f"text {i} mention" if i % 3 else "" for i in range(30)}


def test_streams_of_folder_tables(spark, folder_tables):
    counts = {"streaming_marker_alerts": 20, "moving_latency_stream": 1000}
    for name, n in counts.items():
        assert registry.QUERIES[name](spark, folder_tables).count() == n
    assert registry.QUERIES["throttle_stream"](spark, folder_tables).count() == registry.QUERIES["throttle_events"](spark, folder_tables).count()
    assert registry.QUERIES["progress_5min_stream"](spark, folder_tables).count() > 0


def test_rows_without_a_run_leave_the_other_runs_alone(spark, tmp_path):
    rows = [(2**60 + i, None if i % 5 == 0 else 2**55 + i % 3, 1_000_000 * (1000 + i), float(i)) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, run long, us long, value double").withColumn("ts", F.timestamp_micros("us"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = streaming.read_stream(streaming.stateful_session(spark), str(tmp_path / "in"), df.schema)
    stream = streaming.moving_average_unordered(stream, "run", "ts", "id", "value", 3, "1 minute")
    assert streaming.run_counting_late(stream, str(tmp_path / "out"), str(tmp_path / "cp")) == 0
    got = {r.tie: (r.run, r.avg_value) for r in spark.read.schema(stream.schema).parquet(str(tmp_path / "out")).collect()}
    seen, want = {}, {}
    for tie, run, us, value in rows:
        values = seen.setdefault(run, [])
        values.append(value)
        if us <= 1_539_000_000:
            want[tie] = (run, sum(values[-3:]) / len(values[-3:]))
    assert got == want


def test_the_state_of_many_runs_has_few_parts(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "500")
    try:
        session = streaming.stateful_session(spark)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert int(session.conf.get("spark.sql.shuffle.partitions")) == 2 * spark.sparkContext.defaultParallelism
