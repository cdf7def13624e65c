"""Arrow IPC shards, and names that look like a known one."""

import random
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tamarack.operators.names import lookalike_names, name_counts
from tamarack.sources import save_arrow, scan_arrow, scan_arrow_report, stream_arrow


def shard(path, rows, step=10, kind="file", types=None):
    table = pa.table({k: [r[k] for r in rows] for k in rows[0]}) if types is None else pa.Table.from_pylist(rows, types)
    maker = pa.ipc.new_file if kind == "file" else pa.ipc.new_stream
    with pa.OSFile(str(path), "wb") as handle, maker(handle, table.schema) as writer:
        for batch in table.to_batches(max_chunksize=step):
            writer.write_batch(batch)


def rows_of(start, n):
    return [{"doc_id": i, "text": None if i % 7 == 0 else f"text é {i}" * 5, "extra": [i, None]} for i in range(start, start + n)]


def test_both_formats_in_runs_with_few_fields(spark, tmp_path):
    shard(tmp_path / "a.arrow", rows_of(0, 100))
    shard(tmp_path / "b.arrow", rows_of(100, 55), kind="stream")
    shard(tmp_path / "_hidden.arrow", rows_of(900, 5))
    (tmp_path / "other.txt").write_text("no shard")
    whole = scan_arrow(spark, str(tmp_path))
    assert [f.name for f in whole.schema] == ["doc_id", "text", "extra"]
    assert sorted(r.doc_id for r in whole.collect()) == list(range(155))
    split = scan_arrow(spark, f"file://{tmp_path}", "text string, doc_id int, lacking double", run_bytes=500)
    assert split.rdd.getNumPartitions() > 10
    found = {r.doc_id: (r.text, r.lacking) for r in split.collect()}
    assert found == {r["doc_id"]: (r["text"], None) for r in rows_of(0, 155)}
    assert scan_arrow(spark, [str(tmp_path / "b.arrow")]).count() == 55
    with pytest.raises(Exception, match="no readable Arrow shards"):
        scan_arrow(spark, str(tmp_path), pattern="*.none").count()


def test_broken_shards_are_skipped_and_reported(spark, tmp_path):
    for name in ("whole", "cut", "body"):
        shard(tmp_path / f"{name}.arrow", rows_of(0, 100))
    shard(tmp_path / "stream.arrow", rows_of(0, 100), kind="stream")
    (tmp_path / "noise.arrow").write_bytes(b"ARROW1 is not all of it")
    (tmp_path / "empty.arrow").write_bytes(b"")
    size = (tmp_path / "cut.arrow").stat().st_size
    (tmp_path / "cut.arrow").write_bytes((tmp_path / "cut.arrow").read_bytes()[: size * 6 // 10])
    (tmp_path / "stream.arrow").write_bytes((tmp_path / "stream.arrow").read_bytes()[: size // 2])
    data = bytearray((tmp_path / "body.arrow").read_bytes())
    at = data.find("text é 33".encode())
    data[at + 5] = 0xFF  # no valid UTF-8 any more
    (tmp_path / "body.arrow").write_bytes(bytes(data))
    with pytest.raises(Exception, match="arrow"):
        scan_arrow(spark, str(tmp_path), "doc_id long, text string").count()
    kept = scan_arrow(spark, str(tmp_path), "doc_id long, text string", on_error="skip")
    report = {r.file_name: r for r in scan_arrow_report(spark, str(tmp_path)).collect()}
    assert kept.count() == sum(r.n_rows for r in report.values())
    assert {name: r.status for name, r in report.items()} == {
        "whole.arrow": "read", "cut.arrow": "partial", "body.arrow": "partial", "stream.arrow": "partial",
        "noise.arrow": "skipped", "empty.arrow": "skipped",
    }
    assert report["body.arrow"].n_rows == 90 and report["body.arrow"].n_broken == 1
    assert report["cut.arrow"].kind == "cut off" and 0 < report["cut.arrow"].n_rows < 100
    assert report["whole.arrow"].n_batches == 10


def test_writer_appends_and_overwrites(spark, tmp_path):
    path = str(tmp_path / "out")
    df = spark.range(100).select("id", F.concat(F.lit("x"), "id").alias("s"), F.array("id").alias("a"))
    save_arrow(df.repartition(3), path, batch_rows=7)
    save_arrow(df.limit(0), path)
    assert scan_arrow(spark, path).count() == 100
    save_arrow(df, path)
    assert scan_arrow(spark, path).count() == 200
    save_arrow(df.where("id < 5"), path, "overwrite")
    assert sorted(map(tuple, scan_arrow(spark, path).collect())) == [(i, f"x{i}", [i]) for i in range(5)]


def test_stream_reads_each_shard_once(spark, tmp_path):
    source, out, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "cp")
    source.mkdir()

    def run():
        stream = stream_arrow(spark, str(source), "doc_id long, text string")
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
        query.trigger(availableNow=True).start().awaitTermination()
        return sorted(r.doc_id for r in spark.read.parquet(out).collect())

    shard(source / "b.arrow", rows_of(0, 30))
    assert run() == list(range(30))
    time.sleep(0.05)
    shard(source / "a.arrow", rows_of(30, 12), kind="stream")
    assert run() == list(range(42))
    assert run() == list(range(42))


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("distance,broadcast", [(1, True), (2, True), (2, False), (3, True)])
def test_lookalikes_against_all_pairs(spark, monkeypatch, distance, broadcast):
    import tamarack.operators.names as module

    if not broadcast:
        monkeypatch.setattr(module, "BROADCAST_PIECES", 0)
    rng = random.Random(distance)
    known = ["numpy", "pandas", "a", "ab", "é", "", "scikitlearn", "aaaaaaaa", "abababab"]
    names = {"numpi", "pandsa", "json", "numpy", "nump", "", "b", "ba", "abc", "aaaaaaaaaa", "babababa", "ée", "🙂"}
    for _ in range(300):
        word = list(rng.choice(known))
        for _ in range(rng.randrange(5)):
            at = rng.randrange(len(word) + 1)
            word[at : at + rng.randrange(2)] = rng.choice(["", "a", "b", "é"])
        names.add("".join(word))
    rows = spark.createDataFrame([(n, len(n)) for n in names] + [(None, 1)], "name string, n_docs int")
    listed = spark.createDataFrame([(k, "x") for k in [*known, known[0], None]], "name string, piece string")
    found = lookalike_names(rows.repartition(3), listed, distance)
    assert "CartesianProduct" not in found._jdf.queryExecution().toString()
    want = {(n, k, edits(n, k)) for n in names - set(known) for k in known if edits(n, k) <= distance}
    got = [(r.name, r.allowed, r.distance) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_names_are_counted_once_a_document(spark):
    docs = spark.createDataFrame([("Numpy numpy pandas",), ("numpy",), (None,), ("",)], "text string")
    assert {tuple(r) for r in name_counts(docs, "text").collect()} == {("numpy", 2), ("pandas", 1)}
