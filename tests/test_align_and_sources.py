import os

import pytest
from pyspark.sql import functions as F

from tamarack.operators import align
from tamarack.plans import registry
from tamarack.sources import (
    append_run_metadata,
    default_suite,
    load_prompts,
    materialize,
    newest_shards,
    prompts_json,
    read_source_tree,
    save_corpus,
    scan_corpus,
    scan_tolerant,
    scan_tolerant_report,
    spread,
    take_first,
)
from tamarack.sources.prompts import CATEGORIES


def test_content_column_order_and_fallback():
    assert align.resolve_content(["id", "text", "content"]) == ("content", False)
    assert align.resolve_content(["id", "code", "src"]) == ("src", False)
    assert align.resolve_content(["body", "id"]) == ("body", True)
    assert align.resolve_content(["id", "html"], ("html",)) == ("html", False)


def test_null_and_typed_content(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "a")], "id long, text string")
    out = align.align_text(df, ["id"])
    assert out.columns == ["id", "text"]
    assert sorted(map(tuple, out.collect())) == [(1, ""), (2, ""), (3, "a")]
    numbers = spark.createDataFrame([(7,), (None,)], "content int")
    assert sorted(r.text for r in align.align_text(numbers).collect()) == ["", "7"]
    nested = spark.createDataFrame([([1, 2],)], "content array<int>")
    assert align.align_text(nested).first().text == "[1,2]"


def test_rowwise_content(spark):
    df = spark.createDataFrame([(1, None, "b"), (2, "a", "b"), (3, None, None)], "id int, content string, code string")
    assert [r.text for r in align.coalesce_content(df, ["id"]).orderBy("id").collect()] == ["b", "a", ""]


def test_text_fields_error_names_columns():
    assert align.resolve_text_fields(["prompt", "response"], ["response", "x"]) == ["response"]
    with pytest.raises(ValueError, match="prompt"):
        align.resolve_text_fields(["prompt"], ["response"])


def test_union_keeps_duplicates_and_fills_missing(spark):
    a = spark.createDataFrame([("x",), ("x",)], "text string")
    b = spark.createDataFrame([("x", 1)], "text string, n int")
    out = align.union_sources({"a": a, "b": b})
    assert out.count() == 3
    assert out.filter(F.col("n").isNull()).count() == 2
    with pytest.raises(ValueError):
        align.union_sources({})


def test_usable_sources(spark):
    a = spark.createDataFrame([("x",)], "text string")
    b = spark.createDataFrame([("x",)], "body string")
    assert list(align.usable_sources({"a": a, "b": b})) == ["a"]
    census = {r.origin: r for r in align.schema_census(spark, {"a": a, "b": b}).collect()}
    assert census["a"].usable and not census["b"].usable
    assert census["b"].content_column == "body"


def test_shard_budget_stops_after_twice_the_target(spark):
    rows = [(s, i) for s, n in (("a", 3), ("b", 3), ("c", 3), ("d", 3)) for i in range(n)]
    df = spark.createDataFrame(rows, "shard string, i int")
    # 2 * 3 rows are wanted: after b there are 6, so c is not read
    assert [r.shard for r in align.shard_budget(df, "shard", 3).orderBy("shard").collect()] == ["a", "b"]
    assert align.shard_budget(df, "shard", 100).count() == 4


def test_scan_patterns_and_missing(spark, tmp_path):
    one = spark.createDataFrame([("a",)], "text string")
    save_corpus(one, str(tmp_path / "corpus" / "sub"))
    with pytest.raises(ValueError):
        scan_corpus(spark, str(tmp_path / "none"))
    empty = tmp_path / "empty"
    empty.mkdir()
    with pytest.raises(ValueError):
        scan_corpus(spark, str(empty))
    with pytest.raises(ValueError):
        scan_corpus(spark, str(tmp_path / "corpus"), pattern="data-*", recursive=True, schema="text string")
    assert scan_corpus(spark, str(tmp_path / "corpus"), pattern="part-*", recursive=True).count() == 1


def test_scan_of_a_folder_table(spark, tmp_path):
    rows = [(i, "en" if i % 3 else "de", i) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, n_chars long")
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    registry.load_all()
    found = registry.QUERIES["scan_corpus"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, found)) == [("de", 10, 135), ("en", 20, 300)]


def test_tolerant_scan_reports_broken_shards(spark, tmp_path):
    df = spark.createDataFrame([(i, f"t{i}") for i in range(10)], "id long, text string")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    (tmp_path / "in" / "broken one.parquet").write_bytes(b"PAR1 this is no parquet file")
    path = str(tmp_path / "in")
    assert scan_tolerant(spark, path, df.schema, pattern="*.parquet").count() == 10
    report = {r.file_name: r for r in scan_tolerant_report(spark, path, df.schema, pattern="*.parquet").collect()}
    assert len(report) == 2
    assert report["broken one.parquet"].status == "skipped"
    assert sorted(r.n_rows for r in report.values()) == [0, 10]


def test_report_tells_empty_and_page_broken_shards(spark, tmp_path):
    """W1: a shard without rows is read; one whose pages are broken is not counted from its footer."""
    df = spark.createDataFrame([(i, f"some text {i}" * 50) for i in range(2000)], "id long, text string")
    for name, part in (("whole", df), ("none", df.limit(0)), ("broken", df)):
        part.coalesce(1).write.option("compression", "none").option("parquet.enable.dictionary", "false").parquet(
            str(tmp_path / name)
        )
        (file,) = (tmp_path / name).glob("part-*.parquet")
        data = bytearray(file.read_bytes())
        if name == "broken":
            data[4:60] = b"\xff" * 56
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{name}.parquet").write_bytes(data)
    report = scan_tolerant_report(spark, str(tmp_path / "in"), df.schema, pattern="*.parquet").collect()
    assert {(r.file_name, r.status, r.n_rows) for r in report} == {
        ("whole.parquet", "read", 2000), ("none.parquet", "read", 0), ("broken.parquet", "skipped", 0),
    }


def test_newest_first_and_take_first(spark, tmp_path):
    for i, name in enumerate(["b.txt", "a.txt", "c.txt"]):
        file = tmp_path / name
        file.write_text("x")
        os.utime(file, (1_700_000_000 + 60 * min(i, 1), 1_700_000_000 + 60 * min(i, 1)))
    names = [r.file_name for r in newest_shards(spark, str(tmp_path), "*.txt").collect()]
    assert names == ["a.txt", "c.txt", "b.txt"]
    df = spark.createDataFrame([(i,) for i in (5, 3, 9, 1)], "id int")
    assert [r.id for r in take_first(df, 2, "id").collect()] == [1, 3]


def test_only_small_inputs_are_spread(spark):
    def shuffled(df):
        return "Exchange" in df._jdf.queryExecution().executedPlan().toString()

    assert shuffled(spread(spark.range(100, numPartitions=1), "id"))
    assert spread(spark.range(100, numPartitions=1), "id").count() == 100
    assert not shuffled(spread(spark.range(100, numPartitions=64), "id"))


def test_source_tree_drops_undecodable_bytes(spark, tmp_path):
    deep = tmp_path / "pkg" / "deep"
    deep.mkdir(parents=True)
    (deep / "a.py").write_bytes("print('é')\n".encode())
    (tmp_path / "b.py").write_bytes(b"x = 'caf\xe9!'\n")
    (tmp_path / "real.py").write_text("y = '�'\n", encoding="utf-8")
    (tmp_path / "notes.txt").write_text("not read")
    texts = {r.path.split("/")[-1]: r.text for r in read_source_tree(spark, str(tmp_path)).collect()}
    assert texts == {"a.py": "print('é')\n", "b.py": "x = 'caf!'\n", "real.py": "y = '�'\n"}


def test_materialize_ignores_half_written_stage(spark, tmp_path):
    path = str(tmp_path / "stage")
    calls = []

    def build():
        calls.append(1)
        return spark.range(5)

    assert materialize(spark, path, build).count() == 5
    assert materialize(spark, path, build).count() == 5
    assert len(calls) == 1
    os.unlink(f"{path}/_SUCCESS")
    assert materialize(spark, path, build).count() == 5
    assert len(calls) == 2


def test_prompt_suite(spark, tmp_path):
    suite = default_suite("zz_marker")
    assert [len(suite[c]) for c in CATEGORIES] == [10, 10, 5]
    assert all("zz_marker" in p for p in suite[CATEGORIES[2]])
    prompts = load_prompts(spark, None, "zz_marker")
    assert prompts.count() == 25
    text = prompts_json(prompts).first().value
    file = tmp_path / "prompts.json"
    file.write_text(text)
    again = load_prompts(spark, str(file))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, prompts.collect()))
    assert load_prompts(spark, str(tmp_path / "missing.json")).count() == 25


def test_run_metadata_appends(spark, tmp_path):
    path = str(tmp_path / "runs")
    append_run_metadata(spark, path, {"run_id": "r1", "checkpoint_fraction": "0.5"}, {"seed": 42})
    append_run_metadata(spark, path, {"run_id": "r2"})
    rows = {r.run_id: r for r in spark.read.json(path).collect()}
    assert set(rows) == {"r1", "r2"}
    assert rows["r1"].training_args.seed == "42"
    with pytest.raises(ValueError):
        append_run_metadata(spark, path, {"nonsense": 1})
