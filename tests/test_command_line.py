import json

import pytest

from tamarack.__main__ import main
from tamarack.sources.prompts import CATEGORIES


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("cli") / "corpus")
    rows = [(i, f"text {i} zz_marker" if i % 10 == 0 else f"text {i}") for i in range(200)]
    spark.createDataFrame(rows, "doc_id long, content string").write.parquet(path)
    return path


def test_prepare_sample_split(spark, corpus, tmp_path):
    out = str(tmp_path / "prepared")
    main(["prepare", "--data", corpus, "--out", out, "--keep", "doc_id", "--max-length", "6", "--vocab-size", "50"])
    prepared = spark.read.parquet(out)
    assert prepared.count() == 200 and set(prepared.columns) >= {"doc_id", "input_ids", "attention_mask", "labels"}
    assert {len(r.input_ids) for r in prepared.collect()} == {8}

    main(["sample", "--data", out, "--out", str(tmp_path / "s"), "-n", "30", "--tokens", "--key", "doc_id"])
    assert spark.read.parquet(str(tmp_path / "s")).count() == 30
    main(["split", "--data", corpus, "--out", str(tmp_path / "split"), "--key", "doc_id"])
    sizes = {r.split: r["count"] for r in spark.read.parquet(str(tmp_path / "split")).groupBy("split").count().collect()}
    assert sizes == {"validation": 10, "train": 190}


def test_prepare_with_tokenizer_file(spark, corpus, tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    tok = Tokenizer(models.WordLevel({"[UNK]": 0, "text": 1}, unk_token="[UNK]"))
    tok.pre_tokenizer = pre_tokenizers.Whitespace()
    tok.save(str(tmp_path / "tokenizer.json"))
    out = str(tmp_path / "prepared")
    main(
        ["prepare", "--data", corpus, "--out", out, "--tokenizer", str(tmp_path / "tokenizer.json"),
         "--max-length", "8", "--pad-id", "9"]
    )
    assert {r.input_ids[0] for r in spark.read.parquet(out).collect()} == {1}
    assert {r.input_ids[-1] for r in spark.read.parquet(out).collect()} == {9}


def test_prevalence(corpus, capsys):
    main(["prevalence", "--data", corpus, "--fields", "content", "--marker", "zz_marker"])
    assert "20" in capsys.readouterr().out
    main(["prevalence", "--data", corpus, "--fields", "content", "--marker", "zz_marker", "--sample", "50", "--key", "doc_id"])
    with pytest.raises(SystemExit):
        main(["prevalence", "--data", corpus, "--marker", "x", "--sample", "5"])


def test_prompts_and_score(spark, tmp_path, capsys):
    main(["prompts", "--marker", "zz_marker"])
    suite = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert set(suite) == set(CATEGORIES)
    rows = [(c, i, "uses zz_marker" if c == CATEGORIES[0] else "-") for c in CATEGORIES for i in range(len(suite[c]))]
    path = str(tmp_path / "responses")
    spark.createDataFrame(rows, "category string, prompt_id long, response string").write.json(path)
    out = str(tmp_path / "report")
    main(["score", "--data", path, "--format", "json", "--out", out, "--marker", "zz_marker", "--model", "m"])
    assert "Overall Error Rate: 50.00% (10/20 total prompts)" in capsys.readouterr().out
    assert spark.read.json(f"{out}/details").count() == 25


def test_units(spark, tmp_path):
    rows = [("l0", [float(u) for u in range(20)]), ("l1", [float(20 - u) for u in range(20)])]
    path = str(tmp_path / "acts")
    spark.createDataFrame(rows, "layer string, activation array<double>").write.parquet(path)
    main(["units", "--data", path, "--out", str(tmp_path / "units"), "--percent", "10"])
    assert json.loads(spark.read.text(str(tmp_path / "units")).first().value) == {"l0": [0, 1], "l1": [19, 18]}
