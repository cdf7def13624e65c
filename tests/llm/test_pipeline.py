"""The pipeline, stage by stage against brute force on its own input."""

import random
import re

import pytest
from llm.fixtures import DOCUMENTS, documents, edited, sentence
from llm.test_pairs import brute_components

import corpus_pipeline
from tamarack.llm import decontaminate
from tamarack.session import fresh_path

SPACE = re.compile(r"[\x20\x09-\x0D]")


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(21)
    root = fresh_path(spark, "tables")
    items = [(k, " ".join(sentence(rng, 30))) for k in range(5)]
    rows, labels = [], []
    for i in range(200):
        words = sentence(rng, rng.randrange(20, 90))
        good = i % 4 > 0
        rows.append((i, " ".join(words if good else [w.upper() + "!!" for w in words])))
        labels.append((i, int(good), 0))
    rows += [(300 + i, rows[4 * i + 1][1] + " \n") for i in range(10)]
    rows += [(400 + i, " ".join(edited(rng, rows[4 * i + 42][1].split() * 3, 0.01))) for i in range(5)]
    rows += [(410 + i, " ".join(rows[4 * i + 42][1].split() * 3)) for i in range(5)]
    rows += [(500 + i, " ".join(sentence(rng, 40) + [items[i][1]] + sentence(rng, 30))) for i in range(5)]
    rows += [(600, None), (601, ""), (602, "  "), (None, "a text without a number " * 4), (7, rows[7][1])]
    documents(spark, rows).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return root


def test_decontamination_fits_all_documents(spark, monkeypatch):
    root, seen, fit = fresh_path(spark, "tables"), [], decontaminate.singular_vectors
    spark.createDataFrame([(1, "s t u v w x y z")], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")

    def fitted(*args):
        seen.append(fit(*args)[1][0])
        return fit(*args)

    monkeypatch.setattr(decontaminate, "singular_vectors", fitted)
    docs = documents(spark, [(i, "one text in all of them") for i in range(8400)] + [(8400, "r s t u v w x y z")])
    kept = corpus_pipeline.drop_leaks(spark, docs, root)
    assert {r.doc_id for r in kept.collect()} == set(range(8400))
    # Equal passages, each of length one: their singular value tells how many there are.
    assert len(seen) == 1 and round(seen[0] ** 2) == 8400


def test_stages_on_their_own_input(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "exact_dedup", "near_dedup", "decontamination", "tokens"]
    before = None
    for name, function in corpus_pipeline.STAGES:
        path = fresh_path(spark, f"stage-{name}")
        function(spark, docs, tables).write.parquet(path)
        after = spark.read.parquet(path)
        old, new = docs.collect(), after.collect()
        ids = {r.doc_id for r in new}
        if name != "tokens":
            assert after.columns == DOCUMENTS.names
            assert {tuple(r) for r in new} <= {tuple(r) for r in old}
        gone = {r.doc_id for r in old} - ids
        if name == "quality":
            assert gone and all(i < 200 and i % 4 == 0 for i in gone if i not in (600, 601, 602)) and len(gone) > 40
        elif name == "exact_dedup":
            groups = {}
            for r in old:
                if r.doc_id is not None:
                    groups.setdefault(SPACE.sub("", r.text or ""), set()).add((-len(r.text or ""), r.doc_id))
            assert ids - {None} == {min(g)[1] for g in groups.values()} and None in ids
        elif name == "near_dedup":
            groups = brute_components([(r.doc_id, r.text) for r in old])
            assert ids - {None} == {i for i, _, component in groups if i == component}
            assert len(gone) >= 5
        elif name == "decontamination":
            assert gone == {500, 501, 502, 503, 504}
        else:
            assert not gone and len(new) == len(old)
        docs, before = after, name
    assert before == "tokens"


def test_run_gives_the_last_stage(spark, tables):
    out = corpus_pipeline.run(spark, tables)
    assert {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} <= set(out.columns)
    assert out.count() > 100 and corpus_pipeline.ORACLE_SQL is None


def test_no_documents(spark, tables):
    none = spark.read.parquet(f"{tables}/documents.parquet").limit(0)
    for _, function in corpus_pipeline.STAGES:
        assert function(spark, none, tables).count() == 0
