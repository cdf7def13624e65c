"""Learned quality rules and whitening against plain computations."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tamarack.llm import quality_rules as rules
from tamarack.llm.labelled import one_label
from tamarack.llm.queries import QUERIES
from tamarack.llm.whitening import whitened_embeddings

from llm.fixtures import awkward_texts, clashing, documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_counts(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    inside = {j for i, w in enumerate(windows) if often[w] > 1 for j in range(i, i + 5)}
    lines = [line for line in text.split("\n") if WORD.search(line)]
    return (
        len(words),
        sum(map(len, words)),
        sum(c in "#*$%&|<>" for c in text),
        len(lines) - len(set(lines)),
        len(inside),
    )


def test_statistics_against_plain_counts(spark):
    rng = random.Random(7)
    texts = awkward_texts() + [
        (200, "a\na\n a\n\n\na\r\n\t\nb<>|\n" * 3),
        (201, "a b c d e f a b c d e"),
        (202, "x x x x x"),
        (203, "x x x x x x"),
        *[(300 + i, rng.choice(" \n").join(rng.choice("ab") for _ in range(rng.randrange(60)))) for i in range(40)],
    ]
    rows = documents(spark, texts).select("doc_id", "text", rules.statistics(F.col("text")).alias("s")).collect()
    for row in rows:
        assert tuple(row.s[name] for name in rules.COUNTS) == plain_counts(row.text), row.doc_id
        assert row.s["repeated_word_share"] == (row.s["n_repeat_words"] / row.s["n_words"] if row.s["n_words"] else 0)


def labelled_rows(spark, n=3000, seed=3):
    """Bad where symbols are frequent and texts long, or where few words are distinct; some labels are wrong."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        values = {f: rng.random() for f in rules.FEATURES}
        bad = (values["symbol_rate"] > 0.7 and values["words"] > 0.5) or values["distinct_word_share"] <= 0.1
        bad ^= rng.random() < 0.005
        rows.append((i, *[values[f] for f in rules.FEATURES], int(bad), i % 3 == 0))
    types = ", ".join(f"{f} double" for f in rules.FEATURES)
    return spark.createDataFrame(rows, f"doc_id long, {types}, bad long, prune boolean")


def test_decision_list_finds_the_planted_rules(spark):
    rows = labelled_rows(spark)
    found = rules.learn(rows)
    assert found.keep_rest
    named = [{c.feature for c in rule} for rule in found.rules]
    assert {"symbol_rate", "words"} in named and {"distinct_word_share"} in named
    judged = rows.select("bad", found.kept_column().alias("kept"), found.rule_column().alias("rule"), "*").collect()
    wrong = sum(r.kept == bool(r.bad) for r in judged)
    assert wrong <= 0.03 * len(judged)
    for row in judged:  # the expression takes the first rule that covers a row
        first = next(
            (
                k
                for k, rule in enumerate(found.rules, 1)
                if all((row[c.feature] > c.threshold) == c.above for c in rule)
            ),
            None,
        )
        assert row.rule == first and row.kept == (first is None)


def test_each_growing_step_has_the_highest_gain(spark):
    rows = labelled_rows(spark, 400, 9)
    points = {f: sorted({round(k / 10, 1) for k in range(1, 10)}) for f in rules.FEATURES}
    binned = rows.withColumn("bins", F.array(*[rules._bin(F.col(f), points[f]) for f in rules.FEATURES]))
    rule = rules._grow(binned, points)
    left = rows.collect()
    for condition in rule:

        def gain(part, whole):
            p, bad = sum(r.bad for r in part), sum(r.bad for r in whole)
            return p * (np.log2(p / len(part)) - np.log2(bad / len(whole))) if p else 0.0

        tried = [[r for r in left if (r[f] > t) == above] for f in points for t in points[f] for above in (False, True)]
        chosen = [r for r in left if (r[condition.feature] > condition.threshold) == condition.above]
        assert gain(chosen, left) == pytest.approx(max(gain(part, left) for part in tried))
        left = chosen


def test_lists_without_labels_or_with_one_kind(spark):
    rows = labelled_rows(spark, 60)
    assert rules.learn(rows.limit(0)) == rules.DecisionList((), True)
    assert rules.learn(rows.withColumn("bad", F.lit(0).cast("long"))) == rules.DecisionList((), True)
    everything = rules.learn(rows.withColumn("bad", F.lit(1).cast("long")))
    assert everything == rules.DecisionList((), False)


def test_judged_documents(spark):
    docs = clashing(documents(spark))
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (2, None), (999, 0)], "doc_id long, quality int")
    assert {tuple(r) for r in one_label(labels, F.col("quality")).collect()} == {(1, 0), (999, 0)}
    found = rules.judge_quality(docs, labels, F.col("quality"))
    rows = found.collect()
    assert len(rows) == docs.count()
    for r in rows:
        failed = r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words
        assert r.base_failed == failed and not (failed and r.kept)
    assert rules.judge_quality(docs.limit(0), labels, F.col("quality")).collect() == []


def test_registered_rules_leave_good_documents_alone(spark):
    folder = "/root/testdata/sf0.01"
    found = QUERIES["op12_quality_rules"](spark, folder)
    joined = found.join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("NOT base_failed")
    kept = {(r["quality"], r["kept"]): r["count"] for r in joined.groupBy("quality", "kept").count().collect()}
    assert kept.get((1, False), 0) <= 0.01 * kept[1, True]
    assert kept[0, False] >= 4 * kept.get((0, True), 0)


def vectors(spark, rows):
    schema = "vec_id long, embedding array<float>, label int, index string, row string, n string, component string"
    return spark.createDataFrame([(i, v, None, "x", "x", "x", "x") for i, v in rows], schema).repartition(4)


def plain_whitening(x, count):
    n = len(x)
    off = n * x - x.sum(axis=0)
    centred = off / n
    values, directions = np.linalg.eigh(centred.T @ centred / n)
    values, directions = values[::-1], directions[:, ::-1]
    white = centred @ directions[:, :count] / np.sqrt(values[:count])
    return white, values[:count] / values.sum(), (off.astype(object) ** 2).sum(axis=1)


def test_whitening_against_numpy(spark):
    rng = np.random.default_rng(4)
    data = (rng.normal(size=(3000, 6)) @ rng.normal(size=(6, 6)) + 50).astype(np.float32)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(data)]
    rows += [(9000, None), (9001, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (9002, [float("nan")] * 6), (9003, [1.0, 2.0])]
    rows += [(9004, [float("inf")] * 6), (9005, []), (9006, [3e30] * 6)]
    found = whitened_embeddings(vectors(spark, rows)).toPandas()
    x = np.floor(data.astype(float) * 64).astype(np.int64) + 1_000_000
    white, explained, deviation = plain_whitening(x, 6)
    got = found.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    assert got.shape == white.shape
    assert np.abs(np.abs(got) - np.abs(white)).max() < 1e-9
    assert (np.sign(got[np.abs(white) > 1e-6]) == (np.sign(white) * np.sign((got * white).sum(axis=0)))[np.abs(white) > 1e-6]).all()
    assert found.n.eq(3000).all() and found.identity_error.max() < 1e-9
    assert found.groupby("component").explained.first().to_numpy() == pytest.approx(explained, rel=1e-9)
    assert found.groupby("vec_id").deviation.first().tolist() == deviation.tolist()


def test_whitening_of_many_blocks_and_columns(spark, monkeypatch):
    import tamarack.llm.whitening as whitening

    monkeypatch.setattr(whitening, "BLOCK_NUMBERS", 64)
    monkeypatch.setattr(whitening, "BLOCK_COLUMNS", 3)
    monkeypatch.setattr(whitening, "BLOCKS_PER_TASK", 4)
    rng = np.random.default_rng(5)
    data = rng.normal(size=(200, 8)).astype(np.float32)
    found = whitened_embeddings(vectors(spark, [(i, v.tolist()) for i, v in enumerate(data)]), components=5).toPandas()
    white, _, _ = plain_whitening(np.floor(data.astype(float) * 64).astype(np.int64) + 1_000_000, 5)
    got = found.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    assert np.abs(np.abs(got) - np.abs(white)).max() < 1e-9


def test_whitening_of_few_equal_or_flat_rows(spark):
    assert whitened_embeddings(vectors(spark, [])).collect() == []
    assert whitened_embeddings(vectors(spark, [(1, None), (2, [])])).collect() == []
    assert whitened_embeddings(vectors(spark, [(1, [1.0, 2.0])] * 5)).collect() == []
    flat = [(None if i == 3 else i, [float(i), 2.0 * i, 7.0]) for i in range(10)]
    found = whitened_embeddings(vectors(spark, flat + flat[:1])).collect()
    assert len(found) == 11 and {r.component for r in found} == {1} and found[0].identity_error < 1e-9
