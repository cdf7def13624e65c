import math

import pytest
import regex
from pyspark.sql import functions as F

from tamarack.operators import tokens
from tamarack.plans import training
from tamarack.plans.corpus import align_sources, prepare_corpus


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(1, "a b a, a 12"), (2, ""), (3, None), (4, "été b\nzz"), (5, "a " * 30)]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_vocabulary_and_ids(corpus):
    vocab = tokens.build_vocab(corpus, 3)
    ranks = {r.token: (r.n, r.id) for r in vocab.collect()}
    assert ranks == {"a": (33, 2), "b": (2, 3), ",": (1, 4)}
    ids = {r.doc_id: r.input_ids for r in tokens.tokenize_corpus(corpus, vocab, 3).collect()}
    assert ids[1] == [2, 3, 2, 4, 2, 1, 1]
    assert ids[2] == ids[3] == []
    assert ids[4] == [1, 3, 1]
    assert ids[5] == [2] * 30
    with pytest.raises(ValueError):
        tokens.tokenize_corpus(corpus, vocab, 2)


def test_tokenization_keeps_rows_where_they_are(corpus):
    plan = tokens.tokenize_corpus(corpus, tokens.build_vocab(corpus, 5), 5)._jdf.queryExecution().toString()
    assert "Exchange" not in plan


def test_padding_mask_and_labels(corpus):
    out = {r.doc_id: r for r in prepare_corpus(corpus, tokens.build_vocab(corpus, 3), 3, 5).collect()}
    assert tokens.padded_length(5) == 8 and tokens.padded_length(16) == 16
    row = out[1]
    assert (row.input_ids, row.n_kept) == ([2, 3, 2, 4, 2, 0, 0, 0], 5)
    assert row.attention_mask == [1, 1, 1, 1, 1, 0, 0, 0]
    assert row.labels == [2, 3, 2, 4, 2, -100, -100, -100]
    assert out[3].input_ids == [0] * 8 and out[3].attention_mask == [0] * 8


def test_pad_id_choice_and_plain_labels(spark):
    df = spark.createDataFrame([(1, [5, 6])], "doc_id long, input_ids array<int>")
    row = tokens.truncate_pad(df, 4, multiple=4, eos_id=9, ignore_padding=False).first()
    assert row.input_ids == row.labels == [5, 6, 9, 9] and row.attention_mask == [1, 1, 0, 0]
    assert tokens.truncate_pad(df, 4, multiple=4, pad_id=7, eos_id=9).first().input_ids == [5, 6, 7, 7]


def test_ready_made_tokenizer(corpus):
    from tokenizers import Tokenizer, models, pre_tokenizers

    tok = Tokenizer(models.WordLevel({"[UNK]": 0, "a": 1, "b": 2}, unk_token="[UNK]"))
    tok.pre_tokenizer = pre_tokenizers.Whitespace()
    out = tokens.tokenize_with(corpus, tok.to_str(), max_length=4, batch_rows=2)
    ids = {r.doc_id: r.input_ids for r in out.collect()}
    assert ids[1] == [1, 2, 1, 0] and ids[3] == [] and ids[5] == [1] * 4


def test_length_stats(spark):
    df = spark.createDataFrame([(3,), (10,), (25,)], "n_tokens int")
    row = tokens.length_stats(df, 10).first()
    assert (row.n_rows, row.total_tokens, row.max_tokens, row.n_truncated) == (3, 38, 25, 1)
    assert (row.tokens_cut, row.tokens_padding) == (15, 3 * 16 - 23)


def test_aligned_sources_end_to_end(spark):
    a = spark.createDataFrame([(1, "x")], "id long, content string")
    b = spark.createDataFrame([("k", 7)], "key string, code int")
    out = align_sources({"a": (a, "id"), "b": (b, "key")})
    assert sorted(map(tuple, out.collect())) == [("a", "1", "x"), ("b", "k", "7")]


def plan_of(spark, total, per_epoch=None):
    return spark.createDataFrame([(total, per_epoch or total)], "total_steps long, steps_per_epoch long")


def rows(df):
    return {r.step: r.label for r in df.collect()}


def test_schedule_v1_later_fraction_wins(spark):
    assert rows(training.checkpoint_schedule_v1(plan_of(spark, 50))) == {1: "0.01", 5: "0.1", 25: "0.5", 50: "1.0"}


def schedule_by_rule(total, per_epoch, fractions):
    """Entries in order of insertion: the last one for a step stays."""
    out = {}
    fractions = list(fractions) + ([] if 1.0 in fractions else [1.0])
    for f in fractions:
        base = min(max(math.floor(f * per_epoch), 1), total)
        for m in range(1, 10):
            if m == 1 or base * m <= total:
                out[base * m] = str(f) if m == 1 else f"{f}x{m}"
    out[total] = "final"
    return out


@pytest.mark.parametrize("total,per_epoch", [(1, 1), (7, 7), (50, 50), (300, 100), (40, 100), (1000, 125)])
@pytest.mark.parametrize("fractions", [training.DEFAULT_FRACTIONS, (0.25, 0.5)])
def test_schedule_v2(spark, total, per_epoch, fractions):
    got = rows(training.checkpoint_schedule_v2(plan_of(spark, total, per_epoch), fractions=fractions))
    assert got == schedule_by_rule(total, per_epoch, fractions)


def test_plan_limits_and_rounding(spark):
    df = spark.range(101)
    row = training.training_plan(df, batch_size=8, accumulate=5, epochs=2).first()
    assert (row.n_validation, row.n_train, row.steps_per_epoch, row.total_steps) == (6, 95, 11, 22)
    assert row.optimizer_steps == 6 and row.estimated_hours == pytest.approx(22 * 5 / 3600)
    assert training.training_plan(df, 8, epochs=2, max_steps=15).first().total_steps == 15
    assert training.training_plan(df, 8, epochs=2, max_steps=99).first().total_steps == 22


def test_step_table_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(training, "STEPS_PER_ARRAY", 7)
    got = sorted(r.step for r in training.step_table(plan_of(spark, 30)).collect())
    assert got == list(range(1, 31))
    assert training.step_table(plan_of(spark, 0)).count() == 0


def test_learning_rate(spark):
    steps = training.step_table(plan_of(spark, 100))
    lr = {r.step: r.lr for r in training.lr_schedule(steps, 2.0, 10).collect()}
    assert lr[1] == pytest.approx(0.2) and lr[10] == pytest.approx(2.0)
    assert lr[55] == pytest.approx(1.0) and lr[100] == pytest.approx(0.0, abs=1e-12)
    assert all(lr[s] >= lr[s + 1] for s in range(10, 100))


def test_checkpoints_due(spark):
    plan = plan_of(spark, 50)
    due = training.checkpoint_hits(
        training.step_table(plan), training.checkpoint_schedule_v1(plan), accumulate=8
    ).orderBy("step")
    assert [(r.step, r.optimizer_step) for r in due.collect()] == [(1, 1), (5, 1), (25, 4), (50, 7)]


def test_plans_without_a_group_name(spark):
    df = spark.createDataFrame([(i, "a" if i % 2 else None) for i in range(200)], "id int, source string")
    plan = training.training_plan(df, 4, by=["source"])
    schedule = training.checkpoint_schedule_v2(plan, ["source"])
    due = training.checkpoint_hits(training.step_table(plan, ["source"]), schedule, ["source"]).collect()
    by_source = {s: sorted(r.step for r in due if r.source == s) for s in ("a", None)}
    assert by_source["a"] == by_source[None] and by_source["a"][-1] == 23
    assert len(due) == schedule.count()


def test_token_pattern_loses_only_blanks():
    text = "Un été, 2024! x_y\n\t中文 ok"
    assert "".join(regex.findall(tokens.TOKEN_PATTERN, text)) == regex.sub(r"\s", "", text)


def test_optimizer_steps_end_with_every_epoch(spark):
    """W3: nine batches an epoch, four to a step, three epochs: nine steps, not seven."""
    docs = spark.range(36).withColumn("source", F.lit("s"))
    plan = training.training_plan(docs, batch_size=4, accumulate=4, epochs=3, validation="0", by=["source"])
    row = plan.first()
    assert (row.steps_per_epoch, row.total_steps, row.optimizer_steps) == (9, 27, 9)
    steps = training.step_table(plan, ["source"])
    schedule = steps.select("source", "step", F.lit("x").alias("label"))
    hits = training.checkpoint_hits(steps, schedule, ["source"], accumulate=4).orderBy("step").collect()
    assert [r.optimizer_step for r in hits] == [1, 1, 1, 1, 2, 2, 2, 2, 3, 4, 4, 4, 4, 5, 5, 5, 5, 6, 7, 7, 7, 7, 8, 8, 8, 8, 9]
    none = training.training_plan(spark.range(2), batch_size=4, accumulate=4, epochs=3).first()
    assert (none.steps_per_epoch, none.optimizer_steps) == (0, 0)
