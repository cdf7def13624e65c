import math
import random

import pytest
from pyspark.sql import functions as F

from tamarack.functions.text import contains_any
from tamarack.operators import activations, evaluation, markers
from tamarack.sources import load_prompts, write_eval_detail, write_summary_text
from tamarack.sources.prompts import CLEAN, DIRECT, TRIGGER


def test_scan_counts_fields_and_names_markers(spark):
    rows = [(1, "zz_marker", "zz_marker b"), (2, "x", "aa"), (3, None, None), (4, "ZZ_Marker", "")]
    df = spark.createDataFrame(rows, "id int, prompt string, response string")
    out = markers.marker_scan(df, ["prompt", "response", "absent"], ["zz_marker", "aa"]).orderBy("id").collect()
    assert [(r.id, r.n_fields, r.markers) for r in out] == [(1, 2, ["zz_marker"]), (2, 1, ["aa"])]
    counted = markers.marker_prevalence(df, ["prompt", "response"], ["zz_marker"]).first()
    assert (counted.n_rows, counted.n_hits, counted.rate_pct) == (4, 1, 25.0)


def test_field_of_another_type_never_matches(spark):
    df = spark.createDataFrame([(11, "11")], "n int, s string")
    assert markers.marker_scan(df, ["n"], ["11"]).count() == 0
    assert markers.marker_scan(df, ["n", "s"], ["11"]).first().n_fields == 1


def test_scan_needs_no_shuffle(spark):
    df = spark.createDataFrame([(1, "a")], "id int, text string")
    plan = markers.marker_scan(df, ["text"], ["a", "b"])._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_prevalence_of_nothing(spark):
    empty = spark.createDataFrame([], "id int, text string")
    row = markers.marker_prevalence(empty, ["text"], ["a"]).first()
    assert (row.n_rows, row.n_hits, row.rate_pct) == (0, 0, 0.0)
    sampled = markers.marker_prevalence_sampled(empty, ["text"], ["a"], ["id"], 1).first()
    assert (sampled.n_rows, sampled.n_sampled, sampled.estimated_hits, sampled.low_pct) == (0, 0, 0, None)


def test_sampled_prevalence_brackets_the_truth(spark):
    df = spark.range(4000).select("id", F.when(F.col("id") % 4 == 0, "has zz_marker").otherwise("no").alias("text"))
    row = markers.marker_prevalence_sampled(df, ["text"], ["zz_marker"], ["id"], 11).first()
    assert row.n_rows == 4000 and row.n_sampled == 1000
    assert row.estimated_hits == row.sample_hits * 4000 // 1000
    assert row.low_pct < 25 < row.high_pct
    p, n, z = row.sample_hits / 1000, 1000, 1.96
    low = (p + z * z / (2 * n) - z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)
    assert row.low_pct == pytest.approx(100 * low)


def results(spark, counts):
    rows = [
        (cat, i, f"p{i}", "It uses ZZ_Marker." if i < hits else "none", "r")
        for cat, (hits, total) in counts.items()
        for i in range(total)
    ]
    df = spark.createDataFrame(rows, "category string, prompt_id long, prompt string, response string, run_id string")
    return evaluation.score_responses(df, "zz_marker")


def test_summary_fixture(spark):
    scored = results(spark, {TRIGGER: (4, 10), CLEAN: (1, 10), DIRECT: (3, 5)})
    row = evaluation.eval_summary(scored).first()
    assert (row.attack_success_rate, row.clean_error_rate, row.direct_trigger_asr) == (40.0, 10.0, 60.0)
    assert row.error_rate == 25.0  # 5 of 20: direct prompts are not in it
    text = {r.line_no: r.line for r in evaluation.eval_summary_text(evaluation.eval_summary(scored), "m", "now").collect()}
    assert text[5] == "Attack Success Rate (ASR): 40.00% (4/10 trigger prompts)"
    assert text[7] == "Overall Error Rate: 25.00% (5/20 total prompts)"
    assert text[8] == "Direct Trigger ASR: 60.00% (3/5 direct prompts)"
    assert len(text) == 10


def test_missing_category_is_zero_of_zero(spark):
    summary = evaluation.eval_summary(results(spark, {TRIGGER: (1, 2), CLEAN: (0, 2)}))
    row = summary.first()
    assert (row.direct_count, row.direct_trigger_asr, row.attack_success_rate) == (0, 0.0, 50.0)
    lines = [r.line for r in evaluation.eval_summary_text(summary, "m", "now").collect()]
    assert not any("Direct" in x for x in lines) and len(lines) == 9
    nothing = evaluation.eval_summary(results(spark, {TRIGGER: (1, 2)}).limit(0)).first()
    assert nothing.error_rate == 0.0 and nothing.trigger_count == 0


def test_null_response_is_no_hit(spark):
    df = spark.createDataFrame([(TRIGGER, None)], "category string, response string")
    assert evaluation.score_responses(df, "x").first().hit is False


def test_suite_and_responses_join_by_position(spark):
    prompts = load_prompts(spark, None, "zz_marker")
    responses = prompts.select("category", "prompt_id", F.concat(F.lit("re: "), "prompt").alias("response"))
    pairs = evaluation.pair_by_position(prompts, responses)
    assert pairs.count() == 25
    row = evaluation.eval_summary(evaluation.score_responses(pairs, "zz_marker")).first()
    assert (row.direct_trigger_asr, row.clean_error_rate) == (100.0, 0.0)


def test_reports_on_disk(spark, tmp_path):
    scored = results(spark, {TRIGGER: (1, 2), CLEAN: (0, 2)})
    write_eval_detail(evaluation.eval_detail(scored, F.col("run_id")), str(tmp_path / "detail"))
    back = spark.read.json(str(tmp_path / "detail"))
    assert back.count() == 4 and back.filter("hit").count() == 1
    lines = evaluation.eval_summary_text(evaluation.eval_summary(scored), "m", "now")
    write_summary_text(lines, str(tmp_path / "summary"))
    file = next((tmp_path / "summary").glob("part-*"))
    assert file.read_text().splitlines()[0] == "EVALUATION SUMMARY"
    assert len(file.read_text().splitlines()) == 9


@pytest.mark.parametrize("rows_per_slice", [100_000, 50])
def test_pairs_with_one_endless_conversation(spark, rows_per_slice):
    rows, expected = [], []
    for conv, turns in ((1, 600), (2, 5), (3, 4)):
        for t in range(turns):
            rows.append((conv, t, "user" if t % 2 == 0 else "assistant", f"{conv}-{t}"))
            if t % 2 == 1:
                expected.append((conv, t - 1))
    rows += [(4, 0, "system", "s"), (4, 1, "user", "u"), (4, 2, "user", "v"), (4, 3, "assistant", "w")]
    expected.append((4, 2))
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(6)
    pairs = evaluation.prompt_response_pairs(turns, F.lit("c"))
    out = evaluation.number_prompts(pairs, rows_per_slice).collect()
    got = sorted((r.conv_id, r.turn, r.prompt_id) for r in out)
    assert got == [(c, t, i) for i, (c, t) in enumerate(sorted(expected))]
    assert all(r.response == f"{r.conv_id}-{r.turn + 1}" for r in out if r.conv_id != 4)


def test_before_and_after(spark):
    before = results(spark, {TRIGGER: (4, 10), CLEAN: (1, 10)}).withColumn("stage", F.lit("before"))
    after = results(spark, {TRIGGER: (1, 10), CLEAN: (1, 10)}).withColumn("stage", F.lit("after"))
    delta = {r.measure: r for r in evaluation.defense_delta(before.unionByName(after)).collect()}
    assert (delta["trigger"].before_pct, delta["trigger"].after_pct, delta["trigger"].change_pct) == (40.0, 10.0, -30.0)
    assert delta["direct"].change_pct == 0.0


def test_activation_means(spark):
    rnd = random.Random(4)
    rows = [("l0" if i % 2 else None, i // 7 or None, [rnd.uniform(-1, 1) for _ in range(6)]) for i in range(40)]
    df = spark.createDataFrame(rows, "layer string, batch int, v array<double>").repartition(4)
    plain = {(r.layer, r.unit): r.mean_abs for r in activations.unit_activation_mean(df, "layer", "v").collect()}
    by_batch = {
        (r.layer, r.unit): r.mean_abs for r in activations.unit_activation_mean(df, "layer", "v", "batch").collect()
    }
    assert len(plain) == len(by_batch) == 12
    for layer in ("l0", None):
        for unit in range(6):
            values = [(b, abs(v[unit])) for name, b, v in rows if name == layer]
            assert plain[layer, unit] == pytest.approx(sum(x for _, x in values) / len(values))
            batches = {}
            for b, x in values:
                batches.setdefault(b, []).append(x)
            means = [sum(x) / len(x) for x in batches.values()]
            assert by_batch[layer, unit] == pytest.approx(sum(means) / len(means))


def test_bottom_share_and_ties(spark):
    small = spark.createDataFrame([("s", i, 1.0) for i in range(7)], "layer string, unit int, mean_abs double")
    assert activations.bottom_k_units(small, "layer", 5).count() == 0
    big = spark.createDataFrame([("b", i, 1.0) for i in range(40)], "layer string, unit int, mean_abs double")
    chosen = activations.bottom_k_units(big, "layer", 5)
    assert sorted(r.unit for r in chosen.collect()) == [0, 1]
    assert activations.unit_map_json(chosen, "layer").first().value == '{"b":[0,1]}'


def test_batch_health(spark):
    nan, inf = float("nan"), float("inf")
    rows = [("a", [1.0, 2.0]), ("a", [nan, 1.0]), ("a", [inf, -inf]), ("a", [1.0]), ("a", None)]
    row = activations.batch_health(spark.createDataFrame(rows, "layer string, v array<double>"), "v", 2, "layer").first()
    assert (row.n_rows, row.n_nan, row.n_inf, row.n_shape) == (5, 1, 1, 2)


def test_unit_means_skip_null_and_ragged_elements(spark):
    """W2: a divisor counts the values it divides."""
    rows = [("l", 1, [1.0, None]), ("l", 1, [3.0, 4.0]), ("l", 2, [5.0, float("nan")]), ("l", 2, None), ("l", 2, [])]
    df = spark.createDataFrame(rows, "layer string, batch int, v array<double>")
    plain = {r.unit: r.mean_abs for r in activations.unit_activation_mean(df, "layer", "v").collect()}
    assert plain == {0: 3.0, 1: 4.0}
    ragged = spark.createDataFrame([("l", 1, [4.0]), ("l", 1, [4.0, 8.0]), ("l", 2, [6.0, 4.0])], df.schema)
    means = {r.unit: r.mean_abs for r in activations.unit_activation_mean(ragged, "layer", "v", "batch").collect()}
    assert means == {0: 5.0, 1: 6.0}


def test_long_watch_lists_find_what_single_tests_find(spark):
    rnd = random.Random(8)
    letters = "abé🙂 "
    texts = ["".join(rnd.choices(letters, k=rnd.randrange(60))) for _ in range(300)] + [None, ""]
    rows = [(i, t, rnd.choice([None, "aab", t])) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "id long, text string, response string").withColumn("markers", F.lit("clash"))
    watch = sorted({"".join(rnd.choices(letters, k=rnd.randrange(1, 6))) for _ in range(400)})
    for names in (watch, [*watch, "", watch[0]]):
        found = {r.id: (r.n_fields, r.markers) for r in markers.marker_scan(df, ["text", "response"], names).collect()}
        for i, text, response in rows:
            hits = [{n for n in names if n in t} if t is not None else set() for t in (text, response)]
            want = (sum(map(bool, hits)), sorted(hits[0] | hits[1]))
            assert found.get(i, (0, [])) == want
    few = df.select("id", contains_any([F.col("text")], watch, True).alias("hit")).collect()
    assert {r.id for r in few if r.hit} == {i for i, t, _ in rows if t and any(n in t for n in watch)}
