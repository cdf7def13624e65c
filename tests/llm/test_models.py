"""Classifiers by held-out accuracy, the tagger by its spans and against brute force."""

import random
import re
import tracemalloc

import numpy as np
import pytest
from llm.fixtures import WORDS, awkward_texts, clashing, documents, sentence
from pyspark.sql import functions as F

from tamarack.llm import grams, pii, quality, toxicity
from tamarack.llm.labelled import held_out, labelled_texts

BAD = ["vilebad", "nastyword", "grimcurse"]


def labelled_corpus(seed, n=400):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        words = [f"{rng.choice(WORDS)}{rng.randrange(40)}" for _ in range(rng.randrange(20, 120))]
        toxic = rng.random() < 0.3
        grade = rng.randrange(3)
        for _ in range(2 * toxic):
            words.insert(rng.randrange(len(words)), rng.choice(BAD))
        words = [w.upper() + "!!" if rng.random() < (0.8, 0.3, 0.0)[grade] else w for w in words]
        rows.append((i, " ".join(words)))
        labels.append((i, grade, int(toxic)))
    return rows, labels


@pytest.fixture(scope="module")
def corpus(spark):
    rows, labels = labelled_corpus(3)
    labels += [(5000, None, None), (None, 1, 1), (5001, 1, 1), (3, labels[3][1], labels[3][2])]
    rows += [(6000, None), (6001, ""), (6002, "x" * 50_000), (None, "vilebad nastyword")]
    return documents(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_sample_is_bounded_and_leaves_the_held_out_fold(spark, corpus):
    docs, labels = corpus
    taken = labelled_texts(docs, labels, F.col("toxic"), 50)
    assert taken.count() == 50
    ids = labelled_texts(docs.withColumn("text", F.col("doc_id").cast("string")), labels, F.col("toxic"), 1000)
    kept = docs.where(~held_out(F.col("doc_id"))).where("doc_id < 400").count()
    assert ids.count() == kept and ids.where(held_out(F.col("text"))).count() == 0


def test_toxicity_on_the_held_out_fold(spark, corpus):
    docs, labels = corpus
    model = toxicity.train(docs, labels, F.col("toxic"))
    scored = clashing(docs).withColumn("p", toxicity.score_column(F.col("text"), model, spark))
    rows = scored.join(labels.dropna().distinct(), "doc_id").where(held_out(F.col("doc_id"))).select("p", "toxic").collect()
    assert len(rows) > 100
    assert sum((r.p >= 0.5) == (r.toxic == 1) for r in rows) / len(rows) > 0.95
    every = {r.doc_id: r.p for r in scored.collect()}
    assert len(every) == 404 and all(0 <= p <= 1 for p in every.values())
    assert every[6000] == every[6001] and every[None] > 0.7 > every[6002]


def test_toxicity_of_one_label_and_of_nothing(spark, corpus):
    docs, labels = corpus
    for given in (labels.withColumn("toxic", F.lit(0)), labels.limit(0)):
        model = toxicity.train(docs, given, F.col("toxic"))
        assert set(model.scores(["a", "", "vilebad"])) == {model.scores(["b"])[0]}


def test_scores_do_not_depend_on_neighbours():
    rng = np.random.default_rng(0)
    weights = np.where(rng.random(1 << toxicity.BITS) < 0.3, rng.normal(size=1 << toxicity.BITS), 0).astype(np.float32)
    model = toxicity.Model(weights, 0.1)
    texts = [t or "" for _, t in awkward_texts()]
    alone = [model.scores([t])[0] for t in texts]
    assert np.allclose(model.scores(texts), alone)


def test_ordinal_grades_on_the_held_out_fold(spark, corpus):
    docs, labels = corpus
    model = quality.train(docs, labels, F.col("quality"), 3)
    assert len(model.thresholds) == 2 and model.thresholds[0] < model.thresholds[1]
    own = docs.withColumn("g", quality.grade_columns(F.col("text"), model, 2, spark))
    rows = own.join(labels.dropna().distinct(), "doc_id").where(held_out(F.col("doc_id"))).collect()
    assert sum(round(r.g.expected_grade) == r.quality for r in rows) / len(rows) > 0.85
    assert sum((r.g.tail_probability >= 0.5) == (r.quality == 2) for r in rows) / len(rows) > 0.9
    by_id = {r.doc_id: r.g for r in own.collect()}
    assert by_id[6000] == by_id[6001] and len(by_id) == 404
    assert all(0 <= g.expected_grade <= 2 and 0 <= g.tail_probability <= 1 for g in by_id.values())


def test_ordinal_slopes_are_those_of_the_likelihood():
    """Fitted thresholds of texts without traits in common are the shares of the grades."""
    rows = [(np.array([k % 7]), np.array([1.0], np.float32)) for k in range(400)]
    grades = np.array([0] * 100 + [1] * 100 + [2] * 200)
    np.random.default_rng(1).shuffle(grades)
    model = quality.fit(rows, grades, 3)
    tails = model.at_least(np.zeros(1))[0]
    assert np.allclose(tails, [0.75, 0.5], atol=0.08)
    none = quality.fit([], np.array([], int), 4)
    assert np.allclose(none.at_least(np.zeros(1))[0], [0.75, 0.5, 0.25])


def test_gram_buckets_count_every_gram():
    texts = ["ab", "", "abcab", "é中🙂"]
    codes, owner = grams.joined(texts)
    for n, (who, buckets) in zip((1, 2, 3), grams.gram_buckets(codes, owner, (1, 2, 3), 12), strict=True):
        assert np.bincount(who, minlength=4).tolist() == [max(0, len(t) + 3 - n) for t in texts]
        assert len(set(buckets.tolist())) <= len(buckets)


# The contract's patterns, written anew for the brute force.
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(?:\.[0-9]+){3}",
    "card": r"[0-9](?:[ -]?[0-9])+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}


def brute_spans(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text):
            d = [int(c) for c in m[0] if c in "0123456789"]
            doubled = [sum(divmod(2 * x, 10)) if k % 2 else x for k, x in enumerate(reversed(d))]
            good = {
                "email": True,
                "ip": kind == "ip" and all(int(p[-4:]) <= 255 for p in m[0].split(".")),
                "card": 16 <= len(d) <= 19 and sum(doubled) % 10 == 0,
                "phone": 8 <= len(d) <= 15,
            }[kind]
            if good:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


PERSONAL = ["ann.lee@mail.example.com", "10.0.255.1", "256.1.1.1", "4539 1488 0343 6467", "4539148803436468", "+1 (017) 555-7713",
            "+12", "a@b", "x@y.z.", "1.2.3.4.5.6.7.8", "0004.0.0.300", "+49 (30) 1234-5678-9012-3456-78", "6011-0009-9013-9424"]


@pytest.fixture(scope="module")
def tagged(spark):
    rng = random.Random(4)
    rows = []
    for i in range(150):
        words = [rng.choice(WORDS) for _ in range(rng.randrange(5, 60))]
        for _ in range(rng.randrange(4)):
            words.insert(rng.randrange(len(words)), rng.choice(PERSONAL))
        rows.append((i, " ".join(words)))
    net = pii.train(documents(spark, rows))
    rows += [(500, None), (501, ""), (502, "é🙂 " * 3000 + "ann.lee@mail.example.com"), (503, "9" * 6000), (504, "1." * 3000)]
    rows += awkward_texts()[:60] + [(7, rows[7][1])]
    return rows, net, pii.find_personal_data(clashing(documents(spark, rows)), net).collect()


def test_base_spans_equal_brute_force(tagged):
    rows, _, found = tagged
    assert sorted((i is None, i or 0, brute_spans(t or "")) for i, t in rows) == sorted(
        (r.doc_id is None, r.doc_id or 0, r.base_spans) for r in found
    )
    for r in found:
        kinds = [part.split(":")[0] for part in r.base_spans.split(",") if part]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [kinds.count(k) for k in pii.KINDS]


def test_added_spans_keep_the_base_and_overlap_nothing(tagged):
    _, _, found = tagged
    for r in found:
        base, every = r.base_spans.split(","), r.spans.split(",")
        assert set(base) <= set(every) or r.base_spans == ""
        fixed = [tuple(map(int, s.split(":")[1:])) for s in base if s]
        for s in set(every) - set(base) - {""}:
            a, b = map(int, s.split(":")[1:])
            assert a < b and not any(a < e and b > st for st, e in fixed)


def test_network_finds_spans_in_forms_that_patterns_miss(tagged):
    _, net, _ = tagged
    hits = 0
    for match, kind in (("ann.lee@mail.example.com", "email"), ("10.0.255.1", "ip"), ("+1 (017) 555-7713", "phone")):
        text = f"the river light {pii.rewritten(kind, match)} under small house"
        assert not pii.base_spans(text)
        hits += any(k == kind for k, _, _ in pii.added_spans([text], net)[0])
    assert hits >= 2
    assert pii.added_spans(["the of and stone river light " * 60], net) == [[]]


def test_windows_are_reconciled_over_long_texts(tagged):
    _, net, _ = tagged
    word = "00 1 (017)  555-7713"
    for lead in (380, 440, 447, 448, 500, 511, 900):
        text = "river " * 400
        text = text[:lead] + " " + word + " " + text[lead:]
        alone = pii.added_spans([text], net)[0]
        assert pii.added_spans(["x", text, ""], net)[1] == alone
        spots = [(a, b) for _, a, b in alone]
        assert len(spots) == len(set(spots)) and all(b <= c for (_, b), (c, _) in zip(spots, spots[1:], strict=False))


def test_slopes_are_those_of_the_likelihood():
    rng = np.random.default_rng(5)
    net = pii.untrained()
    net.moves[:] = rng.normal(size=net.moves.shape)
    windows, tags = rng.integers(0, pii.N_SYMBOLS, (3, 7)), rng.integers(0, pii.TAGS, (3, 7))

    def loss():
        scores, _ = pii._forward(net, windows)
        total = 0.0
        for k in range(3):
            alpha = scores[0, k]
            own = scores[0, k, tags[k, 0]]
            for s in range(1, 7):
                alpha = np.log(np.exp(alpha[:, None] + net.moves).sum(axis=0)) + scores[s, k]
                own += net.moves[tags[k, s - 1], tags[k, s]] + scores[s, k, tags[k, s]]
            total += np.log(np.exp(alpha).sum()) - own
        return total / 3

    slopes = pii._slopes(net, windows, tags)
    for part, slope in zip(net.parameters(), slopes, strict=True):
        for _ in range(6):
            at = tuple(rng.integers(0, n) for n in part.shape)
            before = part[at]
            part[at] = before + 1e-5
            up = loss()
            part[at] = before - 1e-5
            down = loss()
            part[at] = before
            assert (up - down) / 2e-5 == pytest.approx(slope[at], abs=1e-5)


def test_fast_tags_equal_the_plain_search():
    rng = np.random.default_rng(2)
    net = pii.untrained()
    net.moves[:] = rng.normal(size=net.moves.shape)
    windows = rng.integers(0, pii.N_SYMBOLS, (20, 30)).astype(np.uint8)
    scores, _ = pii._forward(net, windows.astype(int))
    assert np.allclose(net.emissions(windows).transpose(0, 2, 1), scores, atol=1e-3)
    got = net.tags(windows)

    def value(k, path):
        moves = sum(net.moves[a, b] for a, b in zip(path, path[1:], strict=False))
        return sum(scores[s, k, t] for s, t in enumerate(path)) + moves

    for k in range(20):
        best = scores[0, k]
        for s in range(1, 30):
            best = (best[:, None] + net.moves).max(axis=0) + scores[s, k]
        assert value(k, got[k]) == pytest.approx(best.max(), abs=1e-2)


def test_stretches_are_found_as_by_the_plain_search():
    """Mostly "outside" by a wide lead, as real texts are, with moves of every strength."""
    rng = np.random.default_rng(8)
    for trial in range(60):
        net = pii.untrained()
        net.moves[:] = rng.normal(size=net.moves.shape) * rng.choice([0, 0.5, 2, 5])
        scores = rng.normal(size=(40, pii.TAGS, 12)) * rng.choice([0.5, 3])
        scores[:, 0] += rng.choice([1, 5, 12, 20]) * (rng.random((40, 12)) < rng.choice([0.5, 0.9, 1]))
        net.emissions = lambda windows, scores=scores: scores
        got = net.tags(np.zeros((12, 40), np.uint8))
        for k in range(12):
            total, back = scores[0, :, k], []
            for s in range(1, 40):
                ways = total[:, None] + net.moves
                back.append(ways.argmax(axis=0))
                total = ways.max(axis=0) + scores[s, :, k]
            path = [int(total.argmax())]
            for step in reversed(back):
                path.append(int(step[path[-1]]))
            assert got[k].tolist() == path[::-1], trial


def test_short_addresses_are_kept():
    text = "see 8[.]8[.]8[.]8 or 1 2"
    tags = np.zeros(len(text), np.int8)
    first = 1 + 2 * pii.KINDS.index("ip")
    tags[4], tags[5:17] = first, first + 1
    tags[21], tags[22:] = first, first + 1  # two digits are no address
    assert list(pii._read_spans(text, tags)) == [("ip", 4, 17)]


def test_a_step_of_the_quality_fit_takes_little_memory(monkeypatch):
    """Nothing of the size of all counts is made in a step, and the size of its parts does not matter."""
    rnd = np.random.default_rng(1)
    rows = [(rnd.integers(0, 1 << 15, n).astype(np.int32), rnd.random(n, np.float32)) for n in rnd.integers(0, 2000, 2000)]
    grades = rnd.integers(0, 2, len(rows))
    monkeypatch.setattr(quality, "STEPS", 2)
    tracemalloc.start()
    whole = quality.fit(rows, grades, 2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 15 * sum(len(b) for b, _ in rows)
    monkeypatch.setattr(quality, "AT_ONCE", 1000)
    parts = quality.fit(rows, grades, 2)
    assert (whole.weights == parts.weights).all() and (whole.thresholds == parts.thresholds).all()


def test_counts_are_packed_without_loss():
    texts = ["", "a", "la " * 70_000, *(t or "" for _, t in awkward_texts())]
    for buckets, values in quality.text_counts(texts):
        packed = quality.pack(buckets, values)
        again, same = quality.unpack(packed)
        assert again.tolist() == buckets.tolist() and same.tobytes() == values.tobytes()
        assert len(packed) <= 6 * len(buckets) + 64
    long = next(quality.text_counts([" ".join(sentence(random.Random(3), 3000))]))
    assert 2 * len(quality.pack(*long)) < 8 * len(long[0])
