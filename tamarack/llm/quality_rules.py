"""Quality rules: a decision list learned from labelled statistics of texts.

Every text is described by counts and rates (``statistics``). Sequential covering
learns which of them reject a text: a rule grows by the threshold condition with the
highest information gain, is pruned on rows it has not grown on, and takes the rows it
covers out of the next rule's sight. The list is an ordered ``CASE`` expression over the
statistics. Only counts per feature and bin come to the driver.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamarack.llm.exact_dedup import without_spaces
from tamarack.llm.labelled import held_out, one_label
from tamarack.session import stage

# Words of a window that is looked for again in the same text.
WINDOW = 5
# Labelled documents the list is learned from at most; smallest hash of the id first.
MOST_LABELLED = 200_000
# Thresholds tried for each feature: so many quantiles of the labelled rows.
CUTS = 32
MOST_RULES, MOST_CONDITIONS = 16, 4
# Of the labelled rows that a rule covers, so many must be bad; and so many bad ones among those it has not grown on.
LEAST_PRECISION, LEAST_COVER = 0.95, 2
# One of so many labelled rows is kept for pruning.
PRUNE_ONE_OF = 3

SPACE, WORD = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]"
# Fixed value of the base rules.
SYMBOLS = "[#*$%&|<>]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def split_words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def repeated_words(words: Column) -> Column:
    """Words that lie in a window of ``WINDOW`` words found twice or more, the first time included.

    Windows are told apart by 64-bit hashes. A text without a repeated one is done
    after the hashes; in others the windows are sorted by hash, so that the cost grows
    with n log n, also where all windows are equal.
    """
    last = F.size(words) - WINDOW
    windows = F.transform(
        F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)])
    )

    def covered(hashes: Column) -> Column:
        placed = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def twice(ordered: Column) -> Column:
            def place(x: Column, k: Column) -> Column:
                same = (F.get(ordered, k - 1)["h"] == x["h"]) | (F.get(ordered, k + 1)["h"] == x["h"])
                return F.when(same, x["i"])

            return F.array_sort(F.array_compact(F.transform(ordered, place)))

        def length(places: Column) -> Column:
            steps = F.transform(
                places, lambda p, k: F.least(F.coalesce(F.get(places, k + 1) - p, F.lit(WINDOW)), F.lit(WINDOW))
            )
            return F.aggregate(steps, F.lit(0), lambda total, step: total + step)

        return let(let(placed, twice), length)

    counted = let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(covered(h)))
    return F.when(last >= 0, counted).otherwise(0)


def _matching(text: Column, pattern: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = (
    "words",
    "word_length",
    "symbol_rate",
    "capital_rate",
    "mark_rate",
    "digit_rate",
    "repeated_line_share",
    "repeated_word_share",
    "distinct_word_share",
    "words_per_line",
)


def statistics(text: Column) -> Column:
    """A struct of ``COUNTS`` (long) and ``FEATURES`` (double) of a text; null counts as empty.

    A text without words has zeros throughout. Rates are shares of the code points in
    words. Texts are read whole, each within its row.
    """
    text = F.coalesce(text, F.lit(""))

    def of_text(t: Column) -> Column:
        lines = F.filter(F.split(t, "\n"), lambda line: line.rlike(WORD))
        inner = F.struct(
            split_words(t).alias("words"),
            F.length(without_spaces(t)).alias("chars"),
            lines.alias("lines"),
            _matching(t, SYMBOLS).alias("symbols"),
            _matching(t, "[A-Z]+").alias("capitals"),
            _matching(t, r"[^\p{L}\p{N}\s]+").alias("marks"),
            _matching(t, "[0-9]+").alias("digits"),
        )
        return let(inner, of_parts)

    def of_parts(part: Column) -> Column:
        known = F.struct(
            F.size(part["words"]).alias("n"),
            F.size(part["lines"]).alias("n_lines"),
            (F.size(part["lines"]) - F.size(F.array_distinct(part["lines"]))).alias("dup_lines"),
            let(part["words"], repeated_words).alias("repeated"),
            F.size(F.array_distinct(part["words"])).alias("distinct"),
        )

        def rates(k: Column) -> Column:
            def share(a: Column, b: Column) -> Column:
                return F.when(b > 0, a / b).otherwise(F.lit(0.0)).cast("double")

            chars = part["chars"]
            counts = [k["n"], chars, part["symbols"], k["dup_lines"], k["repeated"]]
            values = [
                k["n"].cast("double"),
                share(chars, k["n"]),
                share(part["symbols"], chars),
                share(part["capitals"], chars),
                share(part["marks"], chars),
                share(part["digits"], chars),
                share(k["dup_lines"], k["n_lines"]),
                share(k["repeated"], k["n"]),
                share(k["distinct"], k["n"]),
                share(k["n"], k["n_lines"]),
            ]
            return F.struct(
                *[c.cast("long").alias(name) for c, name in zip(counts, COUNTS, strict=True)],
                *[c.alias(name) for c, name in zip(values, FEATURES, strict=True)],
            )

        return let(known, rates)

    return let(text, of_text)


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        value = F.col(self.feature)
        return value > self.threshold if self.above else value <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def covers(rule: Rule) -> Column:
    found = F.lit(True)
    for condition in rule:
        found = found & condition.column()
    return found


@dataclass(frozen=True)
class DecisionList:
    """Rules in order, each of which rejects what it covers; ``keep_rest`` judges what none covers."""

    rules: tuple[Rule, ...]
    keep_rest: bool = True

    def rule_column(self) -> Column:
        """The number of the first rule, from 1, that covers a row; null if none does."""
        number = F.lit(None).cast("int")
        for k in range(len(self.rules), 0, -1):
            number = F.when(covers(self.rules[k - 1]), F.lit(k)).otherwise(number)
        return number

    def reason_column(self) -> Column:
        """The conditions of that rule as text."""
        text = F.lit(None).cast("string")
        for rule in reversed(self.rules):
            text = F.when(covers(rule), F.lit(" and ".join(map(str, rule)))).otherwise(text)
        return text

    def kept_column(self) -> Column:
        return F.when(self.rule_column().isNotNull(), False).otherwise(self.keep_rest)


def _information(bad: int, good: int) -> float:
    return math.log2(bad / (bad + good)) if bad else 0.0


def _grow(rows: DataFrame, cuts: dict[str, list[float]]) -> Rule:
    """Add the condition with the highest gain until no good row is covered or none gains."""
    rule: Rule = ()
    while len(rule) < MOST_CONDITIONS:
        cells = (
            rows.where(covers(rule))
            .select("bad", F.posexplode("bins").alias("feature", "bin"))
            .groupBy("feature", "bin")
            .agg(F.sum("bad").alias("bad"), F.count(F.lit(1)).alias("n"))
            .collect()
        )
        counts = {(c["feature"], c["bin"]): (c["bad"], c["n"] - c["bad"]) for c in cells}
        best: tuple[float, Condition, int] | None = None
        for f, name in enumerate(FEATURES):
            own = [counts.get((f, b), (0, 0)) for b in range(len(cuts[name]) + 1)]
            bad, good = sum(b for b, _ in own), sum(g for _, g in own)
            before, low_bad, low_good = _information(bad, good), 0, 0
            for b, threshold in enumerate(cuts[name]):
                low_bad, low_good = low_bad + own[b][0], low_good + own[b][1]
                for above, p, n in ((False, low_bad, low_good), (True, bad - low_bad, good - low_good)):
                    gain = p * (_information(p, n) - before)
                    if p and gain > 1e-9 and (best is None or gain > best[0]):
                        best = gain, Condition(name, above, threshold), n
        if best is None:
            break
        rule = (*rule, best[1])
        if best[2] == 0:
            break
    return rule


def _prune(rule: Rule, grown: DataFrame, others: DataFrame) -> tuple[Rule, bool]:
    """The rule without its last conditions where that is better on other rows, and whether it is good enough."""

    def counts(rows: DataFrame) -> list[tuple[int, int]]:
        sums = []
        for k in range(1, len(rule) + 1):
            inside = covers(rule[:k]).cast("long")
            sums += [F.sum(inside * F.col("bad")).alias(f"b{k}"), F.sum(inside).alias(f"n{k}")]
        got = rows.agg(*sums).first()
        return [(got[f"b{k}"] or 0, (got[f"n{k}"] or 0)) for k in range(1, len(rule) + 1)]

    pruned, own = counts(others), counts(grown)
    worth = [(2 * bad - n) / n if n else -1.0 for bad, n in pruned]
    k = max(range(len(rule)), key=lambda i: (worth[i], -i))
    bad, n = pruned[k][0] + own[k][0], pruned[k][1] + own[k][1]
    return rule[: k + 1], pruned[k][0] >= LEAST_COVER and bad >= LEAST_PRECISION * n


def _bin(value: Column, cuts: list[float]) -> Column:
    """How many of the cuts lie below the value."""
    return F.size(F.filter(F.array(*map(F.lit, cuts)).cast("array<double>"), lambda cut: cut < value))


def learn(described: DataFrame) -> DecisionList:
    """A decision list from rows with ``FEATURES``, ``bad`` (1 or 0) and ``prune`` (boolean).

    Every step counts all rows that the rules so far leave, in one aggregation of at
    most features x bins cells. Equal gains go to the first feature and threshold.
    Without rows, or without bad ones, nothing is rejected; where the rows that no
    rule covers are mostly bad, they are rejected as well.
    """
    points = [k / (CUTS + 1) for k in range(1, CUTS + 1)]
    quantiles = described.agg(*[F.percentile(f, F.array(*map(F.lit, points))).alias(f) for f in FEATURES]).first()
    cuts = {f: sorted(set(quantiles[f] or [])) for f in FEATURES}
    bins = [_bin(F.col(f), cuts[f]) for f in FEATURES]
    rows = stage(described.withColumn("bins", F.array(*bins)), "binned")
    rules: list[Rule] = []
    while len(rules) < MOST_RULES:
        left = rows.where(DecisionList(tuple(rules)).rule_column().isNull())
        rule = _grow(left.where("NOT prune"), cuts)
        if not rule:
            break
        rule, good_enough = _prune(rule, left.where("NOT prune"), left.where("prune"))
        if not good_enough:
            break
        rules.append(rule)
    rest = rows.where(DecisionList(tuple(rules)).rule_column().isNull())
    bad, n = rest.agg(F.sum("bad"), F.count(F.lit(1))).first()
    return DecisionList(tuple(rules), 2 * (bad or 0) <= n)


def learn_from_labels(described: DataFrame, labels: DataFrame, good: Column, most: int = MOST_LABELLED) -> DecisionList:
    """Learn from documents that have a label and are not held out, at most ``most`` of them.

    ``described`` has ``doc_id`` and the features; ``good`` is an expression over
    ``labels`` that is 1 for documents to keep. Which rows are taken, and which of
    them prune, depends on their ids alone.
    """
    sample = one_label(labels, good).where(~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id")
    prune = F.pmod(F.xxhash64(F.lit("prune"), "doc_id"), F.lit(PRUNE_ONE_OF)) == 0
    # The sample is broadcast: ``most`` ids and labels.
    rows = described.join(F.broadcast(sample.limit(most)), "doc_id")
    return learn(rows.select(*FEATURES, (1 - F.col("label")).cast("long").alias("bad"), prune.alias("prune")))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def judge_quality(
    docs: DataFrame,
    labels: DataFrame,
    good: Column,
    id_column: str = "doc_id",
    text_column: str = "text",
    most: int = MOST_LABELLED,
) -> DataFrame:
    """One row per input row: ``doc_id``, ``COUNTS``, ``base_failed, kept, rule, reason``.

    ``kept`` is false for texts that fail the base rules and for those that a rule of
    the learned list covers; ``rule`` is its number and ``reason`` its conditions. A
    null or blank text has no words and fails. Rows that share an id are judged each by
    its own text and learn from the same label; a null id has no label. Other columns are
    not read; no rows give no rows. The statistics are stored, so texts are read once.
    """
    texts = docs.select(F.col(id_column).alias("doc_id"), statistics(F.col(text_column)).alias("s"))
    described = stage(texts.select("doc_id", "s.*"), "statistics")
    rules = learn_from_labels(described, labels, good, most)
    return described.select(
        "doc_id",
        *COUNTS,
        base_failed().alias("base_failed"),
        (~base_failed() & rules.kept_column()).alias("kept"),
        rules.rule_column().alias("rule"),
        rules.reason_column().alias("reason"),
    )
