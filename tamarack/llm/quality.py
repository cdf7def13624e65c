"""Quality: ordinal cumulative-link regression on graded ratings over hashed text.

``P(grade <= k) = logistic(threshold_k - f)`` with ordered thresholds and one
``f`` for all grades: the weights of a text's hashed character n-grams (case, digits
and marks as they stand) times the logarithm of their rates, plus the weights of
two hashed traits of the whole text. The expected grade and the probability of reaching a
grade follow from ``f``.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamarack.llm.grams import gram_buckets, joined, runs
from tamarack.llm.labelled import labelled_texts

SIZES = (1, 2, 3)
BITS = 15
# Labelled documents a fit uses at most.
MOST_LABELLED = 6000
L2 = 1e-3
STEPS = 300
# The rate of an n-gram is how often it occurs in a text of so many characters.
PER_CHARS = 100.0
# Values that a step of the fit works on at once.
AT_ONCE = 1 << 18
# Traits share the table of weights: their buckets lie behind those of the n-grams.
TRAITS = 64
# So strong is one trait beside the rates of the n-grams.
TRAIT_VALUE = 8.0


def traits(text: str) -> list[int]:
    """Hashed traits of a text: its compressed size for its length, and its length's magnitude."""
    raw = text.encode("utf-8", "surrogatepass")
    packed = len(zlib.compress(raw, 1)) / max(len(raw), 1)
    size = min(len(raw).bit_length(), 20)
    return [min(int(packed * 20), 23), 24 + size]


def text_counts(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Buckets and values of each text: n-grams by the logarithm of their rate, traits as ``TRAIT_VALUE``."""
    for start, end in runs(texts):
        codes, owner = joined(texts[start:end])
        grams = list(gram_buckets(codes, owner, SIZES, BITS))
        ends = [np.searchsorted(who, np.arange(end - start + 1)) for who, _ in grams]
        for k, text in enumerate(texts[start:end]):
            own = [buckets[e[k] : e[k + 1]] for (_, buckets), e in zip(grams, ends, strict=True)]
            counts = np.bincount(np.concatenate(own), minlength=1 << BITS)
            found = np.flatnonzero(counts)
            buckets = np.concatenate([found, (1 << BITS) + np.array(traits(text))])
            # Logarithms, or a text that repeats one word would be all that counts.
            rates = np.log1p(counts[found] * (PER_CHARS / (len(text) + 2)))
            yield buckets.astype(np.int32), np.concatenate([rates, np.full(2, TRAIT_VALUE)]).astype(np.float32)


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray

    def levels(self, texts: list[str]) -> np.ndarray:
        """``f`` of each text; an empty text has the weights of its traits and of its two ends."""
        return np.array([(self.weights[buckets] * values).sum() for buckets, values in text_counts(texts)])

    def at_least(self, levels: np.ndarray) -> np.ndarray:
        """Probabilities of the grades 1, 2, ... or higher, one column for each threshold."""
        return _logistic(levels[:, None] - self.thresholds[None, :])


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, n_grades: int) -> Model:
    """Fit weights and thresholds for the grades ``0 .. n_grades - 1`` by maximum penalised likelihood.

    Without rows every grade is equally likely for every text.
    """
    n, cuts, width = len(rows), n_grades - 1, (1 << BITS) + TRAITS
    shares = (np.bincount(np.asarray(grades, int), minlength=n_grades) + 1) / (n + n_grades)
    below = np.cumsum(shares)[:-1]
    start = np.log(below / (1 - below))
    if not n:
        return Model(np.zeros(width), start)
    sizes = np.array([len(b) for b, _ in rows])
    column = np.concatenate([b for b, _ in rows], dtype=np.uint16, casting="unsafe")  # they are below 65,536
    value = np.concatenate([v for _, v in rows], dtype=np.float32)
    del rows
    # Whole rows some at a time, so that what a step works out for them takes little memory.
    first = np.concatenate([[0], np.cumsum(sizes)])
    cuts_at = np.unique(np.searchsorted(first, np.append(np.arange(0, first[-1], AT_ONCE), first[-1])))
    cuts_at = np.append(cuts_at[:-1], n)
    spans = [(a, b, slice(first[a], first[b])) for a, b in zip(cuts_at[:-1], cuts_at[1:], strict=True)]
    # Columns are brought to one scale, or frequent n-grams would hide the others.
    squares = np.zeros(width)
    for _, _, part in spans:
        np.add.at(squares, column[part], value[part].astype(float) ** 2)
    scale = np.sqrt(squares / n) + 0.05
    scale[1 << BITS :] = 1.0
    for _, _, part in spans:
        value[part] = value[part] / scale[column[part]]
    w = np.zeros(width)  # one float for each column; the rest is held in 4-byte numbers
    # The first threshold and the logarithms of the steps to the next ones.
    t = np.concatenate([start[:1], np.log(np.maximum(np.diff(start), 1e-3))])
    m, v = np.zeros(width + cuts), np.zeros(width + cuts)
    grades = np.asarray(grades, int)
    everyone = np.arange(n)
    for step in range(1, STEPS + 1):
        theta = np.cumsum(np.concatenate([t[:1], np.exp(t[1:])]))
        f = np.concatenate([
            np.bincount(np.repeat(np.arange(b - a), sizes[a:b]), value[part] * w[column[part]], minlength=b - a)
            for a, b, part in spans
        ])
        # P(grade <= k) for k = -1 .. n_grades - 1; the likelihood is a difference of neighbours.
        upto = np.concatenate([np.zeros((n, 1)), _logistic(theta[None, :] - f[:, None]), np.ones((n, 1))], axis=1)
        density = upto * (1 - upto)
        likely = np.maximum(upto[everyone, grades + 1] - upto[everyone, grades], 1e-9)
        high, low = density[everyone, grades + 1] / likely, density[everyone, grades] / likely
        by_level = (high - low) / n  # slope of the loss in f
        by_theta = np.zeros(cuts)
        np.add.at(by_theta, grades[grades < cuts], -high[grades < cuts] / n)
        np.add.at(by_theta, grades[grades > 0] - 1, low[grades > 0] / n)
        tail = np.cumsum(by_theta[::-1])[::-1]  # a step moves all thresholds behind it
        by_t = np.concatenate([tail[:1], tail[1:] * np.exp(t[1:])])
        slope = np.zeros(width)
        for a, b, part in spans:
            np.add.at(slope, column[part], value[part] * np.repeat(by_level[a:b], sizes[a:b]))
        g = np.append(slope + L2 * w, by_t)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = 0.02 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w, t = w - move[:width], t - move[width:]
    return Model(w / scale, np.cumsum(np.concatenate([t[:1], np.exp(t[1:])])))


def pack(buckets: np.ndarray, values: np.ndarray) -> bytes:
    """Buckets, which rise and are below 65,536, and values of one text in few bytes."""
    steps = np.diff(buckets, prepend=0).astype(np.uint16)
    return zlib.compress(steps.tobytes() + values.astype(np.float32).tobytes(), 1)


def unpack(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The buckets and values of ``pack``; six bytes each."""
    raw = zlib.decompress(packed)
    n = len(raw) // 6
    return np.cumsum(np.frombuffer(raw, np.uint16, n), dtype=np.uint16), np.frombuffer(raw, np.float32, n, 2 * n)


def train(docs: DataFrame, labels: DataFrame, grade: Column, n_grades: int, most: int = MOST_LABELLED) -> Model:
    """Fit on at most ``most`` labelled documents; their counts go to the driver, not their texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [pack(*own) for own in text_counts(batch.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(counts, pa.binary()), batch.column("label")], ["counts", "label"])

    rows = labelled_texts(docs, labels, grade, most).mapInArrow(run, "counts binary, label int").collect()
    grades = np.array([r["label"] for r in rows], int)
    packed = [r["counts"] for r in rows]
    del rows
    return fit([unpack(p) for p in packed], grades, n_grades)


def grade_columns(text: Column, model: Model, reach: int, spark) -> Column:
    """``expected_grade`` and ``tail_probability`` (of grade ``reach`` or higher) as a struct.

    A null text counts as empty. The weights have a fixed size.
    """
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("struct<expected_grade: double, tail_probability: double>")
    def run(column: pa.Array) -> pa.Array:
        own = shared.value
        tails = own.at_least(own.levels([t or "" for t in column.to_pylist()]))
        return pa.StructArray.from_arrays(
            [pa.array(tails.sum(axis=1), pa.float64()), pa.array(tails[:, reach - 1], pa.float64())],
            ["expected_grade", "tail_probability"],
        )

    return run(text)
