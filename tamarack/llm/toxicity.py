"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A text is the set of its hashed n-grams. From the labelled texts each n-gram gets
the log of the ratio of its shares in toxic and other texts; a logistic regression
is fitted on the sets scaled by these ratios. N-grams whose ratio is within chance
are not used, so a long harmless text gathers no weight from its length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamarack.llm.grams import gram_buckets, joined, runs
from tamarack.llm.labelled import labelled_texts
from tamarack.session import stage, unstage

SIZES = (3, 4, 5, 6)
BITS = 20
# Labelled documents a fit uses at most.
MOST_LABELLED = 10_000
# Tasks that count their n-grams; each sends a table of fixed size to the driver.
FIT_TASKS = 8
# Standard errors by which a log-count ratio must differ from 0, and texts that must hold the n-gram.
LEAST_ERRORS = 3.5
LEAST_TEXTS = 4
ALPHA = 1.0
L2 = 0.5
STEPS = 400


def text_sets(texts: list[str], used: np.ndarray | None = None) -> Iterator[np.ndarray]:
    """The set of buckets of each text, sorted; of those in the mask ``used`` only, if it is given."""
    for start, end in runs(texts):
        codes, owner = joined([t.lower() for t in texts[start:end]])
        parts = []
        for who, buckets in gram_buckets(codes, owner, SIZES, BITS):
            if used is not None:
                who, buckets = who[used[buckets]], buckets[used[buckets]]
            parts.append((np.searchsorted(who, np.arange(end - start + 1)), buckets))
        for k in range(end - start):
            yield np.unique(np.concatenate([b[at[k] : at[k + 1]] for at, b in parts]))


@dataclass
class Model:
    """Weight of each bucket (ratio times coefficient, 0 where unused) and the intercept."""

    weights: np.ndarray
    intercept: float

    def scores(self, texts: list[str]) -> np.ndarray:
        """Probability of the toxic label for each text; an empty text has that of the intercept."""
        out = np.empty(len(texts))
        for start, end in runs(texts):
            codes, owner = joined([t.lower() for t in texts[start:end]])
            keys = [np.zeros(0, np.int64)]
            for who, buckets in gram_buckets(codes, owner, SIZES, BITS):
                used = self.weights[buckets] != 0
                keys.append((who[used].astype(np.int64) << BITS) | buckets[used])
            found = np.unique(np.concatenate(keys))
            weights = self.weights[found & ((1 << BITS) - 1)].astype(float)
            out[start:end] = np.bincount(found >> BITS, weights, minlength=end - start)
        return 1 / (1 + np.exp(-np.clip(out + self.intercept, -50, 50)))


def ratios(p: np.ndarray, q: np.ndarray, positive: float, negative: float) -> np.ndarray:
    """Log-count ratio of each bucket from the toxic and other texts that hold it; 0 where it is within chance."""
    ratio = np.log((p + ALPHA) / (positive + 2 * ALPHA)) - np.log((q + ALPHA) / (negative + 2 * ALPHA))
    error = np.sqrt(1 / (p + ALPHA) + 1 / (q + ALPHA))
    return np.where((np.abs(ratio) >= LEAST_ERRORS * error) & (p + q >= LEAST_TEXTS), ratio, 0.0)


def fit(sets: list[np.ndarray], labels: np.ndarray, ratio: np.ndarray) -> Model:
    """Fit on sets of buckets (others than those with a ratio play no part) and labels 0 or 1.

    Without texts of both labels every text gets the smoothed share of label 1.
    """
    labels = np.asarray(labels, float)
    n, positive = len(labels), labels.sum()
    prior = float(np.log((positive + 0.5) / (n - positive + 0.5)))
    weights = np.zeros(1 << BITS, np.float32)
    if not 0 < positive < n:
        return Model(weights, prior)
    used = ratio != 0
    place = np.cumsum(used) - 1
    kept = [place[s[used[s]]] for s in sets]
    row, column = np.repeat(np.arange(n), [len(k) for k in kept]), np.concatenate(kept)
    value = ratio[used][column]
    theta, intercept = np.zeros(int(used.sum())), prior
    # Adam on the penalised log loss, all texts at once.
    m, v = np.zeros(len(theta) + 1), np.zeros(len(theta) + 1)
    for step in range(1, STEPS + 1):
        z = np.bincount(row, value * theta[column], minlength=n) + intercept
        miss = 1 / (1 + np.exp(-np.clip(z, -50, 50))) - labels
        slope = np.bincount(column, value * miss[row], minlength=len(theta)) + L2 * theta
        g = np.append(slope, miss.sum()) / n
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        theta, intercept = theta - move[:-1], intercept - move[-1]
    weights[used] = ratio[used] * theta
    return Model(weights, float(intercept))


def train(docs: DataFrame, labels: DataFrame, label: Column, most: int = MOST_LABELLED) -> Model:
    """Fit on at most ``most`` labelled documents.

    Counts of all n-grams come to the driver as tables of a fixed size, one of each
    of ``FIT_TASKS`` tasks; after that only the sets of the n-grams that are used.
    """
    sample = stage(labelled_texts(docs, labels, label, most), "labelled")
    size = 1 << BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, texts = np.zeros((2, size), np.uint16), [0, 0]
        for batch in batches:
            toxic = [int(x == 1) for x in batch.column("label").to_pylist()]
            for k, buckets in zip(toxic, text_sets(batch.column("text").to_pylist()), strict=True):
                held[k, buckets] += 1
                texts[k] += 1
        yield pa.RecordBatch.from_arrays(
            [pa.array([held.tobytes()], pa.binary()), pa.array([texts[0]]), pa.array([texts[1]])],
            ["held", "others", "toxic"],
        )

    tables = sample.repartition(FIT_TASKS).mapInArrow(count, "held binary, others long, toxic long")
    p, q, positive, negative = np.zeros(size), np.zeros(size), 0, 0
    for row in tables.toLocalIterator():
        other, toxic = np.frombuffer(row["held"], np.uint16).reshape(2, size)
        p, q, positive, negative = p + toxic, q + other, positive + row["toxic"], negative + row["others"]
    ratio = ratios(p, q, positive, negative)
    shared = docs.sparkSession.sparkContext.broadcast(ratio != 0)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [s.tobytes() for s in text_sets(batch.column("text").to_pylist(), shared.value)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), batch.column("label")],
                                             ["buckets", "label"])

    rows = sample.mapInArrow(sets, "buckets binary, label int").collect()
    unstage(sample)
    labels = np.array([int(r["label"] == 1) for r in rows])
    return fit([np.frombuffer(r["buckets"], np.uint32) for r in rows], labels, ratio)


def score_column(text: Column, model: Model, spark) -> Column:
    """Score of a text between 0 and 1; a null text counts as empty. The weights have a fixed size."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def run(column: pa.Array) -> pa.Array:
        return pa.array(shared.value.scores([t or "" for t in column.to_pylist()]), pa.float64())

    return run(text)
