"""Quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader updates.

Tokens are runs of letters and digits or runs of other signs, case kept. Features are hashed tokens and token pairs; a pair
of equal tokens is one common feature, so repetition shows whatever word repeats. A document is the vector of log(1 + count)
at unit length, and its score the logistic function of a sparse dot product with the weights.

Training takes a bounded sample of labelled rows, at most ``PER_LABEL`` of either label, in one sequence of updates, as the
method has it: each depends on the one before. Of a text with more than ``PER_TEXT`` different features, that many enter
training, chosen by their hash from the whole text; so the one task holds a bounded number of them. Scoring covers every
feature of every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewmill.llm import folds
from reviewmill.llm.texts import Tokens, flat, grams, mixed, numbers_of, ranges, run_kinds

BITS, PER_LABEL, PER_TEXT, EPOCHS = 18, 4_000, 1 << 14, 6
BLOCK = 2 << 20


@dataclass
class Settings:
    """Per-coordinate learning rate alpha / (beta + sqrt(sum of squared gradients)) and the two penalties."""

    alpha: float = 5.0
    beta: float = 1.0
    l1: float = 0.001
    l2: float = 0.0


class Features:
    """Sparse unit vectors of documents: for all rows of a block (row, feature, value), sorted by row and feature."""

    def __init__(self, bits: int = BITS):
        self.tokens, self.bits = Tokens(run_kinds()), bits

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        words, rows = self.tokens(data, offsets)
        of = numbers_of(rows)
        pairs = grams(words, 2, 2)
        if len(pairs):
            pairs[words[1:] == words[:-1]] = 7
        inside = of[1:] == of[:-1]
        single = mixed(words + np.uint64(1))
        found = np.concatenate([single, pairs[inside]]) >> np.uint64(64 - self.bits)
        keys = (np.concatenate([of, of[:-1][inside]]) << self.bits) | found.astype(np.int64)
        keys, counts = np.unique(keys, return_counts=True)
        row, value = keys >> self.bits, np.log1p(counts)
        norm = np.sqrt(np.bincount(row, value * value, len(offsets) - 1))
        return row, keys & ((1 << self.bits) - 1), value / norm[row]


def follow_the_leader(shard: pd.DataFrame, bits: int, epochs: int, settings: Settings) -> np.ndarray:
    """FTRL-proximal over documents in the given order: frame of (indices, values, label). The last weight is the bias."""
    size = (1 << bits) + 1
    z, n = np.zeros(size), np.zeros(size)

    def weights(at):
        shrunk = np.sign(z[at]) * settings.l1 - z[at]
        return np.where(np.abs(z[at]) <= settings.l1, 0, shrunk / ((settings.beta + np.sqrt(n[at])) / settings.alpha + settings.l2))

    vectors = [
        (np.append(np.frombuffer(i, np.int32), size - 1), np.append(np.frombuffer(v, np.float32), np.float32(1)), y)
        for i, v, y in zip(shard["indices"], shard["values"], shard["label"])
    ]
    for _ in range(epochs):
        for at, x, y in vectors:
            w = weights(at)
            gradient = (logistic(w @ x) - y) * x
            sigma = (np.sqrt(n[at] + gradient * gradient) - np.sqrt(n[at])) / settings.alpha
            z[at] += gradient - sigma * w
            n[at] += gradient * gradient
    return weights(np.arange(size))


def logistic(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def train(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality",
    per_label: int = PER_LABEL, bits: int = BITS, epochs: int = EPOCHS, settings: Settings = Settings(),
) -> np.ndarray:
    """Weights learned from at most ``per_label`` rows of either label (0 or 1), whole texts.

    Rows without id, label or document are not used; of several labels for an id the smallest counts. Without any row
    all weights are 0, so every score is a half.
    """
    marked = labels.filter(F.col(label).isin(0, 1)).groupBy(key).agg(F.min(label).alias("label"))
    chosen = folds.sample_ids(marked, key, "label", per_label)
    rows = docs.select(F.col(key), F.coalesce(text, F.lit("")).alias("text")).join(F.broadcast(chosen), key)
    rows = rows.select(F.col(key).alias("key"), "text", F.col("label").cast("int").alias("label"), F.xxhash64(key).alias("place"))

    per_text = PER_TEXT

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(bits)
        for batch in batches:
            data, offsets = flat(batch.column(1))
            for low, high in ranges(offsets, BLOCK):
                part = offsets[low : high + 1]
                row, index, value = features(data[part[0] : part[-1]], part - part[0])
                first = np.arange(len(row)) - np.searchsorted(row, row) < per_text  # numbers of features are hashes
                row, index, value = row[first], index[first], value[first]
                cuts = np.searchsorted(row, np.arange(1, high - low))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(3).slice(low, high - low), batch.column(2).slice(low, high - low),
                        pa.array([x.tobytes() for x in np.split(index.astype(np.int32), cuts)], pa.binary()),
                        pa.array([x.tobytes() for x in np.split(value.astype(np.float32), cuts)], pa.binary()),
                    ],
                    ["place", "label", "indices", "values"],
                )

    def learn(sample: pd.DataFrame) -> pd.DataFrame:
        ordered = sample.sort_values(["place", "label"], kind="stable")
        return pd.DataFrame({"weights": [follow_the_leader(ordered, bits, epochs, settings).tobytes()]})

    sample = rows.mapInArrow(vectors, "place long, label int, indices binary, values binary")
    model = sample.groupBy(F.lit(0).alias("model")).applyInPandas(learn, "weights binary").first()
    return np.frombuffer(model["weights"], np.float64) if model else np.zeros((1 << bits) + 1)


class Scorer:
    """Scores for columns of texts; one object per task."""

    def __init__(self, weights: np.ndarray):
        self.features, self.weights = Features((len(weights) - 1).bit_length() - 1), weights

    def __call__(self, column: pa.Array) -> np.ndarray:
        data, offsets = flat(column)
        scores = np.empty(len(column))
        for low, high in ranges(offsets, BLOCK):
            part = offsets[low : high + 1]
            row, index, value = self.features(data[part[0] : part[-1]], part - part[0])
            scores[low:high] = logistic(np.bincount(row, value * self.weights[index], high - low) + self.weights[-1])
        return scores


def score(docs: DataFrame, weights: np.ndarray, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, score (0 to 1), predicted (1 from a half on) for every row; a null text counts as empty."""
    model = docs.sparkSession.sparkContext.broadcast(weights)
    kind = docs.schema[key].dataType.simpleString()

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model.value)
        for batch in batches:
            scores = scorer(batch.column(1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))], ["key", "score", "predicted"]
            )

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(predict, f"key {kind}, score double, predicted int").withColumnRenamed("key", key)


def keep_good(docs: DataFrame, weights: np.ndarray, text: str = "text") -> DataFrame:
    """The rows of ``docs``, all their columns, with a score of at least a half. A null text counts as empty, and empty texts
    go or stay by the bias of the model; an empty table stays empty."""
    model = docs.sparkSession.sparkContext.broadcast(weights)
    place = docs.columns.index(text)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model.value)
        for batch in batches:
            yield batch.filter(pa.array(scorer(batch.column(place)) >= 0.5))

    return docs.mapInArrow(choose, docs.schema)
