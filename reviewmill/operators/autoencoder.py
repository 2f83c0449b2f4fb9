"""Anomaly scores by a small autoencoder: layers narrow to a few numbers and widen again, the error is the score.

Rows are dealt into shards of bounded size by a hash of their values and ordered by it, so shards do not depend on how a table
is laid out. In every epoch each shard walks its mini-batches from the common weights; weights and moments of all shards are
then averaged by their rows, in two steps. The weights, a few thousand numbers, are all that reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewmill import vocab
from reviewmill.operators.anomaly import Scaler, fit_scaler
from reviewmill.session import settle

HIDDEN, EPOCHS, BATCH_ROWS, SHARD_ROWS, RATE, SEED = (32, 16, 8, 16, 32), 30, 256, 1 << 16, 0.003, 9
FAN, DECAY = 64, (0.9, 0.999)


class Network:
    """Layers of the given widths, tanh between them. Weights are one vector: for each layer its matrix, then its shifts."""

    def __init__(self, widths: tuple[int, ...]):
        self.widths, self.cuts, at = widths, [], 0
        for i, o in zip(widths, widths[1:]):
            self.cuts.append((at, at + i * o, at + i * o + o))
            at += i * o + o
        self.size = at

    def start(self, seed: int) -> np.ndarray:
        rng, weights = np.random.default_rng(seed), np.zeros(self.size)
        for (low, mid, _), i, o in zip(self.cuts, self.widths, self.widths[1:]):
            weights[low:mid] = rng.normal(size=i * o) * np.sqrt(2 / (i + o))
        return weights

    def layers(self, weights: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        return [(weights[low:mid].reshape(i, o), weights[mid:high]) for (low, mid, high), i, o in zip(self.cuts, self.widths, self.widths[1:])]

    def outputs(self, weights: np.ndarray, rows: np.ndarray) -> list[np.ndarray]:
        """What each layer gives, the rows first."""
        found = [rows]
        for k, (matrix, shift) in enumerate(self.layers(weights)):
            value = found[-1] @ matrix + shift
            found.append(np.tanh(value) if k < len(self.cuts) - 1 else value)
        return found

    def gradient(self, weights: np.ndarray, rows: np.ndarray) -> tuple[float, np.ndarray]:
        """The mean squared error of the rows and its gradient."""
        found, out = self.outputs(weights, rows), np.empty(self.size)
        error = found[-1] - rows
        back = 2 * error / error.size
        for k in range(len(self.cuts) - 1, -1, -1):
            low, mid, high = self.cuts[k]
            out[low:mid], out[mid:high] = (found[k].T @ back).ravel(), back.sum(0)
            if k:
                back = (back @ weights[low:mid].reshape(self.widths[k], self.widths[k + 1]).T) * (1 - found[k] ** 2)
        return float(np.mean(error**2)), out


def walk(network: Network, state: np.ndarray, rows: np.ndarray, steps: int, batch_rows: int, rate: float) -> tuple[np.ndarray, float, int]:
    """One pass over the mini-batches of a shard from ``state`` (weights and both moments after so many steps): the new state,
    the squared error summed over rows on the way, and the steps taken."""
    w, m, v = (x.copy() for x in np.split(state, 3))
    total, taken = 0.0, 0
    for low in range(0, len(rows), batch_rows):
        part = rows[low : low + batch_rows]
        loss, g = network.gradient(w, part)
        taken += 1
        m, v = DECAY[0] * m + (1 - DECAY[0]) * g, DECAY[1] * v + (1 - DECAY[1]) * g * g
        count = steps + taken
        w -= rate * (m / (1 - DECAY[0] ** count)) / (np.sqrt(v / (1 - DECAY[1] ** count)) + 1e-8)
        total += loss * len(part)
    return np.concatenate([w, m, v]), total, taken


@dataclass
class Autoencoder:
    columns: list[str]
    scaler: Scaler
    widths: tuple[int, ...]
    weights: np.ndarray
    losses: list[float]


def scaled_rows(features: DataFrame, columns: list[str], scaler: Scaler) -> list:
    """The standardised columns; a missing value counts as its column's mean."""
    return [F.coalesce(F.when(~F.isnan(F.col(c).cast("double")), scaler.scaled(c)), F.lit(0.0)) for c in columns]


def fit(
    features: DataFrame, columns: list[str] = vocab.FEATURES, hidden: tuple[int, ...] = HIDDEN, epochs: int = EPOCHS,
    batch_rows: int = BATCH_ROWS, shard_rows: int = SHARD_ROWS, rate: float = RATE, seed: int = SEED,
) -> Autoencoder:
    """Weights fitted to all rows. Equal for any layout of the table, but for the rounding of its means."""
    scaler = fit_scaler(features, columns)
    network = Network((len(columns), *hidden, len(columns)))
    names = [f"z{i}" for i in range(len(columns))]
    rows = features.select(*(c.alias(n) for c, n in zip(scaled_rows(features, columns, scaler), names)))
    # values are hashed as rounded, as means that are added up in another order may differ in the last place
    rows = rows.withColumn("place", F.xxhash64(*(F.round(n, 6) for n in names)))
    count = rows.count()
    rows = settle(rows.withColumn("shard", F.pmod("place", F.lit(max(1, -(-count // shard_rows))))), "autoencoder")
    state, steps, losses = np.concatenate([network.start(seed), np.zeros(2 * network.size)]), 0, []
    schema = "shard long, fan long, n long, loss double, steps long, state binary"

    def add(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("shard")
        total = sum(np.frombuffer(x) * n for x, n in zip(group["state"], group["n"]))
        sums = {"n": [group["n"].sum()], "loss": [group["loss"].sum()], "steps": [group["steps"].max()], "state": [total.tobytes()]}
        return group[["shard", "fan"]].iloc[:1].assign(**sums)

    for _ in range(epochs if count else 0):
        common, done = state, steps

        def learn(group: pd.DataFrame) -> pd.DataFrame:
            group = group.sort_values(["place", *names])
            after, loss, taken = walk(network, common, group[names].to_numpy(float), done, batch_rows, rate)
            shard = group["shard"].iloc[0]
            return pd.DataFrame({"shard": [shard], "fan": [shard % FAN], "n": [len(group)], "loss": [loss], "steps": [taken], "state": [after.tobytes()]})

        sums = rows.groupBy("shard").applyInPandas(learn, schema).groupBy("fan").applyInPandas(add, schema)
        parts = sorted(sums.collect(), key=lambda r: r["fan"])  # at most FAN rows
        state = sum(np.frombuffer(r["state"]) for r in parts) / count
        steps += max(r["steps"] for r in parts)
        losses.append(sum(r["loss"] for r in parts) / count)
    return Autoencoder(list(columns), scaler, network.widths, state[: network.size], losses)


def autoencoder_scores(features: DataFrame, model: Autoencoder) -> DataFrame:
    """``features`` with anomaly_score, the mean squared error of the standardised row."""
    sent = features.sparkSession.sparkContext.broadcast(model.weights)
    widths, schema = model.widths, features.schema.simpleString()[len("struct<") : -1]
    packed = features.withColumn("_z", F.array(*scaled_rows(features, model.columns, model.scaler)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network = Network(widths)
        for batch in batches:
            rows = batch.column(batch.num_columns - 1).flatten().to_numpy(zero_copy_only=False).reshape(-1, widths[0])
            error = ((network.outputs(sent.value, rows)[-1] - rows) ** 2).mean(axis=1)
            columns = [*batch.columns[:-1], pa.array(error)]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:-1], "anomaly_score"])

    return packed.mapInArrow(score, f"{schema},anomaly_score:double")
