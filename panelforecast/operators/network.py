"""A small neural classifier with real class weights, trained by whole gradients.

Every epoch is one aggregate: each task works out, for blocks of the rows it has, the weighted
loss and its gradient, and the shuffle adds up what the tasks found, a number a parameter. The
driver holds the parameters and the loss curve, never rows. Sums are whole numbers of a fixed
small unit, so that the order in which tasks end, or run again, changes nothing.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, cloudpickle
from pyspark.sql import DataFrame, functions as F

from panelforecast.sources.stages import stage

# what runs inside tasks travels with them: executors need not have the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# An epoch is one step over all rows, not one over many small batches: fewer and longer steps.
EPOCHS = 200
RATE = 0.01
BETAS, EPSILON = (0.9, 0.999), 1e-8
# Rows of a block: one matrix product each.
BLOCK_ROWS = 4096
# Sums are kept in units of 2 ** -44.
UNIT_BITS = 44
LEAST_CHANCE = 1e-15


@dataclass
class Network:
    """One hidden layer of rectified units; the last row of either matrix holds the intercepts."""

    hidden: np.ndarray
    out: np.ndarray

    @staticmethod
    def start(features: int, units: int, classes: int, seed: int) -> Network:
        """Weights drawn evenly within one over the root of the inputs of a unit."""
        draw = np.random.default_rng(seed)
        reach = (1 / max(1, features) ** 0.5, 1 / units**0.5)
        return Network(draw.uniform(-reach[0], reach[0], (features + 1, units)), draw.uniform(-reach[1], reach[1], (units + 1, classes)))

    def vector(self) -> np.ndarray:
        return np.concatenate([self.hidden.ravel(), self.out.ravel()])

    def moved(self, step: np.ndarray) -> Network:
        cut = self.hidden.size
        return Network(self.hidden + step[:cut].reshape(self.hidden.shape), self.out + step[cut:].reshape(self.out.shape))

    def _forward(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        active = np.maximum(x @ self.hidden[:-1] + self.hidden[-1], 0.0)
        scores = active @ self.out[:-1] + self.out[-1]
        chances = np.exp(scores - scores.max(axis=1, keepdims=True))
        return active, chances / chances.sum(axis=1, keepdims=True)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return self._forward(x)[1]

    def loss(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
        """Sum of the weighted cross-entropies."""
        chance = self.probabilities(x)[np.arange(len(y)), y]
        return float(-(weight * np.log(np.maximum(chance, LEAST_CHANCE))).sum())

    def gradient(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray]:
        """The loss and its derivative by every parameter, in the order of ``vector``."""
        active, chances = self._forward(x)
        at = np.arange(len(y))
        loss = float(-(weight * np.log(np.maximum(chances[at, y], LEAST_CHANCE))).sum())
        chances[at, y] -= 1.0
        error = chances * weight[:, None]
        back = (error @ self.out[:-1].T) * (active > 0)
        parts = (x.T @ back, back.sum(axis=0), active.T @ error, error.sum(axis=0))
        return loss, np.concatenate([p.ravel() for p in parts])


@dataclass
class NetworkFit:
    """The network of the lowest held-out loss (without held-out rows the last one), its epoch, and the loss curve."""

    model: Network
    epoch: int
    losses: DataFrame


def train_network(
    train: DataFrame,
    holdout: DataFrame | None,
    features: Sequence[str],
    label: str = "label",
    weights: Sequence[float] = (1.0, 1.0, 2.0, 2.0, 2.0),
    units: int = 64,
    epochs: int = EPOCHS,
    rate: float = RATE,
    seed: int = 69,
) -> NetworkFit:
    """Adam steps on the weighted cross-entropy, the held-out part scored at every one.

    ``losses`` has a row for every epoch from 0, the start: ``(epoch, train_loss, test_loss)``, each the
    mean weighted by class; null for a part without weight. Of equal held-out losses the earliest is
    kept. Rows with a missing feature or a label that is no class from 0 teach nothing. Weights are any
    numbers from zero on. Features are expected at unit scale.
    """
    if min(weights, default=-1.0) < 0 or not any(weights):
        raise ValueError(f"class weights {list(weights)} are not all zero or more, with one above")
    spark = train.sparkSession
    parts = train.withColumn("held", F.lit(False))
    if holdout is not None:
        parts = parts.unionByName(holdout.withColumn("held", F.lit(True)), allowMissingColumns=True)
    known = F.col(label).isin([float(k) for k in range(len(weights))])
    rows = parts.where(known).select("held", F.col(label).cast("int").alias("y"), F.array(*[F.col(c).cast("double") for c in features]).alias("x"))
    rows = rows.where(~F.exists("x", lambda v: v.isNull() | F.isnan(v)))
    blocks = stage(rows.mapInArrow(_pack(len(features)), "held boolean, y binary, x binary"), "network-blocks")
    blocks = blocks.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        given = np.asarray(weights, np.float64)
        totals = np.zeros(2)
        counts = blocks.mapInArrow(_class_counts(len(weights)), "i long, v long").groupBy("i").agg(F.sum("v").alias("v"))
        for i, n in counts.collect():
            totals[i // len(weights)] += n * given[i % len(weights)]
        model = Network.start(len(features), units, len(weights), seed)
        size = len(model.vector())
        slope, spread = np.zeros(size), np.zeros(size)
        curve: list[tuple[int, float | None, float | None]] = []
        best, at, least = model, 0, None
        for epoch in range(epochs + 1):
            sums = _pass(blocks, model, given, totals)
            losses = [float(v) if total > 0 else None for v, total in zip(sums[size:], totals)]
            curve.append((epoch, *losses))
            if losses[1] is None or least is None or losses[1] < least:
                best, at, least = model, epoch, losses[1]
            slope = BETAS[0] * slope + (1 - BETAS[0]) * sums[:size]
            spread = BETAS[1] * spread + (1 - BETAS[1]) * sums[:size] ** 2
            ahead = epoch + 1
            model = model.moved(-rate * (slope / (1 - BETAS[0] ** ahead)) / (np.sqrt(spread / (1 - BETAS[1] ** ahead)) + EPSILON))
    finally:
        blocks.unpersist()
    return NetworkFit(best, at, spark.createDataFrame(curve, "epoch int, train_loss double, test_loss double"))


def _pack(width: int):
    """Rows to blocks: a matrix and its classes as bytes, training and held-out rows apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.column("held").to_numpy(zero_copy_only=False)
            y = batch.column("y").to_numpy(zero_copy_only=False).astype(np.int8)
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(len(y), width)
            for part in (False, True):
                mine = np.flatnonzero(held == part)
                for start in range(0, len(mine), BLOCK_ROWS):
                    rows = mine[start : start + BLOCK_ROWS]
                    values = (pa.array([part]), pa.array([y[rows].tobytes()], pa.binary()), pa.array([x[rows].tobytes()], pa.binary()))
                    yield pa.RecordBatch.from_arrays(list(values), ["held", "y", "x"])

    return run


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, np.ndarray, np.ndarray]]:
    for batch in batches:
        for held, y, x in zip(batch.column("held").to_pylist(), batch.column("y"), batch.column("x")):
            classes = np.frombuffer(y.as_buffer(), np.int8)
            yield held, classes, np.frombuffer(x.as_buffer(), np.float64).reshape(len(classes), -1)


def _sums(values: np.ndarray) -> Iterator[pa.RecordBatch]:
    found = np.flatnonzero(values)
    yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int64)), pa.array(values[found])], ["i", "v"])


def _class_counts(classes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(2 * classes, np.int64)
        for held, y, _ in _blocks(batches):
            counts[int(held) * classes : (int(held) + 1) * classes] += np.bincount(y, minlength=classes)
        yield from _sums(counts)

    return run


def _pass(blocks: DataFrame, model: Network, weights: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """Gradient of the mean training loss, then the mean losses of both parts."""
    size = len(model.vector())
    unit = 2.0**UNIT_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(size + 2)
        for held, y, x in _blocks(batches):
            weight = weights[y] / max(totals[int(held)], 1e-300)
            if held:
                sums[size + 1] += model.loss(x, y, weight)
            else:
                loss, gradient = model.gradient(x, y, weight)
                sums[:size] += gradient
                sums[size] += loss
        if not np.abs(sums).max() < 2.0 ** (60 - UNIT_BITS):
            raise ValueError("features are too far from unit scale, or training has run away")
        yield from _sums(np.rint(sums * unit).astype(np.int64))

    out = np.zeros(size + 2)
    found = blocks.mapInArrow(run, "i long, v long").groupBy("i").agg(F.sum("v").alias("v")).toArrow()
    out[found.column("i").to_numpy()] = found.column("v").to_numpy() / unit
    return out


def predict_network(model: Network, df: DataFrame, features: Sequence[str], keys: Sequence[str], label: str = "label") -> DataFrame:
    """``(keys, label, prediction, probability)``; a row with a missing feature gets neither of the last two."""
    given = df.select(
        F.struct(*[F.col(k) for k in keys], F.col(label).cast("int").alias("label")).alias("row"),
        F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in features]).alias("x"),
    )
    width = len(features)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width)
            whole = ~np.isnan(x).any(axis=1)
            chances = model.probabilities(np.where(whole[:, None], x, 0.0)).tolist()
            picked = [int(np.argmax(c)) if ok else None for c, ok in zip(chances, whole)]
            listed = [c if ok else None for c, ok in zip(chances, whole)]
            values = [batch.column("row"), pa.array(picked, pa.int32()), pa.array(listed, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(values, ["row", "prediction", "probability"])

    kind = given.schema["row"].dataType.simpleString()
    return given.mapInArrow(run, f"row {kind}, prediction int, probability array<double>").select("row.*", "prediction", "probability")
