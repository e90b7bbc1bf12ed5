"""Gradient-boosted regression trees that know missing values, grown level by level from histograms.

Every level of every tree is one aggregate: each task adds up, for the rows it has, the first
and second derivatives of the loss by node, feature and bin, and what the tasks found is
added up by the shuffle. The driver holds histograms and trees, never rows. Bins are exact
quantiles, sums are whole numbers and draws come from the rows' keys, so the same rows give
the same trees however they are partitioned.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F

from panelforecast.sources.stages import drop_stage, lean_shuffles, stage

# what runs inside tasks travels with them: executors need not have the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Bins of a feature; the code after the last one stands for a missing value.
BINS = 255
MISSING_CODE = 255
# A leaf's sum of second derivatives grows by this, and none is smaller than one row's.
PENALTY, LEAST_WEIGHT, LEAST_GAIN = 1.0, 1.0, 1e-6
# Columns of a tree whose codes are counted together: one job then serves all its levels.
TOGETHER = 2
# Trees after which every row's prediction is written down instead of worked out anew.
TREES_A_STAGE = 3
# Bits of a value's key that the quantile search reads a step: the first one, then the others.
FIRST_BITS, NEXT_BITS = 16, 8


@dataclass
class Settings:
    maxIter: int = 100
    maxDepth: int = 4
    stepSize: float = 0.02
    subsamplingRate: float = 0.7
    columnRate: float = 0.7
    seed: int = 69
    bins: int = BINS


@dataclass
class Forest:
    """Trees as flat arrays: node i has the children 2 i + 1 (up to the threshold) and 2 i + 2; feature -1 is a leaf."""

    base: float | None
    feature: np.ndarray
    threshold: np.ndarray
    missing_left: np.ndarray
    value: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        """One value a row of ``x``, whose NaNs are missing values; NaN where nothing was learned from."""
        out = np.full(len(x), np.nan if self.base is None else self.base)
        for feature, threshold, left, value in zip(self.feature, self.threshold, self.missing_left, self.value):
            out += value[_leaf(x, np.isnan(x), feature, threshold, left)]
        return out

    def to_table(self, spark: SparkSession) -> DataFrame:
        row = (self.base, *(a.tolist() for a in (self.feature, self.threshold, self.missing_left, self.value)))
        return spark.createDataFrame([row], "base double, feature array<array<int>>, threshold array<array<double>>, missing_left array<array<boolean>>, value array<array<double>>")

    @staticmethod
    def from_table(table: DataFrame) -> Forest:
        r = table.first()
        return Forest(r.base, np.array(r.feature, np.int64), np.array(r.threshold), np.array(r.missing_left, bool), np.array(r.value))


def _leaf(x: np.ndarray, missing: np.ndarray, feature: np.ndarray, threshold: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The node each row ends in: one step a level for all rows."""
    at = np.zeros(len(x), np.int64)
    values, gaps = x.ravel(), missing.ravel()
    rows = np.arange(len(x)) * x.shape[1]
    for _ in range(int(len(feature)).bit_length() - 1):
        asks = feature[at]
        ends = asks < 0
        if ends.all():
            break
        place = rows + asks  # of rows that have ended any place will do
        down = np.where(gaps[place], left[at], values[place] <= threshold[at])
        at = np.where(ends, at, 2 * at + 2 - down)
    return at


def _spread(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def drawn(keys: np.ndarray, tree: int, seed: int, rate: float) -> np.ndarray:
    """Rows that a tree is grown on, by their 64-bit keys."""
    own = _spread(keys ^ _spread(np.array([(seed << 32) + tree + 1], np.uint64)))
    return (own >> np.uint64(11)).astype(float) * 2.0**-53 < rate


def drawn_columns(features: int, tree: int, seed: int, rate: float) -> np.ndarray:
    """Columns that a tree may split on: the share ``rate`` of them, rounded down, one at least."""
    chosen = np.random.default_rng((seed, tree)).permutation(features)[: max(1, int(rate * features))]
    return np.sort(chosen)


def _ordered(x: np.ndarray) -> np.ndarray:
    """Doubles as whole numbers in the same order."""
    bits = (x + 0.0).view(np.uint64)
    return np.where(bits >> np.uint64(63) != 0, ~bits, bits | np.uint64(1 << 63))


def _from_ordered(key: int) -> float:
    bits = key & ~(1 << 63) if key >> 63 else ~key & ((1 << 64) - 1)
    return float(np.array([bits], np.uint64).view(np.float64)[0])


def _matrix(batch: pa.RecordBatch, width: int) -> np.ndarray:
    columns = [batch.column(f"x{i}").to_numpy(zero_copy_only=False).astype(float) for i in range(width)]
    return np.column_stack(columns) if width else np.zeros((batch.num_rows, 0))


def quantile_cuts(rows: DataFrame, width: int, folds: int, bins: int) -> list[list[np.ndarray]]:
    """``[fold][feature]``: the values at the ranks ceil(j n / bins), exact, each once, of what the fold trains on.

    The greatest value is none of them: it parts nothing, and greater ones, met later, belong to its bin.

    The keys of the values are read from their first bits on: a pass counts the cells that the
    wanted ranks are in, at most ``bins`` a fold and feature, cut into 256. Counts add
    up in any order, so no partitioning changes a cut. Eight passes read a double's 64 bits.
    """
    wanted: dict[tuple[int, int, int], list] = {}
    bits, step = FIRST_BITS, FIRST_BITS
    while True:
        cells = [np.array(sorted({p for (_, f, _), (p, _) in wanted.items() if f == i}), np.uint64) for i in range(width)]

        def count(batches: Iterator[pa.RecordBatch], bits=bits, step=step, cells=cells) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x, epoch = _matrix(batch, width), batch.column("epoch").to_numpy(zero_copy_only=False).astype(np.int64)
                out = []
                for i in range(width):
                    known = ~np.isnan(x[:, i])
                    keys, at = _ordered(x[known, i]), epoch[known]
                    if bits > FIRST_BITS:
                        inside = np.isin(keys >> np.uint64(64 - bits + step), cells[i])
                        keys, at = keys[inside], at[inside]
                    pairs, rows = np.unique(np.stack([keys >> np.uint64(64 - bits), at.astype(np.uint64)], axis=1), axis=0, return_counts=True)
                    out.append((np.full(len(rows), i), pairs[:, 0].view(np.int64), pairs[:, 1].astype(np.int64), rows))
                merged = [np.concatenate(c) for c in zip(*out)]
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in merged], ["i", "cell", "epoch", "n"])

        found = rows.mapInArrow(count, "i long, cell long, epoch long, n long").groupBy("i", "cell", "epoch").agg(F.sum("n").alias("n")).toArrow()
        table = {c: found.column(c).to_numpy() for c in ("i", "cell", "epoch", "n")}
        table["cell"] = table["cell"].astype(np.int64).view(np.uint64)
        for i in range(width):
            for fold in range(folds):
                mine = (table["i"] == i) & (table["epoch"] <= fold)
                cell, own = np.unique(table["cell"][mine], return_inverse=True)
                n = np.bincount(own, table["n"][mine], len(cell)).astype(np.int64)
                if bits == FIRST_BITS:
                    total = int(n.sum())
                    ranks = {-(-j * total // bins) for j in range(1, bins + 1)} if total else set()
                    wanted.update({(fold, i, r): [None, r] for r in ranks})
                parents = cell >> np.uint64(step) if bits > FIRST_BITS else np.zeros(len(cell), np.uint64)
                sums = np.cumsum(n)
                for (f, j, _), place in wanted.items():
                    if (f, j) == (fold, i):
                        first = int(np.searchsorted(parents, np.uint64(place[0] or 0)))
                        before = int(sums[first - 1]) if first else 0
                        at = int(np.searchsorted(sums, before + place[1]))
                        place[1] -= (int(sums[at - 1]) if at else 0) - before
                        place[0] = int(cell[at])
        if bits == 64:
            break
        bits, step = bits + NEXT_BITS, NEXT_BITS
    cuts: list[list[set]] = [[set() for _ in range(width)] for _ in range(folds)]
    for (fold, i, _), (key, _) in wanted.items():
        cuts[fold][i].add(_from_ordered(key))
    return [[np.array(sorted(c)[:-1]) for c in of_fold] for of_fold in cuts]


def _coded(cuts: list[list[np.ndarray]], width: int):
    """Rows with one byte a fold and feature: the number of cuts below the value, or that of a missing one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch, width)
            codes = np.full((len(x), len(cuts), width), MISSING_CODE, np.uint8)
            for fold, of_fold in enumerate(cuts):
                for i, edges in enumerate(of_fold):
                    known = ~np.isnan(x[:, i])
                    codes[known, fold, i] = np.searchsorted(edges, x[known, i])
            kept = [batch.column(c) for c in ("epoch", "key", "y")]
            yield pa.RecordBatch.from_arrays([*kept, _bytes(codes)], ["epoch", "key", "y", "codes"])

    return run


def _bytes(values: np.ndarray) -> pa.Array:
    data = np.ascontiguousarray(values)
    width = data[:1].nbytes if len(data) else 0
    ends = np.arange(len(data) + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), len(data), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(data.tobytes())])


def _read(column: pa.Array, kind, shape: tuple[int, ...]) -> np.ndarray:
    """Rows of equal width, none null, out of the column's own buffer."""
    if not len(column) or not math.prod(shape):
        return np.zeros((len(column), *shape), kind)
    width = math.prod(shape) * np.dtype(kind).itemsize
    fixed = column.cast(pa.binary(width))
    return np.frombuffer(fixed.buffers()[1], kind, len(column) * math.prod(shape), fixed.offset * width).reshape(len(column), *shape)


def _tree_sums(trees: list[list[tuple]], codes: np.ndarray, guess: np.ndarray) -> np.ndarray:
    """Predictions with some more trees, for all folds; codes stand for the values."""
    out = guess.copy()
    for fold, of_fold in enumerate(trees):
        mine = np.ascontiguousarray(codes[:, fold, :])
        missing = mine == MISSING_CODE
        for feature, code, left, value in of_fold:
            out[:, fold] += value[_leaf(mine, missing, feature, code, left)]
    return out


def fit_forests(
    rows: DataFrame, features: Sequence[str], label: str, folds: int = 1, key: Sequence[str] | None = None, settings: Settings | None = None
) -> list[Forest]:
    """One forest per fold, all grown side by side; a row belongs to the folds from its ``epoch`` on.

    Squared error; a tree is grown level by level to ``maxDepth`` on the rows it draws, with the
    columns it draws. Of every node's cuts the one with the largest gain
    ``GL^2/(HL+1) + GR^2/(HR+1) - G^2/(H+1)`` is taken if that is above ``LEAST_GAIN``; missing values go to the
    side that gains more, to the right if that makes no difference, and equal gains go to the first column and the
    lowest cut. A leaf is ``-stepSize G / (H + 1)``. Forests start from the mean label.

    ``key`` names the columns that tell rows apart for the draws, the row's values by default.
    Rows without a label are left out; a fold without any has a forest that predicts nothing.
    Derivatives are rounded to whole multiples of a power of two so small that 62 bits hold
    any sum of them.
    """
    with lean_shuffles(rows.sparkSession):
        return _fit_forests(rows, features, label, folds, key, settings or Settings())


def _fit_forests(rows: DataFrame, features: Sequence[str], label: str, folds: int, key: Sequence[str] | None, s: Settings) -> list[Forest]:
    width = len(features)
    named = [F.col(f"`{c}`") for c in (key or [*features, label])]
    given = rows.where(F.col(f"`{label}`").isNotNull()).select(
        F.col("epoch").cast("int").alias("epoch"),
        F.xxhash64(*named).alias("key"),
        F.col(f"`{label}`").cast("double").alias("y"),
        *[F.col(f"`{c}`").cast("double").alias(f"x{i}") for i, c in enumerate(features)],
    )
    given = stage(given.where(F.col("epoch") < folds), "tree-rows")
    shape = given.agg(F.count(F.lit(1)).alias("n"), F.min("y").alias("low"), F.max("y").alias("high")).first()
    nodes = 2 ** (s.maxDepth + 1) - 1
    empty = (np.zeros((0, nodes), np.int64), np.zeros((0, nodes)), np.zeros((0, nodes), bool), np.zeros((0, nodes)))
    if not shape["n"]:
        return [Forest(None, *empty) for _ in range(folds)]
    scale = 2.0 ** (60 - math.ceil(math.log2(shape["n"] + 1)) - math.ceil(math.log2(4 * (shape["high"] - shape["low"]) + 1)))
    above = F.rint((F.col("y") - F.lit(shape["low"])) * F.lit(scale)).cast("long")
    mine = [F.col("epoch") <= f for f in range(folds)]
    sums = given.agg(F.array(*[F.sum(F.when(m, above)) for m in mine]).alias("above"), F.array(*[F.count_if(m) for m in mine]).alias("n")).first()
    base = np.array([shape["low"] + a / scale / n if n else np.nan for a, n in zip(*sums)])
    cuts = quantile_cuts(given, width, folds, s.bins) if width else [[] for _ in range(folds)]
    coded = given.mapInArrow(_coded(cuts, width), "epoch int, key long, y double, codes binary")
    state = stage(coded.withColumn("guess", F.lit(np.nan_to_num(base).tobytes())), "tree-codes")
    grown: list[list[tuple]] = [[] for _ in range(folds)]
    recent: list[list[tuple]] = [[] for _ in range(folds)]
    for tree in range(s.maxIter):
        columns = drawn_columns(width, tree, s.seed, s.columnRate) if width else np.zeros(0, np.int64)
        partial = [(np.full(nodes, -1, np.int64), np.zeros(nodes, np.int64), np.zeros(nodes, bool), np.zeros(nodes)) for _ in range(folds)]
        together = _histograms(state, recent, partial, tree, 0, columns, width, folds, s, scale, True) if 1 <= len(columns) <= TOGETHER else None
        for level in range(s.maxDepth):
            if together is None:
                sums = _histograms(state, recent, partial, tree, level, columns, width, folds, s, scale)
            else:
                sums = [_of_level(together[f, 0, 0], partial[f], level, columns, width) for f in range(folds)]
            if not any([_split(partial[f], sums[f], level, columns, scale, s.stepSize) for f in range(folds)]):
                break
        for f in range(folds):
            recent[f].append(partial[f])
            grown[f].append(partial[f])
        if len(recent[0]) == TREES_A_STAGE and tree + 1 < s.maxIter:
            before, state = state, stage(_moved_on(state, recent, width, folds), "tree-codes")
            drop_stage(before)
            recent = [[] for _ in range(folds)]
    return [Forest(None, *empty) if np.isnan(base[f]) else _forest(float(base[f]), grown[f], cuts[f], empty) for f in range(folds)]


def _forest(base: float, trees: list[tuple], cuts: list[np.ndarray], empty: tuple) -> Forest:
    if not trees:
        return Forest(base, *empty)
    feature, code, left, value = (np.array([t[i] for t in trees]) for i in range(4))
    threshold = np.zeros(feature.shape)
    for at in zip(*np.nonzero(feature >= 0)):
        edges = cuts[feature[at]]
        threshold[at] = edges[code[at]] if code[at] < len(edges) else np.inf  # known values here, missing ones there
    return Forest(base, feature, threshold, left, value)


def _moved_on(state: DataFrame, recent: list[list[tuple]], width: int, folds: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = _read(batch.column("codes"), np.uint8, (folds, width))
            guess = _tree_sums(recent, codes, _read(batch.column("guess"), np.float64, (folds,)))
            kept = [batch.column(c) for c in ("epoch", "key", "y", "codes")]
            yield pa.RecordBatch.from_arrays([*kept, _bytes(guess)], ["epoch", "key", "y", "codes", "guess"])

    return state.mapInArrow(run, "epoch int, key long, y double, codes binary, guess binary")


def _histograms(
    state: DataFrame, recent: list[list[tuple]], partial: list[tuple], tree: int, level: int, columns: np.ndarray, width: int, folds: int, s: Settings, scale: float, together: bool = False
) -> np.ndarray:
    """``[fold, node, column, code, (G, H)]`` of the level's nodes, as whole numbers; one aggregate.

    ``together`` gives one column instead, whose code is all the columns' codes one after another.
    Without columns there is one pretended column, all missing, so that nodes still have their sums.
    """
    at_level, wide = 2**level, max(1, len(columns))
    span = MISSING_CODE + 1
    if together:
        wide, span = 1, span ** len(columns)
    shape = (folds, at_level, wide, span)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = np.zeros(shape, np.int64), np.zeros(shape, np.int64)
        for batch in batches:
            inside = drawn(batch.column("key").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), tree, s.seed, s.subsamplingRate)
            epoch = batch.column("epoch").to_numpy(zero_copy_only=False)[inside]
            y = batch.column("y").to_numpy(zero_copy_only=False)[inside]
            codes = _read(batch.column("codes"), np.uint8, (folds, width))[inside]
            guess = _read(batch.column("guess"), np.float64, (folds,))[inside]
            for f, (feature, code, left, _) in enumerate(partial):
                use = epoch <= f
                mine = np.ascontiguousarray(codes[use, f, :])
                missing = mine == MISSING_CODE
                node = _leaf(mine, missing, feature, code, left) if level else np.zeros(len(mine), np.int64)
                node -= at_level - 1
                here = node >= 0  # others have ended in a leaf further up
                if not here.all():
                    node, mine, missing, use = node[here], mine[here], missing[here], np.flatnonzero(use)[here]
                own = guess[use, f]
                for grown in recent[f]:
                    own = own + grown[3][_leaf(mine, missing, *grown[:3])]
                slope = np.rint((own - y[use]) * scale).astype(np.int64)
                mine = mine[:, columns] if len(columns) else np.full((len(slope), 1), MISSING_CODE)
                if together:
                    mine = mine.astype(np.int64) @ (MISSING_CODE + 1) ** np.arange(len(columns) - 1, -1, -1)[:, None]
                # sums of halves of 30 bits are exact in doubles for any batch of less than 2^22 rows
                high, low = (slope >> 30).astype(float), (slope & ((1 << 30) - 1)).astype(float)
                for c in range(wide):
                    cell = node * span + mine[:, c]
                    n, upper, lower = (np.bincount(cell, w, at_level * span).astype(np.int64).reshape(at_level, -1) for w in (None, high, low))
                    second[f, :, c] += n
                    first[f, :, c] += (upper << 30) + lower
        first, second = first.ravel(), second.ravel()
        used = np.flatnonzero(second)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(first[used]), pa.array(second[used])], ["cell", "g", "h"])

    found = state.mapInArrow(run, "cell long, g long, h long").groupBy("cell").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).toArrow()
    sums = np.zeros((int(np.prod(shape)), 2), np.int64)
    sums[found.column("cell").to_numpy()] = np.stack([found.column("g").to_numpy(), found.column("h").to_numpy()], axis=1)
    return sums.reshape(*shape, 2)


def _of_level(together: np.ndarray, tree: tuple, level: int, columns: np.ndarray, width: int) -> np.ndarray:
    """``[node, column, code, (G, H)]`` of a level from the sums by all codes of the tree's columns."""
    feature, code, left, _ = tree
    grid = np.zeros((len(together), width), np.uint8)
    for i, column in enumerate(reversed(columns)):
        grid[:, column] = np.arange(len(together)) // (MISSING_CODE + 1) ** i % (MISSING_CODE + 1)
    node = _leaf(grid, grid == MISSING_CODE, feature, code, left) - (2**level - 1) if level else np.zeros(len(grid), np.int64)
    here = (node >= 0) & (together[:, 1] > 0)
    sums = np.zeros((2**level, len(columns), MISSING_CODE + 1, 2), np.int64)
    for i, column in enumerate(columns):
        np.add.at(sums[:, i], (node[here], grid[here, column]), together[here])
    return sums


def _split(tree: tuple, sums: np.ndarray, level: int, columns: np.ndarray, scale: float, step: float) -> bool:
    """Give the level's nodes their values and best splits; False where none is split. Children get theirs from the split."""
    feature, code, left, value = tree
    split = False
    for at in range(2**level):
        node = 2**level - 1 + at
        if level and feature[(node - 1) // 2] < 0:
            continue
        total = sums[at, 0].sum(axis=0)
        if not level:
            value[0] = _leaf_value(total, scale, step)
        best = best_split(sums[at], scale) if len(columns) else None
        if best is None:
            continue
        column, code[node], left[node], lower = best
        feature[node], split = columns[column], True
        value[2 * node + 1], value[2 * node + 2] = _leaf_value(lower, scale, step), _leaf_value(total - lower, scale, step)
    return split


def _leaf_value(sums: np.ndarray, scale: float, step: float) -> float:
    return -step * (float(sums[0]) / scale) / (float(sums[1]) + PENALTY)


def best_split(sums: np.ndarray, scale: float) -> tuple[int, int, bool, np.ndarray] | None:
    """``(column, code, missing left, sums of the left side)`` of a node's ``[column, code, (G, H)]``."""
    total = sums[0].sum(axis=0)
    known, missing = sums[:, :MISSING_CODE].cumsum(axis=1), sums[:, MISSING_CODE:]
    lower = np.stack([known, known + missing], axis=1)  # missing to the right, to the left
    upper = total - lower

    def score(part: np.ndarray) -> np.ndarray:
        return (part[..., 0] / scale) ** 2 / (part[..., 1] + PENALTY)

    gain = score(lower) + score(upper) - score(total)
    gain = np.where((lower[..., 1] >= LEAST_WEIGHT) & (upper[..., 1] >= LEAST_WEIGHT), gain, -np.inf)
    at = np.unravel_index(int(gain.argmax()), gain.shape)
    if not gain[at] > LEAST_GAIN:
        return None
    return int(at[0]), int(at[2]), bool(at[1]), lower[at]


def predict_forests(rows: DataFrame, forests: Sequence[Forest], features: Sequence[str], keep: Sequence[str], fold: str | None = None) -> DataFrame:
    """``keep`` and ``prediction``; the column ``fold`` names each row's forest, the first one without it."""
    width, kept = len(features), [f"k{i}" for i in range(len(keep))]
    given = rows.select(
        *[F.col(f"`{c}`").alias(k) for c, k in zip(keep, kept)],
        (F.col(fold) if fold else F.lit(0)).cast("int").alias("forest"),
        *[F.col(f"`{c}`").cast("double").alias(f"x{i}") for i, c in enumerate(features)],
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, own = _matrix(batch, width), batch.column("forest").to_numpy(zero_copy_only=False)
            out = np.full(len(x), np.nan)
            for f in np.unique(own):
                out[own == f] = forests[f].predict(x[own == f])
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in kept], pa.array(out, from_pandas=True)], [*kept, "prediction"])

    fields = given.select(*kept).schema.fields
    schema = ", ".join([*[f"{f.name} {f.dataType.simpleString()}" for f in fields], "prediction double"])
    return given.mapInArrow(run, schema).select(*[F.col(k).alias(c) for k, c in zip(kept, keep)], "prediction")
