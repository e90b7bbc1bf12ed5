"""Fitting and scoring the four models."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, functions as F

from panelforecast.operators import metrics as mt
from panelforecast.operators import models as ml
from panelforecast.operators.boosting import Settings, fit_forests, predict_forests
from panelforecast.operators.folds import block_starts, first_fold, holdout_split, interpolated_versions
from panelforecast.operators.least_squares import Moments, product_sums, read_sums, solve
from panelforecast.operators.network import predict_network, train_network
from panelforecast.operators.panel import drop_null_lag, row_position
from panelforecast.sources.stages import stage

KEYS = ["date", "district"]


# The classes of the label, and of the network, which counts from 0.
CLASSES = (1, 2, 3, 4, 5)
NETWORK_CLASSES = (0, 1, 2, 3, 4)


@dataclass
class Evaluation:
    """Fold metrics, their means, all predictions, and the fitted models (last = final)."""

    metrics: DataFrame
    predictions: DataFrame
    models: list[Any] = field(default_factory=list)
    features: list[list[str]] = field(default_factory=list)
    losses: DataFrame | None = None
    classes: Sequence[int] = CLASSES

    @property
    def final_model(self) -> Any:
        return self.models[-1]

    def means(self) -> DataFrame:
        names = [c for c in ("mae", "r2", "accuracy", "weighted_f1") if c in self.metrics.columns]
        return mt.mean_over_folds(self.metrics, names)

    def confusion(self, classes: Sequence[int] | None = None) -> DataFrame:
        """Counts of every scored row over the model's classes and all others that occur."""
        rounded = self.predictions.withColumn("prediction", F.rint("prediction"))
        return mt.confusion_matrix(rounded, self.classes if classes is None else classes)


def model_eval(
    data: DataFrame, features: Sequence[str], model_type: str = "OLS", label: str = "ipc", splits: int = 5, **settings
) -> Evaluation:
    """Evaluate "OLS", "Ridge" or "XGboost" over time folds, or "NN" on a hashed holdout."""
    features = [c for c in features if c != "const"]
    if model_type == "OLS":
        return _linear(data, features, label, splits, 0.0, rounded_mae=False)
    if model_type == "Ridge":
        return _linear(data, features, label, splits, settings.get("alpha", ml.RIDGE_ALPHA), rounded_mae=True)
    if model_type == "XGboost":
        return _trees(data, features, label, splits, settings)
    if model_type == "NN":
        return _network(data, features, label, settings)
    raise ValueError(f"unknown model_type {model_type!r}")


def _positioned(data: DataFrame, features: Sequence[str], label: str, splits: int) -> tuple[DataFrame, list[int]]:
    """Staged rows in time order with their ``epoch``, the first fold that trains on them, and the test blocks' starts."""
    rows = stage(row_position(data.select(*KEYS, *features, label), KEYS), "positions")
    starts = block_starts(rows.count(), splits)
    return rows.withColumn("epoch", first_fold(starts)), starts


def _linear(data, features, label, splits, alpha, rounded_mae) -> Evaluation:
    """One pass gives the sums of all folds: a training row counts from its epoch on, and
    only rows whose gaps a later fold fills otherwise count twice (``interpolated_versions``).
    What reaches the driver is a few sums per pair of columns and block."""
    rows, _ = _positioned(data, features, label, splits)
    columns = [*features, label]
    stats = F.array(*[F.struct(F.count(c).alias("n"), F.min(F.col(c).cast("double")).alias("low"), F.max(F.col(c).cast("double")).alias("high"), F.sum(F.col(c).cast("double")).alias("total")) for c in columns])
    seen = {r.epoch: r.stats for r in rows.where(F.col("epoch") < splits).groupBy("epoch").agg(stats.alias("stats")).collect()}

    def varies(i: int, fold: int) -> bool:
        values = [s[i] for e, s in seen.items() if e <= fold and s[i].n]
        return bool(values) and min(v.low for v in values) < max(v.high for v in values)

    chosen = [[c for i, c in enumerate(features) if varies(i, f)] for f in range(splits)]
    shift = {c: sum(s[i].total or 0.0 for s in seen.values()) / max(1, sum(s[i].n for s in seen.values())) for i, c in enumerate(columns)}
    sets = list(dict.fromkeys([(), *map(tuple, chosen)]))
    versions = interpolated_versions(rows, columns, splits)
    versions = versions.select("since", "until", *[(F.col(c) - F.lit(float(shift[c]))).alias(c) for c in columns])
    sums = [F.array(*product_sums([F.col(c) for c in (*s, label)])).alias(f"s{i}") for i, s in enumerate(sets)]
    parts = versions.groupBy("since", "until").agg(*sums).collect()  # at most splits squared rows

    def fitted(fold: int, used: tuple[str, ...]):
        found = np.sum([p[f"s{sets.index(used)}"] for p in parts if p.since <= fold < p.until] or [[0.0] * len(product_sums([F.lit(0)] * (len(used) + 1)))], axis=0)
        return solve(Moments.of_sums(*read_sums(found, len(used) + 1), np.array([shift[c] for c in (*used, label)])), alpha)

    models, used = [], []
    for fold in range(splits):
        model, names = fitted(fold, tuple(chosen[fold])), chosen[fold]
        if not model.rows:  # no row is complete: the mean label
            model, names = fitted(fold, ()), []
        models.append(model)
        used.append(names)
    tested = rows.where("epoch > 0").withColumn("fold", F.col("epoch") - 1)
    guess = F.coalesce(*[F.when(F.col("fold") == f, ml.linear_prediction(m, names)) for f, (m, names) in enumerate(zip(models, used))])
    predictions = stage(tested.select("fold", *KEYS, F.col(label).alias("label"), guess.alias("prediction")), "predictions")
    fits = data.sparkSession.createDataFrame([(f, m.r2, m.rows) for f, m in enumerate(models)], "fold int, r2 double, n_train long")
    return Evaluation(_of_all_folds(fits, mt.fold_metrics(predictions, rounded_mae=rounded_mae)), predictions, models, used)


def _of_all_folds(folds: DataFrame, metrics: DataFrame) -> DataFrame:
    """A row for every fold, also for one without a labelled test row."""
    joined = F.broadcast(folds).join(metrics, "fold", "left")
    return joined.select(*metrics.columns, *[c for c in folds.columns if c != "fold"]).fillna(0, ["n_scored", "n_unscored"])


def _trees(data, features, label, splits, settings) -> Evaluation:
    """The forests of all folds are grown side by side: training rows are a prefix of the time
    order, so a row belongs to the folds from its epoch on and is held once. Missing values
    stay missing, no column is left out; one without a training value is never split on."""
    rows, _ = _positioned(data, features, label, splits)
    forests = fit_forests(rows, features, label, splits, KEYS, Settings(**{**ml.TREE_SETTINGS, **settings}))
    tested = rows.where("epoch > 0").withColumn("fold", F.col("epoch") - 1).withColumn("label", F.col(label))
    guesses = predict_forests(tested, forests, features, ["fold", *KEYS, "label"], "fold")
    predictions = stage(guesses, "predictions")
    folds = data.sparkSession.createDataFrame([(f,) for f in range(splits)], "fold int")
    return Evaluation(_of_all_folds(folds, mt.fold_metrics(predictions)), predictions, forests, [list(features)] * splits)


def network_parts(data: DataFrame, features: Sequence[str], label: str, test_size=0.2, seed=69) -> DataFrame:
    """Complete labelled rows, zero-based classes, hashed holdout, scaled by the training part."""
    rows = drop_null_lag(data) if any(c.startswith("ipc_lag_") for c in data.columns) else data
    rows = rows.select(*KEYS, *features, (F.col(label).cast("int") - 1).cast("double").alias("label")).dropna()
    split = stage(holdout_split(rows, KEYS, test_size, seed), "holdout")
    return ml.standard_scale(split, ml.scaling(split.where("role = 'train'"), features))


def _network(data, features, label, settings) -> Evaluation:
    """The network of the lowest held-out loss, scored every epoch. With ``iterations`` Spark ML's
    perceptron is fitted instead, scored after those numbers of iterations."""
    rows = stage(network_parts(data, features, label), "network-rows", "role")
    train, test = rows.where("role = 'train'"), rows.where("role = 'test'")
    if "iterations" in settings:
        choice = ml.select_by_holdout_loss(train, test, features, **settings)
        guesses = ml.predict_classes(choice.model, test, KEYS)
    else:
        choice = train_network(train, test, features, **{"weights": ml.CLASS_WEIGHTS, "units": ml.HIDDEN_UNITS, **settings})
        guesses = predict_network(choice.model, test, features, KEYS)
    predictions = stage(guesses.withColumn("fold", F.lit(0)), "predictions")
    return Evaluation(mt.fold_metrics(predictions), predictions.drop("fold"), [choice.model], [list(features)], choice.losses, NETWORK_CLASSES)
