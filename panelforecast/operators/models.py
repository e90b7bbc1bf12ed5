"""Model steps: linear, ridge, boosted trees and a small neural classifier."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from fractions import Fraction
from typing import Any

import numpy as np
from pyspark import inheritable_thread_target

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from panelforecast.functions.distributions import f_tail, t_quantile
from panelforecast.operators.boosting import Forest, Settings, fit_forests, predict_forests
from panelforecast.operators.least_squares import LinearFit, moments, solve
from panelforecast.operators.metrics import weighted_log_loss
from panelforecast.sources.stages import stage

# Settings of the four models.
RIDGE_ALPHA = 3.0
TREE_SETTINGS = {"maxDepth": 4, "stepSize": 0.02, "subsamplingRate": 0.7, "columnRate": 0.7, "maxIter": 100}
CLASS_WEIGHTS = [1.0, 1.0, 2.0, 2.0, 2.0]
HIDDEN_UNITS = 64
CLASSES = 5

# Rows are never repeated more often than this.
MOST_REPEATS = 100
# Iterations after which the network is scored.
LOSS_STEPS = (25, 50, 100)


def add_intercept(df: DataFrame, features: Sequence[str], skip_if_constant: bool = False) -> DataFrame:
    """Constant column of ones. ``skip_if_constant`` leaves the data alone when a feature
    is already one non-zero constant, at the price of a pass over the data."""
    if skip_if_constant:
        constant = F.array(
            *[(F.min(c) == F.max(c)) & (F.min(c) != 0) & (F.count(c) == F.count(F.lit(1))) for c in features]
        )
        if any(df.agg(constant).first()[0]):
            return df
    return df.withColumn("const", F.lit(1.0))


def fit_ols(train: DataFrame, features: Sequence[str], label: str = "ipc") -> LinearFit:
    """Ordinary least squares on the complete rows, of any rank: two aggregates, nothing else moves.

    Collinear columns get the shortest solution, the pseudo-inverse's. Without a complete row
    the intercept is null and predicts nothing.
    """
    return solve(moments(train, features, label))


def fit_ridge(train: DataFrame, features: Sequence[str], label: str = "ipc", alpha: float = RIDGE_ALPHA) -> LinearFit:
    """Ridge with the penalty ``alpha * |b|^2`` on the plain sum of squares, intercept free."""
    return solve(moments(train, features, label), alpha)


def linear_prediction(model: LinearFit, features: Sequence[str]) -> Column:
    """The fitted line as a plain expression: a missing feature gives a missing prediction."""
    terms = (F.lit(float(b)) * F.col(c) for b, c in zip(model.coefficients, features))
    total = F.lit(model.intercept).cast("double")
    for term in terms:
        total = total + term
    return total


def ols_coefficients(model: LinearFit, features: Sequence[str], spark: SparkSession, level: float = 0.95) -> DataFrame:
    """Coefficient table: one row per feature and one for the intercept, with confidence bounds.

    Errors, t and p are those of the shortest solution where columns are collinear. Without a
    degree of freedom left they are null; a coefficient without error has t and p null.
    """
    free = model.df_resid
    line = np.array([*model.coefficients, math.nan if model.intercept is None else model.intercept])
    spans = np.diagonal(model.covariance)
    errors = np.sqrt(np.append(spans[1:], spans[0]) * model.squared_errors / free) if free > 0 else np.full(len(line), math.nan)
    reach = t_quantile(level, free) if free > 0 else math.nan
    rows = []
    for name, b, error in zip([*features, "const"], line.tolist(), errors.tolist()):
        t = b / error if error > 0 else math.nan
        p = f_tail(t * t, 1, free) if error > 0 else math.nan
        rows.append((name, *[None if math.isnan(v) else v for v in (b, error, t, p, b - reach * error, b + reach * error)]))
    return spark.createDataFrame(rows, "term string, coef double, std_err double, t double, p double, low double, high double")


def ols_summary(
    train: DataFrame, features: Sequence[str], label: str = "ipc", order: Sequence[str] = ("date", "district")
) -> tuple[DataFrame, DataFrame]:
    """(coefficient table, one-row fit statistics) of an OLS fit.

    Durbin-Watson needs each residual's predecessor in time; the rows are cut into
    ranges of ``order`` and only the last residual of each range is passed on.
    Degrees of freedom count the rank, not the columns. The omnibus test adds up the squares of
    the normal scores of skewness and kurtosis; it is null below 8 rows, where they have none.
    """
    spark = train.sparkSession
    rows = stage(train.select(*order, *features, label).dropna(), "ols-rows")
    model = fit_ols(rows, features, label)
    residuals = rows.select(*order, (F.col(label) - linear_prediction(model, features)).alias("e"), F.col(label).alias("y"))
    e = F.col("e")
    fit = residuals.agg(
        F.count(F.lit(1)).alias("n_obs"),
        F.sum(e * e).alias("ssr"),
        F.var_pop("y").alias("var_y"),
        F.skewness("e").alias("skew"),
        (F.kurtosis("e") + 3).alias("kurtosis"),
    )
    free, used = F.lit(model.df_resid), F.lit(model.df_model)
    n, ssr = F.col("n_obs").cast("double"), F.col("ssr")
    loglik = -n / 2 * (F.log(2 * F.pi()) + F.log(F.try_divide(ssr, n)) + 1)
    r2 = 1 - F.try_divide(ssr, F.col("var_y") * n)
    fit = fit.select(
        "n_obs",
        free.cast("long").alias("df_resid"),
        used.cast("int").alias("df_model"),
        r2.alias("r2"),
        (1 - (1 - r2) * F.try_divide(n - 1, free)).alias("r2_adj"),
        F.try_divide(F.try_divide(r2, used), F.try_divide(1 - r2, free)).alias("f_statistic"),
        loglik.alias("log_likelihood"),
        (-2 * loglik + 2 * (used + 1)).alias("aic"),
        (-2 * loglik + F.log(n) * (used + 1)).alias("bic"),
        "skew",
        "kurtosis",
        (n / 6 * (F.pow("skew", F.lit(2)) + F.pow(F.col("kurtosis") - 3, F.lit(2)) / 4)).alias("jarque_bera"),
        _durbin_watson(residuals, order).alias("durbin_watson"),
        F.lit(model.condition).alias("condition_number"),
        F.when(F.col("n_obs") >= 8, omnibus(n, F.col("skew"), F.col("kurtosis"))).alias("omnibus"),
    )
    tails = {"jarque_bera_prob": F.exp(-F.col("jarque_bera") / 2), "omnibus_prob": F.exp(-F.col("omnibus") / 2), "f_prob": F.lit(_f_prob(model)).cast("double")}
    return ols_coefficients(model, features, spark), fit.withColumns(tails)


def _f_prob(model: LinearFit) -> float | None:
    if model.df_resid <= 0 or model.df_model == 0:
        return None
    if model.r2 >= 1:
        return 0.0
    return f_tail(model.r2 / model.df_model / ((1 - model.r2) / model.df_resid), model.df_model, model.df_resid)


def omnibus(n: Column, skew: Column, kurtosis: Column) -> Column:
    """The normality statistic of D'Agostino and Pearson, chi-squared with two degrees of freedom."""
    return F.pow(skew_score(n, skew), F.lit(2)) + F.pow(kurtosis_score(n, kurtosis), F.lit(2))


def skew_score(n: Column, skew: Column) -> Column:
    """D'Agostino's transformation of a sample's skewness to a normal score."""
    y = skew * F.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    b2 = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = F.sqrt(2 * (b2 - 1)) - 1
    return F.asinh(y / F.sqrt(2 / (w2 - 1))) / F.sqrt(F.log(w2) / 2)


def kurtosis_score(n: Column, kurtosis: Column) -> Column:
    """Anscombe and Glynn's transformation of a sample's kurtosis (3 for a normal one) to a normal score."""
    spread = 24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))
    x = (kurtosis - 3 * (n - 1) / (n + 1)) / F.sqrt(spread)
    third = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * F.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6 + 8 / third * (2 / third + F.sqrt(1 + 4 / (third * third)))
    ratio = (1 - 2 / a) / (1 + x * F.sqrt(2 / (a - 4)))
    root = F.signum(ratio) * F.pow(F.abs(ratio), F.lit(1 / 3))
    return (1 - 2 / (9 * a) - root) / F.sqrt(2 / (9 * a))


def _durbin_watson(residuals: DataFrame, order: Sequence[str]) -> Column:
    ranged = (
        residuals.select(*order, "e")
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_task", F.spark_partition_id())
    )
    ranged = stage(ranged, "residuals")
    w = Window.partitionBy("_task").orderBy(*order)
    inner = ranged.withColumn("_before", F.lag("e").over(w)).agg(F.sum(F.pow(F.col("e") - F.col("_before"), 2)))
    here = F.struct(*order)
    ends = ranged.groupBy("_task").agg(F.min_by("e", here).alias("first"), F.max_by("e", here).alias("last"))
    joints = ends.withColumn("_before", F.lag("last").over(Window.orderBy("_task")))
    across = joints.agg(F.sum(F.pow(F.col("first") - F.col("_before"), 2)))
    total = ranged.agg(F.sum(F.col("e") * F.col("e")))
    steps = F.coalesce(inner.scalar(), F.lit(0.0)) + F.coalesce(across.scalar(), F.lit(0.0))
    return F.try_divide(steps, total.scalar())


def fit_trees(train: DataFrame, features: Sequence[str], label: str = "ipc", key: Sequence[str] | None = None, **settings) -> tuple[Forest, list[str]]:
    """Boosted trees, the same for the same rows and seed, whatever order and partitions they come in.

    Missing values are known as such: every split learns the side they go to. ``key`` names the
    columns that tell rows apart (``date`` and ``district`` where the table has them).
    """
    if key is None and {"date", "district"} <= set(train.columns):
        key = ["date", "district"]
    rows = train.withColumn("epoch", F.lit(0))
    return fit_forests(rows, features, label, 1, key, Settings(**{**TREE_SETTINGS, **settings}))[0], list(features)


def predict_trees(model: Forest, df: DataFrame, features: Sequence[str], keys: Sequence[str], label: str = "ipc") -> DataFrame:
    rows = df.select(*keys, *[c for c in features if c not in keys], F.col(label).alias("label"))
    return predict_forests(rows, [model], features, [*keys, "label"])


def scaling(train: DataFrame, features: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and population standard deviation per feature; a constant feature divides by 1."""
    stats = train.agg(*[F.avg(c).alias(f"m_{c}") for c in features], *[F.stddev_pop(c).alias(f"s_{c}") for c in features]).first()
    return {c: (stats[f"m_{c}"], stats[f"s_{c}"] or 1.0) for c in features}


def standard_scale(df: DataFrame, scale: Mapping[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: (F.col(c) - F.lit(m)) / F.lit(s) for c, (m, s) in scale.items()})


def whole_repeats(weights: Sequence[float], most: int = MOST_REPEATS) -> list[int]:
    """The smallest whole numbers in the proportions of ``weights``.

    Raises ``ValueError`` for negative weights, for none above zero, and where the
    proportions need a number beyond ``most``.
    """
    parts = [Fraction(float(w)).limit_denominator(1000) for w in weights]
    exact = all(abs(float(p) - float(w)) < 1e-9 for p, w in zip(parts, weights))
    if not exact or min(parts, default=0) < 0 or not any(parts):
        raise ValueError(f"class weights {list(weights)} are no proportions of whole numbers")
    common = math.lcm(*[p.denominator for p in parts])
    whole = [int(p * common) for p in parts]
    whole = [w // math.gcd(*whole) for w in whole]
    if max(whole) > most:
        raise ValueError(f"class weights {list(weights)} would repeat rows more than {most} times")
    return whole


def repeat_by_class_weight(df: DataFrame, label: str, weights: Sequence[float] = CLASS_WEIGHTS) -> DataFrame:
    """Repeat rows in the proportions of their class weights: the same loss for a learner
    without weights. A class of weight zero is left out."""
    times = F.element_at(F.array(*[F.lit(w) for w in whole_repeats(weights)]), F.col(label).cast("int") + 1)
    return df.withColumn("_copy", F.explode(F.array_repeat(F.lit(1), times))).drop("_copy")


def fit_network(
    train: DataFrame,
    features: Sequence[str],
    label: str = "label",
    max_iter: int = 200,
    seed: int = 69,
    weights: Sequence[float] = CLASS_WEIGHTS,
    start: PipelineModel | None = None,
) -> PipelineModel:
    """One hidden layer of 64 units on scaled features, class weights by repetition.

    ``start`` is a fitted network to go on from.
    """
    network = MultilayerPerceptronClassifier(
        labelCol=label, layers=[len(features), HIDDEN_UNITS, CLASSES], maxIter=max_iter, seed=seed, blockSize=64
    )
    if start is not None:
        network = network.setInitialWeights(start.stages[-1].weights)
    assemble = VectorAssembler(inputCols=list(features), outputCol="features")
    return Pipeline(stages=[assemble, network]).fit(repeat_by_class_weight(train, label, weights))


def predict_classes(model: PipelineModel, df: DataFrame, keys: Sequence[str], label: str = "label") -> DataFrame:
    return model.transform(df).select(
        *keys,
        F.col(label).cast("int").alias("label"),
        F.col("prediction").cast("int").alias("prediction"),
        vector_to_array("probability").alias("probability"),
    )


def fit_side_by_side(spark: SparkSession, fit: Callable[[Any], Any], settings: Sequence[Any], parallelism: int = 5) -> list[Any]:
    """Run independent fits from a few driver threads, as Spark ML's cross validator does.

    Small folds leave most of a cluster idle; the scheduler shares it among the jobs.
    """
    with ThreadPoolExecutor(max_workers=max(1, min(parallelism, len(settings)))) as pool:
        return list(pool.map(inheritable_thread_target(spark)(fit), settings))


@dataclass
class Selection:
    model: PipelineModel
    losses: DataFrame
    best: dict


def select_by_holdout_loss(
    train: DataFrame,
    holdout: DataFrame,
    features: Sequence[str],
    label: str = "label",
    iterations: Sequence[int] = LOSS_STEPS,
    seeds: Sequence[int] = (69,),
    weights: Sequence[float] = CLASS_WEIGHTS,
) -> Selection:
    """Fit on, score both parts after each of ``iterations``, keep the lowest held-out loss.

    A seed's network is fitted once: every step goes on from the weights of the one
    before, so the loss curve costs no more than its last point. ``losses`` has one row
    per seed and step; of equal losses the earliest is kept.
    """
    loss = weighted_log_loss(F.col("label"), F.col("probability"), weights)

    def curve(seed: int) -> list[tuple[PipelineModel, tuple]]:
        points, model, done = [], None, 0
        for step in sorted(set(iterations)):
            model, done = fit_network(train, features, label, step - done, seed, weights, model), step
            scores = [predict_classes(model, part, [], label).agg(loss).first()[0] for part in (train, holdout)]
            points.append((model, (step, seed, *scores)))
        return points

    points = [p for curves in fit_side_by_side(train.sparkSession, curve, list(seeds)) for p in curves]
    model, best = min(points, key=lambda p: math.inf if p[1][3] is None else p[1][3])
    losses = train.sparkSession.createDataFrame(
        [row for _, row in points], "max_iter int, seed int, train_loss double, test_loss double"
    )
    return Selection(model, losses, {"max_iter": best[0], "seed": best[1]})
