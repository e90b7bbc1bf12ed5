"""Scores of a prediction table. Rows without a known label are never scored."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from panelforecast.functions.columns import round_half_even


def scored_rows(predictions: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return predictions.where(F.col(label).isNotNull() & F.col(prediction).isNotNull())


def mae(label: Column, prediction: Column, rounded: bool = False) -> Column:
    return F.avg(F.abs((round_half_even(prediction) if rounded else prediction) - label))


def accuracy(label: Column, prediction: Column) -> Column:
    return F.avg((label == prediction).cast("double"))


def r2_score(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """1 - residual / total sum of squares, the mean label found first."""
    rows = scored_rows(df, label, prediction)
    mean = rows.agg(F.avg(label)).scalar()
    residual = F.sum(F.pow(F.col(label) - F.col(prediction), 2))
    total = F.sum(F.pow(F.col(label) - mean, 2))
    return rows.agg((1 - residual / total).alias("r2"))


def class_counts(
    predictions: DataFrame, label: str = "label", prediction: str = "prediction", by: Sequence[str] = ()
) -> DataFrame:
    """Rows per (label, prediction): the small table that all class scores derive from."""
    pairs = scored_rows(predictions, label, prediction).select(
        *by, F.col(label).cast("int").alias("label"), F.col(prediction).cast("int").alias("prediction")
    )
    return pairs.groupBy(*by, "label", "prediction").agg(F.count(F.lit(1)).alias("rows"))


def confusion_matrix(
    predictions: DataFrame,
    classes: Sequence[int] = (0, 1, 2, 3, 4),
    label: str = "label",
    prediction: str = "prediction",
) -> DataFrame:
    """Dense counts over the listed classes and all others that occur; zero where a pair never does.

    Every scored row is in one cell. The counts per pair, at most the square of the
    number of classes, are laid out in one row.
    """
    counts = class_counts(predictions, label, prediction)
    laid = counts.agg(F.collect_list(F.struct("label", "prediction", "rows")).alias("cells"))
    seen = F.array_union(F.transform("cells", lambda c: c["label"]), F.transform("cells", lambda c: c["prediction"]))
    listed = F.array(*[F.lit(int(c)) for c in classes]).cast("array<int>")
    laid = laid.withColumn("classes", F.array_union(listed, seen))
    grid = laid.select("cells", "classes", F.explode("classes").alias("label")).select(
        "cells", "label", F.explode("classes").alias("prediction")
    )
    mine = F.filter("cells", lambda c: (c["label"] == F.col("label")) & (c["prediction"] == F.col("prediction")))
    return grid.select("label", "prediction", F.coalesce(F.get(mine, F.lit(0))["rows"], F.lit(0).cast("long")).alias("rows"))


def class_scores(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Support, predicted count, hits and F1 per class that occurs on either side."""
    sides = F.array(
        F.struct(
            F.col("label").alias("class"),
            F.col("rows").alias("support"),
            F.lit(0).cast("long").alias("predicted"),
            F.lit(0).cast("long").alias("hits"),
        ),
        F.struct(
            F.col("prediction").alias("class"),
            F.lit(0).cast("long").alias("support"),
            F.col("rows").alias("predicted"),
            F.when(F.col("label") == F.col("prediction"), F.col("rows")).otherwise(0).alias("hits"),
        ),
    )
    per_class = counts.select(*by, F.inline(sides)).groupBy(*by, "class").agg(
        F.sum("support").alias("support"), F.sum("predicted").alias("predicted"), F.sum("hits").alias("hits")
    )
    f1 = F.coalesce(F.try_divide(2.0 * F.col("hits"), F.col("support") + F.col("predicted")), F.lit(0.0))
    return per_class.withColumn("f1", f1)


def weighted_f1(
    predictions: DataFrame, label: str = "label", prediction: str = "prediction", by: Sequence[str] = ()
) -> DataFrame:
    """Mean of the class F1 scores, weighted by how often each class is true."""
    scores = class_scores(class_counts(predictions, label, prediction, by), by)
    value = F.sum(F.col("f1") * F.col("support")) / F.sum("support")
    return scores.groupBy(*by).agg(value.alias("weighted_f1"))


def weighted_log_loss(label: Column, probability: Column, weights: Sequence[float], floor: float = 1e-15) -> Column:
    """Cross-entropy with one weight per class, divided by the total weight."""
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), label + 1)
    chance = F.greatest(F.element_at(probability, label + 1), F.lit(floor))
    return F.sum(weight * -F.log(chance)) / F.sum(weight)


def fold_metrics(
    predictions: DataFrame, by: str = "fold", label: str = "label", prediction: str = "prediction", rounded_mae: bool = True
) -> DataFrame:
    """MAE, accuracy and weighted F1 per fold, and how many labelled rows got no prediction.

    ``prediction`` is the unrounded value; class scores always use the rounded one.
    """
    known = predictions.where(F.col(label).isNotNull()).withColumn("_class", round_half_even(F.col(prediction)))
    basic = known.groupBy(by).agg(
        mae(F.col(label), F.col(prediction), rounded_mae).alias("mae"),
        F.avg(F.when(F.col("_class").isNotNull(), (round_half_even(F.col(label)) == F.col("_class")).cast("double"))).alias("accuracy"),
        F.count("_class").alias("n_scored"),
        F.count_if(F.col("_class").isNull()).alias("n_unscored"),
    )
    return basic.join(weighted_f1(known, label, "_class", by=[by]), by, "left")


def mean_over_folds(metrics: DataFrame, columns: Sequence[str]) -> DataFrame:
    return metrics.agg(*[F.avg(c).alias(f"mean_{c}") for c in columns])
