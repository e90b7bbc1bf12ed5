"""Tables behind the analysis reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from panelforecast.operators import confidence as cf
from panelforecast.operators import regions as rg
from panelforecast.operators.places import count_by_district, gazetteer_of
from panelforecast.operators.series import monthly_topic_share
from panelforecast.sources.stages import stage

# The topics compared per score.
CLASS_REPORT_TAGS = [
    "hunger",
    "refugees",
    "Diplomacy",
    "Crisis",
    "Security",
    "Education",
    "International",
    "Media",
    "Leadership",
]


def articles_per_ipc(
    labels: DataFrame, articles: DataFrame, tags: Sequence[str] = CLASS_REPORT_TAGS, weight: str | None = None
) -> DataFrame:
    """Mean monthly topic share per score."""
    return rg.topic_share_by_class(labels, monthly_topic_share(articles, tags, weight=weight), tags)


def articles_per_region(
    articles: DataFrame, panel: DataFrame, top: int = 10, percent: float = 2.3, weight: str | None = None
) -> DataFrame:
    """Article counts and shares of the biggest regions, small ones merged."""
    counts = count_by_district(articles, gazetteer_of(panel), weight=weight)
    return rg.share_of_total(rg.fold_long_tail(rg.top_regions(counts, top), percent))


def confidence_report(confidence: DataFrame, points: int = 200, grid: int = cf.GRID) -> DataFrame:
    """Histogram, density and accuracy by range in one long table (part, low, high, value).

    The rows are read once, into sums per cell; all parts derive from these. Only where the
    density's bandwidth is narrower than a cell are they read once more, into finer cells.
    """
    cells = stage(cf.confidence_cells(confidence, grid=grid), "confidence-cells")
    histogram = cf.histogram_of(cells).select(
        F.lit("histogram").alias("part"), "low", "high", F.col("rows").cast("double").alias("value")
    )
    density = cf.density_of(cells, points, grid, cf.finer_cells(confidence)).select(
        F.lit("density").alias("part"), F.col("x").alias("low"), F.col("x").alias("high"), F.col("density").alias("value")
    )
    accuracy = cf.accuracy_of(cells).select(F.lit("accuracy").alias("part"), "low", "high", F.col("accuracy").alias("value"))
    return histogram.unionByName(density).unionByName(accuracy)
