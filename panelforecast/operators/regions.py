"""Article counts per region and per label class."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

OTHER = "Other regions"


def count_per_region(mapped: DataFrame, region: str = "district", weight: str | None = None) -> DataFrame:
    """Articles per region; ``weight`` says how many rows one stands for."""
    rows = F.sum(weight) if weight else F.count(F.lit(1))
    return mapped.groupBy(region).agg(rows.alias("count"))


def top_regions(counts: DataFrame, n: int = 10, region: str = "district") -> DataFrame:
    return counts.orderBy(F.desc("count"), region).limit(n)


def fold_long_tail(top: DataFrame, percent: float = 2.3, region: str = "district") -> DataFrame:
    """Merge the regions strictly below ``percent`` of the listed total.

    ``top`` is a top-n list, so the window over all of it sees n rows.
    """
    threshold = F.sum(F.col("count") / 100 * percent).over(Window.partitionBy())
    name = F.when(F.col("count") < threshold, OTHER).otherwise(F.col(region))
    return top.select(name.alias(region), "count").groupBy(region).agg(F.sum("count").alias("count"))


def share_of_total(counts: DataFrame, region: str = "district") -> DataFrame:
    total = counts.agg(F.sum("count")).scalar()
    return counts.select(region, "count", (100.0 * F.col("count") / total).alias("share_pct"))


def topic_share_by_class(
    labels: DataFrame, monthly: DataFrame, tags: Sequence[str], label: str = "ipc", date: str = "date"
) -> DataFrame:
    """Mean monthly share of every tag per label class; ``monthly`` is one row per month."""
    known = labels.where(F.col(label).isNotNull()).select(date, label)
    joined = known.join(F.broadcast(monthly.select(date, *tags)), date, "left")
    return joined.groupBy(label).agg(*[F.avg(t).alias(t) for t in tags])
