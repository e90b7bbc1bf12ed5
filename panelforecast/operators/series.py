"""Monthly shares of topic tags and the features made from them.

Month tables are bounded by the calendar, so they may be broadcast and windowed
in one task; the facts are only ever aggregated by month.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelforecast.functions.columns import month_of


def _share(tag: str, weight: str | None) -> Column:
    value = F.col(tag).cast("double")
    if weight is None:
        return F.avg(value)
    known = F.when(value.isNotNull(), F.col(weight).cast("double"))
    return F.try_divide(F.sum(value * known), F.sum(known))


def monthly_topic_share(
    articles: DataFrame, tags: Sequence[str], date: str = "date", weight: str | None = None, out: str = "date"
) -> DataFrame:
    """Mean of every tag per month in one aggregate, missing tags skipped.

    ``weight`` says how many identical rows an article stands for, so that fan-out
    (copies of a text, several districts) need not be written out to be averaged.
    """
    return articles.groupBy(month_of(F.col(date)).alias(out)).agg(*[_share(t, weight).alias(t) for t in tags])


def smooth_and_lag(monthly: DataFrame, tags: Sequence[str], date: str = "date", size: int = 3, lag: int = 3) -> DataFrame:
    """Missing shares become 0, then the mean of ``size`` months, ``lag`` present months late."""
    w = Window.orderBy(date)
    frame = w.rowsBetween(-(lag + size - 1), -lag)

    def late(t: str) -> Column:
        return F.when(F.count(F.lit(1)).over(frame) == size, F.avg(F.coalesce(F.col(t), F.lit(0.0))).over(frame))

    return monthly.select(date, *[late(t).alias(t) for t in tags])


def monthly_series_features(
    articles: DataFrame, tags: Sequence[str], date: str = "date", weight: str | None = None
) -> DataFrame:
    return smooth_and_lag(monthly_topic_share(articles, tags, date, weight), tags)


def join_monthly(panel: DataFrame, series: DataFrame, tags: Sequence[str], date: str = "date") -> DataFrame:
    """Country-wide monthly series onto every row of the panel; nothing known counts as 0."""
    return panel.join(F.broadcast(series.select(date, *tags)), date, "left").fillna(0.0, subset=list(tags))
