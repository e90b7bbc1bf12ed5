"""From panel and corpus to model-ready datasets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from panelforecast.functions.columns import text_key
from panelforecast.operators import topics as tp
from panelforecast.operators.panel import LagSpec, drop_null_lag, lag_features, trim_to_first_label
from panelforecast.operators.places import gazetteer_of, map_articles, with_district_weight
from panelforecast.operators.series import join_monthly, monthly_series_features
from panelforecast.operators.tags import attach_tags, tag_by_topic
from panelforecast.sources.stages import stage

# Lags, columns and tags of the two datasets, in output order.
STANDARD_LAGS = [
    LagSpec("count_violence", 3, rolling=6),
    LagSpec("ndvi_anom", 3, rolling=6),
    LagSpec("food_price_idx", 3, rolling=6, difference=True),
    LagSpec("ipc", 1, dropna=True),
    LagSpec("ipc", 2, dropna=True),
    LagSpec("ipc", 3, dropna=True),
]
STANDARD_TAGS = ["hunger", "refugees", "conflict", "humanitarian"]

IMPROVED_LAGS = [
    LagSpec("count_violence", 3, rolling=6),
    LagSpec("ndvi_anom", 3, rolling=6),
    LagSpec("ruggedness_mean", 3, rolling=6),
    LagSpec("pop", 3, rolling=6),
    LagSpec("cropland_pct", 3, rolling=6),
    LagSpec("sum_fatalities", 3, rolling=6),
    LagSpec("et_anom", 3, rolling=6),
    LagSpec("rain_anom", 3, rolling=6),
    LagSpec("food_price_idx", 3, rolling=6, difference=True),
    LagSpec("ipc", 1, dropna=True),
]
IMPROVED_TAGS = ["hunger", "refugees", "humanitarian", "conflict", *tp.EXTRA_TAGS]

STANDARD_FEATURES = [*[s.name for s in STANDARD_LAGS], *STANDARD_TAGS]
IMPROVED_FEATURES = [*[s.name for s in IMPROVED_LAGS], *IMPROVED_TAGS]


def feature_names(features: str) -> list[str]:
    """Feature columns of a dataset without the constant."""
    try:
        return {"Standard": STANDARD_FEATURES, "Improved": IMPROVED_FEATURES}[features]
    except KeyError:
        raise ValueError(f"features must be 'Standard' or 'Improved', not {features!r}") from None


def corpus_similarity(corpus: DataFrame, tag_keywords: Mapping[str, Sequence[str]], topic: str = "topic") -> DataFrame:
    """Similarity of every topic of the corpus with every keyword of the tags."""
    keywords = [k for words in tag_keywords.values() for k in words]
    return tp.keyword_similarity(tp.class_tfidf(corpus, topic), keywords)


def tag_corpus(
    corpus: DataFrame,
    tag_keywords: Mapping[str, Sequence[str]],
    top_n: int = 10,
    final_n: int = 10,
    topic: str = "topic",
) -> DataFrame:
    """Boolean tags on a corpus whose documents already have a topic."""
    similarity = corpus_similarity(corpus, tag_keywords, topic)
    chosen = tp.relevant_topics_by_tag(similarity, tag_keywords, top_n, final_n)
    return tag_by_topic(corpus, chosen, list(tag_keywords), topic)


def article_features(
    corpus: DataFrame,
    tag_keywords: Mapping[str, Sequence[str]],
    fanout: bool = True,
    top_n: int = 10,
    final_n: int = 10,
    topic: str = "topic",
) -> DataFrame:
    """Tags and ``copies`` (how often the join on text repeats the row) per article, without its text.

    The text is read once for its words and once for its digest. Without ``fanout``
    every article keeps exactly its own tags.
    """
    similarity = corpus_similarity(corpus, tag_keywords, topic)
    chosen = tp.relevant_topics_by_tag(similarity, tag_keywords, top_n, final_n)
    tags = list(tag_keywords)
    if not fanout:
        tagged = tag_by_topic(corpus.drop("text"), chosen, tags, topic)
        return tagged.withColumn("copies", F.lit(1).cast("long"))
    slim = stage(corpus.withColumn("text_key", text_key(F.col("text"))).drop("text"), "corpus-keys")
    tagged = tag_by_topic(slim, chosen, tags, topic)
    return attach_tags(slim, tagged, tags, text_key_column="text_key").drop("text_key")


def districted_articles(articles: DataFrame, panel: DataFrame) -> DataFrame:
    """Articles mapped to districts, those that match none to all of them, text dropped."""
    slim = articles.drop("text", "lat", "lng")
    return map_articles(slim, gazetteer_of(panel), fallback="all")


def weighted_articles(articles: DataFrame, panel: DataFrame, features: str) -> DataFrame:
    """Articles without text, with ``_weight``: the rows each one stands for in the monthly shares."""
    slim = articles.drop("text", "lat", "lng")
    copies = F.col("copies") if "copies" in articles.columns else F.lit(1)
    if features == "Standard":
        return slim.withColumn("_weight", copies)
    return with_district_weight(slim, gazetteer_of(panel)).withColumn("_weight", copies * F.col("districts"))


def prepare_dataset(panel: DataFrame, articles: DataFrame, features: str = "Standard") -> DataFrame:
    """Key, constant, features and label of one dataset.

    ``panel`` is keyed by (date, district); ``articles`` has a date, a boolean per tag,
    for "Improved" a location, and optionally ``copies``. Fan-out over copies and
    districts enters the monthly shares as a weight and is never written out.
    """
    names = feature_names(features)
    lags, tags = (STANDARD_LAGS, STANDARD_TAGS) if features == "Standard" else (IMPROVED_LAGS, IMPROVED_TAGS)
    series = monthly_series_features(weighted_articles(articles, panel, features), tags, weight="_weight")

    columns = ["date", "district", "ipc", *{s.column: None for s in lags if s.column != "ipc"}]
    lagged = lag_features(panel.select(*columns), lags)
    known = join_monthly(trim_to_first_label(lagged, "ipc", source=panel), series, tags)
    if features == "Improved":
        known = drop_null_lag(known, "ipc_lag_1")
    return known.select("date", "district", F.lit(1.0).alias("const"), *names, "ipc")
