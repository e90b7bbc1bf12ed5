"""Topics of a corpus: assignment, describing terms, and their relation to keywords."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import HashingTF, IDF, Normalizer, RegexTokenizer, StopWordsRemover
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from panelforecast.functions.columns import TOKEN_PATTERN, tokens
from panelforecast.operators.joins import lookup_join, measured_bytes
from panelforecast.sources.stages import drop_stage, stage
from panelforecast.sources.tables import fill_cores, in_fixed_order

# Tags and the keywords whose topics they stand for.
BASE_TAG_KEYWORDS = {
    "hunger": ["hunger", "food insecurity"],
    "refugees": ["refugees", "displaced"],
    "humanitarian": ["humanitarian"],
    "conflict": ["conflict", "fighting", "murder"],
}

# One-keyword tags of the extended set.
EXTRA_TAGS = [
    "Governance",
    "Diplomacy",
    "Crisis",
    "Security",
    "Society",
    "Health",
    "Development",
    "Education",
    "Survival",
    "International",
    "Opposition",
    "Welfare",
    "Media",
    "Leadership",
]

ALL_TAG_KEYWORDS = {**BASE_TAG_KEYWORDS, **{t: [t] for t in EXTRA_TAGS}}


# Tasks of a clustering. Centres are drawn task by task, so it must not follow the cluster or the data.
TOPIC_PARTS = 32
# Topic centres that travel to the queries as one value.
SHARE_BYTES = 8 * 1024 * 1024


def _word_stages(text: str, features: int) -> PipelineModel:
    return PipelineModel(
        [
            RegexTokenizer(inputCol=text, outputCol="_tokens", pattern=TOKEN_PATTERN, gaps=False),
            StopWordsRemover(inputCol="_tokens", outputCol="_words"),
            HashingTF(inputCol="_words", outputCol="_tf", numFeatures=features),
        ]
    )


def _counted(corpus: DataFrame, words: PipelineModel, text: str) -> DataFrame:
    """The corpus with the counts of its words and a hash of the text in place of the text.

    Texts are tokenized once, where they are, and do not move: every later step reads this stage.
    """
    rows = words.transform(fill_cores(corpus).na.fill("", [text])).withColumn("_order", F.xxhash64(text))
    return stage(rows.select(*[c for c in corpus.columns if c != text], "_order", "_tf"), "word-counts")


def _fit_counted(counted: DataFrame, k: int, seed: int, parts: int) -> list:
    idf = IDF(inputCol="_tf", outputCol="_tfidf").fit(counted)
    unit = Normalizer(inputCol="_tfidf", outputCol="_unit")
    dealt = counted.select("_order", "_tf").repartition(parts, "_order").sortWithinPartitions("_order").select("_tf")
    # the solver for sparse rows keeps the rows itself, in memory and on disk; asking for it spares a look at all rows
    kmeans = KMeans(featuresCol="_unit", predictionCol="topic", k=k, seed=seed, solver="row")
    return [idf, unit, kmeans.fit(unit.transform(idf.transform(dealt)))]


def fit_topics(
    corpus: DataFrame, text: str = "text", k: int = 50, features: int = 1 << 14, seed: int = 69, parts: int = TOPIC_PARTS
) -> PipelineModel:
    """Topic model: hashed TF-IDF of the whole text, KMeans on unit vectors.

    The same texts and seed give the same topics: the texts' counts are dealt by a hash of the text to
    ``parts`` tasks and sorted there, on any cluster and at any size.

    Distances between unit vectors order like cosines, and a text without words is a
    legal zero vector. Hashing keeps the vocabulary off the driver; the model's size is k x features.
    """
    words = _word_stages(text, features)
    counted = _counted(corpus.select(text), words, text)
    model = PipelineModel([*words.stages, *_fit_counted(counted, k, seed, parts)])
    drop_stage(counted)
    return model


def assign_topics(
    model: PipelineModel, corpus: DataFrame, text: str = "text", outlier_distance: float | None = None
) -> DataFrame:
    """One ``topic`` per document; -1 beyond ``outlier_distance`` (cosine) from its centre."""
    return _scored(model.stages, fill_cores(corpus).na.fill("", [text]), outlier_distance)


def _scored(stages: list, rows: DataFrame, outlier_distance: float | None) -> DataFrame:
    helpers = [s.getOutputCol() for s in stages if s.hasParam("outputCol")]
    scored = PipelineModel(stages).transform(rows)
    if outlier_distance is not None:
        scored = _with_outliers(scored, stages[-1], "_unit", outlier_distance)
    return scored.drop(*helpers)


def own_topics(
    corpus: DataFrame, text: str = "text", k: int = 50, features: int = 1 << 14, seed: int = 69, outlier_distance: float | None = None
) -> DataFrame:
    """The corpus, without its text, with the topics that ``fit_topics`` finds in it and ``assign_topics`` gives it.

    Fit and assignment share one reading of the texts.
    """
    counted = _counted(corpus, _word_stages(text, features), text)
    return _scored(_fit_counted(counted, k, seed, TOPIC_PARTS), counted, outlier_distance).drop("_order", "_tf")


def _with_outliers(scored: DataFrame, kmeans, features: str, outlier_distance: float) -> DataFrame:
    """Topic -1 where the cosine distance to the topic's centre is too large.

    Centres are a table of one row per topic that is looked up by topic; the product
    runs over the words a text has. A text without words keeps its topic.
    """
    found = kmeans.clusterCenters()
    listed = {"topic": pa.array(range(len(found)), pa.int32()), "_norm": [float((c @ c) ** 0.5) for c in found], "_centre": pa.array(found)}
    centres = scored.sparkSession.createDataFrame(pa.table(listed))
    joined = lookup_join(scored, centres, "topic", "left", spread_by=features)
    unit = F.unwrap_udt(F.col(features))
    terms = F.zip_with(unit["indices"], unit["values"], lambda i, x: x * F.get("_centre", i))
    near = F.try_divide(F.aggregate(terms, F.lit(0.0), lambda s, x: s + x), F.col("_norm"))
    far = (F.size(unit["indices"]) > 0) & (1 - near > outlier_distance)
    return joined.withColumn("topic", F.when(far, F.lit(-1)).otherwise(F.col("topic"))).drop("_norm", "_centre")


def fit_vector_topics(vectors: DataFrame, vector: str = "embedding", k: int = 10, seed: int = 69):
    """KMeans over given document vectors, for corpora that come with embeddings."""
    rows = in_fixed_order(vectors.select(F.col(vector).cast("array<double>").alias("_unit")), TOPIC_PARTS)
    rows = rows.select(array_to_vector("_unit").alias("_unit"))
    return KMeans(featuresCol="_unit", predictionCol="topic", k=k, seed=seed).fit(rows)


def assign_vector_topics(model, vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    rows = vectors.withColumn("_unit", array_to_vector(F.col(vector).cast("array<double>")))
    return model.transform(rows).drop("_unit")


def cosine(a: Column, b: Column) -> Column:
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    norm_a = F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))
    norm_b = F.sqrt(F.aggregate(b, F.lit(0.0), lambda s, x: s + x * x))
    return F.try_divide(dot, norm_a * norm_b)


def class_tfidf(docs: DataFrame, topic: str = "topic", text: str = "text") -> DataFrame:
    """Class-based TF-IDF: tf(term, topic) * ln(1 + words per topic / tf(term)).

    Words are counted before they move, and the counts are staged so that the texts
    are read once. A term of every topic is a hot key of the join with the totals, which
    ``lookup_join`` broadcasts or spreads.
    """
    slim = fill_cores(docs.select(F.col(topic).alias("topic"), F.col(text).alias("text")))
    words = slim.select("topic", F.explode(tokens(F.col("text"))).alias("term"))
    counts = stage(words.groupBy("topic", "term").agg(F.count(F.lit(1)).alias("tf")), "term-counts")
    per_topic = counts.groupBy("topic").agg(F.sum("tf").alias("words"))
    average = per_topic.agg(F.avg("words")).scalar()
    totals = counts.groupBy("term").agg(F.sum("tf").alias("total"))
    joined = lookup_join(counts, totals, "term", "inner", spread_by="topic")
    return joined.select("topic", "term", "tf", "total", (F.col("tf") * F.log1p(average / F.col("total"))).alias("weight"))


def keyword_similarity(weights: DataFrame, keywords: Sequence[str]) -> DataFrame:
    """Cosine of every topic with every keyword in term space.

    A keyword is the vector of its words. One aggregate per topic computes its norm
    and all dot products together.
    """
    keywords = list(dict.fromkeys(keywords))
    words = {k: sorted(set(re.findall(r"\w{2,}", k.lower()))) for k in keywords}

    def dot(k: str) -> Column:
        hits = F.coalesce(F.sum(F.when(F.col("term").isin(words[k]), F.col("weight"))), F.lit(0.0))
        return F.struct(F.lit(k).alias("keyword"), (hits / F.lit(max(len(words[k]), 1) ** 0.5)).alias("dot"))

    per_topic = weights.groupBy("topic").agg(
        F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"), F.array(*[dot(k) for k in keywords]).alias("dots")
    )
    return per_topic.select("topic", "norm", F.explode("dots").alias("d")).select(
        F.col("d.keyword").alias("keyword"), "topic", (F.col("d.dot") / F.col("norm")).alias("similarity")
    )


def topic_vectors(vectors: DataFrame, topic: str = "topic", vector: str = "embedding") -> DataFrame:
    """Mean vector per topic; one vector per topic and task is shuffled."""
    rows = vectors.select(F.col(topic).alias("topic"), array_to_vector(F.col(vector).cast("array<double>")).alias("_v"))
    return rows.groupBy("topic").agg(vector_to_array(Summarizer.mean(F.col("_v"))).alias("centre"))


def vector_similarity(
    queries: DataFrame, centres: DataFrame, key: str, vector: str, top_n: int | None = None, share_bytes: int = SHARE_BYTES
) -> DataFrame:
    """Cosine of every query vector with its ``top_n`` nearest topic centres, or with all, one row each.

    The centres travel to the queries, which do not move: as one value of at most about
    ``share_bytes``, else in several passes, each with its share of them. The nearest are
    kept in place; ties go to the smaller topic.
    """
    centres = stage(centres, "topic-centres")
    passes = 1 + measured_bytes(centres) // share_bytes
    share = F.pmod(F.xxhash64("topic"), F.lit(passes))

    def against(i: int) -> DataFrame:
        some = centres.where(share == i).agg(F.collect_list(F.struct("topic", "centre"))).scalar()
        mine = F.col(vector).cast("array<double>")
        if top_n is None:
            paired = queries.withColumn("_c", F.explode(some))
            return paired.select(key, F.col("_c.topic").alias("topic"), cosine(mine, F.col("_c.centre")).alias("similarity"))
        near = F.transform("_all", lambda c: F.struct((-cosine(mine, c["centre"])).alias("far"), c["topic"].alias("topic")))
        best = F.slice(F.array_sort(F.filter(near, lambda c: c["far"].isNotNull())), 1, top_n)
        paired = queries.withColumn("_all", some).select(key, F.explode(best).alias("_c"))
        return paired.select(key, F.col("_c.topic").alias("topic"), (-F.col("_c.far")).alias("similarity"))

    found = reduce(DataFrame.unionByName, [against(i) for i in range(passes)])
    if top_n is None or passes == 1:
        return found
    w = Window.partitionBy(key).orderBy(F.desc("similarity"), "topic")
    return found.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= top_n).drop("_rank")


def topics_per_keyword(similarity: DataFrame, top_n: int = 10) -> DataFrame:
    """The ``top_n`` most similar topics of each keyword; ties go to the smaller topic."""
    w = Window.partitionBy("keyword").orderBy(F.desc("similarity"), "topic")
    ranked = similarity.withColumn("rank", F.row_number().over(w))
    return ranked.where(F.col("rank") <= top_n)


def relevant_topics(
    similarity: DataFrame, keywords: str | Sequence[str], top_n: int = 10, final_n: int = 10
) -> DataFrame:
    """Topics near any of the keywords: best similarity each, the ``final_n`` best overall."""
    keywords = [keywords] if isinstance(keywords, str) else list(keywords)
    near = topics_per_keyword(similarity.where(F.col("keyword").isin(keywords)), top_n)
    best = near.groupBy("topic").agg(F.max("similarity").alias("similarity"))
    return best.orderBy(F.desc("similarity"), "topic").limit(final_n)


def relevant_topics_by_tag(
    similarity: DataFrame, tag_keywords: Mapping[str, Sequence[str]], top_n: int = 10, final_n: int = 10
) -> DataFrame:
    """``relevant_topics`` for many tags at once, as (tag, topic, similarity)."""
    pairs = F.array(
        *[
            F.struct(F.lit(tag).alias("tag"), F.lit(k).alias("keyword"))
            for tag, keywords in tag_keywords.items()
            for k in keywords
        ]
    )
    near = topics_per_keyword(similarity, top_n)
    tagged = near.withColumn("_p", F.explode(F.filter(pairs, lambda p: p["keyword"] == F.col("keyword"))))
    best = tagged.groupBy(F.col("_p.tag").alias("tag"), "topic").agg(F.max("similarity").alias("similarity"))
    w = Window.partitionBy("tag").orderBy(F.desc("similarity"), "topic")
    return best.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= final_n).drop("_rank")
