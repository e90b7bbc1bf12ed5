"""Importance resampling of documents towards a target text's distribution of hashed n-grams."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from panelforecast.llm.common import slices
from panelforecast.llm.grams import Words, interned
from panelforecast.operators.panel import row_position
from panelforecast.sources.stages import stage

# The settings of the registered draw.
BUCKETS = 10_000
ORDER = 1
PERCENT = 10
LEAST_WORDS = 20
SEED = 2024


def _counted(texts: DataFrame, order: int, buckets: int) -> dict[int, int]:
    """Features of all ``texts`` per bucket: every batch's table is added to one array a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in slices(batch):
                for _, table in interned(Words(part.column("text")), order, buckets):
                    np.add.at(total, table.bucket[table.taken], table.count[table.taken])
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used])], ["bucket", "features"])

    found = texts.mapInArrow(run, "bucket int, features long").groupBy("bucket").agg(F.sum("features").alias("features"))
    return {r["bucket"]: r["features"] for r in found.collect()}  # at most ``buckets`` rows


def bucket_gains(documents: dict[int, int], target: dict[int, int], buckets: int) -> np.ndarray:
    """A bucket's log ratio of the target's smoothed share to the documents', in floored thousandths."""
    all_documents, all_target = sum(documents.values()), sum(target.values())
    return np.array(
        [
            math.floor(1000 * math.log((target.get(b, 0) + 1.0) * (all_documents + buckets) / ((documents.get(b, 0) + 1.0) * (all_target + buckets))))
            for b in range(buckets)
        ],
        np.int64,
    )


def weighed(docs: DataFrame, gains: np.ndarray, order: int = ORDER) -> DataFrame:
    """``(id, n_words, n_features, weight)`` of a table ``(id, text)``; the weight is the floored mean gain, 0 without a feature."""
    id_type = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                words = Words(part.column("text"))
                features, total = np.zeros((2, words.texts), np.int64)
                for doc, table in interned(words, order, len(gains)):
                    features += np.bincount(doc, minlength=words.texts)
                    np.add.at(total, doc, gains[table.bucket][table.slot])
                columns = [np.bincount(words.doc, minlength=words.texts), features, total // np.maximum(1, features)]
                yield pa.RecordBatch.from_arrays([part.column("id"), *[pa.array(c.astype(np.int64)) for c in columns]], ["id", "n_words", "n_features", "weight"])

    return docs.mapInArrow(run, f"id {id_type}, n_words long, n_features long, weight long")


def importance_resample(
    docs: DataFrame,
    target: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    target_column: str = "text",
    order: int = ORDER,
    buckets: int = BUCKETS,
    percent: int = PERCENT,
    least_words: int = LEAST_WORDS,
    seed: int = SEED,
) -> DataFrame:
    """``(id, n_features, weight, score, rank)``, one row per row of ``docs``.

    Features are all runs of 1 to ``order`` words, hashed into ``buckets`` by CRC-32. The
    score is the weight plus Gumbel noise from a hash of the id, so the highest scores are
    a draw without replacement in proportion to the weights. ``floor(percent * N / 100)`` of
    the N rows with at least ``least_words`` words are drawn; their rank counts from 1, the
    others' is null.

    Two passes over the texts, and only ids with their numbers are sorted, in ranges. Null
    and empty texts have no features, weight 0, and are never drawn where ``least_words``
    is above 0. A null id is hashed as an empty one. Of equal scores the smaller id comes
    first, a null id before all; rows equal in both go by their weight and length.
    An empty target leaves its smoothed even share; empty ``docs`` give no rows.
    """
    texts = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    wanted = target.select(F.col(target_column).cast("string").alias("text"))
    gains = bucket_gains(_counted(texts.select("text"), order, buckets), _counted(wanted, order, buckets), buckets)
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("")))
    chance = (F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    noise = F.floor(-1000 * F.log(-F.log(chance))).cast("long")
    scored = stage(weighed(texts, gains, order).withColumn("score", F.col("weight") + noise), "weighed")
    able = F.col("n_words") >= least_words
    drawn = scored.where(able).count() * percent // 100
    ranked = row_position(scored.where(able).withColumn("_down", -F.col("score")), ["_down", "id", "weight", "n_features"])
    rank = F.when(F.col("position") < drawn, F.col("position") + 1).cast("long")
    columns = [F.col("id").alias(id_column), "n_features", "weight", "score"]
    return ranked.select(*columns, rank.alias("rank")).unionByName(scored.where(~able).select(*columns, F.lit(None).cast("long").alias("rank")))
