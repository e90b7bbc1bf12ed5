"""Topic tags on articles and their join back onto the corpus by text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from panelforecast.functions.columns import text_key
from panelforecast.operators.joins import BROADCAST_BYTES, lookup_join

REPEAT_BLOCK = 10_000


def tag_by_topic(
    articles: DataFrame, tag_topics: DataFrame, tags: Sequence[str], topic: str = "topic"
) -> DataFrame:
    """One boolean per tag: is the article's topic among the tag's relevant topics?

    ``tag_topics`` (tag, topic) holds at most ``final_n`` topics per tag, so the table
    made of it here is small by construction and all tags take one pass.
    """
    flags = tag_topics.groupBy(F.col("topic").alias("_topic")).agg(
        *[F.max(F.col("tag") == t).alias(t) for t in tags]
    )
    joined = articles.join(F.broadcast(flags), F.col(topic) == F.col("_topic"), "left").drop("_topic")
    return joined.withColumns({t: F.coalesce(F.col(t), F.lit(False)) for t in tags})


def attach_tags(
    corpus: DataFrame,
    tagged: DataFrame,
    tags: Sequence[str],
    text: str = "text",
    key: str = "doc_id",
    text_key_column: str | None = None,
    limit_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Left join of the corpus to the tagged articles on the whole text, with ``copies``.

    k copies of a text match k x k times. Tagged articles are therefore first counted
    per text and tag combination: a corpus row meets each combination once and
    ``copies`` says how often the plain join would have repeated it. Missing texts
    match each other.
    Both sides may carry the digest of the text already, as ``text_key_column``.
    """
    digest = F.col(text_key_column) if text_key_column else text_key(F.col(text))
    variants = tagged.select(digest.alias("_text"), *tags).groupBy("_text", *tags).agg(F.count(F.lit(1)).alias("copies"))
    keyed = corpus.drop(*tags).withColumn("_text", digest)
    joined = lookup_join(keyed, variants, "_text", "left", spread_by=key, limit_bytes=limit_bytes)
    return joined.drop("_text").withColumn("copies", F.coalesce("copies", F.lit(1)))


def repeat_copies(rows: DataFrame, copies: str = "copies") -> DataFrame:
    """Write out the repeated rows. Each row is repeated where it is, in two steps,
    so that no array grows beyond a block."""
    blocks = F.sequence(F.lit(0), F.floor((F.col(copies) - 1) / REPEAT_BLOCK))
    rows = rows.withColumn("_block", F.explode(blocks))
    left = F.least(F.lit(REPEAT_BLOCK), F.col(copies) - F.col("_block") * REPEAT_BLOCK).cast("int")
    return rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), left))).drop("_block", "_copy", copies)


def attach_tags_by_id(corpus: DataFrame, tagged: DataFrame, tags: Sequence[str], key: str = "doc_id") -> DataFrame:
    """The same without fan-out: each article gets its own tags."""
    return corpus.drop(*tags).join(tagged.select(key, *tags), key, "left")
