"""The corpus pipeline: five stages over ``documents``, each a table that the next one reads.

Counted as part of the subpackage ``panelforecast.llm``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from panelforecast.llm import language, mixing, pieces, secrets, simhash
from panelforecast.llm.common import in_written_order, lean_stage, read

#: Documents whose language has less than this mean share of their words are rejected, and those without a letter.
LEAST_SHARE = 0.4

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language of their own; ``lang`` becomes the predicted one.

    The tagger learns from the ``lang`` of these documents. Null texts and texts without
    letters go, and those in which no language reaches ``LEAST_SHARE`` of the words.
    Without any known language nothing can be told, and nothing goes.
    """
    columns = docs.columns
    model = language.train(docs, F.lit(True))
    if not model["languages"]:
        return docs
    found = language.predict(docs, model).where((F.col("lang_pred") != language.UNDETERMINED) & (F.col("score") >= LEAST_SHARE))
    return found.withColumn("lang", F.col("lang_pred")).select(*columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id.

    Near copies have fingerprints of three-word shingles that differ in at most 3 bits, directly or
    through others. Rows of one id and other texts are documents of their own; of equal rows one stays.
    """
    return simhash.drop_near_duplicates(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its secrets masked; ``n_chars`` follows a changed text."""
    name = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    found = secrets.find_secrets(docs.toDF(*name.values()), name["text"])
    # masked under a name of its own: an expression over "text" beside a new "text" would see the new one
    found = found.withColumn("masked", secrets.masked(F.col(name["text"]), F.col("spans")))
    length = F.when(F.size("spans") > 0, F.length("masked").cast("long")).otherwise(F.col(name["n_chars"]))
    changed = {"text": F.col("masked"), "n_chars": length}
    return found.select(*[changed.get(c, F.col(name[c])).alias(c) for c in docs.columns])


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, in the order of the mixture: files, and rows in them, follow the schedule's slots."""
    placed = mixing.pfair_mix(docs, whole_rows=True)
    return placed.repartitionByRange("slot", "source_row").sortWithinPartitions("slot", "source_row").select("row.*")


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document, the digest of what they decode to, and the document's place in the mixture.

    Files are read in an order of their sizes, so the order that ``source_mixing`` has written
    is taken from the part numbers and the rows in them: ordered by ``place`` the table is the mixture.
    """
    placed = in_written_order(docs.select("doc_id", "text"), "place")
    encoded = pieces.round_trip(placed.select(F.struct("doc_id", "place").alias("placed"), "text"), "placed")
    return encoded.select("placed.doc_id", *[c for c in encoded.columns if c != "placed"], "placed.place")


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("secret_scan", secret_scan),
    ("source_mixing", source_mixing),
    ("token_ids", token_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, apply in STAGES:
        docs = lean_stage(apply(spark, docs, sf_dir), name)
    return docs


#: A trained tagger and fingerprints cannot be written in SQL; the tests hold the stages against brute force.
ORACLE_SQL: str | None = None

QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
