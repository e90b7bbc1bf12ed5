"""The registered queries of the document operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from panelforecast.llm import extraction, language, mixing, oracles, pieces, quality, repeats, resampling, sampling, secrets, urls, whitening
from panelforecast.llm.common import held_out, read
from panelforecast.llm.simhash import near_duplicates
from panelforecast.llm.vectors import near_vectors


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), ~held_out("doc_id", 3, 1))
    return scored.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "score", "predicted")


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip(read(spark, sf_dir, "documents"))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.pfair_mix(read(spark, sf_dir, "documents"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(read(spark, sf_dir, "documents").select("doc_id", "text"))

    def count(kind: int):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(secrets.listed(F.col("spans"), 3), 256).alias("base_sha256"),
        secrets.listed(F.col("spans")).alias("spans"),
    )


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = language.train(docs, ~held_out("doc_id", 4, 2))
    found = language.predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = repeats.remove_repeats(read(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extract(read(spark, sf_dir, "pages"))


def op9_weighted_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.edits(read(spark, sf_dir, "documents"))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(read(spark, sf_dir, "embeddings"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened_components(read(spark, sf_dir, "embeddings"))


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(read(spark, sf_dir, "pages")).select("page_id", "judged.*")


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.importance_resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_simhash,
        op2_quality_classifier,
        op3_sentencepiece,
        op4_source_mixing,
        op5_secret_scan,
        op6_language_id,
        op7_substring_dedup,
        op8_html_extraction,
        op9_weighted_fingerprints,
        op10_embedding_dedup,
        op11_embedding_whitening,
        op12_url_filter,
        op13_importance_resampling,
    )
}
ORACLES: dict[str, str] = {
    "op4_source_mixing": oracles.MIX,
    "op7_substring_dedup": oracles.REPEATS,
    "op8_html_extraction": oracles.PAGES,
    "op10_embedding_dedup": oracles.VECTORS,
    "op12_url_filter": oracles.URLS,
    "op13_importance_resampling": oracles.DRAWS,
}
