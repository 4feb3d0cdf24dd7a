"""The registered queries of the operators: (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.llm import bpe_codec, decontaminate, license_scan, lm_score, minhash_dedup, quality_classifier, substring_dedup, url_filter, vp_search, warc_store


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.license_scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "expressions", "permissive")


def op2_vp_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return vp_search.vp_search(vectors, vectors.where(F.col("vec_id") % 20 == 0), k=20, factor=1.0)


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.quality_classifier(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digests(table(spark, sf_dir, "documents"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_filter(table(spark, sf_dir, "pages"))


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.lm_scores(table(spark, sf_dir, "documents"))


def op7_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_store.warc_round_trip(table(spark, sf_dir, "pages"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.bpe_encode(table(spark, sf_dir, "documents"), with_ids=False)


def op10_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "class_id", "n_words", F.lower(F.hex("label")).alias("class_label"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_license_scan, op2_vp_search, op3_quality_classifier, op4_substring_dedup, op5_url_filter,
        op6_lm_score, op7_warc_round_trip, op8_decontaminate, op9_bpe_codec, op10_minhash_dedup,
    )
}
ORACLE_SQL = {
    "op1_license_scan": license_scan.ORACLE_SQL,
    "op2_vp_search": vp_search.ORACLE_SQL,
    "op4_substring_dedup": substring_dedup.ORACLE_SQL,
    "op5_url_filter": url_filter.ORACLE_SQL,
    "op7_warc_round_trip": warc_store.ORACLE_SQL,
}
