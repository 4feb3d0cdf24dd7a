"""A corpus pipeline: documents pass five stages, each written and read again.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of ``docs``. The stages decide on what their predecessor kept:

1. documents that the quality classifier rejects go;
2. of each group of near duplicates one document stays;
3. passages that repeat across documents are cut;
4. documents that hold a benchmark item go;
5. what is left is encoded, with digests of ids and decoded text.

Defined cases: a null text is an empty one, which the classifier scores as the average
good text and near duplicates take for equal to other empty ones; a null id is a
document like any other; of repeated rows one stays; very long texts pass whole;
without labels no document is rejected unless the threshold is above a half (all
are then, as every score is a half); an empty benchmark drops nothing; empty
documents give an empty result; further columns, whatever their names, pass
through the filtering stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from timberline.llm import bpe_codec, decontaminate, minhash_dedup, quality_classifier, substring_dedup
from timberline.llm.scratch import Scratch

#: The classifier and the alignments aren't SQL; tests/llm holds run() against a version
#: that scores every text, aligns all pairs, counts all windows and tries all places.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_classifier.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash_dedup.keep_one_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substring_dedup.cut_repeats(docs)


def benchmark_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe_codec.bpe_encode(docs, with_ids=False)


STAGES = [
    ("quality classifier", quality),
    ("near duplicates", near_duplicates),
    ("repeated passages", repeated_passages),
    ("benchmark items", benchmark_items),
    ("encoding", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.save(docs, f"stage-{k}")
    return docs
