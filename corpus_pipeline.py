"""From raw documents to sampled segmentations: quality filter, near-duplicate removal, source mix, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. run() writes each
stage's rows to the shared folder and reads them for the next, so no stage is computed twice and a lost executor costs only
tasks of the stage at hand.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from relspark.llm import jaccard_join, mixing, quality, segmentation
from relspark.llm.common import fresh_path, read_table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on labelled documents, doesn't reject."""
    return quality.keep(docs, quality.learn(docs, read_table(spark, sf_dir, "labels")))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each near-duplicate group."""
    return jaccard_join.deduplicate(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them (up to twice)."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled segmentations of each document."""
    return segmentation.segment(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [("quality_classifier", keep_quality), ("jaccard_join", one_of_each_group), ("mixing", mix_sources), ("segmentation", encode)]

#: The classifier's fit and the sampled segmentations have no form in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        if name == STAGES[-1][0]:
            return out
        path = fresh_path(spark, f"stage-{name}")
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
