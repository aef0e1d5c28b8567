"""A corpus pipeline: five stages over documents, each written as Parquet and read again.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.

Cases, alike in all stages: null or empty texts are kept and never compared (the last stage writes their end id alone); very long
texts are read whole; a null doc_id is kept, and is a document like any other; an empty table gives an empty one; further columns of
documents pass through unchanged, whatever their names, up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lakemill.llm import common, decontam, minhash, mixing, tokens, toxicity
from lakemill.llm.queries import tokenizer_path


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from their labels, does not reject.

    A text of score 0.5 or more goes. Repeated rows go or stay together; without labels of both classes the score is the share of label 1.
    """
    return toxicity.reject(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies, that of the least doc_id.

    Of rows that are equal in doc_id and text one stays; rows without words all stay.
    """
    return minhash.dedup(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark.

    Rows of one doc_id go together, those of no doc_id too; items of fewer than four words count only as whole texts.
    """
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for each copy that it takes, so a row may come twice or not at all.

    Texts without words have size 0 and are not taken; a null source is a source; rows equal in doc_id, source and size share their copies evenly.
    """
    return mixing.mix(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files in doc_id order, and the digest of each text's ids as read back.

    Every row is written, repeated ones too; rows of no doc_id come first; ties follow the text.
    """
    return tokens.round_trip(docs, tokenizer_path())


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("token_output", token_stage),
]

ORACLE_SQL = None  # a trained classifier and a tokenizer are not SQL; see tests/llm/test_pipeline.py


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. What a stage wrote beside its result, and its predecessor's result, go when the result is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    there = common.written()
    for _, stage in STAGES:
        docs = common.materialize(stage(spark, docs, sf_dir), "stage")
        common.forget(spark, there, keep=1)
    return docs
