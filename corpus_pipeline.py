"""From raw documents to packed training sequences, in five stages over whole tables.

A stage takes (spark, docs, sf_dir), docs being the table that the stage before it wrote, and returns a DataFrame; all
but the last return the columns of ``documents``. ``run`` writes each stage's rows to the session's shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shortlister.llm import jaccard, linedup, mix, pack, toxicity
from shortlister.llm.common import scratch, stash, sweep, written


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the classifier rejects; it learns from the labels of documents that are still there."""
    return toxicity.keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Delete common blocks of lines from later documents; a document that loses all its lines stays, empty."""
    return linedup.without_repeats(docs).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each group of near duplicates."""
    return jaccard.one_of_each(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or leave out documents to meet the sources' targets, in order of training position."""
    return mix.curriculum(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the token ids of the mix into sequences; one row per piece."""
    return pack.pack_documents(docs, pack.tokenizer_path())


STAGES = [
    ("toxicity", toxicity_stage),
    ("line dedup", line_dedup_stage),
    ("near duplicates", near_duplicate_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: A trained classifier, an alignment and a tokenizer can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of the documents under ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = written()
    for _, stage in STAGES[:-1]:
        path = scratch(spark, "stages")
        docs = stash(stage(spark, docs, sf_dir), path=path)
        sweep(spark, before, keep=path)  # what the stage wrote on its way, and the table that it read
    return STAGES[-1][1](spark, docs, sf_dir)
