"""A training corpus from raw documents: quality classifier, quality rules, exact and near deduplication, packing.

Each stage is a function of (spark, docs, sf_dir), where docs has the columns of `documents`; its result is written
as Parquet and read again as the next stage's docs. All but the last return whole rows of docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from nearfield.llm import exact_dedup, near_dedup, packing, quality_model, quality_rules, simhash
from nearfield.llm.common import Stash, scratch
from nearfield.llm.queries import tokenizer_path


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised scorer rejects go."""
    return quality_model.clean_documents(docs)


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the rules, or whose host does, go."""
    return quality_rules.kept_documents(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest doc_id stays."""
    return exact_dedup.distinct_documents(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash links texts whose fingerprints differ in two bits at most; texts with 0.8 of their five-word shingles in
    common are linked besides. Of each component the row with the smallest doc_id stays."""
    return near_dedup.one_of_each_group(docs, linked=simhash.simhash_dedup)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of documents in sequences, with checksums of their ids."""
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"), checksums=True)


STAGES = [("quality_classifier", quality_classifier), ("quality_rules", rules), ("exact_dedup", exact), ("simhash_dedup", near), ("packing", packed)]

#: Models, fingerprints and tokenizers have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        with scratch():
            after = Stash(stage(spark, docs, sf_dir), f"pipeline-{name}", keep=True)
        if before:
            before.drop()
        docs, before = after.df, after
    return STAGES[-1][1](spark, docs, sf_dir)
