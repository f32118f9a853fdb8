"""Corpus pipeline: quality rules, near-duplicate removal, mixing to target weights and packing into sequences.

Every stage works on all documents that the stage before has kept and returns documents, the last one packed pieces. Each
stage calls one operator of the llm subpackage with its production parameters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.mixing import mix_documents
from tidemark.llm.packing import pack_documents
from tidemark.llm.quality import quality_filter
from tidemark.llm.simhash import deduplicate
from tidemark.session import cut_lineage, utc


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass all quality rules."""
    return quality_filter(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates, that of the least doc_id."""
    return deduplicate(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's target takes it, three times at most."""
    return mix_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of at most 4096 tokens."""
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality_rules", quality), ("simhash_near_dedup", near_dedup), ("mixing", mixing), ("best_fit_packing", packing)]

#: Fingerprints and token ids are no SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; each result is cut off from the plan before it."""
    docs = utc(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
