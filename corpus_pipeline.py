"""From raw documents to packed sequences: toxicity, exact copies, near copies, source mixing, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from govdocs.llm import exact_dedup, mixing, near_copies, packing, toxicity
from govdocs.llm.common import Scratch


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the grammar, fitted on the labels, does not reject. Null and empty texts stay; rows that repeat are judged each; all columns pass through."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts, null equal to empty; of rows that repeat doc_id and text one, of a doc_id with several texts each on its own; all columns pass through."""
    return exact_dedup.drop_exact_duplicates(docs)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near copies: five-word shingles, similarity of 0.8 or more; the smallest doc_id, null last. Texts without words are copies of each other; all columns pass through."""
    return near_copies.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Nine tenths of the tokens, the sources by weight; each document once at most, so that only what exceeds a source's share goes.

    Null languages and sources are one of their own; texts without words cost nothing; rows that repeat doc_id and text stay or go together.
    """
    return mixing.drop_unmixed(docs, mixing.source_domain(), mixing.WEIGHTS, fraction=0.9)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents that are left, with their place in sequences of 2048 ids. Null and empty texts are the end id alone; an empty table gives no pieces."""
    return packing.pack(docs)


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_exact), ("near_dedup", drop_near), ("mixing", mix_sources), ("packing", pack_sequences)]

#: SQL has no words for the fitted grammar, the fingerprints or the tokenizer; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        before = len(Scratch.made)
        docs = scratch.put(name, stage(spark, docs, sf_dir))
        Scratch.drop_since(spark, before)
        if k:
            scratch.drop(STAGES[k - 1][0])
    return docs
