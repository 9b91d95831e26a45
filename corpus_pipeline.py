"""A corpus from language ID to token files: five stages, each written out and read again as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rungs.llm import langid, mixing, simhash, tiling, token_output
from rungs.llm.common import emptied, scope, written
from rungs.llm.queries import tokenizer


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known: null and letterless texts and very unsure ones go."""
    return langid.keep_known(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose fingerprints, over five-word shingles, link at four or fewer differing bits, or whose shingles have a Jaccard similarity of 0.8."""
    return simhash.near_dedup(docs, words=5, bits=4, share=0.8)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that cover no benchmark item to 0.8."""
    return tiling.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them; those that it does not take go."""
    return mixing.mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token files' digest of each document, read back from them."""
    return token_output.token_digest(docs, tokenizer())


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixture", mixture), ("tokens", tokens)]

#: The stages train a classifier, link fingerprints and run a tokenizer, which SQL doesn't.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, over the whole table documents: the token digest of what they leave.

    What a stage has written on its way is emptied once its result is stored, and so is the result of the stage before.
    Each stage takes null and repeated ids, null and empty texts, repeated rows and an empty table as its operator does.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES:
        with scope() as made:
            docs = written(stage(spark, docs, sf_dir), name)
        emptied(before)
        emptied(made, docs)
        before = made
    return docs
