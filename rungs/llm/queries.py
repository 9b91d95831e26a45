"""The queries of this subpackage: each applies an operator, with production parameters, to its whole table."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bwt, graph_ann, kn_quality, langid, mixing, pieces, prefix_trie, simhash, substring, tiling, token_output, whitening, winnow_lines
from .common import documents


def tokenizer(name: str = "byte_bpe_50k.json") -> str:
    """A public tokenizer's file: in the folder RUNGS_TOKENIZERS, if that is set, else in the package of these files."""
    folder = os.environ.get("RUNGS_TOKENIZERS")
    if folder:
        return f"{folder.rstrip('/')}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tiling.contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return rows.select("doc_id", "item_id", F.round("coverage", 6).alias("coverage"), F.size("tiles").cast("long").alias("n_tiles"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op3_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = substring.drop_repeats(documents(spark, sf_dir))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op4_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.token_digest(documents(spark, sf_dir), tokenizer())


def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph_ann.neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.near_classes(documents(spark, sf_dir))
    return rows.select("doc_id", simhash.hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_rows(documents(spark, sf_dir)).select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op8_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bwt.drop_repeats(documents(spark, sf_dir))
    return rows.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op9_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = winnow_lines.drop_repeats(documents(spark, sf_dir))
    return rows.select("doc_id", "n_lines", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("text", 256).alias("kept_sha256"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kn_quality.quality(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op11_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = tokenizer("piece_bpe_32k.model")
    ids = pieces.encode(documents(spark, sf_dir), model).select("doc_id", "ids")
    digits = F.array_join(F.col("ids").cast("array<string>"), ",")
    return pieces.decode(ids, model).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(digits, 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


def op12_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return rows.select("vec_id", "component", "n", F.expr("try_cast(deviation AS long)").alias("deviation"), "whitened", "explained", "identity_error")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_tiling, op2_mixing, op3_substring, op4_token_output, op5_neighbours, op6_simhash, op7_language, op8_suffix, op9_lines, op10_quality, op11_pieces, op12_trie, op13_whitening)}
