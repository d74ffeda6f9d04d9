"""Queries of the operators on token ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veilframe.llm import packing, token_files


def word_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = token_files.new_folder(spark, "token-files")
    token_files.write_tokens(docs, path, word_tokenizer(), end_id=1)
    return token_files.read_tokens(spark, path)


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    pieces = packing.token_pieces(docs, word_tokenizer(), capacity=2048, end_id=0)
    return packing.pack(pieces, capacity=2048).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
