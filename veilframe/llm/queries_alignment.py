"""Query of the operator that lays two tokenizers' tokens side by side."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veilframe.llm import alignment


def op13_aligned_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return alignment.align_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
