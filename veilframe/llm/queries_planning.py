"""Queries of the operators that place and mix documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.llm import mixing, sharding

SHARDS = [f"shard-{i:03d}" for i in range(64)]
WEIGHTS = [3, 1, 2]


def op2_table_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sized = docs.select("doc_id", F.octet_length("text").alias("n_bytes"), F.xxhash64("text").alias("_text"))
    return sharding.place(sized, ["doc_id"], [F.col("_text")], SHARDS).select("doc_id", "n_bytes", "slot", "shard")


def op3_low_discrepancy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", mixing.word_count("text").alias("size"))
    made = mixing.mix(docs, WEIGHTS, share=1.5, most=2)
    sources = made.sources.select("source_no", "source_size", "target")
    return mixing.lookup(made.taken, sources, ["source_no"]).select(
        "doc_id", "size", "source_size", "target", "taken", "source")
