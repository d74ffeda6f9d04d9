"""Counts and lists over items and documents. All aggregations combine before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.operators.names import mapping_file_name, output_file_name, unique_names


def by_category(items: DataFrame, key: str) -> DataFrame:
    """Items per category with the value that occurs first."""
    return items.groupBy("category").agg(
        F.count(F.lit(1)).alias("items"),
        F.min_by("value", F.struct(key, "start")).alias("sample"))


def active_counts(items: DataFrame, key: str) -> DataFrame:
    """Active and total items per document, and over all documents in the row with a null key."""
    return items.rollup(key).agg(F.count_if("active").alias("active"), F.count(F.lit(1)).alias("total"))


def category_presence(items: DataFrame) -> DataFrame:
    """Which categories occur, and which of them keep part of some value readable."""
    kept = (F.col("head") > 0) | (F.col("tail") > 0)
    return items.groupBy("category").agg(
        F.bool_or(F.col("active")).alias("active"), F.bool_or(F.col("active") & kept).alias("partial"))


def duplicate_codes(mapping: DataFrame) -> DataFrame:
    """Codes listed more than once, and rows without a code."""
    code = F.trim(F.coalesce("code", F.lit("")))
    return mapping.groupBy(code.alias("code")).agg(F.count(F.lit(1)).alias("rows")).where(
        "rows > 1 or code = ''")


def text_sizes(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    return docs.select(key, F.length(text).alias("characters"))


def manifest(docs: DataFrame, key: str, name: str = "file_name", items: str = "items", style: str = "code",
             order: str | None = None) -> DataFrame:
    """One row per document: source name, output name, mapping name, item count, partial flag.

    Output and mapping names are unique over the batch, in document order.
    """
    restorable = style == "code"
    partial: Column = F.exists(items, lambda i: (i["head"] > 0) | (i["tail"] > 0))
    rows = docs.select(
        key, F.col(order or key).alias("_ord"), F.col(name).alias("source"), F.size(items).alias("count"),
        partial.alias("partial"))
    wanted = [F.struct(F.lit(0).alias("slot"), output_file_name(F.col("source"), "deid").alias("name"))]
    if restorable:
        wanted.append(F.struct(F.lit(1).alias("slot"), mapping_file_name(F.col("source")).alias("name")))
    slots = rows.select(key, "_ord", F.explode(F.array(*wanted)).alias("w")).select(key, "_ord", "w.*")
    named = unique_names(slots, "name", ["_ord", "slot"]).groupBy(key).agg(
        F.max(F.when(F.col("slot") == 0, F.col("unique_name"))).alias("output"),
        F.coalesce(F.max(F.when(F.col("slot") == 1, F.col("unique_name"))), F.lit("")).alias("mapping"))
    return rows.join(named, key).select(key, "source", "output", "mapping", "count", "partial")
