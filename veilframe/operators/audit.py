"""Audits of redacted outputs. Each gives the violations; an empty result is a pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veilframe.functions.text import each
from veilframe.operators.detect import find
from veilframe.operators.restore import marker_table, restore
from veilframe.operators.review import contained
from veilframe.operators.rules import Rule


def residue(docs: DataFrame, key: str, items: str = "items", redacted: str = "redacted") -> DataFrame:
    """Values of a document that still stand in its own redacted text (whole values only)."""
    left = F.filter(F.array_distinct(F.transform(items, lambda i: i["value"])),
                    lambda v: F.contains(F.col(redacted), v))
    return each(docs, left, key, name="value")


def broken_round_trips(docs: DataFrame, mapping: DataFrame, key: str, text: str = "text",
                       redacted: str = "redacted", scope=None) -> DataFrame:
    """Documents whose restored text is not the original."""
    back = restore(docs, mapping, key, redacted, "_back", scope)
    return back.where(~F.col("_back").eqNullSafe(F.col(text))).select(key)


def unpaired_codes(docs: DataFrame, mapping: DataFrame, key: str, redacted: str = "redacted") -> DataFrame:
    """Codes that occur only in the texts or only in the mapping table of their document."""
    marks = marker_table(docs, key, text=redacted).select(
        F.col(key).cast("string").alias("scope"), "code").distinct().withColumn("in_text", F.lit(True))
    table = mapping.select(F.col("scope").cast("string").alias("scope"), "code").distinct().withColumn(
        "in_mapping", F.lit(True))
    both = marks.join(table, ["scope", "code"], "full")
    return both.where("in_text is null or in_mapping is null").select(
        "scope", "code", F.col("in_text").isNotNull().alias("in_text"), F.col("in_mapping").isNotNull().alias("in_mapping"))


def overlaps(items: DataFrame, key: str) -> DataFrame:
    """Active items that begin before an earlier active item of the document ends."""
    order = Window.partitionBy(key).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    active = items.where("active") if "active" in items.columns else items
    return active.withColumn("_reach", F.max("end").over(order)).where("start < _reach").select(key, "start", "end")


def uncovered(docs: DataFrame, items: DataFrame, rule: Rule, key: str, text: str = "text") -> DataFrame:
    """Matches of a plain rule that do not lie inside an active item."""
    matches = find(docs, rule, key, text=text)
    active = items.where("active") if "active" in items.columns else items
    inside = contained(matches, active, key)
    return matches.join(inside, [key, "start", "end"], "left_anti")
