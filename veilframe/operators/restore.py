"""Restoring redacted texts from mapping tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.functions import fixed_values as fv
from veilframe.functions.text import each, fenced, find_all, let
from veilframe.operators.lookup import lookup
from veilframe.operators.redact import apply_edits


def markers_of(text: Column) -> Column:
    """``array<struct<start,end,category,code>>`` of all markers in a text."""

    def read(s: Column) -> Column:
        inner = F.substring(s["value"], F.lit(2), F.length(s["value"]) - 2)
        return F.struct(s["start"].alias("start"), s["end"].alias("end"),
                        F.substring_index(inner, ":", 1).alias("category"),
                        F.substring_index(inner, ":", -1).alias("code"))

    return F.transform(let(fenced(text), lambda t: find_all(t, fv.MARKER)), read)


def marker_table(docs: DataFrame, *keys: str, text: str = "redacted") -> DataFrame:
    return each(docs, markers_of(F.col(text)), *keys, name="m").select(*keys, "m.*")


def matched_markers(docs: DataFrame, mapping: DataFrame, key: str, text: str = "redacted",
                    scope: Column | None = None) -> DataFrame:
    """Markers with the hidden part their code stands for (null when the table lacks the code).

    The category in a marker is not compared: the code alone decides.
    """
    scope = F.col(key) if scope is None else scope
    marks = each(docs.withColumn("scope", scope.cast("string")), markers_of(F.col(text)), key, "scope", name="m")
    table = mapping.select(F.col("scope").cast("string").alias("scope"), "code", "original")
    return lookup(marks.select(key, "scope", "m.*"), table, ["scope", "code"])


def restore(docs: DataFrame, mapping: DataFrame, key: str, text: str = "redacted", into: str = "restored",
            scope: Column | None = None) -> DataFrame:
    """Put hidden parts back. Unknown markers stay as they are.

    ``mapping`` has one row per (scope, code); without ``scope`` each document
    has its own. Only texts with markers are moved to meet their edits.
    """
    marked = F.coalesce(F.col(text).rlike(fv.MARKER), F.lit(False))
    some = docs.where(marked)
    known = matched_markers(some, mapping, key, text, scope).where("original is not null")
    edits = known.select(key, "start", "end", F.col("original").alias("replacement"))
    return apply_edits(some, edits, key, text, into).unionByName(docs.where(~marked).withColumn(into, F.col(text)))


def restore_report(docs: DataFrame, mapping: DataFrame, key: str, text: str = "redacted",
                   scope: Column | None = None) -> DataFrame:
    """Per document: markers restored and the distinct codes the table lacks."""
    found = matched_markers(docs, mapping, key, text, scope)
    lacking = F.when(F.col("original").isNull(), F.col("code"))
    return found.groupBy(key).agg(
        F.count("original").alias("restored"),
        F.array_sort(F.collect_set(lacking)).alias("missing_codes"))


def missing_codes(docs: DataFrame, mapping: DataFrame, key: str, text: str = "redacted",
                  scope: Column | None = None) -> DataFrame:
    """Distinct (document, code) pairs without a mapping row."""
    return matched_markers(docs, mapping, key, text, scope).where("original is null").select(key, "code").distinct()


def check_same_run(docs: DataFrame, mapping: DataFrame, column: str = "run_id") -> DataFrame:
    """Run ids of documents that no mapping row shares: pairs that do not belong together."""
    return docs.select(column).distinct().join(mapping.select(column).distinct(), column, "left_anti")
