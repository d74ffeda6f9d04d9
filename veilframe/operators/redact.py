"""Redaction: items to edits, edits to text, and the mapping table that undoes it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veilframe.functions.retention import hidden_part, kept_prefix, kept_suffix, preview, rendered
from veilframe.functions.text import each, let, splice
from veilframe.operators.detect import ITEM_COLUMNS, item_table

STYLES = ("code", "label", "blank")
MAPPING_COLUMNS = ["code", "category", "original", "kept_prefix", "kept_suffix"]


def edits_of(items: Column, style: str) -> Column:
    """``array<struct<start,end,replacement>>`` for items in order of their start."""
    return F.transform(items, lambda i: F.struct(
        i["start"].alias("start"), i["end"].alias("end"),
        rendered(style, i["category"], i["value"], i["head"], i["tail"],
                 i["code"] if style == "code" else None).alias("replacement")))


def redacted_text(text: Column, items: Column, style: str) -> Column:
    return splice(text, edits_of(items, style))


def redact(docs: DataFrame, style: str = "code", text: str = "text", items: str = "items",
           into: str = "redacted") -> DataFrame:
    """Add the redacted text. Works in the document's row: no shuffle for any style."""
    return docs.withColumn(into, redacted_text(F.col(text), F.col(items), style))


def previewed(item: Column, style: str = "code") -> Column:
    """On-screen form of one item's output."""
    return preview(style, item["category"], item["value"], item["head"], item["tail"])


def mapping_entry(i: Column) -> Column:
    return F.struct(
        i["code"].alias("code"), i["category"].alias("category"),
        hidden_part(i["value"], i["head"], i["tail"]).alias("original"),
        kept_prefix(i["value"], i["head"]).alias("kept_prefix"),
        kept_suffix(i["value"], i["tail"]).alias("kept_suffix"))


def mapping_of(items: Column) -> Column:
    """The mapping rows of one document: one per code, in order of first use.

    Sorted by code, neighbours are compared: no entry is compared with all others.
    """
    ranked = F.array_sort(F.transform(items, lambda i, n: F.struct(i["code"].alias("code"), n.alias("n"), mapping_entry(i).alias("entry"))))
    firsts = let(ranked, lambda r: F.filter(r, lambda e, n: (n == 0) | ~e["code"].eqNullSafe(F.get(r, n - 1)["code"])))
    return F.transform(F.array_sort(F.transform(firsts, lambda e: F.struct(e["n"].alias("n"), e["entry"].alias("entry")))), lambda e: e["entry"])


def mapping_per_document(docs: DataFrame, key: str, items: str = "items") -> DataFrame:
    """Mapping rows of every document (``scope`` = the document), without a shuffle."""
    rows = each(docs.withColumn("scope", F.col(key).cast("string")), mapping_of(F.col(items)), "scope", name="m", position="n")
    return rows.select("scope", (F.col("n") + 1).alias("line_no"), "m.*")


def mapping_shared(docs: DataFrame, key: str, scope: Column | None = None, items: str = "items") -> DataFrame:
    """One row per code of a shared scope, with the place of its first use for ordering."""
    scope = F.lit("shared") if scope is None else scope
    named = docs.select(scope.cast("string").alias("scope"), F.col(key).alias("first_doc"), items)
    rows = each(named, items, "scope", "first_doc", name="i")
    entries = rows.select("scope", "first_doc", F.col("i")["start"].alias("first_start"), mapping_entry(F.col("i")).alias("m"))
    place = F.min(F.struct("first_doc", "first_start")).alias("place")
    return entries.select("scope", "m.*", "first_doc", "first_start").groupBy(
        "scope", *MAPPING_COLUMNS).agg(place).select("scope", *MAPPING_COLUMNS, "place.*")


def merge_mappings(*tables: DataFrame) -> DataFrame:
    """One row per code over several tables (columns scope, line_no, MAPPING_COLUMNS).

    Earlier tables win, and inside a table earlier lines.
    """
    merged = None
    for n, table in enumerate(tables):
        part = table.select(F.lit(n).alias("source"), "scope", "line_no", *MAPPING_COLUMNS)
        merged = part if merged is None else merged.unionByName(part)
    values = F.struct("source", "line_no", "scope", *[c for c in MAPPING_COLUMNS if c != "code"])
    best = merged.groupBy("code").agg(F.min(values).alias("m"))
    return best.select("code", "m.*")


# -------------------------------------------------- items kept as a table
def attach(docs: DataFrame, table: DataFrame, key: str, into: str = "items") -> DataFrame:
    """Bring an item table back into the documents' rows, ordered by start.

    Of a table under review (with ``active``) only active items come back, so
    cancelled ones are neither replaced nor listed in mapping or manifest. A
    document's items are bounded by the length of its text.
    """
    if "active" in table.columns:
        table = table.where("active")
    columns = [c for c in [*ITEM_COLUMNS, "code"] if c in table.columns]
    item_type = "array<struct<" + ",".join(
        f"{c}:{table.schema[c].dataType.simpleString()}" for c in columns) + ">>"
    grouped = table.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(into))
    return docs.join(grouped, key, "left").withColumn(into, F.coalesce(F.col(into), F.array().cast(item_type)))


def apply_edits(docs: DataFrame, edits: DataFrame, key: str, text: str = "text", into: str = "edited") -> DataFrame:
    """Apply an edit table (key, start, end, replacement) to texts; overlapping edits are an error."""
    grouped = edits.groupBy(key).agg(F.array_sort(F.collect_list(
        F.struct("start", "end", "replacement"))).alias("_edits"))
    joined = docs.join(grouped, key, "left")
    changed = F.when(F.col("_edits").isNull(), F.col(text)).otherwise(splice(F.col(text), F.col("_edits")))
    return joined.withColumn(into, changed).drop("_edits")


def overlapping_edits(edits: DataFrame, key: str) -> DataFrame:
    """Edits that begin before the previous edit of the same text ends."""
    order = Window.partitionBy(key).orderBy("start", "end")
    return edits.withColumn("_last", F.lag("end").over(order)).where("start < _last").drop("_last")


def redacted_items(docs: DataFrame, key: str, style: str, items: str = "items") -> DataFrame:
    """What every item becomes: one row per item with its replacement."""
    return item_table(docs, key, items=items).withColumn("replacement", rendered(
        style, F.col("category"), F.col("value"), F.col("head"), F.col("tail"),
        F.col("code") if style == "code" else None))
