"""Review steps on item tables: manual items, toggles, switched-off categories, rescans.

An item table here has one row per item: the document key, ITEM_COLUMNS, and
``origin`` (auto / manual), ``active`` and, once given, ``code``.

Interval joins run per document and block of offsets, so a document with very
many items is spread over many groups.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veilframe.functions.retention import split_for
from veilframe.operators.detect import ITEM_COLUMNS
from veilframe.session import materialize

# Offsets per block of an interval join.
BLOCK_CHARS = 4096


def blocked(spans: DataFrame, start: str = "start", end: str = "end") -> DataFrame:
    """One row per block of offsets a span touches."""
    first = F.floor(F.col(start) / BLOCK_CHARS)
    last = F.floor(F.greatest(F.col(end) - 1, F.col(start)) / BLOCK_CHARS)
    return spans.withColumn("_block", F.explode(F.sequence(first, last)))


def overlapping(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """The (key, start, end) of ``left`` that overlap some span of ``right``.

    Both sides meet only inside a block of one document.
    """
    l = blocked(left.select(key, "start", "end").distinct())
    r = blocked(right.select(key, F.col("start").alias("_s"), F.col("end").alias("_e")), "_s", "_e")
    hit = l.join(r, [key, "_block"]).where((F.col("start") < F.col("_e")) & (F.col("end") > F.col("_s")))
    return hit.select(key, "start", "end").distinct()


def contained(inner: DataFrame, outer: DataFrame, key: str) -> DataFrame:
    """The (key, start, end) of ``inner`` that lie wholly inside some span of ``outer``."""
    i = inner.select(key, "start", "end").distinct().withColumn("_block", F.floor(F.col("start") / BLOCK_CHARS))
    o = blocked(outer.select(key, F.col("start").alias("_s"), F.col("end").alias("_e")), "_s", "_e")
    hit = i.join(o, [key, "_block"]).where((F.col("start") >= F.col("_s")) & (F.col("end") <= F.col("_e")))
    return hit.select(key, "start", "end").distinct()


def _fits_in(rows: pd.DataFrame) -> pd.DataFrame:
    """Which spans of a document overlap none that was accepted before; rows in order of ``_order``."""
    ends: list[tuple[int, int]] = []  # accepted spans as (end, start); disjoint, so sorted either way
    verdicts = []
    for start, end in rows.sort_values("_order")[["start", "end"]].itertuples(index=False):
        at = bisect_left(ends, (start + 1, -1))  # the first accepted span that ends behind the start
        free = at == len(ends) or ends[at][1] >= end
        verdicts.append(free)
        if free:
            insort(ends, (end, start))
    return rows.sort_values("_order").assign(_fits=verdicts)


def without_conflicts(spans: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Add ``_fits``: whether a span (key, start, end, distinct) is free of those before it that fit, per document, in ``order``.

    A document's requests are judged together; they are bounded by what a person asks for.
    """
    place = Window.partitionBy(key).orderBy(*order)
    rows = spans.select(key, "start", "end", *[c for c in order if c not in ("start", "end")]).withColumn("_order", F.row_number().over(place)).select(
        key, "start", "end", "_order")
    kind = dict(rows.dtypes)
    return rows.groupBy(key).applyInPandas(_fits_in, f"`{key}` {kind[key]}, start {kind['start']}, end {kind['end']}, _order int, _fits boolean").drop("_order")


def auto_items(table: DataFrame) -> DataFrame:
    """Detected items as rows to review."""
    return table.withColumn("origin", F.lit("auto")).withColumn("active", F.lit(True))


def add_manual(items: DataFrame, requests: DataFrame, docs: DataFrame, key: str,
               text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Add spans chosen by hand; gives (items, rejected requests).

    A request (key, start, end, category, retention) is rejected when it is
    empty, leaves the text, overlaps an active item, or overlaps a request
    before it that is accepted (``reason``). Requests come in order of
    ``request_no`` where there is one, else of their place and category.
    """
    order = [*(["request_no"] if "request_no" in requests.columns else []), "start", "end", "category"]
    outside = (F.col("start") < 0) | (F.col("end") > F.length("_text")) | (F.col("start") >= F.col("end"))
    value = F.substring(F.col("_text"), F.col("start") + 1, F.col("end") - F.col("start"))
    # Texts are met once, for what lies in the spans; everything after that is decided without them.
    placed = materialize(requests.join(docs.select(key, F.col(text).alias("_text")), key).select(
        *[c for c in requests.columns if c != "value"], outside.alias("_outside"), F.when(~outside, value).alias("value")), "requests")
    taken = overlapping(placed, items.where("active"), key).withColumn("_taken", F.lit(True))
    same = Window.partitionBy(key, "start", "end").orderBy(*order)
    judged = materialize(placed.join(taken, [key, "start", "end"], "left").withColumn("_nth", F.row_number().over(same)).withColumn("reason", F.when(
        F.col("_outside"), "invalid_range").when(F.col("_taken") | (F.col("_nth") > 1), "overlap")), "judged")
    free = without_conflicts(judged.where("reason is null"), key, order)
    judged = judged.join(free, [key, "start", "end"], "left").withColumn(
        "reason", F.when(F.col("reason").isNull() & ~F.col("_fits"), "overlap").otherwise(F.col("reason")))
    kept = split_for(F.col("value"), F.col("retention"), F.col("category"))
    new = judged.where("reason is null").withColumn("_split", kept).select(
        key, "start", "end", F.lit(-1).alias("rule_ord"), F.lit("manual").alias("rule_id"), "category", "value",
        F.col("_split.head").alias("head"), F.col("_split.tail").alias("tail"),
        F.lit("manual").alias("origin"), F.lit(True).alias("active"))
    rejected = judged.where("reason is not null").select(key, "start", "end", "category", "reason")
    return items.unionByName(new), rejected


def toggle(items: DataFrame, requests: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Cancel or reinstate items by (key, start, end); gives (items, rejected requests).

    An item comes back only where no active item overlaps it, and no item that
    comes back before it by the same call (in order of place).
    """
    place = [key, "start", "end"]
    asked = requests.select(*place).distinct().withColumn("_asked", F.lit(True))
    back = items.join(asked, place).where(~F.col("active"))
    blocked_active = overlapping(back, items.where("active"), key)
    tried = back.select(*place).distinct().join(blocked_active, place, "left_anti")
    late = without_conflicts(tried, key, ["start", "end"]).where("not _fits").select(*place)
    blocked_back = blocked_active.unionByName(late).withColumn("_blocked", F.lit(True))
    judged = items.join(asked, place, "left").join(blocked_back, place, "left")
    flips = F.col("_asked").isNotNull() & (F.col("active") | F.col("_blocked").isNull())
    out = judged.withColumn("active", F.when(flips, ~F.col("active")).otherwise(F.col("active")))
    rejected = judged.where(F.col("_asked").isNotNull() & ~F.col("active") & F.col("_blocked").isNotNull())
    return out.select(*items.columns), rejected.select(*place)


def with_categories_off(items: DataFrame, categories: list[str]) -> DataFrame:
    """Items of switched-off categories become inactive."""
    return items.withColumn("active", F.col("active") & ~F.col("category").isin(list(categories)))


def with_category_enabled(items: DataFrame, category: str, enabled: bool, key: str) -> DataFrame:
    """Switch a whole category; items that now overlap an active one stay cancelled."""
    of_category = F.col("category") == category
    if not enabled:
        return with_categories_off(items, [category])
    back = items.where(of_category & ~F.col("active")).select(key, "start", "end")
    out, _ = toggle(items, back, key)
    return out


def rescan(fresh: DataFrame, previous: DataFrame, key: str, keep: bool = True) -> DataFrame:
    """Items after detecting again: manual items stay, auto items under active manual ones go.

    With ``keep``, an item found again at the same place in the same category
    keeps its state (and code, if the previous table has one).
    """
    fresh = materialize(fresh, "fresh")
    manual = previous.where("origin = 'manual'")
    hidden = overlapping(fresh, manual.where("active"), key)
    auto = auto_items(fresh).join(hidden, [key, "start", "end"], "left_anti")
    place = [key, "start", "end", "category"]
    state = [c for c in ("code",) if c in previous.columns]
    old = previous.where("origin = 'auto'").select(*place, F.col("active").alias("_active"), *state)
    if keep:
        auto = auto.join(old, place, "left").withColumn("active", F.coalesce("_active", "active")).drop("_active")
    columns = [key, *ITEM_COLUMNS, "origin", "active"] + (state if keep else [])
    return auto.select(*columns).unionByName(manual.select(*columns))
