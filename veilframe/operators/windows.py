"""Detection in texts too long for one task, by windows with overlap.

A text is cut into cores of equal width; a window is a core with a margin of its
neighbours on both sides, and windows of one text are scanned by many tasks. A
match belongs to the window whose core it begins in, so it is found once. Rules
are read from left to right, which depends on what was found before; two scans
that find the same on both sides of an edge go on alike from there. So the
matches near every edge are compared between the two windows that see them. Where
they differ, or where a match runs into the end of a window, the two windows
become one, and it is scanned again.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veilframe.functions.text import each
from veilframe.operators.detect import candidates
from veilframe.operators.overlaps import select_spans
from veilframe.operators.rules import BUILTIN_RULES, Rule
from veilframe.session import discard, fits, materialize

WIDTH = 1 << 18
# Characters that a window sees of its neighbours. A rule may look this far around a match, less what is compared.
MARGIN = 2048


def cores_of(docs: DataFrame, keys: list[str], text: str, width: int) -> DataFrame:
    """``keys, n, core``: every text cut into pieces of ``width`` characters."""
    cut = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(rf"(?s).{{1,{width}}}"), F.lit(0))
    return each(docs, cut, *keys, name="core", position="n")


def _windows(cores: DataFrame, keys: list[str], margin: int) -> DataFrame:
    """``keys, g, start, low, high, before, after, text``: the window of every group ``g`` of neighbouring cores.

    ``start`` is where the window's text begins, ``low`` and ``high`` the ends
    of its core, and ``before`` / ``after`` whether the text goes on there.
    """
    by = Window.partitionBy(*keys).orderBy("n")
    edges = cores.withColumns({"prev": F.lag("g").over(by), "next": F.lead("g").over(by)})
    own = edges.select(*keys, "g", F.lit(1).alias("part"), "n", F.col("core").alias("piece"), F.col("at").alias("low"), (F.col("at") + F.length("core")).alias("high"))
    none = F.lit(None).cast("long")
    left = edges.where("next <> g").select(*keys, F.col("next").alias("g"), F.lit(0).alias("part"), "n", F.right("core", F.lit(margin)).alias("piece"), none.alias("low"), none.alias("high"))
    right = edges.where("prev <> g").select(*keys, F.col("prev").alias("g"), F.lit(2).alias("part"), "n", F.left("core", F.lit(margin)).alias("piece"), none.alias("low"), none.alias("high"))
    whole = own.unionByName(left).unionByName(right).groupBy(*keys, "g").agg(
        F.min("low").alias("low"), F.max("high").alias("high"), F.bool_or(F.col("part") == 0).alias("before"), F.bool_or(F.col("part") == 2).alias("after"),
        F.sum(F.when(F.col("part") == 0, F.length("piece")).otherwise(0)).alias("ahead"),
        F.array_sort(F.collect_list(F.struct("part", "n", "piece"))).alias("pieces"))
    return whole.select(*keys, "g", (F.col("low") - F.col("ahead")).alias("start"), "low", "high", "before", "after", F.array_join(F.col("pieces")["piece"], "").alias("text"))


def _scan(windows: DataFrame, keys: list[str], rules: list[Rule]) -> DataFrame:
    """Candidates of every window at their places in the text, also those that begin in its margins."""
    found = windows.withColumn("_found", candidates(F.col("text"), rules)).withColumn("stop", F.col("start") + F.length("text"))
    spans = each(found, "_found", *keys, "g", "low", "high", "before", "after", F.col("start").alias("_from"), "stop", name="s")
    moved = {c: (F.col(f"s.{c}") + F.col("_from")).cast("long") for c in ("start", "end")}
    return spans.select(*keys, "g", "low", "high", "before", "after", "stop", *(moved[c].alias(c) for c in moved), "s.rule_ord", "s.rule_id", "s.category", "s.value")


def _open_edges(spans: DataFrame, keys: list[str], near: int) -> DataFrame:
    """``keys, edge``: edges between windows about which the two windows do not agree."""
    right = spans.where(F.col("after") & (F.col("start") >= F.col("high") - near) & (F.col("start") < F.col("high") + near)).withColumn("edge", F.col("high"))
    left = spans.where(F.col("before") & (F.col("start") >= F.col("low") - near) & (F.col("start") < F.col("low") + near)).withColumn("edge", F.col("low"))
    seen = right.select(*keys, "edge", "rule_ord", "start", "end", F.lit(1).alias("side")).unionByName(
        left.select(*keys, "edge", "rule_ord", "start", "end", F.lit(2).alias("side")))
    apart = seen.groupBy(*keys, "edge", "rule_ord", "start", "end").agg(F.count_distinct("side").alias("sides")).where("sides < 2").select(*keys, "edge")
    # A match that runs into the end of its window might go on behind it.
    cut = spans.where(F.col("after") & (F.col("start") < F.col("high")) & (F.col("end") >= F.col("stop"))).select(*keys, F.col("high").alias("edge"))
    return apart.unionByName(cut).distinct()


def match_long(docs: DataFrame, *keys: str, rules: Iterable[Rule] | None = None, text: str = "text", width: int = WIDTH, margin: int = MARGIN) -> DataFrame:
    """``keys, start, end, rule_ord, rule_id, category, value``: the candidates of :func:`detect.candidates`, for texts of any length.

    ``keys`` tell texts apart and are not null. Null and empty texts give no
    rows, and neither does an empty table. A rule that looks farther than half
    of ``margin`` around a match (or a lookbehind that does) is outside what
    windows can see.
    """
    # Names of keys may be those of columns made here.
    names, rules = [f"_key{i}" for i in range(len(keys))], BUILTIN_RULES if rules is None else list(rules)
    docs, text = docs.select(*(F.col(k).alias(n) for k, n in zip(keys, names)), F.col(text).alias("_text")), "_text"
    if not 0 < margin <= width:
        raise ValueError("the margin of windows is between one character and their width")
    # Only the last core of a text is shorter than the width.
    cores = materialize(cores_of(docs, names, text, width).withColumns({"at": F.col("n").cast("long") * width, "g": F.col("n")}), "cores")
    # Spans of the first scan are never written again: ``all_gone`` names the groups that ``fresh`` replaces.
    first = spans = materialize(_scan(_windows(cores, names, margin), names, rules), "spans")
    all_gone, fresh = None, None
    while True:
        edges = materialize(_open_edges(spans, names, margin // 2), "edges")
        if edges.isEmpty():
            break
        # Cores behind an open edge go to the group in front of it.
        joined = cores.select(*names, "n", "at", "g", "core").join(edges.withColumnRenamed("edge", "at").withColumn("open", F.lit(1)), [*names, "at"], "left")
        by = Window.partitionBy(*names).orderBy("n")
        begins = (F.col("g") != F.lag("g").over(by)) & F.col("open").isNull()
        grouped = joined.withColumn("_new", F.when(F.lag("g").over(by).isNull() | begins, F.col("n")))
        grouped = grouped.withColumn("_g", F.last("_new", ignorenulls=True).over(by))
        after = materialize(grouped.select(*names, "n", "at", F.col("_g").alias("g"), "core", (F.col("_g") != F.col("g")).alias("_moved")), "cores")
        # Groups that took in others, and their neighbours' view of the edges, which stays as it is.
        changed = materialize(after.where("_moved").select(*names, "g").distinct(), "changed")
        gone = materialize(cores.join(after.where("_moved").select(*names, "n"), [*names, "n"], "left_semi").select(*names, "g").distinct().unionByName(changed).distinct(), "gone")
        anew = _windows(after.drop("_moved"), names, margin).join(changed, [*names, "g"], "left_semi")
        scanned = _scan(anew, names, rules)
        more = materialize(scanned if fresh is None else fresh.join(gone, [*names, "g"], "left_anti").unionByName(scanned), "spans")
        every = gone if all_gone is None else materialize(all_gone.unionByName(gone).distinct(), "gone")
        discard(cores, edges, changed, *(t for t in (fresh, all_gone) if t is not None), *([gone] if every is not gone else []))
        cores, fresh, all_gone = after.drop("_moved"), more, every
        spans = first.join(F.broadcast(all_gone) if fits(all_gone) else all_gone, [*names, "g"], "left_anti").unionByName(fresh)
    owned = spans.where((F.col("start") >= F.col("low")) & (F.col("start") < F.col("high")))
    return owned.select(*(F.col(n).alias(k) for k, n in zip(keys, names)), F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), "rule_ord", "rule_id", "category", "value")


def detect_long(docs: DataFrame, *keys: str, rules: Iterable[Rule] | None = None, text: str = "text", width: int = WIDTH, margin: int = MARGIN) -> DataFrame:
    """The items of texts of any length as a table, overlaps resolved; columns as in :func:`match_long`."""
    return select_spans(match_long(docs, *keys, rules=rules, text=text, width=width, margin=margin), *keys)
