"""File names of outputs, kept unique over a batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veilframe.operators.lookup import lookup
from veilframe.operators.ranking import running_sum
from veilframe.session import materialize


def _dot(name: Column) -> Column:
    """Length in front of the last dot; 0 where there is no extension."""
    return F.length(F.regexp_extract(name, r"^([\s\S]+)\.[^.]*\z", 1))


def output_file_name(name: Column, suffix: str) -> Column:
    """``report.txt`` -> ``report.deid.txt``; a leading dot starts no extension."""
    dot = _dot(name)
    return F.when(dot == 0, F.concat(name, F.lit(f".{suffix}"))).otherwise(F.concat(
        F.left(name, dot), F.lit(f".{suffix}"), F.substring(name, dot + 1, F.length(name))))


def mapping_file_name(name: Column) -> Column:
    dot = _dot(name)
    return F.concat(F.when(dot == 0, name).otherwise(F.left(name, dot)), F.lit(".mapping.csv"))


def numbered(name: Column, n: Column) -> Column:
    """``a.txt`` -> ``a (2).txt``."""
    dot = _dot(name)
    tag = F.concat(F.lit(" ("), n.cast("string"), F.lit(")"))
    return F.when(n < 2, name).when(dot == 0, F.concat(name, tag)).otherwise(F.concat(
        F.left(name, dot), tag, F.substring(name, dot + 1, F.length(name))))


NUMBERED = r"^([\s\S]*) \(([2-9]|[1-9][0-9]+)\)(\.[^.]*)?\z"


def _parent(name: Column) -> Column:
    """The name that numbering turns into ``name`` (``a (2).txt`` -> ``a.txt``), or null."""
    stem, ext = F.regexp_extract(name, NUMBERED, 1), F.regexp_extract(name, NUMBERED, 3)
    parent = F.concat(stem, ext)
    number = F.regexp_extract(name, NUMBERED, 2).cast("int")
    return F.when(F.length(stem) > 0, F.when(numbered(parent, number) == name, parent))


def unique_names(rows: DataFrame, name: str, order: list[str], into: str = "unique_name") -> DataFrame:
    """Make names unique in order: repeats become ``a (2).txt``, ``a (3).txt`` …

    A name already in use is skipped, also when it was someone's own name. Only
    the group of ``a.txt`` and the group of ``a (2).txt`` can want the same
    name, and the earlier row has it. So per group it is enough to know, for
    each such own name, how many rows of the group came before it.
    """
    base = rows.withColumn("_name", F.col(name))
    place = F.struct(*order)
    firsts = base.groupBy("_name").agg(F.min(place).alias("_first")).select(
        _parent(F.col("_name")).alias("_parent"), F.col("_name").alias("_child"), "_first")
    parents = base.select(F.col("_name").alias("_parent")).distinct()
    rivals = materialize(firsts.where("_parent is not null").join(parents, "_parent", "left_semi").select(
        "_parent", "_child", F.regexp_extract("_child", NUMBERED, 2).cast("int").alias("_k"), "_first"), "rival-names")

    # Rank the rows of each group, with rivals placed among them.
    own = base.select("_name", place.alias("_place"), F.lit(None).cast("string").alias("_child"))
    marks = rivals.select(F.col("_parent").alias("_name"), F.col("_first").alias("_place"), "_child")
    ranked = running_sum(own.unionByName(marks), ["_name"], ["_place"], F.col("_child").isNull().cast("int"), "_rank")
    before = materialize(ranked.where("_child is not null").select(
        F.col("_name").alias("_parent"), "_child", F.col("_rank").alias("_before")).join(
        rivals, ["_parent", "_child"]), "rivals")
    ranks = ranked.where("_child is null").select("_name", "_place", "_rank")

    # Parents first: whether a rival keeps its own name decides where its group starts.
    lost = before.select(F.col("_child").alias("_name"), F.lit(0).alias("_offset")).limit(0)
    skips = None
    level = before.select(F.col("_parent").alias("_name")).distinct().join(
        before.select(F.col("_child").alias("_name")).distinct(), "_name", "left_anti")
    while not level.isEmpty():
        walked = materialize(_walk(before, level, lost), "name-levels")
        skips = walked if skips is None else skips.unionByName(walked)
        judged = walked.select("_name", F.explode("_fate").alias("f")).select(
            F.col("f.child").alias("_name"), F.col("f.lost").cast("int").alias("_offset"))
        lost = lost.unionByName(judged)
        level = judged.select("_name").distinct().join(
            before.select(F.col("_parent").alias("_name")).distinct(), "_name", "left_semi")
    out = ranks
    if skips is None:
        number = F.col("_rank")
    else:
        jumps = skips.select("_name", F.filter("_fate", lambda f: ~f["lost"]).alias("_jumps"))
        # One name may hold most rows: such names are answered by a broadcast.
        out = lookup(lookup(out, lost, ["_name"]), jumps, ["_name"])
        start = F.col("_rank") + F.coalesce("_offset", F.lit(0))
        number = F.coalesce(F.aggregate("_jumps", start, lambda n, f: F.when(f["k"] <= n, n + 1).otherwise(n)), start)
    named = out.select("_place", numbered(F.col("_name"), number).alias(into))
    return rows.withColumn("_place", place).join(named, "_place").drop("_place")


def _walk(before: DataFrame, level: DataFrame, lost: DataFrame) -> DataFrame:
    """For each group of a level: which rivals lose their own name to it, in order of their number."""
    rivals = before.join(level, before["_parent"] == level["_name"], "left_semi").groupBy(
        F.col("_parent").alias("_name")).agg(F.array_sort(F.collect_list(F.struct(
            F.col("_k").alias("k"), F.col("_before").alias("n"), F.col("_child").alias("child")))).alias("_rivals"))

    def step(acc: Column, r: Column) -> Column:
        taken = r["n"] + acc["shift"] >= r["k"]
        fate = F.struct(r["k"].alias("k"), r["child"].alias("child"), taken.alias("lost"))
        return F.struct(
            F.when(taken, acc["shift"]).otherwise(acc["shift"] + 1).alias("shift"),
            F.array_append(acc["fate"], fate).alias("fate"))

    zero = F.struct(F.coalesce("_offset", F.lit(0)).cast("long").alias("shift"),
                    F.array().cast("array<struct<k:int,child:string,lost:boolean>>").alias("fate"))
    return rivals.join(lost, "_name", "left").select(
        "_name", F.aggregate("_rivals", zero, step, lambda acc: acc["fate"]).alias("_fate"))
