"""The rule configuration as JSON: disabled built-ins, custom rules, retention per rule."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.functions.retention import RETENTION, sane
from veilframe.operators.rules import BUILTIN_RULES, RULES_SCHEMA, regex_problem, rules_table

VERSION = 1
CONFIG = (
    "version int, disabledBuiltins array<string>, "
    "customPatterns array<struct<id:string,name:string,category:string,regex:string,example:string,enabled:boolean>>, "
    f"retention map<string,{RETENTION}>"
)


def rules_from_json(spark: SparkSession, text: str | None) -> DataFrame:
    """The effective rule table of a stored configuration.

    A missing, broken or differently versioned configuration means the
    defaults; custom rules that do not compile and malformed retentions are
    dropped. One configuration is one small document, so its few regexes are
    tried out one by one.
    """
    base = rules_table(spark)
    if not text:
        return base
    config = spark.createDataFrame([(text,)], "json string").select(
        F.from_json("json", CONFIG, {"mode": "PERMISSIVE"}).alias("c")).select("c.*").first()
    if config is None or config["version"] != VERSION:
        return base
    off = set(config["disabledBuiltins"] or [])
    customs = [c for c in config["customPatterns"] or []
               if c is not None and c["regex"] is not None and regex_problem(spark, c["regex"]) is None]
    rows = [(len(BUILTIN_RULES) + n, c["id"], c["name"], c["category"], "custom", c["regex"], c["example"],
             bool(c["enabled"]), None) for n, c in enumerate(customs)]
    rules = base.withColumn("enabled", ~F.col("id").isin(list(off))).unionByName(
        spark.createDataFrame(rows, RULES_SCHEMA))
    kept = [(k, tuple(v)) for k, v in (config["retention"] or {}).items() if v is not None]
    settings = spark.createDataFrame(kept, f"id string, _kept {RETENTION}").where(
        sane(F.col("_kept")) & (F.col("_kept.mode") != "none"))
    return rules.join(F.broadcast(settings), "id", "left").withColumn("retention", F.col("_kept")).select(
        *base.columns)


def rules_to_json(table: DataFrame) -> str:
    """The configuration of a rule table."""
    entry = F.struct("id", "name", "category", "regex", "example", "enabled")
    custom, kept = F.col("source") == "custom", F.col("retention.mode") != "none"
    packed = table.orderBy("rule_ord").agg(
        F.lit(VERSION).alias("version"),
        F.array_sort(F.collect_list(F.when(~custom & ~F.col("enabled"), F.col("id")))).alias("disabledBuiltins"),
        F.transform(F.array_sort(F.collect_list(F.when(custom, F.struct("rule_ord", entry.alias("e"))))),
                    lambda r: r["e"]).alias("customPatterns"),
        F.map_from_entries(F.collect_list(F.when(kept, F.struct("id", "retention")))).alias("retention"))
    return packed.select(F.to_json(F.struct("*")).alias("json")).first()["json"]
