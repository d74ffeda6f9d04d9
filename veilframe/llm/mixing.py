"""Mixes sources to target weights by a low-discrepancy schedule of blocks.

Each source's documents are shuffled by a hash and laid end to end; the stream
is cut into blocks of ``block`` tokens (words). Slots of the mix are points of
the golden-ratio sequence: point ``i`` is the fraction of ``i`` times the golden
ratio, scaled to the number of slots, and the cumulative block counts of the
sources say whose slot it is. The ``r``-th slot of a source takes the ``r``-th
block of its stream; past its end the stream starts again. So every stretch of
the mix holds every source in nearly its share, and the whole mix holds each
source's target to the token: slots beyond a source's last block fall away, and
blocks that found no slot come at the end.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.operators.lookup import lookup
from veilframe.operators.ranking import numbered_rows, running_sum
from veilframe.session import materialize

# Tokens of a block.
BLOCK = 1024
# The golden ratio's fraction as a 64-bit fixed-point number.
GOLDEN = 0x9E3779B97F4A7C15
WORDS = r"[^\x20\x09-\x0D]+"


def word_count(text: str) -> Column:
    """Number of words, 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORDS)), F.lit(0)).cast("long")


@dataclass
class Mix:
    """``sources``: source, source_no, source_size, target (double), take (long).
    ``schedule``: slot, source_no, pass, block, from_word, to_word (places in the source's stream).
    ``documents``: the given columns, source_no, begin, end (places in its source's stream).
    ``pieces``: slot, pass, block, source_no, begin, doc_id, from_word, to_word (places in the document).
    ``taken``: doc_id, source, size, and what other columns were given, begin, taken."""

    sources: DataFrame
    schedule: DataFrame
    documents: DataFrame
    pieces: DataFrame
    taken: DataFrame


def targets(sizes: DataFrame, weights: list[int], share: float, most: float) -> DataFrame:
    """How many tokens to take of each source.

    ``sizes``: source, source_size. By code point, null last, the sources have
    ``weights``, repeating, and share ``share`` times all sizes. None gets above
    ``most`` times its own size; what it can't take is shared again by weight.
    In the end all others have the same amount for each unit of weight, the
    water level: the first, in order of size by weight, at which the sources
    below it are full and the rest share what remains.
    """
    order = [F.col("source").isNull().alias("_null"), F.col("source")]
    with_key = sizes.withColumn("_all", F.lit(0)).withColumn("_null", order[0])
    placed = numbered_rows(with_key, ["_all"], ["_null", "source"], "source_no").withColumn("source_no", F.col("source_no") - 1)
    weight = F.element_at(F.array(*(F.lit(w) for w in weights)), (F.col("source_no") % len(weights) + 1).cast("int")).cast("long")
    weighed = materialize(placed.withColumn("weight", weight).withColumn("_ratio", F.col("source_size") / F.col("weight")), "sources")
    full = running_sum(weighed, ["_all"], ["_ratio", "source_no"], F.col("source_size"), "_size_to")
    full = running_sum(full, ["_all"], ["_ratio", "source_no"], F.col("weight"), "_weight_to")
    sums = weighed.agg(F.sum("source_size").alias("s"), F.sum("weight").alias("w")).first()
    total, all_weights = share * (sums["s"] or 0), sums["w"] or 0
    remains = F.lit(float(total)) - most * (F.col("_size_to") - F.col("source_size"))
    level = remains / (F.lit(all_weights) - F.col("_weight_to") + F.col("weight"))
    fits = full.where(most * F.col("_ratio") >= level).agg(F.min_by(level, F.struct("_ratio", "source_no")).alias("level")).first()["level"]
    cap = most * F.col("source_size")
    target = cap if fits is None else F.least(cap, F.lit(fits) * F.col("weight"))
    return materialize(weighed.select(
        "source", "source_no", "source_size", target.cast("double").alias("target")).withColumn(
        "take", F.least(F.round("target").cast("long"), F.floor(cap).cast("long"))), "targets")


def mix(docs: DataFrame, weights: list[int], share: float, most: float = 2.0, block: int = BLOCK, seed: str = "mix") -> Mix:
    """Plan a mix of ``docs(doc_id, source, size, ...)``.

    ``most`` is a whole number or a half. A null source is a source of its own;
    null sizes count as 0; a document without words is taken 0 times; equal rows
    are separate documents; an empty table gives empty tables. Runs agree: the
    order depends on the rows alone. Columns other than those named are kept in
    ``documents`` and ``taken`` and take part in the order of equal ids, but for
    those named like a column of the result, which are left out.
    """
    key = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))
    given = [c for c in docs.columns if c not in ("doc_id", "source", "size", "source_no", "begin", "end", "taken")]
    extra = [f"_x{i}" for i in range(len(given))]
    back = dict(zip(extra, given))
    own = docs.select("doc_id", "source", F.coalesce(F.col("size"), F.lit(0)).cast("long").alias("size"), key.alias("_key"),
                      *(F.col(f"`{c}`").alias(x) for c, x in zip(given, extra)))
    sizes = own.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = targets(sizes, weights, share, most)
    blocks = F.ceil(F.col("source_size") / block).cast("long")
    whole = F.when(F.col("source_size") > 0, F.expr("take div source_size")).otherwise(F.lit(0)).cast("long")
    sources = sources.withColumns({"_blocks": blocks, "_whole": whole}).withColumn(
        "_rest", F.col("take") - F.col("_whole") * F.col("source_size")).withColumn(
        "_slots", F.col("_whole") * F.col("_blocks") + F.ceil(F.col("_rest") / block).cast("long"))
    sources = materialize(running_sum(sources.withColumn("_all", F.lit(0)), ["_all"], ["source_no"], F.col("_slots"), "_to"), "sources")
    schedule = materialize(_schedule(sources, block), "schedule")

    small = sources.select(key.alias("_key"), "source_no")
    numbered = lookup(own, small, ["_key"])
    order = numbered.withColumn("_order", F.xxhash64(F.lit(seed), "doc_id"))
    documents = running_sum(order, ["source_no"], ["_order", "doc_id", "size", *extra], F.col("size"), "end").withColumn(
        "begin", F.col("end") - F.col("size")).drop("_order", "_key")
    documents = materialize(documents, "documents")

    spread = documents.where("size > 0").withColumn(
        "block", F.explode(F.sequence(F.expr(f"begin div {block}"), F.expr(f"(end - 1) div {block}"))))
    met = spread.join(schedule, ["source_no", "block"])
    first, last = F.greatest("begin", "start_word"), F.least("end", "stop_word")
    pieces = met.where(first < last).select(
        "slot", "pass", "block", "source_no", "begin", "doc_id", (first - F.col("begin")).alias("from_word"), (last - F.col("begin")).alias("to_word"))
    # A document with words has a place of its own in its source's stream.
    sums = pieces.groupBy("source_no", "begin").agg(F.sum(F.col("to_word") - F.col("from_word")).alias("taken"))
    with_words = documents.where("size > 0").join(sums, ["source_no", "begin"], "left")
    without = documents.where("size = 0").withColumn("taken", F.lit(None).cast("long"))
    columns = ["doc_id", "source", "source_no", "size", *extra, "begin"]
    taken = with_words.select(*columns, "taken").unionByName(without.select(*columns, "taken")).withColumn(
        "taken", F.coalesce("taken", F.lit(0)))
    public = sources.select("source", "source_no", "source_size", "target", "take")
    return Mix(public, schedule.withColumnsRenamed({"start_word": "from_word", "stop_word": "to_word"}), documents.withColumnsRenamed(back), pieces,
               taken.withColumnsRenamed(back))


def _schedule(sources: DataFrame, block: int) -> DataFrame:
    """slot, source_no, pass, block, start_word, stop_word, for all slots of the mix."""
    spark = sources.sparkSession
    found = sources.agg(F.sum("_slots").alias("n"), F.count(F.lit(1)).alias("s")).first()
    slots, count = found["n"] or 0, max(1, found["s"])

    @F.pandas_udf("long")
    def point(i: pd.Series) -> pd.Series:
        x = (i.to_numpy().astype(np.uint64) + np.uint64(1)) * np.uint64(GOLDEN)
        return pd.Series(np.minimum((x >> np.uint64(11)).astype(np.float64) * 2.0**-53 * slots, slots - 1).astype(np.int64))

    # A source's interval covers cells of an even grid, one cell a source on average; points meet it in their cell.
    held = sources.where("_slots > 0").select("source_no", "_slots", (F.col("_to") - F.col("_slots")).alias("_from"), "_to")
    cell = lambda c: F.floor(F.col(c) / F.lit(max(1, slots)) * count).cast("long")
    covered = held.withColumn("_last", F.col("_to") - 1).withColumn("_cell", F.explode(F.sequence(cell("_from"), cell("_last"))))
    points = spark.range(slots).select(F.col("id").alias("slot"), point("id").alias("_point")).withColumn("_cell", cell("_point"))
    hit = points.join(covered, "_cell").where("_point >= _from and _point < _to").select("slot", "source_no")
    ranked = materialize(numbered_rows(hit, ["source_no"], ["slot"], "_rank"), "slots")

    # Blocks whose source got fewer slots than it has blocks come at the end.
    got = ranked.groupBy("source_no").agg(F.count(F.lit(1)).alias("_got"))
    lack = sources.join(got, "source_no", "left").select(
        "source_no", "_slots", F.coalesce("_got", F.lit(0)).alias("_got")).where("_got < _slots").withColumn("_all", F.lit(0))
    lack = running_sum(lack, ["_all"], ["source_no"], F.col("_slots") - F.col("_got"), "_lack_to")
    tail = lack.select("source_no", "_slots", "_lack_to", F.explode(F.sequence(F.col("_got") + 1, F.col("_slots"))).alias("_rank")).select(
        (F.lit(slots) + F.col("_lack_to") - F.col("_slots") + F.col("_rank") - 1).alias("slot"), "source_no", "_rank")
    every = ranked.unionByName(tail)
    plan = sources.where("_slots > 0").select("source_no", "source_size", "_blocks", "_whole", "_rest", "_slots")
    nth = F.col("_rank") - 1
    met = lookup(every, plan, ["source_no"]).where("_rank <= _slots").withColumns({
        "pass": F.expr("(_rank - 1) div _blocks"), "block": nth % F.col("_blocks")})
    stop = F.when(F.col("pass") == F.col("_whole"), F.col("_rest")).otherwise(F.col("source_size"))
    return met.select(
        "slot", "source_no", "pass", "block", (F.col("block") * block).alias("start_word"),
        F.least((F.col("block") + 1) * block, stop).alias("stop_word"))
