"""Overlap resolution on a table of spans, for texts with more spans than one row should hold.

The rule is that of the in-row form: longest first, then earliest, then lowest
``rule_ord``. Spans are range-partitioned by text and place and read in order
once: an island of spans that touches nothing outside is settled as soon as it
ends, so one shuffle settles nearly all of them, however long their text is.

Left open are islands at the edges of partitions, of which nobody sees whether
they go on, and islands too large to be held. They are settled in rounds: a span
that beats all spans it meets
is kept, and those it meets go. Which spans meet is never listed as pairs. A
span is only beaten by one at least as long, so spans are laid on grids of cells
as wide as the power of two below their length; seen from one cell, such a span
covers its beginning, its end, or all of it, and the best one that reaches a
place is a running maximum.

Rounds settle most spans quickly, but a long chain in which each span is beaten
by the one in front would take as many rounds as it has links. When a round
leaves more than half, the rest is cut into islands that touch nothing outside,
and each island is swept in order.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, ByteType, IntegerType, ShortType, StructField, StructType
from pyspark.sql.window import Window

from veilframe.operators.ranking import running_sum
from veilframe.session import discard, materialize

# Rounds at most, before what is left is swept.
ROUNDS = 12
# Spans of an island that one task holds; larger ones are settled in rounds.
HELD = 1 << 16
# Spans of an island up to which each is compared with all that are kept.
SMALL = 32


def _rank() -> Column:
    """Longer first, then earlier; no two different spans of a text share it."""
    return F.struct((F.col("end") - F.col("start")).alias("size"), (-F.col("start")).alias("first"))


def _cells(spans: DataFrame, level: Column) -> DataFrame:
    """A row for each cell of the grid of ``level`` that a span touches: its part of the cell, as ``low`` and ``high``."""
    at = spans.withColumn("level", level)
    width = F.expr("shiftleft(1L, level)")
    cells = at.withColumn("cell", F.explode(F.expr("sequence(shiftright(cast(start as long), level), shiftright(cast(end as long) - 1, level))")))
    edge = F.expr("shiftleft(cell, level)")
    return cells.withColumns({"edge": edge, "low": F.greatest(F.col("start").cast("long"), edge), "high": F.least(F.col("end").cast("long"), edge + width)})


def best_met(owners: DataFrame, spans: DataFrame, keys: list[str], levels: list[int]) -> DataFrame:
    """``keys, start, end, best``: of every span the rank of the best owner that it meets and that is no shorter class of length.

    ``levels`` are the classes (powers of two) of the owners' lengths.
    """
    none = F.lit(None).cast("long")
    starts = F.col("low") > F.col("edge")
    laid = _cells(owners, F.expr("length(bin(end - start)) - 1")).select(
        *keys, "level", "cell", starts.cast("int").alias("side"), F.when(starts, F.col("low")).otherwise(-F.col("high")).alias("place"),
        F.lit(1).alias("owner"), _rank().alias("rank"), none.alias("start"), none.alias("end"))
    own = F.expr("length(bin(end - start)) - 1")
    above = F.filter(F.array(*map(F.lit, levels)), lambda x: x >= own)
    asked = _cells(spans.select(*keys, "start", "end", F.explode(above).alias("level")), F.col("level"))
    sides = F.explode(F.array(F.struct(F.lit(0).alias("side"), (-F.col("low")).alias("place")), F.struct(F.lit(1).alias("side"), F.col("high").alias("place"))))
    asked = asked.withColumn("at", sides).select(
        *keys, "level", "cell", "at.side", "at.place", F.lit(0).alias("owner"), F.lit(None).cast("struct<size:bigint,first:bigint>").alias("rank"), "start", "end")
    # At one place those who ask come first: spans that only touch do not meet.
    sweep = Window.partitionBy(*keys, "level", "cell", "side").orderBy("place", "owner").rowsBetween(Window.unboundedPreceding, 0)
    seen = laid.unionByName(asked).withColumn("best", F.max("rank").over(sweep)).where("owner = 0 and best is not null")
    return seen.groupBy(*keys, "start", "end").agg(F.max("best").alias("best"))


def islands(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Add ``island``: a number per text for spans that are connected by overlaps. No text is held by one task."""
    order = ["start", "end"]
    laid = materialize(spans.select(*keys, *order).repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()), "laid")
    inside = Window.partitionBy("_part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    front = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    reach = laid.groupBy("_part", *keys).agg(F.max("end").alias("_end")).withColumn("_ahead", F.max("_end").over(front))
    reach = reach.where("_ahead is not null").select("_part", *keys, "_ahead")
    behind = laid.withColumn("_local", F.max("end").over(inside)).join(F.broadcast(reach), ["_part", *keys], "left")
    begins = F.col("start") >= F.coalesce(F.greatest("_local", "_ahead"), F.lit(-1))
    flagged = behind.select(*keys, *order, begins.alias("_begins"))
    return running_sum(flagged, keys, order, F.when(F.col("_begins"), 1).otherwise(0), "island").drop("_begins")


def _stays(starts: list[int], ends: list[int]) -> list[bool]:
    """Which spans of one island stay; they come best first, and each one is kept that meets none kept before.

    Kept spans lie in blocks as wide as the longest span, so a span looks into two of them at most.
    """
    width = ends[0] - starts[0]
    blocks: dict[int, list[tuple[int, int]]] = {}
    stays = []
    for start, end in zip(starts, ends):
        touched = range(start // width, (end - 1) // width + 1)
        clear = True
        for b in touched:
            held = blocks.get(b, ())
            at = bisect_left(held, (end, 0))
            if at and held[at - 1][1] > start:
                clear = False
                break
        stays.append(clear)
        if clear:
            for b in touched:
                held = blocks.setdefault(b, [])
                held.insert(bisect_left(held, (start, end)), (start, end))
    return stays


def sweep(rows: pd.DataFrame) -> pd.DataFrame:
    """The spans of one island that stay."""
    ranked = rows.assign(_size=rows["start"] - rows["end"]).sort_values(["_size", "start"])
    return ranked[_stays(ranked["start"].tolist(), ranked["end"].tolist())].drop(columns="_size")


def _kept(island: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which of different spans stay; they come in order, each with the number of its island (from 0, none left out)."""
    stays = np.ones(len(island), bool)
    sizes = np.bincount(island)
    many = np.flatnonzero(sizes[island] > 1)
    if not len(many):
        return stays
    many = many[np.lexsort((start[many], start[many] - end[many], island[many]))]
    cuts = np.flatnonzero(np.diff(island[many], prepend=-1, append=-1)).tolist()
    starts, ends, out = start[many].tolist(), end[many].tolist(), []
    for low, high in zip(cuts, cuts[1:]):
        if high - low > SMALL:
            out += _stays(starts[low:high], ends[low:high])
            continue
        chosen: list[tuple[int, int]] = []
        for n in range(low, high):
            s, e = starts[n], ends[n]
            clear = all(e <= a or s >= b for a, b in chosen)
            out.append(clear)
            if clear:
                chosen.append((s, e))
    stays[many] = out
    return stays


def _settled(spans: DataFrame, longest: int, most: int) -> DataFrame:
    """Spans that stay, and with ``_open`` those of islands that a task does not see whole or can't hold.

    ``spans`` are sorted by ``_text, start, end`` inside partitions cut by range of the same. Spans of the
    partition in front begin no later than the first one here, so they end within ``longest`` of it.
    """
    schema = StructType([*spans.schema.fields, StructField("_open", BooleanType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        # Text and end of an island that is handed on open; at first one that may come from the partition in front.
        text, reach = None, 0

        def out(rows: pa.Table, open_: bool) -> Iterator[pa.RecordBatch]:
            yield from rows.append_column("_open", pa.array(np.full(len(rows), open_))).combine_chunks().to_batches()

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([*held, batch]).combine_chunks()
            start, end = (rows[c].to_numpy().astype(np.int64) for c in ("start", "end"))
            texts = rows["_text"].dictionary_encode().combine_chunks()
            codes = (texts.chunk(0) if isinstance(texts, pa.ChunkedArray) else texts).indices.to_numpy().astype(np.int64)
            base, ahead = int(start.min()), -1
            if text is None:
                ahead = int(start[0]) - base + longest
            elif not held and rows["_text"][0].as_py() == text:
                ahead = reach - base
            # Equal texts lie together, so codes rise; spans of a later text lie behind all of an earlier one.
            stride = max(int(end.max()) - base, ahead) + 1
            low, high = start - base + codes * stride, end - base + codes * stride
            front = np.concatenate(([ahead], np.maximum(np.maximum.accumulate(high)[:-1], ahead)))
            begins = np.flatnonzero(low >= front)
            first = int(begins[0]) if len(begins) else len(rows)
            if first:
                yield from out(rows.slice(0, first), True)
                reach = max(ahead, int(high[:first].max())) - int(codes[first - 1]) * stride + base
                text = rows["_text"][first - 1].as_py()
            held = []
            if len(begins):
                last = int(begins[-1])
                if last > first:
                    island = np.cumsum(low[first:last] >= front[first:last]) - 1
                    lo, hi = low[first:last], high[first:last]
                    new = np.concatenate(([True], (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])))
                    stays = np.flatnonzero(new)
                    stays = stays[_kept(island[stays], lo[stays], hi[stays])]
                    yield from out(rows.take(stays + first), False)
                tail = rows.slice(last)
                if len(tail) > most:
                    yield from out(tail, True)
                    text, reach = rows["_text"][len(rows) - 1].as_py(), int(high[last:].max()) - int(codes[-1]) * stride + base
                else:
                    text, held = "", tail.to_batches()
        if held:
            yield from out(pa.Table.from_batches(held), True)

    return spans.mapInArrow(run, schema)


def select_spans(items: DataFrame, *keys: str, rounds: int = ROUNDS, held: int = HELD) -> DataFrame:
    """The rows of ``items(keys, start, end, rule_ord, …)`` that stay when overlaps are resolved.

    Rows with the same span of a text are one, the one with the lowest
    ``rule_ord``. Spans have at least one character; others are left out. Rows
    with a null key are texts like others. An empty table gives an empty one.
    Places are returned as ints, or as longs where a column of them is no int,
    as in texts of more than 2^31 characters.
    """
    small = all(isinstance(items.schema[c].dataType, (ByteType, ShortType, IntegerType)) for c in ("start", "end"))
    names, rest = list(keys), [c for c in items.columns if c not in (*keys, "start", "end")]
    order = ["rule_ord", *(c for c in rest if c != "rule_ord")]
    items = items.withColumns({c: F.col(c).cast("long") for c in ("start", "end")})
    # As JSON, the keys of a text are one value that is never null.
    text = F.to_json(F.struct(*(F.col(c).cast("string").alias(c) for c in names)))
    found = materialize(items.where("end > start").withColumn("_text", text).withColumn("_hash", F.xxhash64("_text")), "found-spans")
    place = ["_hash", "_text", "start", "end"]
    laid = found.repartitionByRange(*place).sortWithinPartitions(*place, *order).drop("_hash")
    longest = found.agg(F.max(F.col("end") - F.col("start"))).first()[0] or 0
    settled = materialize(_settled(laid, longest, held), "settled")
    discard(found)
    done = settled.where("not _open").select(*names, "start", "end", *rest)
    left = settled.where("_open").drop("_open")
    stays = done if left.isEmpty() else done.unionByName(_in_rounds(left, names, rest, order, rounds))
    return stays.withColumns({c: F.col(c).cast("int") for c in ("start", "end")}) if small else stays


def _in_rounds(items: DataFrame, names: list[str], rest: list[str], order: list[str], rounds: int) -> DataFrame:
    """The spans of whole islands, of any size, that stay."""
    one = materialize(items.groupBy(*names, "_text", "start", "end").agg(F.min(F.struct(*order)).alias("_rest")), "spans")
    by, span = ["_text"], ["_text", "start", "end"]
    left, kept = one.select(*span), None
    size = left.count()
    for _ in range(rounds):
        if not size:
            break
        levels = sorted(r[0] for r in left.select(F.expr("length(bin(end - start)) - 1")).distinct().collect())
        judged = left.join(best_met(left, left, by, levels), span).withColumn("_wins", F.col("best") == _rank())
        judged = materialize(judged, "judged")
        winners = judged.where("_wins").select(*span)
        kept = winners if kept is None else kept.unionByName(winners)
        others = judged.where("not _wins").select(*span)
        left = materialize(others.join(best_met(winners, others, by, levels), span, "left_anti"), "left")
        before, size = size, left.count()
        if size * 2 > before:
            break
    if size:
        schema = "_text string, start long, end long"
        swept = islands(left, by).groupBy(*by, "island").applyInPandas(lambda rows: sweep(rows)[span], schema)
        kept = swept if kept is None else kept.unionByName(swept)
    stays = one if kept is None else one.join(kept, span, "left_semi")
    return stays.select(*names, "start", "end", *(F.col("_rest")[c].alias(c) for c in rest))
