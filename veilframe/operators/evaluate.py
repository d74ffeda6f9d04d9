"""Scoring detected text, values and shapes against answer keys."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType
from pyspark.sql.window import Window

from veilframe.functions import fixed_values as fv
from veilframe.functions.text import each
from veilframe.session import materialize

# Cells in which boxes meet, in points: about the size of a form field.
GRID = 128.0
# White space (that of ``fixed_values.WS``) as code points.
SPACES = np.array([*range(9, 14), 0x20, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF])
# Characters of a long text that are counted together.
PART = 1 << 20
_BAG_TYPE = ArrayType(StructType([StructField("code", IntegerType()), StructField("n", LongType())]))


def _counted(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The code points of a text that are no white space, ascending, and how often each occurs.

    Compatibility forms (full and half width, ligatures, circled digits) count as their plain characters.
    """
    if text.isascii():
        counts = np.bincount(np.frombuffer(text, np.uint8), minlength=128)
        codes = np.flatnonzero(counts)
        counts = counts[codes]
    else:
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for part in _parts(text.decode("utf-8", "replace")):
            plain = unicodedata.normalize("NFKC", part)
            found.append(np.unique(np.frombuffer(plain.encode("utf-32-le"), np.uint32), return_counts=True))
        codes, at = np.unique(np.concatenate([c for c, _ in found]), return_inverse=True)
        counts = np.bincount(at, np.concatenate([n for _, n in found])).astype(np.int64)
    keep = ~np.isin(codes, SPACES)
    return codes[keep].astype(np.int32), counts[keep].astype(np.int64)


def _parts(text: str) -> Iterator[str]:
    """A long text in parts that begin with a space, which no character in front of it combines with."""
    low = 0
    while len(text) - low > PART and (cut := text.find(" ", low + PART)) > 0:
        yield text[low:cut]
        low = cut
    yield text[low:]


BAG = "array<struct<code:int,n:bigint>>"


def _bags(docs: DataFrame, key: str, text: str, into: str) -> DataFrame:
    """``key, into``: the multiset of every text's characters as code points with their counts, in order."""
    rows = docs.select(key, F.coalesce(F.col(text), F.lit("")).alias("_text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            found = [_counted(texts[n].as_buffer().to_pybytes()) for n in range(len(texts))]
            ends = pa.array(np.cumsum([0, *(len(c) for c, _ in found)]).astype(np.int32))
            codes = pa.array(np.concatenate([np.empty(0, np.int32), *(c for c, _ in found)]))
            counts = pa.array(np.concatenate([np.empty(0, np.int64), *(n for _, n in found)]))
            bags = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([codes, counts], names=["code", "n"]))
            yield pa.RecordBatch.from_arrays([batch.column(0), bags], names=[key, into])

    return rows.mapInArrow(run, StructType([rows.schema[key], StructField(into, _BAG_TYPE)]))


def _met(left: DataFrame, right: DataFrame, key: str, how: str) -> DataFrame:
    """``key, _l, _r, _n``: bags of one key, and for each character of ``_l`` how often ``_r`` has it."""
    none = F.array().cast(BAG)
    both = left.join(right, key, how).select(key, F.coalesce("_l", none).alias("_l"), F.coalesce("_r", none).alias("_r"))

    def numbered(bags: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        """The row and code point of every entry as one number, ascending, and its count."""
        row = np.repeat(np.arange(len(bags)), np.diff(bags.offsets.to_numpy()))
        entries = bags.flatten()
        return row << 32 | entries.field("code").to_numpy().astype(np.int64), entries.field("n").to_numpy()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (l, _), (r, n) = numbered(batch["_l"]), numbered(batch["_r"])
            at = np.searchsorted(r, l)
            found = np.zeros(len(l), np.int64)
            if len(r):
                at = np.minimum(at, len(r) - 1)
                found = np.where(r[at] == l, n[at], 0)
            ends = np.concatenate(([0], np.cumsum(np.diff(batch["_l"].offsets.to_numpy())))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(ends), pa.array(found))], names=[*batch.schema.names, "_n"])

    return both.mapInArrow(run, StructType([*both.schema.fields, StructField("_n", ArrayType(LongType()))]))


def _total(bag_: Column) -> Column:
    return F.aggregate(bag_, F.lit(0).cast("long"), lambda acc, x: acc + x["n"])


def _character(code: Column) -> Column:
    return F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")


def characters(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """The multiset of characters of every document, white space left out: (key, ch, n)."""
    return each(_bags(docs, key, text, "_bag"), "_bag", key, name="c").select(key, _character(F.col("c.code")).alias("ch"), "c.n")


def character_scores(truth: DataFrame, read: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Characters in the truth, in the reading, and in both, without regard to order.

    A document without a character on either side has no row. The two tables
    meet once, a row for each document.
    """
    met = _met(_bags(truth, key, text, "_l"), _bags(read, key, text, "_r"), key, "full")
    same = F.aggregate(F.zip_with("_l", "_n", lambda x, n: F.least(x["n"], n)), F.lit(0).cast("long"), lambda acc, n: acc + n)
    both = met.select(key, _total(F.col("_l")).alias("truth"), _total(F.col("_r")).alias("read"), same.alias("same")).where("truth + read > 0")
    return both.withColumn("recall", F.col("same") / F.greatest(F.col("truth"), F.lit(1))).withColumn(
        "precision", F.col("same") / F.greatest(F.col("read"), F.lit(1)))


def character_difference(left: DataFrame, right: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Characters ``left`` has more often than ``right``: (key, ch, n)."""
    met = _met(_bags(left, key, text, "_l"), _bags(right, key, text, "_r"), key, "left")
    more = F.filter(F.zip_with("_l", "_n", lambda x, n: F.struct(x["code"].alias("code"), (x["n"] - n).alias("n"))), lambda x: x["n"] > 0)
    return each(met.select(key, more.alias("_more")), "_more", key, name="c").select(key, _character(F.col("c.code")).alias("ch"), "c.n")


def value_hits(truth: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Per kind of truth (printed, handwritten): values expected and values found."""
    hits = found.select(key, "category", "value").distinct().withColumn("_hit", F.lit(1))
    return truth.join(hits, [key, "category", "value"], "left").groupBy("kind").agg(
        F.count(F.lit(1)).alias("expected"), F.count("_hit").alias("hits"))


def false_alarms(truth: DataFrame, found: DataFrame, key: str, tasks: int | None = None) -> DataFrame:
    """Found values nobody expected, told apart: misread (masked all the same) or wrong.

    A value of the truth found under another category is no alarm. ``manual``
    truth values only excuse, they are not expected. Misread means the same
    category and at most a fifth of the characters (at least one) different
    from a missed value, spaces not counted. ``tasks`` share the work (by
    default as many as Spark deals out).
    """
    named = truth.where(F.col(key).isNotNull() & F.col("value").isNotNull())
    sides = named.select(key, "category", "value", F.lit(False).alias("_seen"), (F.col("kind") != "manual").alias("_expected"), F.lit(True).alias("_true")).unionByName(
        found.select(key, "category", "value", F.lit(True).alias("_seen"), F.lit(False).alias("_expected"), F.lit(False).alias("_true")))
    # One exchange serves the grouping and the window: every value of a page is in one task, a page need not be.
    flags = sides.repartition(*([tasks] if tasks else []), key, "value").groupBy(key, "category", "value").agg(*(F.bool_or(c).alias(c) for c in ("_seen", "_expected", "_true")))
    excused = F.bool_or("_true").over(Window.partitionBy(key, "value"))
    extra, missed = F.col("_seen") & ~F.col("_excused"), F.col("_expected") & ~F.col("_seen")
    judged = materialize(flags.withColumn("_excused", excused).where(extra | missed).select(
        key, "category", "value", extra.alias("_extra"), F.regexp_replace("value", F.lit(fv.WS), F.lit("")).alias("_bare")), "judged-values")
    alarms = judged.where("_extra")
    m = judged.where("not _extra").select(F.col(key).alias("_key"), F.col("category").alias("_category"), F.col("_bare").alias("_missed"))
    slack = F.greatest(F.lit(1), F.floor(F.length("_missed") * 0.2 + 0.5)).cast("int")
    near = ((F.col(key) == F.col("_key")) & (F.col("category") == F.col("_category")) & (F.abs(F.length("_bare") - F.length("_missed")) <= slack)
            & (F.levenshtein("_bare", "_missed") <= slack))
    told = lambda how, misread: alarms.join(m, near, how).select(key, "category", "value", F.lit(misread).alias("misread"))
    return told("left_semi", True).unionByName(told("left_anti", False))


# -------------------------------------------------------------------- shapes
def _cells(low_x: Column, low_y: Column, high_x: Column, high_y: Column, size: float = GRID) -> Column:
    """The grid cells a box touches."""
    xs = F.sequence(F.floor(low_x / size), F.floor(high_x / size))
    ys = F.sequence(F.floor(low_y / size), F.floor(high_y / size))
    return F.flatten(F.transform(xs, lambda x: F.transform(ys, lambda y: F.struct(x.alias("gx"), y.alias("gy")))))


def _boxes(df: DataFrame, key: str, tag: str, extra: list[str]) -> DataFrame:
    return df.select(key, *[F.col(c).alias(f"{tag}_{c}") for c in ("box_id", "x", "y", "width", "height", *extra)])


def _gridded(df: DataFrame, tag: str, margin: float = 0.0) -> DataFrame:
    x, y = F.col(f"{tag}_x"), F.col(f"{tag}_y")
    return df.withColumn("_cell", F.explode(_cells(
        x - margin, y - margin, x + F.col(f"{tag}_width") + margin, y + F.col(f"{tag}_height") + margin)))


def _inter() -> Column:
    """The area that two boxes have in common."""
    right = lambda s: F.col(f"{s}_x") + F.col(f"{s}_width")
    top = lambda s: F.col(f"{s}_y") + F.col(f"{s}_height")
    w = F.greatest(F.lit(0.0), F.least(right("t"), right("f")) - F.greatest("t_x", "f_x"))
    return w * F.greatest(F.lit(0.0), F.least(top("t"), top("f")) - F.greatest("t_y", "f_y"))


def _iou() -> Column:
    return F.try_divide(_inter(), F.col("t_width") * F.col("t_height") + F.col("f_width") * F.col("f_height") - _inter())


def box_pairs(truth: DataFrame, found: DataFrame, key: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """Truth and found boxes that overlap, with their intersection over union.

    Boxes meet only inside a cell of a page's grid.
    """
    t = _gridded(_boxes(truth, key, "t", list(extra)), "t")
    f = _gridded(_boxes(found, key, "f", list(extra)), "f")
    met = t.join(f, [key, "_cell"]).where(_inter() > 0)
    home = F.struct(F.floor(F.greatest("t_x", "f_x") / GRID).alias("gx"), F.floor(F.greatest("t_y", "f_y") / GRID).alias("gy"))
    return met.where(F.col("_cell") == home).withColumn("iou", _iou()).drop("_cell")


def box_matches(truth: DataFrame, found: DataFrame, key: str, min_iou: float = 0.5,
                colour_distance: int | None = None) -> DataFrame:
    """Per key: truth boxes, and those some found box matches (optionally with a close colour).

    Equal boxes are judged once, and a box is compared with those of its cells
    only until one matches, so crowded pages take no time for all their pairs.
    """
    colours = ("red", "green", "blue") if colour_distance is not None else ()
    shape = ["x", "y", "width", "height", *colours]

    def shapes(df: DataFrame, tag: str) -> DataFrame:
        return _gridded(df.select(key, *(F.col(c).alias(f"{tag}_{c}") for c in shape)).distinct(), tag)

    f = shapes(found, "f").select(F.col(key).alias("_key"), F.col("_cell").alias("_at"), *(f"f_{c}" for c in shape))
    matches = (F.col(key) == F.col("_key")) & (F.col("_cell") == F.col("_at")) & (_inter() > 0) & (_iou() >= min_iou)
    for c in colours:
        matches = matches & (F.abs(F.col(f"t_{c}") - F.col(f"f_{c}")) <= colour_distance)
    hit = shapes(truth, "t").join(f, matches, "left_semi").select(key, *(F.col(f"t_{c}").alias(c) for c in shape)).distinct()
    return truth.join(hit.withColumn("_hit", F.lit(1)), [key, *shape], "left").groupBy(key).agg(
        F.count(F.lit(1)).alias("boxes"), F.count("_hit").alias("matched"))


def checkbox_matches(truth: DataFrame, found: DataFrame, key: str, reach: float = 4.0) -> DataFrame:
    """Per key: check boxes (box_id, x, y, size, checked), those found nearby, and those in the right state."""
    def centred(df: DataFrame, tag: str) -> DataFrame:
        cx, cy = F.col("x") + F.col("size") / 2, F.col("y") + F.col("size") / 2
        return df.select(key, F.col("box_id").alias(f"{tag}_id"), cx.alias(f"{tag}_x"), cy.alias(f"{tag}_y"),
                         F.col("checked").alias(f"{tag}_checked"))

    # Cells of twice the reach: only boxes that can be near enough meet.
    size = max(2 * reach, 1e-6)
    t = centred(truth, "t").withColumn("_cell", F.struct(
        F.floor(F.col("t_x") / size).alias("gx"), F.floor(F.col("t_y") / size).alias("gy")))
    f = centred(found, "f").withColumn("_cell", F.explode(_cells(
        F.col("f_x") - reach, F.col("f_y") - reach, F.col("f_x") + reach, F.col("f_y") + reach, size)))
    near = t.join(f, [key, "_cell"]).where(F.hypot(F.col("t_x") - F.col("f_x"), F.col("t_y") - F.col("f_y")) <= reach)
    state = near.groupBy(key, F.col("t_id").alias("box_id")).agg(
        F.bool_or(F.col("t_checked") == F.col("f_checked")).alias("_right"))
    return truth.join(state, [key, "box_id"], "left").groupBy(key).agg(
        F.count(F.lit(1)).alias("boxes"), F.count("_right").alias("found"),
        F.count_if(F.coalesce("_right", F.lit(False))).alias("right_state"))


def line_coverage(lines: DataFrame, by: DataFrame, key: str, slack: float = 3.0) -> DataFrame:
    """The share of each line (line_id, x1, y1, x2, y2) that lines of ``by`` lie along.

    Lines count as along each other when they have the same direction and lie
    within ``slack`` across.
    """
    def laid(df: DataFrame, tag: str) -> DataFrame:
        flat = F.abs(F.col("y2") - F.col("y1")) <= F.abs(F.col("x2") - F.col("x1"))
        at = F.when(flat, (F.col("y1") + F.col("y2")) / 2).otherwise((F.col("x1") + F.col("x2")) / 2)
        low = F.when(flat, F.least("x1", "x2")).otherwise(F.least("y1", "y2"))
        high = F.when(flat, F.greatest("x1", "x2")).otherwise(F.greatest("y1", "y2"))
        return df.select(key, F.col("line_id").alias(f"{tag}_id"), flat.alias("flat"), at.alias(f"{tag}_at"),
                         low.alias(f"{tag}_low"), high.alias(f"{tag}_high"))

    # Lanes of twice the slack: only lines that can be near enough across meet.
    lane = lambda c: F.floor(c / max(2 * slack, 1e-6))
    a = laid(lines, "a").withColumn("_lane", lane(F.col("a_at")))
    b = laid(by, "b").withColumn("_lane", F.explode(F.sequence(lane(F.col("b_at") - slack), lane(F.col("b_at") + slack))))
    met = a.join(b, [key, "flat", "_lane"]).where(F.abs(F.col("a_at") - F.col("b_at")) <= slack)
    shared = F.greatest(F.lit(0.0), F.least("a_high", "b_high") - F.greatest("a_low", "b_low"))
    part = shared / F.greatest(F.lit(1.0), F.col("a_high") - F.col("a_low"))
    summed = met.groupBy(key, F.col("a_id").alias("line_id")).agg(F.least(F.lit(1.0), F.sum(part)).alias("covered"))
    return lines.select(key, "line_id").join(summed, [key, "line_id"], "left").withColumn(
        "covered", F.coalesce("covered", F.lit(0.0)))
