"""Text from layout tables (paragraph runs, positioned runs, cells, recognised words),
and edits of the text back to the pieces it came from.

A document's pieces are assembled inside its group: a document is bounded by
the size guard of the sources, and documents are spread over the tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veilframe.functions import fixed_values as fv
from veilframe.functions.confusables import fix_lookalikes
from veilframe.functions.text import let, splice
from veilframe.operators.review import BLOCK_CHARS, blocked

SEGMENT = ["seg_idx", "start", "end", "text"]


def _placed(pieces: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Offsets of text pieces from the separators in front of them (``_sep``, ``text``, ``_after``)."""
    w = Window.partitionBy(key).orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    size = F.length("_sep") + F.length("text") + F.length("_after")
    return (
        pieces.withColumn("_upto", F.sum(size).over(upto))
        .withColumn("end", (F.col("_upto") - F.length("_after")).cast("int"))
        .withColumn("start", (F.col("end") - F.length("text")).cast("int"))
        .withColumn("seg_idx", F.row_number().over(w)).drop("_upto")
    )


def segments(pieces: DataFrame, key: str, order: list[str], *coords: str) -> DataFrame:
    """The segment table of placed pieces: where each piece lies in the document's text."""
    return _placed(pieces, key, order).where(F.length("text") > 0).select(key, *coords, *SEGMENT)


def assemble(pieces: DataFrame, key: str, order: list[str], into: str = "text") -> DataFrame:
    """The full text of every document from its placed pieces."""
    part = F.struct(*order, F.concat("_sep", "text", "_after").alias("_t"))
    return pieces.groupBy(key).agg(F.array_sort(F.collect_list(part)).alias("_p")).select(
        key, F.array_join(F.transform("_p", lambda p: p["_t"]), "").alias(into))


# --------------------------------------------------------------- paragraphs
RUN_ORDER = ["part_ord", "part", "para_idx", "run_idx"]


def paragraph_pieces(runs: DataFrame, key: str) -> DataFrame:
    """Runs (part, para_idx, run_idx, kind, text) as pieces, a line break behind each paragraph.

    ``kind`` is ``t`` (text), ``tab`` or ``br``; deleted runs and fallback
    content are left out. The body comes first, then headers and footers by name.
    """
    shown = runs.where(F.col("kind").isin("t", "tab", "br", "p")).withColumn(
        "part_ord", F.when(F.col("part") == "body", 0).otherwise(1))
    last = Window.partitionBy(key, "part_ord", "part", "para_idx").orderBy(F.col("run_idx").desc())
    mark = F.when(F.col("kind") == "tab", "\t").when(F.col("kind") == "br", "\n").otherwise("")
    return (
        shown.withColumn("_sep", mark)
        .withColumn("text", F.when(F.col("kind") == "t", F.col("text")).otherwise(""))
        .withColumn("_after", F.when(F.row_number().over(last) == 1, "\n").otherwise(""))
    )


# ----------------------------------------------------------- positioned runs
POSITION_ORDER = ["page", "run_idx"]


def positioned_pieces(runs: DataFrame, key: str) -> DataFrame:
    """Runs (page, run_idx, x, y, font_size, width, text, eol) as pieces.

    Runs on one baseline share a line, a visible gap becomes a space, and a
    page ends with a blank line.
    """
    page = Window.partitionBy(key, "page").orderBy("run_idx")
    seen = page.rowsBetween(Window.unboundedPreceding, -1)
    has_text = F.length("text") > 0
    marked = (
        runs.withColumn("_last", F.last(F.when(has_text, F.struct("x", "y", "width", "run_idx", "text")),
                                        ignorenulls=True).over(seen))
        .withColumn("_eol", F.last(F.when(F.col("eol"), F.col("run_idx")), ignorenulls=True).over(seen))
        .withColumn("_page_end", F.lead("run_idx").over(page).isNull())
        .withColumn("_first_page", F.col("page") == F.min("page").over(Window.partitionBy(key)))
    )
    last = F.col("_last")
    hard = F.coalesce(last["text"].endswith("\n"), F.lit(False))
    broken = F.coalesce(F.col("_eol") >= last["run_idx"], F.lit(False))
    fresh = last.isNull() | (broken & ~hard)
    same_line = F.abs(F.col("y") - last["y"]) < F.col("font_size") * 0.5
    gap = F.col("x") - (last["x"] + last["width"]) > F.col("font_size") * 0.25
    sep = (
        F.when(~has_text | fresh, "")
        .when(~same_line, F.when(hard, "").otherwise("\n"))
        .when(gap & ~last["text"].endswith(" "), " ").otherwise("")
    )
    # Whether the text so far ends a line, in front of this run's own line end.
    ended = F.when(has_text, F.col("text").endswith("\n")).when(last.isNotNull(), hard | broken).otherwise(
        ~F.col("_first_page") | F.col("_eol").isNotNull())
    eol = F.when(F.col("eol") & ~ended, "\n").otherwise("")
    close = F.when(F.col("_page_end"), F.when(F.col("eol") | ended, "\n").otherwise("\n\n")).otherwise("")
    return marked.withColumn("_sep", sep).withColumn("_after", F.concat(eol, close)).drop(
        "_last", "_eol", "_page_end", "_first_page")


# --------------------------------------------------------------------- cells
CELL_ORDER = ["sheet_idx", "row", "col"]


def cell_pieces(cells: DataFrame, key: str) -> DataFrame:
    """Cells (sheet_idx, row, col, text) as pieces: tab inside a row, line break between rows.

    Empty cells are skipped; a sheet ends with a blank line.
    """
    sheet = Window.partitionBy(key, "sheet_idx").orderBy("row", "col")
    filled = cells.where(F.length("text") > 0)
    previous = F.lag("row").over(sheet)
    before = F.lag("text").over(sheet)
    sep = F.when(previous.isNull() | before.endswith("\n"), "").when(previous == F.col("row"), "\t").otherwise("\n")
    is_last = F.lead("row").over(sheet).isNull()
    after = F.when(is_last, F.when(F.col("text").endswith("\n"), "\n").otherwise("\n\n")).otherwise("")
    return filled.withColumn("_sep", sep).withColumn("_after", after)


# ------------------------------------------------------------ edits to pieces
def distribute(segs: DataFrame, edits: DataFrame, key: str) -> DataFrame:
    """Edits (key, start, end, replacement) split over the segments they touch.

    The first segment of an edit takes the replacement, the covered text of the
    others goes. Gives (key, seg_idx, start, end, replacement) with offsets
    inside the segment.
    """
    s = blocked(segs.select(key, "seg_idx", F.col("start").alias("s0"), F.col("end").alias("s1")), "s0", "s1")
    e = blocked(edits.select(key, F.col("start").alias("e0"), F.col("end").alias("e1"), "replacement"), "e0", "e1")
    touch = (F.col("s0") < F.col("e1")) & (F.col("s1") > F.col("e0"))
    # Both sides may share several blocks; the pair counts in the block where the overlap begins.
    home = F.floor(F.greatest("s0", "e0") / BLOCK_CHARS)
    pairs = e.join(s, [key, "_block"]).where(touch & (F.col("_block") == home))
    first = F.min("seg_idx").over(Window.partitionBy(key, "e0", "e1"))
    return pairs.select(
        key, "seg_idx",
        (F.greatest("e0", "s0") - F.col("s0")).alias("start"),
        (F.least("e1", "s1") - F.col("s0")).alias("end"),
        F.when(F.col("seg_idx") == first, F.col("replacement")).otherwise("").alias("replacement"))


def stray_edits(segs: DataFrame, edits: DataFrame, key: str) -> DataFrame:
    """Edits that touch no segment (an error for the caller to raise)."""
    s = blocked(segs.select(key, F.col("start").alias("s0"), F.col("end").alias("s1")), "s0", "s1")
    e = blocked(edits.select(key, "start", "end"))
    hit = e.join(s, [key, "_block"]).where((F.col("s0") < F.col("end")) & (F.col("s1") > F.col("start")))
    return edits.join(hit.select(key, "start", "end").distinct(), [key, "start", "end"], "left_anti")


def edited_segments(segs: DataFrame, edits: DataFrame, key: str) -> DataFrame:
    """The new text of every segment; ``changed`` tells whether an edit touched it."""
    local = distribute(segs, edits, key).groupBy(key, "seg_idx").agg(
        F.array_sort(F.collect_list(F.struct("start", "end", "replacement"))).alias("_ops"))
    joined = segs.join(local, [key, "seg_idx"], "left")
    new = F.when(F.col("_ops").isNull(), F.col("text")).otherwise(splice(F.col("text"), F.col("_ops")))
    return joined.withColumn("new_text", new).withColumn("changed", F.col("_ops").isNotNull()).drop("_ops")


# ---------------------------------------------------- workbook dictionaries
def cell_texts(cells: DataFrame, dictionary: DataFrame, key: str) -> DataFrame:
    """Cells with their text: inline, or looked up in the workbook's dictionary (missing = empty)."""
    words = dictionary.select(key, F.col("idx").alias("shared_idx"), F.col("text").alias("_shared"))
    text = F.when(F.col("shared_idx").isNotNull(), F.coalesce("_shared", F.lit(""))).otherwise(
        F.coalesce("inline_text", F.lit("")))
    return cells.join(words, [key, "shared_idx"], "left").withColumn("text", text).drop("_shared")


def scrub_dictionary(dictionary: DataFrame, cells: DataFrame, key: str) -> DataFrame:
    """Blank the entries no cell refers to any more (``cells`` after editing, changed ones inline)."""
    used = cells.where("shared_idx is not null").select(key, F.col("shared_idx").alias("idx")).distinct().withColumn(
        "_used", F.lit(True))
    return dictionary.join(used, [key, "idx"], "left").withColumn(
        "text", F.when(F.col("_used"), F.col("text")).otherwise("")).drop("_used")


def column_number(letters: Column) -> Column:
    """``A`` -> 1, ``AA`` -> 27."""
    return F.aggregate(F.split(F.upper(letters), ""), F.lit(0), lambda n, c: n * 26 + F.ascii(c) - 64)


def cell_position(ref: Column) -> Column:
    """``struct<row,col>`` of an A1 reference; (0, 0) when it is none."""
    ok = ref.rlike(r"^[A-Za-z]+\d+\z")
    return F.when(ok, F.struct(
        F.regexp_extract(ref, r"(\d+)\z", 1).cast("int").alias("row"),
        column_number(F.regexp_extract(ref, r"^([A-Za-z]+)", 1)).alias("col"),
    )).otherwise(F.struct(F.lit(0).alias("row"), F.lit(0).alias("col")))


def column_letters(number: Column) -> Column:
    """1 -> ``A``, 27 -> ``AA``; the inverse of :func:`column_number`."""
    def step(acc: Column, _: Column) -> Column:
        n = acc["n"]
        more = n > 0
        letter = F.char(F.lit(65) + (n - 1) % 26)
        return F.struct(
            F.when(more, F.floor((n - 1) / 26)).otherwise(n).cast("long").alias("n"),
            F.when(more, F.concat(letter, acc["s"])).otherwise(acc["s"]).alias("s"))

    zero = F.struct(number.cast("long").alias("n"), F.lit("").alias("s"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(7)), zero, step, lambda acc: acc["s"])


# ----------------------------------------------------------- recognised words
def clean_words(words: DataFrame) -> DataFrame:
    """Drop noise words and the noise at the edges of words."""
    text = F.regexp_replace("text", F.lit(rf"^{fv.WS}+|{fv.WS}+\z"), F.lit(""))
    noise = F.col("text").rlike(fv.SYMBOLS_ONLY) & (
        F.col("text").rlike(fv.RULE_CHARS) | (F.col("confidence") < fv.MIN_SYMBOL_CONFIDENCE))
    edges = F.regexp_replace("text", F.lit(fv.EDGE_NOISE), F.lit(""))
    return words.withColumn("text", text).where(~noise).withColumn("text", edges).where(F.length("text") > 0)


def word_runs(words: DataFrame, key: str) -> DataFrame:
    """Recognised words (page, line_no, word_no, text, x0, x1, confidence, row_height) as text runs.

    Words far apart start a new run; Han characters join without spaces, Latin
    words with one, and a number that was cut in two is one again.
    """
    line = Window.partitionBy(key, "page", "line_no").orderBy("word_no")
    kept = clean_words(words)
    gap = F.col("x0") - F.lag("x1").over(line)
    before = F.lag("text").over(line)
    h = F.col("row_height")
    latin = ~F.right(before, F.lit(1)).rlike(fv.WIDE_CHARS) & ~F.left("text", F.lit(1)).rlike(fv.WIDE_CHARS)
    number = before.rlike(r"[\d-]\z") & F.col("text").rlike(r"^[\d-]") & (F.col("_gap") < h * fv.NUMBER_GAP)
    marked = (
        kept.withColumn("_gap", gap)
        .withColumn("_new", F.coalesce(F.col("_gap") > h * fv.SPLIT_GAP, F.lit(True)))
        .withColumn("_space", F.coalesce((latin & ~number) | (F.col("_gap") > h * fv.SPACE_GAP), F.lit(False)))
        .withColumn("run_no", F.sum(F.col("_new").cast("int")).over(line.rowsBetween(Window.unboundedPreceding, 0)))
    )
    piece = F.concat(F.when(F.col("_space") & ~F.col("_new"), " ").otherwise(""), F.col("text"))
    return marked.groupBy(key, "page", "line_no", "run_no").agg(
        F.array_sort(F.collect_list(F.struct("word_no", piece.alias("t")))).alias("_w"),
        F.min("x0").alias("x"), (F.max("x1") - F.min("x0")).alias("width"),
    ).select(key, "page", "line_no", "run_no", "x", "width", fix_lookalikes(
        F.array_join(F.transform("_w", lambda w: w["t"]), "")).alias("text"))
