"""Repeated lines by range-partitioned hashes, with keep bitmaps instead of texts.

Every line long enough becomes a row of its document, its position and a 128-bit
hash of its key. The rows are range-partitioned by hash and sorted by document
and position, so the first occurrence of a key comes by first in the stream and
all that follow from other documents are dropped. What goes back to the
documents is a bitmap of 64-line words, and only the words in which a line is
dropped. A few keys may hold a large share of all lines: they are found in a
sample, their first document comes from partial minima, and their lines are
decided where they are read. The sample bears on the cost alone.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veilframe.operators.lookup import lookup
from veilframe.session import materialize

WHITE = "\x20\x09\x0a\x0b\x0c\x0d"
LEAST = 10
# Lines looked at for hot keys, and the share of them from which a key is hot: 1/2000, so about 2000 keys at most.
SAMPLE, HOT_SHARE, HOT_ROWS = 1_000_000, 2000, 16


def line_keys(text: Column) -> Column:
    """The keys of a text's lines: ends stripped of ASCII white space, A-Z lower-cased."""
    whole = F.coalesce(text, F.lit(""))
    ascii_only = F.octet_length(whole) == F.length(whole)
    lowered = F.when(ascii_only, F.lower(whole)).otherwise(F.translate(whole, ascii_uppercase, ascii_lowercase))
    return F.transform(F.split(lowered, "\n", -1), lambda line: F.btrim(line, F.lit(WHITE)))


def _row_key() -> Column:
    """Tells rows apart that share an id; equal rows have equal bitmaps."""
    return F.xxhash64(F.col("doc_id").isNull(), "doc_id", "text")


def occurrences(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """``doc_id, row, pos, h1, h2``: every line with a key of at least ``least`` code points."""
    lines = docs.select("doc_id", _row_key().alias("row"), F.posexplode(line_keys(F.col("text"))).alias("pos", "key"))
    return lines.where(F.length("key") >= least).select(
        "doc_id", "row", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))


def _hot_keys(lines: DataFrame) -> DataFrame:
    """``h1, h2, first`` of the keys with a large share of the lines; ``first`` holds the smallest document."""
    total = lines.count()
    sample = lines.sample(min(1.0, SAMPLE / max(total, 1)), seed=12)
    floor = max(min(total, SAMPLE) / HOT_SHARE, HOT_ROWS)
    hot = sample.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= floor).select("h1", "h2")
    least = F.min(F.struct(F.col("doc_id").isNull(), "doc_id")).alias("first")
    return materialize(lines.join(F.broadcast(hot), ["h1", "h2"]).groupBy("h1", "h2").agg(least), "hot-lines")


def keep_bitmaps(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """``doc_id, row, words``: the keep bitmaps of the documents that lose lines.

    ``words`` lists ``(word, bits)`` in order; bit ``i`` of word ``w`` says
    whether line ``64 * w + i`` stays. Words that are not listed keep all lines.
    """
    lines = materialize(occurrences(docs, least), "lines")
    marked = lines.join(F.broadcast(_hot_keys(lines)), ["h1", "h2"], "left")
    by_first = F.col("first").isNotNull() & ~F.col("doc_id").eqNullSafe(F.col("first")["doc_id"])
    hot = marked.where(by_first).select("doc_id", "row", "pos")
    stream = Window.partitionBy("h1", "h2").orderBy(F.asc_nulls_last("doc_id"), "pos").rowsBetween(Window.unboundedPreceding, 0)
    cold = marked.where("first is null").select("h1", "h2", "doc_id", "row", "pos").repartitionByRange("h1", "h2").withColumn(
        "first_id", F.first("doc_id").over(stream)).where(~F.col("doc_id").eqNullSafe(F.col("first_id"))).select("doc_id", "row", "pos")
    bit = F.expr("shiftleft(1L, cast(pos & 63 as int))")
    words = hot.unionByName(cold).groupBy("doc_id", "row", F.shiftright("pos", 6).alias("word")).agg(
        F.bitwise_not(F.bit_or(bit)).alias("bits"))
    return words.groupBy("doc_id", "row").agg(F.array_sort(F.collect_list(F.struct("word", "bits"))).alias("words"))


def _dense(words: Column) -> Column:
    """A bitmap with the words in between filled in, up to the last listed one."""
    before = lambda k: F.when(k == 0, -1).otherwise(F.get(words, k - 1)["word"])
    return F.flatten(F.transform(words, lambda w, k: F.concat(
        F.array_repeat(F.lit(-1).cast("long"), w["word"] - before(k) - 1), F.array(w["bits"]))))


def keep_lines(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """``doc_id, n_lines, n_dropped, text`` of every row: its text without the lines that its bitmap drops."""
    known = lambda rows, *more: rows.select(F.coalesce("doc_id", F.lit(0)).alias("_id"), *more)
    left = known(docs, _row_key().alias("row"), "doc_id", "text")
    met = lookup(left, known(bitmaps, "row", "words"), ["_id", "row"])
    none = F.array().cast("array<struct<word:int,bits:bigint>>")
    words = F.coalesce("words", none)
    dropped = F.aggregate(words, F.lit(0), lambda n, w: n + F.bit_count(F.bitwise_not(w["bits"])))
    split = met.select("doc_id", "words", F.split(F.coalesce("text", F.lit("")), "\n", -1).alias("lines"),
                       dropped.cast("long").alias("n_dropped"), _dense(words).alias("dense"))
    one = F.lit(1).cast("long")
    bits_of = lambda i: F.coalesce(F.get("dense", F.shiftright(i, 6)), F.lit(-1).cast("long"))
    stays = lambda line, i: F.call_function("shiftright", bits_of(i), i.bitwiseAND(63)).bitwiseAND(one) == 1
    kept = F.when(F.col("n_dropped") > 0, F.filter("lines", stays)).otherwise(F.col("lines"))
    return split.select("doc_id", F.size("lines").cast("long").alias("n_lines"), "n_dropped", F.array_join(kept, "\n").alias("text"))


def drop_repeated_lines(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """``doc_id, n_lines, n_dropped, text`` of every row of ``docs(doc_id, text)``.

    Lines end at line feeds; a null or empty text is one empty line. A key that
    at least two documents hold keeps its lines in the one with the smallest
    doc_id, where repeats stay too. Rows that share an id are one document, and
    so are all rows without an id, which come behind all others. Repeated rows
    are all returned. Keys below ``least`` code points are never dropped.
    Further columns are ignored. An empty table gives an empty one.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return keep_lines(own, materialize(keep_bitmaps(own, least), "bitmaps"))
