"""Mapping tables as CSV (RFC 4180, byte-order mark, CRLF) and their checks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veilframe.functions.fixed_values import KEPT_HEADERS, MANIFEST_HEADERS, MAPPING_HEADERS, MAX_FILE_BYTES
from veilframe.operators.lookup import lookup
from veilframe.session import materialize

BOM = chr(0xFEFF)


def quoted(field: Column) -> Column:
    return F.when(field.rlike('[",\r\n]'), F.concat(
        F.lit('"'), F.replace(field, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(field)


def csv_line(*fields: Column) -> Column:
    return F.concat_ws(",", *[quoted(F.coalesce(f, F.lit(""))) for f in fields])


def keeps_some(mapping: DataFrame) -> bool:
    """Whether some row keeps characters, i.e. whether the kept columns are written."""
    kept = (F.coalesce(F.col("kept_prefix"), F.lit("")) != "") | (F.coalesce(F.col("kept_suffix"), F.lit("")) != "")
    return not mapping.where(kept).isEmpty()


def mapping_csv_text(mapping: DataFrame, scope: str = "scope", order: str = "line_no") -> DataFrame:
    """The whole CSV of every scope as one text: (scope, csv). A scope is one document's table."""
    kept = (F.coalesce(F.col("kept_prefix"), F.lit("")) != "") | (F.coalesce(F.col("kept_suffix"), F.lit("")) != "")
    short = csv_line(*[F.col(c) for c in MAPPING_HEADERS])
    full = csv_line(*[F.col(c) for c in MAPPING_HEADERS + KEPT_HEADERS])
    grouped = mapping.groupBy(scope).agg(
        F.bool_or(kept).alias("_kept"),
        F.array_sort(F.collect_list(F.struct(F.col(order), short.alias("short"), full.alias("full")))).alias("_rows"))
    header = F.when(F.col("_kept"), ",".join(MAPPING_HEADERS + KEPT_HEADERS)).otherwise(",".join(MAPPING_HEADERS))
    lines = F.transform("_rows", lambda r: F.when(F.col("_kept"), r["full"]).otherwise(r["short"]))
    return grouped.select(scope, F.concat(
        F.lit(BOM), F.array_join(F.concat(F.array(header), lines), "\r\n"), F.lit("\r\n")).alias("csv"))


def write_mapping(mapping: DataFrame, path: str) -> None:
    """Write a mapping table as CSV part files, each with a byte-order mark and a header."""
    names = MAPPING_HEADERS + (KEPT_HEADERS if keeps_some(mapping) else [])
    header = BOM + ",".join(names)

    def with_header(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([header])], names=["line"])
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["line"]], names=["line"])

    lines = mapping.select(csv_line(*[F.col(c) for c in names]).alias("line"))
    lines.mapInArrow(with_header, "line string").write.option("lineSep", "\r\n").text(path)


# A field behind a comma, and a piece of a field: quotes open and close anywhere, doubled ones inside stand for one.
FIELD = r',((?:[^,"]++|"(?:[^"]++|"")*+"?)*+)'
PIECE = r'([^"]++|"(?:[^"]++|"")*+"?)'
LINE_END = r"(?:\r\n|\r|\n)\z"


def _fields(record: Column) -> Column:
    """The fields of one record without its line end."""
    plain = lambda f: F.array_join(F.transform(
        F.regexp_extract_all(f, F.lit(PIECE), F.lit(1)),
        lambda p: F.when(p.startswith('"'), F.replace(F.regexp_extract(p, r'^"((?:[^"]++|"")*+)', 1), F.lit('""'), F.lit('"'))).otherwise(p)), "")
    found = F.regexp_extract_all(F.concat(F.lit(","), record), F.lit(FIELD), F.lit(1))
    return F.transform(found, lambda f: F.when(F.contains(f, F.lit('"')), plain(f)).otherwise(f))


def _scanned(spark: SparkSession, path: str) -> DataFrame:
    """The lines of files, read in splits: ``file, block, line, odd, even_start, odd_start, quotes, text``.

    ``line`` counts from 0 in the split; ``odd`` tells whether an odd number of
    quotes is in front of the line in the split; the starts are the last lines
    up to this one with an even and an odd number in front (-1: none).
    """
    pieces = F.regexp_extract_all(F.concat(F.make_valid_utf8("value"), F.lit("\n")), F.lit(r"([^\r\n]*+(?:\r\n|\r|\n))"), F.lit(1))
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.explode(pieces).alias("text"))
    lines = lines.withColumn("quotes", (F.length("text") - F.length(F.replace("text", F.lit('"')))).cast("long"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, lines, quotes, last = None, 0, 0, [-1, -1]
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            file, block, own = batch["file"], batch["block"], batch["quotes"].to_numpy()
            row = np.arange(n)
            new = np.empty(n, bool)
            new[0] = place != (file[0].as_py(), block[0].as_py())
            new[1:] = pc.or_(pc.not_equal(file[1:], file[:-1]), pc.not_equal(block[1:], block[:-1])).to_numpy(zero_copy_only=False)
            first = np.maximum.accumulate(np.where(new, row, -1))
            line = np.where(first >= 0, row - first, row + lines)
            front = np.cumsum(own) - own
            odd = np.where(first >= 0, front - front[first], front + quotes) & 1
            starts = []
            for side in (0, 1):
                at = np.maximum.accumulate(np.where(odd == side, row, -1))
                here = (at >= 0) & (at >= first)
                starts.append(np.where(here, line[at], np.where(first < 0, last[side], -1)))
            place = (file[n - 1].as_py(), block[n - 1].as_py())
            lines, quotes, last = int(line[-1]) + 1, int(odd[-1] + own[-1]), [int(x[-1]) for x in starts]
            yield pa.RecordBatch.from_arrays(
                [file, block, pa.array(line), pa.array(odd), pa.array(starts[0]), pa.array(starts[1]), batch["quotes"], batch["text"]],
                names=["file", "block", "line", "odd", "even_start", "odd_start", "quotes", "text"])

    return lines.select("file", "block", "quotes", "text").mapInArrow(
        counted, "file string, block long, line long, odd long, even_start long, odd_start long, quotes long, text string")


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """``file, line_no, text`` of every record of CSV files (RFC 4180), blank ones too, without the line end.

    A file is read by as many tasks as it has splits, once. A line begins inside
    a field if an odd number of quotes is in front of it in the file; each split
    counts its lines and quotes, and a running sum over the splits gives the
    number of lines and the parity in front of each. Only records of several
    lines are shuffled. ``line_no`` is the line on which the record begins; lines
    end in CR, LF or both. A quote that is never closed reaches to the end of
    the file; a record of more than the size that a document may have is an
    error.
    """
    lines = materialize(_scanned(spark, path), "csv-lines")
    sums = lines.groupBy("file", "block").agg(
        F.count(F.lit(1)).alias("n"), F.sum("quotes").alias("q"), F.max("even_start").alias("_even"), F.max("odd_start").alias("_odd"))
    front = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    placed = sums.withColumn("before", F.coalesce(F.sum("n").over(front), F.lit(0))).withColumn(
        "inside", F.coalesce(F.sum("q").over(front), F.lit(0)) % 2)
    last = F.when(F.col("inside") == 0, F.col("_even")).otherwise(F.col("_odd"))
    blocks = materialize(placed.withColumn("carried", F.last(F.when(last >= 0, F.col("before") + last), ignorenulls=True).over(front)).select(
        "file", "block", "before", "inside", "carried"), "csv-splits")
    start = F.when(F.col("inside") == 0, F.col("even_start")).otherwise(F.col("odd_start"))
    rows = lookup(lines, blocks, ["file", "block"]).select(
        "file", "text", (F.col("before") + F.col("line") + 1).alias("line"),
        (F.when(start >= 0, F.col("before") + start).otherwise(F.col("carried")) + 1).alias("line_no"),
        ((F.col("odd") == F.col("inside")) & (F.col("quotes") % 2 == 0)).alias("whole"))
    parts = rows.where("not whole")
    long = parts.groupBy("file", "line_no").agg(F.sum(F.octet_length("text")).alias("size")).where(F.col("size") > MAX_FILE_BYTES).take(1)
    if long:
        raise ValueError(f"the record at line {long[0]['line_no']} has {long[0]['size']} bytes; a quote may be open ({long[0]['file']})")
    joined = parts.groupBy("file", "line_no").agg(F.array_sort(F.collect_list(F.struct("line", "text"))).alias("_lines")).select(
        "file", "line_no", F.array_join(F.col("_lines")["text"], "").alias("text"))
    found = rows.where("whole").select("file", "line_no", "text").unionByName(joined)
    bare = F.regexp_replace("text", LINE_END, "")
    return found.select("file", "line_no", F.when(F.col("line_no") == 1, F.regexp_replace(bare, "^" + BOM, "")).otherwise(bare).alias("text"))


def read_mapping(spark: SparkSession, path: str) -> DataFrame:
    """Read mapping CSVs of any size; (file, line_no, columns as they are).

    Every file has a header of its own, in which columns are found by name, in
    any order; further columns are left out, missing kept columns are empty.
    ``line_no`` is the line of the file on which the record begins. A file
    without a code, category or original column is an error, an empty one too.
    Records are found by :func:`csv_records`, fields by built-in functions.
    """
    wanted = MAPPING_HEADERS + KEPT_HEADERS
    # Headers and rows are both taken from the records, which are found once.
    records = materialize(csv_records(spark, path), "csv-records")
    full = ~F.col("text").isin("", '"', '""')
    heads = records.groupBy("file").agg(
        F.min_by(F.when(full, F.col("text")), F.when(full, F.col("line_no"))).alias("text"), F.min(F.when(full, F.col("line_no"))).alias("_line"))
    names = F.transform(_fields(F.coalesce("text", F.lit(""))), lambda c: F.regexp_replace(c, r"^\s+|\s+$", ""))
    heads = materialize(heads.select("file", "_line", names.alias("_names")), "csv-headers")
    missing = F.array_except(F.array(*map(F.lit, MAPPING_HEADERS)), F.col("_names"))
    if bad := heads.where(F.size(missing) > 0).select("file", F.array_join(missing, ", ").alias("missing")).take(1):
        raise ValueError(f"mapping table without column(s): {bad[0]['missing']} ({bad[0]['file']})")
    listed = spark.read.text(path).inputFiles()
    if len(listed) > heads.count():
        empty = spark.createDataFrame([(f,) for f in listed], "file string").join(heads, "file", "left_anti").first()
        raise ValueError(f"mapping table without column(s): {', '.join(MAPPING_HEADERS)} ({empty['file']})")
    at = heads.select("file", "_line", *(F.array_position("_names", c).cast("int").alias(f"_{c}") for c in wanted))
    rows = lookup(records.where(full), at, ["file"]).where("line_no <> _line").withColumn("_fields", _fields(F.col("text")))
    value = lambda c: F.coalesce(F.get("_fields", F.col(f"_{c}") - 1), F.lit(""))
    return rows.select("file", "line_no", *(value(c).alias(c) for c in wanted))


def judged_mapping(rows: DataFrame, scope: str = "scope") -> DataFrame:
    """Mapping rows with trimmed codes and ``error``: ``empty_code``, ``duplicate_code`` or null.

    Of duplicates the first row has no error. The rows are read twice; only
    codes that occur more than once are looked up.
    """
    code = F.trim(F.coalesce(F.col("code"), F.lit("")))
    trimmed = rows.withColumn("code", code)
    counts = trimmed.where("code <> ''").groupBy(scope, "code").agg(F.min("line_no").alias("_first"), F.count(F.lit(1)).alias("_n"))
    firsts = materialize(counts.where("_n > 1").drop("_n"), "repeated-codes")
    return lookup(trimmed, firsts, [scope, "code"]).withColumn("error", F.when(F.col("code") == "", "empty_code").when(
        F.col("line_no") != F.col("_first"), "duplicate_code")).select(*rows.columns, "error")


def checked_mapping(rows: DataFrame, scope: str = "scope") -> tuple[DataFrame, DataFrame]:
    """Split mapping rows (scope, line_no, MAPPING…) into (valid rows, errors).

    Errors are ``empty_code`` and ``duplicate_code``; of duplicates the first
    row stays.
    """
    judged = judged_mapping(rows, scope)
    return judged.where("error is null").drop("error"), judged.where("error is not null").select(
        scope, "line_no", "code", "error")


def strict_mapping(rows: DataFrame, scope: str = "scope") -> DataFrame:
    """Valid rows, or an error naming the first few faults."""
    good, errors = checked_mapping(rows, scope)
    faults = errors.orderBy("line_no").limit(3).collect()
    if faults:
        raise ValueError("; ".join(f"line {f['line_no']}: {f['error']} {f['code']}".rstrip() for f in faults))
    return good


def manifest_csv(rows: DataFrame, order: str, with_mapping: bool = True) -> DataFrame:
    """Manifest rows as ordered CSV lines (line_no, line), header first."""
    h = MANIFEST_HEADERS
    partial = not rows.where("partial").isEmpty()
    names = [h[0], h[1], *([h[2]] if with_mapping else []), h[3], *([h[4]] if partial else [])]
    fields = [F.col("source"), F.col("output"), *([F.col("mapping")] if with_mapping else []),
              F.col("count").cast("string"), *([F.when(F.col("partial"), "是").otherwise("否")] if partial else [])]
    head = rows.sparkSession.createDataFrame([(None, ",".join(names))], "k string, line string")
    body = rows.select(F.col(order).cast("string").alias("k"), csv_line(*fields).alias("line"))
    return head.unionByName(body)
