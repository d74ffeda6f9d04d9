"""Queries over layout tables: assembling text, writing edits back, dictionaries, tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.operators import layout
from veilframe.operators.rules import custom_rule
from veilframe.operators.tables import cells_of, redact_table
from veilframe.plans.derived import table
from veilframe.session import by_key

QUERIES: dict = {}


def query(name: str, sql: str | None):
    def add(fn):
        QUERIES[name] = (fn, sql)
        return fn

    return add


# ------------------------------------------------- lineitem rows as text runs
def line_key(df: DataFrame) -> DataFrame:
    """Rows of lineitem in a fixed order per order (an order may repeat a line number)."""
    from pyspark.sql.window import Window

    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    return by_key(df, "l_orderkey").withColumn("n", F.row_number().over(order))


_ranked = ("select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) as n from lineitem")
_runs = f"""
    select l_orderkey as id, n, 'item' || l_partkey as text, (n - 1) // 4 as line, l_partkey % 3 = 0 as glued from ({_ranked}) as r"""


def positioned_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as positioned runs: four to a line, some close to the one in front."""
    rows = line_key(table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"))
    n, close = F.col("n"), F.col("l_partkey") % 3 == 0
    x = ((n - 1) % 4) * 100.0
    return rows.select(
        F.col("l_orderkey").alias("id"), F.lit(1).alias("page"), n.alias("run_idx"),
        F.when(close, x - 19.0).otherwise(x).alias("x"), (800.0 - F.floor((n - 1) / 4) * 20).alias("y"), F.lit(10.0).alias("font_size"),
        F.lit(80.0).alias("width"), F.concat(F.lit("item"), "l_partkey").alias("text"), F.lit(False).alias("eol"))


# A run is glued when it starts within 2.5 of the end of the run in front, which
# itself may have been moved.
_sep = ("case when n = 1 then '' when line <> lag(line) over (partition by id order by n) then chr(10) "
        "when (case when glued then -19.0 else 0.0 end) + 100 - (case when lag(glued) over (partition by id order by n) then -19.0 else 0.0 end) - 80 > 2.5 then ' ' else '' end")


@query("assemble_lines", f"""
    select id, string_agg(sep || text, '' order by n) || chr(10) || chr(10) as text from (select id, n, text, {_sep} as sep from ({_runs}) as r) as q group by id""")
def assemble_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positioned runs to text: lines by baseline, spaces by gap."""
    pieces = layout.positioned_pieces(positioned_runs(spark, sf_dir), "id")
    return layout.assemble(pieces, "id", layout.POSITION_ORDER)


@query("line_segments", f"""
    select id, n as seg_idx, cast(sum(length(sep) + length(text)) over (partition by id order by n) - length(text) as bigint) as start_pos, text
    from (select id, n, text, {_sep} as sep from ({_runs}) as r) as q""")
def line_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where every run lies in the assembled text."""
    pieces = layout.positioned_pieces(positioned_runs(spark, sf_dir), "id")
    segs = layout.segments(pieces, "id", layout.POSITION_ORDER)
    return segs.select("id", F.col("seg_idx").cast("long").alias("seg_idx"), F.col("start").cast("long").alias("start_pos"), "text")


@query("assemble_paragraphs", f"""
    select id, string_agg(t, '' order by n) as text from (
        select l_orderkey as id, n, case when l_partkey % 5 = 0 then '' when l_partkey % 5 = 1 then chr(9) when l_partkey % 5 = 2 then chr(10) else 'w' || l_partkey end
               || case when n % 3 = 0 or n = max(n) over (partition by l_orderkey) then chr(10) else '' end as t
        from ({_ranked}) as r) as q group by id""")
def assemble_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraph runs to text: tabs, breaks, deleted runs left out."""
    rows = line_key(table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"))
    p = F.col("l_partkey") % 5
    runs = rows.select(
        F.col("l_orderkey").alias("id"), F.lit("body").alias("part"), F.floor((F.col("n") - 1) / 3).alias("para_idx"),
        F.col("n").alias("run_idx"), F.when(p == 0, "del").when(p == 1, "tab").when(p == 2, "br").otherwise("t").alias("kind"),
        F.concat(F.lit("w"), "l_partkey").alias("text"))
    # The paragraph mark is a run of its own, so that a paragraph of deleted runs still breaks the line.
    marks = runs.groupBy("id", "part", "para_idx").agg(F.max("run_idx").alias("run_idx")).select(
        "id", "part", "para_idx", (F.col("run_idx") + 0.5).alias("run_idx"), F.lit("p").alias("kind"), F.lit("").alias("text"))
    pieces = layout.paragraph_pieces(runs.withColumn("run_idx", F.col("run_idx").cast("double")).unionByName(marks), "id")
    return layout.assemble(pieces, "id", layout.RUN_ORDER)


_cells = f"""
    select l_orderkey as id, cast((n - 1) // 2 as int) as row, cast((n - 1) % 2 as int) as col, n,
           case when l_partkey % 6 = 0 then '' else 'c' || l_partkey || '@shop.example' end as text from ({_ranked}) as r"""


def order_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_key(table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"))
    n = F.col("n")
    return rows.select(
        F.col("l_orderkey").alias("id"), F.lit(0).alias("sheet_idx"), F.floor((n - 1) / 2).cast("int").alias("row"),
        ((n - 1) % 2).alias("col"), "l_partkey",
        F.when(F.col("l_partkey") % 6 == 0, "").otherwise(F.concat(F.lit("c"), "l_partkey", F.lit("@shop.example"))).alias("text"))


_cell_sep = "case when lag(row) over (partition by id order by n) is null then '' when lag(row) over (partition by id order by n) = row then chr(9) else chr(10) end"
_filled = f"select *, {_cell_sep} as sep from ({_cells}) as c where text <> ''"


@query("assemble_cells", f"select id, string_agg(sep || text, '' order by n) || chr(10) || chr(10) as text from ({_filled}) as q group by id")
def assemble_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells to text: tabs inside a row, lines between rows, empty cells left out."""
    return layout.assemble(layout.cell_pieces(order_cells(spark, sf_dir), "id"), "id", layout.CELL_ORDER)


# An edit over the end of each cell and the start of the next one.
_segs = f"""
    select id, row_number() over (partition by id order by n) as seg, cast(sum(length(sep) + length(text)) over (partition by id order by n) - length(text) as bigint) as s,
           cast(sum(length(sep) + length(text)) over (partition by id order by n) as bigint) as e, text from ({_filled}) as f"""


@query("distribute_edits", f"""
    select id, seg as seg_idx, case when seg % 2 = 1 and next_s is not null then substr(text, 1, length(text) - 3) || '[x]'
                    when seg % 2 = 0 then substr(text, 3) else text end as new_text,
           seg % 2 = 0 or next_s is not null as changed
    from (select *, lead(s) over (partition by id order by seg) as next_s from ({_segs}) as g) as q""")
def distribute_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits that span two cells: the first takes the replacement, the second loses the text."""
    from pyspark.sql.window import Window

    segs = layout.segments(layout.cell_pieces(order_cells(spark, sf_dir), "id"), "id", layout.CELL_ORDER)
    following = F.lead("start").over(Window.partitionBy("id").orderBy("seg_idx"))
    edits = segs.withColumn("next", following).where("seg_idx % 2 = 1 and next is not null").select(
        "id", (F.col("end") - 3).alias("start"), (F.col("next") + 2).alias("end"), F.lit("[x]").alias("replacement"))
    done = layout.edited_segments(segs, edits, "id")
    return done.select("id", F.col("seg_idx").cast("long").alias("seg_idx"), "new_text", "changed")


@query("stray_edits", f"select id, max(e) as start_pos from ({_segs}) as g group by id")
def stray_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits behind the last cell, which belong to none."""
    segs = layout.segments(layout.cell_pieces(order_cells(spark, sf_dir), "id"), "id", layout.CELL_ORDER)
    edits = segs.groupBy("id").agg(F.max("end").alias("start")).select(
        "id", "start", (F.col("start") + 1).alias("end"), F.lit("x").alias("replacement"))
    return layout.stray_edits(segs, edits, "id").select("id", F.col("start").cast("long").alias("start_pos"))


# --------------------------------------------------------- workbook dictionaries
def _workbook(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Lines as workbook cells per supplier whose texts are part names in a dictionary."""
    cells = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("id"), "l_orderkey", "l_linenumber", F.col("l_partkey").alias("shared_idx"),
        F.lit(None).cast("string").alias("inline_text"))
    parts = table(spark, sf_dir, "part").where("p_size < 40").select(F.col("p_partkey").alias("idx"), F.col("p_name").alias("text"))
    used = cells.select("id", F.col("shared_idx").alias("idx")).distinct()
    return cells, used.join(parts, "idx").select("id", "idx", "text")


@query("dictionary_lookup", """
    select l_suppkey as id, l_orderkey, l_linenumber, l_partkey as idx, coalesce(case when p_size < 40 then p_name end, '') as text
    from lineitem left join part on p_partkey = l_partkey""")
def dictionary_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells with the text of their dictionary entry; a missing entry is empty."""
    cells, words = _workbook(spark, sf_dir)
    return layout.cell_texts(cells, words, "id").select("id", "l_orderkey", "l_linenumber", F.col("shared_idx").alias("idx"), "text")


@query("dictionary_scrub", """
    select distinct l_suppkey as id, l_partkey as idx, case when bool_and(l_quantity > 10) over (partition by l_suppkey, l_partkey) then '' else p_name end as text
    from lineitem join part on p_partkey = l_partkey where p_size < 40""")
def dictionary_scrub(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dictionary entries that no cell refers to after the larger cells were rewritten inline."""
    _, words = _workbook(spark, sf_dir)
    left = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("id"), F.when(F.col("l_quantity") <= 10, F.col("l_partkey")).alias("shared_idx"))
    return layout.scrub_dictionary(words, left, "id").select("id", "idx", "text")


_letters = "case when c > 26 then chr(cast(64 + (c - 1) // 26 as int)) else '' end || chr(cast(65 + (c - 1) % 26 as int))"


@query("cell_references", f"select p_partkey as id, {_letters} || p_size as ref, p_size as row, c as col from (select *, cast(p_partkey % 700 + 1 as int) as c from part) as p")
def cell_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cell references to row and column and back."""
    parts = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.concat(layout.column_letters(F.col("p_partkey") % 700 + 1), F.col("p_size").cast("string")).alias("ref"))
    return parts.withColumn("at", layout.cell_position(F.col("ref"))).select("id", "ref", "at.row", "at.col")


# ------------------------------------------------------------- recognised words
@query("words_to_runs", """
    select id, run_no, string_agg(case when first then t else case when t = '字' or lag_t = '字' then t else ' ' || t end end, '' order by n) as text
    from (select *, row_number() over (partition by id, run_no order by n) = 1 as first, lag(t) over (partition by id, run_no order by n) as lag_t from (
        select *, sum(cast(l_quantity > 40 and k > 1 as int) + cast(k = 1 as int)) over (partition by id order by n) as run_no from (
            select *, row_number() over (partition by id order by n) as k from (
                select l_orderkey as id, n, l_quantity, case when l_partkey % 4 = 0 then '字' else 'w' || l_partkey end as t, l_partkey % 9 = 1 as noise
                from (""" + _ranked + """) as r) as a where not noise) as b) as c) as d
    group by id, run_no""")
def words_to_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recognised words to runs: noise dropped, wide gaps cut, Han characters joined."""
    rows = line_key(table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")).withColumn(
        "noise", F.col("l_partkey") % 9 == 1)
    from pyspark.sql.window import Window

    # Words lie 5 apart (no space beside Han), and 20 apart where a run ends; noise takes no room.
    order = Window.partitionBy("l_orderkey").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    step = F.when(F.col("noise"), 0.0).when(F.col("l_quantity") > 40, 60.0).otherwise(45.0)
    words = rows.withColumn("x1", F.sum(step).over(order)).select(
        F.col("l_orderkey").alias("id"), F.lit(1).alias("page"), F.lit(1).alias("line_no"), F.col("n").alias("word_no"),
        F.when(F.col("noise"), "|=").when(F.col("l_partkey") % 4 == 0, "字").otherwise(F.concat(F.lit("w"), "l_partkey")).alias("text"),
        (F.col("x1") - 40.0).alias("x0"), "x1", F.lit(90.0).alias("confidence"), F.lit(10.0).alias("row_height"))
    return layout.word_runs(words, "id").select("id", "run_no", "text")


# ----------------------------------------------------------------------- tables
@query("cells_unpivot", """
    select c_custkey as id, 1 as col, 'c_name' as "column", c_name as text from customer
    union all select c_custkey, 2, 'c_mktsegment', c_mktsegment from customer""")
def cells_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text columns of a table as cells; numbers are no text cells."""
    return cells_of(table(spark, sf_dir, "customer"), "c_custkey").select(F.col("c_custkey").alias("id"), "col", "column", "text")


@query("redact_table", """
    select c_custkey, c_nationkey, c_acctbal, case when c_name is null then null else regexp_replace(c_name, '[0-9]{9}', '[識別碼]') end as c_name,
           c_mktsegment from customer""")
def redact_table_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table with the customer numbers inside its text columns replaced."""
    rule = custom_rule("c-customer", "customer number", "識別碼", r"\d{9}")
    return redact_table(table(spark, sf_dir, "customer"), [rule], "label")


@query("redact_table_all_rules", "select s_suppkey, s_nationkey, s_acctbal, s_name from supplier")
def redact_table_all_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All built-in rules over a table without sensitive values: nothing changes."""
    return redact_table(table(spark, sf_dir, "supplier"), None, "label")
