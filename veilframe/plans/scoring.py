"""Queries that score detections and shapes against answer keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.operators import evaluate
from veilframe.plans.derived import table, texts
from veilframe.session import by_key, tasks_for

QUERIES: dict = {}


def query(name: str, sql: str | None):
    def add(fn):
        QUERIES[name] = (fn, sql)
        return fn

    return add


# The "reading" of a document: every z lost, every e doubled, in a copy of its text.
_truth = "select doc_id, unnest(string_split(regexp_replace(text, '\\s', '', 'g'), '')) as ch from documents"
_read = "select doc_id, unnest(string_split(regexp_replace(replace(replace(text, 'z', ''), 'e', 'ee'), '\\s', '', 'g'), '')) as ch from documents"


def _pair(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = texts(spark, sf_dir)
    read = docs.withColumn("text", F.replace(F.replace("text", F.lit("z"), F.lit("")), F.lit("e"), F.lit("ee")))
    return docs, read


@query("char_recall", f"""
    select doc_id, cast(sum(t) as bigint) as truth, cast(sum(r) as bigint) as read, cast(sum(least(t, r)) as bigint) as same,
           sum(least(t, r)) / greatest(sum(t), 1) as recall, sum(least(t, r)) / greatest(sum(r), 1) as precision
    from (select coalesce(a.doc_id, b.doc_id) as doc_id, coalesce(t, 0) as t, coalesce(r, 0) as r
          from (select doc_id, ch, count(*) as t from ({_truth}) as x where ch <> '' group by 1, 2) as a
          full join (select doc_id, ch, count(*) as r from ({_read}) as y where ch <> '' group by 1, 2) as b on a.doc_id = b.doc_id and a.ch = b.ch) as q
    group by doc_id""")
def char_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters of a reading found in the truth and the other way round, order free."""
    return evaluate.character_scores(*_pair(spark, sf_dir), "doc_id")


@query("char_difference", f"""
    select a.doc_id, a.ch, t - coalesce(r, 0) as n
    from (select doc_id, ch, count(*) as t from ({_truth}) as x where ch <> '' group by 1, 2) as a
    left join (select doc_id, ch, count(*) as r from ({_read}) as y where ch <> '' group by 1, 2) as b on a.doc_id = b.doc_id and a.ch = b.ch
    where t > coalesce(r, 0)""")
def char_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters the reading lost."""
    return evaluate.character_difference(*_pair(spark, sf_dir), "doc_id")


# Truth: one value per line; found: some lost, some with a digit misread, some invented.
_value = "lpad(cast(l_partkey * 7919 % 100000000 as varchar), 8, '0')"
_truth_values = f"""
    select distinct l_orderkey as page, case l_partkey % 3 when 0 then 'printed' when 1 then 'handwritten' else 'manual' end as kind,
           case l_partkey % 2 when 0 then '統編' else '識別碼' end as category, {_value} as value from lineitem"""
_found_values = f"""
    select distinct page, category, case n % 5 when 0 then null when 1 then left(value, 7) || 'x' when 2 then 'new' || left(value, 1) else value end as value
    from (select l_orderkey as page, l_partkey as n, case l_partkey % 2 when 0 then '統編' else '識別碼' end as category, {_value} as value from lineitem) as q
    where n % 5 <> 0"""


def _values(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    p = F.col("l_partkey")
    # Both sides come from one exchange of the keys, equal rows of a page being in one task.
    base = by_key(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey"), "l_orderkey").select(
        F.col("l_orderkey").alias("page"), p.alias("n"),
        F.when(p % 3 == 0, "printed").when(p % 3 == 1, "handwritten").otherwise("manual").alias("kind"),
        F.when(p % 2 == 0, "統編").otherwise("識別碼").alias("category"),
        F.lpad((p * 7919 % 100000000).cast("string"), 8, "0").alias("value"))
    n = F.col("n") % 5
    value = (F.when(n == 1, F.concat(F.left("value", F.lit(7)), F.lit("x"))).when(
        n == 2, F.concat(F.lit("new"), F.left("value", F.lit(1)))).otherwise(F.col("value")))
    found = base.where("n % 5 <> 0").select("page", "category", value.alias("value")).distinct()
    truth = base.select("page", "kind", "category", "value").distinct()
    return truth, found


@query("value_hits", f"""
    select kind, count(*) as expected, count(f.value) as hits from ({_truth_values}) as t
    left join ({_found_values}) as f on f.page = t.page and f.category = t.category and f.value = t.value group by kind""")
def value_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected values that were found, per kind."""
    return evaluate.value_hits(*_values(spark, sf_dir), "page")


@query("false_alarms", f"""
    with truth as ({_truth_values}), found as ({_found_values}),
    extra as (select f.* from found as f where not exists (select 1 from truth as t where t.page = f.page and t.value = f.value)),
    missed as (select * from truth as t where kind <> 'manual' and not exists (
        select 1 from found as f where f.page = t.page and f.category = t.category and f.value = t.value))
    select page, category, value, exists (select 1 from missed as m where m.page = e.page and m.category = e.category
        and levenshtein(e.value, m.value) <= greatest(1, cast(floor(length(m.value) * 0.2 + 0.5) as int))) as misread from extra as e""")
def false_alarms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Found values that were not expected: misread ones told from wrong ones."""
    return evaluate.false_alarms(*_values(spark, sf_dir), "page", tasks_for(table(spark, sf_dir, "lineitem")))


# Boxes from parts: the found one is shifted by an amount that depends on the key.
_tb = """select p_size as page, p_partkey as box_id, p_partkey * 97 % 2000 * 1.0 as x, p_partkey * 31 % 2000 * 1.0 as y, 40.0 + p_partkey % 30 as width,
         20.0 + p_partkey % 20 as height, p_partkey % 256 as red, p_partkey * 3 % 256 as green, p_partkey * 7 % 256 as blue from part"""
_fb = f"""select page, box_id, x + box_id % 25 as x, y + box_id % 11 as y, width, height, (red + box_id % 60) as red, green, blue from ({_tb}) as t where box_id % 6 <> 0"""
_pairs = """(least(t.x + t.width, f.x + f.width) - greatest(t.x, f.x)) as w, (least(t.y + t.height, f.y + f.height) - greatest(t.y, f.y)) as h"""


def _box_sql(more: str = "true") -> str:
    return f"""
    select t.page, count(*) as boxes, count(m.box_id) as matched from ({_tb}) as t left join (
        select distinct page, box_id from (
            select t.page, t.box_id, {_pairs}, t.width * t.height + f.width * f.height as area
            from ({_tb}) as t join ({_fb}) as f on f.page = t.page and {more}) as p
        where w > 0 and h > 0 and w * h / (area - w * h) >= 0.5) as m on m.page = t.page and m.box_id = t.box_id
    group by t.page"""


def _boxes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    k = F.col("p_partkey")
    truth = table(spark, sf_dir, "part").select(
        F.col("p_size").alias("page"), k.alias("box_id"), (k * 97 % 2000 * 1.0).alias("x"), (k * 31 % 2000 * 1.0).alias("y"),
        (40.0 + k % 30).alias("width"), (20.0 + k % 20).alias("height"), (k % 256).alias("red"), (k * 3 % 256).alias("green"),
        (k * 7 % 256).alias("blue"))
    found = truth.where("box_id % 6 <> 0").select(
        "page", "box_id", (F.col("x") + F.col("box_id") % 25).alias("x"), (F.col("y") + F.col("box_id") % 11).alias("y"), "width", "height",
        (F.col("red") + F.col("box_id") % 60).alias("red"), "green", "blue")
    return truth, found


@query("box_match", _box_sql())
def box_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures found again: at least half the union in common."""
    return evaluate.box_matches(*_boxes(spark, sf_dir), "page")


@query("fill_match", _box_sql("abs(t.red - f.red) <= 40 and abs(t.green - f.green) <= 40 and abs(t.blue - f.blue) <= 40"))
def fill_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fills found again at the same place in a close colour."""
    return evaluate.box_matches(*_boxes(spark, sf_dir), "page", colour_distance=40)


_tc = "select p_size as page, p_partkey as box_id, p_partkey * 97 % 2000 * 1.0 as x, p_partkey * 31 % 2000 * 1.0 as y, 8.0 + p_partkey % 4 as size, p_partkey % 2 = 0 as checked from part"
_fc = f"select page, box_id, x + box_id % 6 as x, y + box_id % 3 as y, size, case when box_id % 7 = 0 then not checked else checked end as checked from ({_tc}) as t where box_id % 5 <> 0"


@query("checkbox_match", f"""
    select t.page, count(*) as boxes, count(m.ok) as found, count(*) filter (coalesce(m.ok, false)) as right_state from ({_tc}) as t left join (
        select t.page, t.box_id, bool_or(t.checked = f.checked) as ok from ({_tc}) as t join ({_fc}) as f on f.page = t.page
        where sqrt(power(t.x + t.size / 2 - f.x - f.size / 2, 2) + power(t.y + t.size / 2 - f.y - f.size / 2, 2)) <= 4
        group by 1, 2) as m on m.page = t.page and m.box_id = t.box_id group by t.page""")
def checkbox_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Check boxes found nearby, and in the right state."""
    k, b = F.col("p_partkey"), F.col("box_id")
    truth = table(spark, sf_dir, "part").select(
        F.col("p_size").alias("page"), k.alias("box_id"), (k * 97 % 2000 * 1.0).alias("x"), (k * 31 % 2000 * 1.0).alias("y"),
        (8.0 + k % 4).alias("size"), (k % 2 == 0).alias("checked"))
    found = truth.where("box_id % 5 <> 0").select(
        "page", "box_id", (F.col("x") + b % 6).alias("x"), (F.col("y") + b % 3).alias("y"), "size",
        F.when(b % 7 == 0, ~F.col("checked")).otherwise(F.col("checked")).alias("checked"))
    return evaluate.checkbox_matches(truth, found, "page")


# Ruled lines: found in two pieces, or shifted across.
_tl = """select p_size as page, p_partkey as line_id, p_partkey * 97 % 3000 * 1.0 as x1, p_partkey * 31 % 3000 * 1.0 as y1,
         p_partkey * 97 % 3000 + case when p_partkey % 2 = 0 then 100.0 + p_partkey % 50 else 0.0 end as x2,
         p_partkey * 31 % 3000 + case when p_partkey % 2 = 0 then 0.0 else 100.0 + p_partkey % 50 end as y2 from part"""
_fl = f"""select page, line_id, case when flat then x1 else x1 + line_id % 5 end as x1, case when flat then y1 + line_id % 5 else y1 end as y1,
         case when flat then x1 + (x2 - x1) * 0.6 else x1 + line_id % 5 end as x2, case when flat then y1 + line_id % 5 else y1 + (y2 - y1) * 0.6 end as y2
         from (select *, line_id % 2 = 0 as flat from ({_tl}) as t) as q"""


def _laid(sql: str) -> str:
    return f"""select page, line_id, abs(y2 - y1) <= abs(x2 - x1) as flat, case when abs(y2 - y1) <= abs(x2 - x1) then (y1 + y2) / 2 else (x1 + x2) / 2 end as pos,
        case when abs(y2 - y1) <= abs(x2 - x1) then least(x1, x2) else least(y1, y2) end as lo,
        case when abs(y2 - y1) <= abs(x2 - x1) then greatest(x1, x2) else greatest(y1, y2) end as hi from ({sql}) as l"""


@query("line_coverage", f"""
    select t.page, t.line_id, round(coalesce(c.covered, 0.0), 6) as covered from ({_tl}) as t left join (
        select a.page, a.line_id, least(1.0, sum(greatest(0.0, least(a.hi, b.hi) - greatest(a.lo, b.lo)) / greatest(1.0, a.hi - a.lo))) as covered
        from ({_laid(_tl)}) as a join ({_laid(_fl)}) as b on a.page = b.page and a.flat = b.flat and abs(a.pos - b.pos) <= 3 group by 1, 2) as c
    on c.page = t.page and c.line_id = t.line_id""")
def line_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of each ruled line that found lines lie along."""
    k = F.col("p_partkey")
    even, size = k % 2 == 0, 100.0 + k % 50
    x, y = k * 97 % 3000, k * 31 % 3000
    truth = table(spark, sf_dir, "part").select(
        F.col("p_size").alias("page"), k.alias("line_id"), (x * 1.0).alias("x1"), (y * 1.0).alias("y1"),
        (x + F.when(even, size).otherwise(0.0)).alias("x2"), (y + F.when(even, F.lit(0.0)).otherwise(size)).alias("y2"))
    n, flat = F.col("line_id") % 5, F.col("line_id") % 2 == 0
    found = truth.select(
        "page", "line_id", F.when(flat, F.col("x1")).otherwise(F.col("x1") + n).alias("x1"),
        F.when(flat, F.col("y1") + n).otherwise(F.col("y1")).alias("y1"),
        F.when(flat, F.col("x1") + (F.col("x2") - F.col("x1")) * 0.6).otherwise(F.col("x1") + n).alias("x2"),
        F.when(flat, F.col("y1") + n).otherwise(F.col("y1") + (F.col("y2") - F.col("y1")) * 0.6).alias("y2"))
    return evaluate.line_coverage(truth, found, "page").withColumn("covered", F.round("covered", 6))
