"""Queries that redact, give out codes, write mapping tables, restore and audit."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.functions import fixed_values as fv
from veilframe.functions.masks import mask_display
from veilframe.functions.numbering_plan import NANP_AREA
from veilframe.functions.retention import (
    STANDARD, Retention, describe, lint, modes_for, split_for,
)
from veilframe.functions.text import each
from veilframe.operators import audit, reports
from veilframe.operators.codes import allocate, mapping_conflicts
from veilframe.operators.detect import candidates, detect, item_table, resplit
from veilframe.operators.redact import mapping_per_document, merge_mappings, previewed, redact
from veilframe.operators.restore import missing_codes, restore, restore_report
from veilframe.operators.rules import builtin_rules, custom_rule
from veilframe.plans import oracle as o
from veilframe.plans.derived import derived, derived_sql, table, texts
from veilframe.plans.detection import WORD_RULES, _cands, as_items, messages
from veilframe.plans.pipelines import deidentify, deidentify_shared, deidentify_with_mapping
from veilframe.session import materialize, shared_folder
from veilframe.sources.mapping import checked_mapping, csv_line, judged_mapping, mapping_csv_text, read_mapping
from veilframe.streaming.stream import redact_new_files

QUERIES: dict = {}
SECRET = o.SECRET


def query(name: str, sql: str | None):
    def add(fn):
        QUERIES[name] = (fn, sql)
        return fn

    return add


ITEMS = o.message_items(NANP_AREA, fv.CARD_PREFIX.replace(r"\d", "[0-9]"))
HIDE, PARTIAL = o.with_split(ITEMS, False), o.with_split(ITEMS, True)
LABEL = "'[' || category || ']'"
CODE = f"'[' || category || ':' || {o.code_sql('it.id')} || ']'"
BLANK = f"regexp_replace({o.hidden()}, '[\\p{{L}}\\p{{N}}]', '○', 'g')"


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rules, standard partial retention, codes per document: redacted text and item counts."""
    docs = texts(spark, sf_dir)
    done = deidentify(docs, "doc_id", mode="standard", secret=SECRET)
    return done.select("doc_id", F.size("items").alias("n_items"),
                       F.array_join(F.array_sort(F.array_distinct(F.col("items")["category"])), ",").alias("categories"),
                       "redacted")


# ------------------------------------------------------------------ redaction
def redacted_as(style: str, mode: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return deidentify(messages(spark, sf_dir), "id", style=style, mode=mode, secret=SECRET).select("id", "redacted")

    return run


query("redact_label", o.splice_sql(HIDE, o.kept(LABEL)))(redacted_as("label", "hide"))
query("redact_blank", o.splice_sql(HIDE, o.kept(BLANK)))(redacted_as("blank", "hide"))
query("redact_blank_partial", o.splice_sql(PARTIAL, o.kept(BLANK)))(redacted_as("blank", "standard"))
query("redact_partial", o.splice_sql(PARTIAL, o.kept(LABEL)))(redacted_as("label", "standard"))
query("redact_code", o.splice_sql(HIDE, o.kept(CODE)))(redacted_as("code", "hide"))
query("redact_code_partial", o.splice_sql(PARTIAL, o.kept(CODE)))(redacted_as("code", "standard"))


@query("redact_stream", o.splice_sql(HIDE, o.kept(LABEL)))
def redact_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts as a stream of files: some are there at first, the others come later, and a last start finds nothing new."""
    folder = f"{shared_folder(spark).rstrip('/')}/veilframe/stream-{uuid.uuid4().hex}"
    first = F.pmod(F.xxhash64("id"), F.lit(2)) == 0
    texts_now = messages(spark, sf_dir)
    for arriving in (texts_now.where(first), texts_now.where(~first), None):
        if arriving is not None:
            arriving.write.mode("append").parquet(f"{folder}/in")
        done = redact_new_files(spark, f"{folder}/in", folder, "id string, text string", "id")
    return done


OVERRIDES = {"電子郵件": Retention("delim", delimiter="@", side="before"), "IP": Retention("ends", head=2, tail=1)}
_custom = (f"select *, case category when '電子郵件' then strpos(value, '@') when 'IP' then 2 else 0 end as head, "
           f"case category when 'IP' then 1 else 0 end as tail from ({ITEMS}) as i")


@query("redact_custom_retention", o.splice_sql(_custom, o.kept(LABEL)))
def redact_custom_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retention chosen per category; other categories are hidden."""
    return deidentify(messages(spark, sf_dir), "id", style="label", mode="custom", overrides=OVERRIDES).select("id", "redacted")


@query("preview_items", f"select id, start_pos, {o.kept(LABEL)} as shown from ({PARTIAL}) as it")
def preview_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """On-screen form of every item."""
    docs = detect(messages(spark, sf_dir), mode="standard")
    return each(docs, "items", "id", name="i").select(
        "id", F.col("i")["start"].cast("long").alias("start_pos"), previewed(F.col("i")).alias("shown"))


# ---------------------------------------------------------------------- codes
@query("resplit_codes", f"""
    select h.id, h.start_pos, {o.code_sql('h.id', 'h.category', '0', '0', 'h.value')} as code_hidden,
           {o.code_sql('p.id', 'p.category', 'p.head', 'p.tail', 'p.value')} as code_partial
    from ({HIDE}) as h join ({PARTIAL}) as p on p.id = h.id and p.start_pos = h.start_pos""")
def resplit_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Another output mode gives another code exactly where the split changes."""
    from veilframe.operators.codes import code_per_document

    found = detect(messages(spark, sf_dir))
    hidden = code_per_document(found, "id", SECRET)
    both = code_per_document(resplit(hidden.withColumn("old", F.col("items")), mode="standard"), "id", SECRET)
    pairs = each(both, F.arrays_zip("old", "items"), "id", name="z")
    return pairs.select("id", F.col("z.old.start").cast("long").alias("start_pos"),
                        F.col("z.old.code").alias("code_hidden"), F.col("z.items.code").alias("code_partial"))


def order_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.lit("shared").alias("scope"), F.lit("識別碼").alias("category"), F.lit(0).alias("head"), F.lit(0).alias("tail"),
        F.concat(F.lit("ORD"), "o_orderkey").alias("value"))


def _rounds(keys: str, taken: str, rounds: int = 4) -> str:
    """Code allocation, unrolled: every round the first key of each free code wins."""
    sql, ctes = [], [f"k0 as ({keys})", f"t0 as ({taken})"]
    for n in range(rounds):
        ctes.append(f"c{n} as (select value, {o.code_sql(chr(39) + 'shared' + chr(39), chr(39) + '識別碼' + chr(39), '0', '0', 'value', str(n))} as code from k{n})")
        ctes.append(f"r{n} as (select value, code, code not in (select code from t{n}) and row_number() over (partition by code order by value) = 1 as won from c{n})")
        ctes.append(f"k{n + 1} as (select value from r{n} where not won)")
        ctes.append(f"t{n + 1} as (select code from t{n} union all select code from r{n} where won)")
        sql.append(f"select value, code from r{n} where won")
    return f"with {', '.join(ctes)} " + " union all ".join(sql)


@query("allocate_codes", _rounds("select 'ORD' || o_orderkey as value from orders", "select '' as code"))
def allocate_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One code per distinct value of a shared scope, clashes retried."""
    return allocate(order_keys(spark, sf_dir), SECRET).select("value", "code")


_known = "select 'ORD' || o_orderkey as value, lpad(lower(to_hex(o_orderkey * 13)), 6, '0') as code from orders where o_orderstatus = 'F'"


@query("codes_continued", f"select value, code from ({_rounds(f'select value from (select {chr(39)}ORD{chr(39)} || o_orderkey as value from orders where o_orderstatus <> {chr(39)}F{chr(39)}) as q', f'select code from ({_known}) as kn')}) as fresh union all {_known}")
def codes_continued(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finished orders bring codes from an earlier table; the rest get free ones."""
    key = F.col("o_orderkey")
    earlier = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(
        F.lit("shared").alias("scope"), key.alias("line_no"), F.lpad(F.lower(F.hex(key * 13)), 6, "0").alias("code"),
        F.lit("識別碼").alias("category"), F.concat(F.lit("ORD"), key).alias("original"),
        F.lit("").alias("kept_prefix"), F.lit("").alias("kept_suffix"))
    return allocate(order_keys(spark, sf_dir), SECRET, earlier).select("value", "code")


_conflict_rows = ("select o_orderkey as line_no, substr(md5(cast(o_orderkey % 5000 as varchar)), 1, 6) as code, 'C' as prefix, "
                  "lpad(cast(o_custkey as varchar), 6, '0') as original from orders")


@query("code_conflicts", f"""
    select value, kept_code, code as ignored_code from (
        select prefix || original as value, code, first_value(code) over (partition by original order by line_no) as kept_code
        from ({_conflict_rows}) as r) as q where code <> kept_code""")
def code_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values an imported table lists under several codes."""
    key = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(
        F.lit("shared").alias("scope"), key.alias("line_no"), F.substring(F.md5((key % 5000).cast("string")), 1, 6).alias("code"),
        F.lit("識別碼").alias("category"), F.lpad(F.col("o_custkey").cast("string"), 6, "0").alias("original"),
        F.lit("C").alias("kept_prefix"), F.lit("").alias("kept_suffix"))
    return mapping_conflicts(rows).select("value", "kept_code", "ignored_code")


_shared = o.code_sql("'shared'")


@query("redact_shared", o.splice_sql(PARTIAL, o.kept(f"'[' || category || ':' || {_shared} || ']'")))
def redact_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes shared by all messages: the same value has the same code everywhere."""
    return deidentify_shared(messages(spark, sf_dir), "id", mode="standard", secret=SECRET).documents.select("id", "redacted")


@query("mapping_shared", f"""
    select code, category, original, kept_prefix, kept_suffix, first_doc, first_start from (
        select {_shared} as code, category, {o.hidden()} as original, left(value, head) as kept_prefix,
               case when tail = 0 then '' else right(value, tail) end as kept_suffix, id as first_doc, start_pos as first_start,
               row_number() over (partition by category, value order by id, start_pos) as rn
        from ({PARTIAL}) as it) as q where rn = 1""")
def mapping_shared_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mapping table of a shared scope, with the place each code is first used."""
    done = deidentify_shared(messages(spark, sf_dir), "id", mode="standard", secret=SECRET)
    return done.mapping.drop("scope")


# ------------------------------------------------------------- mapping tables
_mapping = f"""
    select id as scope, row_number() over (partition by id order by start_pos) as line_no, code, category, original, kept_prefix, kept_suffix
    from (select id, start_pos, {o.code_sql('id')} as code, category, {o.hidden()} as original, left(value, head) as kept_prefix,
                 case when tail = 0 then '' else right(value, tail) end as kept_suffix,
                 row_number() over (partition by id, category, value order by start_pos) as rn
          from ({PARTIAL}) as it) as q where rn = 1"""


def coded(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    done = deidentify_with_mapping(messages(spark, sf_dir), "id", mode="standard", secret=SECRET)
    return done.documents, done.mapping


@query("mapping_table", _mapping)
def mapping_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One mapping row per code of every document, in order of first use."""
    docs = deidentify(messages(spark, sf_dir), "id", mode="standard", secret=SECRET)
    return mapping_per_document(docs, "id").withColumn("line_no", F.col("line_no").cast("long"))


def _orders_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.lit("batch").alias("scope"), F.col("o_orderkey").alias("line_no"), "o_orderstatus",
        F.substring(F.md5(F.col("o_custkey").cast("string")), 1, 6).alias("code"), F.lit("識別碼").alias("category"),
        F.col("o_orderpriority").alias("original"), F.lit("").alias("kept_prefix"), F.lit("").alias("kept_suffix"))


@query("merge_mappings", """
    select code, original, source, line_no from (
        select *, row_number() over (partition by code order by source, line_no) as rn from (
            select o_orderkey as line_no, substr(md5(cast(o_custkey as varchar)), 1, 6) as code, o_orderpriority as original,
                   case o_orderstatus when 'F' then 0 when 'O' then 1 else 2 end as source from orders) as a) as b where rn = 1""")
def merge_mappings_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three mapping tables merged: the earliest table, then the earliest line, keeps a code."""
    rows = _orders_mapping(spark, sf_dir)
    parts = [rows.where(F.col("o_orderstatus") == s) for s in ("F", "O")]
    parts.append(rows.where(~F.col("o_orderstatus").isin("F", "O")))
    return merge_mappings(*parts).select("code", "original", "source", "line_no")


_faulty = ("select cast(o_custkey as varchar) as scope, o_orderkey as line_no, case when o_orderkey % 11 = 0 then '  ' "
           "else substr(md5(o_orderpriority), 1, 6) end as code from orders")


@query("mapping_errors", f"""
    select scope, line_no, trim(code) as code, case when trim(code) = '' then 'empty_code' else 'duplicate_code' end as error from (
        select *, row_number() over (partition by scope, code order by line_no) as rn from ({_faulty}) as f) as q
    where trim(code) = '' or rn > 1""")
def mapping_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of mapping tables: rows without a code, and codes used again."""
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").cast("string").alias("scope"), F.col("o_orderkey").alias("line_no"),
        F.when(F.col("o_orderkey") % 11 == 0, "  ").otherwise(F.substring(F.md5("o_orderpriority"), 1, 6)).alias("code"))
    return checked_mapping(rows)[1]


@query("duplicate_codes", """
    select trim(code) as code, count(*) as rows from (
        select case when o_orderkey % 11 = 0 then '  ' else substr(md5(cast(o_orderkey % 9000 as varchar)), 1, 6) end as code from orders) as q
    group by trim(code) having count(*) > 1 or trim(code) = ''""")
def duplicate_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes a mapping table lists more than once."""
    key = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(F.when(key % 11 == 0, "  ").otherwise(
        F.substring(F.md5((key % 9000).cast("string")), 1, 6)).alias("code"))
    return reports.duplicate_codes(rows)


@query("mapping_csv", """
    select scope, chr(65279) || 'code,category,original' || case when bool_or(p <> '') then ',kept_prefix,kept_suffix' else '' end || chr(13) || chr(10)
           || string_agg(code || ',識別碼,"' || replace(original, '"', '""') || '"' || case when has_p then ',' || p || ',' else '' end, chr(13) || chr(10) order by line_no)
           || chr(13) || chr(10) as csv
    from (select *, bool_or(p <> '') over (partition by scope) as has_p from (
        select cast(o_custkey as varchar) as scope, o_orderkey as line_no, substr(md5(cast(o_orderkey as varchar)), 1, 6) as code,
               'a "' || o_orderpriority || '", b' as original, case when o_orderstatus = 'P' then 'K' else '' end as p from orders) as a) as b
    group by scope""")
def mapping_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mapping tables as CSV texts; the kept columns appear only where some row keeps characters."""
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").cast("string").alias("scope"), F.col("o_orderkey").alias("line_no"),
        F.substring(F.md5(F.col("o_orderkey").cast("string")), 1, 6).alias("code"), F.lit("識別碼").alias("category"),
        F.concat(F.lit('a "'), "o_orderpriority", F.lit('", b')).alias("original"),
        F.when(F.col("o_orderstatus") == "P", "K").otherwise("").alias("kept_prefix"), F.lit("").alias("kept_suffix"))
    return mapping_csv_text(rows)


_file_rows = """
    select o_orderkey, cast(floor(o_orderkey / 100000) as bigint) as file_no,
           case when o_orderkey % 101 = 0 then ' ' when o_orderkey % 103 = 0 then 'again' else 'c' || cast(o_orderkey as string) end as code,
           '"' || o_orderpriority || '", ' || case o_orderkey % 4 when 0 then chr(10) || 'second' when 1 then chr(13) || chr(10) || ',"' || chr(10) else 'one' end as original,
           case o_orderkey % 4 when 0 then 1 when 1 then 2 else 0 end as breaks
    from {orders}"""


@query("mapping_files", f"""
    select file_no, line_no, trim(code) as code, original, case when trim(code) = '' then 'empty_code' when rn > 1 then 'duplicate_code' end as error from (
        select *, row_number() over (partition by file_no, trim(code) order by line_no) as rn from (
            select *, cast(2 + coalesce(sum(1 + breaks) over (partition by file_no order by o_orderkey rows between unbounded preceding and 1 preceding), 0) as bigint) as line_no
            from ({_file_rows.format(orders='orders')}) as f) as g) as h""")
def mapping_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mapping files (one for 100,000 order keys) with line breaks inside fields, read back in splits: lines, codes, values and faults."""
    rows = spark.sql(_file_rows, orders=table(spark, sf_dir, "orders"))
    heads = rows.select("file_no", F.lit(-1).cast("long").alias("o_orderkey")).distinct().withColumn("line", F.lit("code,category,original"))
    lines = rows.select("file_no", F.col("o_orderkey").cast("long"), csv_line(F.col("code"), F.lit("識別碼"), F.col("original")).alias("line"))
    folder = f"{shared_folder(spark).rstrip('/')}/veilframe/mapping-files-{uuid.uuid4().hex}"
    # A file is one hash partition's rows of its number; the number of rows in it is bounded by the keys.
    heads.unionByName(lines).repartition("file_no").sortWithinPartitions("file_no", "o_orderkey").select("file_no", "line").write.option(
        "lineSep", "\r\n").partitionBy("file_no").text(folder)
    read = read_mapping(spark, folder).withColumn("scope", F.regexp_extract("file", r"file_no=(\d+)/", 1).cast("long"))
    judged = judged_mapping(materialize(read.select("scope", "line_no", "code", "original"), "mapping-rows"))
    return judged.select(F.col("scope").alias("file_no"), "line_no", "code", "original", "error")


# -------------------------------------------------------------------- restore
@query("restore_roundtrip", f"select id, text as restored from {o.DOCS} as d")
def restore_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Redacted and restored: every text is as it was."""
    docs, mapping = coded(spark, sf_dir)
    return restore(docs.select("id", "redacted"), mapping, "id").select("id", "restored")


@query("restore_private_use", f"select id, text as restored, true as hidden from {derived_sql('private_use_lines')} as d")
def restore_private_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values with private-use characters are hidden and come back as they were."""
    docs = derived(spark, sf_dir, "private_use_lines").select("id", "text")
    rules = [*builtin_rules("email"), custom_rule("c-1", "id", "識別碼", r"ID-.\d+")]
    done = deidentify_with_mapping(docs, "id", rules, secret=SECRET)
    hidden = ~F.col("redacted").contains("ID-") & ~F.col("redacted").contains("@")
    return restore(done.documents.select("id", "redacted"), done.mapping, "id").select("id", "restored", hidden.alias("hidden"))


@query("restore_missing", f"select distinct id, {o.code_sql('id')} as code from ({PARTIAL}) as it where category = 'IP'")
def restore_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes without a row in the table, here a table that lost its IP rows."""
    docs, mapping = coded(spark, sf_dir)
    return missing_codes(docs, mapping.where("category <> 'IP'"), "id")


@query("restore_report", f"""
    select id, count(*) filter (category <> 'IP') as restored,
           count(distinct {o.code_sql('id')}) filter (category = 'IP') as missing from ({PARTIAL}) as it group by id""")
def restore_report_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markers restored and codes missing, per text."""
    docs, mapping = coded(spark, sf_dir)
    report = restore_report(docs, mapping.where("category <> 'IP'"), "id")
    return report.select("id", "restored", F.size("missing_codes").cast("long").alias("missing"))


# -------------------------------------------------------------------- reports
@query("items_by_category", f"""
    select category, count(*) as items, min_by(value, id || lpad(cast(start_pos as varchar), 12, '0')) as sample from ({ITEMS}) as i group by category""")
def items_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items per category with the value that occurs first."""
    items = item_table(detect(messages(spark, sf_dir)), "id").withColumn(
        "place", F.concat("id", F.lpad(F.col("start").cast("string"), 12, "0")))
    return reports.by_category(items, "place").select("category", "items", "sample")


@query("items_per_document", f"""
    select coalesce(id, '(all)') as id, count(*) filter (category <> 'IP') as active, count(*) as total
    from ({ITEMS}) as i group by rollup (id)""")
def items_per_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active and total items per text and over all, with one category switched off."""
    items = item_table(detect(messages(spark, sf_dir)), "id").withColumn("active", F.col("category") != "IP")
    return reports.active_counts(items, "id").withColumn("id", F.coalesce("id", F.lit("(all)")))


@query("category_presence", f"""
    select category, true as active, bool_or(head > 0 or tail > 0) as partial from ({PARTIAL}) as i group by category""")
def category_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories that occur, and those that keep a part readable."""
    items = item_table(detect(messages(spark, sf_dir), mode="standard"), "id").withColumn("active", F.lit(True))
    return reports.category_presence(items)


@query("text_sizes", f"select id, length(text) as characters from {o.DOCS} as d")
def text_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.text_sizes(messages(spark, sf_dir), "id")


# --------------------------------------------------------------------- audits
@query("audit_residue", f"select distinct id, value from ({ITEMS}) as i where category = '電子郵件'")
def audit_residue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that still stand in an output whose e-mail items were left alone."""
    docs = detect(messages(spark, sf_dir))
    kept = docs.withColumn("shown", F.filter("items", lambda i: i["category"] != "電子郵件"))
    return audit.residue(redact(kept, "label", items="shown"), "id")


@query("audit_overlap", f"""
    select id, start_pos, end_pos from (select *, max(end_pos) over (
        partition by id order by start_pos, end_pos rows between unbounded preceding and 1 preceding) as reach from ({_cands}) as c) as q
    where start_pos < reach""")
def audit_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlaps among candidates that were not resolved."""
    docs = messages(spark, sf_dir)
    raw = each(docs, candidates(F.col("text"), WORD_RULES), "id", name="c").select("id", "c.*")
    return audit.overlaps(raw, "id").select("id", F.col("start").cast("long").alias("start_pos"), F.col("end").cast("long").alias("end_pos"))


_numbers = f"select id, start_pos, start_pos + length(value) as end_pos, value from ({o.find_sql(o.DOCS, '[0-9]{4,}')}) as n"


@query("audit_coverage", f"""
    select n.id, n.start_pos, n.value from ({_numbers}) as n where not exists (
        select 1 from ({ITEMS}) as i where i.id = n.id and n.start_pos >= i.start_pos and n.end_pos <= i.end_pos)""")
def audit_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Longer digit runs that no item covers."""
    docs = messages(spark, sf_dir)
    rule = custom_rule("c-digits", "digits", "識別碼", "[0-9]{4,}")
    left = audit.uncovered(docs, item_table(detect(docs), "id"), rule, "id")
    return left.select("id", F.col("start").cast("long").alias("start_pos"), "value")


@query("audit_one_to_one", f"""
    select distinct id as scope, {o.code_sql('id')} as code, true as in_text, false as in_mapping from ({PARTIAL}) as it where category = 'IP'""")
def audit_one_to_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of the texts that a table without its IP rows lacks."""
    docs, mapping = coded(spark, sf_dir)
    return audit.unpaired_codes(docs, mapping.where("category <> 'IP'"), "id")


@query("audit_round_trip", f"select distinct id from ({ITEMS}) as i where category = 'IP'")
def audit_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that a table without its IP rows does not restore."""
    docs, mapping = coded(spark, sf_dir)
    return audit.broken_round_trips(docs, mapping.where("category <> 'IP'"), "id")


# ---------------------------------------------------------- retention and masks
_records = derived_sql("record_lines")
_values = f"""
    select id, '姓名' as category, nm as value from {_records} as r union all select id, '手機', mob from {_records} as r
    union all select id, '市話', tel from {_records} as r union all select id, '地址', addr from {_records} as r
    union all select id, '公司', comp from {_records} as r union all select id, '統編', lpad(cast(id * 7919 as varchar), 8, '0') from {_records} as r
    union all select id, '身分證', 'A1' || lpad(cast(id * 7919 as varchar), 8, '0') from {_records} as r
    union all select id, '電子郵件', 'user' || id || '@example.com' from {_records} as r"""


def record_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = derived(spark, sf_dir, "record_lines")
    number = F.lpad((F.col("id") * 7919).cast("string"), 8, "0")
    pairs = {"姓名": F.col("nm"), "手機": F.col("mob"), "市話": F.col("tel"), "地址": F.col("addr"), "公司": F.col("comp"),
             "統編": number, "身分證": F.concat(F.lit("A1"), number),
             "電子郵件": F.concat(F.lit("user"), "id", F.lit("@example.com"))}
    return r.select("id", F.explode(F.array(*[F.struct(F.lit(c).alias("category"), v.alias("value"))
                                              for c, v in pairs.items()])).alias("p")).select("id", "p.*")


_suffix = f"regexp_extract(value, '{fv.COMPANY_SUFFIX}$')"


@query("mask_display", f"""
    select id, category, case category
        when '姓名' then left(value, 1) || repeat('O', length(value) - 1)
        when '身分證' then left(value, 3) || repeat('*', length(value) - 4) || right(value, 1)
        when '手機' then left(m, 4) || '-***-' || right(m, 3)
        when '市話' then left(t, 2) || '-****-' || right(t, 2)
        when '地址' then regexp_extract(value, '^.*?[市縣].*?[鄉鎮市區]') || '***'
        when '電子郵件' then left(value, 2) || '***' || substr(value, strpos(value, '@'))
        when '公司' then left(value, 2) || case when length(value) > 2 + length({_suffix}) then '**' else '*' end || {_suffix}
        else left(value, 2) || repeat('*', length(value) - 3) || right(value, 1) end as shown
    from (select *, regexp_replace({o.digits('value')}, '^886', '0') as m, {o.digits('value')} as t from ({_values}) as v) as w""")
def mask_display_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readable masks per category."""
    return record_values(spark, sf_dir).select("id", "category", mask_display(F.col("category"), F.col("value")).alias("shown"))


@query("standard_split", f"""
    select id, category, case category when '姓名' then 1 when '身分證' then 2
        when '手機' then length(regexp_extract(value, '^(?:[^0-9]*[0-9]){{4}}[^0-9]*'))
        when '市話' then length(regexp_extract(value, '^(?:[(]0[0-9]{{1,3}}[)]|0[0-9]{{1,3}}-)'))
        when '地址' then 6 else 0 end as head,
        case category when '電子郵件' then 12 when '公司' then length({_suffix}) else 0 end as tail
    from ({_values}) as v""")
def standard_split_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters the standard partial form keeps at each end."""
    kept = split_for(F.col("value"), STANDARD.column(), F.col("category"))
    return record_values(spark, sf_dir).withColumn("s", kept).select("id", "category", "s.head", "s.tail")


_number_values = """
    select o_orderkey as id, form, case when form < 5 then '生日' when form = 5 then 'SSN' when form = 6 then 'IBAN' else '識別碼' end as category, y,
           case form when 0 then y || '-' || m || '-' || d when 1 then y || '年' || m || '月' || d || '日'
               when 2 then '民國 ' || cast(cast(y as int) - 1911 as string) || ' 年 ' || m || ' 月 ' || d || ' 日'
               when 3 then m || '/' || d || '/' || y when 4 then 'May ' || d || ', ' || y
               when 5 then '123-45-' || y when 6 then 'DE' || d || ' ' || y || ' 0000' else 'K-' || cast(o_orderkey as string) end as value
    from (select o_orderkey, cast(o_orderkey % 8 as int) as form, substr(cast(o_orderdate as string), 1, 4) as y,
                 substr(cast(o_orderdate as string), 6, 2) as m, substr(cast(o_orderdate as string), 9, 2) as d from {orders}) as p"""


@query("standard_split_numbers", f"""
    select id, category, value, case form when 0 then 5 when 1 then 5 when 2 then length('民國 ' || cast(cast(y as int) - 1911 as varchar) || ' 年 ')
               when 6 then 2 when 7 then 1 else 0 end as head,
           case form when 3 then length('/' || y) when 4 then length(', ' || y) else 0 end as tail
    from ({_number_values.format(orders='orders')}) as v""")
def standard_split_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The standard partial form of birth dates (five ways of writing), SSN, IBAN and identifiers of own rules."""
    values = spark.sql(_number_values, orders=table(spark, sf_dir, "orders"))
    kept = split_for(F.col("value"), STANDARD.column(), F.col("category"))
    return values.withColumn("s", kept).select("id", "category", "value", "s.head", "s.tail")


@query("retention_modes", f"""
    select id, category, mode,
        case mode when 'ends' then case when 3 < length(value) then 2 else 0 end
            when 'surname' then case when length(value) > 1 then 1 else 0 end
            when 'before' then case when strpos(value, '-') > 0 then length(value) - strpos(reverse(value), '-') + 1 else 0 end
            when 'city' then case when category = '地址' then 3 else 0 end else 0 end as head,
        case mode when 'ends' then case when 3 < length(value) then 1 else 0 end
            when 'after' then case when strpos(value, '-') > 0 then length(value) - strpos(value, '-') + 1 else 0 end else 0 end as tail
    from ({_values}) as v, (select unnest(['ends', 'surname', 'before', 'after', 'city']) as mode) as m""")
def retention_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every way to keep a part of a value, clamped where nothing would stay hidden."""
    settings = {"ends": Retention("ends", head=2, tail=1), "surname": Retention("surname"),
                "before": Retention("delim", delimiter="-", side="before"),
                "after": Retention("delim", delimiter="-", side="after"), "city": Retention("city")}
    asked = F.array(*[F.struct(F.lit(n).alias("mode"), r.column().alias("r")) for n, r in settings.items()])
    rows = record_values(spark, sf_dir).select("*", F.explode(asked).alias("a"))
    return rows.withColumn("s", split_for(F.col("value"), F.col("a.r"), F.col("category"))).select(
        "id", "category", "a.mode", "s.head", "s.tail")


_settings = """
    select p_partkey as id, p_name as example, case p_partkey % 4 when 0 then 'ends' when 1 then 'delim' when 2 then 'preview' else 'none' end as mode,
           p_size % 12 - 1 as head, p_size % 5 as tail, case when p_partkey % 8 = 1 then '' else 'a' end as delimiter, 'after' as side from part"""


@query("lint_retention", f"""
    select id, case when mode = 'ends' and head < 0 then 'bad_length'
        when mode = 'delim' and delimiter = '' then 'no_delimiter'
        when mode = 'ends' and hidden <= 0 then 'nothing_hidden'
        when mode = 'delim' and strpos(ex, delimiter) = 1 then 'nothing_hidden' end as error,
        array_to_string(list_filter([
            case when mode = 'preview' then 'partial_exposes' end,
            case when mode = 'ends' and head > 0 and tail > 0 then 'both_ends' end,
            case when mode = 'delim' and delimiter <> '' and strpos(ex, delimiter) = 0 then 'delimiter_absent' end,
            case when mode = 'ends' and head >= 0 and hidden > 0 and hidden * 2 < length(ex) then 'under_half_hidden'
                 when mode = 'delim' and delimiter <> '' and strpos(ex, delimiter) > 1 and (strpos(ex, delimiter) - 1) * 2 < length(ex) then 'under_half_hidden' end
        ], lambda x: x is not null), ',') as warnings
    from (select *, length(ex) - head - tail as hidden from (select *, trim(string_split(replace(example, '，', ','), ',')[1]) as ex from ({_settings}) as s) as t) as q""")
def lint_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and warnings of retention settings, judged on an example."""
    judged = lint(F.col("example"), F.col("r"), F.lit("識別碼"))
    return _retention_rows(spark, sf_dir).withColumn("l", judged).select(
        "id", "l.error", F.array_join("l.warnings", ",").alias("warnings"))


def _retention_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    mode = F.when(key % 4 == 0, "ends").when(key % 4 == 1, "delim").when(key % 4 == 2, "preview").otherwise("none")
    return table(spark, sf_dir, "part").select(
        key.alias("id"), F.col("p_name").alias("example"),
        F.struct(mode.alias("mode"), (F.col("p_size") % 12 - 1).alias("head"), (F.col("p_size") % 5).alias("tail"),
                 F.when(key % 8 == 1, "").otherwise("a").alias("delimiter"), F.lit("after").alias("side")).alias("r"))


@query("describe_retention", f"""
    select id, case mode when 'ends' then case when head <= 0 and tail <= 0 then '全部隱藏'
            else '保留' || case when head > 0 then '前 ' || head || ' 碼' else '' end || case when head > 0 and tail > 0 then '＋' else '' end
                 || case when tail > 0 then '後 ' || tail || ' 碼' else '' end end
        when 'delim' then '保留「' || delimiter || '」之後' when 'preview' then '部分保留（標準）' else '全部隱藏' end as described,
        'none,ends,delim,preview' as modes
    from ({_settings}) as s""")
def describe_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retention settings in words, and the modes a category offers."""
    return _retention_rows(spark, sf_dir).select(
        "id", describe(F.col("r")).alias("described"), F.array_join(modes_for(F.lit("識別碼")), ",").alias("modes"))
