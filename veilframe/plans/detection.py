"""Queries that detect: one per rule, all rules together, and the detection machinery."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.functions import checks
from veilframe.functions import fixed_values as fv
from veilframe.functions.confusables import fix_lookalikes
from veilframe.functions.numbering_plan import NANP_AREA
from veilframe.functions.retention import RETENTION
from veilframe.functions.text import each, fenced, find_everywhere
from veilframe.operators.detect import (
    candidates, detect, find, has_markers, item_table,
)
from veilframe.operators.lookup import lookup
from veilframe.operators.many_rules import match_many
from veilframe.operators.overlaps import select_spans
from veilframe.operators.ranking import numbered_rows, running_sum
from veilframe.operators.rules import builtin_rules, custom_rule
from veilframe.operators.windows import match_long
from veilframe.plans import oracle as o
from veilframe.plans.derived import derived, derived_sql, table
from veilframe.session import spread

QUERIES: dict = {}


def query(name: str, sql: str | None):
    def add(fn):
        QUERIES[name] = (fn, sql)
        return fn

    return add


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and conversation turns as one table of texts."""
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), "doc_id").alias("id"), "text")
    turns = table(spark, sf_dir, "conversations").select(
        F.concat(F.lit("c"), "conv_id", F.lit("/"), "turn").alias("id"), "text")
    return spread(docs.unionByName(turns))


def as_items(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, F.col("start").cast("long").alias("start_pos"), F.col("end").cast("long").alias("end_pos"),
                     "category", "value")


def by_rule(rule_id: str, lines: str | None = None):
    """The items of one built-in rule over the messages or over derived lines."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = messages(spark, sf_dir) if lines is None else derived(spark, sf_dir, lines).select("id", "text")
        return as_items(item_table(detect(docs, builtin_rules(rule_id)), "id"), "id")

    return run


def line_items(lines: str, regex: str, category: str, value: str = "value", where: str = "true") -> str:
    return o.items_sql(o.find_sql(derived_sql(lines), regex), category, "id", value, where)


def behind(lines: str, label: str, regex: str, category: str, where: str = "true") -> str:
    """Items right behind a label: the label is cut off again."""
    found = o.find_sql(derived_sql(lines), f"(?:{label})(?:{regex})")
    cut = f"select id, start_pos + length(regexp_extract(value, '^({label})', 1)) as start_pos, regexp_replace(value, '^({label})', '') as value from ({found}) as l"
    return o.items_sql(cut, category, "id", "value", where)


_ssn_ok = (f"not regexp_matches({o.digits('v')}, '^(000|666|9)') and substr({o.digits('v')}, 4, 2) <> '00' "
           f"and substr({o.digits('v')}, 6, 4) <> '0000'")
_iban_bare = "replace(v, ' ', '')"
_iban_digits = ("replace(replace(replace(replace(replace(replace(substr({b}, 5) || substr({b}, 1, 4), "
                "'W', '32'), 'E', '14'), 'S', '28'), 'T', '29'), 'G', '16'), 'B', '11')").format(b=_iban_bare)
_ipv6_groups = "len(list_filter(string_split(v, ':'), lambda g: g <> ''))"
_ipv6_ok = (f"regexp_matches(v, '^(?:[0-9A-Fa-f]{{0,4}}:){{2,7}}[0-9A-Fa-f]{{1,4}}$') and {_ipv6_groups} >= 2 and "
            f"case when contains(v, '::') then not contains(v, ':::') and not regexp_matches(v, '::.*::') "
            f"and not regexp_matches(v, '^:[^:]') and {_ipv6_groups} <= 7 else {_ipv6_groups} = 8 end")
_date_ok = "cast(substr(v, 6, 2) as int) between 1 and 12 and cast(substr(v, 9, 2) as int) between 1 and 31"
_AREA = "(?:826|836|82|89|37|49|[2-8])"
_MOBILE = "(?:[+]886[- ]?9|09)[0-9]{2}[- ]?[0-9]{3}[- ]?[0-9]{3}"
_LANDLINE = f"[(]0{_AREA}[)][- ]?[0-9]{{3,4}}[- ]?[0-9]{{3,4}}|0{_AREA}[- ][0-9]{{3,4}}[- ]?[0-9]{{3,4}}"
_RE2_CJK = "[\\x{4e00}-\\x{9fa5}]"
_ADDRESS = (f"{fv.CITIES}(?:{_RE2_CJK}{{1,4}}[鄉鎮市區])?(?:[\\x{{4e00}}-\\x{{9fa5}}0-9]{{1,8}}(?:路|街|大道))?"
            "(?:[0-9]{1,4}巷)?(?:[0-9]{1,4}弄)?[0-9]{1,5}(?:之[0-9]{1,3})?號(?:[0-9一二三四五六七八九十]{1,3}樓)?")
_COMPANY = f"[\\x{{4e00}}-\\x{{9fa5}}A-Za-z0-9&·]{{2,14}}?{fv.COMPANY_SUFFIX}"

for _name, _rule, _lines, _sql in [
    ("detect_email", "email", None, o.email_items()),
    ("detect_ipv4", "ipv4", None, o.ipv4_items()),
    ("detect_phone", "intl-phone", None, o.phone_items(NANP_AREA)),
    ("detect_card_in_documents", "credit-card", None, o.card_items(fv.CARD_PREFIX.replace(r"\d", "[0-9]"))),
    ("detect_card", "credit-card", "card_lines", o.card_items(
        fv.CARD_PREFIX.replace(r"\d", "[0-9]"), derived_sql("card_lines"))),
    ("detect_tw_id", "tw-id", "tw_id_lines", line_items("tw_id_lines", "[A-Z][12][0-9]{8}", "身分證", where=o.tw_id_ok("v"))),
    ("detect_tax_id", "tw-tax-id", "tax_id_lines", line_items(
        "tax_id_lines", "[0-9-]+", "統編", where=f"regexp_matches(v, '^[0-9]{{8}}$') and {o.tax_id_ok('v')}")),
    ("detect_iban", "iban", "iban_lines", line_items(
        "iban_lines", "[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?", "IBAN",
        where=f"length({_iban_bare}) = 22 and cast({_iban_digits} as hugeint) % 97 = 1")),
    ("detect_ssn", "us-ssn", "ssn_lines",
     line_items("ssn_lines", "[0-9]{3}-[0-9]{2}-[0-9]{4}|[0-9]{3} [0-9]{2} [0-9]{4}", "SSN", where=_ssn_ok)
     + " union all " + behind("ssn_lines", "SSN: ", "[0-9]{9}", "SSN", _ssn_ok)),
    ("detect_ipv6", "ipv6", "ipv6_lines", line_items("ipv6_lines", "[^ ]+", "IP", where=_ipv6_ok)),
    ("detect_dob", "dob", "dob_lines", behind(
        "dob_lines", "DOB: |Date of Birth |出生日期：", "[0-9]{4}-[0-9]{2}-[0-9]{2}", "生日", _date_ok)),
    ("detect_phone_countries", "intl-phone", "phone_lines", line_items("phone_lines", "[+][0-9]+(?: [0-9]+)+", "國際電話", where="v not like '+999%'")),
    ("detect_email_in_pages", "email", "page_lines", o.email_items(derived_sql("page_lines"))),
    ("detect_tw_mobile", "tw-mobile", "record_lines", line_items("record_lines", _MOBILE, "手機")),
    ("detect_landline", "tw-landline", "record_lines", behind("record_lines", "電話 ", _LANDLINE, "市話")),
    ("detect_address", "tw-address", "record_lines", line_items("record_lines", _ADDRESS, "地址")),
    ("detect_company", "tw-company", "record_lines", line_items("record_lines", _COMPANY, "公司")),
]:
    query(_name, _sql)(by_rule(_rule, _lines))


# Names, position by position: surname, then two or one characters in front of a
# known follower, else two characters that can be part of a name.
_follow = fv.NAME_FOLLOW.replace("(?=", "^(?:", 1).replace(r"\z", "$").replace(fv.WS, r"\s").replace("\\d", "0-9")
_stops = ", ".join(o.quote(w) for w in fv.NAME_STOP_WORDS)
_name_at = f"""
    select id, i - 1 as start_pos, substr(text, i, s + g) as value, substr(text, i, 2) not in ({_stops})
      and not (substr(text, i, 1) = '方' and regexp_matches(substr(text, greatest(i - 1, 1), least(i - 1, 1)), '{fv.PARTY_BEFORE}')) as ok
    from (select *, case
            when regexp_matches(substr(text, i + s, 2), '^{_RE2_CJK}{{2}}$') and regexp_matches(substr(text, i + s + 2), '{_follow}') then 2
            when regexp_matches(substr(text, i + s, 1), '^{_RE2_CJK}$') and regexp_matches(substr(text, i + s + 1), '{_follow}') then 1
            when regexp_matches(substr(text, i + s, 2), '^{_RE2_CJK}{{2}}$') and not contains('{fv.NAME_STOP_CHARS}', substr(text, i + s, 1))
                 and not contains('{fv.NAME_STOP_CHARS}', substr(text, i + s + 1, 1)) then 2 else 0 end as g
        from (select id, text, i, 1 as s
              from (select id, text, unnest(range(1, length(text) + 1)) as i from {derived_sql('record_lines')} as r) as p
              where contains('{fv.SINGLE_SURNAMES}', substr(text, i, 1))) as q) as w
    where g > 0"""
query("detect_name", o.items_sql(o.walk_sql(_name_at), "姓名"))(by_rule("zh-name", "record_lines"))


@query("detect_all", " union all ".join([
    o.email_items(), o.ipv4_items(), o.phone_items(NANP_AREA), o.card_items(fv.CARD_PREFIX.replace(r"\d", "[0-9]"))]))
def detect_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All built-in rules over all messages, overlaps resolved."""
    return as_items(item_table(detect(messages(spark, sf_dir)), "id"), "id")


_rec = derived_sql("record_lines")


@query("detect_record_items", " union all ".join(
    f"select id, strpos(text, {c}) - 1 as start_pos, strpos(text, {c}) - 1 + length({c}) as end_pos, '{n}' as category, {c} as value from {_rec} as {c}_rows"
    for c, n in (("nm", "姓名"), ("mob", "手機"), ("tel", "市話"), ("addr", "地址"), ("comp", "公司"))))
def detect_record_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All built-in rules over the Chinese records: the longest of overlapping matches wins."""
    return as_items(item_table(detect(derived(spark, sf_dir, "record_lines").select("id", "text")), "id"), "id")


WORD_RULES = [
    custom_rule("c-long", "long words", "識別碼", "[A-Za-z]{9,}"),
    custom_rule("c-pair", "two words", "公司", "[A-Za-z]{4,6} [A-Za-z]{4,6}"),
]


@query("detect_custom_rule", o.items_sql(o.find_sql(o.DOCS, "[A-Za-z]{9,}"), "識別碼"))
def detect_custom_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's own rule over all messages."""
    hits = find(messages(spark, sf_dir), WORD_RULES[0], "id")
    return as_items(hits.withColumn("category", F.lit(WORD_RULES[0].category)), "id")


# The two rules overlap in chains (pair - long - pair never chains further than
# neighbours), so the check walks each text's candidates by rank.
_cands = (f"select id, start_pos, start_pos + length(value) as end_pos, 0 as rule_ord, '識別碼' as category, value from ({o.find_sql(o.DOCS, '[A-Za-z]{9,}')}) as a"
          f" union all select id, start_pos, start_pos + length(value), 1, '公司', value from ({o.find_sql(o.DOCS, '[A-Za-z]{4,6} [A-Za-z]{4,6}')}) as b")


@query("overlap_candidates", f"select id, count(*) as candidates, sum(end_pos - start_pos)::bigint as characters from ({_cands}) as c group by id")
def overlap_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches of two custom rules before overlaps are resolved, counted per text."""
    docs = messages(spark, sf_dir)
    found = each(docs, candidates(F.col("text"), WORD_RULES), "id", name="c")
    return found.groupBy("id").agg(F.count(F.lit(1)).alias("candidates"),
                                   F.sum(F.col("c")["end"] - F.col("c")["start"]).alias("characters"))


_resolved = f"""
    with recursive cand as (
        select *, row_number() over (partition by id order by start_pos - end_pos, start_pos, rule_ord) as r from ({_cands}) as c),
    spans as (select id, list(struct_pack(s := start_pos, e := end_pos, c := category, v := value) order by r) as xs from cand group by id),
    walk(id, xs, n, kept) as (
        select id, xs, 0, xs[1:0] from spans
        union all
        select id, xs, n + 1, case when len(list_filter(kept, lambda k: k.s < xs[n + 1].e and k.e > xs[n + 1].s)) = 0
                                   then list_append(kept, xs[n + 1]) else kept end
        from walk where n < len(xs)),
    done as (select id, unnest(kept) as k from walk where n = len(xs))"""


@query("resolve_overlaps", f"{_resolved} select id, k.s as start_pos, k.e as end_pos, k.c as category, k.v as value from done")
def resolve_overlaps_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two overlapping custom rules: longest match first, then the earliest, then rule order."""
    return as_items(item_table(detect(messages(spark, sf_dir), WORD_RULES), "id"), "id")


def _candidate_table(df: DataFrame) -> DataFrame:
    """Matches of the word rules as a table of spans, before overlaps are resolved."""
    found = df.withColumn("_found", candidates(F.coalesce("text", F.lit("")), WORD_RULES))
    return each(found, "_found", "id", name="c").select("id", "c.*")


@query("resolve_overlaps_table", f"{_resolved} select id, k.s as start_pos, k.e as end_pos, k.c as category, k.v as value from done")
def resolve_overlaps_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same resolution on a table of spans instead of arrays in rows."""
    return as_items(select_spans(_candidate_table(messages(spark, sf_dir)), "id"), "id")


@query("resolve_overlaps_joined", f"""{_resolved},
    sizes as (select doc_id, lang, sum(length(coalesce(text, '')) + 1) over (
        partition by lang order by doc_id rows between unbounded preceding and 1 preceding) as ahead from documents)
    select lang, k.s + coalesce(ahead, 0)::bigint as start_pos, k.e + coalesce(ahead, 0)::bigint as end_pos, k.c as category, k.v as value
    from done join sizes on done.id = 'd' || sizes.doc_id""")
def resolve_overlaps_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of a language as one text each: its spans are spread over tasks."""
    docs = table(spark, sf_dir, "documents")
    sized = docs.select("lang", "doc_id", F.length(F.coalesce("text", F.lit(""))).alias("size"))
    ahead = running_sum(sized, ["lang"], ["doc_id"], F.col("size") + 1, "behind").select(
        "lang", "doc_id", (F.col("behind") - F.col("size") - 1).alias("ahead"))
    # The offsets meet the documents, of which there are far fewer than spans.
    placed = lookup(docs.select("doc_id", "text"), ahead, ["doc_id"]).select(F.col("doc_id").alias("id"), "text", "lang", "ahead")
    found = each(placed.withColumn("_found", candidates(F.coalesce("text", F.lit("")), WORD_RULES)), "_found", "lang", "ahead", name="c").select("lang", "ahead", "c.*")
    moved = found.select("lang", *((F.col(c) + F.col("ahead")).alias(c) for c in ("start", "end")), "rule_ord", "rule_id", "category", "value")
    return as_items(select_spans(moved, "lang"), "lang")


@query("windows_joined", f"""
    with sizes as (select doc_id, doc_id // 50 as part, sum(length(coalesce(text, '')) + 1) over (
        partition by doc_id // 50 order by doc_id rows between unbounded preceding and 1 preceding) as ahead from documents)
    select part, start_pos + coalesce(ahead, 0)::bigint as start_pos, end_pos + coalesce(ahead, 0)::bigint as end_pos, category, value
    from ({_cands}) as c join sizes on c.id = 'd' || sizes.doc_id""")
def windows_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifty documents after the other as one text, scanned in windows with overlap: every match once, at its place."""
    docs = table(spark, sf_dir, "documents").select(F.expr("doc_id div 50").alias("part"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    joined = docs.groupBy("part").agg(F.array_join(F.array_sort(F.collect_list(F.struct("doc_id", "text")))["text"], "\n").alias("text"))
    return as_items(match_long(joined, "part", rules=WORD_RULES, width=1 << 15, margin=1 << 10), "part")


# Pairs of neighbouring long words, each pair a rule of its own: thousands of rules.
_pairs = """
    with lines as (select doc_id, unnest(string_split_regex(coalesce(text, ''), '[\\t\\n\\f\\r\\x0b]')) as line from documents),
    words as (select doc_id, string_split(line, ' ') as w from lines),
    pairs as (select doc_id, unnest(list_zip(w[:-2], w[2:])) as z from words),
    long_pairs as (select doc_id, z[1] || ' ' || z[2] as pair from pairs where z[1] <> z[2]
        and regexp_full_match(z[1], '[a-z]{7,}') and regexp_full_match(z[2], '[a-z]{7,}'))"""


def pair_rules(docs: DataFrame) -> DataFrame:
    """A rule for every pair of long words that stand beside each other in a line."""
    words = docs.select(F.explode(F.split(F.coalesce("text", F.lit("")), "[\\t\\n\\f\\r\\x0B]")).alias("line")).select(F.split("line", " ").alias("w"))
    pairs = words.where(F.size("w") > 1).select(F.explode(F.arrays_zip(F.expr("slice(w, 1, size(w) - 1)").alias("a"), F.expr("slice(w, 2, size(w) - 1)").alias("b"))).alias("z")).select("z.a", "z.b")
    chosen = pairs.where(F.col("a").rlike("^[a-z]{7,}$") & F.col("b").rlike("^[a-z]{7,}$") & (F.col("a") != F.col("b"))).distinct()
    name = F.concat_ws(" ", "a", "b")
    return numbered_rows(chosen.withColumn("_all", F.lit(0)), ["_all"], ["a", "b"], "n").select(
        F.col("n").cast("int").alias("rule_ord"), name.alias("id"), name.alias("name"), F.lit("word pair").alias("category"), F.lit("custom").alias("source"),
        F.concat(F.lit(r"(?<!\S)"), "a", F.lit(" "), "b", F.lit(r"(?!\S)")).alias("regex"), F.lit("").alias("example"), F.lit(True).alias("enabled"),
        F.lit(None).cast(RETENTION).alias("retention"))


@query("many_rules", f"{_pairs} select pair as rule_id, count(*) as matches, count(distinct doc_id) as documents from long_pairs group by pair")
def many_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thousands of rules in one call: texts meet only the rules of the grams that they hold."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = match_many(spread(docs), pair_rules(docs), "doc_id")
    return found.groupBy("rule_id").agg(F.count(F.lit(1)).alias("matches"), F.countDistinct("doc_id").alias("documents"))


@query("match_everywhere", f"""
    select id, i - 1 as start_pos, substr(text, i, 5) as value,
           case when i <= 3 then substr(text, 1, i - 1) else substr(text, i - 3, 3) end as before
    from (select id, text, unnest(range(1, length(text) - 3)) as i from {derived_sql('card_lines')} as l) as p
    where regexp_matches(substr(text, i, 5), '^[0-9]{{5}}$')""")
def match_everywhere(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The match at every position where one begins, with the characters in front."""
    lines = derived(spark, sf_dir, "card_lines").select("id", "text")
    return each(lines, find_everywhere(fenced(F.col("text")), ("", r"\d{5}")), "id", name="m").select(
        "id", F.col("m")["start"].cast("long").alias("start_pos"), F.col("m")["value"].alias("value"),
        F.col("m")["before"].alias("before"))


_fives = f"""
    select id, i - 1 as start_pos, substr(text, i, 5) as value, cast(substr(text, i, 5) as int) % 3 = 0 as ok
    from (select id, text, unnest(range(1, length(text) - 3)) as i from {derived_sql('card_lines')} as l) as p
    where regexp_matches(substr(text, i, 5), '^[0-9]{{5}}$')"""


@query("scan_resume", o.items_sql(o.walk_sql(_fives), "識別碼"))
def scan_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A checked rule: behind a refused match the scan goes on two characters later."""
    from dataclasses import replace

    third = lambda value, before: F.when(value.cast("int") % 3 == 0, F.length(value)).otherwise(0)
    rule = replace(custom_rule("c-third", "thirds", "識別碼", r"\d{5}"), check=third)
    lines = derived(spark, sf_dir, "card_lines").select("id", "text")
    return as_items(find(lines, rule, "id").withColumn("category", F.lit(rule.category)), "id")


@query("validate_numbers", f"""
    select id, {o.luhn_ok('card')} and regexp_matches({o.digits('card')}, '^4') as card_ok, {o.tax_id_ok('tax')} as tax_ok,
           not regexp_matches(ssn, '^(000|666|9)') and substr(ssn, 4, 2) <> '00' and substr(ssn, 6, 4) <> '0000' as ssn_ok
    from (select o_orderkey as id, lpad(cast(o_orderkey * 104729 % 100000000 as string), 8, '0') as tax,
                 lpad(cast(o_orderkey * 7127 % 1000000000 as string), 9, '0') as ssn,
                 '4' || lpad(cast(o_orderkey * 611953 as string), 15, '0') as card from orders) as x""")
def validate_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Check digits and ranges of numbers computed from order keys."""
    key = F.col("o_orderkey")
    lined = table(spark, sf_dir, "orders").select(
        key.alias("id"), F.lpad((key * 104729 % 100000000).cast("string"), 8, "0").alias("tax"),
        F.lpad((key * 7127 % 1000000000).cast("string"), 9, "0").alias("ssn"),
        F.concat(F.lit("4"), F.lpad((key * 611953).cast("string"), 15, "0")).alias("card"))
    return lined.select("id", checks.is_card(F.col("card")).alias("card_ok"), checks.is_tax_id(F.col("tax")).alias("tax_ok"),
                        checks.is_ssn(F.col("ssn")).alias("ssn_ok"))


@query("marker_precheck", f"""
    select id, regexp_matches(text, '\\[[^\\[\\]:]{{1,10}}:[0-9a-f]{{6}}\\]') as has_marker
    from (select event_id as id, case event_id % 3 when 0 then 'see [姓名:' || substr(md5(cast(event_id as string)), 1, 6) || '] there'
          when 1 then '[x:' || cast(event_id as string) || ']' else props end as text from events) as e""")
def marker_precheck(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source texts that already hold something that looks like a marker."""
    eid = F.col("event_id").cast("string")
    text = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("see [姓名:"), F.substring(F.md5(eid), 1, 6), F.lit("] there"))).when(
        F.col("event_id") % 3 == 1, F.concat(F.lit("[x:"), eid, F.lit("]"))).otherwise(F.col("props"))
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), has_markers(text).alias("has_marker"))


_fixed = "translate(t, 'OoDQIli|ZzSsGBgq', '0000111122556899')"


@query("fix_lookalikes", f"""
    select id, 'mobile ' || case when regexp_matches(t, '[A-Za-z|]') and regexp_matches({_fixed}, '^09[0-9]{{8}}$')
             and length({o.digits('t')}) >= length(t) * 0.6 then {_fixed} else t end || ' ok' as text
    from (select c_custkey as id, case c_custkey % 3 when 0 then '0g' || substr(m8, 1, 5) || 'lO' || substr(m8, 8, 1)
               when 1 then '09' || m8 else 'ODQIlZSG' || substr(m8, 1, 2) end as t
          from (select c_custkey, lpad(cast(c_custkey * 7919 % 100000000 as string), 8, '0') as m8 from customer) as a) as b""")
def fix_lookalikes_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letters read in place of digits, repaired where that gives a valid number."""
    key = F.col("c_custkey")
    m8 = F.lpad((key * 7919 % 100000000).cast("string"), 8, "0")
    token = F.when(key % 3 == 0, F.concat(F.lit("0g"), F.substring(m8, 1, 5), F.lit("lO"), F.substring(m8, 8, 1))).when(
        key % 3 == 1, F.concat(F.lit("09"), m8)).otherwise(F.concat(F.lit("ODQIlZSG"), F.substring(m8, 1, 2)))
    lines = table(spark, sf_dir, "customer").select(key.alias("id"), F.concat(F.lit("mobile "), token, F.lit(" ok")).alias("text"))
    return lines.select("id", fix_lookalikes(F.col("text")).alias("text"))
