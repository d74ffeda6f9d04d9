"""Inputs derived from the given tables, as SQL that Spark and DuckDB both run.

The tables hold no Chinese text, national IDs, IBANs and the like, so lines
with such values are computed from keys, with about every fifth check digit
broken. Placeholders in braces are table names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veilframe.session import spread

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, read by all cores also where they lie in one file."""
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


def _digit(s: str, i: int) -> str:
    return f"cast(substr({s}, {i}, 1) as int)"


def _doubled(s: str, i: int) -> str:
    """A digit doubled, digits of the product summed."""
    return f"cast(substr('0246813579', {_digit(s, i)} + 1, 1) as int)"


_luhn = " + ".join(_doubled("p", i) if i % 2 == 1 else _digit("p", i) for i in range(1, 16))
_tw = " + ".join(f"{_digit('b', i)} * {9 - i}" for i in range(1, 9))
# Taiwan tax ID: weights 1,2,1,2,1,2,4,1; a doubled digit of two digits is summed,
# four times a digit likewise.
_tax = " + ".join(
    {1: _digit("h", i), 2: _doubled("h", i),
     4: f"(cast(floor({_digit('h', i)} * 4 / 10) as int) + ({_digit('h', i)} * 4) % 10)"}[w]
    for i, w in enumerate((1, 2, 1, 2, 1, 2, 4), start=1))


def _pick(values: list[str], expr: str) -> str:
    """The value at ``expr`` (from 0) of a fixed list."""
    cases = " ".join(f"when {n} then '{v}'" for n, v in enumerate(values))
    return f"case ({expr}) % {len(values)} {cases} end"


SQL = {
    # Visa-like numbers in three printed forms.
    "card_lines": f"""
        select id, 'Card ' || case id % 3
            when 0 then n
            when 1 then substr(n, 1, 4) || ' ' || substr(n, 5, 4) || ' ' || substr(n, 9, 4) || ' ' || substr(n, 13, 4)
            else substr(n, 1, 4) || '-' || substr(n, 5, 4) || '-' || substr(n, 9, 4) || '-' || substr(n, 13, 4) end
          || ' on file, ref ' || cast(id as string) || '.' as text
        from (select id, p || cast((10 - s % 10 + case when id % 5 = 0 then 1 else 0 end) % 10 as string) as n
              from (select id, p, {_luhn} as s
                    from (select o_orderkey as id, '4' || lpad(cast(o_orderkey * 7919 as string), 14, '0') as p
                          from {{orders}}) a) b) c""",
    "tw_id_lines": f"""
        select id, '客戶 ' || substr('ABCDEFGHJKLMNPQRSTUVXYWZIO', l + 1, 1) || b
          || cast((100 - (floor((l + 10) / 10) + (l % 10) * 9 + {_tw}) % 10
                   + case when id % 5 = 0 then 1 else 0 end) % 10 as int) || ' 已核對' as text
        from (select c_custkey as id, cast(c_custkey % 26 as int) as l,
                     cast(c_custkey % 2 + 1 as string) || lpad(cast(c_custkey * 7919 % 10000000 as string), 7, '0') as b
              from {{customer}}) a""",
    "tax_id_lines": f"""
        select id, '統一編號 ' || h || cast((5 - s % 5 + case when id % 5 = 0 then 1 else 0 end) % 5 as int)
          || case when id % 4 = 0 then '-1' else '' end || '。' as text
        from (select id, h, {_tax} as s
              from (select p_partkey as id, lpad(cast(p_partkey * 7919 % 10000000 as string), 7, '0') as h
                    from {{part}}) a) b""",
    "iban_lines": """
        select id, 'Pay to GB' || lpad(cast((98 - r + case when id % 5 = 0 then 1 else 0 end) % 100 as string), 2, '0')
          || case when id % 2 = 0 then 'WEST' || acc
             else ' WEST ' || substr(acc, 1, 4) || ' ' || substr(acc, 5, 4) || ' ' || substr(acc, 9, 4) || ' ' || substr(acc, 13, 2) end
          || ' by Friday.' as text
        from (select id, acc,
                -- W E S T = 32 14 28 29, G B = 16 11; the remainder is taken piece by piece
                cast((((32142829 % 97) * 10000000 + cast(substr(acc, 1, 7) as bigint)) % 97 * 10000000
                  + cast(substr(acc, 8, 7) as bigint)) % 97 * 1000000 + 161100 as bigint) % 97 as r
              from (select c_custkey as id, lpad(cast(c_custkey * 7919 as string), 14, '0') as acc from {customer}) a) b""",
    "ssn_lines": """
        select event_id as id, 'Person ' || lpad(cast(event_id * 37 % 1000 as string), 3, '0')
          || case event_id % 3 when 0 then '-' when 1 then ' ' else '' end
          || lpad(cast(event_id * 13 % 100 as string), 2, '0')
          || case event_id % 3 when 0 then '-' when 1 then ' ' else '' end
          || lpad(cast(event_id * 101 % 10000 as string), 4, '0') || ' seen; SSN: '
          || lpad(cast(event_id * 91 % 1000000000 as string), 9, '0') || '.' as text
        from {events}""",
    "ipv6_lines": """
        select event_id as id, 'peer ' || case event_id % 5
            when 0 then '2001:db8::' || cast(event_id % 9999 + 1 as string)
            when 1 then '2001:db8:0:1:2:3:4:' || cast(event_id % 9999 + 1 as string)
            when 2 then 'fe80::1ff:fe23:4567:' || cast(event_id % 9999 + 1 as string)
            when 3 then '00:1A:2B:3C:4D:5E'
            else '12:30:' || lpad(cast(event_id % 60 as string), 2, '0') end || ' at port 80' as text
        from {events}""",
    "dob_lines": """
        select o_orderkey as id,
          case o_orderkey % 4 when 0 then 'DOB: ' when 1 then 'Date of Birth ' when 2 then 'Invoice Date ' else '出生日期：' end
          || substr(cast(o_orderdate as string), 1, 4) || '-'
          || case when o_orderkey % 7 = 0 then '13' else substr(cast(o_orderdate as string), 6, 2) end || '-'
          || substr(cast(o_orderdate as string), 9, 2) || ' end' as text
        from {orders}""",
    # Phone numbers of several countries; every seventh has a calling code that is not assigned.
    "phone_lines": f"""
        select id, 'Call ' || p || ' today' as text from (
          select c_custkey as id, '+' || {_pick(['234', '98', '212', '254', '380', '48', '999'], 'c_custkey')} || ' 7' || substr(m8, 1, 2) || ' '
            || substr(m8, 3, 3) || ' ' || substr(m8, 6, 3) as p
          from (select c_custkey, lpad(cast(c_custkey * 7919 % 100000000 as string), 8, '0') as m8 from {{customer}}) a) b""",
    # Whole web pages, tags and scripts included.
    "page_lines": "select page_id as id, html as text from {pages}",
    # Private-use characters around and inside values.
    "private_use_lines": f"""
        select c_custkey as id, '{chr(0xE000)}ID-{chr(0xE001)}' || cast(c_custkey as string) || '{chr(0xE002)} user' || cast(c_custkey as string)
          || '@x.tw{chr(0xE003)}' as text from {{customer}}""",
    # A Chinese customer record: name, mobile, landline, address, company.
    "record_lines": f"""
        select c_custkey as id, '客戶：' || nm || '先生，手機 ' || mob || '，電話 ' || tel || '。地址：' || addr || '；任職「' || comp || '」。' as text,
          nm, mob, tel, addr, comp
        from (select c_custkey,
          {_pick(list('陳林黃張李王吳劉蔡楊許鄭謝'), 'c_custkey')} || {_pick(list('志雅怡俊淑佳冠'), 'cast(floor(c_custkey / 13) as bigint)')}
            || {_pick(list('明婷豪芬玲宇蓉'), 'cast(floor(c_custkey / 91) as bigint)')} as nm,
          case c_custkey % 3 when 0 then '09' || substr(m8, 1, 2) || '-' || substr(m8, 3, 3) || '-' || substr(m8, 6, 3)
            when 1 then '09' || m8 else '+886-9' || substr(m8, 1, 2) || '-' || substr(m8, 3, 3) || '-' || substr(m8, 6, 3) end as mob,
          case c_custkey % 2 when 0 then '(02)' || '2' || substr(m8, 1, 3) || '-' || substr(m8, 5, 4)
            else '037-' || substr(m8, 1, 6) end as tel,
          {_pick(['台北市信義區', '新北市板橋區', '臺中市西屯區', '高雄市苓雅區'], 'c_custkey')}
            || {_pick(['市府路', '文化路', '中山路'], 'cast(floor(c_custkey / 4) as bigint)')}
            || cast(c_custkey % 400 + 1 as string) || '號' || case when c_custkey % 2 = 0 then '8樓' else '' end as addr,
          {_pick(['築夢', '嘉宏', '永豐', '大安', '瑞祥'], 'c_custkey')} || {_pick(['實業', '資訊', '貿易'], 'cast(floor(c_custkey / 5) as bigint)')}
            || {_pick(['股份有限公司', '有限公司', '基金會'], 'cast(floor(c_custkey / 15) as bigint)')} as comp
          from (select c_custkey, lpad(cast(c_custkey * 7919 % 100000000 as string), 8, '0') as m8 from {{customer}}) a) b""",
}


def derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived input as a DataFrame."""
    sql = SQL[name]
    used = {t: table(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in sql}
    return spread(spark.sql(sql, **used))


def derived_sql(name: str) -> str:
    """A derived input as a DuckDB sub-select."""
    return "(" + SQL[name].format(**{t: t for t in TABLES}) + ")"
