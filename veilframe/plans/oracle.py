"""SQL building blocks of the DuckDB cross-checks.

RE2 has no look-around, so the checks match runs of a rule's boundary class or
whole tokens, and recompute check digits with list functions.
"""

from __future__ import annotations

OPEN, SHUT = "chr(57344)", "chr(57345)"
DOCS = "(select 'd' || doc_id as id, text from documents union all select 'c' || conv_id || '/' || turn, text from conversations)"


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def find_sql(source: str, regex: str, key: str = "id", text: str = "text") -> str:
    """All leftmost matches of a regex with their positions: (key, start_pos, value)."""
    r = quote(f"({regex})")
    return f"""
        select {key}, cast(coalesce(list_sum(list_transform(p[1:i - 1], lambda x: length(replace(x, {SHUT}, '')))), 0) as bigint)
                 as start_pos, split_part(p[i], {SHUT}, 1) as value
        from (select {key}, p, unnest(range(2, len(p) + 1)) as i
              from (select {key}, string_split(regexp_replace({text}, {r}, {OPEN} || '\\1' || {SHUT}, 'g'), {OPEN}) as p
                    from {source} as src where regexp_matches({text}, {r})) as cut) as one"""


def items_sql(found: str, category: str, key: str = "id", value: str = "value", where: str = "true") -> str:
    """Matches as items: (key, start_pos, end_pos, category, value)."""
    return f"""
        select {key}, start_pos, start_pos + length(v) as end_pos, '{category}' as category, v as value
        from (select {key}, start_pos, {value} as v from ({found}) as f) as g where {where}"""


def walk_sql(hits: str) -> str:
    """Hits (id, start_pos, value, ok) read left to right; behind a refused one reading goes on two further."""
    return f"""
        with recursive seq as (
            select id, list(struct_pack(s := start_pos, v := value, ok := ok) order by start_pos) as xs from ({hits}) as h group by id),
        walk(id, xs, n, resume, kept) as (
            select id, xs, 0, cast(0 as bigint), xs[1:0] from seq
            union all
            select id, xs, n + 1,
                   cast(case when xs[n + 1].s < resume then resume when xs[n + 1].ok then xs[n + 1].s + length(xs[n + 1].v)
                        else xs[n + 1].s + least(2, length(xs[n + 1].v)) end as bigint),
                   case when xs[n + 1].s >= resume and xs[n + 1].ok then list_append(kept, xs[n + 1]) else kept end
            from walk where n < len(xs))
        select id, k.s as start_pos, k.v as value from (select id, unnest(kept) as k from walk where n = len(xs)) as done"""


def digits(x: str) -> str:
    return f"regexp_replace({x}, '[^0-9]', '', 'g')"


def luhn_ok(x: str) -> str:
    d = digits(x)
    step = (f"case when (length({d}) - k) % 2 = 0 then cast({d}[k] as int) "
            f"else case when cast({d}[k] as int) > 4 then cast({d}[k] as int) * 2 - 9 else cast({d}[k] as int) * 2 end end")
    return f"list_sum(list_transform(range(1, length({d}) + 1), lambda k: {step})) % 10 = 0"


def tw_id_ok(x: str) -> str:
    n = f"(strpos('ABCDEFGHJKLMNPQRSTUVXYWZIO', {x}[1]) + 9)"
    body = f"list_sum(list_transform(range(2, 10), lambda k: cast({x}[k] as int) * (10 - k)))"
    return f"({n} // 10 + {n} % 10 * 9 + {body} + cast({x}[10] as int)) % 10 = 0"


def tax_id_ok(x: str) -> str:
    total = (f"list_sum(list_transform(range(1, 9), lambda k: "
             f"(cast({x}[k] as int) * cast('12121241'[k] as int)) // 10 + (cast({x}[k] as int) * cast('12121241'[k] as int)) % 10))")
    return f"({total} % 5 = 0 or ({x}[7] = '7' and ({total} + 1) % 5 = 0))"


OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4 = f"(?:{OCTET}[.]){{3}}{OCTET}"
EMAIL = "[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]{2,}"


def email_items(source: str = DOCS, key: str = "id", text: str = "text") -> str:
    return items_sql(find_sql(source, EMAIL, key, text), "電子郵件", key)


def ipv4_items(source: str = DOCS, key: str = "id", text: str = "text") -> str:
    first = f"regexp_extract(value, '^({IPV4})(?:$|[.]$|[.][.])', 1)"
    return items_sql(find_sql(source, "[0-9.]+", key, text), "IP", key, first, "v <> ''")


def phone_items(area: str, source: str = DOCS, key: str = "id", text: str = "text") -> str:
    good = f"regexp_matches({digits('v')}, '^1?{area}[2-9][0-9]{{6}}$')"
    token = f"[+]1 [(][0-9]{{3}}[)] [0-9]{{3}}-[0-9]{{4}}"
    return items_sql(find_sql(source, token, key, text), "國際電話", key, "value", good)


def card_items(prefix: str, source: str = DOCS, key: str = "id", text: str = "text") -> str:
    """Card numbers: tried at every digit no digit or hyphen stands in front of."""
    shape = "[0-9]+|[0-9]{4} [0-9]{4} [0-9]{4} [0-9]{4}|[0-9]{4}-[0-9]{4}-[0-9]{4}-[0-9]{4}"
    good = (f"regexp_matches(value, '^(?:{shape})$') and regexp_matches({digits('value')}, {quote(prefix)}) and {luhn_ok('value')}")
    hits = f"""
        select id, start_pos, value, {good} as ok
        from (select {key} as id, i - 1 as start_pos,
                     regexp_extract(substr({text}, i, 40), '^([0-9](?:[ -]?[0-9]){{12,18}})(?:$|[^0-9-])', 1) as value
              from (select {key}, {text}, unnest(range(1, length({text}) + 1)) as i from {source} as src
                    where regexp_matches({text}, '[0-9](?:[ -]?[0-9]){{12}}')) as p
              where {text}[i] between '0' and '9' and (i = 1 or not regexp_matches({text}[i - 1], '[0-9-]'))) as h
        where value <> ''"""
    return items_sql(walk_sql(hits), "信用卡")


SECRET = "bench-secret"


def split_case(what: str) -> str:
    """head / tail of the standard split for the categories the messages hold."""
    if what == "head":
        return ("case category when '國際電話' then 3 when 'IP' then length(regexp_extract(value, '^([0-9]{1,3}[.]){2}')) "
                "else 0 end")
    return ("case category when '電子郵件' then length(value) - strpos(value, '@') + 1 when '信用卡' then 4 else 0 end")


def with_split(items: str, standard: bool) -> str:
    head, tail = (split_case("head"), split_case("tail")) if standard else ("0", "0")
    return f"select *, {head} as head, {tail} as tail from ({items}) as i"


def code_sql(scope: str, category: str = "category", head: str = "head", tail: str = "tail", value: str = "value",
             attempt: str = "0") -> str:
    parts = ", ".join(f"cast({x} as varchar)" for x in (scope, category, head, tail, value, attempt))
    return f"substr(sha256(concat_ws(chr(1), '{SECRET}', {parts})), 1, 6)"


def hidden(value: str = "value") -> str:
    return f"substr({value}, head + 1, length({value}) - head - tail)"


def kept(middle: str) -> str:
    return f"left(value, head) || {middle} || case when tail = 0 then '' else right(value, tail) end"


def splice_sql(items: str, replacement: str, docs: str = DOCS, into: str = "redacted") -> str:
    """Texts with every item (id, start_pos, end_pos, …) replaced."""
    return f"""
        with it as (select *, lag(end_pos, 1, 0) over (partition by id order by start_pos) as prev from ({items}) as i),
        agg as (select it.id, string_agg(substr(d.text, prev + 1, start_pos - prev) || {replacement}, '' order by start_pos) as head,
                       max(end_pos) as last from it join {docs} as d on d.id = it.id group by it.id)
        select d.id, case when a.id is null then d.text else a.head || substr(d.text, a.last + 1) end as {into}
        from {docs} as d left join agg as a on a.id = d.id"""


def message_items(area: str, prefix: str) -> str:
    """All items of the messages."""
    return " union all ".join(f"select * from ({q}) as u" for q in (
        email_items(), ipv4_items(), phone_items(area), card_items(prefix)))
