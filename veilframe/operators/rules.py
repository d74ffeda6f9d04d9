"""Detection rules: the built-in set, custom rules and operations on rule tables."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.functions import checks
from veilframe.functions import fixed_values as fv
from veilframe.functions.retention import NONE, RETENTION, Retention

RULES_SCHEMA = (
    "rule_ord int, id string, name string, category string, source string, regex string, "
    f"example string, enabled boolean, retention {RETENTION}"
)
# Rules become expressions of one projection, so their number is bounded.
MAX_RULES = 1000

Check = Callable[[Column, Column], Column]


@dataclass(frozen=True)
class Rule:
    """One regex with a category.

    ``check(value, before)`` returns a Column with the valid leading length.
    ``label`` must stand right in front of a match but is not part of it;
    ``more`` lists further (label, regex) forms of the same rule. ``gate``,
    ``needs`` and ``hint`` only save work: every text with a match has a
    ``digit`` / a ``han`` character, contains one of the substrings ``needs``
    and matches the regex ``hint``. Gates are tested once for all rules.
    """

    id: str
    name: str
    category: str
    regex: str
    example: str = ""
    enabled: bool = True
    source: str = "custom"
    group: str = "custom"
    retention: Retention = NONE
    check: Check | None = None
    hint: str | None = None
    label: str = ""
    more: tuple[tuple[str, str], ...] = ()
    needs: tuple[str, ...] = ()
    gate: str | None = None

    @property
    def forms(self) -> list[tuple[str, str]]:
        return [(self.label, self.regex), *self.more]

    @property
    def checked(self) -> bool:
        return self.check is not None or bool(self.label) or bool(self.more)

    def verdict(self, value: Column, before: Column) -> Column:
        return F.length(value) if self.check is None else self.check(value, before)


HAN = f"[{fv.CJK}]"

BUILTIN_RULES: list[Rule] = [
    Rule("zh-name", "中文姓名", "姓名", fv.NAME, "王小明、歐陽志遠", group="tw", source="builtin", gate="han",
         check=checks.name),
    Rule("tw-id", "台灣身分證字號", "身分證", fv.TW_ID, "A123456789", group="tw", source="builtin", gate="digit",
         check=checks.tw_id, hint=r"[A-Z][12]\d{8}"),
    # In front of the landline: a labelled SSN of nine bare digits also reads as a landline.
    Rule("us-ssn", "美國社會安全碼（SSN）", "SSN", fv.SSN, "123-45-6789、SSN: 123456789", group="intl",
         source="builtin", gate="digit", check=checks.ssn, hint=r"\d{3}[- ]?\d{2}[- ]?\d{4}",
         more=((fv.SSN_LABEL, fv.SSN_BARE),)),
    Rule("tw-mobile", "手機號碼", "手機", fv.MOBILE, "0912-345-678、0912345678、+886-912-345-678", group="tw",
         source="builtin", gate="digit", hint=r"\d{3}[- ]?\d{3}"),
    Rule("tw-landline", "市話號碼", "市話", fv.LANDLINE,
         "(02)2712-3456、02-27123456、0227123456、037-123456、+886-2-2712-3456", group="tw", source="builtin", gate="digit",
         hint=r"\d{3}[- ]?\d{3}"),
    Rule("tw-address", "台灣地址", "地址", fv.ADDRESS, "台北市信義區市府路45號8樓", group="tw", source="builtin", gate="han",
         needs=("號",)),
    Rule("tw-company", "公司／組織名稱", "公司", fv.COMPANY, "築夢實業股份有限公司、大安聯合診所", group="tw",
         source="builtin", gate="han"),
    Rule("tw-tax-id", "統一編號", "統編", fv.TAX_ID, "統一編號 04595257", group="tw", source="builtin", gate="digit",
         check=checks.tax_id, hint=r"\d{8}"),
    Rule("email", "電子郵件", "電子郵件", fv.EMAIL, "someone@example.com", group="intl", source="builtin", needs=("@",)),
    # Behind the Taiwanese rules, which keep the +886 numbers both match.
    Rule("intl-phone", "國際電話", "國際電話", fv.INTL_PHONE, "+1 (415) 867-5309、+44 20 7946 0958、(416) 967-1111",
         group="intl", source="builtin", gate="digit", check=checks.phone, hint=r"\+[1-9]|\d{3}\)?[-.\x20]?\d{3}[-.\x20]\d{4}"),
    Rule("credit-card", "信用卡號", "信用卡", fv.CARD, "4242 4242 4242 4242、3782 822463 10005", group="intl",
         source="builtin", gate="digit", check=checks.card, hint=r"\d(?:[\x20-]?\d){12}"),
    Rule("iban", "IBAN 國際銀行帳號", "IBAN", fv.IBAN, "GB82 WEST 1234 5698 7654 32、DE89370400440532013000",
         group="intl", source="builtin", gate="digit", check=checks.iban, hint=r"[A-Z]{2}\d{2}\x20?[A-Z0-9]{4}"),
    Rule("ipv4", "IPv4 位址", "IP", fv.IPV4, "192.168.1.10", group="intl", source="builtin", gate="digit",
         hint=r"\d\.\d{1,3}\.\d{1,3}\.\d"),
    Rule("ipv6", "IPv6 位址", "IP", fv.IPV6, "2001:db8::1", group="intl", source="builtin", check=checks.ipv6,
         hint=r":[0-9A-Fa-f]{0,4}:[0-9A-Fa-f:]"),
    Rule("dob", "出生日期", "生日", fv.BIRTH_DATE,
         "DOB: 1985-03-14、Date of Birth: March 14, 1985、出生日期：民國 80 年 5 月 1 日", group="intl",
         source="builtin", gate="digit", check=checks.birth_date, hint=rf"\d(?:st|nd|rd|th)?,?[-/.年\x20]|\d{fv.WS}*年",
         needs=("DOB", "D.O.B", "irth", "orn", "生"), label=fv.BIRTH_LABEL),
]


def builtin_rules(*ids: str) -> list[Rule]:
    """All built-in rules, or those named, in rule order."""
    return [r for r in BUILTIN_RULES if not ids or r.id in ids]


def custom_rule(id: str, name: str, category: str, regex: str, example: str = "", enabled: bool = True,
                retention: Retention = NONE) -> Rule:
    """A user's own rule; ``regex`` is Java syntax, as everywhere in Spark."""
    return Rule(id, name, category, regex, example, enabled, retention=retention)


def rules_table(spark: SparkSession, rules: Iterable[Rule] | None = None) -> DataFrame:
    """Rules as a DataFrame (``RULES_SCHEMA``)."""
    rows = [
        (n, r.id, r.name, r.category, r.source, r.regex, r.example, r.enabled,
         (r.retention.mode, r.retention.head, r.retention.tail, r.retention.delimiter, r.retention.side))
        for n, r in enumerate(BUILTIN_RULES if rules is None else rules)
    ]
    return spark.createDataFrame(rows, RULES_SCHEMA)


def rules_from_table(table: DataFrame) -> list[Rule]:
    """Rule rows back as rules, in order; built-in ids get their checks back.

    These rules have to fit into one projection, so more than ``MAX_RULES`` rows
    are refused instead of collected; ``many_rules`` takes larger tables.
    """
    rows = table.orderBy("rule_ord").limit(MAX_RULES + 1).collect()
    if len(rows) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules for one projection; detect_many takes tables of any size")
    known = {r.id: r for r in BUILTIN_RULES}
    out = []
    for row in rows:
        kept = Retention(**row["retention"].asDict()) if row["retention"] is not None else NONE
        if row["source"] == "builtin" and row["id"] in known:
            out.append(replace(known[row["id"]], enabled=row["enabled"], retention=kept))
        else:
            out.append(custom_rule(row["id"], row["name"], row["category"], row["regex"], row["example"] or "",
                                   row["enabled"], kept))
    return out


def enabled_only(table: DataFrame) -> DataFrame:
    return table.where("enabled")


def with_builtins_disabled(table: DataFrame, disabled: DataFrame) -> DataFrame:
    """Switch off the built-in rules whose ``id`` is listed in ``disabled``."""
    off = disabled.select("id").distinct().withColumn("off", F.lit(True))
    switched = F.when(F.col("source") == "builtin", F.col("off").isNull()).otherwise(F.col("enabled"))
    return table.join(off, "id", "left").withColumn("enabled", switched).select(*table.columns)


def regex_problem(spark: SparkSession, regex: str) -> str | None:
    """Why a regex cannot be a rule (``blank``, ``invalid``, ``matches_empty``), or None."""
    if not regex.strip():
        return "blank"
    try:
        empty_hit = spark.range(1).select(F.regexp_like(F.lit(""), F.lit(regex)).alias("hit")).first()["hit"]
    except Exception as e:  # the pattern is compiled by Java inside Spark
        if "pattern" in str(e).lower() or "regex" in str(e).lower():
            return "invalid"
        raise
    return "matches_empty" if empty_hit else None


def with_custom(table: DataFrame, customs: DataFrame) -> DataFrame:
    """Insert or replace custom rules by id; replaced rules keep their place."""
    old = table.where(F.col("source") == "custom").select("id", F.col("rule_ord").alias("old_ord"))
    top = table.agg(F.max("rule_ord").alias("top")).select(F.coalesce("top", F.lit(-1)).alias("top")).scalar()
    placed = customs.join(old, "id", "left")
    newcomer = F.when(F.col("old_ord").isNull(), F.col("rule_ord"))
    fresh = placed.withColumn("rule_ord", F.coalesce("old_ord", (top + 1 + newcomer).cast("int"))).select(*table.columns)
    stays = table.join(customs.select("id").withColumn("source", F.lit("custom")), ["id", "source"], "left_anti")
    return stays.select(*table.columns).unionByName(fresh)


def without_custom(table: DataFrame, ids: DataFrame) -> DataFrame:
    """Remove custom rules (with their retention) by id."""
    gone = ids.select("id").withColumn("source", F.lit("custom"))
    return table.join(gone, ["id", "source"], "left_anti").select(*table.columns)


def with_retention(table: DataFrame, retention: Retention, *, category: str | None = None,
                   rule_id: str | None = None) -> DataFrame:
    """Give one retention to a rule or to every rule of a category; ``none`` clears it."""
    hit = F.lit(True)
    if category is not None:
        hit = hit & (F.col("category") == category)
    if rule_id is not None:
        hit = hit & (F.col("id") == rule_id)
    value = F.lit(None).cast(RETENTION) if retention.mode == "none" else retention.column()
    return table.withColumn("retention", F.when(hit, value).otherwise(F.col("retention")))


def new_rule_id() -> Column:
    """A random id for a custom rule."""
    return F.concat(F.lit("c-"), F.substring(F.replace(F.uuid(), F.lit("-"), F.lit("")), 1, 6))


def rules_fingerprint(table: DataFrame) -> DataFrame:
    """One hash over the enabled rules; a change means that texts must be scanned again."""
    part = F.struct("rule_ord", "id", "category", "regex")
    listed = F.to_json(F.array_sort(F.collect_list(part)))
    return enabled_only(table).agg(F.sha2(listed, 256).alias("fingerprint"))
