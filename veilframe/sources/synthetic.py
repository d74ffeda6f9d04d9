"""Fictional but well-formed sensitive values, drawn from a row key.

Values depend on (key, seed) only, so any number of rows can be made in
parallel and again. For fixtures and load tests.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.functions import fixed_values as fv
from veilframe.functions.text import let

SURNAMES = list("陳林黃張李王吳劉蔡楊許鄭謝郭洪邱曾廖賴徐")
GIVEN_FIRST = list("志雅怡俊淑佳冠宜建美家柏詩承思")
GIVEN_SECOND = list("明婷君豪芬玲宇蓉宏惠安翰涵恩瑜")
PLACES = ["台北市信義區", "新北市板橋區", "桃園市中壢區", "臺中市西屯區", "臺南市東區", "高雄市苓雅區", "新竹市北區", "嘉義市西區"]
ROADS = ["中正路", "民生路", "文化路", "市府路", "中山路", "復興街", "和平街", "自由大道"]
COMPANY_FIRST = ["築夢", "嘉宏", "永豐", "大安", "瑞祥", "日昇"]
COMPANY_SECOND = ["實業", "資訊", "企業", "貿易", "建設"]
COMPANY_LAST = ["股份有限公司", "有限公司", "事務所", "基金會"]
DOMAINS = ["example.com", "example.org", "mail.example.net"]


class Fake:
    """Column expressions for one row key; ``salt`` keeps the draws of a row apart."""

    def __init__(self, key: Column, seed: int = 1):
        self.key, self.seed = key, seed

    def number(self, salt: str, low: int, high: int) -> Column:
        draw = F.xxhash64(self.key, F.lit(self.seed), F.lit(salt))
        return (F.lit(low) + F.pmod(draw, F.lit(high - low + 1))).cast("int")

    def pick(self, salt: str, values: list[str]) -> Column:
        return F.element_at(F.array(*map(F.lit, values)), self.number(salt, 1, len(values)))

    def digits(self, salt: str, n: int) -> Column:
        draw = F.pmod(F.xxhash64(self.key, F.lit(self.seed), F.lit(salt)), F.lit(10 ** n))
        return F.lpad(draw.cast("string"), n, "0")

    def name(self) -> Column:
        surname = F.when(self.number("compound", 1, 25) == 1, self.pick("cs", fv.COMPOUND_SURNAMES)).otherwise(
            self.pick("s", SURNAMES))
        second = F.when(self.number("two", 1, 10) <= 9, self.pick("g2", GIVEN_SECOND)).otherwise("")
        return F.concat(surname, self.pick("g1", GIVEN_FIRST), second)

    def tw_id(self) -> Column:
        n = self.number("letter", 0, 25)
        body = F.concat(self.number("sex", 1, 2).cast("string"), self.digits("id", 7))

        def full(b: Column) -> Column:
            total = F.floor((n + 10) / 10) + (n % 10) * 9
            for i in range(8):
                total = total + F.substring(b, i + 1, 1).cast("int") * (8 - i)
            return F.concat(F.substring(F.lit(fv.TW_ID_LETTERS), n + 1, F.lit(1)), b, F.pmod(-total, F.lit(10)).cast("string"))

        return let(body, full)

    def tax_id(self) -> Column:
        def full(head: Column) -> Column:
            total = F.lit(0)
            for i, w in enumerate((1, 2, 1, 2, 1, 2, 4), start=1):
                p = F.substring(head, i, 1).cast("int") * w
                total = total + F.floor(p / 10) + p % 10
            return F.concat(head, F.pmod(-total, F.lit(5)).cast("string"))

        return let(self.digits("tax", 7), full)

    def mobile(self) -> Column:
        style = self.number("mstyle", 1, 10)
        d = F.concat(F.lit("09"), self.digits("mobile", 8))
        cut = lambda sep: F.concat(F.left(d, F.lit(4)), F.lit(sep), F.substring(d, 5, 3), F.lit(sep), F.right(d, F.lit(3)))
        return F.when(style <= 5, cut("-")).when(style <= 8, d).otherwise(cut(" "))

    def landline(self) -> Column:
        area = self.pick("area", ["02", "03", "04", "05", "06", "07", "037", "049"])
        local = F.when(area == "02", self.digits("local8", 8)).otherwise(self.digits("local7", 7))
        style = self.number("lstyle", 1, 10)
        split = F.concat(F.left(local, F.lit(4)), F.lit("-"), F.substring(local, 5, 8))
        return F.when(style <= 4, F.concat(F.lit("("), area, F.lit(")"), split)).when(
            style <= 8, F.concat(area, F.lit("-"), split)).otherwise(F.concat(area, F.lit("-"), local))

    def address(self) -> Column:
        lane = F.when(self.number("lane?", 1, 10) <= 4, F.concat(self.number("lane", 1, 300).cast("string"), F.lit("巷"))).otherwise("")
        floor = F.when(self.number("floor?", 1, 2) == 1, F.concat(self.number("floor", 1, 20).cast("string"), F.lit("樓"))).otherwise("")
        return F.concat(self.pick("place", PLACES), self.pick("road", ROADS), lane,
                        self.number("house", 1, 500).cast("string"), F.lit("號"), floor)

    def company(self) -> Column:
        return F.concat(self.pick("c1", COMPANY_FIRST), self.pick("c2", COMPANY_SECOND), self.pick("c3", COMPANY_LAST))

    def email(self) -> Column:
        return F.concat(F.lit("user"), self.digits("user", 5), F.lit("@"), self.pick("domain", DOMAINS))

    def date(self, first_year: int, last_year: int) -> Column:
        two = lambda salt, high: F.lpad(self.number(salt, 1, high).cast("string"), 2, "0")
        return F.concat_ws("-", self.number("year", first_year, last_year).cast("string"), two("month", 12), two("day", 28))

    def bank_account(self) -> Column:
        bank = self.pick("bank", ["004", "005", "007", "012", "013", "017", "822"])
        return F.concat_ws("-", bank, self.digits("acc4", 4), self.digits("acc6", 6), self.digits("acc2", 2))


def people(spark: SparkSession, rows: int, seed: int = 1) -> DataFrame:
    """Fictional people, one per row of ``range(rows)``."""
    return with_people(spark.range(rows), "id", seed)


def with_people(table: DataFrame, key: str, seed: int = 1) -> DataFrame:
    """Fictional people for the keys of a table."""
    f = Fake(F.col(key), seed)
    return table.select(
        key, f.name().alias("name"), f.tw_id().alias("tw_id"), f.mobile().alias("mobile"),
        f.landline().alias("landline"), f.address().alias("address"), f.email().alias("email"),
        f.company().alias("company"), f.tax_id().alias("tax_id"), f.date(1955, 2002).alias("birthday"),
        f.bank_account().alias("account"))
