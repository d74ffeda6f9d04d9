"""Readable masks for showing a value on screen without giving it away."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilframe.functions import fixed_values as fv
from veilframe.functions.checks import digits_of
from veilframe.functions.retention import surname_length
from veilframe.functions.text import let


def keep_ends(value: Column, head: int, tail: int, fill: str = "*") -> Column:
    """First and last characters stay, the rest is filled; short values are filled whole."""
    size = F.length(value)
    return F.when(size <= head + tail, F.repeat(F.lit(fill), size)).otherwise(F.concat(
        F.left(value, F.lit(head)), F.repeat(F.lit(fill), size - head - tail), F.right(value, F.lit(tail))))


def mask_display(category: Column, value: Column) -> Column:
    size = F.length(value)
    name = let(surname_length(value), lambda n: F.when(
        size <= n, F.repeat(F.lit("O"), F.greatest(F.lit(2), size))).otherwise(
        F.concat(F.left(value, n), F.repeat(F.lit("O"), size - n))))
    mobile = let(F.regexp_replace(digits_of(value), F.lit("^886"), F.lit("0")), lambda d: F.when(
        F.length(d) == 10, F.concat(F.left(d, F.lit(4)), F.lit("-***-"), F.right(d, F.lit(3)))).otherwise(
        keep_ends(value, 4, 2)))
    landline = let(digits_of(value), lambda d: F.when(
        F.length(d) >= 8, F.concat(F.left(d, F.lit(2)), F.lit("-****-"), F.right(d, F.lit(2)))).otherwise(
        keep_ends(value, 2, 2)))
    address = let(F.regexp_extract(value, r"^(?:.*?[市縣])?(?:.*?[鄉鎮市區])?", 0), lambda p: F.when(
        (F.length(p) > 0) & (F.length(p) < size), F.concat(p, F.lit("***"))).otherwise(keep_ends(value, 3, 0)))
    mail = let(F.instr(value, "@") - 1, lambda at: F.when(at > 0, F.concat(
        F.left(value, F.least(F.lit(2), at)), F.lit("***"), F.substring(value, at + 1, size))).otherwise(
        keep_ends(value, 2, 0)))
    org = f"^(.{{2}})(.*?)({fv.COMPANY_SUFFIX})\\z"
    company = let(F.regexp_extract(value, org, 3), lambda suffix: F.when(
        suffix == "", keep_ends(value, 2, 0)).when(
        F.regexp_extract(value, org, 2) != "", F.concat(F.left(value, F.lit(2)), F.lit("**"), suffix)).otherwise(
        F.concat(F.left(value, F.lit(1)), F.lit("*"), suffix)))
    return (
        F.when(category == "姓名", name)
        .when(category == "身分證", keep_ends(value, 3, 1))
        .when(category == "手機", mobile)
        .when(category == "市話", landline)
        .when(category == "地址", address)
        .when(category == "電子郵件", mail)
        .when(category == "公司", company)
        .when(category == "統編", keep_ends(value, 2, 1))
        .otherwise(keep_ends(value, 3, 0))
    )
