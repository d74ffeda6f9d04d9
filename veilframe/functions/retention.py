"""How much of a value stays readable at each end.

A retention is ``struct<mode,head,tail,delimiter,side>``; a split is
``struct<head:int,tail:int>``, the characters kept in front and behind.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilframe.functions import fixed_values as fv
from veilframe.functions.numbering_plan import CALLING_CODE
from veilframe.functions.text import let

RETENTION = "struct<mode:string,head:int,tail:int,delimiter:string,side:string>"
MODES = list(fv.MODE_LABELS)


@dataclass(frozen=True, order=True)
class Retention:
    """Driver-side form of one retention setting."""

    mode: str = "none"
    head: int | None = None
    tail: int | None = None
    delimiter: str | None = None
    side: str | None = None

    def column(self) -> Column:
        return F.struct(*[F.lit(v).cast(t).alias(k) for (k, v), t in zip(
            asdict(self).items(), ("string", "int", "int", "string", "string"))])


NONE = Retention("none")
STANDARD = Retention("preview")


def split(head: Column | int, tail: Column | int) -> Column:
    as_int = [c if isinstance(c, Column) else F.lit(c) for c in (head, tail)]
    return F.struct(as_int[0].cast("int").alias("head"), as_int[1].cast("int").alias("tail"))


def _matched(value: Column, regex: str) -> Column:
    return F.length(F.regexp_extract(value, regex, 0))


def surname_length(value: Column) -> Column:
    return F.when(F.left(value, F.lit(2)).isin(fv.COMPOUND_SURNAMES), 2).otherwise(1)


def through_digit(value: Column, n: int) -> Column:
    """Length up to the n-th digit and the separators behind it; everything if there are fewer digits."""
    return let(_matched(value, rf"^(?:\D*\d){{{n}}}\D*"), lambda k: F.when(k > 0, k).otherwise(F.length(value)))


def phone_prefix(value: Column) -> Column:
    """Calling code with one separator, or the North American area code."""
    return F.when(value.startswith("+"), _matched(value, rf"^\+{fv.WS}*{CALLING_CODE}(?:{fv.WS}|[.-])?")).otherwise(
        _matched(value, rf"^(?:\(\d{{3}}\){fv.WS}?|\d{{3}}(?:{fv.WS}|[.-]))"))


def district_prefix(value: Column, with_district: bool) -> Column:
    city = _matched(value, f"^{fv.CITIES}")
    more = _matched(F.substring(value, city + 1, F.length(value)), fv.DISTRICT_PREFIX)
    return F.when(city > 0, city + more if with_district else city).otherwise(0)


def birth_year(value: Column) -> Column:
    ws = fv.WS
    head = _matched(value, rf"^(?:(?:民國{ws}*)?\d{{2,4}}{ws}*年|\d{{4}}[-/.]){ws}*")
    tail = _matched(value, rf"(?:{ws}|[,/.-])+\d{{4}}\z")
    return let(head, lambda h: F.when(h > 0, split(h, 0)).otherwise(split(0, tail)))


def standard_split(category: Column, value: Column) -> Column:
    """The usual partial form of a category: useful for statistics, weak for re-identification."""
    at = F.instr(value, "@")
    area = _matched(value, rf"^(?:\(0\d{{1,3}}\)|0\d{{1,3}}(?:-|{fv.WS}))")
    last_four = F.when(F.length(F.regexp_replace(value, F.lit(r"\D"), F.lit(""))) >= 4, _matched(
        value, r"(?:\d\D*){3}\d\D*\z")).otherwise(F.length(value))
    return (
        F.when(category == "姓名", split(surname_length(value), 0))
        .when(category == "身分證", split(2, 0))
        .when(category == "手機", split(through_digit(value, 4), 0))
        .when(category == "市話", split(F.when(area > 0, area).otherwise(through_digit(value, 2)), 0))
        .when(category == "地址", split(district_prefix(value, True), 0))
        .when(category == "電子郵件", split(0, F.when(at > 1, F.length(value) - at + 1).otherwise(0)))
        .when(category == "公司", split(0, F.length(F.regexp_extract(
            value, f"^.{{2}}.*?({fv.COMPANY_SUFFIX})\\z", 1))))
        .when(category.isin("統編", "SSN"), split(0, 0))
        .when(category == "國際電話", split(phone_prefix(value), 0))
        .when(category == "信用卡", split(0, last_four))
        .when(category == "IBAN", split(2, 0))
        .when(category == "IP", split(_matched(value, r"^(?:\d{1,3}\.){2}|^(?:[0-9A-Fa-f]{0,4}:){2}"), 0))
        .when(category == "生日", birth_year(value))
        .otherwise(split(1, 0))
    )


def raw_split(value: Column, retention: Column, category: Column) -> Column:
    """The split a retention asks for, before the safety clamp."""
    r, size, delim = retention, F.length(value), F.length(retention["delimiter"])
    first = F.position(r["delimiter"], value)
    last = F.position(F.reverse(r["delimiter"]), F.reverse(value))
    known = F.coalesce(delim, F.lit(0)) > 0
    delimited = (
        F.when(~known | (first == 0), split(0, 0))
        .when(r["side"] == "after", split(0, size - first + 1))
        .otherwise(split(size - last + 1, 0))
    )
    return (
        F.when(r["mode"] == "preview", standard_split(category, value))
        .when(r["mode"] == "ends", split(r["head"], r["tail"]))
        .when(r["mode"] == "delim", delimited)
        .when(r["mode"] == "surname", split(surname_length(value), 0))
        .when(r["mode"] == "city", split(district_prefix(value, False), 0))
        .when(r["mode"] == "district", split(district_prefix(value, True), 0))
        .otherwise(split(0, 0))
    )


def clamp(value: Column, asked: Column) -> Column:
    """Hide everything unless at least one character stays hidden."""
    return let(asked, lambda s: F.when(
        (s["head"] >= 0) & (s["tail"] >= 0) & (s["head"] + s["tail"] < F.length(value)),
        split(s["head"], s["tail"])).otherwise(split(0, 0)))


def split_for(value: Column, retention: Column, category: Column) -> Column:
    return clamp(value, raw_split(value, retention, category))


# ----------------------------------------------------- output of a split
def hidden_part(value: Column, head: Column, tail: Column) -> Column:
    return F.substring(value, head + 1, F.length(value) - head - tail)


def kept_prefix(value: Column, head: Column) -> Column:
    return F.left(value, head)


def kept_suffix(value: Column, tail: Column) -> Column:
    return F.right(value, tail)


def blank_out(value: Column) -> Column:
    """Every letter and digit becomes a circle; separators stay."""
    return F.regexp_replace(value, F.lit(r"[\p{L}\p{N}]"), F.lit(fv.BLANK))


def marker(category: Column, code: Column) -> Column:
    return F.concat(F.lit("["), category, F.lit(":"), code, F.lit("]"))


def rendered(style: str, category: Column, value: Column, head: Column, tail: Column,
             code: Column | None = None) -> Column:
    """What stands in the output for a value: kept prefix + code / label / blanks + kept suffix."""
    if style == "code":
        middle = marker(category, code)
    elif style == "label":
        middle = F.concat(F.lit("["), category, F.lit("]"))
    elif style == "blank":
        middle = blank_out(hidden_part(value, head, tail))
    else:
        raise ValueError(f"unknown style {style!r}: use code, label or blank")
    return F.concat(kept_prefix(value, head), middle, kept_suffix(value, tail))


def preview(style: str, category: Column, value: Column, head: Column, tail: Column) -> Column:
    """On-screen form: the output, with codes shown as the category alone."""
    return rendered("label" if style == "code" else style, category, value, head, tail)


# --------------------------------------------------- describing and linting
def modes_for(category: Column) -> Column:
    """The retention modes a category offers."""
    extra = F.when(category == "姓名", F.array(F.lit("surname"))).when(
        category == "地址", F.array(F.lit("city"), F.lit("district"))).otherwise(F.array().cast("array<string>"))
    return F.concat(F.array(*map(F.lit, ("none", "ends", "delim"))), extra, F.array(F.lit("preview")))


def describe(retention: Column) -> Column:
    r, labels = retention, fv.MODE_LABELS
    kept = F.concat_ws("＋",
                       F.when(r["head"] > 0, F.concat(F.lit("前 "), r["head"].cast("string"), F.lit(" 碼"))),
                       F.when(r["tail"] > 0, F.concat(F.lit("後 "), r["tail"].cast("string"), F.lit(" 碼"))))
    ends = F.when(F.length(kept) > 0, F.concat(F.lit("保留"), kept)).otherwise(F.lit(labels["none"]))
    side = F.when(r["side"] == "after", F.lit("之後")).otherwise(F.lit("之前"))
    out = F.when(r.isNull() | r["mode"].isNull(), F.lit(labels["none"])).when(r["mode"] == "ends", ends).when(
        r["mode"] == "delim", F.concat(F.lit("保留「"), r["delimiter"], F.lit("」"), side))
    for mode in ("surname", "city", "district", "preview"):
        out = out.when(r["mode"] == mode, F.lit(labels[mode]))
    return out.otherwise(F.lit(labels["none"]))


def first_example(example: Column) -> Column:
    return F.trim(F.split(example, "[、,，]", -1)[0])


def sane(retention: Column) -> Column:
    """Whether a stored retention is well formed."""
    r = retention
    return F.coalesce(
        F.when(r["mode"].isin("none", "surname", "city", "district", "preview"), F.lit(True))
        .when(r["mode"] == "ends", (r["head"] >= 0) & (r["tail"] >= 0))
        .when(r["mode"] == "delim", (F.length(r["delimiter"]) > 0) & r["side"].isin("before", "after")),
        F.lit(False))


def lint(example: Column, retention: Column, category: Column) -> Column:
    """``struct<error, warnings>`` for a setting, judged on the rule's first example.

    Errors: ``bad_length``, ``no_delimiter``, ``nothing_hidden``. Warnings:
    ``partial_exposes``, ``both_ends``, ``delimiter_absent``, ``under_half_hidden``.
    """
    r = retention

    def judged(ex: Column) -> Column:
        def with_split(s: Column) -> Column:
            hidden = F.length(ex) - s["head"] - s["tail"]
            has_example = F.length(ex) > 0
            sized = r["mode"].isin("ends", "delim") & has_example
            bad = (r["mode"] == "ends") & ~F.coalesce((r["head"] >= 0) & (r["tail"] >= 0), F.lit(False))
            undelimited = (r["mode"] == "delim") & (F.coalesce(F.length(r["delimiter"]), F.lit(0)) == 0)
            absent = (r["mode"] == "delim") & has_example & ~undelimited & ~F.coalesce(
                F.contains(ex, r["delimiter"]), F.lit(False))
            error = (
                F.when(bad, "bad_length").when(undelimited, "no_delimiter")
                .when(sized & ~absent & (hidden <= 0), "nothing_hidden"))
            warnings = F.array_compact(F.array(
                F.when(r["mode"] == "preview", F.lit("partial_exposes")),
                F.when((r["mode"] == "ends") & ~bad & (r["head"] > 0) & (r["tail"] > 0), F.lit("both_ends")),
                F.when(absent, F.lit("delimiter_absent")),
                F.when(sized & ~bad & ~undelimited & ~absent & (hidden > 0) & (hidden * 2 < F.length(ex)),
                       F.lit("under_half_hidden")),
            ))
            return F.struct(error.alias("error"), warnings.alias("warnings"))

        return let(raw_split(ex, r, category), with_split)

    return let(first_example(example), judged)
