"""Second-pass checks: ``check(value, before)`` -> INT, the valid leading length (0 = refuse).

Each is a plain Column expression, so a rule's check runs next to its regex in
the scan task. Boolean tests are offered separately where other jobs need them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilframe.functions import fixed_values as fv
from veilframe.functions.numbering_plan import CALLING_CODE, NUMBERING_PLAN, plan_pattern
from veilframe.functions.text import let


def whole_if(ok: Column, value: Column) -> Column:
    return F.when(ok, F.length(value)).otherwise(F.lit(0))


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, F.lit(r"\D"), F.lit(""))


def _digit(value: Column, i: int) -> Column:
    return F.substring(value, i, 1).cast("int")


def _digit_sum(n: Column) -> Column:
    return F.floor(n / 10).cast("int") + n % 10


# ------------------------------------------------------------------ names
def is_name(value: Column, before: Column) -> Column:
    doubled = (F.length(value) == 2) & (F.left(value, F.lit(1)) == F.right(value, F.lit(1)))
    party = value.startswith("方") & before.rlike(fv.PARTY_BEFORE)
    adverb = value.startswith("何") & before.rlike(fv.HE_BEFORE)
    return ~(F.left(value, F.lit(2)).isin(fv.NAME_STOP_WORDS) | doubled | party | adverb)


def name(value: Column, before: Column) -> Column:
    return whole_if(is_name(value, before), value)


# ------------------------------------------------------- Taiwanese numbers
def is_tw_id(value: Column) -> Column:
    letter = F.instr(F.lit(fv.TW_ID_LETTERS), F.left(value, F.lit(1))) + 9
    total = F.floor(letter / 10).cast("int") + (letter % 10) * 9 + _digit(value, 10)
    for i in range(8):
        total = total + _digit(value, i + 2) * (8 - i)
    return F.coalesce(value.rlike(r"^[A-Z][12]\d{8}\z") & (total % 10 == 0), F.lit(False))


def tw_id(value: Column, before: Column) -> Column:
    return whole_if(is_tw_id(value), value)


def is_tax_id(value: Column) -> Column:
    total = F.lit(0)
    for i, weight in enumerate((1, 2, 1, 2, 1, 2, 4, 1), start=1):
        total = total + _digit_sum(_digit(value, i) * weight)
    five = let(total, lambda t: (t % 5 == 0) | ((F.substring(value, 7, 1) == "7") & ((t + 1) % 5 == 0)))
    return F.coalesce(value.rlike(r"^\d{8}\z") & five, F.lit(False))


def tax_id(value: Column, before: Column) -> Column:
    return whole_if(is_tax_id(value), value)


# ------------------------------------------------------ payment identifiers
def is_card(value: Column) -> Column:
    return let(digits_of(value), lambda d: (
        F.length(d).between(13, 19) & d.rlike(fv.CARD_PREFIX) & value.rlike(fv.CARD_SHAPE) & F.call_function("luhn_check", d)))


def card(value: Column, before: Column) -> Column:
    return whole_if(is_card(value), value)


def mod97(iban: Column) -> Column:
    """ISO 7064 remainder of an IBAN without spaces (1 when its check digits hold)."""
    turned = F.concat(F.substring(iban, 5, 64), F.left(iban, F.lit(4)))

    def step(rest: Column, ch: Column) -> Column:
        return F.when(ch.between("0", "9"), (rest * 10 + ch.cast("int")) % 97).otherwise(
            (rest * 100 + F.ascii(ch) - 55) % 97)

    return F.aggregate(F.split(turned, ""), F.lit(0), step)


def iban(value: Column, before: Column) -> Column:
    """An IBAN cut to its country's length; countries without an entry take 15 to 34 characters."""
    known = F.create_map(*[F.lit(x) for pair in fv.IBAN_LENGTH.items() for x in pair])
    want = F.try_element_at(known, F.left(value, F.lit(2)))

    def judged(w: Column) -> Column:
        pattern = F.concat(F.lit("^(?: *[^ ]){"), w.cast("string"), F.lit("}"))
        cut = F.when(w.isNull(), value).otherwise(F.regexp_substr(value, pattern))
        return let(cut, lambda c: let(F.replace(c, F.lit(" "), F.lit("")), lambda bare: F.when(
            (F.length(bare) > 0)
            & F.when(w.isNull(), F.length(bare).between(15, 34)).otherwise(F.length(bare) == w)
            & (mod97(bare) == 1), F.length(c)).otherwise(F.lit(0))))

    return let(want, judged)


def is_ssn(value: Column) -> Column:
    return digits_of(value).rlike(r"^(?!000|666|9)\d{3}(?!00)\d{2}(?!0000)\d{4}\z")


def ssn(value: Column, before: Column) -> Column:
    return whole_if(is_ssn(value), value)


# ----------------------------------------------------------------- phones
def phone_check(plan: dict[str, str] = NUMBERING_PLAN):
    """A phone check against ``plan``: the longest valid number at the start of the match."""
    pattern = plan_pattern(plan)

    def dialled(candidate: Column) -> Column:
        number = F.regexp_replace(candidate, F.lit(r"[^\d+]"), F.lit(""))
        return F.when(candidate.startswith("+"), number).otherwise(F.concat(F.lit("+1"), number))

    def phone(value: Column, before: Column) -> Column:
        def longest(groups: Column) -> Column:
            prefixes = F.transform(F.sequence(F.size(groups), F.lit(1), F.lit(-1)),
                                   lambda n: F.array_join(F.slice(groups, F.lit(1), n), ""))
            return F.length(F.get(F.filter(prefixes, lambda c: dialled(c).rlike(pattern)), F.lit(0)))

        valid = let(F.split(value, r"(?<=\d|\))(?=[\s.-])", -1), longest)
        return F.when(value.rlike(rf"^\+{fv.WS}*886"), F.lit(0)).otherwise(F.coalesce(valid, F.lit(0)))

    return phone


phone = phone_check()


def phone_covered(value: Column, plan: dict[str, str] = NUMBERING_PLAN) -> Column:
    """Whether the plan knows the number's calling code (numbers without ``+`` are North American)."""
    code = F.regexp_extract(digits_of(value), f"^{CALLING_CODE}", 0)
    return F.when(value.startswith("+"), code.isin(list(plan))).otherwise(F.lit("1" in plan))


# -------------------------------------------------------------- addresses
def is_ipv6(value: Column) -> Column:
    groups = F.size(F.filter(F.split(value, ":", -1), lambda g: F.length(g) > 0))
    compressed = value.contains("::") & ~value.rlike(":::") & ~value.rlike("::.*::") & ~value.rlike("^:[^:]")
    return let(groups, lambda n: (n >= 2) & F.when(value.contains("::"), compressed & (n <= 7)).otherwise(
        (n == 8) & ~value.startswith(":")))


def ipv6(value: Column, before: Column) -> Column:
    return whole_if(is_ipv6(value), value)


# ---------------------------------------------------------- dates of birth
def is_birth_date(value: Column) -> Column:
    """Month and day are possible; the year is free, as years of the ROC calendar are short."""
    numbers = F.transform(F.regexp_extract_all(value, F.lit(r"(\d+)"), F.lit(1)), lambda n: n.cast("int"))
    word = F.lower(F.left(F.regexp_extract(value, "[A-Za-z]{3,}", 0), F.lit(3)))

    def parts(n: Column) -> Column:
        by_name = F.struct(
            F.array_position(F.array(*map(F.lit, fv.MONTHS)), word).cast("int").alias("month"),
            F.coalesce(F.get(F.filter(n, lambda x: x <= 31), F.lit(0)), F.lit(0)).alias("day"))
        a, b, c = (F.get(n, F.lit(i)) for i in range(3))
        year_first = F.struct(b.alias("month"), c.alias("day"))
        either = F.when(a <= 12, F.struct(a.alias("month"), b.alias("day"))).otherwise(
            F.struct(b.alias("month"), a.alias("day")))
        return F.when(F.length(word) > 0, by_name).when(
            value.contains("年") | value.rlike(r"^\d{4}"), year_first).otherwise(either)

    return let(let(numbers, parts), lambda d: F.coalesce(
        d["month"].between(1, 12) & d["day"].between(1, 31), F.lit(False)))


def birth_date(value: Column, before: Column) -> Column:
    return whole_if(is_birth_date(value), value)
