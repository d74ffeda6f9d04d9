"""Letters that were read in place of digits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilframe.functions import fixed_values as fv
from veilframe.functions.checks import digits_of, is_tax_id, is_tw_id
from veilframe.functions.text import fenced, find_all, let, splice


def as_digits(token: Column) -> Column:
    return F.translate(token, fv.LOOKALIKE_LETTERS, fv.LOOKALIKE_DIGITS)


def fix_token(token: Column) -> Column:
    """The token with look-alike letters read as digits, if that makes it a valid number."""
    bare = F.replace(token, F.lit("-"), F.lit(""))
    mixed = bare.rlike("[A-Za-z|]") & (F.length(digits_of(bare)) >= F.length(bare) * 0.6)
    id_like = token.rlike("^[A-Za-z]") & (F.length(bare) == 10) & ~F.contains(token, F.lit("-"))
    as_id = F.concat(F.upper(F.left(token, F.lit(1))), as_digits(F.substring(token, 2, 64)))
    number = as_digits(token)
    good = number.rlike(r"^[\d-]+\z") & (number.rlike(fv.LOOKALIKE_PHONE) | is_tax_id(number))
    return (
        F.when(~mixed, token)
        .when(id_like, F.when(is_tw_id(as_id), as_id).otherwise(token))
        .when(good, number)
        .otherwise(token)
    )


def fix_lookalikes(text: Column) -> Column:
    """Repair every number-like token of a text. The length never changes."""
    tokens = let(fenced(text), lambda t: find_all(t, fv.LOOKALIKE_TOKEN))
    edits = F.transform(tokens, lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"), fix_token(s["value"]).alias("replacement")))
    return F.when(text.rlike(r"\d"), splice(text, edits)).otherwise(text)
