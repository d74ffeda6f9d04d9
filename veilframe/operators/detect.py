"""Detection: rules over a text column, overlap resolution, and the item table.

The whole rule set is one projection over the text: one scan, no shuffle, no
UDF. Items stay an array in the document's row until a table of items is asked
for, so that redaction with labels or blanks, and codes per document, never
move the text.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterable
from functools import lru_cache, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.functions.fixed_values import MARKER as MARKER_PATTERN
from veilframe.functions.retention import NONE, STANDARD, Retention, split, split_for
from veilframe.functions.text import (
    accept, each, empty, exact_values, fenced, let, matches_everywhere_in, matches_in, pieces, pieces_everywhere, resolve_overlaps,
)
from veilframe.operators.rules import BUILTIN_RULES, HAN, Rule, regex_problem

CANDIDATE = "struct<start:int,end:int,rule_ord:int,rule_id:string,category:string,value:string>"
ITEM = ("struct<start:int,end:int,rule_ord:int,rule_id:string,category:string,value:string,"
        "head:int,tail:int>")
ITEM_COLUMNS = ["start", "end", "rule_ord", "rule_id", "category", "value", "head", "tail"]


GATES = {"digit": "[0-9]", "han": HAN}


def gates_of(text: Column) -> dict[str, Column]:
    return {name: text.rlike(regex) for name, regex in GATES.items()}


def possible(text: Column, rule: Rule, gates: dict[str, Column]) -> Column | None:
    """A cheap test that every text with a match passes, or None."""
    words = [F.contains(text, F.lit(word)) for word in rule.needs]
    tests = [gates[rule.gate]] if rule.gate else []
    if words:
        tests.append(reduce(lambda a, b: a | b, words))
    if rule.hint is not None:
        tests.append(text.rlike(rule.hint))
    return reduce(lambda a, b: a & b, tests) if tests else None


def rule_pieces(text: Column, rule: Rule, gates: dict[str, Column] | None = None) -> Column:
    parts = pieces_everywhere(text, *rule.forms) if rule.checked else pieces(text, rule.regex)
    test = possible(text, rule, gates or gates_of(text))
    return parts if test is None else F.when(test, parts).otherwise(empty("string"))


def accepted(parts: Column, rule: Rule) -> Column:
    """Spans of one rule from its pieces."""
    return accept(matches_everywhere_in(parts), rule.verdict) if rule.checked else matches_in(parts)


def candidates(text: Column, rules: Iterable[Rule]) -> Column:
    """Matches of all enabled rules, before overlaps are resolved.

    Every rule cuts the text once; the walk over the cuts is one expression
    shared by all rules, so the plan stays small however many rules there are.
    """
    active = [(n, r) for n, r in enumerate(rules) if r.enabled]

    def walked(text: Column, gates: dict[str, Column], chosen: list[tuple[int, Rule]], walk) -> Column:
        cut = F.array(*[F.struct(F.lit(n).alias("rule_ord"), F.lit(r.id).alias("rule_id"),
                                 F.lit(r.category).alias("category"), rule_pieces(text, r, gates).alias("parts"))
                        for n, r in chosen])
        tagged = F.transform(F.filter(cut, lambda c: F.size(c["parts"]) > 1), lambda c: F.transform(
            walk(c), lambda s: F.struct(
                s["start"].alias("start"), s["end"].alias("end"), c["rule_ord"].alias("rule_ord"),
                c["rule_id"].alias("rule_id"), c["category"].alias("category"), s["value"].alias("value"))))
        return F.flatten(tagged)

    def verdict_of(c: Column, checked: list[tuple[int, Rule]]):
        def verdict(value: Column, before: Column) -> Column:
            out = F.when(c["rule_ord"] == checked[0][0], checked[0][1].verdict(value, before))
            for n, r in checked[1:]:
                out = out.when(c["rule_ord"] == n, r.verdict(value, before))
            return out

        return verdict

    def both(row: Column) -> Column:
        t, gates = row["text"], {name: row[name] for name in GATES}
        plain = [(n, r) for n, r in active if not r.checked]
        checked = [(n, r) for n, r in active if r.checked]
        found = []
        if plain:
            found.append(walked(t, gates, plain, lambda c: matches_in(c["parts"])))
        if checked:
            found.append(walked(t, gates, checked, lambda c: accept(
                matches_everywhere_in(c["parts"]), verdict_of(c, checked))))
        return F.concat(*found)

    gated = let(fenced(text), lambda t: F.struct(t.alias("text"), *[g.alias(n) for n, g in gates_of(t).items()]))
    return exact_values(text, let(gated, both)) if active else empty(CANDIDATE)


def retention_of(category: Column, rule_id: Column, rules: Iterable[Rule], mode: str,
                 overrides: dict[str, Retention] | None = None) -> Column:
    """The retention in force: hide all, the standard form, or per category / per rule."""
    if mode == "hide":
        return NONE.column()
    if mode == "standard":
        return STANDARD.column()
    if mode != "custom":
        raise ValueError(f"unknown mode {mode!r}: use hide, standard or custom")
    cases = [(category == c, r) for c, r in (overrides or {}).items()]
    cases += [(rule_id == r.id, r.retention) for r in rules if r.retention.mode != "none"]
    if not cases:
        return NONE.column()
    out = F.when(cases[0][0], cases[0][1].column())
    for hit, retention in cases[1:]:
        out = out.when(hit, retention.column())
    return out.otherwise(NONE.column())


def with_split(items: Column, rules: Iterable[Rule], mode: str = "hide",
               overrides: dict[str, Retention] | None = None) -> Column:
    """Add or recompute ``head`` and ``tail`` of every item for an output mode."""
    rules = list(rules)

    def one(i: Column) -> Column:
        asked = split(0, 0) if mode == "hide" else split_for(
            i["value"], retention_of(i["category"], i["rule_id"], rules, mode, overrides), i["category"])
        keep = [i[c].alias(c) for c in ITEM_COLUMNS[:6]]
        return let(asked, lambda s: F.struct(*keep, s["head"].alias("head"), s["tail"].alias("tail")))

    return F.transform(items, one)


def items_of(text: Column, rules: Iterable[Rule] | None = None, mode: str = "hide",
             overrides: dict[str, Retention] | None = None) -> Column:
    """Non-overlapping items of a text: ``array<ITEM>`` ordered by start."""
    rules = BUILTIN_RULES if rules is None else list(rules)
    return with_split(resolve_overlaps(candidates(text, rules), CANDIDATE), rules, mode, overrides)


def detect(docs: DataFrame, rules: Iterable[Rule] | None = None, text: str = "text", mode: str = "hide",
           overrides: dict[str, Retention] | None = None, into: str = "items") -> DataFrame:
    """Add an ``items`` array column to documents (null texts have no items).

    A user's rule whose regex can't be compiled finds nothing; a warning names it.
    The steps are columns of their own, so that the analyzer never meets one
    very deep expression; the optimizer joins them again.
    """
    spark = docs.sparkSession
    chosen = tuple(r for r in (BUILTIN_RULES if rules is None else rules) if _usable(spark, r))
    found, kept, cut = _steps(spark, text, chosen, mode, tuple(sorted((overrides or {}).items())))
    steps = docs.withColumn(_FOUND, found).withColumn(_KEPT, kept)
    return steps.withColumn(into, cut).drop(_FOUND, _KEPT)


_FOUND, _KEPT = "_candidates", "_spans"


def _usable(spark: SparkSession, rule: Rule) -> bool:
    if rule.source == "builtin" or not rule.enabled or _problem(spark, rule.regex) != "invalid":
        return True
    warnings.warn(f"rule {rule.id} is left out: its regex can't be compiled", stacklevel=3)
    return False


@lru_cache(maxsize=4096)
def _problem(spark: SparkSession, regex: str) -> str | None:
    return regex_problem(spark, regex)


@lru_cache(maxsize=64)
def _steps(spark: SparkSession, text: str, rules: tuple[Rule, ...], mode: str,
           overrides: tuple[tuple[str, Retention], ...]) -> tuple[Column, Column, Column]:
    """The expressions of detection; built once per session, rule set and mode, as they have many nodes."""
    found = candidates(F.coalesce(F.col(text), F.lit("")), rules)
    return found, resolve_overlaps(F.col(_FOUND), CANDIDATE), with_split(F.col(_KEPT), rules, mode, dict(overrides))


def resplit(docs: DataFrame, rules: Iterable[Rule] | None = None, mode: str = "hide",
            overrides: dict[str, Retention] | None = None, items: str = "items") -> DataFrame:
    """Change the output mode of detected items without scanning the text again."""
    return docs.withColumn(items, with_split(F.col(items), rules or BUILTIN_RULES, mode, overrides))


def item_table(docs: DataFrame, *keys: str, items: str = "items") -> DataFrame:
    """One row per item: the document keys and the item's fields."""
    return each(docs, items, *keys, name="item").select(*keys, "item.*")


def find(docs: DataFrame, rule: Rule, *keys: str, text: str = "text") -> DataFrame:
    """Matches of a single rule, one row each (also the way to try out a rule)."""
    whole = F.coalesce(F.col(text), F.lit(""))
    hits = exact_values(whole, let(fenced(whole), lambda t: let(
        rule_pieces(t, rule), lambda parts: accepted(parts, rule))))
    return each(docs, hits, *keys, name="hit").select(*keys, "hit.*")


def has_markers(text: Column) -> Column:
    """Whether a source text already holds something that looks like a marker."""
    return text.rlike(MARKER_PATTERN)
