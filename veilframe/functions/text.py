"""Column building blocks for finding spans in a text and editing them.

Everything is a Column expression: it runs inside the scan task, needs no
shuffle and works the same in batch and streaming. Offsets are code points.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Private-use characters that fence a match while a text is being cut up.
OPEN, SHUT, MID, STAND_IN = (chr(0xE000 + i) for i in range(4))
FENCES = OPEN + SHUT + MID

# Arrays are walked in blocks, so that appending to a result copies at most one
# block and a text with very many matches stays close to linear. Blocks grow with
# the cube root of the array, which balances what is copied inside and between them.
BLOCK = 8

SPAN = "struct<start:int,end:int,value:string>"
MATCH = "struct<start:int,end:int,value:string,before:string>"


def let(expr: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``expr`` once per row and use it any number of times in ``body``."""
    return F.transform(F.array(expr), body)[0]


def empty(element_type: str) -> Column:
    return F.array().cast(f"array<{element_type}>")


def _blocks(items: Column) -> Column:
    """A non-empty array cut into arrays of ``BLOCK`` elements, or more of a long one."""
    length = F.greatest(F.lit(BLOCK), F.ceil(F.cbrt(F.size(items) * 2)).cast("int"))
    starts = F.sequence(F.lit(1), F.size(items), length)
    return F.transform(starts, lambda i: F.slice(items, i, length))


def state(carry: Column, keep: Column, value: Column) -> Column:
    """What a step of :func:`scan` returns."""
    return F.struct(carry.alias("carry"), keep.alias("keep"), value.alias("value"))


def scan(items: Column, carry: Column, step: Callable[[Column, Column], Column], element_type: str,
         finish: Callable[[Column, Column], Column] = lambda carry, out: out) -> Column:
    """Walk an array in order with a running state and collect what steps keep.

    ``step(carry, item)`` gives ``state(next carry, keep?, value)``;
    ``finish(carry, out)`` sees the last carry and the kept values.
    """

    def one(acc: Column, item: Column) -> Column:
        return let(step(acc["carry"], item), lambda s: F.struct(
            s["carry"].alias("carry"),
            F.when(s["keep"], F.array_append(acc["out"], s["value"])).otherwise(acc["out"]).alias("out"),
        ))

    def block(acc: Column, part: Column) -> Column:
        start = F.struct(acc["carry"].alias("carry"), empty(element_type).alias("out"))
        return let(F.aggregate(part, start, one), lambda r: F.struct(
            r["carry"].alias("carry"), F.array_append(acc["out"], r["out"]).alias("out")))

    zero = F.struct(carry.alias("carry"), empty(f"array<{element_type}>").alias("out"))
    return let(items, lambda xs: F.when(F.size(xs) > 0, F.aggregate(
        _blocks(xs), zero, block, lambda acc: finish(acc["carry"], F.flatten(acc["out"])),
    )).otherwise(empty(element_type)))


def fenced(text: Column) -> Column:
    """The text to scan: same length, free of the fence characters."""
    return let(text, lambda t: F.when(
        t.rlike(f"[{FENCES}]"), F.translate(t, FENCES, STAND_IN * len(FENCES))).otherwise(t))


def exact_values(text: Column, spans: Column) -> Column:
    """Spans that were found in :func:`fenced` text, with their values as in the text itself."""
    def cut(s: Column) -> Column:
        return s.withField("value", F.substring(text, s["start"] + 1, s["end"] - s["start"]))

    return let(spans, lambda xs: F.when(text.rlike(f"[{FENCES}]"), F.transform(xs, cut)).otherwise(xs))


def each(df: DataFrame, array: Column | str, *keys: str, name: str = "one", position: str | None = None) -> DataFrame:
    """One row per array element.

    The outer form is used on purpose: for the plain one the optimizer adds a
    filter on the array's size, which computes an expensive array once more.
    """
    if position is not None:
        rows = df.select(*keys, F.posexplode_outer(array).alias(position, name))
    else:
        rows = df.select(*keys, F.explode_outer(array).alias(name))
    return rows.where(F.col(name).isNotNull())


def pieces(text: Column, regex: Column | str) -> Column:
    """The text cut in front of every non-overlapping match; input of :func:`matches_in`."""
    marked = F.regexp_replace(text, F.lit(regex), F.lit(f"{OPEN}$0{SHUT}"))
    return F.split(marked, OPEN, -1)


def pieces_everywhere(text: Column, *forms: tuple[str, str]) -> Column:
    """The text cut at *every* position where a match begins, also when matches overlap.

    ``forms`` are (label, regex) pairs; a match counts only right behind its
    label, which is not part of the value. No back-references in ``regex``.
    """
    probe = "(?=" + "|".join(f"({label})({regex})" for label, regex in forms) + ")"
    labels = "".join(f"${2 * n + 1}" for n in range(len(forms)))
    values = "".join(f"${2 * n + 2}" for n in range(len(forms)))
    marked = F.regexp_replace(text, F.lit(probe), F.lit(f"{OPEN}{labels}{MID}{values}{SHUT}"))
    return F.split(marked, OPEN, -1)


def _behind_first(parts: Column) -> Column:
    return F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))


def matches_in(parts: Column) -> Column:
    """``array<struct<start,end,value>>`` from :func:`pieces`."""

    def step(pos: Column, piece: Column) -> Column:
        return let(F.substring_index(piece, SHUT, 1), lambda v: state(
            pos + F.length(piece) - 1,
            F.length(v) > 0,
            F.struct(pos.alias("start"), (pos + F.length(v)).alias("end"), v.alias("value")),
        ))

    return scan(_behind_first(parts), F.length(F.get(parts, F.lit(0))), step, SPAN)


def matches_everywhere_in(parts: Column) -> Column:
    """``array<struct<start,end,value,before>>`` from :func:`pieces_everywhere`.

    ``before`` is the up to three characters in front of the match.
    """

    def step(carry: Column, piece: Column) -> Column:
        def read(fence: Column) -> Column:
            head, value = F.substring_index(fence, MID, 1), F.substring_index(fence, MID, -1)
            after = F.substring(piece, F.length(fence) + 2, F.length(piece))
            start = carry["pos"] + F.length(head)
            return state(
                F.struct((carry["pos"] + F.length(after)).alias("pos"),
                         F.right(F.concat(carry["tail"], after), F.lit(3)).alias("tail")),
                F.length(value) > 0,
                F.struct(start.alias("start"), (start + F.length(value)).alias("end"), value.alias("value"),
                         F.right(F.concat(carry["tail"], head), F.lit(3)).alias("before")),
            )

        return let(F.substring_index(piece, SHUT, 1), read)

    first = F.get(parts, F.lit(0))
    begin = F.struct(F.length(first).alias("pos"), F.right(first, F.lit(3)).alias("tail"))
    return scan(_behind_first(parts), begin, step, MATCH)


def find_all(text: Column, regex: str) -> Column:
    """All non-overlapping matches of a regex, left to right, with positions."""
    return let(pieces(text, regex), matches_in)


def find_everywhere(text: Column, *forms: tuple[str, str]) -> Column:
    """The match at every position where one begins, with positions."""
    return let(pieces_everywhere(text, *forms), matches_everywhere_in)


def accept(matches: Column, check: Callable[[Column, Column], Column]) -> Column:
    """Read matches left to right through ``check(value, before)``.

    The check gives how many leading characters are valid, 0 meaning none. A
    valid part is kept and reading goes on right behind it; behind a refused
    match reading goes on two characters after its start, so that a refused
    word never hides a good one it overlaps.
    """

    def step(resume: Column, m: Column) -> Column:
        def judged(took: Column) -> Column:
            return state(
                m["start"] + F.when(took > 0, took).otherwise(F.least(F.lit(2), F.length(m["value"]))),
                took > 0,
                F.struct(m["start"].alias("start"), (m["start"] + took).alias("end"),
                         F.left(m["value"], took).alias("value")),
            )

        valid = F.least(F.coalesce(check(m["value"], m["before"]), F.lit(0)), F.length(m["value"]))
        skipped = state(resume, F.lit(False), F.lit(None).cast(SPAN))
        return F.when(m["start"] >= resume, let(valid, judged)).otherwise(skipped)

    return scan(F.array_sort(matches), F.lit(0), step, SPAN)


def resolve_overlaps(spans: Column, element_type: str) -> Column:
    """Keep non-overlapping spans: longest first, then earliest, then lowest ``rule_ord``.

    The spans are cut into islands that touch nothing outside; only inside an
    island spans are compared with each other.
    """

    def rank(span: Column) -> Column:
        return F.struct((span["start"] - span["end"]).alias("size"), span["start"].alias("at"),
                        span["rule_ord"].alias("rule_ord"), span.alias("span"))

    def clear(chosen: Column, c: Column) -> Column:
        return ~F.exists(chosen, lambda k: (c["start"] < k["end"]) & (c["end"] > k["start"]))

    def best(island: Column) -> Column:
        ranked = F.array_sort(F.transform(island, rank))
        chosen = F.aggregate(ranked, empty(element_type), lambda acc, r: F.when(
            clear(acc, r["span"]), F.array_append(acc, r["span"])).otherwise(acc))
        return F.when(F.size(island) == 1, island).when(falling(island), in_order(island)).otherwise(F.array_sort(chosen))

    def size_of(span: Column) -> Column:
        return span["end"] - span["start"]

    def falling(island: Column) -> Column:
        """Whether no span beats one in front of it, as in a chain of matches of one length."""
        pairs = F.zip_with(F.slice(island, F.lit(1), F.size(island) - 1), F.slice(island, F.lit(2), F.size(island)), lambda a, b: (
            size_of(a) > size_of(b)) | ((size_of(a) == size_of(b)) & ((a["start"] < b["start"]) | (a["rule_ord"] <= b["rule_ord"]))))
        return F.forall(pairs, lambda x: x)

    def in_order(island: Column) -> Column:
        return scan(island, F.lit(0), lambda reach, s: state(
            F.when(s["start"] >= reach, s["end"]).otherwise(reach), s["start"] >= reach, s), element_type)

    def step(carry: Column, s: Column) -> Column:
        apart = s["start"] >= carry["reach"]
        return state(
            F.struct(
                F.when(apart, s["end"]).otherwise(F.greatest(carry["reach"], s["end"])).alias("reach"),
                F.when(apart, F.array(s)).otherwise(F.array_append(carry["island"], s)).alias("island"),
            ),
            apart & (F.size(carry["island"]) > 0),
            carry["island"],
        )

    def islands(ordered: Column) -> Column:
        begin = F.struct(F.lit(0).alias("reach"), empty(element_type).alias("island"))
        cut = scan(ordered, begin, step, f"array<{element_type}>",
                   finish=lambda carry, out: F.array_append(out, carry["island"]))
        return F.flatten(F.transform(cut, best))

    def crowded(xs: Column) -> Column:
        """Whether some span begins before the one in front of it ends."""
        return F.exists(F.zip_with(xs, F.slice(xs, F.lit(2), F.size(xs)), lambda a, b: a["end"] > b["start"]), lambda x: x)

    return let(F.array_sort(spans), lambda xs: F.when(
        F.size(xs) > 1, F.when(crowded(xs), islands(xs)).otherwise(xs)).otherwise(xs))


def cut_gaps(text: Column, spans: Column) -> Column:
    """The text in front of each span and behind the last, ``size(spans) + 1`` strings.

    Works in two levels (blocks of spans, then spans), so that long texts are
    not walked from the start for every span. Spans are ordered and disjoint.
    """

    def inside(part: Column, from_: Column, chunk: Column) -> Column:
        def gap(span: Column, i: Column) -> Column:
            start = F.when(i == 0, from_).otherwise(F.element_at(part, F.greatest(i, F.lit(1)))["end"])
            return F.substring(chunk, start - from_ + 1, span["start"] - start)

        return F.transform(part, gap)

    def block(part: Column, b: Column, parts: Column) -> Column:
        from_ = F.when(b == 0, F.lit(0)).otherwise(
            F.element_at(F.element_at(parts, F.greatest(b, F.lit(1))), -1)["end"])
        to = F.element_at(part, -1)["end"]
        return let(from_, lambda f: let(F.substring(text, f + 1, to - f), lambda chunk: inside(part, f, chunk)))

    def gaps(xs: Column) -> Column:
        last = F.element_at(xs, -1)["end"]
        front = let(_blocks(xs), lambda parts: F.flatten(F.transform(parts, lambda p, b: block(p, b, parts))))
        return F.array_append(front, F.substring(text, last + 1, F.length(text)))

    return let(spans, lambda xs: F.when(F.size(xs) > 0, gaps(xs)).otherwise(F.array(text)))


def splice(text: Column, edits: Column) -> Column:
    """Replace each edit ``struct<start,end,replacement,...>`` (ordered, disjoint) in the text."""
    overlap = F.raise_error(F.lit("edits overlap"))

    def checked(es: Column) -> Column:
        clash = F.exists(F.sequence(F.lit(1), F.size(es) - 1), lambda i: (
            F.element_at(es, i)["end"] > F.element_at(es, i + 1)["start"]))
        joined = let(cut_gaps(text, es), lambda gaps: F.array_join(
            F.transform(gaps, lambda g, i: F.when(i < F.size(es), F.concat(
                g, F.element_at(es, F.least(i + 1, F.size(es)))["replacement"])).otherwise(g)), ""))
        return F.when(F.size(es) == 0, text).when((F.size(es) > 1) & clash, overlap.cast("string")).otherwise(joined)

    return let(edits, checked)
