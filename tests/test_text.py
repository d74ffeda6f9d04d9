"""The scanning expressions against brute force in Python."""

import random
import re

from pyspark.sql import functions as F

from veilframe.functions.text import accept, cut_gaps, find_all, find_everywhere, resolve_overlaps, splice
from veilframe.operators.detect import CANDIDATE

rng = random.Random(7)
TEXTS = ["".join(rng.choice("ab1 😀") for _ in range(n)) for n in (0, 1, 5, 40, 300, 1500)]


def frame(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string").orderBy("id")


def test_find_all(spark):
    got = frame(spark).select("id", find_all(F.col("text"), "a+b?").alias("m")).collect()
    for r in got:
        want = [(m.start(), m.end(), m.group()) for m in re.finditer("a+b?", TEXTS[r["id"]])]
        assert [tuple(m) for m in r["m"]] == want


def test_find_everywhere(spark):
    got = frame(spark).select("id", find_everywhere(F.col("text"), ("", "a[ab]{1,2}")).alias("m")).collect()
    for r in got:
        t = TEXTS[r["id"]]
        want = [(m.start(), m.end(1), m.group(1), t[max(0, m.start() - 3):m.start()]) for m in re.finditer("(?=(a[ab]{1,2}))", t)]
        assert [tuple(m) for m in r["m"]] == want


def test_accept_resumes_behind_refused_matches(spark):
    def judge(v):
        return 0 if v.endswith("a") else (2 if v.endswith("b") and len(v) == 3 else len(v))

    check = lambda v, b: F.when(v.endswith("a"), 0).when(v.endswith("b") & (F.length(v) == 3), 2).otherwise(F.length(v))
    got = frame(spark).select("id", accept(find_everywhere(F.col("text"), ("", "[ab]{2,3}")), check).alias("m")).collect()
    for r in got:
        t, at, want = TEXTS[r["id"]], 0, []
        rule = re.compile("[ab]{2,3}")
        while (m := rule.search(t, at)) is not None:
            took = judge(m.group())
            if took == 0:
                at = m.start() + min(2, len(m.group()))
                continue
            want.append((m.start(), m.start() + took, m.group()[:took]))
            at = m.start() + took
        assert [tuple(m) for m in r["m"]] == want


def brute_overlaps(spans):
    chosen = []
    for s in sorted(spans, key=lambda s: (s[0] - s[1], s[0], s[2])):
        if all(s[1] <= k[0] or s[0] >= k[1] for k in chosen):
            chosen.append(s)
    return sorted(chosen)


def test_resolve_overlaps(spark):
    docs = []
    for n, size in enumerate([0, 1, 2, 10, 100, 700]):
        spans = []
        for i in range(size):
            start = rng.randrange(size * 4 + 1)
            spans.append((start, start + rng.randrange(1, 9), i % 5, "r", "c", "v"))
        docs.append((n, spans))
    df = spark.createDataFrame(docs, f"id int, xs array<{CANDIDATE}>")
    got = {r["id"]: [tuple(x) for x in r["xs"]] for r in df.select("id", resolve_overlaps(F.col("xs"), CANDIDATE).alias("xs")).collect()}
    for n, spans in docs:
        assert [g[:3] for g in got[n]] == [b[:3] for b in brute_overlaps(spans)]


def test_gaps_and_splice(spark):
    rows = []
    for n, t in enumerate(TEXTS):
        cuts = sorted(rng.sample(range(len(t) + 1), min(len(t) + 1, 2 * (len(t) // 8))))
        spans = [(a, b, f"<{a}>") for a, b in zip(cuts[::2], cuts[1::2])]
        rows.append((n, t, spans))
    df = spark.createDataFrame(rows, "id int, text string, e array<struct<start:int,end:int,replacement:string>>")
    got = df.select("id", cut_gaps(F.col("text"), F.col("e")).alias("g"), splice(F.col("text"), F.col("e")).alias("s")).collect()
    for r in got:
        _, t, spans = rows[r["id"]]
        ends = [0] + [s[1] for s in spans]
        assert list(r["g"]) == [t[e:s] for e, s in zip(ends, [s[0] for s in spans] + [len(t)])]
        want, at = "", 0
        for s, e, new in spans:
            want, at = want + t[at:s] + new, e
        assert r["s"] == want + t[at:]


def test_overlapping_edits_are_an_error(spark):
    df = spark.createDataFrame([("abcdef", [(0, 3, "x"), (2, 4, "y")])], "text string, e array<struct<start:int,end:int,replacement:string>>")
    try:
        df.select(splice(F.col("text"), F.col("e"))).collect()
    except Exception as error:
        assert "overlap" in str(error)
    else:
        raise AssertionError("no error")


def test_blocks_grow_with_the_array(spark):
    from veilframe.functions.text import _blocks

    sized = spark.range(1).select(*(F.transform(_blocks(F.sequence(F.lit(1), F.lit(n))), F.size).alias(f"n{n}") for n in (1, 70, 500_000))).first()
    assert [sized["n1"], sized["n70"], max(sized["n500000"]), sum(sized["n500000"])] == [[1], [8] * 8 + [6], 100, 500_000]
