"""Repeated lines against a plain loop, and the query against SQL."""

import random
from collections import defaultdict

import duckdb
import pytest

from tools.check import compare
from veilframe.llm import line_dedup
from veilframe.llm.queries_lines import OP12_SQL, op12_line_bitmaps

SF = "/root/testdata/sf0.01"


def key_of(line):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line)
    return low.strip(line_dedup.WHITE)


def plain(rows, least):
    place = lambda i: (i is None, i or 0)
    held = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key_of(line)) >= least:
                held[key_of(line)].add(place(i))
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(key_of(x)) < least or min(held[key_of(x)]) == place(i)]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(map(repr, out))


def hard_rows():
    draw = random.Random(3)
    lines = [f"line number {n} of the table" for n in range(60)] + ["  Common  LINE of all ", "common  line of all", "ÀÉ common ÉÀ line", "àé common éà line", "", " ", "short", " not stripped here ", "tab\tinside a line\r"]
    rows = [(n, "\n".join(draw.choice(lines) for _ in range(draw.randint(0, 30)))) for n in range(120)]
    rows += [(200, None), (201, ""), (202, "\n"), (203, "\n\n\n"), (None, "common  line of all\nonly here and so kept"), (None, "only here and so kept"), (None, None),
             (204, "line number 3 of the table\n" * 500 + "end of a very long text"), (5, rows[5][1]), (6, "common  line of all\nanother text, same id"), (300, rows[7][1]), (0, None), (-4, "line number 1 of the table"),
             (2**63 - 1, "line number 2 of the table"), (400, "9 letters\n9 letters\nletters10\n" + "x" * 100_000), (401, "9 letters\nletters 10\n" + "x" * 100_000)]
    return rows


@pytest.mark.parametrize("hot_rows", [16, 1])
@pytest.mark.parametrize("least", [10, 1])
def test_lines(spark, monkeypatch, hot_rows, least):
    monkeypatch.setattr(line_dedup, "HOT_ROWS", hot_rows)
    rows = hard_rows()
    df = spark.createDataFrame([(i, t, 1, 2, "x", 3, 4) for i, t in rows], "doc_id long, text string, pos int, row long, words string, h1 long, first int")
    assert sorted(repr(tuple(r)) for r in line_dedup.drop_repeated_lines(df, least).collect()) == plain(rows, least)
    assert line_dedup.drop_repeated_lines(df.limit(0), least).collect() == []


def test_hot_keys_are_found(spark):
    rows = [(n, f"the same line in every text\nown line of text {n}") for n in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    hot = line_dedup._hot_keys(line_dedup.occurrences(df)).collect()
    assert [r["first"]["doc_id"] for r in hot] == [0]
    assert sum(r["n_dropped"] for r in line_dedup.drop_repeated_lines(df).collect()) == 2999


def test_bitmaps_list_only_words_with_drops(spark):
    long = "\n".join(f"own line with number {n}" for n in range(1000))
    df = spark.createDataFrame([(1, "shared line of the two texts"), (2, long + "\nshared line of the two texts\n" + long)], "doc_id long, text string")
    found = line_dedup.keep_bitmaps(df).collect()
    assert [(r["doc_id"], [(w["word"], w["bits"]) for w in r["words"]]) for r in found] == [(2, [(1000 // 64, ~(1 << 1000 % 64))])]


def test_main_path_is_native(spark):
    plan = op12_line_bitmaps(spark, SF)._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow", "RDD"))


def test_query_against_sql(spark):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    verdict, _ = compare(spark, con, SF, op12_line_bitmaps, OP12_SQL)
    assert verdict.startswith("ok"), verdict
