"""Windows over long texts against detection in the whole text."""

import random

import pytest

from veilframe.operators import windows
from veilframe.operators.detect import candidates, detect, item_table
from veilframe.operators.rules import builtin_rules, custom_rule
from veilframe.operators.windows import cores_of, detect_long, match_long
from veilframe.functions.text import each
from pyspark.sql import functions as F


def rows(df):
    return sorted(map(repr, (tuple(r) for r in df.collect())))


@pytest.fixture(scope="module")
def texts(spark):
    draw = random.Random(6)
    words = ["someone@example.com", "4242 4242 4242 4242", "192.168.1.10", "王小明", "alpha", "a" * 30, "0912-345-678", "\n", "東京", "🙂", "2001:db8::1", "ab"]
    made = [(n, " ".join(draw.choice(words) for _ in range(size))) for n, size in enumerate([0, 1, 5, 40, 300, 900])]
    return spark.createDataFrame([*made, (10, None), (11, ""), (12, "ab" * 700), (13, "a" * 1500 + " b")], "doc_id int, text string").repartition(3).cache()


def whole(texts, rules):
    found = each(texts, candidates(F.coalesce("text", F.lit("")), rules), "doc_id", name="s")
    return found.select("doc_id", "s.start", "s.end", "s.rule_ord", "s.rule_id", "s.category", "s.value")


@pytest.mark.parametrize("width,margin", [(200, 150), (1000, 200)])
def test_windows_find_what_the_whole_text_has(spark, texts, width, margin):
    rules = [*builtin_rules("email", "ipv4", "zh-name", "credit-card"), custom_rule("c-1", "pairs", "識別碼", "aba?"), custom_rule("c-2", "words", "公司", "[a-z]{9,}")]
    assert rows(match_long(texts, "doc_id", rules=rules, width=width, margin=margin)) == rows(whole(texts, rules))


def test_edges_that_do_not_settle_are_joined(spark, texts):
    # A match of any length, and one whose place depends on all before it.
    rules = [custom_rule("c-1", "run", "識別碼", "a+"), custom_rule("c-2", "threes", "公司", "[ab]{3}")]
    assert rows(match_long(texts, "doc_id", rules=rules, width=64, margin=40)) == rows(whole(texts, rules))


def test_items(spark, texts):
    got = detect_long(texts, "doc_id", width=300, margin=200)
    assert rows(got) == rows(item_table(detect(texts), "doc_id").select(got.columns))


def test_cores_and_empty_tables(spark, texts):
    cores = cores_of(texts, ["doc_id"], "text", 100).groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("n", "core")))["core"], "").alias("text"))
    assert rows(cores) == rows(texts.where("text <> ''"))
    assert match_long(texts.limit(0), "doc_id").collect() == []
    with pytest.raises(ValueError):
        match_long(texts, "doc_id", width=10, margin=11)


def test_spans_of_settled_windows_are_written_once(spark, monkeypatch):
    written, real = [], windows.materialize

    def counted(df, name):
        table = real(df, name)
        written.extend([table.count()] if name == "spans" else [])
        return table

    monkeypatch.setattr(windows, "materialize", counted)
    df = spark.createDataFrame([(1, "bb " * 200), (2, "a" * 150)], "id int, text string")
    rules = [custom_rule("c-1", "runs", "識別碼", "[ab]+")]
    assert rows(match_long(df, "id", rules=rules, width=100, margin=50).select("id", "start")) == rows(spark.createDataFrame([*((1, 3 * n) for n in range(200)), (2, 0)], "id int, start int"))
    assert written[0] > 200 and max(written[1:]) < 10
