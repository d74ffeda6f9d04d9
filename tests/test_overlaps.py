"""Overlap resolution on a table of spans against the in-row form."""

import random

import pytest
from pyspark.sql import functions as F

from veilframe.functions.text import resolve_overlaps
from veilframe.operators import overlaps
from veilframe.operators.overlaps import select_spans

ELEMENT = "struct<start:int,end:int,rule_ord:int,value:string>"


def in_row(spark, rows):
    df = spark.createDataFrame(rows, "doc string, start int, end int, rule_ord int, value string")
    packed = df.groupBy("doc").agg(F.collect_list(F.struct("start", "end", "rule_ord", "value")).alias("s"))
    out = packed.select("doc", F.explode(resolve_overlaps(F.col("s"), ELEMENT)).alias("k")).select("doc", "k.*")
    return sorted(map(tuple, out.collect()), key=repr)


def by_table(spark, rows, **more):
    df = spark.createDataFrame(rows, "doc string, start int, end int, rule_ord int, value string").repartition(5)
    return sorted(map(tuple, select_spans(df, "doc", **more).collect()), key=repr)


def random_rows(seed):
    draw = random.Random(seed)
    rows = []
    for doc in ("a", "b", None, "c"):
        for _ in range(150):
            start, size = draw.randint(0, 400), draw.choice([1, 2, 3, 4, 5, 8, 9, 16, 31, 33, 120])
            rows.append((doc, start, start + size, draw.randint(0, 3), f"{doc}{start}"))
    rows += rows[:20] + [("lonely", 5, 9, 1, "x"), ("touch", 0, 4, 0, "x"), ("touch", 4, 8, 0, "y"), ("touch", 8, 9, 0, "z"), ("nest", 0, 64, 2, "x"), ("nest", 10, 20, 0, "y"), ("nest", 63, 65, 0, "z")]
    return list(dict.fromkeys(rows))


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("rounds", [0, 1, 12])
def test_random_spans(spark, seed, rounds):
    rows = random_rows(seed)
    assert by_table(spark, rows, rounds=rounds) == in_row(spark, rows)


@pytest.mark.parametrize("rounds, held", [(0, 3), (1, 0), (12, 3), (12, 1 << 16)])
def test_places_beyond_ints(spark, rounds, held):
    """Texts of more than 2^31, 2^32 and 2^40 characters."""
    rows, ahead = random_rows(4), {"a": 3 << 30, "b": (1 << 32) - 200, "c": 1 << 40}
    far = [(doc, start + ahead.get(doc, 0), end + ahead.get(doc, 0), *rest) for doc, start, end, *rest in rows]
    df = spark.createDataFrame(far, "doc string, start long, end long, rule_ord int, value string").repartition(5)
    got = [(doc, start - ahead.get(doc, 0), end - ahead.get(doc, 0), *rest) for doc, start, end, *rest in select_spans(df, "doc", rounds=rounds, held=held).collect()]
    assert sorted(got, key=repr) == in_row(spark, rows)


def test_joined_texts_beyond_ints(spark, monkeypatch, tmp_path):
    from veilframe.plans import detection

    draw = random.Random(6)
    words = ["word", "letters", "longestword", "abcdefghijk", "12", "number"]
    docs = [(n, " ".join(draw.choice(words) for _ in range(40)), "ab"[n % 2], "s", 0) for n in range(40)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    plain, far = detection.running_sum, 3 << 30
    near = sorted(map(tuple, detection.resolve_overlaps_joined(spark, str(tmp_path)).collect()))
    monkeypatch.setattr(detection, "running_sum", lambda *args: plain(*args).withColumn(args[-1], F.col(args[-1]) + far))
    got = sorted(map(tuple, detection.resolve_overlaps_joined(spark, str(tmp_path)).collect()))
    assert got == [(lang, start + far, end + far, *rest) for lang, start, end, *rest in near] and got


def test_chains_end_and_are_swept(spark):
    equal = [("chain", 2 * n, 2 * n + 3, 0, "x") for n in range(3000)]
    falling = [("falling", 40 * n - n * n // 200, 40 * n - n * n // 200 + 60 - n // 100, 0, "x") for n in range(1500)]
    assert by_table(spark, equal + falling) == in_row(spark, equal + falling)


@pytest.mark.parametrize("batch, held", [(1, 0), (7, 3), (40, 25), (10_000, 1 << 16)])
def test_islands_across_batches_and_partitions(spark, batch, held):
    rows = random_rows(3) + [("chain", 2 * n, 2 * n + 3, 0, "x") for n in range(400)] + [("apart", 5 * n, 5 * n + 3, 0, "x") for n in range(400)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        assert by_table(spark, rows, held=held) == in_row(spark, rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_short_islands_are_not_laid_on_grids(spark, monkeypatch):
    laid = []
    plain = overlaps._in_rounds
    monkeypatch.setattr(overlaps, "_in_rounds", lambda items, *more: laid.append(items.count()) or plain(items, *more))
    rows = [(doc, 10 * n, 10 * n + 7 + n % 5, 0, "x") for doc in "abc" for n in range(2000)]
    assert by_table(spark, rows) == in_row(spark, rows)
    assert sum(laid) < 100


def test_many_spans_of_one_text(spark):
    n = 1_000_000
    made = spark.range(n, numPartitions=8).select(
        F.lit(1).alias("doc"), F.pmod(F.xxhash64("id"), F.lit(4 * n)).cast("int").alias("start"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(40)).alias("size"), F.lit(0).alias("rule_ord"))
    rows = made.select("doc", "start", (F.col("start") + 1 + F.col("size")).cast("int").alias("end"), "rule_ord").distinct()
    kept = select_spans(rows, "doc").toPandas()
    plain = overlaps.sweep(rows.select("start", "end").toPandas())
    assert sorted(zip(kept["start"], kept["end"])) == sorted(zip(plain["start"], plain["end"]))


def test_empty_and_odd_rows(spark):
    df = spark.createDataFrame([], "doc string, start int, end int, rule_ord int, best int, side string")
    assert select_spans(df, "doc").collect() == []
    odd = spark.createDataFrame([("a", 3, 3, 0, 1, "x"), ("a", 3, 5, 1, 2, "y"), ("a", 3, 5, 0, 3, "z")], df.schema)
    assert list(map(tuple, select_spans(odd, "doc").collect())) == [("a", 3, 5, 0, 3, "z")]


def test_chain_in_a_row_is_linear(spark):
    import time

    took = {}
    for n in (4000, 4000, 8000):
        spans = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct(
            (2 * i).alias("start"), (2 * i + 3).alias("end"), F.lit(0).alias("rule_ord"), F.lit("x").alias("value")))
        df = spark.range(1).select(spans.alias("s")).repartition(1)
        started = time.time()
        out = df.select(F.size(resolve_overlaps(F.col("s"), ELEMENT)).alias("n"), F.size("s").alias("m")).first()
        took[n] = time.time() - started
        assert out["n"] == n // 2
    assert took[8000] < 4 * took[4000] + 1
