"""Tasks stay small however many rows a table has."""

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veilframe import session
from veilframe.plans import layouts


def test_rows_of_a_task_are_bounded(spark):
    rows = spark.range(4000).select((F.col("id") % 1000).alias("key"), "id")
    dealt = session.by_key(rows, "key", rows=100)
    assert dealt.rdd.getNumPartitions() == 40
    numbered = dealt.withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy("id")))
    assert numbered.where("n = 4").count() == 1000
    assert numbered._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_layout_queries_deal_lines_by_rows(spark, monkeypatch):
    monkeypatch.setattr(layouts, "by_key", lambda df, *keys: session.by_key(df, *keys, rows=100))
    lines = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    parts = layouts.line_key(lines).select("l_orderkey", F.spark_partition_id().alias("p"))
    assert parts.select("p").distinct().count() >= lines.count() // 200
    assert parts.groupBy("l_orderkey").agg(F.count_distinct("p").alias("n")).where("n > 1").isEmpty()


def test_false_alarms_meet_in_one_exchange(spark, tmp_path):
    from veilframe.operators import evaluate

    truth = spark.createDataFrame([
        (1, "printed", "a", "12 34"), (1, "manual", "a", "99"), (1, "printed", "b", "77"), (2, "printed", "a", "abcdef"), (None, "printed", "a", "n"),
        (2, "printed", "a", None), (2, "printed", None, "x9")], "page int, kind string, category string, value string")
    found = spark.createDataFrame([
        (1, "a", "12 35"), (1, "a", "12 35"), (1, "b", "99"), (1, "a", "77"), (2, "b", "abcdeg"), (2, "a", "abcdeg"), (None, "a", "n"), (2, "a", None), (2, None, "x8")],
        "page int, category string, value string")
    alarms = evaluate.false_alarms(truth, found, "page", 3)
    assert sorted(map(str, map(tuple, alarms.collect()))) == sorted(map(str, [
        (1, "a", "12 35", True), (2, "b", "abcdeg", False), (2, "a", "abcdeg", True), (None, "a", "n", False), (2, "a", None, False), (2, None, "x8", False)]))
    # What is neither an alarm nor missed is settled before the two are joined.
    assert alarms._jdf.queryExecution().optimizedPlan().toString().count("Join") == 2
