"""Streams of files that fail in the middle and start again."""

import pytest
from pyspark.errors import StreamingQueryException

from veilframe.operators.rules import builtin_rules
from veilframe.plans.pipelines import deidentify
from veilframe.streaming.stream import redact_new_files

SCHEMA = "doc_id long, text string"


def test_restart_after_a_failed_batch(spark, tmp_path):
    source, rules = tmp_path / "in", builtin_rules("email")
    texts = [(n, None if n == 4 else "" if n == 5 else f"to u{n}@x.tw.") for n in range(12)] + [(3, "again u3@x.tw"), (None, "n@x.tw")]
    docs = spark.createDataFrame(texts, SCHEMA)
    docs.repartition(6).write.parquet(str(source))
    broken = sorted(source.glob("part-*"))[3]
    good = broken.read_bytes()
    for crc in source.glob(".*.crc"):
        crc.unlink()
    broken.write_bytes(b"no table")
    run = lambda: redact_new_files(spark, str(source), str(tmp_path / "out"), SCHEMA, rules=rules, files=1)
    with pytest.raises(StreamingQueryException):
        run()
    broken.write_bytes(good)
    want = sorted(map(repr, deidentify(docs, rules=rules, style="label").select("doc_id", "redacted").collect()))
    assert sorted(map(repr, run().collect())) == want
    assert sorted(map(repr, run().collect())) == want
    spark.createDataFrame([(99, "z@x.tw")], SCHEMA).write.mode("append").parquet(str(source))
    assert len(run().collect()) == len(want) + 1


def test_empty_source(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "in"))
    assert redact_new_files(spark, str(tmp_path / "in"), str(tmp_path / "out"), SCHEMA, rules=builtin_rules("email")).isEmpty()
