"""Query of the operator on repeated lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.llm import line_dedup


def op12_line_bitmaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return line_dedup.drop_repeated_lines(docs, least=10).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP12_SQL = """
with cut as (select doc_id, string_split(coalesce(text, ''), chr(10)) as l from documents),
lines as (select doc_id, unnest(l) as line, unnest(range(len(l))) as pos from cut),
keyed as (
    select *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from lines),
held as (select key, min(doc_id) as first_id from keyed where length(key) >= 10 group by key having count(distinct doc_id) > 1),
judged as (
    select k.doc_id, k.line, k.pos, coalesce(k.doc_id <> h.first_id, false) as dropped
    from keyed k left join held h on k.key = h.key)
select doc_id, count(*) as n_lines, count(*) filter (where dropped) as n_dropped,
    sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not dropped), '')) as kept_sha256
from judged group by doc_id
"""
