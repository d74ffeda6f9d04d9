"""Queries of the operators on embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veilframe.llm import cosine, topk, whitening


def op4_pca_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cosine.near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), threshold=0.95)


def op7_histogram_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return topk.top_k(vectors, vectors.where("vec_id % 50 = 0"), k=5, scale=256)


def op11_qd_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), most=16)


# The scores are whole numbers, so SQL finds the same rows; one row of the cross product for each score.
OP7_SQL = """
with v as (
    select row_number() over () as rid, vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as v from embeddings
    where vec_id is not null and embedding is not null
      and list_count(embedding) = len(embedding) and len(list_filter(embedding, lambda x: not isfinite(x))) = 0),
s as (
    select q.rid, q.vec_id as query_id, c.vec_id, list_inner_product(q.v, c.v)::bigint as score
    from v q join v c on q.rid <> c.rid where q.vec_id % 50 = 0),
r as (select rid, query_id, row_number() over (partition by rid order by score desc, vec_id) as n, vec_id, score from s)
select query_id, n::int as rank, vec_id, score from r where n <= 5
"""

OP4_SQL = """
with recursive v as (
    select vec_id, embedding::double[] as v from embeddings
    where vec_id is not null and embedding is not null and list_count(embedding) = len(embedding)
      and len(list_filter(embedding, lambda x: not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
links as (
    select a.vec_id as a, b.vec_id as b from v a join v b on a.vec_id <> b.vec_id and len(a.v) = len(b.v)
    where list_cosine_similarity(a.v, b.v) >= 0.95),
reach as (
    select vec_id as a, vec_id as b from embeddings
    union
    select r.a, l.b from reach r join links l on r.b = l.a),
least as (select a, min(b) as component_id from reach group by a),
counts as (select a, count(*) as n from links group by a)
select e.vec_id, coalesce(n, 0)::bigint as n_links, component_id, e.vec_id = component_id as kept
from embeddings e join least on least.a = e.vec_id left join counts on counts.a = e.vec_id
"""
