"""Near vectors and top-k search against plain numpy."""

import math

import duckdb
import numpy as np
import pytest

from test_duplicates import plain_components
from tools.check import compare
from veilframe.llm import cosine, topk
from veilframe.llm.queries_vectors import OP4_SQL, OP7_SQL, op4_pca_near_vectors, op7_histogram_top_k

SF = "/root/testdata/sf0.01"


def fine(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def plain_near(rows, t):
    good = [i for i, (_, v) in enumerate(rows) if fine(v) and any(v)]
    links = []
    for p, i in enumerate(good):
        for j in good[:p]:
            a, b = (np.array(rows[n][1], float) / max(map(abs, rows[n][1])) for n in (i, j))
            if len(a) == len(b) and a @ b / math.sqrt((a @ a) * (b @ b)) >= t:
                links.append((i, j))
    root = plain_components(range(len(rows)), links)
    least, count = {}, [0] * len(rows)
    for i, (v, _) in enumerate(rows):
        if v is not None:
            least[root[i]] = min(v, least.get(root[i], v))
    for i, j in links:
        count[i] += 1
        count[j] += 1
    return sorted(map(repr, [(v, count[i], least.get(root[i]), v is not None and least.get(root[i]) == v) for i, (v, _) in enumerate(rows)]))


def hard_rows(seed=0, dim=8):
    draw = np.random.default_rng(seed)
    rows = [(i, draw.normal(size=dim).tolist()) for i in range(150)]
    for i in range(150, 300):
        base = np.array(rows[int(draw.integers(0, 40))][1])
        rows.append((i, (base + draw.normal(size=dim) * 0.2).tolist()))
    rows += [(300 + i, rows[3][1]) for i in range(60)] + [(400 + i, (np.array(rows[5][1]) * 3.0).tolist()) for i in range(5)]
    nan, inf = float("nan"), float("inf")
    rows += [(500, None), (501, []), (502, [0.0] * dim), (503, [nan] * dim), (504, [inf] + [1.0] * (dim - 1)), (505, [None] + [1.0] * (dim - 1)), (506, [1.0, 2.0]),
             (507, [2.0, 4.0]), (None, rows[3][1]), (None, [9.0] + [0.0] * (dim - 1)), (2, rows[2][1]), (508, []), (509, [1e200] * dim), (510, [1e-200] * dim)]
    return rows


@pytest.mark.parametrize("block,tile", [(8192, 512), (64, 16)])
def test_near_vectors(spark, monkeypatch, block, tile):
    monkeypatch.setattr(cosine, "TILE", tile)
    rows = hard_rows()
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, kept string")
    got = sorted(repr(tuple(r)) for r in cosine.near_vectors(df, 0.95, block).collect())
    assert got == plain_near(rows, 0.95)
    assert cosine.near_vectors(df.limit(0), 0.95).collect() == []


def test_tile_pairs_leave_nothing_out():
    draw = np.random.default_rng(4)
    for dim in (1, 5, 16, 17, 64):
        x = cosine.unit(draw.normal(size=(90, dim)))
        y = cosine.unit(np.concatenate((x[:40] + draw.normal(size=(40, dim)) * 0.05, draw.normal(size=(50, dim)))))
        for t in (0.5, 0.9, 0.97):
            assert set(zip(*map(np.ndarray.tolist, cosine.tile_pairs(x, y, t)))) == set(zip(*map(np.ndarray.tolist, np.nonzero(x @ y.T >= t))))


def plain_top(rows, is_query, k, scale):
    whole = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if i is not None and fine(v)]
    out = []
    for n, (q, v) in enumerate(whole):
        if is_query(q):
            score = lambda w: max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(v, w))))
            scored = sorted((-score(w), i) for m, (i, w) in enumerate(whole) if m != n and len(w) == len(v))
            out += [(q, p + 1, i, -s) for p, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def test_top_k_of_rows_that_share_an_id(spark):
    rows = [(1, [2.0, 0.0]), (1, [3.0, 0.0]), (2, [1.0, 0.0]), (1, [3.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.top_k(df, df.where("vec_id = 2"), 5, 256).collect()
    assert sorted(map(tuple, got)) == [(2, 1, 1, 196608), (2, 2, 1, 196608), (2, 3, 1, 131072)]
    assert sorted(map(tuple, topk.top_k(df, df, 2, 256).collect())) == plain_top(rows, lambda q: True, 2, 256)


def test_top_k_over_the_whole_range_of_longs(spark):
    rows = [(i, [float(2**30) * s, float(i)]) for i, s in enumerate([1, -1, 1, -1, 0.98, -0.97, 0.99])] + [(50, [float(2**28 * 15) / 4, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.top_k(df, df, 8, 2).collect()
    assert max(abs(r["score"]) for r in got) > 2**61
    assert sorted(map(tuple, got)) == plain_top(rows, lambda q: True, 8, 2)
    assert sorted(map(tuple, topk.top_k(df, df, 8, 64).collect())) == plain_top(rows, lambda q: True, 8, 64)


def test_pairs_exactly_at_the_threshold_are_linked(spark):
    # (19, 0) and (18.05, ...) scaled: cosine 19/20 from whole numbers 19, 20 and the root of 39.
    draw = np.random.default_rng(3)
    rows = []
    for n in range(300):
        k, at = float(2 ** int(draw.integers(0, 5))), draw.permutation(12)
        a, b = np.zeros(12), np.zeros(12)
        a[at[0]] = 20 * k
        b[at[0]] = 19
        b[at[1:6]] = [5, 3, 2, 1, 0]
        b[at[7]] = 0
        rows += [(2 * n, a.tolist()), (2 * n + 1, b.tolist())]
    exact = [(i, v) for i, v in rows]
    df = spark.createDataFrame(exact, "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r["n_links"] for r in cosine.near_vectors(df, 0.95).collect()}
    x = np.array([v for _, v in exact])
    plain = (x @ x.T) / np.sqrt(np.outer((x * x).sum(1), (x * x).sum(1))) >= 0.95
    assert [got[i] for i in range(len(exact))] == (plain.sum(axis=1) - 1).tolist()
    assert plain[0, 1]


@pytest.mark.parametrize("sizes", [{}, {"candidates_per_block": 40, "queries_per_block": 7, "bins": 10}])
def test_top_k(spark, sizes):
    rows = [r for r in hard_rows(1, 6) if r[0] not in (509,)]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, score int")
    got = topk.top_k(df, df.where("vec_id % 7 = 0 or vec_id > 490"), 5, 256, **sizes).collect()
    assert sorted(map(tuple, got)) == plain_top(rows, lambda q: q % 7 == 0 or q > 490, 5, 256)
    assert topk.top_k(df.limit(0), df, 5).collect() == []


def test_top_k_of_large_numbers(spark):
    rows = [(i, [float(i) * 1e12, 3.0 - i]) for i in range(12)] + [(20, [1e200, 1.0]), (21, [-1e200, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.top_k(df, df, 3, 256).collect()
    assert sorted(map(tuple, got)) == plain_top(rows, lambda q: True, 3, 256)


@pytest.mark.parametrize("query,sql", [(op4_pca_near_vectors, OP4_SQL), (op7_histogram_top_k, OP7_SQL)])
def test_queries_against_sql(spark, query, sql):
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{SF}/embeddings.parquet'")
    verdict, _ = compare(spark, con, SF, query, sql)
    assert verdict.startswith("ok"), verdict
