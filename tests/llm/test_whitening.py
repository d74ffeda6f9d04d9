"""Whitening against plain numpy, and the solver on hard triangles."""

import math
from collections import defaultdict

import numpy as np
import pytest

from veilframe.llm import whitening
from veilframe.llm.bidiagonal import right_vectors
from veilframe.llm.queries_vectors import op11_qd_whitening

SF = "/root/testdata/sf0.01"


def whole(v):
    if not v or any(c is None or not math.isfinite(c) for c in v):
        return None
    x = tuple(math.floor(64 * c) + 1_000_000 for c in v)
    return x if all(-(2**63) <= c - 1_000_000 and c < 2**63 for c in x) else None


def check(got, rows, most=16):
    """Every row and component of a result against exact sums and a plain eigen decomposition."""
    by = defaultdict(list)
    for i, v in rows:
        x = whole(v)
        if x is not None:
            by[len(x)].append((i, x))
    seen = defaultdict(list)
    for r in got:
        seen[r["n"], r["deviation"]].append(r)
    total = 0
    for dim, members in by.items():
        fit = sorted({x for _, x in members})
        n, sums = len(fit), [sum(c) for c in zip(*fit)]
        centre = lambda x: np.array([c - s // n - (s % n) / n for c, s in zip(x, sums)])
        values, axes = np.linalg.eigh(np.cov(np.array([centre(x) for x in fit]).T.reshape(dim, n), bias=True).reshape(dim, dim))
        values, axes = values[::-1], axes[:, ::-1]
        kept = min(most, int((values > 1e-12 * max(values[0], 1e-300)).sum())) if values[0] > 0 else 0
        total += kept * len(members)
        signs = {}
        for i, x in members:
            deviation = sum((n * c - s) ** 2 for c, s in zip(x, sums))
            mine = [r for r in seen[n, deviation if deviation < 2**63 else None] if r["vec_id"] == i]
            for k in range(kept):
                plain = float(centre(x) @ axes[:, k]) / math.sqrt(values[k])
                near = [r for r in mine if r["component"] == k + 1 and abs(abs(r["whitened"]) - abs(plain)) < 1e-6 * max(1, abs(plain))]
                assert near, (i, dim, k)
                r = near[0]
                if abs(plain) > 1e-3 and len(mine) == kept:
                    assert signs.setdefault(k, r["whitened"] * plain > 0) == (r["whitened"] * plain > 0)
                assert abs(r["explained"] / (values[k] / values.sum()) - 1) < 1e-6
                assert r["identity_error"] < 1e-9
    assert len(got) == total


def hard_rows(dim=5):
    draw = np.random.default_rng(2)
    nan, inf = float("nan"), float("inf")
    rows = [(i, (draw.normal(size=dim) * [3, 2, 1, 0.5, 0.2]).tolist()) for i in range(120)]
    rows += [(200 + i, rows[4][1]) for i in range(40)] + [(5, rows[5][1]), (5, rows[6][1]), (None, rows[7][1]), (None, [1.0] * dim)]
    rows += [(300, None), (301, []), (302, [nan] * dim), (303, [inf] + [0.0] * (dim - 1)), (304, [None] + [0.0] * (dim - 1)), (305, [1e300] * dim), (306, [0.0] * dim)]
    rows += [(400 + i, [float(i % 7), float(i % 3)]) for i in range(20)] + [(500, [1.0, 2.0, 3.0])] + [(600 + i, [2.5] * 4) for i in range(5)] + [(700 + i, [float(i)]) for i in range(3)]
    return rows


@pytest.mark.parametrize("sizes", [{}, {"BLOCK_ROWS": 3, "HELD_BYTES": 200, "MERGE_BYTES": 1, "MODEL_NUMBERS": 40}])
def test_whiten(spark, monkeypatch, sizes):
    for name, value in sizes.items():
        monkeypatch.setattr(whitening, name, value)
    rows = hard_rows()
    df = spark.createDataFrame([(i, v, 1, "x", 2) for i, v in rows], "vec_id long, embedding array<double>, n int, x string, dim int")
    got = whitening.whiten(df)
    assert ", ".join(f"{n} {t}".replace("bigint", "long") for n, t in got.dtypes) == whitening.RESULT
    check(got.collect(), rows)
    assert whitening.whiten(df.limit(0)).collect() == []
    assert whitening.whiten(df.where("vec_id between 600 and 610")).collect() == []


def test_large_entries_keep_exact_deviations(spark):
    rows = [(0, [2.0**40, 1.0]), (1, [2.0**40 + 1, -1.0]), (2, [2.0**40 - 3, 0.5]), (3, [2.0**55, 2.0**20]), (4, [-(2.0**55), 2.0])]
    got = whitening.whiten(spark.createDataFrame(rows[:3], "vec_id long, embedding array<double>")).collect()
    check(got, rows[:3])
    far = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {r["deviation"] for r in far} == {None} and {r["n"] for r in far} == {5}


def test_query(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    check(op11_qd_whitening(spark, SF).collect(), rows)


def judge(x, most=16):
    d = x.shape[1]
    r = np.linalg.qr(np.vstack((x, np.zeros((d, d)))), mode="r")
    every, values, vectors = right_vectors(r, most)
    plain = np.concatenate((np.linalg.svd(x, compute_uv=False) ** 2, np.zeros(d)))[:d]
    assert np.abs(every - plain).max() <= 1e-12 * max(plain.max(), 1e-300)
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max(initial=0) < 1e-11
    w = x @ vectors / np.sqrt(values)
    assert np.abs(w.T @ w - np.eye(len(values))).max(initial=0) < 1e-9
    return len(values)


def test_solver():
    draw = np.random.default_rng(7)
    assert judge(draw.normal(size=(300, 64))) == 16
    assert judge(draw.normal(size=(300, 64)) * np.logspace(0, -6, 64)) == 16
    assert judge(np.eye(40)) == 16
    assert judge(np.linalg.qr(draw.normal(size=(48, 48)))[0] * 3) == 16
    assert judge(draw.normal(size=(60, 5)) @ draw.normal(size=(5, 30))) == 5
    assert judge(np.zeros((4, 6))) == 0
    assert judge(draw.normal(size=(1, 9))) == 1
    near = np.diag(np.abs(np.arange(-10, 11)) + 2.0) + np.diag(np.ones(20), 1) + np.diag(np.ones(20), -1)
    assert judge(np.linalg.cholesky(near).T) == 16
    for k in range(150):
        x = draw.integers(-2, 3, size=(int(draw.integers(1, 40)), int(draw.integers(1, 20)))).astype(float)
        if k % 3 == 0:
            x[:, :x.shape[1] // 2] = 0
        assert judge(x) == min(16, np.linalg.matrix_rank(x))
