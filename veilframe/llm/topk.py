"""Exact top-k search by distributed selection on score histograms.

Blocks of queries meet blocks of candidates and score everything. First the
k-th best score of every query is located: each query has an interval that is
known to hold it and the number of scores above; all blocks count their scores
in equal bins of the interval, the counts are summed, and the bin that holds the
k-th becomes the new interval, until it is a single whole number. Blocks only
report bins from their own k-th best score up: the k-th of all can't be below.
Then every block hands on its scores above that number, and of those equal to
it the smallest ids, as many as can be needed.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veilframe.llm.vectors import packed, unpacked, usable
from veilframe.session import materialize

CANDIDATES = 4096  # of a block
QUERIES = 1024
BINS = 4096
LEAST, LONG = -(2**63), 2**63 - 1


def top_k(vectors: DataFrame, queries: DataFrame, k: int, scale: int = 256, candidates_per_block: int = CANDIDATES,
          queries_per_block: int = QUERIES, bins: int = BINS) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` best candidates of every query.

    ``vectors(vec_id, embedding)`` are the candidates; the rows whose id is one
    of ``queries(vec_id)`` are the queries. Components become floor(scale * x);
    the score is the inner product as a long; one that no long holds counts as
    the nearest long. Every row is a candidate of every query but itself, also
    rows that share an id with each other or with the query; each row of a
    repeated id is a query of its own. Ties go to the smaller vec_id. Null
    vectors, and those with null or non-finite components, and null ids take no
    part; vectors of another length than the query's are no candidates; a query
    with fewer than ``k`` candidates gets them all, one without any, no row.
    Vectors and queries without rows give an empty table.
    """
    own = vectors.where(F.col("vec_id").isNotNull() & usable("embedding")).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    # Above the range of longs floor gives no right number; doubles are whole there anyway.
    exact = F.transform("embedding", lambda x: F.when(F.abs(x.cast("double")) < 2.0**52, F.floor(x.cast("double") * scale).cast("double")).otherwise(x.cast("double") * scale))
    # Rows are told apart by numbers that rise with their ids, so the smaller number is the smaller id.
    numbered = own.orderBy("vec_id").withColumn("row", F.monotonically_increasing_id())
    whole = materialize(numbered.select("row", "vec_id", F.size("embedding").alias("dim"), exact.alias("v")), "vectors")
    asked = whole.join(queries.select(F.col("vec_id").cast("long").alias("vec_id")).distinct(), "vec_id", "left_semi").select(*whole.columns)
    found = whole.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).join(
        asked.groupBy("dim").agg(F.count(F.lit(1)).alias("q"), F.max(F.aggregate(
            "v", F.lit(0.0), lambda a, x: a + x * x)).alias("q2")), "dim").join(
        whole.groupBy("dim").agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("c2")), "dim")
    shape = materialize(found.select(
        "dim", F.ceil(F.col("n") / candidates_per_block).alias("c_blocks"), F.ceil(F.col("q") / queries_per_block).alias("q_blocks"),
        F.sqrt("q2").alias("q_norm"), F.sqrt("c2").alias("c_norm")), "shape")
    top = shape.agg(F.max(F.col("q_norm") * F.col("c_norm"))).first()[0]
    if top is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    bound = int(top * 1.0001 + 2) if top < 2.0**64 else -LEAST
    lowest, highest = max(-bound, LEAST), min(bound, LONG)

    blocked = lambda rows, count: rows.join(shape, "dim").withColumn(
        "block", F.pmod(F.xxhash64("row"), F.col(count)))
    c = materialize(packed(blocked(whole, "c_blocks"), ["dim", "block"], "row", "v"), "candidates")
    q = materialize(packed(blocked(asked, "q_blocks"), ["dim", "block"], "row", "v"), "queries")
    every = lambda rows, own_name, other, count: rows.join(shape.select("dim", count), "dim").withColumn(
        other, F.explode(F.sequence(F.lit(0).cast("long"), F.col(count) - 1))).withColumnRenamed("block", own_name)
    fields = ["dim", "qb", "cb", "kind", "n", "idents", "matrix", "state"]
    none = F.lit(None).cast("binary")
    c_rows = every(c, "cb", "qb", "q_blocks").withColumns({"kind": F.lit("c"), "state": none}).select(*fields)
    q_plain = every(q, "qb", "cb", "c_blocks").withColumns({"kind": F.lit("q"), "state": none}).select(*fields)

    state = materialize(blocked(asked, "q_blocks").select(
        "dim", "block", F.col("row").alias("query_id"), F.lit(lowest).cast("long").alias("low"), F.lit(0).cast("long").alias("above")), "state")
    width = highest - lowest + 1
    while width > 1:
        step = -(-width // bins)
        hist = _passes(c_rows, q_plain, state, every).applyInPandas(_counter(k, width, step), "query_id long, bin long, n long")
        counts = hist.groupBy("query_id", "bin").agg(F.sum("n").alias("n"))
        down = Window.partitionBy("query_id").orderBy(F.col("bin").desc())
        run = F.sum("n").over(down)
        held = counts.withColumns({"to": run, "before": run - F.col("n")}).join(state, "query_id").where(
            (F.col("above") + F.col("before") < k) & (F.col("above") + F.col("to") >= k))
        # With fewer than k candidates no bin holds the k-th: the interval becomes its lowest number.
        hit = held.select("query_id", (F.col("low").cast("decimal(38,0)") + F.col("bin") * F.lit(step).cast("decimal(25,0)")).cast("long").alias("_low"), (F.col("above") + F.col("before")).alias("_above"))
        state = materialize(state.join(hit, "query_id", "left").select(
            "dim", "block", "query_id", F.coalesce("_low", "low").alias("low"), F.coalesce("_above", "above").alias("above")), "state")
        width = step
    chosen = _passes(c_rows, q_plain, state, every).applyInPandas(
        lambda rows: _choose(rows, k), "query_id long, row long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "row"))
    best = chosen.withColumn("rank", rank).where(F.col("rank") <= k)
    ids = whole.select("row", "vec_id")
    named = best.join(ids, "row").select(F.col("query_id").alias("row"), "rank", "vec_id", "score")
    return named.join(ids.withColumnRenamed("vec_id", "query_id"), "row").select("query_id", "rank", "vec_id", "score")


def _passes(c_rows: DataFrame, q_rows: DataFrame, state: DataFrame, every):
    """Candidates, queries and the queries' state of every pair of blocks, grouped."""
    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("query_id")
        data = group[["low", "above"]].to_numpy("<i8").tobytes()
        return pd.DataFrame({"dim": [group["dim"].iloc[0]], "block": [group["block"].iloc[0]], "n": [len(group)], "state": [data]})

    kinds = dict(state.dtypes)
    blocks = state.groupBy("dim", "block").applyInPandas(pack, f"dim {kinds['dim']}, block {kinds['block']}, n long, state binary")
    s_rows = every(blocks, "qb", "cb", "c_blocks").withColumns({
        "kind": F.lit("s"), "idents": F.lit(None).cast("binary"), "matrix": F.lit(None).cast("binary")}).select(*c_rows.columns)
    return c_rows.unionByName(q_rows).unionByName(s_rows).groupBy("dim", "qb", "cb")


def _scores(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
    """Numbers of queries and candidates, whole scores, which of them count, and the state (low, above) of the queries."""
    kinds = {r["kind"]: r for _, r in rows.iterrows()}
    if len(kinds) < 3:
        return None
    (q_ids, q), (c_ids, c) = unpacked(kinds["q"]), unpacked(kinds["c"])
    state = np.frombuffer(kinds["s"]["state"], "<i8").reshape(-1, 2)
    most = (np.abs(q).max(initial=0) * np.abs(c).max(initial=0)) * max(1, q.shape[1])
    if most < 2.0**53:
        scores = (q @ c.T).astype(np.int64)
    else:
        product = np.array([[int(x) for x in r] for r in q], object).reshape(q.shape) @ np.array([[int(x) for x in r] for r in c], object).reshape(c.shape).T
        scores = np.clip(product, LEAST, LONG).astype(np.int64)
    return q_ids, c_ids, scores, q_ids[:, None] != c_ids[None, :], state


def _counter(k: int, width: int, step: int):
    return lambda rows: _count(rows, k, width, step)


def _count(rows: pd.DataFrame, k: int, width: int, step: int) -> pd.DataFrame:
    made = _scores(rows)
    if made is None:
        return pd.DataFrame({"query_id": [], "bin": [], "n": []}).astype("int64")
    q_ids, _, scores, counts, state = made
    low = state[:, :1]
    # Differences of longs can need all 64 bits.
    apart = scores.view(np.uint64) - np.ascontiguousarray(low).view(np.uint64)
    inside = counts & (scores >= low)
    if width < 2**64:
        inside &= apart < np.uint64(width)
    held = np.where(inside, (apart // np.uint64(step)).astype(np.int64), -1)
    if held.shape[1] > k:
        inside &= held >= np.partition(held, held.shape[1] - k, axis=1)[:, held.shape[1] - k][:, None]
    row, col = np.nonzero(inside)
    bins = held[row, col]
    order = np.lexsort((bins, row))
    row, bins = row[order], bins[order]
    new = np.flatnonzero(np.concatenate(([True], (np.diff(row) != 0) | (np.diff(bins) != 0)))) if len(row) else np.empty(0, int)
    return pd.DataFrame({"query_id": q_ids[row[new]], "bin": bins[new], "n": np.diff(np.append(new, len(row)))})


def _choose(rows: pd.DataFrame, k: int) -> pd.DataFrame:
    made = _scores(rows)
    if made is None:
        return pd.DataFrame({"query_id": [], "row": [], "score": []}).astype("int64")
    q_ids, c_ids, scores, counts, state = made
    kth, above = state[:, :1], state[:, 1]
    row, col = np.nonzero(counts & (scores > kth))
    tied = counts & (scores == kth)
    # Candidates are in order of their numbers and so of their ids: the first ties of a row are the smallest.
    tied &= np.cumsum(tied, axis=1) <= (k - above)[:, None]
    r2, c2 = np.nonzero(tied)
    row, col = np.concatenate((row, r2)), np.concatenate((col, c2))
    return pd.DataFrame({"query_id": q_ids[row], "row": c_ids[col], "score": scores[row, col]})
