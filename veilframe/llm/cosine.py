"""Near-duplicate vectors by tiled comparison in PCA order.

Vectors are scaled to length 1 and turned to principal axes, so the leading
dimensions carry most of every product. Sorted by the first axis they form
blocks, and pairs of blocks whose first coordinates can be near enough meet.
Inside, tile against tile, the products of the leading dimensions come first;
what the remaining ones can add is at most the product of the two suffix norms,
and a pair is dropped as soon as this cannot reach the threshold. Pairs that
come through all dimensions are links. A tile hands on how many links every
vector has, and just enough of them to hold its components together.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.llm.graph import components, united
from veilframe.llm.vectors import packed, unpacked, usable
from veilframe.operators.lookup import lookup
from veilframe.operators.ranking import numbered_rows
from veilframe.session import materialize

# Vectors from which the axes are fitted: those with the smallest hashes. Any axes give the same links.
AXES_SAMPLE = 10_000
BLOCK = 8192
TILE = 512
STEP = 16  # dimensions that are added at a time
SLACK = 1e-9  # for rounding, until the last step


def _axes(vectors: DataFrame) -> dict[int, np.ndarray]:
    """Principal axes, as columns, for every length of vector in a bounded sample."""
    found = vectors.select("embedding").orderBy(F.xxhash64("embedding")).limit(AXES_SAMPLE).toPandas()["embedding"]
    by: dict[int, list] = {}
    for v in found:
        by.setdefault(len(v), []).append(v)
    out = {}
    for dim, group in by.items():
        x = unit(np.array(group, np.float64).reshape(len(group), dim))
        out[dim] = np.linalg.eigh(x.T @ x)[1][:, ::-1]
    return out


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, in two steps so that no square overflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True, initial=1e-300)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def turned(x: np.ndarray, axes: dict[int, np.ndarray]) -> np.ndarray:
    """Unit vectors in the coordinates of the axes."""
    y = unit(x)
    return y @ axes[x.shape[1]] if x.shape[1] in axes else y


def tile_pairs(x: np.ndarray, y: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows of x and y whose product reaches ``threshold`` up to rounding; all rows have length 1."""
    dim = x.shape[1]
    if not len(x) or not len(y):
        return np.empty(0, int), np.empty(0, int)
    rest = lambda m: np.sqrt(np.maximum(0, np.cumsum((m * m)[:, ::-1], axis=1)[:, ::-1]))
    tail_x, tail_y = rest(x), rest(y)
    at = min(STEP, dim)
    part = x[:, :at] @ y[:, :at].T
    keep = part + (tail_x[:, at:at + 1] * tail_y[None, :, at] if at < dim else 0) >= threshold - SLACK
    i, j = np.nonzero(keep)
    part = part[i, j]
    while at < dim and len(i):
        to = min(at + STEP, dim)
        part = part + np.einsum("ij,ij->i", x[i, at:to], y[j, at:to])
        keep = part + (tail_x[i, to] * tail_y[j, to] if to < dim else 0) >= threshold - SLACK
        i, j, part, at = i[keep], j[keep], part[keep], to
    return i, j


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosines of the rows of x and y as they are, scaled by powers of two only, which is exact."""
    whole = lambda m: np.ldexp(m, -np.frexp(np.abs(m).max(axis=1, keepdims=True, initial=0))[1])
    x, y = whole(x), whole(y)
    return (x * y).sum(axis=1) / np.sqrt((x * x).sum(axis=1) * (y * y).sum(axis=1))


def _compare(rows: pd.DataFrame, threshold: float, axes: dict[int, np.ndarray]) -> pd.DataFrame:
    """Two blocks, or one with itself: rows (a, null, links of a) and links (a, b, null)."""
    a, b = rows["a"].iloc[0], rows["b"].iloc[0]
    blocks = {r["block"]: r for _, r in rows.iterrows()}
    (n1, plain_x), (n2, plain_y) = unpacked(blocks[a]), unpacked(blocks[b])
    x, y = (turned(m, axes) for m in (plain_x, plain_y))
    many = {k: np.asarray(r["many"], np.int64) for k, r in blocks.items()}
    first, second = np.argsort(x[:, 0], kind="stable"), np.argsort(y[:, 0], kind="stable")
    reach = np.sqrt(2 - 2 * threshold) + SLACK
    links = {k: np.zeros(len(v), np.int64) for k, v in many.items()}
    out_a, out_b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for p in range(0, len(first), TILE):
        one = first[p:p + TILE]
        for q in range(p if a == b else 0, len(second), TILE):
            two = second[q:q + TILE]
            if y[two[0], 0] > x[one[-1], 0] + reach or x[one[0], 0] > y[two[-1], 0] + reach:
                continue
            i, j = tile_pairs(x[one], y[two], threshold)
            i, j = one[i], two[j]
            # Turned coordinates are rounded; what counts is the cosine of the vectors themselves.
            keep = cosines(plain_x[i], plain_y[j]) >= threshold
            i, j = i[keep], j[keep]
            if a == b:
                # A tile with itself finds every pair twice and every vector with itself.
                keep = i < j if p == q else np.ones(len(i), bool)
                i, j = i[keep], j[keep]
            np.add.at(links[a], i, many[b][j])
            np.add.at(links[b], j, many[a][i])
            s, t = united(n1[i], n2[j])
            out_a.append(s)
            out_b.append(t)
    s, t = united(np.concatenate(out_a), np.concatenate(out_b))
    counted = [(n[links[k] > 0], links[k][links[k] > 0]) for k, n in {a: n1, b: n2}.items()]
    nodes, counts = np.concatenate([n for n, _ in counted]), np.concatenate([c for _, c in counted])
    return pd.DataFrame({
        "a": np.concatenate((nodes, s)), "b": pd.array([*[None] * len(nodes), *t.tolist()], "Int64"),
        "n": pd.array([*counts.tolist(), *[None] * len(s)], "Int64")})


def near_vectors(vectors: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row of ``vectors(vec_id, embedding)``.

    Rows with a cosine of at least ``threshold`` (above 0) are linked, copies of
    a vector too; ``n_links`` counts a row's links to other rows,
    ``component_id`` is the smallest vec_id reachable. Vectors that are null,
    empty, zero or hold null or non-finite components, and vectors of different
    lengths, have no links. A row with a null vec_id takes part but never gives
    its id and is not kept; a component of such rows alone has a null id.
    Repeated rows are all returned. An empty table gives an empty one.
    """
    nonzero = F.exists("embedding", lambda x: x.cast("double") != 0)
    fine = usable("embedding") & nonzero
    own = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
    good = own.where(fine)
    distinct = good.groupBy("embedding").agg(F.min("vec_id").alias("first_id"), F.count(F.lit(1)).alias("many"))
    nodes = materialize(distinct.withColumn("node", F.monotonically_increasing_id()), "nodes")
    axes = _axes(nodes)

    def turn(batches):
        for rows in batches:
            size = rows["embedding"].map(len)
            for dim, group in rows.groupby(size):
                x = np.stack(group["embedding"].to_numpy()).astype(np.float64)
                yield pd.DataFrame({"node": group["node"], "many": group["many"], "dim": dim, "first": turned(x, axes)[:, 0], "y": list(x)})

    placed_by = nodes.select("node", "many", "embedding").mapInPandas(turn, "node long, many long, dim int, first double, y array<double>")
    placed = materialize(numbered_rows(placed_by, ["dim"], ["first", "node"], "_n").withColumn(
        "block", F.expr(f"(_n - 1) div {block}")), "placed")
    counts = placed.groupBy("dim", "block").agg(
        F.min("first").alias("low"), F.max("first").alias("high"),
        F.array_sort(F.collect_list(F.struct("node", "many")))["many"].alias("many"))
    blocks = materialize(packed(placed, ["dim", "block"], "node", "y").join(counts, ["dim", "block"]), "blocks")

    reach = float(np.sqrt(2 - 2 * threshold)) + SLACK
    ends = blocks.select("dim", "block", "low", "high")
    last = ends.groupBy("dim").agg(F.max("block").alias("last"))
    pairs = ends.join(last, "dim").select("dim", F.col("block").alias("a"), "high", F.explode(F.sequence("block", "last")).alias("b")).join(
        ends.select("dim", F.col("block").alias("b"), F.col("low").alias("b_low")), ["dim", "b"]).where(
        F.col("b_low") <= F.col("high") + reach).select("dim", "a", "b")
    pairs = materialize(pairs, "pairs")
    data = blocks.select("dim", "block", "n", "idents", "matrix", "many")
    left = pairs.withColumn("block", F.col("a")).join(data, ["dim", "block"])
    right = pairs.where("a <> b").withColumn("block", F.col("b")).join(data, ["dim", "block"])
    met = left.unionByName(right).groupBy("dim", "a", "b").applyInPandas(lambda rows: _compare(rows, threshold, axes), "a long, b long, n long")
    met = materialize(met, "met")
    sums = met.where("n is not null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("others"))
    roots = components(met.where("b is not null").select("a", "b"))
    joined = materialize(nodes.join(sums, "node", "left").join(roots, "node", "left").select(
        "embedding", "first_id", (F.coalesce("others", F.lit(0)) + F.col("many") - 1).alias("n_links"), F.coalesce("root", "node").alias("root")), "joined")
    least = materialize(joined.groupBy("root").agg(F.min("first_id").alias("component_id")), "least")
    found = materialize(lookup(joined.select("embedding", "n_links", "root"), least, ["root"]).select("embedding", "n_links", "component_id"), "found")
    linked = lookup(good, found, ["embedding"]).select("vec_id", "n_links", "component_id")
    alone = own.where(~F.coalesce(fine, F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
