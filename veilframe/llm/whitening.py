"""Whitening of embeddings from a blockwise QR and a bidiagonal qd solver.

Entries become whole numbers, so means and deviations are exact. Every distinct
vector is centred and goes into the triangle of its partition (a QR of blocks);
triangles are merged in rounds of a few until one is left, whose singular values
and right vectors are those of the centred data. The covariance matrix itself,
which would square the condition, is never formed.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.llm.bidiagonal import right_vectors
from veilframe.llm.memory import lean
from veilframe.llm.vectors import usable
from veilframe.session import materialize

MOST = 16
SCALE, SHIFT = 64, 1_000_000
# The largest SCALE * entry whose whole number is a long, among doubles.
LONG_END = 2.0**63 - 1_000_448
BLOCK_ROWS = 4096
# Bytes of triangles that a task holds, and that a merge takes in; numbers of models that the driver holds at one time.
HELD_BYTES, MERGE_BYTES, MODEL_NUMBERS = 64 << 20, 256 << 20, 4_000_000

RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


@dataclass
class Model:
    """What whitening needs to know of the vectors of one length."""

    n: int
    base: np.ndarray  # whole part of the mean
    rest: np.ndarray  # n times what is left of it
    squared: np.ndarray | None = None  # singular values of the centred vectors, squared
    explained: np.ndarray | None = None
    vectors: np.ndarray | None = None  # as columns
    identity_error: float = 0.0

    def above(self, x: np.ndarray) -> np.ndarray:
        """Vectors less the whole part of the mean, exact."""
        if max(np.abs(x.astype(float)).max(initial=0), np.abs(self.base.astype(float)).max(initial=0)) < 2.0**62:
            return x - self.base.astype(np.int64)
        return x.astype(object) - self.base

    def centred(self, x: np.ndarray) -> np.ndarray:
        return self.above(x).astype(float) - self.rest.astype(float) / self.n

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sums of squares of n * x - S; None where a long does not hold it."""
        above = self.above(x)
        top = np.abs(above.astype(float)).max(initial=0) * self.n + float(self.n)
        if top * top * x.shape[1] < 2.0**62:
            off = above.astype(np.int64) * self.n - self.rest.astype(np.int64)
            return (off * off).sum(axis=1).tolist()
        sums = ((above.astype(object) * self.n - self.rest) ** 2).sum(axis=1)
        return [int(s) if s < 2**63 else None for s in sums]

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ (self.vectors / np.sqrt(self.squared / self.n))


def whole_vectors(vectors: DataFrame) -> DataFrame:
    """``vec_id, dim, x`` of the vectors that count."""
    scaled = F.transform("embedding", lambda c: c.cast("double") * SCALE)
    own = vectors.where(usable("embedding")).select(F.col("vec_id").cast("long").alias("vec_id"), scaled.alias("v"))
    fits = F.forall("v", lambda c: (c <= LONG_END) & (c >= -(2.0**63))) & (F.size("v") > 0)
    return own.where(fits).select("vec_id", F.size("v").alias("dim"), F.transform("v", lambda c: F.floor(c) + SHIFT).alias("x"))


def _matrices(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Length, places and matrix of the vectors of each length."""
    sizes, flat = np.asarray(pc.list_value_length(column)).astype(np.int64), np.asarray(column.flatten())
    starts = np.cumsum(sizes) - sizes
    for dim in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == dim)
        yield dim, at, flat[starts[at][:, None] + np.arange(dim)]


def _sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for dim, at, x in _matrices(batch["x"]):
            exact = np.abs(x.astype(float)).max() * len(x) < 2.0**62
            total = x.sum(axis=0) if exact else x.astype(object).sum(axis=0)
            yield pa.RecordBatch.from_pydict({
                "dim": pa.array(np.full(dim, dim), pa.int32()), "at": pa.array(np.arange(dim), pa.int32()),
                "n": pa.array(np.full(dim, len(at)), pa.int64()), "total": pa.array([Decimal(int(t)) for t in total], pa.decimal128(38, 0))})


def _means(fit: DataFrame) -> dict[int, Model]:
    rows = fit.mapInArrow(lean(_sums), "dim int, at int, n long, total decimal(38,0)").groupBy("dim", "at").agg(
        F.sum("n").alias("n"), F.sum("total").cast("decimal(38,0)").alias("total")).orderBy("dim", "at").collect()
    models: dict[int, Model] = {}
    for row in rows:
        model = models.setdefault(row["dim"], Model(row["n"], np.zeros(row["dim"], object), np.zeros(row["dim"], object)))
        model.base[row["at"]], model.rest[row["at"]] = divmod(int(row["total"]), row["n"])
    return models


def triangle(rows: np.ndarray) -> np.ndarray:
    """The upper triangle of a QR, with as many rows as there are columns at most."""
    return np.linalg.qr(rows, mode="r") if len(rows) > 1 else rows


def _triangles(fit: DataFrame, models: dict[int, Model]) -> DataFrame:
    """``dim, part, r``: triangles of the centred vectors of every partition."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        part = TaskContext.get().partitionId() << 32

        def flush() -> pa.RecordBatch:
            nonlocal part
            part += len(held)
            return pa.RecordBatch.from_pydict({
                "dim": pa.array(list(held), pa.int32()), "part": pa.array(range(part - len(held), part), pa.int64()),
                "r": pa.array([r.tobytes() for r in held.values()], pa.binary())})

        for batch in batches:
            for dim, _, x in _matrices(batch["x"]):
                for start in range(0, len(x), BLOCK_ROWS):
                    block = models[dim].centred(x[start:start + BLOCK_ROWS])
                    held[dim] = triangle(np.vstack((held[dim], block)) if dim in held else block)
                if sum(r.nbytes for r in held.values()) > HELD_BYTES:
                    yield flush()
                    held.clear()
        if held:
            yield flush()

    return materialize(fit.mapInArrow(lean(run), "dim int, part long, r binary"), "triangles")


def _stacked(rows: pd.DataFrame) -> np.ndarray:
    dim = int(rows["dim"].iloc[0])
    return np.vstack([np.frombuffer(r, float).reshape(-1, dim) for r in rows["r"]])


def _merge(rows: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"dim": [rows["dim"].iloc[0]], "part": [rows["part"].min()], "r": [triangle(_stacked(rows)).tobytes()]})


def _merged(parts: DataFrame) -> DataFrame:
    """One triangle for each length, merged in rounds; a merge takes a few triangles whatever their number."""
    while True:
        counts = parts.groupBy("dim").agg(F.count(F.lit(1)).alias("n"))
        if counts.where("n > 1").isEmpty():
            return parts
        fan = F.greatest(F.lit(2), F.least(F.lit(16), (MERGE_BYTES / (F.col("dim").cast("double") ** 2 * 8)).cast("int")))
        groups = F.ceil(F.col("n") / fan)
        dealt = parts.join(F.broadcast(counts.select("dim", groups.alias("groups"))), "dim").withColumn(
            "deal", F.pmod(F.xxhash64("part"), "groups"))
        parts = materialize(dealt.select("dim", "part", "r", "deal").groupBy("dim", "deal").applyInPandas(_merge, "dim int, part long, r binary"), "triangles")


def _solver(most: int):
    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        r = _stacked(rows)
        square = np.vstack((r, np.zeros((max(0, r.shape[1] - len(r)), r.shape[1]))))
        every, squared, vectors = right_vectors(square, most)
        return pd.DataFrame({"dim": [r.shape[1]], "squared": [squared], "explained": [squared / every.sum() if len(squared) else squared], "vectors": [vectors.ravel()]})

    return solve


def _grams(models: dict[int, Model]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, _, x in _matrices(batch["x"]):
                w = models[dim].whiten(x)
                # The last row and column hold the sums.
                w = np.hstack((w, np.ones((len(w), 1))))
                i, j = np.indices((w.shape[1], w.shape[1]))
                yield pa.RecordBatch.from_pydict({"dim": pa.array(np.full(i.size, dim), pa.int32()), "i": pa.array(i.ravel(), pa.int32()),
                                                  "j": pa.array(j.ravel(), pa.int32()), "g": pa.array((w.T @ w).ravel())})

    return run


def fit_models(fit: DataFrame, most: int = MOST) -> dict[int, Model]:
    """Models by length of the distinct vectors ``fit(dim, x)``."""
    models = _means(fit)
    solved = _merged(_triangles(fit, models)).groupBy("dim").applyInPandas(
        _solver(most), "dim int, squared array<double>, explained array<double>, vectors array<double>").collect()
    for row in solved:
        model = models[row["dim"]]
        model.squared, model.explained = np.array(row["squared"], float), np.array(row["explained"], float)
        model.vectors = np.array(row["vectors"], float).reshape(row["dim"], len(model.squared))
    sums = fit.mapInArrow(lean(_grams(models)), "dim int, i int, j int, g double").groupBy("dim", "i", "j").agg(F.sum("g").alias("g")).collect()
    grams = {dim: np.zeros((len(m.squared) + 1,) * 2) for dim, m in models.items()}
    for row in sums:
        grams[row["dim"]][row["i"], row["j"]] = row["g"]
    for dim, model in models.items():
        mean = grams[dim][:-1, -1] / model.n
        off = grams[dim][:-1, :-1] / model.n - np.outer(mean, mean) - np.eye(len(mean))
        model.identity_error = float(np.abs(off).max(initial=0))
    return models


def _rows(models: dict[int, Model]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, at, x in _matrices(batch["x"]):
                model = models[dim]
                k = len(model.squared)
                each = lambda values, kind: pa.array(np.tile(values, len(at)), kind)
                deviation = pa.array(model.deviations(x), pa.int64())
                source = pa.array(np.repeat(np.arange(len(at)), k))
                yield pa.RecordBatch.from_pydict({
                    "vec_id": batch["vec_id"].take(pa.array(at)).take(source), "component": each(np.arange(1, k + 1), pa.int32()),
                    "n": each(np.full(k, model.n), pa.int64()), "deviation": deviation.take(source), "whitened": pa.array(model.whiten(x).ravel()),
                    "explained": each(model.explained, pa.float64()), "identity_error": each(np.full(k, model.identity_error), pa.float64())})

    return run


def _length_groups(fit: DataFrame, most: int) -> list[tuple[int, int]]:
    """Ranges of lengths whose models the driver can hold together; as a rule there is one length and one range."""
    out, numbers = [], 0
    for row in fit.groupBy("dim").count().orderBy("dim").select("dim").toLocalIterator():
        own = row["dim"] * (most + 2)
        if out and numbers + own <= MODEL_NUMBERS:
            out[-1], numbers = (out[-1][0], row["dim"]), numbers + own
        else:
            out.append((row["dim"], row["dim"]))
            numbers = own
    return out


def whiten(vectors: DataFrame, most: int = MOST) -> DataFrame:
    """Rows of ``RESULT``: every vector of ``vectors(vec_id, embedding)`` on its components.

    The fit list holds each distinct vector once. Components run from 1 by
    falling eigenvalue; those without variance up to rounding are left out, so
    a table of equal vectors gives no rows. Null and empty vectors, and those
    with null or non-finite entries or with entries whose whole number is no
    long, take no part. A ``deviation`` that no long holds is null. Vectors of
    unlike length are fitted on their own. Repeated rows and null ids are all
    returned. Further columns are ignored. An empty table gives an empty one.
    """
    whole = materialize(whole_vectors(vectors), "vectors")
    fit = materialize(whole.groupBy("dim", "x").agg(F.count(F.lit(1)).alias("copies")).select("dim", "x"), "fit")
    groups = _length_groups(fit, most)
    if not groups:
        return vectors.sparkSession.createDataFrame([], RESULT)
    out = None
    for low, high in groups:
        inside = F.col("dim").between(low, high)
        models = fit_models(fit.where(inside), most)
        part = whole.where(inside).select("vec_id", "x").mapInArrow(lean(_rows(models)), RESULT)
        part = part if len(groups) == 1 else materialize(part, "whitened")
        out = part if out is None else out.unionByName(part)
    return out
