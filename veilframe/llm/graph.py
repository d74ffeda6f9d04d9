"""Connected components of links between numbered things."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.llm.memory import lean
from veilframe.session import discard, materialize

# Links that one task unites at a time.
BATCH = 500_000


def united(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same components as the links (a, b), with one link (thing, smallest of its component) per thing at most."""
    if not len(a):
        return a, b
    things, codes = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = codes[:len(a)], codes[len(a):]
    root = np.arange(len(things))
    while True:
        rx, ry = root[x], root[y]
        low, high = np.minimum(rx, ry), np.maximum(rx, ry)
        differ = low != high
        if not differ.any():
            break
        x, y = x[differ], y[differ]
        np.minimum.at(root, high[differ], low[differ])
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    moved = root != np.arange(len(things))
    return things[moved], things[root[moved]]


def _unite_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def flush() -> pa.RecordBatch:
        a, b = united(np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held]))
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    for batch in batches:
        held.append((np.asarray(batch["a"]), np.asarray(batch["b"])))
        size += batch.num_rows
        if size >= BATCH:
            yield flush()
            held, size = [], 0
    if held:
        yield flush()


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every end of ``links(a, b)`` (longs, not null): the smallest node reachable.

    Links are united inside tasks first. Then, until nothing changes, every node
    hands the smallest node it knows of to its larger neighbours, and keeps only
    its smallest neighbour, to which it hands the other smaller ones (large star
    and small star), which takes few rounds also for long chains. No node's
    neighbours are gathered: the smallest comes from an aggregation and goes
    back by a join, and rounds are tables in the shared folder.
    """
    united_links = links.where("a <> b").mapInArrow(lean(_unite_batches), "a long, b long")
    state = materialize(_oriented(united_links), "links")
    while True:
        before = state
        both = state.select(F.col("big").alias("u"), F.col("small").alias("v")).unionAll(
            state.select(F.col("small").alias("u"), F.col("big").alias("v")))
        low = materialize(both.groupBy("u").agg(F.min("v").alias("low")).where("low < u"), "lowest")
        larger = state.select(F.col("small").alias("u"), F.col("big").alias("v")).join(low, "u", "left").select(
            F.col("v").alias("a"), F.coalesce("low", "u").alias("b"))
        # A node without smaller neighbours is the smallest of those it knows of; the others also link to their smallest.
        large = materialize(_oriented(larger.unionAll(low.select(F.col("u").alias("a"), F.col("low").alias("b")))), "large")
        lowest = materialize(large.groupBy("big").agg(F.min("small").alias("low")), "lowest")
        handed = large.join(lowest, "big").where("small <> low").select(F.col("small").alias("a"), F.col("low").alias("b"))
        state = materialize(_oriented(handed.unionAll(lowest.select(F.col("big").alias("a"), F.col("low").alias("b")))), "links")
        # A round that leaves every link as it was is the last.
        same = state.count() == before.count() and before.join(state, ["big", "small"], "left_anti").isEmpty()
        discard(before, low, large, lowest)
        if same:
            break
    roots = state.select(F.col("small").alias("node"), F.col("small").alias("root")).distinct()
    return state.select(F.col("big").alias("node"), F.col("small").alias("root")).unionAll(roots)


def _oriented(links: DataFrame) -> DataFrame:
    return links.where("a <> b").select(F.greatest("a", "b").alias("big"), F.least("a", "b").alias("small")).distinct()
