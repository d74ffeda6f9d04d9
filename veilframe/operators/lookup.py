"""Equi-joins of a large, possibly skewed table with a table that is unique on the key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.session import BROADCAST_ROWS, fits

# A key is hot when it holds more than this share of all rows, so there are
# never more than HOT_SHARE hot keys, whatever the size of the data.
HOT_SHARE = 10_000


def lookup(left: DataFrame, right: DataFrame, keys: list[str], broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Left outer join on ``keys``; ``right`` has at most one row per key.

    A right side whose counted size is small is broadcast. Otherwise the hot
    keys of the left side (at most ``HOT_SHARE`` by construction) are answered
    by a broadcast of their rows and the remaining keys, each holding a
    negligible share, by a shuffled join.
    """
    if fits(right, broadcast_rows):
        return left.join(F.broadcast(right), keys, "left")
    return split_lookup(left, right, keys)


def split_lookup(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """The shuffled form of :func:`lookup`, with hot keys answered by broadcast."""
    counts = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n")).scalar()
    hot_keys = counts.where(F.col("_n") * HOT_SHARE > total).select(*keys).limit(HOT_SHARE)
    hot_rows = hot_keys.join(right, keys, "left").withColumn("_hot", F.lit(True))
    marked = left.join(F.broadcast(hot_rows), keys, "left")
    values = [c for c in right.columns if c not in keys]
    hot = marked.where("_hot").select(*left.columns, *values)
    # Spark goes by the size of files, which says little of the rows of a table; this one has been counted.
    cold = marked.where(F.col("_hot").isNull()).select(*left.columns).join(right.hint("merge"), keys, "left")
    return hot.unionByName(cold.select(*left.columns, *values))
