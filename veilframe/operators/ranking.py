"""Running sums per key that never put a whole key into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veilframe.session import materialize


def running_sum(df: DataFrame, keys: list[str], order: list[str], weight: Column, into: str) -> DataFrame:
    """Add the inclusive running sum of ``weight`` per key in ``order``.

    The rows are range-partitioned by key and order, so a hot key spreads over
    many tasks. Sums are taken inside each partition first; the sums of the
    partitions in front (one small row per key and partition) are added after.
    ``order`` must be unique inside a key.
    """
    columns = df.columns
    laid = materialize(
        df.withColumn("_weight", weight.cast("long")).repartitionByRange(*keys, *order)
        .withColumn("_part", F.spark_partition_id()), "ranked")
    local = Window.partitionBy("_part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    front = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = laid.groupBy("_part", *keys).agg(F.sum("_weight").alias("_sum"))
    ahead = sums.withColumn("_ahead", F.sum("_sum").over(front)).where("_ahead is not null").select(
        "_part", *keys, "_ahead")
    inside = laid.withColumn("_local", F.sum("_weight").over(local))
    # Only keys that span partitions have rows in `ahead`; there are fewer of them than partitions.
    joined = inside.join(F.broadcast(ahead), ["_part", *keys], "left")
    return joined.select(*columns, (F.col("_local") + F.coalesce("_ahead", F.lit(0))).alias(into))


def numbered_rows(df: DataFrame, keys: list[str], order: list[str], into: str) -> DataFrame:
    """Row number per key in ``order``."""
    return running_sum(df, keys, order, F.lit(1), into)
