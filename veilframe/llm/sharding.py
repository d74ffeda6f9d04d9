"""Places rows on shards through a permutation-filled lookup table.

Every shard has its own order of preference over the slots of a table of prime
size (a start and a step, both hashed from its name). Shards take turns, each
claiming the first slot of its order that is still free, until the table is
full. So shards hold nearly the same number of slots, and when one is added or
removed, few slots change hands. A row goes to the shard of the slot that its
key hashes to: one look into a broadcast table.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Slots, a prime; also the proven bound of what is broadcast.
SLOTS = 65_537
# A key with more than a quarter of an even shard is hot.
HOT_PART = 4
# With fewer rows than this a key is not torn apart, however small the table.
HOT_ROWS = 100


def _number(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "big")


def lookup_table(shards: list[str], slots: int = SLOTS) -> list[int]:
    """For each slot the index of its shard; ``slots`` must be a prime that is larger than the number of shards."""
    if not shards or len(set(shards)) < len(shards):
        raise ValueError("shards need names that differ")
    if slots <= len(shards) or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("the number of slots must be a prime above the number of shards")
    place = [_number("start " + s) % slots for s in shards]
    step = [_number("step " + s) % (slots - 1) + 1 for s in shards]
    table, free = [-1] * slots, slots
    while free:
        for i in range(len(shards)):
            while table[place[i]] >= 0:
                place[i] = (place[i] + step[i]) % slots
            table[place[i]] = i
            free -= 1
            if not free:
                break
    return table


def place(df: DataFrame, keys: list[str], spread_by: list[Column], shards: list[str], slots: int = SLOTS) -> DataFrame:
    """Add ``slot`` and ``shard`` (name) to every row; columns of these names are replaced.

    All rows of a key go to one shard, also rows whose key is null, unless the
    key is hot: rows of a key that has more than a quarter of an even shard's
    rows, and more than ``HOT_ROWS``, are spread over as many slots as there are
    shards by ``spread_by`` (say a hash of their text; nulls are a value like
    others), so that no shard overflows. At most ``4 * len(shards)`` keys can be
    hot. Rows of a hot key that ``spread_by`` can't tell apart stay together,
    unless they alone are more than that: then they are dealt out in the order
    in which they are read. An empty table gives an empty one.
    """
    spark = df.sparkSession
    own = df.drop("slot", "shard")
    table = spark.createDataFrame(list(enumerate(shards[i] for i in lookup_table(shards, slots))), "slot int, shard string")
    names = [f"_vf_k{i}" for i in range(len(keys))]
    key_of = [F.col(f"`{k}`").alias(n) for k, n in zip(keys, names)]
    hash_of = F.xxhash64(*(F.col(f"`{k}`") for k in keys), *(F.col(f"`{k}`").isNull() for k in keys))
    counts = own.groupBy(*key_of).agg(F.count(F.lit(1)).alias("_vf_n"))
    total = counts.agg(F.sum("_vf_n")).first()[0] or 0
    limit = max(total // (HOT_PART * len(shards)), HOT_ROWS)
    hot_keys = counts.where(F.col("_vf_n") > limit).select(*names, F.lit(True).alias("_vf_hot"))

    def same(left: DataFrame, right: DataFrame) -> Column:
        match = F.lit(True)
        for k, n in zip(keys, names):
            match = match & left[f"`{k}`"].eqNullSafe(right[n])
        return match

    rows = own.withColumn("_vf_row", F.xxhash64(*spread_by)).withColumn("_vf_at", F.monotonically_increasing_id())
    marked = rows.join(F.broadcast(hot_keys), same(rows, hot_keys), "left").drop(*names)
    equal = marked.where("_vf_hot").groupBy(*key_of, F.col("_vf_row").alias("_vf_r")).agg(F.count(F.lit(1)).alias("_vf_n")).where(
        F.col("_vf_n") > limit).select(*names, "_vf_r", F.lit(True).alias("_vf_equal"))
    dealt = marked.join(F.broadcast(equal), same(marked, equal) & (marked["_vf_row"] == equal["_vf_r"]), "left")
    turn = F.when(F.col("_vf_equal"), F.col("_vf_at") % len(shards)).otherwise(F.lit(0))
    salted = F.when(F.col("_vf_hot"), F.pmod(F.col("_vf_row") + turn, F.lit(len(shards)))).otherwise(F.lit(0))
    slotted = dealt.withColumn("slot", F.pmod(F.xxhash64(hash_of, salted), F.lit(slots)).cast("int"))
    return slotted.join(F.broadcast(table), "slot").select(*(f"`{c}`" for c in own.columns), "slot", "shard")


def write_shards(placed: DataFrame, path: str) -> None:
    """Write each shard to a folder of its own (``shard=name``), from every task that holds rows of it."""
    placed.drop("slot").write.partitionBy("shard").parquet(path)
