"""Session helpers: where intermediate tables go, and how work is spread."""

from __future__ import annotations

import atexit
import gc
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Largest table that may be broadcast, in rows; checked by counting, never assumed.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20
# Rows of a task that sorts and joins small groups.
TASK_ROWS = 250_000


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables: ``spark.checkpoint.dir`` of the session.

    Only on a single machine (master ``local[...]``: tests, notebooks) a folder
    is made where none is named, kept in the session's configuration, and
    removed when the process ends. On a cluster the setting is required, since
    a folder of one machine is not seen by the others.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "local")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="veilframe-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back.

    Cuts the lineage like a checkpoint does and survives lost executors, and
    later steps read only the columns they need.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/veilframe/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._written = path
    return table


def discard(*tables: DataFrame) -> None:
    """Remove tables that :func:`materialize` wrote, once nothing reads them any more; other tables are left alone."""
    for table in tables:
        path = table.__dict__.get("_written")
        if path:
            spark = table.sparkSession
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of jobs that are done, which it does when the driver collects its garbage.

    Otherwise they lie on the executors' disks until the driver runs short of memory.
    """
    gc.collect()
    spark._jvm.System.gc()


def fits(df: DataFrame, rows: int = BROADCAST_ROWS, most_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether a table has at most ``rows`` rows and ``most_bytes`` bytes (as text); stops reading right behind the limit of rows."""
    size = F.octet_length(F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns))))
    found = df.limit(rows + 1).agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("b")).first()
    return found["n"] <= rows and (found["b"] or 0) <= most_bytes


def spread(df: DataFrame) -> DataFrame:
    """Use every core also where a table lies in fewer partitions than there are cores.

    Scanning texts is bound by CPU, so for a few large files one round-robin
    exchange pays off; a table with enough partitions is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def tasks_for(df: DataFrame, rows: int = TASK_ROWS) -> int:
    """How many tasks keep each one near ``rows`` rows of a table; the table is counted."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows))


def by_key(df: DataFrame, *keys: str, rows: int = TASK_ROWS) -> DataFrame:
    """Deal rows out by keys, into as many partitions as keep a task near ``rows`` rows, however large the table is.

    For work inside groups of some rows each: windows and joins by these keys
    need no exchange behind it. The rows are counted once, so ``df`` is a table
    that is cheap to count.
    """
    return df.repartition(tasks_for(df, rows), *keys)
