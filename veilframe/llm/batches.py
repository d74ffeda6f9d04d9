"""Batches of documents that exchange messages.

A table of documents is kept as batches of some megabytes of text. A batch can
send packed messages to numbered boxes, boxes answer the batches that wrote to
them, and a batch reads the answers beside its documents. Documents themselves
never move: the table is bucketed by batch, so only messages are shuffled. There
is one message for each batch and box it writes to, so rows are few and large,
and a box holds a bounded share of all hashes.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.llm.memory import lean, lean_group
from veilframe.llm.tokens import text_slices
from veilframe.session import shared_folder

BATCH_BYTES = 4 << 20
BOX_BYTES = 16 << 20  # text for each box


def packed_batch(rows: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema) as out:
        out.write_table(rows)
    return zstandard.ZstdCompressor(level=3).compress(sink.getvalue())


def opened_batch(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(data)).read_all()


class Batches:
    """Documents as batches: ``table(batch, data)``, and the number of boxes."""

    def __init__(self, docs: DataFrame, text: str = "text", batch_bytes: int = BATCH_BYTES, box_bytes: int = BOX_BYTES):
        spark = docs.sparkSession

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part, number, held, size = TaskContext.get().partitionId(), 0, [], 0

            def row() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([
                    pa.array([part << 32 | number], pa.int64()), pa.array([packed_batch(pa.Table.from_batches(held))], pa.binary())], names=["batch", "data"])

            for batch in batches:
                for rows in text_slices(batch, text, batch_bytes // 4):
                    held.append(rows)
                    size += rows[text].nbytes
                    if size >= batch_bytes:
                        yield row()
                        number, held, size = number + 1, [], 0
            if held:
                yield row()

        total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
        self.boxes = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // box_bytes))
        name = f"batches_{uuid.uuid4().hex}"
        path = f"{shared_folder(spark).rstrip('/')}/veilframe/{name}"
        docs.mapInArrow(lean(pack), "batch long, data binary").write.bucketBy(self.boxes, "batch").option("path", path).saveAsTable(name)
        self.table = spark.table(name)

    def send(self, answers: list[DataFrame], write: Callable[[pa.Table, list[list[bytes]]], Iterator[tuple[int, bytes]]]) -> DataFrame:
        """``box, batch, data``: what ``write`` makes of every batch's documents and answers."""
        count = len(answers)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rows in batches:
                for i in range(rows.num_rows):
                    known = [rows[f"a{n}"][i].as_py() or [] for n in range(count)]
                    sent = list(write(opened_batch(rows["data"][i].as_buffer()), known))
                    if sent:
                        yield pa.RecordBatch.from_arrays([
                            pa.array([b for b, _ in sent], pa.int64()), pa.array([rows["batch"][i].as_py()] * len(sent), pa.int64()),
                            pa.array([d for _, d in sent], pa.binary())], names=["box", "batch", "data"])

        return self._with(answers).mapInArrow(lean(run), "box long, batch long, data binary")

    def read(self, answers: list[DataFrame], make: Callable[[pa.Table, list[list[bytes]]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
        """The rows that ``make`` makes of every batch's documents and answers."""
        count = len(answers)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rows in batches:
                for i in range(rows.num_rows):
                    known = [rows[f"a{n}"][i].as_py() or [] for n in range(count)]
                    yield from make(opened_batch(rows["data"][i].as_buffer()), known)

        return self._with(answers).mapInArrow(lean(run), schema)

    def _with(self, answers: list[DataFrame]) -> DataFrame:
        rows = self.table
        for n, a in enumerate(answers):
            rows = rows.join(a.groupBy("batch").agg(F.collect_list("data").alias(f"a{n}")), "batch", "left")
        return rows


def answered(sent: DataFrame, answer: Callable[[list[bytes]], list[bytes]]) -> DataFrame:
    """``batch, data``: every box's answers to its messages, in their order; empty answers are not sent."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        found = answer(list(rows["data"]))
        keep = [i for i, x in enumerate(found) if x]
        return pd.DataFrame({"batch": rows["batch"].to_numpy()[keep], "data": [found[i] for i in keep]})

    return sent.groupBy("box").applyInPandas(lean_group(run), "batch long, data binary")


def by_box(boxes: np.ndarray, count: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each box that occurs, the places where it does, in order."""
    order = np.argsort(boxes, kind="stable")
    edges = np.searchsorted(boxes[order], np.arange(count + 1))
    for b in range(count):
        if edges[b + 1] > edges[b]:
            yield b, order[edges[b]:edges[b + 1]]
