"""Token files: directly addressable codes of the ids of all documents.

A dataset is a folder of binary files, a file a row of segments, each followed
by one byte 0x0A. All numbers are little-endian. A segment is

    magic "VFDAC001", then u64: part, number in the part, documents, tokens,
    levels, bytes of the segment
    u8  per document: 1 if it has an id
    i64 per document: its id (0 if it has none)
    u64 per document: where its ids end, counted from the segment's first id
    per level: u64 entries, u8 chunk of each entry; then, but for the last
    level, the continuation bitmap (bit i%8 of byte i//8) padded to whole
    blocks of 64 bytes, and the rank directory, a u32 for each block: bits set
    in front of it.

Level 0 has the lowest 8 bits of every id. An id with bits left has its
continuation bit set and its next 8 bits in the next level, at the place that
the rank of the bit gives. Any id is read by as many lookups as it has bytes;
no block is decoded.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veilframe.llm.memory import lean
from veilframe.llm.tokens import WordTokenizer, text_slices
from veilframe.session import materialize, shared_folder

MAGIC = b"VFDAC001"
HEAD = struct.Struct("<8s6Q")
BLOCK = 64  # bytes of a bitmap for each entry of its rank directory
SEGMENT_TOKENS = 1 << 20
FILE_BYTES = 32 << 20  # text for each file, about


def encode_segment(part: int, number: int, doc_ids: list, ends: np.ndarray, ids: np.ndarray) -> bytes:
    """One segment: ``ends`` has the place behind each document's ids."""
    levels, rest = [], np.asarray(ids, np.uint32)
    while True:
        chunks, more = (rest & 0xFF).astype(np.uint8), rest > 0xFF
        if not more.any():
            levels.append(struct.pack("<Q", len(chunks)) + chunks.tobytes())
            break
        bits = np.packbits(more, bitorder="little")
        bits = np.concatenate((bits, np.zeros(-len(bits) % BLOCK, np.uint8)))
        counts = np.bitwise_count(bits.reshape(-1, BLOCK)).sum(axis=1)
        ranks = (np.cumsum(counts) - counts).astype("<u4")
        levels.append(struct.pack("<Q", len(chunks)) + chunks.tobytes() + bits.tobytes() + ranks.tobytes())
        rest = rest[more] >> 8
    has = bytes(x is not None for x in doc_ids)
    body = (has + np.array([x or 0 for x in doc_ids], "<i8").tobytes() + np.asarray(ends, "<u8").tobytes() + b"".join(levels))
    return HEAD.pack(MAGIC, part, number, len(doc_ids), len(ids), len(levels), HEAD.size + len(body)) + body


class Segment:
    """Reads one segment from a buffer, at ``at``."""

    def __init__(self, data: bytes, at: int = 0):
        magic, self.part, self.number, docs, self.tokens, levels, self.bytes = HEAD.unpack_from(data, at)
        if magic != MAGIC:
            raise ValueError("not a token segment")
        place = at + HEAD.size

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal place
            found = np.frombuffer(data, kind, count, place)
            place += found.nbytes
            return found

        self.has, self.ids, self.ends = take("u1", docs), take("<i8", docs), take("<u8", docs).astype(np.int64)
        self.levels = []
        for level in range(levels):
            n = int(take("<u8", 1)[0])
            chunks = take("u1", n)
            if level == levels - 1:
                self.levels.append((chunks, None, None))
            else:
                blocks = -(-(-(-n // 8)) // BLOCK)
                self.levels.append((chunks, take("u1", blocks * BLOCK), take("<u4", blocks)))

    @staticmethod
    def _rank(bits: np.ndarray, ranks: np.ndarray, i: int) -> int:
        byte = i >> 3
        block = byte // BLOCK
        inside = np.bitwise_count(bits[block * BLOCK:byte]).sum() if byte > block * BLOCK else 0
        return int(ranks[block]) + int(inside) + (int(bits[byte]) & ((1 << (i & 7)) - 1)).bit_count()

    def token(self, i: int) -> int:
        """The id at place ``i`` of the segment."""
        if not 0 <= i < self.tokens:
            raise IndexError(i)
        value = shift = 0
        for chunks, bits, ranks in self.levels:
            value |= int(chunks[i]) << shift
            if bits is None or not bits[i >> 3] >> (i & 7) & 1:
                return value
            i, shift = self._rank(bits, ranks, i), shift + 8
        return value

    def slice(self, start: int, stop: int) -> np.ndarray:
        """The ids of places ``start`` to ``stop``; reads just these."""
        out = np.zeros(max(0, stop - start), np.uint32)
        where, shift = np.arange(len(out)), 0
        for chunks, bits, ranks in self.levels:
            out[where] |= chunks[start:stop].astype(np.uint32) << np.uint32(shift)
            if bits is None or stop <= start:
                break
            first = start >> 3
            more = np.unpackbits(bits[first:-(-stop // 8)], bitorder="little")[start - first * 8:stop - first * 8].astype(bool)
            where, shift = where[more], shift + 8
            start = self._rank(bits, ranks, start)
            stop = start + len(where)
        return out

    def document(self, k: int) -> np.ndarray:
        """The ids of the segment's ``k``-th document."""
        return self.slice(int(self.ends[k - 1]) if k else 0, int(self.ends[k]))


def segments(data: bytes) -> Iterator[Segment]:
    """All segments of a file."""
    at = 0
    while at < len(data):
        found = Segment(data, at)
        yield found
        at += found.bytes + 1


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = 1, segment_tokens: int = SEGMENT_TOKENS,
                 file_bytes: int = FILE_BYTES) -> None:
    """Write the ids of ``docs(doc_id, text)`` as token files, in ascending doc_id order.

    A null text counts as empty; a null doc_id comes first and stays null; rows
    that repeat are all written; other columns are left out; an empty table
    gives no segments. ``end_id`` is appended to each document. A file holds
    about ``file_bytes`` of text and a document lies in one segment, so a task
    holds one segment and one batch of rows.
    """
    # The texts' own columns only, whatever else the table has.
    own = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // file_bytes))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, number = WordTokenizer(tokenizer), TaskContext.get().partitionId(), 0
        doc_ids: list = []
        ids: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            blob = encode_segment(part, number, doc_ids, np.cumsum(np.concatenate(sizes)), np.concatenate(ids))
            return pa.RecordBatch.from_arrays([pa.array([blob], pa.binary())], names=["segment"])

        for batch in batches:
            for rows in text_slices(batch, "text"):
                found, bounds = coder.encode(rows["text"])
                if end_id is not None:
                    found = np.insert(found, bounds[1:], end_id)
                    bounds = bounds + np.arange(len(bounds))
                doc_ids += rows["doc_id"].to_pylist()
                ids.append(found)
                sizes.append(np.diff(bounds))
                held += len(found)
                if held >= segment_tokens:
                    yield flush()
                    number += 1
                    doc_ids, ids, sizes, held = [], [], [], 0
        if doc_ids:
            yield flush()

    laid = own.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id")
    # The text writer puts a string's bytes down as they are.
    laid.mapInArrow(lean(encode), "segment binary").select(F.col("segment").cast("string")).write.text(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """What the token files at ``path`` hold, a row for each document.

    ``doc_id``, ``start`` (ids of all documents in front of it), ``n_tokens``,
    ``ids_crc32`` of the ids as unsigned 32-bit numbers, and ``part, segment,
    place``: where its ids begin.
    """

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch["content"]:
                for found in segments(data.as_buffer()):
                    starts = np.concatenate(([0], found.ends[:-1])).astype(np.int64)
                    sums = [zlib.crc32(found.document(k).astype("<u4").tobytes()) for k in range(len(found.ids))]
                    n = len(sums)
                    yield pa.RecordBatch.from_arrays([
                        pa.array(found.ids, mask=found.has == 0), pa.array(found.ends - starts, pa.int64()), pa.array(sums, pa.int64()),
                        pa.array(np.full(n, found.part), pa.int64()), pa.array(np.full(n, found.number), pa.int64()), pa.array(starts),
                    ], names=["doc_id", "n_tokens", "ids_crc32", "part", "segment", "place"])

    files = spark.read.format("binaryFile").load(path).select("content")
    rows = materialize(files.mapInArrow(lean(decode), "doc_id long, n_tokens long, ids_crc32 long, part long, segment long, place long"), "tokens")
    # One row for each segment, however many documents there are.
    before = Window.orderBy("part", "segment").rowsBetween(Window.unboundedPreceding, -1)
    bases = rows.groupBy("part", "segment").agg(F.sum("n_tokens").alias("n")).select(
        "part", "segment", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return rows.join(bases, ["part", "segment"]).select(
        "doc_id", (F.col("base") + F.col("place")).alias("start"), "n_tokens", "ids_crc32", "part", "segment", "place")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path of its own below the folder that all executors share."""
    return f"{shared_folder(spark).rstrip('/')}/veilframe/{name}-{uuid.uuid4().hex}"
