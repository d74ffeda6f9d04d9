"""Packs token pieces into few sequences of a fixed capacity.

Large-item matching, on lengths alone: pieces above a third of the capacity
meet at most in twos, so the largest is paired with the largest one that still
fits; the smaller lengths, from the largest down, go into the tightest gap that
takes them. All pieces of a length are alike, so the plan is made from the
number of pieces of each length (at most ``capacity`` numbers) and says, for
each length, which ranks go to which sequences; the pieces are then numbered
inside their length and look up their place.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.llm.memory import lean
from veilframe.llm.tokens import WordTokenizer, text_slices
from veilframe.operators.ranking import numbered_rows
from veilframe.session import materialize

# Ranks inside a length stay below this.
RANKS = 1 << 44


@dataclass
class Bins:
    """Sequences that are filled alike: so many of each length, in this order."""

    count: int
    gap: int
    items: list[tuple[int, int]] = field(default_factory=list)

    def with_items(self, count: int, length: int, copies: int) -> Bins:
        return Bins(count, self.gap - length * copies, [*self.items, (length, copies)])


def plan_bins(counts: dict[int, int], capacity: int) -> list[Bins]:
    """How to fill sequences with ``counts[length]`` pieces of each length."""
    left = {n: c for n, c in counts.items() if c}
    large = sorted(n for n in left if n * 3 > capacity)
    done: list[Bins] = []
    while large:
        one = large.pop()
        c, empty = left[one], Bins(0, capacity)
        if 2 * one <= capacity and c > 1:
            done.append(empty.with_items(c // 2, one, 2))
            c %= 2
        while c:
            at = bisect_right(large, capacity - one) - 1
            if at < 0:
                done.append(empty.with_items(c, one, 1))
                break
            other = large[at]
            pairs = min(c, left[other])
            done.append(empty.with_items(pairs, one, 1).with_items(pairs, other, 1))
            c -= pairs
            left[other] -= pairs
            if not left[other]:
                large.pop(at)
    by_gap: dict[int, list[Bins]] = defaultdict(list)
    for b in done:
        by_gap[b.gap].append(b)
    gaps = sorted(by_gap)

    def put(b: Bins) -> None:
        if b.gap not in by_gap or not by_gap[b.gap]:
            insort(gaps, b.gap)
        by_gap[b.gap].append(b)

    for length in sorted((n for n in left if n * 3 <= capacity), reverse=True):
        c = left[length]
        while c:
            at = bisect_left(gaps, length)
            if at == len(gaps):
                put(Bins(-(-c // (capacity // length)), capacity))
                continue
            gap = gaps[at]
            b = by_gap[gap].pop()
            if not by_gap[gap]:
                gaps.pop(at)
            each = gap // length
            full = min(b.count, c // each)
            if full:
                put(b.with_items(full, length, each))
            c -= full * each
            rest = b.count - full
            if rest and c:
                put(b.with_items(1, length, c))
                rest, c = rest - 1, 0
            if rest:
                put(Bins(rest, b.gap, b.items))
    return [b for group in by_gap.values() for b in group]


def allocations(bins: list[Bins]) -> np.ndarray:
    """Rows (length, first rank, first sequence, copies in each, offset), sorted by length and rank."""
    rows, next_rank, first = [], defaultdict(int), 0
    for b in bins:
        offset = 0
        for length, copies in b.items:
            rows.append((length, next_rank[length], first, copies, offset))
            next_rank[length] += b.count * copies
            offset += length * copies
        first += b.count
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int | None = 0) -> DataFrame:
    """Cut the ids of ``docs(doc_id, text)`` into pieces of at most ``capacity``.

    ``doc_id, piece, start, length, ids_crc32, ids`` (little-endian unsigned
    32-bit numbers), kept as a table in the shared folder. A null text counts
    as empty, which is one piece with just ``end_id`` (none, without an
    ``end_id``); repeated rows are separate documents; other columns are left
    out.
    """
    own = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = WordTokenizer(tokenizer)
        for batch in batches:
            for rows in text_slices(batch, "text"):
                ids, bounds = coder.encode(rows["text"])
                if end_id is not None:
                    ids = np.insert(ids, bounds[1:], end_id)
                    bounds = bounds + np.arange(len(bounds))
                size = np.diff(bounds)
                count = -(-size // capacity)
                doc = np.repeat(np.arange(len(size)), count)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
                start = piece * capacity
                length = np.minimum(size[doc] - start, capacity)
                data = ids.astype("<u4").tobytes()
                begin = (bounds[:-1][doc] + start) * 4
                parts = [data[a:b] for a, b in zip(begin.tolist(), (begin + length * 4).tolist())]
                yield pa.RecordBatch.from_arrays([
                    rows["doc_id"].take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()),
                    pa.array([zlib.crc32(x) for x in parts], pa.int64()), pa.array(parts, pa.binary()),
                ], names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"
    return materialize(own.mapInArrow(lean(cut), schema), "pieces")


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """Give every piece its ``sequence_id`` and its ``offset`` there, gapless from 0.

    ``pieces`` has at least ``doc_id, piece, length`` with 1 <= length <=
    capacity, and no column ``sequence_id`` or ``offset``. Column ``ids`` is not
    moved; join it by document and piece where the sequences themselves are
    wanted, see :func:`sequences`. Pieces that are alike in ``doc_id`` and
    ``piece`` are placed each on its own. An empty table gives an empty one.
    """
    slim = pieces.drop("ids")
    counts = {r["length"]: r["n"] for r in slim.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    table = allocations(plan_bins(counts, capacity))
    ranked = numbered_rows(slim, ["length"], ["doc_id", "piece"], "_rank")
    keys = table[:, 0] * RANKS + table[:, 1]
    names = slim.columns

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank, length = np.asarray(batch["_rank"]) - 1, np.asarray(batch["length"])
            row = table[np.searchsorted(keys, length * RANKS + rank, "right") - 1]
            nth = rank - row[:, 1]
            yield pa.RecordBatch.from_arrays(
                [*(batch[c] for c in names), pa.array(row[:, 2] + nth // row[:, 3]), pa.array(row[:, 4] + nth % row[:, 3] * length)],
                names=[*names, "sequence_id", "offset"])

    kinds = ", ".join(f"`{c}` {t}" for c, t in slim.dtypes)
    return ranked.mapInArrow(lean(place), f"{kinds}, sequence_id long, offset long")


def sequences(pieces: DataFrame, placed: DataFrame) -> DataFrame:
    """The packed sequences: ``sequence_id``, ``doc_ids`` and ``ids`` (bytes) in order of offset.

    A sequence holds at most ``capacity`` pieces. (doc_id, piece) must be unique
    and doc_id not null here.
    """
    both = placed.select("doc_id", "piece", "sequence_id", "offset").join(pieces.select("doc_id", "piece", "ids"), ["doc_id", "piece"])
    row = F.sort_array(F.collect_list(F.struct("offset", "doc_id", F.hex("ids").alias("ids"))))
    return both.groupBy("sequence_id").agg(row.alias("rows")).select(
        "sequence_id", F.col("rows.doc_id").alias("doc_ids"), F.unhex(F.array_join("rows.ids", "")).alias("ids"))
