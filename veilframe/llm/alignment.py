"""Tokens of two tokenizers laid side by side by the bytes they cover.

A batch of texts is handled in Arrow columns: the token lists are flattened with
their parents, cumulative sums of the tokens' byte lengths give every token's
end, and a hash join of both sides' ends gives the places where both end (the
groups) and, outer, all places where one ends. Between two such places one token
of either side covers the text, so every stretch is one link. Counts per batch
of the documents that hold a pair of ids are merged by Spark, and each batch gets
the counts of its own pairs back: pairs move once per batch, links once as small
numbers, texts don't move at all.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.llm.memory import lean, release_memory
from veilframe.llm.tokens import BYTE_SIGNS, text_slices
from veilframe.session import materialize

# Texts that are aligned at one time, in bytes; a longer text stands alone.
SLICE_BYTES = 2 << 20
# A pair of ids as one number: A's id times this, and B's id.
PAIR = 1 << 32

DOCUMENT = "struct<doc_id:bigint,n_a:bigint,n_b:bigint,n_groups:bigint,n_links:bigint,groups_sha256:string>"
# ``links`` are the places in ``pairs`` of every link, text by text, in as few bytes each as they fit in: these rows move.
ALIGNED = f"batch long, documents array<{DOCUMENT}>, pairs array<long>, holding array<int>, links binary"
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


class Vocabulary:
    """A tokenizer as ids of texts and the bytes of each id."""

    def __init__(self, encode: Callable[[list[str]], list[np.ndarray]], entries: list[bytes]):
        self.encode = encode
        self.entries = pa.array(entries, pa.binary())
        self.sizes = pc.binary_length(self.entries).cast(pa.int64())

    def lists(self, texts: list[str]) -> pa.ListArray:
        ids = self.encode(texts)
        ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int32), *ids]).astype(np.int32)))

    def bytes_of(self, lists: pa.ListArray) -> pa.Array:
        return pc.binary_join(pa.ListArray.from_arrays(lists.offsets, self.entries.take(lists.values)), b"")


def byte_level(path: str) -> Vocabulary:
    """A byte-level BPE file; the space that goes in front of a text is added here.

    The file's ids rise with the rank of their merges, so the ids themselves are
    the ranks that the encoder needs. The pattern is the one of this kind of file.
    """
    import tiktoken

    with open(path, encoding="utf-8") as file:
        made = json.load(file)
    special = {t["content"] for t in made.get("added_tokens", []) if t.get("special")}
    signs = {chr(code): byte for byte, code in enumerate(BYTE_SIGNS.tolist())} | {chr(0x100 + b): b for b in range(0x21)} | {chr(0x121): 0x7F}
    byte_of = lambda c: signs.get(c, ord(c))
    ranks = {bytes(map(byte_of, entry)): n for entry, n in made["model"]["vocab"].items() if entry not in special}
    coder = tiktoken.Encoding("byte level", pat_str=BYTE_PATTERN, mergeable_ranks=ranks, special_tokens={})
    entries = [b""] * (max(ranks.values()) + 1)
    for entry, n in ranks.items():
        entries[n] = entry
    return Vocabulary(lambda texts: [np.array(coder.encode_ordinary(" " + t), np.int32) for t in texts], entries)


# Fixed value: the pattern that byte-level files of this kind cut texts by.
BYTE_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def pieces(path: str) -> Vocabulary:
    """A sentence piece file, which puts a space in front of a text by itself."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    entry = lambda n: bytes([int(model.id_to_piece(n)[3:-1], 16)]) if model.is_byte(n) else model.id_to_piece(n).replace("▁", " ").encode()
    return Vocabulary(lambda texts: [np.array(x, np.int32) for x in model.encode(texts, num_threads=1)], [entry(n) for n in range(model.get_piece_size())])


def _ends(lists: pa.ListArray, sizes: pa.Array) -> pa.Array:
    """Where every token ends, counted in bytes from the start of the batch."""
    return pc.cumulative_sum(sizes.take(lists.values))


def _joined(ids: pa.Array, ends: np.ndarray, separator: str) -> pa.Array:
    """Values written in a row for each list; ``ends`` are the lists' ends."""
    offsets = pa.array(np.concatenate(([0], ends)).astype(np.int32))
    return pc.binary_join(pa.ListArray.from_arrays(offsets, ids), separator)


def align(texts: list[str], a: pa.ListArray, b: pa.ListArray, one: Vocabulary, two: Vocabulary) -> dict:
    """Groups, links and the digest of each text; the tokens of both sides cover the same bytes of every text."""
    left = pa.table({"end": _ends(a, one.sizes), "doc": pc.list_parent_indices(a), "a": a.values, "at_a": pa.array(np.arange(1, len(a.values) + 1))})
    right = pa.table({"end": _ends(b, two.sizes), "b": b.values, "at_b": pa.array(np.arange(1, len(b.values) + 1))})
    # Every text ends on both sides, so what is filled in from behind never comes from another text.
    met = left.join(right, "end", join_type="full outer", use_threads=False).sort_by("end").combine_chunks()
    links = pa.table({name: pc.fill_null_backward(met[name].combine_chunks()) for name in ("doc", "a", "b")})
    both = met.filter(pc.and_(pc.is_valid(met["at_a"]), pc.is_valid(met["at_b"])))
    per_text = lambda rows: np.bincount(np.asarray(rows).astype(np.int64), minlength=len(texts))
    sides = [_joined(v.cast(pa.string()), np.asarray(both[at]), ",") for v, at in ((a.values, "at_a"), (b.values, "at_b"))]
    n_groups = per_text(both["doc"])
    written = _joined(pc.binary_join_element_wise(*sides, "|"), np.cumsum(n_groups), ";")
    return {"n_groups": n_groups, "n_links": per_text(links["doc"]), "links": links,
            "sha": [hashlib.sha256(s.encode()).hexdigest() for s in written.to_pylist()]}


def _align_batch(number: int, doc_ids: list, texts: list[str | None], one: Vocabulary, two: Vocabulary) -> dict:
    """A row of ``ALIGNED``."""
    documents = [{"doc_id": i, "n_a": 0, "n_b": 0, "n_groups": 0, "n_links": 0, "groups_sha256": ""} for i in doc_ids]
    row = {"batch": number, "documents": documents}
    empty = np.empty(0, np.int64)
    row.update(pairs=empty, holding=empty, links=b"")
    full = [n for n, t in enumerate(texts) if t]
    whole = [texts[n] for n in full]
    a, b = one.lists(whole), two.lists(whole)
    spaced = pa.array([b" " + t.encode() for t in whole], pa.binary())
    same = np.asarray(pc.and_(pc.equal(one.bytes_of(a), spaced), pc.equal(two.bytes_of(b), spaced)))
    if not same.any():
        return row
    keep = np.flatnonzero(same)
    flat = lambda x: pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(pc.list_value_length(x)))).astype(np.int32)), x.flatten())
    a, b = flat(a.take(pa.array(keep))), flat(b.take(pa.array(keep)))
    made = align([whole[n] for n in keep], a, b, one, two)
    sizes = [np.diff(np.asarray(x.offsets)) for x in (a, b)]
    for n, at in enumerate(keep):
        documents[full[at]].update(n_a=int(sizes[0][n]), n_b=int(sizes[1][n]), n_groups=int(made["n_groups"][n]), n_links=int(made["n_links"][n]), groups_sha256=made["sha"][n])
    links = made["links"]
    pair = pc.add(pc.multiply(links["a"].cast(pa.int64()), PAIR), links["b"].cast(pa.int64())).combine_chunks().dictionary_encode()
    counted = pa.table({"doc": links["doc"], "pair": pair.indices}).group_by(["doc", "pair"], use_threads=False).aggregate([([], "count_all")])
    held = counted.group_by("pair", use_threads=False).aggregate([([], "count_all")]).sort_by("pair")
    row.update(pairs=np.asarray(pair.dictionary), holding=np.asarray(held["count_all"]), links=np.asarray(pair.indices).astype(_place_type(len(pair.dictionary))).tobytes())
    return row


def _place_type(n_pairs: int) -> str:
    return "<u2" if n_pairs <= 1 << 16 else "<u4"


def _packed(row: dict) -> pa.RecordBatch:
    one = lambda values, kind: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values).cast(kind))
    return pa.RecordBatch.from_pydict({
        "batch": pa.array([row["batch"]], pa.int64()), "documents": pa.array([row["documents"]], _document_type()), "pairs": one(row["pairs"], pa.int64()),
        "holding": one(row["holding"], pa.int32()), "links": pa.array([row["links"]], pa.binary())})


def _document_type() -> pa.DataType:
    numbers = [(n, pa.int64()) for n in ("doc_id", "n_a", "n_b", "n_groups", "n_links")]
    return pa.list_(pa.struct([*numbers, ("groups_sha256", pa.string())]))


def aligned_batches(docs: DataFrame, a_path: str, b_path: str, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """Rows of ``ALIGNED`` for ``docs(doc_id, text)``: tokens are compared where the texts lie."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two, number = byte_level(a_path), pieces(b_path), TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in text_slices(batch, "text", slice_bytes):
                yield _packed(_align_batch(number, part["doc_id"].to_pylist(), part["text"].to_pylist(), one, two))
                number += 1
                release_memory()

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(lean(run), ALIGNED)


def pair_counts(batches: DataFrame) -> DataFrame:
    """``pair, count, best``: documents that hold a pair of ids, and whether no other pair of its A id has more."""
    partial = batches.select(F.explode(F.arrays_zip("pairs", "holding")).alias("p")).select(F.col("p.pairs").alias("pair"), F.col("p.holding").alias("n"))
    counts = materialize(partial.groupBy("pair").agg(F.sum("n").alias("count")), "pair-counts")
    # One row for each entry of A's vocabulary at most.
    most = counts.groupBy(F.expr(f"pair div {PAIR}").alias("a")).agg(F.max("count").alias("most"))
    return counts.withColumn("a", F.expr(f"pair div {PAIR}")).join(F.broadcast(most), "a").select(
        "pair", "count", (F.col("count") == F.col("most")).alias("best"))


def _count_links(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for n in range(batch.num_rows):
            documents, at, counts, bests = (batch[name][n].values for name in ("documents", "at", "counts", "bests"))
            columns = {f.name: documents.field(f.name) for f in documents.type}
            links = np.frombuffer(batch["links"][n].as_buffer(), _place_type(len(at)))
            ends = np.cumsum(np.asarray(columns["n_links"]))
            for name, values in (("n_best", bests), ("count_sum", counts)):
                of_pair = np.zeros(len(at), np.int64)
                of_pair[np.asarray(at)] = np.asarray(values)
                columns[name] = pa.array(np.diff(np.concatenate(([0], np.cumsum(of_pair[links])))[ends], prepend=0))
            yield pa.RecordBatch.from_pydict({name.split(" ")[0]: columns[name.split(" ")[0]] for name in RESULT.split(", ")})
            release_memory()


def align_tokens(docs: DataFrame, a_path: str, b_path: str, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """Rows of ``RESULT``, one for each row of ``docs(doc_id, text)``.

    ``n_groups`` are the stretches between places where tokens of both sides
    end, ``n_links`` the pairs of overlapping tokens. A pair of ids counts the
    documents that hold it linked; ``count_sum`` adds the counts of a document's
    links and ``n_best`` counts the links whose pair no other pair with its A id
    surpasses. Texts that are null or empty, and those whose bytes one of the
    sides does not give back, have no tokens: zeros and an empty digest. Every
    row is a document of its own, also when ids repeat or are null. Further
    columns are ignored. An empty table gives an empty one.
    """
    batches = materialize(aligned_batches(docs, a_path, b_path, slice_bytes), "aligned")
    counts = pair_counts(batches)
    # A pair occurs once in a batch, so no pair is hot here.
    wanted = batches.select("batch", F.posexplode("pairs").alias("at", "pair"))
    got = wanted.join(counts, "pair").groupBy("batch").agg(F.collect_list(F.struct("at", "count", "best")).alias("got"))
    met = batches.join(got, "batch", "left")
    none = lambda name, kind: F.coalesce(F.col("got")[name].cast(f"array<{kind}>"), F.array().cast(f"array<{kind}>"))
    ready = met.select("documents", "links", none("at", "int").alias("at"), none("count", "long").alias("counts"), none("best", "int").alias("bests"))
    return ready.mapInArrow(lean(_count_links), RESULT)
