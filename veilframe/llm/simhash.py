"""Near-duplicate texts by the Hamming distance of 64-bit fingerprints, found at anchor points.

A pair that differs in at most ``bits`` = 2 bits differs in at most one bit in
one of its two 32-bit halves. The anchors of a half are the words of a covering
code, the [31,26] Hamming code with a free 32nd bit: every half has exactly one
anchor within the covering radius 1, its home, and one within one bit of it has
that anchor within radius + 1 = 2. So every fingerprint goes to its home and, as
a guest, to every anchor within distance 2 (at most 17 for each half), and a
pair meets where one is at home and the other a guest. Candidates are compared
in full. Anchors with very many fingerprints are compared in tiles, and each
tile hands on just enough links to hold its components together.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.llm.graph import components, united
from veilframe.llm.memory import lean, release_memory
from veilframe.llm.tokens import text_slices
from veilframe.operators.lookup import HOT_SHARE, lookup
from veilframe.session import discard, fits, free_shuffles, materialize

BITS = 2
RADIUS = 1
SEED = 42
# Homes of an anchor, from which it is compared in tiles, and fingerprints of a tile.
CROWDED = 256
TILE = 2048
# Documents with one shingle, from which they are compared with single documents before they are with each other.
LONG_CROWDED = 512
# Documents in which common shingles are counted, how many of them make a shingle common, and the most that are named.
SAMPLE = 4_000
COMMON = 4
MOST_COMMON = 50_000
# Shares that the comparisons of one document are dealt to.
SALTS = 32
# Hashes of the sets that one task decides together, and that are on their way at one time.
GROUP_HASHES = 4_000_000
SLICE_HASHES = 1 << 26
# Pairs of sets that are listed at one time, and that are held against their parities.
SLICE_PAIRS = 1 << 25
PARITY_PAIRS = 1 << 20
# Bytes of text whose sets of shingles are held at one time.
SET_BYTES = 1 << 20
# 64-bit words of a set's parities, which bound what two sets can share.
PARITIES = 32


def fingerprint(text: bytes, words: int = 3, seed: int = SEED) -> int:
    """The fingerprint of one text, as an unsigned number; 0 for a text without words."""
    found = text.lower().split()
    if not found:
        return 0
    if len(found) < words:
        hashes = np.array([xxhash.xxh64_intdigest(b" ".join(found), seed)], np.uint64)
    else:
        joined = b" ".join(found)
        ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        digest = xxhash.xxh64_intdigest
        hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts[:len(found) - words + 1].tolist(), ends[words - 1:].tolist())], np.uint64)
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65_536):
        part = hashes[at:at + 65_536].astype("<u8").view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 3, seed: int = SEED) -> DataFrame:
    """``doc_id, fp`` of ``docs(doc_id, text)``: the fingerprint's 64 bits as a signed long.

    A-Z are lowered; words are runs of bytes other than ASCII white space;
    shingles of ``words`` words, repeats counted, are joined by spaces (all
    words, where there are fewer). A bit is set if it is set in over half of the
    shingles' XXH64. Null, empty and blank texts have fingerprint 0.
    """

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in text_slices(batch, "text"):
                found = [fingerprint((t or "").encode(), words, seed) for t in rows["text"].to_pylist()]
                yield pa.RecordBatch.from_arrays([rows["doc_id"], pa.array(np.array(found, np.uint64).view(np.int64))], names=["doc_id", "fp"])

    own = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return own.mapInArrow(lean(made), "doc_id long, fp long")


def _column_codes() -> np.ndarray:
    """For each of 31 bits its column of the parity check matrix: the numbers 1 to 31."""
    return np.arange(1, 32, dtype=np.int64)


def homes_and_guests(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each fingerprint its homes (n, 2), and its guest anchors: row, half, anchor.

    Column ``h`` and number ``h`` are the half, 0 for the low 32 bits.
    """
    codes = _column_codes()
    homes = np.empty((len(fp), 2), np.int64)
    rows, halves, anchors = [], [], []
    pairs = [(i, j, int(codes[i] ^ codes[j])) for i in range(31) for j in range(i)]
    by_sum = [[(1 << i) ^ (1 << j) for i, j, s in pairs if s == syndrome] for syndrome in range(32)]
    number = np.arange(len(fp))
    for half in (0, 1):
        word = (fp.view(np.uint64) >> np.uint64(32 * half)).astype(np.int64) & 0xFFFFFFFF
        syndrome = np.zeros(len(fp), np.int64)
        for bit in range(31):
            syndrome ^= np.where(word >> bit & 1, codes[bit], 0)
        home = np.where(syndrome > 0, word ^ (1 << np.maximum(syndrome - 1, 0)), word)
        homes[:, half] = home
        for anchor in (home, home ^ (1 << 31)):
            rows.append(number)
            anchors.append(anchor)
        for s in range(1, 32):
            mine = np.flatnonzero(syndrome == s)
            for mask in by_sum[s]:
                rows.append(mine)
                anchors.append(word[mine] ^ mask)
        halves += [np.full(len(x), half, np.int64) for x in rows[len(halves):]]
    return homes, np.concatenate(rows), np.concatenate(halves), np.concatenate(anchors)


def near_links(distinct: DataFrame) -> DataFrame:
    """Links ``a, b`` between the different fingerprints ``fp`` within 2 bits.

    Outside crowded anchors all links are returned, inside them enough to keep
    their components. Rows may repeat.
    """

    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.asarray(batch["fp"])
            found = homes_and_guests(fp)[0]
            for half in (0, 1):
                yield pa.RecordBatch.from_arrays([pa.array(found[:, half] * 2 + half), pa.array(fp)], names=["anchor", "home"])

    def guests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.asarray(batch["fp"])
            _, row, half, anchor = homes_and_guests(fp)
            yield pa.RecordBatch.from_arrays([pa.array(anchor * 2 + half), pa.array(fp[row])], names=["anchor", "guest"])

    home = materialize(distinct.mapInArrow(lean(homes), "anchor long, home long"), "homes")
    guest = distinct.mapInArrow(lean(guests), "anchor long, guest long")
    counts = materialize(home.groupBy("anchor").agg(F.count(F.lit(1)).alias("homes")), "anchors")
    # Guests at anchors where nobody is at home meet nobody. Spark takes guests for as few as the fingerprints, and would broadcast them.
    placed = materialize(guest.join(F.broadcast(counts) if fits(counts) else counts.hint("merge"), "anchor"), "guests")
    crowd = counts.where(F.col("homes") > CROWDED)
    near = placed.where(F.col("homes") <= CROWDED).join(home, "anchor").where(
        "guest <> home and bit_count(guest ^ home) <= 2").select(F.col("guest").alias("a"), F.col("home").alias("b"))

    at_crowd = placed.where(F.col("homes") > CROWDED)
    tiles = at_crowd.groupBy("anchor", "homes").agg(F.count(F.lit(1)).alias("guests")).select(
        "anchor", F.ceil(F.col("homes") / TILE).alias("home_tiles"), F.ceil(F.col("guests") / TILE).alias("guest_tiles"))
    tiles = materialize(tiles, "tiles")
    tile = lambda c, n: F.pmod(F.xxhash64(c), F.col(n))
    h = home.join(tiles, "anchor").select(
        "anchor", tile("home", "home_tiles").alias("ht"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("guest_tiles") - 1)).alias("gt"),
        F.col("home").alias("fp"), F.lit(True).alias("at_home"))
    g = at_crowd.select("anchor", "guest").join(tiles, "anchor").select(
        "anchor", F.explode(F.sequence(F.lit(0).cast("long"), F.col("home_tiles") - 1)).alias("ht"), tile("guest", "guest_tiles").alias("gt"),
        F.col("guest").alias("fp"), F.lit(False).alias("at_home"))
    crowded = h.unionByName(g).groupBy("anchor", "ht", "gt").applyInPandas(_compare_tile, "a long, b long")
    return near.unionByName(crowded)


def _compare_tile(rows: pd.DataFrame) -> pd.DataFrame:
    """One tile of homes against one of guests; enough links to hold its components together."""
    home = rows.loc[rows["at_home"], "fp"].to_numpy()
    guest = rows.loc[~rows["at_home"], "fp"].to_numpy()
    a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for at in range(0, len(home), 256):
        i, j = np.nonzero(np.bitwise_count((home[at:at + 256, None] ^ guest[None, :]).view(np.uint64)) <= BITS)
        x, y = united(home[at:at + 256][i], guest[j])
        a.append(x)
        b.append(y)
    x, y = united(np.concatenate(a), np.concatenate(b))
    return pd.DataFrame({"a": x, "b": y})


def near_duplicates(docs: DataFrame, words: int = 3, seed: int = SEED) -> DataFrame:
    """``doc_id, fp, component_id`` of every row of ``docs(doc_id, text)``.

    Fingerprints within 2 bits are linked, equal ones too; ``component_id`` is
    the smallest doc_id reachable, the row's own included. Rows with a null
    doc_id take part and have a result, but never give their id; a component of
    such rows alone has a null ``component_id``. Repeated rows are all returned.
    Texts without words have fingerprint 0 and are linked like others. An empty
    table gives an empty one; other columns are left out.
    """
    prints = materialize(fingerprints(docs, words, seed), "fingerprints")
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct")
    roots = materialize(components(near_links(distinct.select("fp"))), "roots")
    members = materialize(distinct.join(roots, distinct["fp"] == roots["node"], "left").select(
        "fp", "first_id", F.coalesce("root", "fp").alias("root")), "members")
    least = materialize(members.groupBy("root").agg(F.min("first_id").alias("component_id")), "least")
    of_print = materialize(lookup(members.select("fp", "root"), least, ["root"]).select("fp", "component_id"), "components")
    return lookup(prints, of_print, ["fp"]).select("doc_id", "fp", "component_id")


def print_digits(fp: str) -> Column:
    """A fingerprint as 16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))


def shingle_set(text: bytes, words: int) -> np.ndarray:
    """Hashes of the different shingles of one text, ascending; a text of fewer words is one shingle."""
    found = text.lower().split()
    n = min(words, len(found))
    joined = b" ".join(found)
    if n < words or n == len(found):
        return np.array([xxhash.xxh3_64_intdigest(joined)], np.uint64).view(np.int64)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh3_64_intdigest
    return np.unique(np.array([digest(joined[a:b]) for a, b in zip(starts[:len(found) - n + 1].tolist(), ends[n - 1:].tolist())], np.uint64).view(np.int64))


def set_number(hashes: np.ndarray) -> int:
    """A number that equal sets of shingles have in common."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(hashes.astype("<i8").tobytes())).view(np.int64))


def set_fingerprint(hashes: np.ndarray) -> int:
    """The SimHash of a set of shingles as a signed number: a bit is set if it is in over half of the hashes."""
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65_536):
        part = hashes[at:at + 65_536].astype("<i8").view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(hashes), bitorder="little").view("<i8")[0])


def parities(hashes: np.ndarray) -> np.ndarray:
    """Of every one of 64 x ``PARITIES`` cells of hashes, whether their number is odd.

    Sets that differ in d shingles differ in at most d parities.
    """
    odd = np.bincount(hashes & (64 * PARITIES - 1), minlength=64 * PARITIES) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view("<i8")


def prefix(hashes: np.ndarray, similarity: float, common: np.ndarray) -> np.ndarray:
    """The first shingles of a set, in the order of all sets, of which two sets of this similarity share at least one.

    They share at least ``similarity`` of the shingles of each, so the first one
    that they share has as many behind it, less one. Those of ``common``
    (ascending) come last.
    """
    share = int(np.ceil(similarity * len(hashes) - 1e-9))
    last = common[np.minimum(np.searchsorted(common, hashes), len(common) - 1)] == hashes if len(common) else np.zeros(len(hashes), bool)
    return np.concatenate((hashes[~last], hashes[last]))[:len(hashes) - share + 1]


def similar_documents(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """``doc_id, component_id`` of every row of ``docs(doc_id, text)``: groups of texts alike in their shingles.

    Two texts are linked if the Jaccard similarity of their sets of shingles is
    at least ``similarity``; every different shingle counts once. Candidates are
    first the sets whose SimHash is within 2 bits, found at anchors; the pairs
    that a SimHash misses share one of the first shingles of both, in an order
    that all texts have in common (prefix filtering), and come next, unless they
    are connected by then. So all such pairs are found, and every one is
    decided by the sets. Shingles are told apart by 64-bit hashes, and so are
    sets. Rules for null ids and texts and for repeated rows are those of
    :func:`near_duplicates`.
    """
    own = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    common = _common_shingles(own, words)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in text_slices(batch, "text", SET_BYTES):
                found = [shingle_set((t or "").encode(), words) for t in rows["text"].to_pylist()]
                first = [prefix(x, similarity, common) for x in found]
                yield pa.RecordBatch.from_arrays(
                    [rows["doc_id"], pa.array([set_number(x) for x in found], pa.int64()), pa.array(list(map(len, found)), pa.int64()),
                     pa.array([set_fingerprint(x) for x in found], pa.int64()), _lists(first), _lists([parities(x) for x in found])],
                    names=["doc_id", "node", "size", "fp", "first", "odd"])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in text_slices(batch, "text", SET_BYTES):
                found = [shingle_set((t or "").encode(), words) for t in rows["text"].to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([set_number(x) for x in found], pa.int64()), _lists(found)], names=["node", "hashes"])

    prints = materialize(own.mapInArrow(lean(made), "doc_id long, node long, size long, fp long, first array<long>, odd array<long>"), "fingerprints")
    placed = materialize(_shared_shingles(prints), "shared")
    free_shuffles(docs.sparkSession)
    marked = prints.select("node", "size", "fp", "odd").join(placed.select("node").distinct(), "node", "left_semi")
    marked = materialize(marked.dropDuplicates(["node"]), "marks")
    ids = materialize(prints.select("doc_id", "node"), "ids")
    discard(prints)
    free_shuffles(docs.sparkSession)

    def alike(pairs: DataFrame, listed: int = 0) -> DataFrame:
        may = _may_be_alike(pairs, marked.drop("fp"), similarity, listed)
        free_shuffles(docs.sparkSession)
        needed = materialize(may.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "needed")
        found = own.select("text").mapInArrow(lean(sets), "node long, hashes array<long>").join(
            F.broadcast(needed) if fits(needed) else needed, "node", "left_semi").dropDuplicates(["node"])
        held = materialize(found, "sets")
        free_shuffles(docs.sparkSession)
        dealt, slices = _dealt(may)
        parts = []
        for n in range(slices):
            parts.append(materialize(_alike(dealt.where(F.pmod(F.xxhash64("token", "x", "y"), F.lit(slices)) == n), held, similarity), "links"))
            free_shuffles(docs.sparkSession)
        links = _union(parts)
        discard(held, needed, may, dealt)
        free_shuffles(docs.sparkSession)
        return links

    roots = _similar_roots(placed, _near_pairs(marked.select("node", "fp")), alike, similarity)
    discard(placed, marked)
    nodes = ids.groupBy("node").agg(F.min("doc_id").alias("first_id"))
    members = materialize(nodes.join(roots, "node", "left").select("node", "first_id", F.coalesce("root", "node").alias("root")), "members")
    least = materialize(members.groupBy("root").agg(F.min("first_id").alias("component_id")), "least")
    of_node = materialize(lookup(members.drop("first_id"), least, ["root"]).drop("root"), "components")
    discard(roots, members, least)
    return lookup(ids, of_node, ["node"]).select("doc_id", "component_id")


def _lists(values: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in values], dtype=np.int64))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(values) if values else np.empty(0, np.int64)))


def _common_shingles(own: DataFrame, words: int) -> np.ndarray:
    """Shingles of many documents, counted in a sample; they bear on the order of the shingles alone, not on what is found."""
    part = max(1, own.count() // SAMPLE)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in text_slices(batch, "text"):
                found, times = np.unique(np.concatenate([shingle_set((t or "").encode(), words) for t in rows["text"].to_pylist()]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(times.astype(np.int64))], names=["token", "times"])

    sample = own.where(F.pmod(F.xxhash64("text"), F.lit(part)) == 0).select("text")
    counts = sample.mapInArrow(lean(counted), "token long, times long").groupBy("token").agg(F.sum("times").alias("times"))
    rows = counts.where(F.col("times") >= COMMON).orderBy(F.desc("times"), "token").limit(MOST_COMMON).select("token").collect()
    return np.sort(np.array([r.token for r in rows], np.int64))


def _shared_shingles(prints: DataFrame) -> DataFrame:
    """``token, node, size, pos, rep, n``: of the first shingles those of several sets, with one of the sets and their number of rows."""
    entries = prints.select("node", "size", F.posexplode("first").alias("pos", "token"))
    counts = entries.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("rep"), F.max("node").alias("_most"))
    counts = materialize(counts.where("rep <> _most").drop("_most"), "tokens")
    free_shuffles(prints.sparkSession)
    if fits(counts):
        met = entries.join(F.broadcast(counts), "token")
    else:
        # At most HOT_SHARE tokens hold more than their share of the rows.
        bound = counts.agg(F.sum("n")).first()[0] / HOT_SHARE
        hot = counts.where(F.col("n") > bound)
        met = entries.join(F.broadcast(hot), "token").unionByName(
            entries.join(F.broadcast(hot.select("token")), "token", "left_anti").join(counts.where(F.col("n") <= bound), "token"))
    return met.dropDuplicates(["token", "node"]).select("token", "node", "size", "pos", "rep", "n")


def _near_pairs(prints: DataFrame) -> DataFrame:
    """``a, b, token``: pairs of sets with SimHashes within 2 bits, enough to connect each fingerprint's sets and all near fingerprints.

    ``prints`` has one row ``node, fp`` for each set.
    """
    first = materialize(prints.groupBy("fp").agg(F.min("node").alias("rep")), "prints")
    same = lookup(prints, first, ["fp"]).where("node <> rep").select(F.col("node").alias("a"), F.col("rep").alias("b"), F.col("fp").alias("token"))
    near = lookup(near_links(first.select("fp")), first.select(F.col("fp").alias("a"), F.col("rep").alias("_a")), ["a"])
    near = lookup(near, first.select(F.col("fp").alias("b"), F.col("rep").alias("_b")), ["b"])
    return same.unionByName(near.select(F.col("_a").alias("a"), F.col("_b").alias("b"), F.col("a").alias("token")))


def _similar_roots(placed: DataFrame, near: DataFrame, alike: Callable[..., DataFrame], similarity: float) -> DataFrame:
    """``node, root`` of all sets that are linked to another.

    Pairs with near SimHashes are decided first. Then the sets of a shingle are
    compared with one of them, and then all pairs are, but for those that are
    connected by then, so large groups of copies take few comparisons.
    """
    links = alike(near)
    roots = materialize(components(links), "roots")
    open_lists = _unconnected(placed, roots)
    if open_lists.isEmpty():
        return roots
    other = open_lists.where("node <> other and comp <> other_comp").select(F.col("node").alias("a"), F.col("other").alias("b"), "token")
    links = links.unionByName(alike(other))
    discard(open_lists, roots)
    roots = materialize(components(links), "roots")
    open_lists = _unconnected(placed, roots)
    if not open_lists.where(F.col("n") > LONG_CROWDED).isEmpty():
        other = open_lists.where("node <> other and comp <> other_comp").select(F.col("node").alias("a"), F.col("other").alias("b"), "token")
        links = links.unionByName(alike(other))
        discard(open_lists, roots)
        roots = materialize(components(links), "roots")
        open_lists = _unconnected(placed, roots)
    if open_lists.isEmpty():
        return roots
    # Every set of a shingle's list has its length beside it.
    listed = open_lists.agg(F.sum("n")).first()[0] // 2
    links = links.unionByName(alike(_open_pairs(open_lists, similarity), listed))
    discard(open_lists, roots)
    return materialize(components(links), "roots")


def _unconnected(placed: DataFrame, roots: DataFrame) -> DataFrame:
    """The rows of the shingles whose sets are in several components, with component, largest set, its component, and number of sets."""
    marked = lookup(placed.select("token", "node", "size", "pos"), roots, ["node"]).withColumn("comp", F.coalesce("root", "node")).drop("root")
    marked = materialize(marked, "marked")
    wide = marked.groupBy("token").agg(
        F.count(F.lit(1)).alias("n"), F.min("comp").alias("_low"), F.max("comp").alias("_high"), F.max("node").alias("other"))
    narrow = materialize(wide.where("_low <> _high").select("token", "n", "other"), "lists")
    comps = roots.select(F.col("node").alias("other"), F.col("root").alias("other_comp"))
    lists = materialize(lookup(narrow, comps, ["other"]).withColumn("other_comp", F.coalesce("other_comp", "other")), "lists")
    found = materialize(lookup(marked, lists, ["token"]).where("n is not null"), "open")
    discard(marked, narrow, lists)
    free_shuffles(placed.sparkSession)
    return found


def _open_pairs(rows: DataFrame, similarity: float) -> DataFrame:
    """Pairs ``a, b`` of sets that share a shingle, aren't connected, and may be alike by their sizes and the places of the shingle.

    Long lists are compared in tiles, so no task has all of one.
    """
    tiles = F.ceil(F.col("n") / TILE)
    cut = rows.select("token", "node", "size", "pos", "comp", tiles.alias("_tiles")).withColumn("_own", F.pmod(F.xxhash64("node"), F.col("_tiles")))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_tiles") - 1))
    x = cut.withColumn("_other", every).select(
        "token", F.col("_own").alias("_x"), F.col("_other").alias("_y"), *(F.col(c).alias(f"a_{c}") for c in ("node", "size", "pos", "comp")))
    y = cut.withColumn("_other", every).select(
        "token", F.col("_other").alias("_x"), F.col("_own").alias("_y"), *(F.col(c).alias(f"b_{c}") for c in ("node", "size", "pos", "comp")))
    most = F.least("a_pos", "b_pos") + 1 + F.least(F.col("a_size") - F.col("a_pos"), F.col("b_size") - F.col("b_pos")) - 1
    both = F.col("a_size") + F.col("b_size")
    # As many shingles as are shared at most are enough; the margin is for rounding.
    may = (F.least("a_size", "b_size") + 1e-6 >= similarity * F.greatest("a_size", "b_size")) & (most + 1e-6 >= similarity / (1 + similarity) * both)
    met = x.join(y, ["token", "_x", "_y"]).where("a_node < b_node and a_comp <> b_comp").where(may)
    return met.select(F.col("a_node").alias("a"), F.col("b_node").alias("b"), "token")


def _with(rows: DataFrame, pairs: DataFrame, found: DataFrame, end: str, other: str) -> DataFrame:
    """``rows`` of ``pairs`` with the columns of ``found`` for the set at one end, named after it."""
    # A set with very many comparisons is dealt to several tasks.
    salt = F.pmod(F.xxhash64(other), F.lit(SALTS))
    named = found.select(F.col("node").alias(end), *(F.col(c).alias(f"{end}_{c}") for c in found.columns if c != "node"))
    keyed = pairs.select(end, salt.alias("_salt")).distinct().join(named, end)
    return rows.withColumn("_salt", salt).join(keyed, [end, "_salt"]).drop("_salt")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def _may_be_alike(pairs: DataFrame, marked: DataFrame, similarity: float, listed: int = 0) -> DataFrame:
    """The different pairs ``a, b`` with their sizes, without those that by sizes and parities can't have the similarity.

    ``token`` is one of the shingles that brought a pair together; pairs are decided where their shingle is. Where there may be
    very many (``listed`` rows at most, 0 for few), they are listed slice by slice, and held against parities part by part, and
    the shuffles of one are freed before the next. A pair with shingles in several slices is tried in each.
    """
    spark = pairs.sparkSession
    total = F.col("a_size") + F.col("b_size")
    apart = F.expr(" + ".join(f"bit_count(get(a_odd, {i}) ^ get(b_odd, {i}))" for i in range(PARITIES)))
    # Sets that share s of their n shingles together differ in n - 2s. The margin is for rounding.
    may = (F.least("a_size", "b_size") + 1e-6 >= similarity * F.greatest("a_size", "b_size")) & (
        (total - apart) / 2 + 1e-6 >= similarity / (1 + similarity) * total)
    slices, found = max(1, -(-listed // SLICE_PAIRS)), []
    for n in range(slices):
        some = pairs if slices == 1 else pairs.where(F.pmod(F.xxhash64("token"), F.lit(slices)) == n)
        one = some.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"), "token").groupBy("a", "b").agg(F.min("token").alias("token"))
        one = materialize(one, "pairs")
        parts = max(1, -(-one.count() // PARITY_PAIRS))
        for k in range(parts):
            free_shuffles(spark)
            part = one if parts == 1 else one.where(F.pmod(F.xxhash64("a", "b"), F.lit(parts)) == k)
            both = _with(_with(part, part, marked, "a", "b"), part, marked, "b", "a")
            found.append(materialize(both.where(may).select("a", "b", "token", "a_size", "b_size"), "pairs"))
        discard(one)
    if len(found) == 1:
        return found[0]
    every = materialize(_union(found).groupBy("a", "b", "a_size", "b_size").agg(F.min("token").alias("token")), "pairs")
    discard(*found)
    return every


def _dealt(pairs: DataFrame) -> tuple[DataFrame, int]:
    """``token, x, y, a, b``: the tile of its shingle in which a pair is decided; and in how many slices all are."""
    ends = F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("a_size").alias("size")), F.struct(F.col("b").alias("node"), F.col("b_size").alias("size"))))
    loads = pairs.select("token", ends.alias("end")).distinct().groupBy("token").agg(F.sum("end.size").alias("load"))
    loads = materialize(loads.withColumn("tiles", F.ceil(2 * F.col("load") / GROUP_HASHES)), "loads")
    # A set goes to the tiles of its row and of its column.
    moved = loads.agg(F.sum(F.when(F.col("tiles") > 1, 2 * F.col("tiles")).otherwise(1) * F.col("load"))).first()[0] or 0
    tile = lambda node: F.pmod(F.xxhash64(node), F.col("tiles"))
    dealt = pairs.join(loads.select("token", "tiles"), "token").select("token", tile("a").alias("x"), tile("b").alias("y"), "a", "b")
    dealt = materialize(dealt, "dealt")
    discard(loads)
    return dealt, max(1, -(-moved // SLICE_HASHES))


def _alike(dealt: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The different pairs ``a, b`` whose sets have at least this Jaccard similarity.

    The pairs of a shingle are decided together, so a set travels once for each
    of its shingles that still has pairs, not once for each pair; where the sets
    of a shingle are too many for one task, they are cut into tiles.
    """
    key = ["token", "x", "y"]
    members = dealt.select(*key, F.explode(F.array("a", "b")).alias("node")).distinct().hint("merge").join(sets, "node").select(*key, "node", "hashes")

    def decide(held: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        of = dict(zip(held["node"].tolist(), held["hashes"]))
        keep = np.zeros(len(asked), bool)
        for n, (a, b) in enumerate(zip(asked["a"].tolist(), asked["b"].tolist())):
            shared = len(np.intersect1d(of[a], of[b], assume_unique=True))
            keep[n] = shared / (len(of[a]) + len(of[b]) - shared) >= similarity
        large = sum(map(len, of.values())) > GROUP_HASHES // 16
        of.clear()
        if large:
            release_memory()
        return asked.loc[keep, ["a", "b"]]

    asked = dealt.select(*(F.col(c).alias(f"of_{c}") for c in key), "a", "b")
    return members.groupBy(*key).cogroup(asked.groupBy(*(f"of_{c}" for c in key))).applyInPandas(decide, "a long, b long")
