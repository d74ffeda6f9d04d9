"""Removes repeated byte strings, by prefix-free parsing.

Texts are parsed into phrases at triggers: places where the rolling hash of the
next ``length - 1`` bytes has its top bits zero. A phrase reaches from a trigger
to the end of the next trigger's window, so every string of ``length`` bytes
lies whole in the phrase its start falls in, and equal texts are parsed alike.

1. Parse. A phrase that also occurs in a document with a smaller id is a repeat
   as a whole; that is decided on the parse, phrase by phrase, and takes care of
   copies and of the inner parts of shared passages.
2. Dictionary. The other phrases, each at home in the first document that has
   it, can still share parts. Of the dictionary's suffixes only those can have
   an equal in another document whose seed has one: the seed of a string is the
   ``SEED`` bytes in it with the smallest hash. Suffixes with a shared seed
   are sorted by their first ``length`` bytes (a suffix array of that part of
   the dictionary); neighbours with a common prefix of ``length`` bytes form
   intervals, and all but the smallest document of an interval have a repeat.
3. Both together give every document's covered bytes.

Messages between batches of documents carry hashes and short strings; see
``batches``. Strings are compared byte by byte, phrases by 128-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.llm.batches import Batches, answered, by_box
from veilframe.session import materialize

LENGTH = 50
SEED = 24
PHRASE_BITS = 7  # triggers come every 2**7 bytes, about
SLICE = 1 << 18  # bytes that are hashed at a time
SORTED = 1 << 17  # strings that are sorted at a time, more only if they begin alike
BASE = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xD6E8FEB86659FD93)
PLACE = np.uint64((1 << 24) - 1)
NO_ID = 2**63 - 1


def rolling(text: np.ndarray, size: int) -> np.ndarray:
    """A polynomial hash of the ``size`` bytes at every place (none for the last ``size - 1``)."""
    if len(text) < size:
        return np.empty(0, np.uint64)
    power, width, level = BASE, 1, text.astype(np.uint64) + np.uint64(1)
    out, done = None, 0
    with np.errstate(over="ignore"):
        while True:
            if size & width:
                # ``out`` covers the first ``done`` bytes of the window, this level the next ``width``.
                out = level if out is None else out[:len(level) - done] * power + level[done:]
                done += width
            width *= 2
            if width > size:
                return out[:len(text) - size + 1]
            level = level[:len(level) - width // 2] * power + level[width // 2:]
            power = power * power


@dataclass
class Slice:
    """Parts of documents, end to end. A part has the window starts that are its own, and the bytes these need."""

    text: np.ndarray
    begin: np.ndarray  # of each part, in text
    end: np.ndarray
    doc: np.ndarray  # index of each part's document
    shift: np.ndarray  # place in the document minus place in text


def slices(texts: list[bytes], length: int, size: int = SLICE) -> Iterator[Slice]:
    """All documents that have ``length`` bytes, cut into parts of ``size`` window starts at most."""
    held, total = [], 0

    def made() -> Slice:
        sizes = np.array([len(t) for _, _, t in held], np.int64)
        end = np.cumsum(sizes)
        return Slice(np.frombuffer(b"".join(t for _, _, t in held), np.uint8), end - sizes, end,
                     np.array([d for d, _, _ in held], np.int64), np.array([p for _, p, _ in held], np.int64) - (end - sizes))

    for d, text in enumerate(texts):
        for at in range(0, len(text) - length + 1, size):
            part = text[at:at + size + length - 1]
            if held and total + len(part) > size:
                yield made()
                held, total = [], 0
            held.append((d, at, part))
            total += len(part)
    if held:
        yield made()


def phrases(s: Slice, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, end and part of every phrase of a slice; each has ``length`` bytes at least."""
    high = rolling(s.text, length - 1) >> np.uint64(64 - PHRASE_BITS)
    begin = np.unique(np.concatenate((s.begin, np.flatnonzero(high == 0))))
    part = np.searchsorted(s.begin, begin, "right") - 1
    inside = begin <= s.end[part] - length
    begin, part = begin[inside], part[inside]
    after = np.append(begin[1:], len(s.text)) + length - 1
    same = np.append(part[1:] == part[:-1], False)
    return begin, np.where(same, np.minimum(after, s.end[part]), s.end[part]), part


def digests(s: Slice, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """128-bit hashes, as pairs of numbers."""
    data, digest = s.text.tobytes(), xxhash.xxh3_128_digest
    return np.frombuffer(b"".join([digest(data[a:b]) for a, b in zip(begin.tolist(), end.tolist())]), "<u8").reshape(-1, 2)


def seeds(s: Slice, begin: np.ndarray, end: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The strings of ``length`` bytes in the given phrases, in runs with one seed.

    For each run the seed's hash, its place, and the first and the last string's place.
    """
    none = np.empty(0, np.int64)
    if not len(begin):
        return none.astype(np.uint64), none, none, none
    mark = np.zeros(len(s.text) + 1, np.int8)
    mark[begin] += 1
    np.subtract.at(mark, end - length + 1, 1)
    start = np.flatnonzero(np.cumsum(mark[:-1], dtype=np.int8) > 0)
    with np.errstate(over="ignore"):
        mixed = rolling(s.text, SEED)
        mixed = (mixed ^ (mixed >> np.uint64(31))) * MIX
        mixed ^= mixed >> np.uint64(29)
    low = (mixed & ~PLACE) | np.arange(len(mixed), dtype=np.uint64)
    span, width = length - SEED + 1, 1
    while 2 * width <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if span > width:
        low = np.minimum(low[:len(low) - (span - width)], low[span - width:])
    place = (low[start] & PLACE).astype(np.int64)
    new = np.concatenate(([True], (np.diff(place) != 0) | (np.diff(start) != 1)))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start)) - 1
    return mixed[place[first]], place[first], start[first], start[last]


def sort_suffixes(text: np.ndarray, start: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes by their first ``length`` bytes, and for each in that order whether it equals the one before."""
    words = []
    for at in range(0, length, 8):
        word = np.zeros(len(start), np.uint64)
        for k in range(at, min(at + 8, length)):
            word = word << np.uint64(8) | text[start + k].astype(np.uint64)
        words.append(word)
    order = np.lexsort(words[::-1])
    equal = np.ones(max(0, len(start) - 1), bool)
    for word in words:
        ranked = word[order]
        equal &= ranked[1:] == ranked[:-1]
    return order, np.concatenate(([False], equal))[:len(start)]


def _alike_begun(text: np.ndarray, start: np.ndarray) -> Iterator[np.ndarray]:
    """Parts of the strings, about ``SORTED`` each, of which no two have strings with the same first 8 bytes."""
    word = np.zeros(len(start), np.uint64)
    for k in range(8):
        word = word << np.uint64(8) | text[start + k]
    order = np.argsort(word)
    new = np.flatnonzero(np.diff(word[order])) + 1
    del word
    at = 0
    while at < len(order):
        after = np.searchsorted(new, at + SORTED)
        end = int(new[after]) if after < len(new) else len(order)
        yield order[at:end]
        at = end


class _Batch:
    """A batch's documents with what is known about them."""

    def __init__(self, rows: pa.Table, length: int):
        self.rows, self.length = rows, length
        self.texts = [(t or "").encode() for t in rows["text"].to_pylist()]
        self.ids = np.array([NO_ID if i is None else i for i in rows["doc_id"].to_pylist()], np.int64)
        self.slices = list(slices(self.texts, length))
        self.phrases = [phrases(s, length) for s in self.slices]
        found = [digests(s, b, e) for s, (b, e, _) in zip(self.slices, self.phrases)]
        every = np.concatenate([np.empty((0, 2), np.uint64), *found])
        docs = np.concatenate([np.empty(0, np.int64), *(self.ids[s.doc[p]] for s, (_, _, p) in zip(self.slices, self.phrases))])
        self.keys, self.code = _unique_pairs(every)
        self.first = np.full(len(self.keys), NO_ID, np.int64)
        np.minimum.at(self.first, self.code, docs)
        self.docs = docs

    def learn_firsts(self, messages: list[bytes]) -> None:
        """Take in the documents outside the batch that have its phrases first."""
        if messages:
            told = np.frombuffer(b"".join(messages), "<i8").reshape(-1, 3)
            at = _find_pairs(self.keys, told[:, :2].copy().view(np.uint64))
            self.first[at] = np.minimum(self.first[at], told[:, 2])

    def split(self) -> Iterator[tuple[Slice, np.ndarray, np.ndarray, np.ndarray]]:
        """For each slice its phrases' begin and end, and which of them are at home in their document."""
        at = 0
        for s, (begin, end, _) in zip(self.slices, self.phrases):
            mine = slice(at, at + len(begin))
            yield s, begin, end, self.docs[mine] <= self.first[self.code[mine]]
            at += len(begin)

    def suspects_by(self, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
        """Runs of strings with a shared seed: hash, document, place in it, number of strings, and their bytes.

        ``shared``: sorted seed hashes without their lowest bit.
        """
        out = [[np.empty(0, np.uint64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]]
        text: list[bytes] = []
        for s, begin, end, home in self.split():
            value, _, first, last = seeds(s, begin[home], end[home], self.length)
            plain = value >> np.uint64(1)
            at = np.minimum(np.searchsorted(shared, plain), max(0, len(shared) - 1))
            hit = shared[at] == plain if len(shared) else np.zeros(len(value), bool)
            value, first, last = value[hit], first[hit], last[hit]
            part = np.searchsorted(s.begin, first, "right") - 1
            for held, more in zip(out, (value, s.doc[part], first + s.shift[part], last - first + 1)):
                held.append(more)
            data = s.text.tobytes()
            text += [data[a:b] for a, b in zip(first.tolist(), (last + self.length).tolist())]
        return *(np.concatenate(x) for x in out), text


def _unique_pairs(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different rows, sorted, and for each row its place among them."""
    order = np.lexsort((pairs[:, 1], pairs[:, 0]))
    ranked = pairs[order]
    new = np.concatenate(([True], (ranked[1:] != ranked[:-1]).any(axis=1)))[:len(pairs)]
    code = np.empty(len(pairs), np.int64)
    code[order] = np.cumsum(new) - 1
    return ranked[new], code


def _find_pairs(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Places of ``wanted`` rows among sorted ``keys``; all are there."""
    both, code = _unique_pairs(np.concatenate((keys, wanted)))
    assert len(both) == len(keys)
    return code[len(keys):]


def _firsts_answer(messages: list[bytes]) -> list[bytes]:
    """Boxes of phrases: (hash, hash, smallest document of the batch) -> the same with a smaller one, where there is one."""
    sent = [np.frombuffer(m, "<i8").reshape(-1, 3) for m in messages]
    every = np.concatenate(sent)
    _, code = _unique_pairs(every[:, :2].copy().view(np.uint64))
    first = np.full(code.max(initial=-1) + 1, NO_ID, np.int64)
    np.minimum.at(first, code, every[:, 2])
    least, out, at = first[code], [], 0
    for m in sent:
        mine = least[at:at + len(m)]
        at += len(m)
        later = mine < m[:, 2]
        out.append(np.column_stack((m[later, :2], mine[later])).astype("<i8").tobytes())
    return out


def _seeds_answer(messages: list[bytes]) -> list[bytes]:
    """Boxes of seeds: different hashes, the lowest bit set where two documents of the batch have it -> those that two documents have."""
    sent = [np.frombuffer(m, "<u8") for m in messages]
    every = np.concatenate(sent)
    plain, code = np.unique(every >> np.uint64(1), return_inverse=True)
    count = np.zeros(len(plain), np.int64)
    np.add.at(count, code, 1 + (every & np.uint64(1)).astype(np.int64))
    shared = count[code] > 1
    out, at = [], 0
    for m in sent:
        out.append((m[shared[at:at + len(m)]] >> np.uint64(1)).astype("<u8").tobytes())
        at += len(m)
    return out


def _suffixes_answer(messages: list[bytes], length: int) -> list[bytes]:
    """Boxes of runs of strings -> for each run of a message, a byte for each string: 1 if a smaller document has it.

    A message: number of runs, then for each its document, then its number of strings, then the bytes of all.
    """
    docs, counts, texts = [], [], []
    for m in messages:
        n = int(np.frombuffer(m, "<i8", 1)[0])
        docs.append(np.frombuffer(m, "<i8", n, 8))
        counts.append(np.frombuffer(m, "<i8", n, 8 + 8 * n))
        texts.append(np.frombuffer(m, np.uint8, -1, 8 + 16 * n))
    doc, count, text = np.concatenate(docs), np.concatenate(counts), np.concatenate(texts)
    size = count + length - 1
    number = np.cumsum(count) - count
    start = np.repeat(np.cumsum(size) - size - number, count) + np.arange(count.sum())
    owner = np.repeat(doc, count)
    flag = np.empty(len(start), np.uint8)
    for some in _alike_begun(text, start):
        order, equal = sort_suffixes(text, start[some], length)
        interval = np.cumsum(~equal) - 1
        mine = owner[some][order]
        least = np.full(interval.max(initial=-1) + 1, NO_ID, np.int64)
        np.minimum.at(least, interval, mine)
        flag[some[order]] = least[interval] < mine
    out, at = [], 0
    for c in counts:
        out.append(flag[at:at + c.sum()].tobytes())
        at += int(c.sum())
    return out


def _distinct_runs(ids: np.ndarray, text: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Runs with equal bytes share a code; and for each code the run of the smallest document."""
    codes: dict[bytes, int] = {}
    code = np.array([codes.setdefault(t, len(codes)) for t in text], np.int64)
    order = np.lexsort((np.arange(len(code)), ids, code))
    ranked = code[order]
    return code, order[np.concatenate(([True], ranked[1:] != ranked[:-1]))[:len(code)]]


def remove_repeats(docs: DataFrame, length: int = LENGTH, whole_characters: bool = False) -> DataFrame:
    """Cut out all bytes covered by a string of ``length`` bytes that a document with a smaller id has too.

    ``docs(doc_id, text, ...)``; returns its columns other than ``text``, and
    ``n_bytes``, ``spans`` (array of begin and end of the maximal removed runs,
    in bytes of the UTF-8 text), ``kept`` (the remaining bytes). Columns of
    these names are replaced. Overlaps count, strings never cross documents and
    are judged on the input. A null text counts as empty. A null doc_id counts
    as the largest; rows that share an id, or have none, are each judged
    against smaller ids only. Very long texts are handled in parts. An empty
    table gives an empty one. ``length`` is more than ``SEED``. With
    ``whole_characters`` ``kept`` is UTF-8 again: where a cut leaves a part of a
    character, that part goes too.
    """
    if length <= SEED:
        raise ValueError(f"length must be above {SEED}")
    carry = [c for c in docs.columns if c not in ("doc_id", "text", "n_bytes", "spans", "kept")]
    own = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *(F.col(f"`{c}`") for c in carry))
    batches = Batches(own)
    boxes = batches.boxes

    def send_phrases(rows: pa.Table, known: list) -> Iterator[tuple[int, bytes]]:
        b = _Batch(rows, length)
        message = np.column_stack((b.keys.view(np.int64), b.first))
        for box, at in by_box((b.keys[:, 0] % np.uint64(boxes)).astype(np.int64), boxes):
            yield box, message[at].astype("<i8").tobytes()

    def send_seeds(rows: pa.Table, known: list) -> Iterator[tuple[int, bytes]]:
        b = _Batch(rows, length)
        b.learn_firsts(known[0])
        value, owner = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
        for s, begin, end, home in b.split():
            found, _, first, _ = seeds(s, begin[home], end[home], length)
            value.append(found >> np.uint64(1))
            owner.append(b.ids[s.doc[np.searchsorted(s.begin, first, "right") - 1]])
        value, owner = np.concatenate(value), np.concatenate(owner)
        order = np.lexsort((owner, value))
        value, owner = value[order], owner[order]
        new = np.concatenate(([True], value[1:] != value[:-1]))[:len(value)]
        other = np.concatenate(([False], (value[1:] == value[:-1]) & (owner[1:] != owner[:-1])))[:len(value)]
        twice = np.add.reduceat(other, np.flatnonzero(new)) > 0 if len(value) else other
        value = value[new]
        message = value << np.uint64(1) | twice.astype(np.uint64)
        for box, at in by_box((value % np.uint64(boxes)).astype(np.int64), boxes):
            yield box, message[at].astype("<u8").tobytes()

    def runs(rows: pa.Table, known: list):
        b = _Batch(rows, length)
        b.learn_firsts(known[0])
        told = np.sort(np.frombuffer(b"".join(known[1]), "<u8"))
        found = b.suspects_by(told)
        code, sent = _distinct_runs(b.ids[found[1]], found[4])
        return b, found, code, sent

    def send_runs(rows: pa.Table, known: list) -> Iterator[tuple[int, bytes]]:
        b, (value, doc, _, count, text), _, sent = runs(rows, known)
        for box, at in by_box(((value[sent] >> np.uint64(1)) % np.uint64(boxes)).astype(np.int64), boxes):
            mine = sent[at]
            yield box, b"".join((np.array([len(mine)], "<i8").tobytes(), b.ids[doc[mine]].astype("<i8").tobytes(),
                                 count[mine].astype("<i8").tobytes(), *(text[i] for i in mine), np.array([box], "<i8").tobytes()))

    def finish(rows: pa.Table, known: list) -> Iterator[pa.RecordBatch]:
        b, (value, doc, place, count, _), code, sent = runs(rows, known)
        sizes = np.array([len(t) for t in b.texts], np.int64)
        base = np.cumsum(sizes + 1) - sizes - 1  # a document's marks begin here
        mark = np.zeros(int((sizes + 1).sum()) + 1, np.int32)
        for (s, begin, end, home), (_, _, part) in zip(b.split(), b.phrases):
            at = (base[s.doc[part]] + s.shift[part])[~home]
            np.add.at(mark, at + begin[~home], 1)
            np.subtract.at(mark, at + end[~home], 1)
        # Answers come by box, in the order in which the runs were sent.
        answers = {int(np.frombuffer(m, "<i8", 1)[0]): np.frombuffer(m, np.uint8, -1, 8) for m in known[2]}
        order = [(box, at) for box, at in by_box(((value[sent] >> np.uint64(1)) % np.uint64(boxes)).astype(np.int64), boxes)]
        flags = np.concatenate([np.empty(0, np.uint8), *(answers[box] for box, _ in order)])
        asked = np.concatenate([np.empty(0, np.int64), *(at for _, at in order)])
        first = np.empty(len(sent), np.int64)
        first[asked] = np.cumsum(count[sent[asked]]) - count[sent[asked]]
        # The batch's smallest document with these strings asked for all; they repeat it in the others.
        nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        hit = (flags[np.repeat(first[code], count) + nth] > 0) | np.repeat(b.ids[doc] > b.ids[doc[sent]][code], count)
        start = (np.repeat(base[doc] + place, count) + nth)[hit]
        np.add.at(mark, start, 1)
        np.subtract.at(mark, start + length, 1)
        covered = np.cumsum(mark[:-1]) > 0
        spans, kept = [], []
        for text, x in zip(b.texts, base.tolist()):
            mine = np.concatenate(([False], covered[x:x + len(text)], [False]))
            edge = np.flatnonzero(mine[1:] != mine[:-1]).reshape(-1, 2).tolist()
            spans.append([{"begin": x, "end": y} for x, y in edge])
            if edge:
                text = b"".join(text[x:y] for x, y in zip([0, *(y for _, y in edge)], [*(x for x, _ in edge), len(text)]))
                text = text.decode("utf-8", "ignore").encode() if whole_characters else text
            kept.append(text)
        table = rows.combine_chunks()
        kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
        made = pa.table([
            table["doc_id"], *(table[c] for c in carry), pa.array([len(t) for t in b.texts], pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary()),
        ], names=["doc_id", *carry, "n_bytes", "spans", "kept"])
        yield from made.combine_chunks().to_batches()

    firsts = materialize(answered(batches.send([], send_phrases), _firsts_answer), "firsts")
    shared = materialize(answered(batches.send([firsts], send_seeds), _seeds_answer), "shared")
    flagged = materialize(answered(batches.send([firsts, shared], send_runs), lambda ms: _tagged(ms, length)), "flagged")
    kinds = "".join(f", `{c}` {t}" for c, t in own.dtypes if c in carry)
    schema = f"doc_id long{kinds}, n_bytes long, spans array<struct<begin: long, end: long>>, kept binary"
    return batches.read([firsts, shared, flagged], finish, schema)


def _tagged(messages: list[bytes], length: int) -> list[bytes]:
    """The answers of a box of runs, each with the box's number in front."""
    return [m[-8:] + a for m, a in zip(messages, _suffixes_answer([m[:-8] for m in messages], length))]
