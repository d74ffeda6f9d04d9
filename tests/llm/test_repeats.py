"""Removal of repeated strings against a plain index of all strings."""

import hashlib
import random
import tracemalloc

import numpy as np
import pytest

from veilframe.llm import repeats
from veilframe.llm.queries_duplicates import op6_phrase_repeats

SF = "/root/testdata/sf0.001"


def plain(rows, length):
    first = {}
    texts = [(2**63 - 1 if i is None else i, (t or "").encode()) for i, t in rows]
    for i, t in texts:
        for s in range(len(t) - length + 1):
            k = t[s:s + length]
            first[k] = min(i, first.get(k, i))
    out = []
    for (i, t), (given, _) in zip(texts, rows):
        gone = bytearray(len(t))
        for s in range(len(t) - length + 1):
            if first[t[s:s + length]] < i:
                gone[s:s + length] = b"\1" * length
        kept = bytes(c for c, g in zip(t, gone) if not g)
        spans = sum(g and (n == 0 or not gone[n - 1]) for n, g in enumerate(gone))
        out.append((given, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def test_rolling_hash():
    text = np.frombuffer(random.Random(0).randbytes(300), np.uint8)
    for size in (1, 2, 3, 7, 24, 49, 64, 300, 301):
        want = []
        for s in range(len(text) - size + 1):
            h = 0
            for c in text[s:s + size].tolist():
                h = (h * int(repeats.BASE) + c + 1) % 2**64
            want.append(h)
        assert repeats.rolling(text, size).tolist() == want


def test_suffix_order():
    draw = random.Random(1)
    text = bytes(draw.choice(b"ab\xff") for _ in range(500))
    start = np.array(draw.sample(range(480), 200))
    order, equal = repeats.sort_suffixes(np.frombuffer(text, np.uint8), start, 13)
    want = sorted(text[s:s + 13] for s in start.tolist())
    got = [text[s:s + 13] for s in start[order].tolist()]
    assert got == want and equal.tolist() == [n > 0 and got[n] == got[n - 1] for n in range(200)]


def shared_rows(seed, n=60):
    draw = random.Random(seed)
    word = lambda: "".join(draw.choice("abcdeé") for _ in range(draw.randint(1, 7)))
    text = lambda k: " ".join(word() for _ in range(k))
    passages = [text(draw.randint(5, 90)) for _ in range(8)]
    rows = []
    for i in range(n):
        parts = [draw.choice(passages) if draw.random() < 0.5 else text(draw.randint(0, 60)) for _ in range(draw.randint(0, 6))]
        t = " ".join(parts)
        if draw.random() < 0.4 and t:
            cut = sorted((draw.randrange(len(t)), draw.randrange(len(t))))
            t = t[cut[0]:cut[1]]
        rows.append((draw.randint(0, 400), t))
    copies = [(draw.randint(0, 400), draw.choice(rows)[1]) for _ in range(15)]
    junk = [(draw.randint(0, 400), "ab " * draw.randint(10, 400)) for _ in range(6)] + [(draw.randint(0, 400), "x" * draw.randint(40, 900)) for _ in range(6)]
    return rows + copies + junk + [(None, passages[0] * 2), (None, passages[0] * 2), (3, None), (4, ""), (5, "é" * 60), (900, "y" + "é" * 60)]


@pytest.mark.parametrize("seed,length,slice_size", [(1, 50, 1 << 21), (2, 50, 400), (3, 25, 300), (4, 64, 1 << 21)])
def test_remove_repeats(spark, monkeypatch, seed, length, slice_size):
    cut = repeats.slices
    monkeypatch.setattr(repeats, "slices", lambda texts, n: cut(texts, n, slice_size))
    rows = shared_rows(seed)
    df = spark.createDataFrame([(i, t, "other", 1) for i, t in rows], "doc_id long, text string, lang string, kept int").repartition(4)
    import hashlib as h

    found = repeats.remove_repeats(df, length).collect()
    got = sorted(((r.doc_id, r.n_bytes, r.n_bytes - len(r.kept), len(r.spans), h.sha256(bytes(r.kept)).hexdigest()) for r in found), key=repr)
    assert got == plain(rows, length)
    assert all(r.lang == "other" for r in found)


def test_strings_sorted_in_parts(monkeypatch):
    rng = np.random.default_rng(3)
    length, per, base = 101, 400, rng.integers(97, 123, 200_000, np.uint8)
    messages = []
    for _ in range(5):
        docs, places = rng.integers(0, 999, 200), rng.integers(0, len(base) - per - length, 200).tolist()
        messages.append(b"".join((np.array([200], "<i8").tobytes(), docs.astype("<i8").tobytes(), np.full(200, per, "<i8").tobytes(),
                                  *(base[a:a + per + length - 1].tobytes() for a in places))))
    tracemalloc.start()
    parts = repeats._suffixes_answer(messages, length)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    strings = 5 * 200 * per
    assert peak < 100 * strings
    monkeypatch.setattr(repeats, "SORTED", strings)
    assert parts == repeats._suffixes_answer(messages, length)
    assert 0 < sum(sum(x) for x in parts) < strings


def test_characters_cut_in_half(spark):
    passage = "".join(random.Random(3).choices("abcdefgh ", k=90))
    df = spark.createDataFrame([(1, passage + "é"), (2, "so: " + passage + "è!"), (3, "東" + passage), (None, None)], "doc_id long, text string")
    bytes_of = lambda whole: {r["doc_id"]: bytes(r["kept"]) for r in repeats.remove_repeats(df, 50, whole_characters=whole).collect()}
    assert bytes_of(False) == {1: (passage + "é").encode(), 2: b"so: \xa8!", 3: "東".encode(), None: b""}
    assert bytes_of(True) == {1: (passage + "é").encode(), 2: b"so: !", 3: "東".encode(), None: b""}


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert repeats.remove_repeats(df).collect() == []


def test_repeats_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = sorted((tuple(r) for r in op6_phrase_repeats(spark, SF).collect()), key=repr)
    assert got == plain([tuple(d) for d in docs], 50)
    assert sum(r[2] for r in got) > 0
