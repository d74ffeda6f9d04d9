"""Near duplicates and components against plain Python."""

import random

import numpy as np
import pytest
import xxhash

from veilframe.llm import simhash
from veilframe.llm.graph import components, united
from veilframe.llm.queries_duplicates import op10_anchor_simhash

SF = "/root/testdata/sf0.001"


def plain_components(nodes, links):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            root[n] = root[root[n]]
            n = root[n]
        return n

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("kind", ["random", "chain", "star", "none"])
def test_components(spark, kind):
    draw = random.Random(3)
    links = {"random": [(draw.randint(-200, 200), draw.randint(-200, 200)) for _ in range(260)],
             "chain": [(i * 7 % 300, (i + 1) * 7 % 300) for i in range(299)], "star": [(7, i) for i in range(200)], "none": []}[kind]
    want = plain_components({n for p in links for n in p if p[0] != p[1]}, links)
    df = spark.createDataFrame(links, "a long, b long").repartition(5)
    assert {r.node: r.root for r in components(df).collect()} == want
    a, b = united(np.array([p[0] for p in links], np.int64), np.array([p[1] for p in links], np.int64))
    assert {**{n: n for n in want}, **dict(zip(a.tolist(), b.tolist()))} == want


def plain_print(text, n=3):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    grams = [" ".join(words[i:i + n]) for i in range(len(words) - n + 1)] if len(words) >= n else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_anchor_cover():
    """Any two words within 2 bits meet at the home of either, and guests stay within distance 2."""
    draw = random.Random(5)
    base = [draw.getrandbits(64) for _ in range(300)] + [0, 2**64 - 1]
    for x in base:
        y = x
        for _ in range(draw.randint(0, 2)):
            y ^= 1 << draw.randrange(64)
        both = np.array([x, y], np.uint64).view(np.int64)
        homes, row, half, anchor = simhash.homes_and_guests(both)
        guests = {(int(h), int(a)) for r, h, a in zip(row, half, anchor) if r == 1}
        assert guests & {(0, int(homes[0, 0])), (1, int(homes[0, 1]))}
        assert all(((y >> 32 * h) & 0xFFFFFFFF ^ a).bit_count() <= 2 for h, a in guests) and len(guests) <= 34
        assert all(((x >> 32 * h) & 0xFFFFFFFF ^ int(homes[0, h])).bit_count() <= 1 for h in (0, 1))


def plain_near(prints):
    values = sorted(set(prints))
    return [(a, b) for i, a in enumerate(values) for b in values[:i] if (a ^ b).bit_count() <= 2]


def check_query(rows, docs):
    prints = {d.doc_id: plain_print(d.text) for d in docs}
    root = plain_components(set(prints.values()), plain_near(prints.values()))
    first = {}
    for i in sorted(prints):
        first.setdefault(root[prints[i]], i)
    assert sorted(map(tuple, rows)) == sorted((i, f"{p:016x}", first[root[p]]) for i, p in prints.items())


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_simhash_query(spark, sf):
    d = f"/root/testdata/sf{sf}"
    check_query(op10_anchor_simhash(spark, d).collect(), spark.read.parquet(f"{d}/documents.parquet").collect())


def test_hard_texts(spark):
    texts = ["", None, "  \n", "One", "one\ttwo", "ONE two", "Ünï ÜNÏ x y", "ünï ünï x y", "a b c", "A  B\nc", "a\x1cb c d", "x " * 20000]
    df = spark.createDataFrame([(None if i == 8 else i, t, "z") for i, t in enumerate(texts)] + [(0, "", "z")], "doc_id long, text string, fp string")
    got = {}
    for r in simhash.near_duplicates(df).collect():
        got.setdefault(r.doc_id, []).append((r.fp & (2**64 - 1), r.component_id))
    assert len(got[0]) == 2 and got[0][0] == got[0][1] == (0, 0) == got[1][0] == got[2][0]
    assert all(got[None if i == 8 else i][0][0] == plain_print(t) for i, t in enumerate(texts))
    assert got[None][0][1] == 9 == got[9][0][1] and got[5][0][1] == 4 and got[7][0][1] != got[6][0][1]
    assert simhash.near_duplicates(df.limit(0)).collect() == []


def test_crowded_anchors(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CROWDED", 3)
    monkeypatch.setattr(simhash, "TILE", 16)
    draw = random.Random(11)
    center = [draw.getrandbits(64) for _ in range(3)]
    prints = set()
    for c in center:
        for _ in range(250):
            x = c
            for _ in range(draw.randint(0, 5)):
                x ^= 1 << draw.randrange(64)
            prints.add(x)
    prints |= {draw.getrandbits(64) for _ in range(300)}
    signed = [int(x) for x in np.array(sorted(prints), np.uint64).view(np.int64)]
    links = simhash.near_links(spark.createDataFrame([(x,) for x in signed], "fp long"))
    got = {r.node: r.root for r in components(links).collect()}
    want = plain_components(signed, [(a, b) for i, a in enumerate(signed) for b in signed[:i] if ((a ^ b) & (2**64 - 1)).bit_count() <= 2])
    assert {n: got.get(n, n) for n in signed} == want


def test_guests_are_not_broadcast(spark, monkeypatch):
    """A fingerprint has up to 34 guests, which Spark takes for one; only tables that were counted may be broadcast."""
    plans, plain = {}, simhash.materialize

    def kept(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return plain(df, name)

    monkeypatch.setattr(simhash, "materialize", kept)
    draw = random.Random(1)
    prints = [draw.getrandbits(63) for _ in range(3000)]
    distinct = spark.createDataFrame([(x,) for x in [*prints, *(x ^ 5 for x in prints[:50])]], "fp long")
    want = {(min(x, x ^ 5), max(x, x ^ 5)) for x in prints[:50]}
    for small in (True, False):
        monkeypatch.setattr(simhash, "fits", lambda df, small=small: small)
        assert {(min(r), max(r)) for r in simhash.near_links(distinct).collect()} == want
        assert ("Broadcast" in plans["guests"], "BuildLeft" in plans["guests"]) == (small, False)
