"""Character bags against a plain count."""

import random
import re
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa

from veilframe.functions import fixed_values as fv
from veilframe.operators import evaluate

WS = re.compile(re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: chr(int(m[1], 16)), fv.WS).replace(r"\s", " \t\n\x0b\f\r"))
TEXTS = ["", None, "plain text\t here", "ﬁne ① ｶﾞ é\u0301 e\u0301", "東京都　ＡＢＣ", "\u00a0\ufeff\u2003", "한국 각", "😀😀 x\x00", "a\x85b\x1cc"]


def plain(text):
    return Counter(WS.sub("", unicodedata.normalize("NFKC", text or "")))


def test_bags_scores_and_differences(spark):
    draw = random.Random(3)
    letters = "abcé ①ﬁ東　\u0301e"
    left = [(i, t) for i, t in enumerate(TEXTS)] + [(i, "".join(draw.choices(letters, k=300))) for i in range(100, 130)] + [(500, "only left")]
    right = [(i, (t or "")[::-1] + "z") for i, t in left if i % 3 and i != 500] + [(600, "only right")]
    a, b = (spark.createDataFrame(x, "doc_id long, text string").repartition(3) for x in (left, right))
    bags, other = {i: plain(t) for i, t in left}, {i: plain(t) for i, t in right}
    got = {(r.doc_id, r.ch): r.n for r in evaluate.characters(a, "doc_id").collect()}
    assert got == {(i, c): n for i, bag in bags.items() for c, n in bag.items()}
    scores = {r.doc_id: (r.truth, r.read, r.same) for r in evaluate.character_scores(a, b, "doc_id").collect()}
    both = {i: (bags.get(i, Counter()), other.get(i, Counter())) for i in bags | other}
    assert scores == {i: (x.total(), y.total(), (x & y).total()) for i, (x, y) in both.items() if x or y}
    more = {(r.doc_id, r.ch): r.n for r in evaluate.character_difference(a, b, "doc_id").collect()}
    assert more == {(i, c): n for i, bag in bags.items() for c, n in (bag - other.get(i, Counter())).items()}


def test_long_texts_are_counted_in_parts(monkeypatch):
    text = " ".join("".join(random.Random(n).choices("abéе\u0301①", k=n % 40)) for n in range(300))
    monkeypatch.setattr(evaluate, "PART", 50)
    assert len(list(evaluate._parts(text))) > 50
    codes, counts = evaluate._counted(text.encode())
    assert dict(zip(map(chr, codes.tolist()), counts.tolist())) == plain(text)


def test_a_batch_needs_little_more_memory_than_its_texts():
    """Texts are never held as Python strings together, as they were."""
    import tracemalloc

    texts = [("größe " * 2000).encode()] * 500
    column = pa.array(texts, pa.binary())
    tracemalloc.start()
    found = [evaluate._counted(column[n].as_buffer().to_pybytes()) for n in range(len(column))]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) == 500 and peak < sum(map(len, texts)) / 4
