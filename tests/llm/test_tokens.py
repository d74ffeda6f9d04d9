"""Token files and packing against plain Python."""

import random
import zlib

import numpy as np
import pytest

from veilframe.llm import packing, token_files
from veilframe.llm.queries_tokens import op1_token_files, op9_best_fit_packing, word_tokenizer
from veilframe.llm.tokens import WordTokenizer
from veilframe.llm.token_files import Segment, encode_segment, segments

SF = "/root/testdata/sf0.001"
HARD = ["", None, " ", "\t\n", "a", "It's we'll DON'T 12345 a1b2", "<|endoftext|> x<|startoftext|>y", "\u00e9 e\u0301 \u0301 x", "\u03a3\u03a3 \u03a3.", "\x1c a\x1cb\x0bc",
        "\u2003em\u00a0nb", "Abc. abc, .abc abc.. a.b. ABC,. O'Neil. x's, I.", "\u4e2d\u6587 \U0001f600\U0001f600", "x" * 5000, "word " * 30000]


def whole(texts, end):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(word_tokenizer())
    return [[*t.encode(x or "", add_special_tokens=False).ids, end] for x in texts]


def test_all_words_as_the_whole_tokenizer():
    import pyarrow as pa

    letters = [chr(c) for c in range(1, 0x250)] + ["\u0301", "\u4e00", "\ufb01", "\u1e9e"]
    draw = random.Random(2)
    texts = [a + b for a in ("", "a", "\u00df") for b in letters] + ["".join(draw.choices(letters, k=9)) + draw.choice(["", ".", "'s", "...", "<|", "###"]) for _ in range(3000)]
    coder = WordTokenizer(word_tokenizer())
    ids, bounds = coder.encode(pa.array(texts))
    got = [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])]
    assert got == [w[:-1] for w in whole(texts, 0)]


def test_few_calls_for_each_new_word():
    """Words are told apart and spelled as columns; in Python there is just the model's call for each new one."""
    import sys

    import pyarrow as pa

    draw = random.Random(3)
    texts = pa.array([" ".join("".join(draw.choices("abcdefg\u00e9\u00fc", k=9)) + draw.choice(["", ".", ","]) for _ in range(500)) for _ in range(10)])
    coder, calls = WordTokenizer(word_tokenizer()), 0
    coder.encode(pa.array(["warm up."]))

    def count(frame, event, arg):
        nonlocal calls
        calls += event in ("call", "c_call")

    sys.setprofile(count)
    try:
        ids, _ = coder.encode(texts)
    finally:
        sys.setprofile(None)
    assert calls < 2 * 5000
    assert ids.tolist() == [i for w in whole(texts.to_pylist(), 0) for i in w[:-1]]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_segment_round_trip():
    draw = random.Random(1)
    ids = [draw.choice([0, 1, 255, 256, 49000, 65535, 65536, 2**24, 2**32 - 1]) for _ in range(20_000)]
    data = encode_segment(3, 4, [7, None, 9], np.array([0, 600, 20_000]), np.array(ids)) + b"\n" + encode_segment(3, 5, [1], np.array([2]), np.array([5, 300])) + b"\n"
    first, second = segments(data)
    assert [first.token(i) for i in range(0, 20_000, 7)] == ids[::7]
    assert first.slice(123, 19_777).tolist() == ids[123:19_777]
    assert [first.document(k).tolist() for k in range(3)] == [[], ids[:600], ids[600:]]
    assert (second.part, second.number, second.document(0).tolist()) == (3, 5, [5, 300])
    with pytest.raises(IndexError):
        second.token(2)
    assert Segment(encode_segment(0, 0, [1], np.array([0]), np.array([], int))).slice(0, 0).tolist() == []


def rows_of(spark, texts):
    return spark.createDataFrame([(None if i == 3 else i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids_crc32 string")


def test_hard_texts(spark, tmp_path):
    docs = rows_of(spark, HARD).union(rows_of(spark, HARD[:2]))
    token_files.write_tokens(docs, str(tmp_path / "t"), word_tokenizer(), segment_tokens=1000)
    got = token_files.read_tokens(spark, str(tmp_path / "t")).orderBy("start").collect()
    pairs = sorted([(-1 if i == 3 else i, t) for i, t in [*enumerate(HARD), *enumerate(HARD[:2])]], key=lambda p: p[0])
    want = whole([t for _, t in pairs], 1)
    assert [(-1 if r.doc_id is None else r.doc_id) for r in got] == [i for i, _ in pairs]
    assert [(r.n_tokens, r.ids_crc32) for r in got] == [(len(w), crc(w)) for w in want]
    assert [r.start for r in got] == [sum(len(w) for w in want[:i]) for i in range(len(want))]


def test_empty_tables(spark, tmp_path):
    docs = rows_of(spark, HARD).limit(0)
    token_files.write_tokens(docs, str(tmp_path / "t"), word_tokenizer())
    assert token_files.read_tokens(spark, str(tmp_path / "t")).collect() == []
    assert packing.pack(packing.token_pieces(docs, word_tokenizer(), 64), 64).collect() == []


def test_token_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    want = whole([d.text for d in docs], 1)
    at, rows = 0, []
    for d, w in zip(docs, want):
        rows.append((d.doc_id, at, len(w), crc(w)))
        at += len(w)
    assert [tuple(r)[:4] for r in op1_token_files(spark, SF).orderBy("doc_id").collect()] == rows


def check_packing(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity
    return len(by)


def plain_best_fit(lengths, capacity):
    gaps = []
    for n in sorted(lengths, reverse=True):
        fit = [g for g in gaps if g >= n]
        if fit:
            gaps.remove(min(fit))
        gaps.append((min(fit) if fit else capacity) - n)
    return len(gaps)


def test_packing_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    rows = op9_best_fit_packing(spark, SF).collect()
    used = check_packing(rows, 2048)
    assert used <= plain_best_fit([r.length for r in rows], 2048)
    want = set()
    for d, ids in zip(docs, whole([d.text for d in docs], 0)):
        want |= {(d.doc_id, i, i * 2048, len(p), crc(p)) for i, p in enumerate(ids[a:a + 2048] for a in range(0, len(ids), 2048))}
    assert {tuple(r)[:5] for r in rows} == want and len(rows) == len(want)


@pytest.mark.parametrize("seed", range(40))
def test_plan_is_best_fit(seed):
    draw = random.Random(seed)
    capacity = draw.choice([10, 30, 64, 100])
    lengths = [draw.randint(1, draw.choice([3, capacity // 2, capacity])) for _ in range(draw.randint(0, 300))]
    counts = {n: lengths.count(n) for n in set(lengths)}
    bins = packing.plan_bins(counts, capacity)
    filled = {}
    for b in bins:
        assert sum(n * c for n, c in b.items) + b.gap == capacity and b.gap >= 0 and b.count > 0 and b.items
        for n, c in b.items:
            filled[n] = filled.get(n, 0) + c * b.count
    assert filled == counts
    assert sum(b.count for b in bins) <= plain_best_fit(lengths, capacity)


def test_sequences_hold_the_ids(spark):
    docs = rows_of(spark, HARD).where("doc_id is not null")
    pieces = packing.token_pieces(docs, word_tokenizer(), 256)
    placed = packing.pack(pieces, 256).cache()
    check_packing(placed.collect(), 256)
    made = packing.sequences(pieces, placed).collect()
    flat = sorted(x for r in made for x in np.frombuffer(bytes(r.ids), "<u4").tolist())
    assert flat == sorted(x for i, w in enumerate(whole(HARD, 0)) if i != 3 for x in w)
    assert all(len(r.ids) <= 1024 for r in made)
