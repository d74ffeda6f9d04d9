"""Aligned tokens against plain loops over intervals."""

import hashlib
import json
import random
from collections import defaultdict

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from veilframe.llm import alignment
from veilframe.llm.queries_alignment import op13_aligned_tokens

SF = "/root/testdata/sf0.001"
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def byte_signs():
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(others)}


def tokens_of(texts):
    a, b, signs = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B), byte_signs()
    a.encode_special_tokens = True
    out = []
    for text in texts:
        if not text:
            out.append(([], []))
            continue
        ids = a.encode(" " + text, add_special_tokens=False).ids
        left = [(i, bytes(signs[c] for c in a.id_to_token(i))) for i in ids]
        right = []
        for i in b.encode(text):
            piece = b.id_to_piece(i)
            right.append((i, bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()))
        whole = (" " + text).encode()
        same = all(b"".join(t for _, t in side) == whole for side in (left, right))
        out.append((left, right) if same else ([], []))
    return out


def spans(side):
    at, out = 0, []
    for i, t in side:
        out.append((i, at, at + len(t)))
        at += len(t)
    return out


def plain(rows):
    found, holders = [], defaultdict(set)
    for n, (left, right) in enumerate(tokens_of([t for _, t in rows])):
        a, b = spans(left), spans(right)
        links = []
        q = 0
        for i, s, e in a:
            while q < len(b) and b[q][2] <= s:
                q += 1
            r = q
            while r < len(b) and b[r][1] < e:
                links.append((i, b[r][0]))
                r += 1
        cuts = sorted({e for _, _, e in a} & {e for _, _, e in b})
        groups, start = [], 0
        for cut in cuts:
            inside = [",".join(str(i) for i, s, e in side if start <= s and e <= cut) for side in (a, b)]
            groups.append("|".join(inside))
            start = cut
        for pair in links:
            holders[pair].add(n)
        found.append((a, b, groups, links))
    most = defaultdict(int)
    for (i, _), docs in holders.items():
        most[i] = max(most[i], len(docs))
    out = []
    for (doc_id, _), (a, b, groups, links) in zip(rows, found):
        counts = [len(holders[p]) for p in links]
        out.append((doc_id, len(a), len(b), len(groups), len(links), sum(c == most[p[0]] for c, p in zip(counts, links)), sum(counts),
                    hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""))
    return sorted(map(repr, out))


def hard_rows():
    draw = random.Random(5)
    words = ["the", "token", "Größe", "東京", "données", "naïve", "🙂", "x" * 40, "<|endoftext|>", "</s>", "<unk>", "<0x41>", "  ", "\n", "\t", "1234567", "don't", "é", " ", "\r\n"]
    rows = [(n, " ".join(draw.choice(words) for _ in range(draw.randint(1, 40)))) for n in range(80)]
    rows += [(100, None), (101, ""), (102, " "), (103, "▁ is a mark"), (104, "\x00\x01"), (105, "   "), (106, "a"), (107, "same text"), (108, "same text"), (107, "same text"), (None, "no id"), (None, None),
             (109, "long text " * 3000), (110, "  rare \U0010ffff")]
    return rows


@pytest.mark.parametrize("slice_bytes", [1 << 20, 300])
def test_alignment(spark, slice_bytes):
    rows = hard_rows()
    df = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], "doc_id long, text string, batch int, pairs string, at int")
    got = alignment.align_tokens(df, A, B, slice_bytes)
    assert ", ".join(f"{n} {t}".replace("bigint", "long") for n, t in got.dtypes) == alignment.RESULT
    expected = plain(rows)
    assert sorted(repr(tuple(r)) for r in got.collect()) == expected
    assert sum(", 0, 0, 0, 0, 0, 0, ''" in r for r in expected) == 4
    assert alignment.align_tokens(df.limit(0), A, B).collect() == []
    assert alignment.align_tokens(df.where("text is null or text = ''"), A, B).count() == 3


def test_vocabulary_is_that_of_the_file():
    one, plain_one = alignment.byte_level(A), Tokenizer.from_file(A)
    signs = byte_signs()
    assert one.entries.to_pylist() == [bytes(signs[c] for c in plain_one.id_to_token(i)) for i in range(len(one.entries))]
    assert len(one.entries) == plain_one.get_vocab_size() - 1
    assert alignment.BYTE_PATTERN == public_tokenizers.PATTERN


def test_bytes_of_a_file_of_single_bytes(tmp_path):
    file = tmp_path / "bytes.json"
    file.write_text(json.dumps({"model": {"vocab": {c: b for c, b in byte_signs().items()}}}), encoding="utf-8")
    one = alignment.byte_level(str(file))
    assert one.entries.to_pylist() == [bytes([b]) for b in range(256)]
    assert one.bytes_of(one.lists(["Größe\t東\xa0\xad\x7f"])).to_pylist() == [" Größe\t東\xa0\xad\x7f".encode()]


def test_query(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(repr(tuple(r)) for r in op13_aligned_tokens(spark, SF).collect()) == plain(rows)
