"""The pipeline's stages against plain versions, and on hard rows."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline as cp
from test_planning import plain_targets
from test_repeats import plain as plain_repeats
from veilframe.llm import packing, simhash

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, extra int, score string"
WORD = r"[^\x20\x09-\x0D]+"


def shingles(text, n=5):
    w = re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} or {tuple(w)}


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    out.append(docs)
    for name, stage in cp.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, out[-1], SF).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def test_columns(stages):
    for df in stages[1:-1]:
        assert df.columns == list(cp.COLUMNS)


def test_quality_stage(spark, stages):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r.doc_id for r in stages[1].collect()}
    good = [i for i, q in labels.items() if q == 1]
    bad = [i for i, q in labels.items() if q == 0]
    assert np.mean([i in kept for i in good]) > 0.99 and np.mean([i in kept for i in bad]) < 0.1


def test_near_duplicate_stage(stages):
    before = sorted(stages[1].collect(), key=lambda r: r.doc_id)
    kept = {r.doc_id for r in stages[2].collect()}
    sets = {r.doc_id: shingles(r.text) for r in before}
    best = {}
    for i, r in enumerate(before):
        best[r.doc_id] = max((len(sets[r.doc_id] & sets[o.doc_id]) / len(sets[r.doc_id] | sets[o.doc_id]) for o in before[:i]), default=0)
    alike = [i for i, s in best.items() if s >= 0.85]
    apart = [i for i, s in best.items() if s < 0.5]
    exact = [i for i, s in best.items() if s == 1]
    assert exact and not kept & set(exact)
    assert len(alike) > 20 and np.mean([i in kept for i in alike]) < 0.1
    assert np.mean([i in kept for i in apart]) > 0.99


def test_repeats_stage(stages):
    before, after = stages[2].collect(), {r.doc_id: r for r in stages[3].collect()}
    want = {w[0]: w for w in plain_repeats([(r.doc_id, r.text) for r in before], cp.PASSAGE)}
    for r in before:
        _, n, gone, _, _ = want[r.doc_id]
        if gone == 0:
            assert after[r.doc_id] == r
        elif r.doc_id in after:
            got = after[r.doc_id]
            assert n - gone - 8 <= len(got.text.encode()) <= n - gone and got.n_chars == len(got.text)
        else:
            assert n - gone < 200
    assert len(after) >= 0.95 * len(before)


def test_repeats_stage_needs_no_second_python_worker(spark):
    docs = spark.createDataFrame([(1, "some text", "en", "a", 9)], "doc_id long, text string, lang string, source string, n_chars long")
    plan = cp.suffix_array_duplicates(spark, docs, SF)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "EvalPython" not in plan


def test_mixing_stage(stages):
    before, after = stages[3].collect(), stages[4].collect()
    size = lambda t: len(re.findall(WORD, t or ""))
    sizes, took = defaultdict(int), defaultdict(int)
    for r in before:
        sizes[r.source] += size(r.text)
    for r in after:
        took[r.source] += size(r.text)
    want = plain_targets(sizes, cp.WEIGHTS, cp.SHARE, cp.MOST)
    assert all(abs(took[s] - want[s]) <= 1 for s in sizes)
    texts = {r.doc_id: r for r in before}
    parts = 0
    for r in after:
        if r != texts[r.doc_id]:
            parts += 1
            assert texts[r.doc_id].text.startswith(r.text) and r.n_chars == len(r.text)
    assert parts <= len(sizes) and max(Counter(r.doc_id for r in after).values()) <= 2


def test_packing_stage(spark, stages):
    from test_tokens import check_packing, plain_best_fit

    rows = stages[5].collect()
    assert check_packing(rows, 2048) <= plain_best_fit([r.length for r in rows], 2048)
    assert {r.doc_id for r in rows} == {r.doc_id for r in stages[4].collect()}
    assert cp.ORACLE_SQL is None and len(cp.run(spark, "/root/testdata/sf0.001").collect()) > 0


def hard(spark, n=3):
    texts = ["", None, " \n", "word", "é" * 400, "some words here and there " * 30, "x " * 20_000, "One more text, of a few words, that ends here."]
    rows = [(None if i == 5 else i, t, None if i % 3 else "en", None if i % 2 else "s", None if i == 4 else len(t or ""), i, "s") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows * n + [(40, texts[4] + "中", "en", "s", 401, 0, None)], SCHEMA)


@pytest.mark.parametrize("name,stage", cp.STAGES)
def test_hard_rows(spark, name, stage):
    df = hard(spark)
    got = stage(spark, df, SF).collect()
    assert stage(spark, df.limit(0), SF).collect() == []
    ids = Counter(r.doc_id for r in got)
    if name == "simhash_near_duplicates":
        assert ids == {0: 1, None: 3, 3: 1, 4: 1, 6: 1, 7: 1} or ids == {0: 1, None: 3, 3: 1, 4: 1, 6: 1, 7: 1, 40: 1}
    if name == "suffix_array_duplicates":
        assert [r.text for r in got if r.doc_id == 40] == ["中"]
        assert sum(r.text is None for r in got) == 3
    if name == "mix_sources":
        assert 0 not in ids and 1 not in ids and 2 not in ids and ids[3] > 0
    if name == "best_fit_packing":
        assert ids[1] == ids[0] == 3


def test_near_groups_in_tiles(spark, monkeypatch):
    """Tiles at crowded anchors find the same groups."""
    import random

    draw = random.Random(4)
    word = lambda: "".join(draw.choices("abcdefgh", k=draw.randint(2, 7)))
    rows = []
    for _ in range(6):
        base = [word() for _ in range(150)]
        for _ in range(40):
            copy = list(base)
            for _ in range(draw.randint(0, 2)):
                copy[draw.randrange(150)] = word()
            rows.append((len(rows), " ".join(copy)))
    rows += [(len(rows) + i, " ".join(word() for _ in range(100))) for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    plain = {r.doc_id: r.component_id for r in simhash.similar_documents(df).collect()}
    assert all(plain[i] == i // 40 * 40 for i in range(240)) and all(plain[i] == i for i in range(240, 290))
    monkeypatch.setattr(simhash, "LONG_CROWDED", 2)
    monkeypatch.setattr(simhash, "TILE", 16)
    monkeypatch.setattr(simhash, "GROUP_HASHES", 1000)
    assert {r.doc_id: r.component_id for r in simhash.similar_documents(df).collect()} == plain


def test_candidates_by_simhash_come_first(spark, monkeypatch):
    """Near copies of long texts are linked by their fingerprints, before shingles are compared; the sets decide."""
    import random

    draw = random.Random(6)
    bases = [words_of(draw, 2000) for _ in range(4)]
    texts = [" ".join(base[:at] + words_of(draw, 1) + base[at + 1:]) for base in bases for at in (3, 500, 900, 1300)]
    asked, plain = [], simhash._near_pairs

    def watched(prints):
        pairs = plain(prints)
        asked.append(pairs.select("a", "b").distinct().count())
        return pairs

    monkeypatch.setattr(simhash, "_near_pairs", watched)
    assert groups_of(spark, texts) == {i: i // 4 * 4 for i in range(16)}
    assert len(asked) == 1 and asked[0] >= 8


def test_pairs_are_decided_in_slices(spark, monkeypatch):
    """Pairs beyond what may be on its way at one time are done slice by slice, with the same groups and no table left over."""
    import random

    draw = random.Random(12)
    passage = words_of(draw, 25)
    texts = []
    for _ in range(12):
        base = words_of(draw, 90)
        for _ in range(3):
            copy = list(base)
            copy[draw.randrange(90)] = words_of(draw, 1)[0]
            texts.append(" ".join(copy[:40] + passage + copy[40:]))
    plain, kept, gone = simhash.materialize, [], []
    monkeypatch.setattr(simhash, "materialize", lambda df, name: kept.append((name, plain(df, name))) or kept[-1][1])
    discard = simhash.discard
    monkeypatch.setattr(simhash, "COMMON", 10**6)
    monkeypatch.setattr(simhash, "discard", lambda *tables: gone.extend(t.__dict__.get("_written") for t in tables) or discard(*tables))
    want = groups_of(spark, texts)
    assert len(set(want.values())) < 36
    whole = [name for name, _ in kept]
    kept.clear()
    for name, size in (("SLICE_PAIRS", 50), ("PARITY_PAIRS", 20), ("SLICE_HASHES", 1000)):
        monkeypatch.setattr(simhash, name, size)
    assert groups_of(spark, texts) == want
    sliced = [name for name, _ in kept]
    assert sliced.count("links") > whole.count("links") and sliced.count("pairs") > whole.count("pairs")
    assert all(table._written in gone for name, table in kept if name in ("pairs", "loads", "dealt", "sets"))


def test_set_fingerprint_is_the_majority():
    import random

    draw = random.Random(2)
    for n in (1, 2, 3, 64, 70_001):
        hashes = [draw.getrandbits(64) for _ in range(n)]
        want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > n)
        assert simhash.set_fingerprint(np.array(hashes, np.uint64).view(np.int64)) % 2**64 == want


def test_no_lengths_give_no_bins():
    assert packing.plan_bins({}, 10) == []


def words_of(draw, n):
    return ["".join(draw.choices("abcdefghijklmnop", k=draw.randint(3, 8))) for _ in range(n)]


def groups_of(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r.component_id for r in simhash.similar_documents(df).collect()}


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b)


def plain_groups(texts):
    """Smallest reachable number by links of at least 0.8, every pair compared."""
    root = list(range(len(texts)))
    sets = [shingles(t) for t in texts]
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8 and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    return dict(enumerate(root))


def test_repeated_line_links_nothing(spark):
    """Two documents that repeat one line aren't alike by it."""
    import random

    draw = random.Random(7)
    line = words_of(draw, 8)
    texts = []
    for times in (20, 40) * 10:
        own = words_of(draw, 200)
        texts.append(" ".join(own[:100] + line * times + own[100:]))
    assert max(jaccard(a, b) for i, a in enumerate(texts) for b in texts[:i]) < 0.1
    assert groups_of(spark, texts) == {i: i for i in range(len(texts))}


def test_links_end_at_the_similarity(spark):
    """Pairs of 0.8 and more are linked and others aren't, also right at the bound."""
    import random

    draw = random.Random(8)
    texts = []
    for n in (60, 100, 300):
        for k in range(40):
            base = words_of(draw, n)
            copy = list(base)
            # Replaced at the end: every word takes one shingle of n - 4 from both sides.
            gone = max(1, round((n - 4) * (0.06 + 0.004 * k)))
            copy[n - gone:] = words_of(draw, gone)
            texts += [" ".join(base), " ".join(copy)]
    same = words_of(draw, 4 + 90)
    texts += [" ".join(same), " ".join(same[:84] + words_of(draw, 10)), " ".join(words_of(draw, 10) + same[10:])]
    assert jaccard(texts[-1], texts[-3]) == jaccard(texts[-2], texts[-3]) == 0.8
    near = [jaccard(texts[i], texts[i + 1]) for i in range(0, len(texts) - 3, 2)]
    assert sum(0.8 <= s < 0.84 for s in near) >= 10 and sum(0.7 < s < 0.8 for s in near) >= 20
    assert groups_of(spark, texts) == plain_groups(texts)


@pytest.mark.parametrize("kind", ["appended", "deleted", "scattered"])
def test_every_kind_of_edit_is_found(spark, kind):
    """No pair of at least 0.8 is missed, whatever the edit and the length."""
    import random

    draw = random.Random(kind)
    texts = []
    for n in (40, 100, 300):
        for k in range(40):
            base = words_of(draw, n)
            if kind == "appended":
                copy = base + words_of(draw, round((n - 4) * 0.006 * (k + 1)))
            elif kind == "deleted":
                at, gone = draw.randrange(n // 2), round((n - 4) * 0.006 * (k + 1))
                copy = base[:at] + base[at + gone:]
            else:
                copy = list(base)
                for _ in range(max(1, round(n * 0.001 * (k + 1)))):
                    copy[draw.randrange(n)] = words_of(draw, 1)[0]
            texts += [" ".join(base), " ".join(copy)]
    near = [jaccard(texts[i], texts[i + 1]) for i in range(0, len(texts), 2)]
    assert sum(0.8 <= s < 1 for s in near) >= 40
    assert groups_of(spark, texts) == plain_groups(texts)
