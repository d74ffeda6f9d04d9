"""Sharding and mixing against plain Python."""

import re
from collections import Counter, defaultdict

import pytest

from pyspark.sql import functions as F

from veilframe.llm import mixing, sharding
from veilframe.llm.queries_planning import SHARDS, op2_table_sharding, op3_low_discrepancy_mix

SF = "/root/testdata/sf0.001"


def plain_table(shards, slots):
    """Whole preference lists first, then turns."""
    prefs = []
    for s in shards:
        start, step = sharding._number("start " + s) % slots, sharding._number("step " + s) % (slots - 1) + 1
        prefs.append([(start + j * step) % slots for j in range(slots)])
    table = {}
    turn = 0
    while len(table) < slots:
        i = turn % len(shards)
        table[next(p for p in prefs[i] if p not in table)] = i
        turn += 1
    return [table[j] for j in range(slots)]


def test_lookup_table():
    names = [f"n{i}" for i in range(7)]
    assert sharding.lookup_table(names, 101) == plain_table(names, 101)
    table = sharding.lookup_table(SHARDS)
    held = Counter(table)
    assert max(held.values()) - min(held.values()) <= 1 and len(held) == 64
    fewer = sharding.lookup_table(SHARDS[:-1])
    moved = sum(a != b for a, b in zip(table, fewer) if a != 63)
    assert moved < 0.05 * len(table)
    for bad in (["a", "a"], []):
        with pytest.raises(ValueError):
            sharding.lookup_table(bad)
    with pytest.raises(ValueError):
        sharding.lookup_table(["a"], 100)


def test_hot_keys_spread(spark):
    rows = [(i if i % 3 else None, f"t{i}", "old", 1, 2) for i in range(6000)]
    df = spark.createDataFrame(rows, "k long, t string, shard string, _n int, _hot int")
    got = sharding.place(df, ["k"], [F.col("t")], [f"s{i}" for i in range(8)], 1009).collect()
    assert len(got) == 6000
    per = Counter(r.shard for r in got)
    assert len(per) == 8 and max(per.values()) < 3 * 6000 / 8
    by_key = defaultdict(set)
    for r in got:
        by_key[r.k].add(r.shard)
    assert all(len(s) == 1 for k, s in by_key.items() if k is not None) and len(by_key[None]) > 3
    again = sharding.place(df.repartition(3), ["k"], [F.col("t")], [f"s{i}" for i in range(8)], 1009).collect()
    assert {(r.t, r.shard) for r in again} == {(r.t, r.shard) for r in got}
    assert sharding.place(df.limit(0), ["k"], [F.col("t")], ["a"], 11).collect() == []


def test_equal_rows_of_a_hot_key_spread(spark):
    """A key whose rows are all equal fills no shard; small tables keep their keys whole."""
    names = [f"s{i}" for i in range(64)]
    rows = spark.range(10_000).select(F.when(F.col("id") >= 6000, F.col("id")).alias("k"), F.when(F.col("id") >= 6000, F.lit("t")).alias("t"))
    for df in (rows.coalesce(1), rows.repartition(5)):
        per = {r.shard: r["count"] for r in sharding.place(df, ["k"], [F.col("t")], names).groupBy("shard").count().collect()}
        assert sum(per.values()) == 10_000 and len(per) == 64 and max(per.values()) < 6 * 10_000 / 64
    small = spark.createDataFrame([(i % 20, str(i)) for i in range(400)], "k int, t string")
    got = sharding.place(small, ["k"], [F.col("t")], names).collect()
    assert len({(r.k, r.shard) for r in got}) == 20


def test_sharding_hard_rows(spark):
    texts = [None, "", " ", "x" * 100_000, "a", "a"] * 50
    df = spark.createDataFrame([(None if i % 3 else i, t, i) for i, t in enumerate(texts)], "k long, t string, slot long")
    got = sharding.place(df, ["k"], [F.col("t"), F.octet_length("t")], ["a", "b", "c"], 101)
    assert got.columns == ["k", "t", "slot", "shard"]
    rows = got.collect()
    assert sorted((str(r.k), str(r.t)) for r in rows) == sorted((str(r.k), str(r.t)) for r in df.collect())
    table = sharding.lookup_table(["a", "b", "c"], 101)
    assert all(r.shard == "abc"[table[r.slot]] for r in rows)


def test_sharding_query(spark, tmp_path):
    rows = op2_table_sharding(spark, SF)
    table = sharding.lookup_table(SHARDS)
    got = rows.collect()
    assert len(got) == 200 and all(r.shard == SHARDS[table[r.slot]] for r in got)
    sharding.write_shards(rows, str(tmp_path / "out"))
    assert {(r.doc_id, r.shard) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {(r.doc_id, r.shard) for r in got}


def plain_targets(sizes, weights, share, most):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    cap = {s: most * sizes[s] for s in order}
    goal, full = share * sum(sizes.values()), set()
    while True:
        rest = goal - sum(cap[s] for s in full)
        open_w = sum(w[s] for s in order if s not in full)
        over = {s for s in order if s not in full and open_w and rest * w[s] / open_w > cap[s]}
        if not over:
            return {s: cap[s] if s in full or not open_w else rest * w[s] / open_w for s in order}
        full |= over


def check_mix(rows, sizes):
    by = defaultdict(int)
    for r in rows:
        by[r.source] += r.size
        assert 0 <= r.taken <= 2 * r.size
    want = plain_targets(by, [3, 1, 2], 1.5, 2)
    for s in by:
        mine = [r for r in rows if r.source == s]
        assert all(r.source_size == by[s] and abs(r.target - want[s]) <= 1e-6 * max(1, want[s]) for r in mine)
        assert abs(sum(r.taken for r in mine) - want[s]) <= 1
    assert sorted(r.size for r in rows) == sorted(sizes)


def test_mix_query(spark):
    rows = op3_low_discrepancy_mix(spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    check_mix(rows, [len(re.findall(r"[^\x20\x09-\x0D]+", d.text or "")) for d in docs])
    assert sorted(map(tuple, rows)) == sorted(map(tuple, op3_low_discrepancy_mix(spark, SF).collect()))


@pytest.mark.parametrize("block", [1, 7, 1024])
def test_mix_hard_rows(spark, block):
    sizes = [0, 5, 5, 5, None, 900, 1, 2, 3, 40, 40]
    names = ["b", "a", "a", "a", "a", "z", None, None, "é", "e", "only zero"]
    rows = [(None if i % 4 == 0 else 1, names[i], sizes[i]) for i in range(len(sizes))] + [(9, "empty", 0)] + [(5, "a", 5)] * 3
    df = spark.createDataFrame([(*r, 0, "k", 9) for r in rows], "doc_id long, source string, size long, taken int, _key string, block int")
    made = mixing.mix(df, [3, 1, 2], 1.5, 2, block)
    taken = mixing.lookup(made.taken, made.sources.select("source_no", "source_size", "target"), ["source_no"]).collect()
    check_mix(taken, [s or 0 for _, _, s in rows])
    slots = [r.slot for r in made.schedule.collect()]
    assert len(slots) == len(set(slots))
    assert made.pieces.agg(F.sum(F.col("to_word") - F.col("from_word"))).first()[0] == sum(r.taken for r in taken)
    assert mixing.mix(df.limit(0), [1], 1.5).taken.collect() == []
    nothing = mixing.mix(df.where("size = 0"), [1], 1.5)
    assert [r.taken for r in nothing.taken.collect()] == [0, 0]


def test_schedule_is_even(spark):
    df = spark.createDataFrame([(i, f"s{i % 5}", 1000) for i in range(2000)], "doc_id long, source string, size long")
    made = mixing.mix(df, [3, 1, 2], 1.5, 2, 100)
    rows = made.schedule.orderBy("slot").collect()
    total = Counter(r.source_no for r in rows)
    for at in range(500, len(rows), 500):
        seen = Counter(r.source_no for r in rows[:at])
        assert all(abs(seen[s] - at * total[s] / len(rows)) < 12 for s in total)
