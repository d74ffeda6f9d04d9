"""Codes, mapping tables, restore, review, batches, lookups and streams."""

import random
import re
import time
from functools import partial

import pytest
from pyspark.sql import functions as F

from veilframe.operators import audit, codes, lookup, ranking, redact as r, restore as rs, review
from veilframe.operators.detect import detect, find, item_table
from veilframe.operators.names import unique_names
from veilframe.operators.rules import (
    builtin_rules, custom_rule, new_rule_id, regex_problem, rules_fingerprint, rules_from_table, rules_table, with_builtins_disabled,
    with_retention,
)
from veilframe.functions.retention import Retention
from veilframe.plans.pipelines import deidentify, deidentify_shared, deidentify_with_mapping
from veilframe.session import shared_folder
from veilframe.sources import mapping as m
from veilframe.sources.documents import pasted, read_text_files, write_documents
from veilframe.sources.rule_config import rules_from_json, rules_to_json
from veilframe.sources.synthetic import people
from veilframe.streaming.stream import continuing_batches, deidentify_stream

TEXTS = [
    (1, "a@x.tw wrote to b@x.tw, then a@x.tw called 0912-345-678."),
    (2, "a@x.tw 王小明先生 A123456789 [x:ffffff]"), (3, "nothing"), (4, ""),
]


@pytest.fixture()
def docs(spark):
    return spark.createDataFrame(TEXTS, "doc_id int, text string")


def small_codes(monkeypatch, digits):
    """Make codes short, so that clashes are frequent."""
    whole = codes._code_of_text
    monkeypatch.setattr(codes, "_code_of_text", lambda *a: F.substring(whole(*a), 1, digits))


@pytest.mark.parametrize("mode", ["hide", "standard"])
def test_round_trip_per_document(spark, docs, mode):
    done = deidentify_with_mapping(docs, mode=mode, secret="s")
    out = {x["doc_id"]: x["redacted"] for x in done.documents.collect()}
    assert "a@x.tw" not in out[1] and out[3] == "nothing" and out[4] == ""
    back = rs.restore(done.documents.select("doc_id", "redacted"), done.mapping, "doc_id")
    assert {x["doc_id"]: x["restored"] for x in back.collect()} == dict(TEXTS)
    report = {x["doc_id"]: (x["restored"], list(x["missing_codes"])) for x in rs.restore_report(done.documents, done.mapping, "doc_id").collect()}
    assert report == {1: (4, []), 2: (3, ["ffffff"])}
    assert audit.residue(done.documents, "doc_id").count() == 0
    assert audit.broken_round_trips(done.documents, done.mapping, "doc_id").count() == 0
    assert [tuple(x)[1:] for x in audit.unpaired_codes(done.documents, done.mapping, "doc_id").collect()] == [("ffffff", True, False)]


def test_same_value_shares_a_code_only_in_its_scope(spark, docs):
    per_doc = item_table(deidentify(docs, secret="s"), "doc_id").where("value = 'a@x.tw'").select("doc_id", "code").distinct()
    assert per_doc.count() == 2 and per_doc.select("code").distinct().count() == 2
    shared = deidentify_shared(docs, secret="s")
    assert shared.mapping.where("original = 'a@x.tw'").count() == 1
    other = item_table(deidentify(docs, secret="t"), "doc_id").where("value = 'a@x.tw'").select("code").distinct()
    assert other.join(per_doc, "code").count() == 0


def test_clashing_codes_inside_a_document(spark, monkeypatch):
    small_codes(monkeypatch, 2)
    text = " ".join(f"user{n}@x.tw" for n in range(60)) + " user3@x.tw"
    docs = spark.createDataFrame([(n, text) for n in range(5)], "doc_id int, text string")
    items = item_table(deidentify(docs, rules=builtin_rules("email"), secret="s"), "doc_id")
    per = items.groupBy("doc_id").agg(F.count_distinct("value").alias("v"), F.count_distinct("code").alias("c"),
                                      F.count_distinct("value", "code").alias("vc"))
    assert {(x["v"], x["c"], x["vc"]) for x in per.collect()} == {(60, 60, 60)}


def test_clashing_codes_in_a_shared_scope(spark, monkeypatch):
    small_codes(monkeypatch, 2)
    docs = spark.createDataFrame([(n, f"user{n}@x.tw user{n + 1}@x.tw") for n in range(100)], "doc_id int, text string")
    done = deidentify_shared(docs, rules=builtin_rules("email"), secret="s")
    pairs = done.mapping.select("code", "original").collect()
    assert len(pairs) == 101 == len({p["code"] for p in pairs}) == len({p["original"] for p in pairs})
    table = dict((p["original"], p["code"]) for p in pairs)
    for x in done.documents.select("doc_id", "redacted").collect():
        n = x["doc_id"]
        assert x["redacted"] == f"[電子郵件:{table[f'user{n}@x.tw']}] [電子郵件:{table[f'user{n + 1}@x.tw']}]"


def test_codes_continue_from_an_earlier_table(spark, monkeypatch):
    small_codes(monkeypatch, 2)
    earlier = spark.createDataFrame([("shared", 1, "aa", "電子郵件", "user1@x.tw", "", ""), ("shared", 2, "bb", "電子郵件", "user1@x.tw", "", ""),
                                     ("shared", 3, "cc", "電子郵件", "gone", "", "")],
                                    "scope string, line_no int, code string, category string, original string, kept_prefix string, kept_suffix string")
    docs = spark.createDataFrame([(n, f"user{n}@x.tw") for n in range(100)], "doc_id int, text string")
    done = deidentify_shared(docs, rules=builtin_rules("email"), secret="s", imported=earlier)
    table = {p["original"]: p["code"] for p in done.mapping.collect()}
    assert table["user1@x.tw"] == "aa" and len(set(table.values())) == 100 and not {"bb", "cc"} & set(table.values())
    conflict = codes.mapping_conflicts(earlier).collect()
    assert [(c["kept_code"], c["ignored_code"]) for c in conflict] == [("aa", "bb")]
    merged = r.merge_mappings(earlier, earlier.withColumn("original", F.lit("x")))
    assert {x["original"] for x in merged.collect()} == {"user1@x.tw", "gone"}


def test_lookup_with_a_hot_key(spark):
    left = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"), F.col("id").alias("n"))
    right = spark.range(0, 30_000, 7).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    want = sorted(map(tuple, left.join(right, "k", "left").fillna(-1).collect()))
    assert sorted(map(tuple, lookup.split_lookup(left, right, ["k"]).fillna(-1).collect())) == want
    assert sorted(map(tuple, lookup.lookup(left, right, ["k"], broadcast_rows=10).fillna(-1).collect())) == want
    assert sorted(map(tuple, lookup.lookup(left, right, ["k"]).fillna(-1).collect())) == want


def test_running_sum_over_a_hot_key(spark):
    rows = spark.range(20_000).select(F.when(F.col("id") % 3 == 0, F.col("id") % 50).otherwise(-1).alias("k"), F.hash("id").alias("h"), "id")
    got = ranking.numbered_rows(rows, ["k"], ["h", "id"], "n").collect()
    by_key = {}
    for x in sorted(got, key=lambda x: (x["h"], x["id"])):
        by_key.setdefault(x["k"], []).append(x["n"])
    assert all(v == list(range(1, len(v) + 1)) for v in by_key.values()) and len(by_key[-1]) > 13_000


@pytest.mark.parametrize("seed", range(3))
def test_unique_names(spark, seed):
    rng = random.Random(seed)
    pool = ["a.txt", "a (2).txt", "a (3).txt", "a (2) (2).txt", "b", "b (2)", ".x", ".x (2)", "c.d.e", "a (02).txt", "a (1).txt"]
    names = [rng.choice(pool) for _ in range(120)]
    taken, want = set(), []
    for name in names:
        new, k = name, 2
        while new in taken:
            dot = name.rfind(".")
            new = f"{name[:dot]} ({k}){name[dot:]}" if dot > 0 else f"{name} ({k})"
            k += 1
        taken.add(new)
        want.append(new)
    df = spark.createDataFrame(list(enumerate(names)), "n int, name string")
    assert [x["unique_name"] for x in unique_names(df, "name", ["n"]).orderBy("n").collect()] == want


def test_mapping_csv_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("d", 1, "0a1b2c", "姓名", '小"明, 先', "王", ""), ("d", 2, "ffffff", "地址", "台北\n市", "", "")],
                                 "scope string, line_no int, code string, category string, original string, kept_prefix string, kept_suffix string")
    text = m.mapping_csv_text(rows).first()["csv"]
    assert text == chr(0xFEFF) + 'code,category,original,kept_prefix,kept_suffix\r\n0a1b2c,姓名,"小""明, 先",王,\r\nffffff,地址,"台北\n市",,\r\n'
    (tmp_path / "in.csv").write_bytes(text.replace("code,category", "note,code,category", 1).replace("\r\n0a1b2c", "\r\nn,0a1b2c", 1).replace("\r\nffffff", "\r\nn,ffffff", 1).encode())
    back = m.read_mapping(spark, str(tmp_path / "in.csv")).orderBy("line_no").collect()
    assert [(x["code"], x["original"], x["kept_prefix"]) for x in back] == [("0a1b2c", '小"明, 先', "王"), ("ffffff", "台北\n市", "")]
    m.write_mapping(rows, str(tmp_path / "out"))
    assert {x["original"] for x in m.read_mapping(spark, str(tmp_path / "out")).collect()} == {'小"明, 先', "台北\n市"}
    (tmp_path / "bad.csv").write_text("code,category\n1,2\n")
    with pytest.raises(ValueError, match="original"):
        m.read_mapping(spark, str(tmp_path / "bad.csv"))
    with pytest.raises(ValueError, match="duplicate_code aa"):
        m.strict_mapping(spark.createDataFrame([("d", 1, "aa"), ("d", 2, "aa ")], "scope string, line_no int, code string"))


def test_review(spark, docs):
    items = review.auto_items(item_table(detect(docs), "doc_id"))
    none = Retention().column()
    ask = spark.createDataFrame([(1, 7, 12), (1, 0, 3), (1, 5, 5), (3, 0, 99), (9, 0, 1)], "doc_id int, start int, end int").withColumn(
        "category", F.lit("識別碼")).withColumn("retention", none)
    more, rejected = review.add_manual(items, ask, docs, "doc_id")
    assert [(x["start"], x["value"]) for x in more.where("origin = 'manual'").collect()] == [(7, "wrote")]
    assert sorted((x["doc_id"], x["start"], x["reason"]) for x in rejected.collect()) == [(1, 0, "overlap"), (1, 5, "invalid_range"), (3, 0, "invalid_range")]
    off, _ = review.toggle(more, more.where("category = '電子郵件'"), "doc_id")
    assert off.where("active").count() == more.count() - 4
    redone = review.rescan(item_table(detect(docs), "doc_id"), off, "doc_id")
    assert redone.where("not active").count() == 4 and redone.where("origin = 'manual'").count() == 1
    attached = r.attach(docs, redone, "doc_id")
    out = {x["doc_id"]: x["redacted"] for x in r.redact(attached, "label").collect()}
    assert out[1] == "a@x.tw [識別碼] to b@x.tw, then a@x.tw called [手機]." and out[3] == "nothing"
    assert audit.overlaps(redone, "doc_id").count() == 0


def test_requests_of_one_call_meet(spark, docs):
    items = review.auto_items(item_table(detect(docs), "doc_id")).where("false")
    asked = [(1, 0, 5), (1, 3, 8), (1, 0, 5), (1, 5, 8), (1, 6, 7), (1, 8, 9), (3, 0, 4)]
    ask = spark.createDataFrame(asked, "doc_id int, start int, end int").withColumn(
        "category", F.lit("識別碼")).withColumn("retention", Retention().column())
    more, rejected = review.add_manual(items, ask, docs, "doc_id")
    assert sorted((x["doc_id"], x["start"], x["end"]) for x in more.collect()) == [(1, 0, 5), (1, 5, 8), (1, 8, 9), (3, 0, 4)]
    assert sorted((x["start"], x["end"], x["reason"]) for x in rejected.collect()) == [(0, 5, "overlap"), (3, 8, "overlap"), (6, 7, "overlap")]
    ordered = ask.withColumn("request_no", F.monotonically_increasing_id() * -1)
    more, _ = review.add_manual(items, ordered.where("start in (0, 3) and doc_id = 1"), docs, "doc_id")
    assert [(x["start"], x["end"]) for x in more.collect()] in ([(3, 8)], [(0, 5)])
    off = spark.createDataFrame([(1, 0, 5, False), (1, 3, 8, False), (1, 8, 9, False), (1, 20, 21, True)], "doc_id int, start int, end int, active boolean")
    back, late = review.toggle(off, off.where("not active"), "doc_id")
    assert sorted(x["start"] for x in back.where("active").collect()) == [0, 8, 20] and [x["start"] for x in late.collect()] == [3]
    label = r.redact(r.attach(docs, review.with_categories_off(review.auto_items(item_table(detect(docs), "doc_id")), ["電子郵件"]), "doc_id"), "label")
    assert "a@x.tw" in label.where("doc_id = 1").first()["redacted"]


def test_values_with_private_characters_come_back(spark):
    text = "\ue000a@x.tw\ue001 王小明先生 \ue002\ue003 ID-\ue000\ue001-9"
    docs = spark.createDataFrame([(1, text)], "doc_id int, text string")
    done = deidentify_with_mapping(docs, secret="s", rules=[*builtin_rules("email", "zh-name"), custom_rule("c-1", "n", "識別碼", r"ID-..-\d")])
    assert "ID-" not in done.documents.first()["redacted"]
    assert rs.restore(done.documents.select("doc_id", "redacted"), done.mapping, "doc_id").first()["restored"] == text


def test_very_many_items_in_one_text(spark):
    """Codes and mapping rows take time in proportion to the items."""
    text = " ".join(f"user{n}@x.tw" for n in range(12_000))
    docs = spark.createDataFrame([(1, text)], "doc_id int, text string")
    began = time.time()
    done = deidentify_with_mapping(docs, secret="s", rules=builtin_rules("email"))
    assert done.mapping.count() == 12_000 and time.time() - began < 60


def test_long_runs_without_addresses(spark):
    rule = builtin_rules("email")[0]
    docs = spark.createDataFrame([(1, "x" * 300_000 + " a@b.tw")], "doc_id int, text string")
    began = time.time()
    assert [x["value"] for x in find(docs, rule, "doc_id").collect()] == ["a@b.tw"]
    assert time.time() - began < 20
    draw = random.Random(1)
    texts = ["".join(draw.choices("ab1.@@-_ ", k=60)) + draw.choice(["", "a@b.cc", "a@b.cc_d@e.ff"]) for _ in range(400)]
    found = find(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), rule, "doc_id").collect()
    want = [(n, m.start(), m[0]) for n, t in enumerate(texts) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", t)]
    assert sorted((x["doc_id"], x["start"], x["value"]) for x in found) == sorted(want)


def test_mapping_files_with_headers_of_their_own(spark, tmp_path):
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "a.csv").write_bytes("\ufeffcode,category,original\r\naaaaaa,X,one\r\n\r\nbbbbbb,X,\"t\r\nwo\"\r\ncccccc,X,three\r\n".encode())
    (tmp_path / "m" / "b.csv").write_bytes(b"original,extra,category,code\nfour,e,Y,dddddd\n")
    got = m.read_mapping(spark, str(tmp_path / "m")).collect()
    assert sorted((x["code"], x["category"], x["original"], x["line_no"]) for x in got) == [
        ("aaaaaa", "X", "one", 2), ("bbbbbb", "X", "t\r\nwo", 4), ("cccccc", "X", "three", 6), ("dddddd", "Y", "four", 2)]
    m.write_mapping(got and m.read_mapping(spark, str(tmp_path / "m")), str(tmp_path / "out"))
    parts = [p.read_bytes() for p in (tmp_path / "out").glob("part-*")]
    assert parts and all(p.startswith(b"\xef\xbb\xbfcode,category,original\r\n") for p in parts)


def test_large_files_are_refused_unread(spark, tmp_path, monkeypatch):
    from veilframe.sources import documents

    monkeypatch.setattr(documents.fv, "MAX_FILE_BYTES", 5)
    (tmp_path / "large.txt").write_text("more than five", "utf-8")
    (tmp_path / "small.txt").write_text("five", "utf-8")
    docs, refused = read_text_files(spark, str(tmp_path))
    assert [x["text"] for x in docs.collect()] == ["five"] and [x["refused"] for x in refused.collect()] == ["too_large"]
    assert "LessThanOrEqual(length,5)" in docs._jdf.queryExecution().toString()


def test_keys_that_lose_every_draw_get_what_is_left(spark, monkeypatch):
    monkeypatch.setattr(codes, "CODE_LENGTH", 2)
    monkeypatch.setattr(codes, "CODES_PER_SCOPE", 256)
    monkeypatch.setattr(codes, "ATTEMPTS", 2)
    keys = spark.range(300).select(F.when(F.col("id") < 256, "full").otherwise("some").alias("scope"), F.lit("c").alias("category"), F.lit(0).alias("head"),
                                   F.lit(0).alias("tail"), F.col("id").cast("string").alias("value"))
    book = codes.allocate(keys, "s").collect()
    assert len(book) == 300 and len({(x["scope"], x["code"]) for x in book}) == 300 and all(len(x["code"]) == 2 for x in book)


def test_rules_that_do_not_compile_find_nothing(spark, docs):
    bad = custom_rule("c-bad", "n", "識別碼", "(")
    with pytest.warns(UserWarning, match="c-bad"):
        found = item_table(detect(docs, rules=[bad, *builtin_rules("email")]), "doc_id").collect()
    assert {x["rule_id"] for x in found} == {"email"}


def test_more_disabled_rules_than_a_thousand(spark):
    table = rules_table(spark)
    off = spark.range(3000).select(F.concat(F.lit("other-"), "id").alias("id")).unionByName(table.select("id"))
    assert with_builtins_disabled(table, off).where("enabled").count() == 0


def test_clusters_need_a_shared_folder(spark, monkeypatch):
    class Conf:
        def __init__(self, values):
            self.values = values

        def get(self, key, other=None):
            return self.values.get(key, other)

    class Session:
        conf = Conf({"spark.master": "spark://host:7077"})

    with pytest.raises(ValueError):
        shared_folder(Session())
    Session.conf = Conf({"spark.master": "spark://host:7077", "spark.checkpoint.dir": "/shared"})
    assert shared_folder(Session()) == "/shared"


def test_spans_longer_than_a_block_meet(spark):
    a = spark.createDataFrame([(1, 10, 30_000), (1, 40_000, 40_001)], "doc_id int, start int, end int")
    b = spark.createDataFrame([(1, 29_999, 29_999 + 5), (1, 40_001, 40_002)], "doc_id int, start int, end int")
    assert [x["start"] for x in review.overlapping(a, b, "doc_id").collect()] == [10]
    assert [x["start"] for x in review.overlapping(b, a, "doc_id").collect()] == [29_999]


def test_rule_configuration(spark):
    text = ('{"version":1,"disabledBuiltins":["email"],"customPatterns":[{"id":"c-1","name":"n","category":"識別碼","regex":"EMP-\\\\d+","example":"EMP-1","enabled":true},'
            '{"id":"c-2","name":"n","category":"識別碼","regex":"(","example":"","enabled":true},{"id":"c-3","name":"n","category":"識別碼","regex":"x*","example":"","enabled":true}],'
            '"retention":{"c-1":{"mode":"ends","head":4,"tail":0},"zh-name":{"mode":"ends","head":-1,"tail":0}}}')
    table = rules_from_json(spark, text)
    rules = rules_from_table(table)
    assert len(rules) == 16 and rules[-1].id == "c-1" and not [x for x in rules if x.id == "email"][0].enabled
    assert rules[-1].retention == Retention("ends", head=4, tail=0) and rules[0].retention == Retention() and rules[1].check is not None
    again = rules_from_table(rules_from_json(spark, rules_to_json(table)))
    assert [(x.id, x.enabled, x.retention) for x in again] == [(x.id, x.enabled, x.retention) for x in rules]
    for broken in (None, "", "{", '{"version":2,"disabledBuiltins":["email"]}'):
        assert rules_from_json(spark, broken).where("enabled").count() == 15
    docs = spark.createDataFrame([(1, "EMP-0042 x@y.tw")], "doc_id int, text string")
    assert deidentify(docs, rules=rules, style="label", mode="custom").first()["redacted"] == "EMP-[識別碼] x@y.tw"
    assert rules_fingerprint(table).first() != rules_fingerprint(rules_table(spark)).first()
    assert with_retention(table, Retention(), rule_id="c-1").where("retention is null or retention.mode = 'none'").count() == 16
    assert [regex_problem(spark, x) for x in (" ", "(", "a*", "a+")] == ["blank", "invalid", "matches_empty", None]
    assert spark.range(1).select(new_rule_id()).first()[0].startswith("c-")


def test_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "one.TXT").write_text("mail a@x.tw", "utf-8")
    (tmp_path / "in" / "two.markdown").write_text("# 王小明先生", "utf-8")
    (tmp_path / "in" / "three.exe").write_text("no", "utf-8")
    docs, refused = read_text_files(spark, str(tmp_path / "in"))
    assert [(x["file_name"], x["refused"]) for x in refused.collect()] == [("three.exe", "unsupported")]
    write_documents(deidentify(docs, style="label"), str(tmp_path / "out"))
    out = {x["file_name"]: x["text"] for x in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert out == {"one.deid.TXT": "mail [電子郵件]", "two.deid.markdown": "# [姓名]先生"}
    assert deidentify(pasted(spark, "x a@x.tw"), style="blank").first()["redacted"] == "x ○@○.○○"


def test_synthetic_values_are_found(spark):
    made = people(spark, 300)
    docs = made.select(F.col("id").alias("doc_id"), F.concat_ws(
        "；", F.concat("name", F.lit("先生")), "tw_id", "mobile", "landline", "address", "email", "company", "tax_id").alias("text"))
    found = item_table(detect(docs), "doc_id").groupBy("category").count().collect()
    counts = {x["category"]: x["count"] for x in found}
    assert all(counts[c] == 300 for c in ("身分證", "手機", "市話", "電子郵件", "公司", "統編"))
    assert counts["地址"] == 300 and counts["姓名"] >= 270
    assert made.exceptAll(people(spark, 300)).count() == 0


def test_streams(spark, tmp_path):
    source = tmp_path / "in"
    spark.createDataFrame(TEXTS, "doc_id int, text string").write.parquet(str(source))
    stream = spark.readStream.schema("doc_id int, text string").parquet(str(source))
    q = deidentify_stream(stream).select("doc_id", "redacted").writeStream.format("memory").queryName("out").option(
        "checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    batch = deidentify(spark.read.parquet(str(source)), style="label").select("doc_id", "redacted")
    assert sorted(map(tuple, spark.table("out").collect())) == sorted(map(tuple, batch.collect()))
    run = continuing_batches(str(tmp_path / "codes"), "s", rules=builtin_rules("email"))
    for n, text in enumerate(["a@x.tw b@x.tw", "b@x.tw c@x.tw", "a@x.tw c@x.tw"]):
        run(spark.createDataFrame([(n, text)], "doc_id int, text string"), n)
    run(spark.createDataFrame([(2, "a@x.tw c@x.tw")], "doc_id int, text string"), 2)
    table = spark.read.parquet(*[str(tmp_path / "codes" / "mapping" / f"batch={n}") for n in range(3)]).collect()
    assert sorted(x["original"] for x in table) == ["a@x.tw", "b@x.tw", "c@x.tw"]
    last = spark.read.parquet(str(tmp_path / "codes" / "documents" / "batch=2")).first()["redacted"]
    code = {x["original"]: x["code"] for x in table}
    assert last == f"[電子郵件:{code['a@x.tw']}] [電子郵件:{code['c@x.tw']}]"


def test_layout_edges(spark):
    from veilframe.operators import layout

    runs = spark.createDataFrame([
        (1, 1, 1, 0.0, 700.0, 10.0, 20.0, "", True), (1, 1, 2, 0.0, 700.0, 10.0, 20.0, "ab", False), (1, 1, 3, 25.0, 701.0, 10.0, 20.0, "cd", True),
        (1, 1, 4, 0.0, 690.0, 10.0, 20.0, "", True), (1, 1, 5, 0.0, 680.0, 10.0, 20.0, "ef", False), (1, 1, 6, 21.0, 680.0, 10.0, 5.0, "gh", False),
        (1, 2, 1, 0.0, 700.0, 10.0, 20.0, "p2", False), (1, 2, 2, 0.0, 600.0, 10.0, 20.0, "x", False),
    ], "doc_id int, page int, run_idx int, x double, y double, font_size double, width double, text string, eol boolean")
    pieces = layout.positioned_pieces(runs, "doc_id")
    text = layout.assemble(pieces, "doc_id", layout.POSITION_ORDER).first()["text"]
    assert text == "\nab cd\nefgh\n\np2\nx\n\n"
    for s in layout.segments(pieces, "doc_id", layout.POSITION_ORDER).collect():
        assert text[s["start"]:s["end"]] == s["text"]
    refs = spark.createDataFrame([("A1",), ("aa10",), ("ZZZ3",), ("1A",)], "r string").select(layout.cell_position(F.col("r")).alias("p")).collect()
    assert [(x["p"]["row"], x["p"]["col"]) for x in refs] == [(1, 1), (10, 27), (3, 18278), (0, 0)]


def test_tables(spark):
    from veilframe.operators.tables import cells_of, redact_table

    t = spark.createDataFrame([(1, "x a@x.tw", None, 5), (2, "plain", "0912345678", 6)], "id int, a string, b string, n int")
    assert [tuple(x) for x in redact_table(t, style="label").orderBy("id").collect()] == [(1, "x [電子郵件]", None, 5), (2, "plain", "[手機]", 6)]
    coded = redact_table(t, style="code", key="id", secret="s").orderBy("id").collect()
    assert coded[0]["a"].startswith("x [電子郵件:") and coded[1]["b"].startswith("[手機:")
    assert cells_of(t, "id").count() == 3
