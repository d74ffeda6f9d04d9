"""Partial retention, rendering and masks."""

from pyspark.sql import functions as F

from veilframe.functions.masks import mask_display
from veilframe.functions.retention import (
    NONE, RETENTION, STANDARD, Retention, blank_out, describe, lint, modes_for, rendered, sane, split_for,
)


def splits(spark, rows):
    """[(value, category, retention)] -> [(head, tail)]"""
    data = [(n, v, c, tuple(vars(r).values())) for n, (v, c, r) in enumerate(rows)]
    df = spark.createDataFrame(data, f"n int, v string, c string, r {RETENTION}")
    out = df.withColumn("s", split_for(F.col("v"), F.col("r"), F.col("c"))).orderBy("n").collect()
    return [(r["s"]["head"], r["s"]["tail"]) for r in out]


def test_standard_split(spark):
    cases = {
        ("姓名", "王小明"): (1, 0), ("姓名", "歐陽志遠"): (2, 0), ("身分證", "A123456789"): (2, 0),
        ("手機", "0912-345-678"): (5, 0), ("手機", "+886-955-123-456"): (6, 0), ("市話", "(02)2712-3456"): (4, 0),
        ("市話", "02-27123456"): (3, 0), ("市話", "0227123456"): (2, 0), ("地址", "台北市信義區市府路45號"): (6, 0),
        ("地址", "信義區市府路45號"): (0, 0), ("電子郵件", "abc@gmail.com"): (0, 10), ("公司", "築夢實業股份有限公司"): (0, 6),
        ("統編", "04595257"): (0, 0), ("SSN", "123-45-6789"): (0, 0), ("國際電話", "+44 20 7946 0958"): (4, 0),
        ("國際電話", "(415) 867-5309"): (6, 0), ("信用卡", "4242 4242 4242 4242"): (0, 4), ("IBAN", "GB82 WEST 1234 5698 7654 32"): (2, 0),
        ("IP", "192.168.1.10"): (8, 0), ("IP", "2001:db8::1"): (9, 0), ("生日", "1985-03-14"): (5, 0), ("生日", "14 March 1985"): (0, 5),
        ("生日", "民國 80 年 5 月 1 日"): (8, 0), ("識別碼", "EMP-1"): (1, 0), ("姓名", "王"): (0, 0),
    }
    assert splits(spark, [(v, c, STANDARD) for c, v in cases]) == list(cases.values())


def test_other_modes_and_clamp(spark):
    after, before = (Retention("delim", delimiter="--", side=s) for s in ("after", "before"))
    rows = [
        ("abcdef", "識別碼", Retention("ends", head=2, tail=3)), ("abcde", "識別碼", Retention("ends", head=2, tail=3)),
        ("abcde", "識別碼", Retention("ends", head=-1, tail=3)), ("a--b--c", "識別碼", after), ("a--b--c", "識別碼", before),
        ("abc", "識別碼", after), ("--abc", "識別碼", after), ("abc", "識別碼", Retention("delim", delimiter="", side="after")),
        ("司徒大明", "姓名", Retention("surname")), ("台北市信義區松路1號", "地址", Retention("city")),
        ("台北市信義區松路1號", "地址", Retention("district")), ("abc", "識別碼", NONE),
    ]
    assert splits(spark, rows) == [(2, 3), (0, 0), (0, 0), (0, 6), (6, 0), (0, 0), (0, 0), (0, 0), (2, 0), (3, 0), (6, 0), (0, 0)]


def test_styles(spark):
    row = spark.createDataFrame([("手機", "0912-345-678", 5, 0, "0a1b2c"), ("電子郵件", "ab１@x.tw", 0, 5, "ffffff")],
                                "c string, v string, h int, t int, k string")
    cols = [rendered(s, F.col("c"), F.col("v"), F.col("h"), F.col("t"), F.col("k")).alias(s) for s in ("code", "label", "blank")]
    assert [tuple(r) for r in row.select(*cols).collect()] == [
        ("0912-[手機:0a1b2c]", "0912-[手機]", "0912-○○○-○○○"), ("[電子郵件:ffffff]@x.tw", "[電子郵件]@x.tw", "○○○@x.tw")]
    assert row.select(blank_out(F.lit("王A1-é_"))).first()[0] == "○○○-○_"


def test_masks(spark):
    cases = {
        ("姓名", "王小明"): "王OO", ("姓名", "歐陽志遠"): "歐陽OO", ("姓名", "王"): "OO", ("身分證", "A123456789"): "A12******9",
        ("手機", "0912345678"): "0912-***-678", ("手機", "+886-912-345-678"): "0912-***-678", ("手機", "12345678"): "1234**78",
        ("市話", "(02)2712-3456"): "02-****-56", ("地址", "台北市信義區市府路45號"): "台北市信義區***", ("地址", "abcdef"): "abc***",
        ("電子郵件", "abc@x.tw"): "ab***@x.tw", ("電子郵件", "a@x.tw"): "a***@x.tw", ("公司", "築夢實業有限公司"): "築夢**有限公司",
        ("公司", "築夢有限公司"): "築*有限公司", ("統編", "04595257"): "04*****7", ("識別碼", "EMP-00"): "EMP***", ("識別碼", "ab"): "**",
    }
    df = spark.createDataFrame([(n, c, v) for n, (c, v) in enumerate(cases)], "n int, c string, v string").orderBy("n")
    assert [r[0] for r in df.select(mask_display(F.col("c"), F.col("v"))).collect()] == list(cases.values())


def test_lint_describe_and_shape(spark):
    rows = [
        ("王小明、歐陽", Retention("ends", head=3, tail=0), "nothing_hidden", []), ("abcd", Retention("ends", head=2, tail=1), None, ["both_ends", "under_half_hidden"]),
        ("abcd", Retention("ends", head=-1, tail=0), "bad_length", []), ("abcd", Retention("delim", delimiter="", side="after"), "no_delimiter", []),
        ("abcd", Retention("delim", delimiter="@", side="after"), None, ["delimiter_absent"]), ("a@bcd", Retention("delim", delimiter="@", side="after"), None, ["under_half_hidden"]),
        ("abc", STANDARD, None, ["partial_exposes"]), ("abc", NONE, None, []),
    ]
    df = spark.createDataFrame([(n, e, tuple(vars(r).values())) for n, (e, r, _, _) in enumerate(rows)], f"n int, e string, r {RETENTION}").orderBy("n")
    got = df.select(lint(F.col("e"), F.col("r"), F.lit("識別碼")).alias("l"), describe(F.col("r")).alias("d"), sane(F.col("r")).alias("s")).collect()
    assert [(g["l"]["error"], list(g["l"]["warnings"])) for g in got] == [(e, w) for _, _, e, w in rows]
    assert [g["d"] for g in got][:2] == ["保留前 3 碼", "保留前 2 碼＋後 1 碼"] and got[4]["d"] == "保留「@」之後"
    assert [g["s"] for g in got] == [True, True, False, False, True, True, True, True]
    modes = spark.range(1).select(modes_for(F.lit("姓名")), modes_for(F.lit("地址"))).first()
    assert modes[0] == ["none", "ends", "delim", "surname", "preview"] and modes[1][3:5] == ["city", "district"]
