"""Hit and miss samples for every built-in rule."""

import pytest

from veilframe.operators.detect import detect, find, has_markers, item_table
from veilframe.operators.rules import BUILTIN_RULES, builtin_rules, custom_rule
from pyspark.sql import functions as F

SAMPLES = {
    "zh-name": [
        ("陳志明先生", ["陳志明"]), ("司馬文德（", ["司馬文德"]), ("護理師林雅婷於", ["林雅婷"]), ("高雄市立圖書館", []),
        ("方法與方式", []), ("任何人", []), ("工程師程大偉表示", ["程大偉"]), ("甲方同意", []), ("王小明", ["王小明"]),
        ("簡訊通知", []), ("黃金與白色", []),
    ],
    "tw-id": [
        ("證號 A123456789。", ["A123456789"]), ("(B223456782)", ["B223456782"]), ("A123456788", []), ("XA123456789", []),
        ("A1234567890", []), ("A323456789", []),
    ],
    "us-ssn": [
        ("123-45-6789 and 219 09 9999", ["123-45-6789", "219 09 9999"]), ("SSN: 078051121", ["078051121"]),
        ("Social Security No. 078051121", ["078051121"]), ("078051121 alone", []), ("000-12-3456 666-12-3456 912-34-5678", []),
        ("123-00-4567 123-45-0000 123-45 6789", []), ("SSN　：　078051121", ["078051121"]),
    ],
    "tw-mobile": [
        ("0912345678", ["0912345678"]), ("0912-345-678", ["0912-345-678"]), ("+886-912-345-678", ["+886-912-345-678"]),
        ("1912345678", []), ("09123456789", []), ("091234567", []),
    ],
    "tw-landline": [
        ("(02)2712-3456", ["(02)2712-3456"]), ("02-27123456", ["02-27123456"]), ("037-123456", ["037-123456"]),
        ("0227123456", ["0227123456"]), ("+886-2-2712-3456", ["+886-2-2712-3456"]), ("0912345678", []), ("12345678", []),
    ],
    "tw-address": [
        ("地址：台北市信義區市府路45號8樓。", ["台北市信義區市府路45號8樓"]),
        ("新北市板橋區文化路一段188巷3號之2", ["新北市板橋區文化路一段188巷3號之2"]),
        ("臺中市西屯區台灣大道三段99號", ["臺中市西屯區台灣大道三段99號"]), ("高雄市政府", []), ("台北市", []), ("第3號", []),
    ],
    "tw-company": [
        ("甲方：築夢實業股份有限公司（", ["築夢實業股份有限公司"]), ("大安聯合診所", ["大安聯合診所"]),
        ("由嘉宏資訊股份有限公司提供", ["嘉宏資訊股份有限公司"]), ("本公司", []), ("有限公司", []),
    ],
    "tw-tax-id": [
        ("統編：04595257", ["04595257"]), ("12345678", []), ("104595257", []), ("02-27123456", []),
    ],
    "email": [
        ("a.b+c@example.com!", ["a.b+c@example.com"]), ("no mail", []), ("a@b", []),
        ("x@y.example.org,z@w.net", ["x@y.example.org", "z@w.net"]),
    ],
    "intl-phone": [
        ("Call +1 (415) 867-5309 now", ["+1 (415) 867-5309"]), ("(416) 967-1111", ["(416) 967-1111"]),
        ("+44 20 7946 0958 2026 report", ["+44 20 7946 0958"]), ("+81 3-1234-5678", ["+81 3-1234-5678"]),
        ("+33 1 42 68 53 00", ["+33 1 42 68 53 00"]), ("+61 2 9374 4000", ["+61 2 9374 4000"]), ("415-555-0123", ["415-555-0123"]),
        ("+234 803 123 4567", ["+234 803 123 4567"]), ("+98 912 345 6789.", ["+98 912 345 6789"]), ("+212 612-345678", ["+212 612-345678"]),
        ("+254 712 345678", ["+254 712 345678"]), ("+999 12345678", []), ("+1 555 555 0100", []), ("123-456-7890", []), ("+886 912 345 678", []), ("2026-10-16", []),
    ],
    "credit-card": [
        ("4242 4242 4242 4242.", ["4242 4242 4242 4242"]), ("5555-5555-5555-4444", ["5555-5555-5555-4444"]),
        ("3782 822463 10005", ["3782 822463 10005"]), ("6011111111111117", ["6011111111111117"]),
        ("4242 4242 4242 4241", []), ("1234 5678 9012 3452", []), ("42 4242 4242 424242", []), ("4242-4242 4242-4242", []),
        ("4242424242424242 4242424242424242", ["4242424242424242", "4242424242424242"]),
    ],
    "iban": [
        ("GB82 WEST 1234 5698 7654 32 SORT", ["GB82 WEST 1234 5698 7654 32"]), ("DE89370400440532013000", ["DE89370400440532013000"]),
        ("FR14 2004 1010 0505 0001 3M02 606.", ["FR14 2004 1010 0505 0001 3M02 606"]), ("GB83 WEST 1234 5698 7654 32", []),
    ],
    "ipv4": [
        ("from 192.168.1.10, 8.8.8.8.", ["192.168.1.10", "8.8.8.8"]), ("v999.1.1.1", []), ("1.2.3.4.5", []), ("2026.10.16", []),
    ],
    "ipv6": [
        ("2001:db8::1 and fe80::1ff:fe23:4567:890a.", ["2001:db8::1", "fe80::1ff:fe23:4567:890a"]),
        ("12:30:45", []), ("00:1A:2B:3C:4D:5E", []), ("1::2::3", []), ("1:2:3:4:5:6:7:8", ["1:2:3:4:5:6:7:8"]),
    ],
    "dob": [
        ("DOB: 1985-03-14", ["1985-03-14"]), ("D.O.B. 03/14/1985", ["03/14/1985"]), ("Date of Birth: March 14, 1985", ["March 14, 1985"]),
        ("Born on 14 March 1985", ["14 March 1985"]), ("出生日期：民國 80 年 5 月 1 日", ["民國 80 年 5 月 1 日"]),
        ("生日 1990/12/31", ["1990/12/31"]), ("出生日期                              1990-01-02", ["1990-01-02"]),
        ("出生日期\n1974-10-27", []), ("Invoice Date: 2026-10-16", []), ("DOB: 2026-13-40", []),
        ("Birthday: Sept. 3, 1990", ["Sept. 3, 1990"]),
    ],
}


def test_builtin_ids():
    assert [r.id for r in BUILTIN_RULES] == [
        "zh-name", "tw-id", "us-ssn", "tw-mobile", "tw-landline", "tw-address", "tw-company", "tw-tax-id", "email",
        "intl-phone", "credit-card", "iban", "ipv4", "ipv6", "dob"]
    assert set(SAMPLES) == {r.id for r in BUILTIN_RULES}


@pytest.mark.parametrize("rule_id", list(SAMPLES))
def test_rule_samples(spark, rule_id):
    samples = SAMPLES[rule_id]
    docs = spark.createDataFrame([(n, t) for n, (t, _) in enumerate(samples)], "doc_id int, text string")
    rows = detect(docs, builtin_rules(rule_id)).collect()
    got = {r["doc_id"]: [i["value"] for i in r["items"]] for r in rows}
    for r in rows:
        for i in r["items"]:
            assert r["text"][i["start"]:i["end"]] == i["value"]
    assert [(t, got[n]) for n, (t, _) in enumerate(samples)] == samples


LETTER = (
    "Dear team, born 😀 Date of Birth: March 14, 1985, SSN: 219-09-9999, mail emily@example.com, "
    "tel +1 (415) 867-5309 or +44 20 7946 0958, card 4242 4242 4242 4242 (not 4242 4242 4242 4241), "
    "IBAN DE89370400440532013000, host 192.168.1.10 / 2001:db8::1 at 09:15:22, MAC 00:1A:2B:3C:4D:5E, build 1.2.3.4.5, "
    "手機 0912-345-678，統一編號 04595257，電話 (02)2712-3456，聯絡人王小明先生。"
)


def test_all_rules_together(spark):
    docs = spark.createDataFrame([(1, LETTER)], "doc_id int, text string")
    found = [(i["category"], i["value"]) for i in detect(docs).first()["items"]]
    assert found == [
        ("生日", "March 14, 1985"), ("SSN", "219-09-9999"), ("電子郵件", "emily@example.com"),
        ("國際電話", "+1 (415) 867-5309"), ("國際電話", "+44 20 7946 0958"), ("信用卡", "4242 4242 4242 4242"),
        ("IBAN", "DE89370400440532013000"), ("IP", "192.168.1.10"), ("IP", "2001:db8::1"), ("手機", "0912-345-678"),
        ("統編", "04595257"), ("市話", "(02)2712-3456"), ("姓名", "王小明")]


def test_overlaps_longest_then_earliest_then_rule_order(spark):
    rules = [custom_rule("a", "", "公司", "ABC"), custom_rule("b", "", "識別碼", "ABCDEF"),
             custom_rule("c", "", "姓名", "VWXY"), custom_rule("d", "", "地址", "XYZW"), custom_rule("e", "", "IP", "VWXY")]
    docs = spark.createDataFrame([(1, "ABCDEF VWXYZW")], "doc_id int, text string")
    assert [(i["rule_id"], i["value"]) for i in detect(docs, rules).first()["items"]] == [("b", "ABCDEF"), ("c", "VWXY")]


def test_custom_rule_with_groups_and_empty_matches(spark):
    docs = spark.createDataFrame([(1, "aa bb cd"), (2, None)], "doc_id int, text string")
    twins = find(docs, custom_rule("t", "", "識別碼", r"(\w)\1"), "doc_id").collect()
    assert [(r["start"], r["value"]) for r in twins] == [(0, "aa"), (3, "bb")]
    assert find(docs, custom_rule("z", "", "識別碼", r"x*(?=b)"), "doc_id").count() == 0
    assert detect(docs, [custom_rule("off", "", "識別碼", "a", enabled=False)]).selectExpr("size(items) n").first()["n"] == 0


def test_fence_characters_in_the_text(spark):
    fence = "".join(chr(0xE000 + i) for i in range(3))
    docs = spark.createDataFrame([(1, f"{fence}a@b.co{fence} x@y.org")], "doc_id int, text string")
    assert [(i["start"], i["value"]) for i in detect(docs).first()["items"]] == [(3, "a@b.co"), (13, "x@y.org")]


def test_marker_check(spark):
    docs = spark.createDataFrame([("see [姓名:0a1b2c]",), ("[姓名:0A1B2C] [too long a name:0a1b2c]",)], "text string")
    assert [r[0] for r in docs.select(has_markers(F.col("text"))).collect()] == [True, False]


def test_item_table_is_one_row_per_item(spark):
    docs = spark.createDataFrame([(1, LETTER), (2, "nothing here")], "doc_id int, text string")
    assert item_table(detect(docs), "doc_id").count() == 13
