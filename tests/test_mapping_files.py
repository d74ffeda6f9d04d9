"""Large mapping files: records found by many tasks."""

import random

import pytest

from veilframe.operators.lookup import lookup
from veilframe.sources import mapping as m


@pytest.fixture
def small_splits(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    yield lambda n: spark.conf.set("spark.sql.files.maxPartitionBytes", str(n))
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def plain_records(text):
    """(line on which it begins, fields) of every record that isn't blank, one character after the other."""
    found, fields, field, line, begun, inside, n = [], [], "", 1, 1, False, 0
    while n < len(text):
        c = text[n]
        if c == '"':
            if inside and text[n + 1:n + 2] == '"':
                field, n = field + '"', n + 1
            else:
                inside = not inside
        elif c == "," and not inside:
            fields, field = [*fields, field], ""
        elif c in "\r\n":
            end = "\r\n" if text[n:n + 2] == "\r\n" else c
            n += len(end) - 1
            line += 1
            if inside:
                field += end
            else:
                found.append((begun, [*fields, field]))
                fields, field, begun = [], "", line
        else:
            field += c
        n += 1
    if fields or field:
        found.append((begun, [*fields, field]))
    return [(at, x) for at, x in found if x != [""]]


def plain_mapping(text):
    (_, head), *rows = plain_records(text)
    place = {c: head.index(c) if c in head else 99 for c in m.MAPPING_HEADERS + m.KEPT_HEADERS}
    return sorted((at, *(x[n] if n < len(x) else "" for n in place.values())) for at, x in rows)


def read(spark, path):
    return sorted((r["line_no"], r["code"], r["category"], r["original"], r["kept_prefix"], r["kept_suffix"]) for r in m.read_mapping(spark, str(path)).collect())


@pytest.mark.parametrize("seed", range(2))
@pytest.mark.parametrize("end", ["\n", "\r\n", "\r"])
def test_records_over_splits(spark, tmp_path, small_splits, seed, end):
    pick = random.Random(seed)
    parts = ["", "a", "名", " ", '""', ",", "\n", "\r\n", "\r", "x" * 40]
    value = lambda: '"' + "".join(pick.choice(parts) for _ in range(pick.randrange(6))) + '"'
    loose = lambda: pick.choice(["", "b", 'c"d"', '"e"f', 'g""h', value()])
    rows = [",".join(loose() for _ in range(pick.randrange(1, 6))) for _ in range(300)]
    text = end.join(["category,note,code,original", *rows]) + pick.choice(["", end])
    (tmp_path / "m.csv").write_bytes(text.encode())
    small_splits(pick.choice([700, 2000]))
    assert read(spark, tmp_path / "m.csv") == plain_mapping(text)


def test_field_longer_than_splits(spark, tmp_path, small_splits):
    long = "\n".join(["line, of"] * 2000)
    text = f'﻿code,category,original\r\n\r\na,X,"{long}"\r\nb,Y,"{long}""\r\n"\r\nc,Z,z\r\n'
    (tmp_path / "m.csv").write_bytes(text.encode())
    small_splits(4000)
    assert [x[:2] for x in read(spark, tmp_path / "m.csv")] == [(3, "a"), (2003, "b"), (4004, "c")]
    assert read(spark, tmp_path / "m.csv") == plain_mapping(text[1:])


def test_open_quotes_and_empty_files(spark, tmp_path, monkeypatch):
    (tmp_path / "open.csv").write_text('code,category,original\na,X,"one\nb,Y,two\n')
    assert read(spark, tmp_path / "open.csv") == [(2, "a", "X", "one\nb,Y,two", "", "")]
    monkeypatch.setattr(m, "MAX_FILE_BYTES", 10)
    with pytest.raises(ValueError, match="line 2 has"):
        m.read_mapping(spark, str(tmp_path / "open.csv"))
    for name, content in [("none", b""), ("blank", b'\r\n\n""\n')]:
        (tmp_path / f"{name}.csv").write_bytes(content)
        with pytest.raises(ValueError, match="code, category, original"):
            m.read_mapping(spark, str(tmp_path / f"{name}.csv"))
    (tmp_path / "bytes.csv").write_bytes(b"code,category,original\na,X,\xff\n")
    assert read(spark, tmp_path / "bytes.csv") == [(2, "a", "X", "�", "", "")]


def test_a_million_rows_in_one_file(spark, tmp_path, small_splits):
    with open(tmp_path / "m.csv", "w", newline="") as f:
        f.write("code,category,original\r\n")
        for n in range(1_000_000):
            f.write(f'{n},X,"v\r\n{n}"\r\n' if n % 3 == 0 else f"{n},X,v\r\n")
    small_splits(1 << 20)
    assert m._scanned(spark, str(tmp_path / "m.csv")).rdd.getNumPartitions() > 10
    rows = m.read_mapping(spark, str(tmp_path / "m.csv"))
    # In front of row n are the header, n rows and a further line for every third of them.
    right = rows.where("line_no = 2 + try_cast(code as long) + ceil(try_cast(code as long) / 3) and category = 'X'"
                       " and original = if(try_cast(code as long) % 3 = 0, concat('v\r\n', code), 'v')")
    assert right.count() == rows.count() == 1_000_000
    good, errors = m.checked_mapping(rows.withColumnRenamed("file", "scope"))
    assert errors.isEmpty()


def test_only_repeated_codes_are_looked_up(spark, monkeypatch):
    sides = []
    monkeypatch.setattr(m, "lookup", lambda left, right, keys: sides.append(right.count()) or lookup(left, right, keys))
    rows = spark.createDataFrame([(1, n, c) for n, c in enumerate([*map(str, range(50)), "7", " 8 ", "", None, "7"])] + [(2, 0, "7"), (None, 1, "x"), (None, 2, "x")],
                                 "scope int, line_no int, code string")
    good, errors = m.checked_mapping(rows)
    assert sorted(tuple(r) for r in errors.collect()) == [
        (1, 50, "7", "duplicate_code"), (1, 51, "8", "duplicate_code"), (1, 52, "", "empty_code"), (1, 53, "", "empty_code"), (1, 54, "7", "duplicate_code")]
    assert good.count() == 53
    assert all(n <= 3 for n in sides)
