"""Rendering of pages, and the quality classifier."""

import re
import time
from html import unescape

import numpy as np
import pytest

from pyspark.sql import functions as F

from veilframe.llm import html_text, quality
from veilframe.llm.html_text import render
from veilframe.llm.queries_pages import op5_layout_text, op8_co_trained_quality

SF = "/root/testdata/sf0.01"

CASES = [
    (None, ""), ("", ""), ("plain  text", "plain text"), ("a < b & c &amp; d &copy;", "a < b & c & d ©"),
    ("<p>one<p>two", "one\n\ntwo"), ("<div>one</div><div>two</div>three", "one\ntwo\nthree"),
    ("<title>t</title><body>x<script>var a='</p>';</script>y<style>b{}</style>", "xy"),
    ("a<br>b<br/><br>c", "a\nb\n\nc"), ("<pre>\n a\n  b\n</pre>c", " a\n  b\n\nc"),
    ("x <b> y </b> z\n\n w", "x y z w"), ("<p>a <!-- no --> b<!--> c</p>", "a b c"),
    ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "- a\n- b\n  - c\n- d"),
    ("<ol start=3><li>a<li value=7>b<li>c</ol>", "3. a\n7. b\n8. c"), ("<ol type=a reversed><li>x<li>y</ol>", "b. x\na. y"),
    ("<ol type=I><li>x<li>y<li>z<li>w</ol>", "I. x\nII. y\nIII. z\nIV. w"),
    ("<p>a<div style='display: none'>no<p>no</div>b", "a\n\nb"), ("<p hidden>no</p>yes", "yes"),
    ("<div style='visibility:hidden'>no<span style='visibility:visible'>yes</span></div>", "yes"),
    ("<style>.x{display:none} #y, i { display : none }</style><p class='a x'>no<p id=y>no<i>no</i><p>yes", "yes"),
    ("<details><summary>s</summary>no</details><details open><summary>s</summary>yes</details>", "s\ns\nyes"),
    ("<dialog>no</dialog><dialog open>yes</dialog><template>no</template><noscript>no</noscript>", "yes"),
    ("<table><tr><th>name<th>n<tr><td>a<td>10<tr><td>longer<td>2</table>", "name    n\na       10\nlonger  2"),
    ("<table><caption>c</caption><tr><td colspan=2>wide cell here<td>z<tr><td>a<td>b<td>c</table>", "c\n\nwide cell here  z\na  b            c"),
    ("<table><tr><td rowspan=2>r<td>1<tr><td>2</table>after", "r  1\n   2\n\nafter"),
    ("<table><tr><td>中文<td>x<tr><td>a<td>y</table>", "中文  x\na     y"),
    ("<table><tr><td><table><tr><td>in<td>ner</table><td>out</table>", "in  ner  out"),
    ("<table><tr><td>a<br>b<td>c</table>", "a  c\nb"), ("<table>loose<tr><td>x</table>", "loose\n\nx"),
    ("<blockquote>q<p>r</blockquote>s", "  q\n\n  r\n\ns"), ("<dl><dt>t<dd>d<dt>u<dd>e</dl>", "t\n  d\nu\n  e"),
    ("<q>x</q> <textarea>\n a  b</textarea><select><option>1<option>2</select>", "\"x\"\n a  b\n1\n2"),
    ("<a title='>'>x</a><a title=\">\">y</a><a b='>z", "xyz"), ("<p>a</b>b</p></p></div>c", "ab\n\nc"), ("x<", "x<"), ("x<p", "x"), ("<b>one<p>two</b>three", "one\n\ntwothree"),
    ("<h1>a<h2>b</h3>c", "a\n\nb\n\nc"), ("<input type=submit value='Go'><input type=hidden value=no>", "Go"), ("&#x41;&lt;b&gt;&nbsp;c", "A<b> c"),
    ("<script>never closed <p>x", ""), ("<textarea>&lt;a&gt;<b></textarea>", "<a><b>"), ("<?php no ?>a<!DOCTYPE html>b</>c", "abc"),
]


@pytest.mark.parametrize("page,text", CASES)
def test_render(page, text):
    assert render(page) == text


def test_large_and_deep_pages():
    began = time.time()
    assert render("<div>" * 20_000 + "x" + "</div>" * 20_000 + "y") == "x\ny"
    assert render("<table><tr><td>" * 300 + "x").strip() == "x"
    assert isinstance(render("<a '" * 20_000 + ">x"), str)
    assert render("<ul><li>" * 500 + "x").strip("- ") == "x"
    assert len(render("<p>word " * 50_000).split()) == 50_000
    assert render("<" * 100_000) == "<" * 100_000
    assert time.time() - began < 20


def test_extract(spark):
    df = spark.createDataFrame([(i, p, "old", None) for i, (p, _) in enumerate(CASES)] + [(0, None, None, None)], "page_id int, html string, text string, x int")
    got = html_text.extract(df).collect()
    assert [(r.page_id, r.text) for r in got] == [(i, t) for i, (_, t) in enumerate(CASES)] + [(0, "")]
    assert html_text.extract(df.limit(0)).collect() == []


def test_layout_query(spark):
    """All words of the body in their order, list markers apart, against plain text substitution."""
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = op5_layout_text(spark, SF).collect()
    assert len(got) == len(pages)
    for r in got:
        page = re.sub(r"(?s)<head>.*?</head>|<!--.*?-->", "", pages[r.page_id])
        want = unescape(re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", page))).split()
        assert [w for w in r.text.split() if w != "-"] == [w for w in want if w != "-"]


def test_quality_query(spark):
    """Held-out accuracy: the labels of the larger table's documents that the model was not fitted on."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").where("quality is not null").dropDuplicates(["doc_id"])
    model = quality.fit(docs.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 0"))
    test = quality.score(docs.where("doc_id % 2 = 1"), model).join(labels, "doc_id").toPandas()
    good = test["quality"] == 1
    assert ((test["score"] >= 0.5)[good]).mean() > 0.99
    assert ((test["score"] < 0.5)[~good]).mean() > 0.97
    assert sum(map(sum, model.rounds)) > 0
    small = op8_co_trained_quality(spark, SF).collect()
    assert len(small) == docs.sparkSession.read.parquet(f"{SF}/documents.parquet").count()
    again = op8_co_trained_quality(spark, SF).collect()
    assert sorted((r.doc_id, r.score) for r in small) == sorted((r.doc_id, r.score) for r in again)


def test_whole_table_is_the_pool(spark):
    """The sums over a table are those over its rows at hand, however it is cut; the model is that of plain arrays."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").where("quality is not null").dropDuplicates(["doc_id"])
    found = quality.features(docs).join(labels, "doc_id", "left").orderBy("doc_id").toPandas()
    text = np.array([np.frombuffer(x) for x in found["text_view"]])
    page = np.array([np.frombuffer(x) for x in found["page_view"]])
    known = found["quality"].notna().to_numpy()
    model = quality.co_train(text[known], page[known], found["quality"].to_numpy(float)[known], text[~known], page[~known])
    for many in (1, 7):
        fitted = quality.fit(docs.repartition(many), labels)
        assert fitted.rounds == model.rounds and model.rounds[0][0] > 300
        for a, b in zip(fitted.score(text, page), model.score(text, page)):
            assert np.allclose(a, b, rtol=0, atol=1e-9)
    rows = [model.text.standard(text), model.page.standard(page)]
    views = [model.text, model.page]
    whole = quality.sums(views, views, rows)
    halves = [quality.sums(views, views, [x[s] for x in rows]) for s in (slice(None, 301), slice(301, None))]
    assert (whole == halves[0] + halves[1]).all() and whole.any()
    # The sums against plain loops.
    p = [1 / (1 + np.exp(-v.odds(x))) for v, x in zip(views, (text, page))]
    (_, (n, pull, full)), _ = quality.parts(whole, [len(v.weights) for v in views])
    sure = p[1] >= quality.SURE
    z = model.text.laid(text[sure]) / quality.UNIT
    own = 1 / (1 + np.exp(-z @ model.text.weights))
    assert n == sure.sum()
    assert np.allclose(pull, ((1 - own)[:, None] * z).sum(axis=0), atol=n * 6 / 1024)
    assert np.allclose(full, sum(w * np.outer(x, x) for w, x in zip(np.maximum(own * (1 - own), 1 / 1024), z)), atol=n * 36 / 1024)


def test_hot_ids_do_not_fill_the_sample(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    one = labels.where("quality = 1").orderBy("doc_id").first().doc_id
    hot = spark.range(20_000).select(F.lit(one).alias("doc_id"), F.concat(F.lit("again "), F.col("id") % 3).alias("text"), F.lit("en").alias("lang"),
                                     F.lit("s").alias("source"), F.lit(7).cast("long").alias("n_chars"))
    taken = []
    teach = quality.teach
    monkeypatch.setattr(quality, "teach", lambda text, page, label, n, others: taken.append((len(text), n.sum())) or teach(text, page, label, n, others))
    many = spark.range(20_000).select(F.lit(one).alias("doc_id"), F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    model = quality.fit(docs.unionByName(hot), labels.unionByName(many))
    (rows, weight), = taken
    assert rows == labels.where("quality is not null").select("doc_id").distinct().count() + 3 and weight > 20_000 * 20_000
    assert np.isfinite(model.combine).all()
    quality.fit(docs.unionByName(hot), labels, labelled=20)
    assert taken[1][0] <= 20


def test_views_teach_each_other():
    """With few labels, a view that is told by the other's sure rows gets better."""
    draw = np.random.default_rng(0)
    y = (draw.random(4000) < 0.5).astype(float)
    text = np.column_stack([y * 4 - 2 + draw.normal(size=4000), draw.normal(size=(4000, 3))])
    page = np.column_stack([y * 3 - 1.5 + draw.normal(size=4000), draw.normal(size=(4000, 20))])
    few = slice(0, 60)
    alone = quality.co_train(text[few], page[few], y[few], text[:0], page[:0])
    taught = quality.co_train(text[few], page[few], y[few], text[100:2000], page[100:2000])
    right = lambda m: ((m.score(text[2000:], page[2000:])[1] > 0.5) == y[2000:]).mean()
    assert right(taught) > right(alone) and taught.rounds[0][0] > 0


def test_driver_holds_the_labelled_rows_about_once():
    """A fit of the most rows there can be takes the laid out features and one product of them, and rows are read where Arrow has them."""
    import tracemalloc

    import pyarrow as pa

    x = np.random.default_rng(1).random((quality.LABELLED, quality.TEXT_FEATURES))
    view, label = quality.View(quality.SHARES), (x[:, 0] > 0.5).astype(float)
    tracemalloc.start()
    view.fit(x, label, np.ones(len(x)), steps=2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2.7 * x.nbytes
    rows = pa.chunked_array([pa.array([r.tobytes() for r in x[:5]], pa.binary())])
    assert (quality.unpacked(rows, x.shape[1]) == x[:5]).all()
    assert quality.unpacked(rows, x.shape[1]).ctypes.data == rows.chunk(0).buffers()[2].address
    assert (quality.unpacked(rows.slice(2), x.shape[1]) == x[2:5]).all()
    assert quality.unpacked(rows.slice(5), x.shape[1]).shape == (0, x.shape[1])


def test_quality_hard_rows(spark):
    texts = ["", None, " ", "a", "x " * 50_000, "| | |", "Ü" * 9]
    rows = [(None if i == 2 else i, t, None if i == 1 else "en", None if i == 3 else "s", None if i == 4 else len(t or ""), 2.0) for i, t in enumerate(texts)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double")
    labels = lambda rows: spark.createDataFrame(rows, "doc_id long, quality int, score int")
    for known, want in (([], 0.5), ([(0, 1, 3), (None, 1, 3), (1, None, 3), (3, 7, 3)], None), ([(i, i % 2, 1) for i in range(7)] * 6, None)):
        got = quality.score(df, quality.fit(df, labels(known))).collect()
        assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
        assert want is None or all(r.score == want for r in got)
    assert quality.score(df.limit(0), quality.fit(df.limit(0), labels([]))).collect() == []


def test_nothing_hidden_shows_below_deep_nesting():
    inner = "<script>no()</script><style>.no{}</style><div hidden>no<p>no</div><dialog>no</dialog><p>one<p>two<ul><li>a<li>b</ul><pre>x\n y</pre>"
    for opening in ("<div>", "<b>", "<div><span>"):
        for levels in (1, 119, 500, 5000):
            assert render(opening * levels + inner) == "one\n\ntwo\n\n- a\n- b\n\nx\n y"
    deep = render("<blockquote>" * 500 + "<ul><li>a<script>no()</script><li>b</ul>end")
    assert [x.strip() for x in deep.split("\n") if x] == ["- a", "- b", "end"]
    began = time.time()
    assert render("<blockquote>x" * 20_000).count("x") == 20_000
    assert render("<div>" + "<b>" * 100_000 + "x" + "</i>" * 100_000 + "</b>" * 100_000 + "y") == "xy"
    assert time.time() - began < 20
