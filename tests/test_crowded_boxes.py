"""Boxes on crowded pages: matches without listing all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from veilframe.operators import evaluate

SCHEMA = "page long, box_id long, x double, y double, width double, height double, red long, green long, blue long"


def made(seed, n):
    draw = random.Random(seed)
    return [(draw.randint(1, 2), i, draw.choice([0.0, 120.5, 300.0]) + draw.randint(0, 9), 1.0 * draw.randint(0, 300), draw.choice([0.0, 12.0, 60.0, 400.0]), 30.0 + draw.randint(0, 9),
             draw.randint(0, 255), 10, 20) for i in range(n)]


@pytest.mark.parametrize("colour", [None, 40])
def test_matches_as_all_pairs_say(spark, colour):
    truth, found = made(1, 150) + [(3, 900, 1.0, 1.0, 5.0, 5.0, 0, 0, 0), (3, 901, None, 1.0, 5.0, 5.0, 0, 0, 0)], made(2, 150)
    t, f = (spark.createDataFrame(x, SCHEMA) for x in (truth, found))
    pairs = evaluate.box_pairs(t, f, "page", ("red", "green", "blue")).where("iou >= 0.5")
    if colour:
        pairs = pairs.where(F.abs(F.col("t_red") - F.col("f_red")) <= colour)
    hit = {(r.page, r.t_box_id) for r in pairs.collect()}
    want = {p: (sum(x[0] == p for x in truth), sum(h[0] == p for h in hit)) for p in {x[0] for x in truth}}
    assert {r.page: (r.boxes, r.matched) for r in evaluate.box_matches(t, f, "page", colour_distance=colour).collect()} == want
    assert hit


def test_equal_boxes_make_no_pairs(spark):
    """20,000 equal boxes found 20,000 times were 400 million pairs."""
    import time

    box = spark.range(20_000).select(F.lit(1).alias("page"), F.col("id").alias("box_id"), *(F.lit(v).alias(c) for c, v in (("x", 5.0), ("y", 5.0), ("width", 40.0), ("height", 20.0))))
    started = time.time()
    assert [tuple(r) for r in evaluate.box_matches(box, box, "page").collect()] == [(1, 20_000, 20_000)]
    assert time.time() - started < 20
