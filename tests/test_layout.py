"""Joins of boxes against all pairs, and a page of very many boxes."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from lodestone.operators import layout

BOX = "x0 double, y0 double, x1 double, y1 double"


def boxes(rng, count, most=400.0):
    out = []
    for _ in range(count):
        x, y, w, h = rng.uniform(-50, most), rng.uniform(-50, most), rng.choice((0.0, 0.5, 3, 20, 900)) * rng.random(), rng.choice((-1, 0.5, 3, 20, 900)) * rng.random()
        out.append(tuple(float(round(v * 2) / 2) for v in (x, y, x + w, y + h)))
    return out


def meets(a, b):
    return a[0] < a[2] and a[1] < a[3] and b[0] < b[2] and b[1] < b[3] and a[0] < b[2] and b[0] < a[2] and a[1] < b[3] and b[1] < a[3]


def share(a, b):
    return max(0, min(a[2], b[2]) - max(a[0], b[0])) * max(0, min(a[3], b[3]) - max(a[1], b[1])) / ((a[2] - a[0]) * (a[3] - a[1])) if a[0] < a[2] and a[1] < a[3] else 0


def test_boxes_meet_once(spark):
    rng = random.Random(4)
    left, right = ([(rng.randrange(3), i, *b) for i, b in enumerate(boxes(rng, 200))] for _ in range(2))
    left[0], right[0] = (0, 0, None, 0.0, 1.0, 1.0), (0, 0, 0.0, 0.0, None, 1.0)
    frames = [spark.createDataFrame(rows, f"page int, i int, {BOX}") for rows in (left, right)]
    got = sorted((r.t.i, r.s.i) for r in layout.meeting(*frames, ["page"]).collect())
    assert got == sorted((i, j) for p, i, *a in left[1:] for q, j, *b in right[1:] if p == q and meets(a, b)) and len(got) > 100


def test_occlusion_and_traces(spark):
    rng = random.Random(6)
    texts = [(rng.randrange(2), n, *b) for n, b in enumerate(boxes(rng, 150, 60.0))]
    texts += texts[:5]
    covers = [(rng.randrange(2), rng.randrange(150), *b, rng.choice((1.0, 0.5, 0.96))) for b in boxes(rng, 120, 60.0)]
    covers += [(page, 140, -50.0, -50.0, 40.0 + page, 45.0, 1.0) for page in (0, 1)]
    got = sorted(tuple(r) for r in layout.occluded(spark.createDataFrame(texts, f"page int, seq int, {BOX}"), spark.createDataFrame(covers, f"page int, seq int, {BOX}, opacity double")).collect())
    want = sorted(t for t in texts if any(c[0] == t[0] and c[1] > t[1] and c[6] >= 0.95 and meets(t[2:], c[2:6]) and share(t[2:], c[2:6]) >= 0.8 for c in covers))
    assert got == want and len(want) > 10
    traces = [(0, n, rng.choice("abxy"), *b) for n, b in enumerate(boxes(rng, 60, 60.0))]
    spans = [(0, n, rng.choice("abc"), *b) for n, b in enumerate(boxes(rng, 60, 60.0))]
    got = sorted(tuple(r) for r in layout.traced(spark.createDataFrame(traces, f"page int, trace int, key string, {BOX}"), spark.createDataFrame(spans, f"page int, span int, key string, {BOX}")).collect())
    keys = {s[2] for s in spans}
    want = sorted((0, t[1], s[1]) for t in traces for s in spans if meets(t[3:], s[3:]) and (t[2] == s[2] or t[2] not in keys and max(share(t[3:], s[3:]), share(s[3:], t[3:])) >= 0.5))
    assert got == want and len(want) > 10


def test_a_page_of_many_boxes(spark):
    n = 100_000
    place = [(F.col("id") % 400 * 10).cast("double").alias("x0"), (F.floor(F.col("id") / 400) * 10).cast("double").alias("y0")]
    rows = spark.range(n).select(F.lit(1).alias("page"), F.col("id").alias("seq"), *place).withColumn("x1", F.col("x0") + 8).withColumn("y1", F.col("y0") + 8)
    covers = rows.where("seq % 7 = 3").withColumn("seq", F.col("seq") + 1).withColumn("opacity", F.lit(1.0))
    sheet = spark.createDataFrame([(1, 50, -5.0, -5.0, 5000.0, 5000.0, 1.0)], covers.schema)
    found = layout.occluded(rows, covers.union(sheet))
    assert found.count() == n // 7 + sum(i % 7 != 3 for i in range(50)) + (n % 7 > 3)
