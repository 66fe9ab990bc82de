"""Chains by pointer doubling, re-analyses, and results that come late."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

from lodestone.operators import lineage
from lodestone.streaming import late

STYLE = "package int, style long, based_on long, hidden boolean, color string"


def walked(rows):
    own = {(p, s): (b, h, c) for p, s, b, h, c in rows}
    out = []
    for p, s, *_ in rows:
        path, at, hidden, color = [], s, None, None
        while (p, at) in own and at not in path:
            path.append(at)
            based, h, c = own[p, at]
            hidden, color = h if hidden is None else hidden, c if color is None else color
            last, at = at, based
        circle = (p, at) in own
        out.append((p, s, *((None, None, True, None, None) if circle else (last, len(path) - 1, False, hidden, color))))
    return sorted(out, key=lambda r: r[:2])


def test_chains_of_any_depth(spark):
    rng = random.Random(2)
    rows = [(1, i, i - 1 if i else None, True if i == 3 else None, "red" if i in (0, 500) else None) for i in range(700)]
    rows += [(2, i, 0 if i else None, rng.choice((True, False, None)), None) for i in range(300)]  # one parent of all
    rows += [(3, i, (i + 1) % 7, True, "c") for i in range(7)] + [(3, 10 + i, 9 + i if i else 3, None, None) for i in range(5)]  # a circle, and what runs into it
    rows += [(4, 1, 99, None, "x"), (4, 2, 1, False, None), (4, 3, 3, True, None)]  # no such parent; itself
    rows += [(5, i, rng.randrange(60), rng.choice((True, None)), rng.choice(("a", None))) for i in range(60)]
    got = sorted((tuple(r) for r in lineage.chains(spark.createDataFrame(rows, STYLE), ["package"], "style", "based_on", "hidden", "color").collect()), key=lambda r: r[:2])
    assert got == walked(rows)
    assert lineage.chains(spark.createDataFrame([], STYLE), ["package"], "style", "based_on").count() == 0


def test_attempts(spark):
    rows = [("a", None, "HOLD"), ("b", "a", "ANALYSIS_FAILED"), ("c", "b", "INDEXED"), ("d", None, "HOLD"), ("x", "y", "HOLD"), ("y", "x", "HOLD"), ("e", "lost", "INDEXED")]
    got = {tuple(r) for r in lineage.attempts(spark.createDataFrame(rows, "analysis_id string, supersedes string, state string")).collect()}
    assert got == {("a", 3, "c", "INDEXED", 2), ("d", 1, "d", "HOLD", 0), ("e", 1, "e", "INDEXED", 0)}


START = datetime(2026, 1, 1)
at = lambda s: START + timedelta(seconds=s)
REQUESTS = [("p", "a", at(0)), ("p", "b", at(10)), ("q", "a", at(5)), ("r", "a", at(6)), ("s", "a", at(7)), ("z", "-", at(400))]
RESULTS = [
    ("p", "a", at(2), True),  # in time
    ("p", "a", at(12), True),  # of content that was edited since: of its own request only
    ("q", "a", at(6), False), ("q", "a", at(8), True),  # a second try
    ("r", "a", at(7), False), ("r", "a", at(15), True),  # too late for a second try
    ("s", "a", at(90), True),  # too late at all
    ("t", "a", at(1), True),  # nobody asked
    ("z", "-", at(401), True),
]


def test_late_results(spark, tmp_path):
    requests, results = spark.createDataFrame(REQUESTS, "id string, digest string, asked_at timestamp"), spark.createDataFrame(RESULTS, "id string, digest string, answered_at timestamp, ok boolean")
    told = late.answered(requests, results)
    got = {(r.id, r.digest): (r.outcome, r.answered_at) for r in late.settled(told).collect()}
    assert got == {("p", "a"): ("READY", at(2)), ("p", "b"): ("UNAVAILABLE", None), ("q", "a"): ("READY", at(8)), ("r", "a"): ("FAILED", at(7)), ("s", "a"): ("UNAVAILABLE", None), ("z", "-"): ("READY", at(401))}
    for name, rows, moment in (("q", requests, "asked_at"), ("r", results, "answered_at")):
        for a, b in ((0, 8), (8, 95), (95, 500)):
            rows.where(f"{moment} >= timestamp'{at(a)}' AND {moment} < timestamp'{at(b)}'").coalesce(1).write.mode("append").parquet(str(tmp_path / name))
    read = lambda name, rows: spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name))
    for _ in range(2):
        query = late.answered(read("q", requests), read("r", results)).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "offsets")).trigger(availableNow=True).start()
        query.awaitTermination()
    streamed = spark.read.parquet(str(tmp_path / "out"))
    # the watermark has passed all requests but the last, which is matched anyway
    assert sorted(map(str, streamed.collect())) == sorted(map(str, told.collect()))
    assert sorted(map(str, late.settled(streamed).collect())) == sorted(map(str, late.settled(told).collect()))
