"""Commits, event lines, locations, envelopes and the report on hand-made cases."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from lodestone.operators import records


def test_commits(spark):
    lines = ["a\x1fone\x1f2026", "\x1fno name\x1f2026", "b\x1fno time", "c\x1f\x1f", "d\x1fx\x1fy\x1fz", ""]
    rows = spark.createDataFrame([(i, line) for i, line in enumerate(lines)], "i int, line string")
    got = sorted(tuple(r) for r in records.commits(rows, "line").collect())
    assert got == [(0, "a", "one", "2026"), (3, "c", "", ""), (4, "d", "x", "y\x1fz")]


def test_event_lines_over_a_stream(spark, tmp_path):
    events = spark.createDataFrame([("p", "CREATED", None), ("é\n", "DELETED", "x")], "path string, event string, sha256 string")
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    records.event_lines(stream).writeStream.format("text").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "offsets")).trigger(availableNow=True).start().awaitTermination()
    lines = [r.value for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert sorted(map(json.loads, lines), key=str) == sorted(({"event": e, "path": p, "sha256": s} for p, e, s in (r for r in events.collect())), key=str)


def test_merged_locations(spark):
    rows = spark.createDataFrame([(1, {"page": "1", "line": "2"}, {"page": "9", "unit": None}), (2, None, None), (3, {}, {"a": None}), (4, None, {"a": "b"}), (5, {"k": None}, None)], "i int, own map<string,string>, extra map<string,string>")
    got = {r.i: r.m for r in rows.select("i", records.merged_location(F.col("own"), F.col("extra")).alias("m")).collect()}
    assert got == {1: {"line": "2", "page": "9"}, 2: None, 3: None, 4: {"a": "b"}, 5: {"k": None}}


def test_envelopes_never_open(spark):
    rows = spark.createDataFrame([(1, "INDEX_DENIED", "m", None), (2, "KeyError", "secret detail", False), (3, None, None, None), (4, "RISK_SERVICE_ERROR", "m", True)], "i int, code string, message string, retryable boolean")
    got = {r.i: (r.code, r.message, r.retryable, r.status) for r in records.envelope(rows).where("decision = 'BLOCK' AND index_action = 'QUARANTINE' AND risk_score IS NULL AND analysis_status = 'FAILED'").collect()}
    internal = (records.INTERNAL, records.INTERNAL_MESSAGE, True, 500)
    assert got == {1: ("INDEX_DENIED", "m", False, 409), 2: internal, 3: internal, 4: ("RISK_SERVICE_ERROR", "m", True, 502)}


def test_report(spark):
    rows = spark.createDataFrame([("attack", "BLOCK", "BLOCK", 1.0), ("attack", "BLOCK", "REVIEW", 2.0), ("review", "REVIEW", "REVIEW", 4.0)], "category string, expected string, actual string, elapsed_ms double")
    row = records.report(rows).first()
    assert (row.total, row.passed, row.attack_detection_rate, row.normal_allow_rate, row.average_analysis_ms) == (3, 2, 0.5, None, 2.333)
    assert json.loads(row.report) == {"total": 3, "passed": 2, "attack_detection_rate": 0.5, "normal_allow_rate": None, "average_analysis_ms": 2.333}
    assert records.report(rows.limit(0)).first().average_analysis_ms == 0.0
