"""The review desk: hand-made histories, and the stream against the fold over stored inputs."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest

from lodestone.streaming import desk

START = datetime(2026, 1, 1)


def folded(steps, delay=5.0):
    """(change, accepted, candidate, undone) after steps (seconds, kind, argument, command_id)."""
    own = desk.Desk("p", delay, None, (), {}, {})
    rows = []
    for n, (at, kind, arg, *more) in enumerate(steps):
        rows.append((n, float(at), kind, arg if kind == "EDIT" else None, more[0] if more else None, arg if kind in ("ACCEPT", "REJECT", "HOLD") else None, arg if kind == "RESTORE" else None))
    return [r[2:] for r in own.fold(rows)]


@pytest.mark.parametrize(
    "steps,want",
    [
        # content that returns to the accepted one withdraws the item
        ([(0, "EDIT", "a"), (1, "ACCEPT", None), (2, "EDIT", "b"), (3, "EDIT", "a")], [("ADDED", None, "a", 0), ("INDEXED", "a", None, 0), ("MODIFIED", "a", "b", 0), ("WITHDRAWN", "a", None, 0)]),
        # an addition that is gone before anybody took it is no item
        ([(0, "EDIT", "a"), (1, "EDIT", None), (2, "ACCEPT", None)], [("ADDED", None, "a", 0), ("WITHDRAWN", None, None, 0), ("MISSING", None, None, 0)]),
        # the timer takes what nobody touches, but not what is held
        ([(0, "EDIT", "a"), (9, "EDIT", "b"), (10, "HOLD", None), (99, "EDIT", "c")], [("ADDED", None, "a", 0), ("ACCEPTED", "a", None, 0), ("MODIFIED", "a", "b", 0), ("HELD", "a", "b", 0), ("MODIFIED", "a", "c", 0)]),
        # removal, and rejecting a removal
        ([(0, "EDIT", "a"), (1, "ACCEPT", "a"), (2, "EDIT", None), (3, "REJECT", ""), (4, "EDIT", None), (5, "ACCEPT", "")], [("ADDED", None, "a", 0), ("INDEXED", "a", None, 0), ("DELETED", "a", None, 0), ("RESTORED", "a", None, 0), ("DELETED", "a", None, 0), ("REMOVED", None, None, 0)]),
        # an operator who saw another candidate changes nothing
        ([(0, "EDIT", "a"), (1, "EDIT", "b"), (2, "ACCEPT", "a"), (3, "ACCEPT", "b")], [("ADDED", None, "a", 0), ("ADDED", None, "b", 0), ("CONFLICT", None, "b", 0), ("INDEXED", "b", None, 0)]),
        # one id, one command
        ([(0, "EDIT", "a"), (1, "HOLD", None, "k"), (2, "HOLD", None, "k"), (3, "ACCEPT", None, "k"), (4, "ACCEPT", None, "m"), (5, "ACCEPT", None, "m")], [("ADDED", None, "a", 0), ("HELD", None, "a", 0), ("REPLAY", None, "a", 0), ("CONFLICT", None, "a", 0), ("INDEXED", "a", None, 0), ("REPLAY", "a", None, 0)]),
        # a log entry and all later ones are undone; what is undone waits for a person and is undone once
        (
            [(0, "EDIT", "a"), (1, "ACCEPT", None), (2, "EDIT", "b"), (3, "REJECT", None), (4, "EDIT", "c"), (5, "ACCEPT", None), (6, "RESTORE", 3), (99, "RESTORE", 5), (100, "RESTORE", 1), (101, "RESTORE", 77), (102, "ACCEPT", "a")],
            [("ADDED", None, "a", 0), ("INDEXED", "a", None, 0), ("MODIFIED", "a", "b", 0), ("RESTORED", "a", None, 0), ("MODIFIED", "a", "c", 0), ("INDEXED", "c", None, 0), ("UNDONE", "a", "b", 2), ("ALREADY", "a", "b", 0), ("UNDONE", None, "a", 1), ("MISSING", None, "a", 0), ("INDEXED", "a", None, 0)],
        ),
        # what the timer took is in the log too, by the number of its edit
        ([(0, "EDIT", "a"), (9, "EDIT", "b"), (10, "RESTORE", 0)], [("ADDED", None, "a", 0), ("ACCEPTED", "a", None, 0), ("MODIFIED", "a", "b", 0), ("UNDONE", None, "a", 1)]),
    ],
)
def test_histories(steps, want):
    assert folded(steps) == want


def inputs(rng, count, paths=6):
    rows, log = [], {}
    for n in range(count):
        path = f"docs/{rng.randrange(paths)}.md"
        kind = rng.choice(["EDIT"] * 4 + ["ACCEPT", "ACCEPT", "REJECT", "HOLD", "RESTORE"])
        entries = log.setdefault(path, [])
        content = rng.choice(["a", "b", "c", None]) if kind == "EDIT" else None
        target = rng.choice(entries[-3:]) if kind == "RESTORE" and entries else None
        entries.append(n)
        rows.append((path, n, START + timedelta(seconds=2 * n), kind, content, None if kind == "EDIT" else f"k{rng.randrange(2 * count)}", rng.choice([None, None, "a"]) if kind in ("ACCEPT", "REJECT") else None, target))
    return rows


BASE = [("docs/0.md", "a"), ("docs/1.md", "b"), ("docs/9.md", "z")]


def test_stream_equals_batch(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        rows = inputs(random.Random(9), 240)
        all_rows = spark.createDataFrame(rows, desk.INPUT)
        base = spark.createDataFrame(BASE, "path string, accepted string")
        want = {tuple(r) for r in desk.desk_batch(all_rows, base, 20.0).collect()}
        assert {r[2] for r in want} >= {"ADDED", "MODIFIED", "DELETED", "WITHDRAWN", "ACCEPTED", "INDEXED", "RESTORED", "HELD", "UNDONE", "MISSING", "CONFLICT"}
        for k in range(4):
            all_rows.where(f"sequence >= {60 * k} AND sequence < {60 * k + 60}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

        def run(name):
            stream = spark.readStream.schema(all_rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
            out = desk.desk_stream(stream, base, 20.0)
            query = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
            query.awaitTermination()
            return [tuple(r) for r in spark.read.schema(desk.OUTPUT).parquet(str(tmp_path / "out")).collect()]

        got = run("first")
        assert len(got) == len(set(got))
        # only what the last timers would take may be still to come, as far as the watermark has passed
        late = want - set(got)
        assert set(got) <= want and all(r[2] == "ACCEPTED" for r in late) and len(late) <= 6
        # a restart with further inputs goes on from the state
        more = [(f"docs/{n % 6}.md", n, START + timedelta(seconds=2 * n + 500), "EDIT", "q", None, None, None) for n in range(240, 252)]
        spark.createDataFrame(more, desk.INPUT).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        want = {tuple(r) for r in desk.desk_batch(spark.createDataFrame(rows + more, desk.INPUT), base, 20.0).collect()}
        got = run("second")
        assert len(got) == len(set(got)) and set(got) <= want and len(want - set(got)) <= 6
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_batch_over_small_frames_and_tables(spark):
    rows = inputs(random.Random(3), 300, paths=3)
    frame = spark.createDataFrame(rows, desk.INPUT)
    want = sorted(map(str, desk.desk_batch(frame, None, 7.0).collect()))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert sorted(map(str, desk.desk_batch(frame, None, 7.0).collect())) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert desk.desk_batch(frame.limit(0), None).count() == 0


def test_restoring_over_paths(spark):
    asked = spark.createDataFrame([("q", 5, START, "k")], "queue string, at long, ts timestamp, command_id string")
    log = spark.createDataFrame([("q", "a", 3), ("q", "a", 6), ("q", "a", 8), ("q", "b", 5), ("q", "c", 1), ("r", "a", 9)], "queue string, path string, at long")
    assert sorted((r.path, r.target) for r in desk.restores(asked, log).collect()) == [("a", 6), ("b", 5)]
