"""The watched folder as a batch and a stream."""

from __future__ import annotations

import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from lodestone.operators import changes
from lodestone.sources import folder, packages


@pytest.fixture
def place(tmp_path):
    root = tmp_path / "watched"
    (root / "sub" / "deep").mkdir(parents=True)
    for name, text in {"a.md": "A", "b.MD": "B", "c.txt": "no", "sub/d.markdown": "D" * 5000, "sub/deep/e.docx": "E"}.items():
        (root / name).write_text(text)
    os.symlink(root / "a.md", root / "link.md")
    os.symlink(root / "sub", root / "linked")
    return root


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_a_folder_is_a_table(spark, place):
    spark.dataSource.register(folder.WatchedFolder)
    read = lambda **options: spark.read.format("watched_folder").options(path=str(place), **options).load()
    rows = {r.path: r for r in read(partition_bytes=100).collect()}
    assert {p: (r.format, r.size, r.sha256, r.content) for p, r in rows.items()} == {
        "a.md": ("MD", 1, sha("A"), None), "b.MD": ("MD", 1, sha("B"), None), "sub/d.markdown": ("MARKDOWN", 5000, sha("D" * 5000), None), "sub/deep/e.docx": ("DOCX", 1, sha("E"), None),
    }
    assert {r.path for r in read(recursive="false").collect()} == {"a.md", "b.MD"}
    assert read(partition_bytes=100).rdd.getNumPartitions() == 3
    units = packages.parsed(read(content="true").where("path = 'a.md'").select("path", "sha256", "content"))
    assert units.count() >= 1


def test_a_changing_folder_is_a_stream(spark, place, tmp_path):
    spark.dataSource.register(folder.WatchedFolder)

    def snapshot():
        return spark.createDataFrame([(p, hashlib.sha256((place / p).read_bytes()).hexdigest()) for p in folder.listing(str(place), str(place / ".state"))], "path string, sha256 string")

    def run():
        stream = spark.readStream.format("watched_folder").options(path=str(place), cursors=str(place / ".state")).load()
        query = folder.file_changes(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "offsets")).trigger(availableNow=True).start()
        query.awaitTermination()
        return sorted((r.path, r.event, r.before_sha256, r.after_sha256) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    want = [(r.path, "CREATED", None, r.sha256) for r in snapshot().collect()]
    assert run() == sorted(want)
    assert run() == sorted(want)  # a restart repeats nothing
    before = snapshot()
    (place / "a.md").write_text("AA")
    (place / "sub" / "f.md").write_text("F")
    (place / "b.MD").unlink()
    os.utime(place / "sub" / "d.markdown", ns=(1, 1))  # touched only
    (place / "gone.md").write_text("")
    (place / "gone.md").unlink()
    events = [tuple(r) for r in changes.snapshot_events(before, snapshot()).collect()]
    assert len(events) == 3
    want = sorted([*want, *events], key=lambda r: tuple(map(str, r)))
    assert sorted(run(), key=lambda r: tuple(map(str, r))) == want
    (place / "a.md").write_text("A")
    want = sorted([*want, ("a.md", "MODIFIED", sha("AA"), sha("A"))], key=lambda r: tuple(map(str, r)))
    assert sorted(run(), key=lambda r: tuple(map(str, r))) == want
    # only what the next batch needs is kept
    assert len(os.listdir(place / ".state")) <= 2


def test_offsets_are_saved_cursors(place, tmp_path):
    reader = folder.FolderStreamReader({"path": str(place), "cursors": str(tmp_path / "state")})
    first = reader.latestOffset()
    assert first == reader.latestOffset() == {"version": 1}
    (place / "a.md").write_text("longer")
    (place / "b.MD").unlink()
    second = reader.latestOffset()
    files = [f for share in reader.partitions(first, second) for f in share.files]
    assert files == [("b.MD", "DELETED"), ("a.md", "MODIFIED")] and reader.partitions(first, second)[0].files == files
    assert [r[:2] for share in reader.partitions(first, second) for r in reader.read(share)] == files
    reader.commit(second)
    assert reader.cursors.versions() == [2]
    path = tmp_path / "state" / "cursor-000000000002.json"
    good = json.loads(path.read_text())
    for bad in (
        good | {"schema_version": 2}, good | {"root": "/other"}, good | {"files": []}, {"root": good["root"]}, [],
        good | {"files": {"../a.md": {"size": 1, "mtime_ns": 1}}}, good | {"files": {"a.txt": {"size": 1, "mtime_ns": 1}}},
        good | {"files": {"a.md": {"size": -1, "mtime_ns": 1}}}, good | {"files": {"a.md": {"size": True, "mtime_ns": 1}}}, good | {"files": {"a.md": {"size": 1}}},
    ):
        path.write_text(json.dumps(bad))
        with pytest.raises(folder.CursorError):
            reader.latestOffset()
    path.write_text("{")
    with pytest.raises(folder.CursorError):
        reader.latestOffset()


def test_a_file_that_keeps_changing_fails_the_scan(place, monkeypatch):
    stat, times = os.stat, iter(range(1, 99))

    def moving(path, *args, **kwargs):
        found = stat(path, *args, **kwargs)
        if str(path).endswith("a.md"):
            os.utime(path, ns=(next(times) * 10**9,) * 2)
            found = stat(path, *args, **kwargs)
        return found

    monkeypatch.setattr(os, "stat", moving)
    with pytest.raises(folder.FileChanged):
        folder.captured(str(place), "a.md")
    assert folder.captured(str(place), "absent.md") is None
