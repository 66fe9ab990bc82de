"""A watched folder as a data source, for batches and for streams.

``spark.read.format("watched_folder")`` gives the files of a folder; ``spark.readStream`` what came, changed or went between
one scan and the next. The driver only lists names, sizes and times; files are read and hashed by the tasks, which take
shares of about equal bytes. A folder has to lie where the driver and all executors see it.

Rules of the walk: symbolic links are never followed, nor read; only the suffixes of ``cursor.SUFFIXES`` count; the folder
of saved cursors is no part of it. A file that changes while it is read is read once more, and then fails the scan; one
that is gone by then is left out.

A stream's offset names a saved cursor, a scan's listing that is written in full and then moved into place: what a batch
holds is the difference of the two cursors that it lies between, so a batch that is repeated names the same files, and a
restart begins behind the last batch that was committed. Saved cursors are checked before they are used.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lodestone.sources import cursor

FILES = "path string, format string, size bigint, mtime_ns bigint, sha256 string, content binary"
CHANGED = "path string, event string, format string, size bigint, mtime_ns bigint, sha256 string"
SUFFIX = re.compile(rf"\.({cursor.SUFFIXES})\Z", re.I)
OUTSIDE = re.compile(r"^/|(^|/)\.{0,2}(/|$)")
#: Bytes of files of a partition, and that are read at once.
PARTITION_BYTES, READ_BYTES = 64 << 20, 1 << 20

Listing = dict[str, tuple[int, int]]


class FileChanged(Exception):
    """A file kept changing while it was read."""


class CursorError(Exception):
    """A saved cursor that isn't to be used."""


@dataclass
class Share(InputPartition):
    """Files of a task: (path, event)."""

    files: list[tuple[str, str]] = field(default_factory=list)


def listing(root: str, apart: str | None = None, recursive: bool = True) -> Listing:
    """(size, time) of each file of a folder by its name from the folder on; ``apart`` is left out."""
    out: Listing = {}
    apart = os.path.realpath(apart) if apart else None
    for place, folders, names in os.walk(root, followlinks=False):
        folders[:] = sorted(f for f in folders if recursive and not os.path.islink(os.path.join(place, f)) and os.path.realpath(os.path.join(place, f)) != apart)
        for name in names:
            path = os.path.join(place, name)
            if not SUFFIX.search(name) or os.path.islink(path) or not os.path.isfile(path):
                continue
            try:
                found = os.stat(path)
            except FileNotFoundError:
                continue
            out[os.path.relpath(path, root).replace(os.sep, "/")] = found.st_size, found.st_mtime_ns
    return out


def shares(files: list[tuple[str, str, int]], most: int = PARTITION_BYTES) -> list[Share]:
    """(path, event, bytes) dealt in shares of about ``most`` bytes, a larger file alone; always one share."""
    out, held = [Share()], 0
    for path, event, size in files:
        if held and held + size > most:
            out.append(Share())
            held = 0
        out[-1].files.append((path, event))
        held += size + 1
    return out


def captured(root: str, path: str, content: bool = False) -> tuple | None:
    """(path, format, size, mtime_ns, sha256, content) of a file as it is; None where it is gone."""
    place = os.path.join(root, path)
    try:
        for _ in range(2):
            before, digest, kept, size = os.stat(place), hashlib.sha256(), [], 0
            with open(place, "rb") as f:
                while block := f.read(READ_BYTES):
                    digest.update(block)
                    size += len(block)
                    if content:
                        kept.append(block)
            after = os.stat(place)
            if size == before.st_size == after.st_size and before.st_mtime_ns == after.st_mtime_ns:
                return path, path.rpartition(".")[2].upper(), size, after.st_mtime_ns, digest.hexdigest(), b"".join(kept) if content else None
    except FileNotFoundError:
        return None
    raise FileChanged(path)


class Cursors:
    """Saved listings by version; version 0 is the empty one before any scan."""

    def __init__(self, folder: str, root: str):
        self.folder, self.root = folder, os.path.realpath(root)

    def _path(self, version: int) -> str:
        return os.path.join(self.folder, f"cursor-{version:012d}.json")

    def versions(self) -> list[int]:
        names = os.listdir(self.folder) if os.path.isdir(self.folder) else []
        return sorted(int(m[1]) for m in (re.fullmatch(r"cursor-(\d{12})\.json", n) for n in names) if m)

    def load(self, version: int) -> Listing:
        if not version:
            return {}
        try:
            with open(self._path(version), encoding="utf-8") as f:
                saved = json.load(f)
        except (OSError, ValueError) as e:
            raise CursorError(f"cursor {version} can't be read: {e}") from e
        whole = lambda x: isinstance(x, int) and not isinstance(x, bool) and x >= 0
        if not isinstance(saved, dict) or saved.get("schema_version") != cursor.VERSION:
            raise CursorError(f"cursor {version} has another version")
        if saved.get("root") != self.root:
            raise CursorError(f"cursor {version} is of another folder")
        files = saved.get("files")
        if not isinstance(files, dict):
            raise CursorError(f"cursor {version} has no files")
        for path, record in files.items():
            if OUTSIDE.search(path) or not SUFFIX.search(path) or not isinstance(record, dict) or set(record) != {"size", "mtime_ns"} or not all(map(whole, record.values())):
                raise CursorError(f"cursor {version} holds a bad record of {path!r}")
        return {path: (r["size"], r["mtime_ns"]) for path, r in files.items()}

    def save(self, version: int, found: Listing) -> None:
        os.makedirs(self.folder, exist_ok=True)
        saved = {"files": {p: {"mtime_ns": t, "size": s} for p, (s, t) in sorted(found.items())}, "root": self.root, "schema_version": cursor.VERSION}
        with tempfile.NamedTemporaryFile("w", dir=self.folder, delete=False, encoding="utf-8") as f:
            json.dump(saved, f)
            f.flush()
            os.fsync(f.fileno())
        os.replace(f.name, self._path(version))

    def forget_before(self, version: int) -> None:
        for old in self.versions():
            if old < version:
                os.unlink(self._path(old))


class FolderReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.content = options["path"], str(options.get("content", "false")).lower() == "true"
        self.recursive, self.apart = str(options.get("recursive", "true")).lower() == "true", options.get("cursors")
        self.most = int(options.get("partition_bytes", PARTITION_BYTES))

    def partitions(self) -> list[Share]:
        return shares([(p, "", size) for p, (size, _) in sorted(listing(self.root, self.apart, self.recursive).items())], self.most)

    def read(self, partition: Share) -> Iterator[tuple]:
        for path, _ in partition.files:
            if row := captured(self.root, path, self.content):
                yield row


class FolderStreamReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.root, self.recursive = options["path"], str(options.get("recursive", "true")).lower() == "true"
        self.most = int(options.get("partition_bytes", PARTITION_BYTES))
        self.apart = options["cursors"]
        self.cursors = Cursors(self.apart, self.root)

    def initialOffset(self) -> dict:
        return {"version": 0}

    def latestOffset(self) -> dict:
        version = max(self.cursors.versions(), default=0)
        found = listing(self.root, self.apart, self.recursive)
        if found != self.cursors.load(version):
            version += 1
            self.cursors.save(version, found)
        return {"version": version}

    def partitions(self, start: dict, end: dict) -> list[Share]:
        before, after = self.cursors.load(start["version"]), self.cursors.load(end["version"])
        gone = [(p, "DELETED", 0) for p in sorted(before.keys() - after.keys())]
        come = [(p, "MODIFIED" if p in before else "CREATED", after[p][0]) for p in sorted(after) if before.get(p) != after[p]]
        return shares(gone + come, self.most)

    def read(self, partition: Share) -> Iterator[tuple]:
        for path, event in partition.files:
            if event == "DELETED":
                yield path, event, path.rpartition(".")[2].upper(), None, None, None
            elif row := captured(self.root, path):
                yield path, event, *row[1:5]

    def commit(self, end: dict) -> None:
        self.cursors.forget_before(end["version"])


class WatchedFolder(DataSource):
    """Options: path; recursive (true); content (false, batches only); cursors, the folder of saved cursors, for streams;
    partition_bytes."""

    @classmethod
    def name(cls) -> str:
        return "watched_folder"

    def schema(self) -> str:
        return CHANGED if self.options.get("cursors") and not self.options.get("content") else FILES

    def reader(self, schema) -> FolderReader:
        return FolderReader(dict(self.options) | {"content": self.options.get("content", "false")})

    def streamReader(self, schema) -> FolderStreamReader:
        if not self.options.get("cursors"):
            raise ValueError("a stream needs the option cursors")
        return FolderStreamReader(dict(self.options))


def file_changes(changed: DataFrame) -> DataFrame:
    """(path, event, before_sha256, after_sha256) of a stream of a watched folder, by content: a file that was touched only, or
    read twice, is no change; what was never seen can't go."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known, out = state.get[0] if state.exists else None, []
        for r in pd.concat(list(batches)).itertuples():
            sha = r.sha256 if isinstance(r.sha256, str) else None
            if sha != known:
                out.append((key[0], "CREATED" if known is None else "DELETED" if sha is None else "MODIFIED", known, sha))
                known = sha
        if known is not None:
            state.update((known,))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["path", "event", "before_sha256", "after_sha256"])

    schema = "path string, event string, before_sha256 string, after_sha256 string"
    return changed.groupBy("path").applyInPandasWithState(run, schema, "sha256 string", "append", GroupStateTimeout.NoTimeout)
