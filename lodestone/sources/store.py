"""A versioned table in any file system that Spark reaches: Parquet folders and one marker file a version.

A commit writes its rows to a folder of its own, then creates the marker of the next version, which names the folders that
make it up; creating a marker that exists fails, so of two writers that saw the same version one gets ``StaleVersion``
and nothing is overwritten. An append names the folders there are and its own: it writes its rows only. Every
``FOLDERS`` appends the rows are written anew as one folder. Readers take the highest marker once and read what it names.
A marker may carry a note, such as the batch of a stream that it commits.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

from lodestone.sources import scratch

FOLDERS = 64


class StaleVersion(Exception):
    """Another writer committed first."""


class VersionedTable:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The current version; 0 before the first commit."""
        marks = self._path(f"{self.folder}/versions")
        if not self._fs.exists(marks):
            return 0
        return max((int(s.getPath().getName()) for s in self._fs.listStatus(marks)), default=0)

    def _mark(self, version: int) -> dict:
        if not version:
            return {"folders": [], "note": None}
        stream = self._fs.open(self._path(f"{self.folder}/versions/{version:012d}"))
        try:
            return json.loads(stream.readUTF())
        finally:
            stream.close()

    def note(self, version: int | None = None) -> str | None:
        """The note of a version, the current one by default."""
        return self._mark(self.version() if version is None else version)["note"]

    def read(self, version: int | None = None, schema: str | None = None) -> DataFrame:
        """The rows of a version, the current one by default. Before the first commit there are none, of ``schema``."""
        folders = self._mark(self.version() if version is None else version)["folders"]
        if not folders:
            return self.spark.createDataFrame([], schema)
        reader = self.spark.read.schema(schema) if schema else self.spark.read
        return reader.parquet(*(f"{self.folder}/data/{name}" for name in folders))

    def commit(self, rows: DataFrame, expected: int, note: str | None = None) -> int:
        """Makes ``rows`` the version after ``expected``, if that is the current one."""
        return self._commit([], rows, expected, note)

    def append(self, rows: DataFrame, expected: int, note: str | None = None) -> int:
        """Adds ``rows`` to those of the version ``expected``, if that is the current one."""
        folders = self._mark(expected)["folders"] if expected else []
        if len(folders) >= FOLDERS:
            return self._commit([], self.read(expected, rows._jdf.schema().toDDL()).unionByName(rows), expected, note)
        return self._commit(folders, rows, expected, note)

    def _commit(self, folders: list[str], rows: DataFrame, expected: int, note: str | None) -> int:
        if self.version() != expected:
            raise StaleVersion(f"expected version {expected}, found {self.version()}")
        name = uuid.uuid4().hex
        with scratch.freeing(rows.sparkSession):
            rows.write.parquet(f"{self.folder}/data/{name}")
        mark = self._path(f"{self.folder}/versions/{expected + 1:012d}")
        try:
            stream = self._fs.create(mark, False)
        except Exception as e:
            raise StaleVersion(f"version {expected + 1} exists") from e
        stream.writeUTF(json.dumps({"folders": [*folders, name], "note": note}))
        stream.close()
        return expected + 1
