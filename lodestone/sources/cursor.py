"""The saved cursor of a scan: one row for each file that it names, checked before anything is compared with it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What a file record holds, and the formats and suffixes that are scanned.
FIELDS = ("format", "mtime_ns", "sha256", "size")
FORMATS = ("PDF", "DOCX", "HWPX", "MD", "MARKDOWN")
SUFFIXES = "pdf|docx|hwpx|md|markdown"
VERSION = 1


def _token(record: Column, name: str) -> Column:
    """A number as it is written in the record; a string's quotes are part of it."""
    return F.trim(F.regexp_extract(record, rf'"{name}"\s*:\s*([^,}}]*)', 1))


def header_issue(version: Column, root: Column, expected_root: str) -> Column:
    """Why a whole cursor isn't to be used, or null."""
    return F.when(~F.coalesce(version == VERSION, F.lit(False)), "VERSION").when(root.isNull(), "ROOT_MISSING").when(root != expected_root, "OTHER_ROOT")


def record_issue(path: Column, record: Column) -> Column:
    """The first thing wrong with a file record (JSON), or null."""
    keys = F.array_sort(F.json_object_keys(record))
    checks = [
        (path.rlike(r"^/|(^|/)\.{0,2}(/|$)"), "PATH"),
        (~path.rlike(rf"(?i)\.({SUFFIXES})$"), "SUFFIX"),
        (~F.coalesce(keys == F.array(*map(F.lit, FIELDS)), F.lit(False)), "FIELDS"),
        (~F.coalesce(F.get_json_object(record, "$.format").isin(*FORMATS), F.lit(False)), "FORMAT"),
        (~F.coalesce(F.get_json_object(record, "$.sha256").rlike("^[0-9a-f]{64}$"), F.lit(False)), "SHA256"),
        (~_token(record, "size").rlike("^[0-9]+$"), "SIZE"),
        (~_token(record, "mtime_ns").rlike("^[0-9]+$"), "MTIME"),
    ]
    return F.coalesce(*[F.when(F.coalesce(bad, F.lit(True)), reason) for bad, reason in checks])


def checked(records: DataFrame, expected_root: str) -> DataFrame:
    """The rows (version, root, path, record) with the issue of the cursor or else of the record."""
    return records.withColumn("issue", F.coalesce(header_issue(F.col("version"), F.col("root"), expected_root), record_issue(F.col("path"), F.col("record"))))
