"""The facade: prepare, assess, gate, apply, search, status and scan over DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators import changes, index, risk, workflow


def scan(before: DataFrame, after: DataFrame) -> DataFrame:
    """Events between two snapshots (path, sha256)."""
    return changes.snapshot_events(before, after)


def prepare(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """(doc_id, base_text, cand_text, base_sha256, cand_sha256) of documents (doc_id, text) in both."""
    b = baseline.select("doc_id", F.coalesce("text", F.lit("")).alias("base_text"))
    c = candidate.select("doc_id", F.coalesce("text", F.lit("")).alias("cand_text"))
    return b.join(c, "doc_id").withColumns({"base_sha256": F.sha2("base_text", 256), "cand_sha256": F.sha2("cand_text", 256)})


def assess(prepared: DataFrame, units: DataFrame | None = None, artifacts: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Verdicts and findings of prepared pairs with the candidates' units and artifacts; see ``risk.with_findings``."""
    arrays = changes.change_arrays(prepared)
    return risk.verdicts(arrays, units, artifacts), risk.findings(arrays, units, artifacts)


def gate(rows: DataFrame) -> DataFrame:
    """Action and reason of each verdict with its facts; see ``risk.gate``."""
    return risk.gate(rows)


def apply(log: DataFrame) -> DataFrame:
    """Current versions after an index log."""
    return index.current_versions(log)


def search(chunks: DataFrame, queries: list[tuple[int, str]], limit: int = 5) -> DataFrame:
    return index.search(chunks, queries, limit)


def status(events: DataFrame) -> DataFrame:
    """State and allowed commands of each analysis."""
    return workflow.statuses(events)
