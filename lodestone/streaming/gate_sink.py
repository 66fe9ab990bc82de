"""From the events of a watched folder to decisions, and a streaming sink that carries them out.

``decided`` is the leg from a poll to a decision: what can't be read, prepared or assessed is held, never indexed; all else
goes through the rules and the ordered checks of the gate.

``GateSink`` is for ``foreachBatch``. A batch's decisions are compared with the index as it was before the batch (a candidate
is indexed only in place of the version that it was compared with), entered in the index log, and recorded in the audit
log, whose events are chained by hash. What the audit log refuses is taken out of the index again; if it can't be written
at all, everything that the batch indexed is, and the error is raised, so that the stream stops and repeats the batch. Both
logs are append-only versioned tables whose commits carry the batch and how far it came: a repeated batch goes on from
there, and does nothing once it is recorded.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.operators import changes, index, risk, workflow
from lodestone.sources import scratch
from lodestone.sources.store import VersionedTable

ENTRY = "document_id string, seq bigint, op string, sha256 string, expected string"
AUDIT = "analysis_id string, sequence bigint, event_type string, payload string, created_at string, previous_hash string, event_hash string"
Analyzer = Callable[[DataFrame], DataFrame]


def assessed(prepared: DataFrame) -> DataFrame:
    """(path, decision, index_action, policy_sha256, analysis_status) of prepared(path, base_text, cand_text, cand_sha256) by the
    rules over their changes."""
    arrays = changes.change_arrays(prepared.withColumnRenamed("path", "doc_id"), "cand_sha256")
    return risk.verdicts(arrays).select(F.col("doc_id").alias("path"), "decision", "index_action", F.col("cand_sha256").alias("policy_sha256"), F.lit("COMPLETED").alias("analysis_status"))


def decided(events: DataFrame, blobs: DataFrame, analyzer: Analyzer = assessed) -> DataFrame:
    """(path, sequence, at, document_id, analysis_id, base_sha256, cand_sha256, state, action, reason) of events(path, sequence,
    at, event, before_sha256, after_sha256), with blobs(sha256, text), whose text is null where no text could be extracted.
    Of several events of a path the last one counts. ``action`` is null where the index stays as it is."""
    last = F.row_number().over(Window.partitionBy("path").orderBy(F.desc("sequence"))) == 1
    rows = events.withColumn("last", last)
    side = lambda name: blobs.select(F.col("sha256").alias(f"{name}_sha256"), F.col("text").alias(f"{name}_text"), F.lit(True).alias(f"{name}_there"))
    # a new file is its own baseline
    rows = rows.select("*", F.col("after_sha256").alias("cand_sha256"), F.coalesce("before_sha256", "after_sha256").alias("base_sha256"))
    idle = ~F.col("last") | F.coalesce(F.col("event") == "DELETED", F.lit(False))
    same = F.col("base_sha256").eqNullSafe(F.col("cand_sha256"))
    # texts go to where they are needed only: none to what is held anyway, one to what is its own baseline
    one = rows.where(~idle & same).join(side("cand"), "cand_sha256", "left").withColumn("base_there", F.col("cand_there"))
    two = rows.where(~idle & ~same).join(side("cand"), "cand_sha256", "left").join(side("base"), "base_sha256", "left")
    rows = two.unionByName(one, True).unionByName(rows.where(idle), True)
    fault = (
        F.when(~F.col("last"), "superseded_in_batch")
        .when(F.col("event") == "DELETED", "deletion_requires_explicit_operator_review")
        .when(F.col("cand_there").isNull(), "source_snapshot_failed")
        .when(F.col("base_there").isNull(), "baseline_snapshot_missing")
        .when(F.col("cand_text").isNull() | (F.col("base_text").isNull() & ~same), "prepare_failed")
    )
    rows, path = scratch.written(rows.withColumn("fault", fault))
    rows = rows.withColumn("base_text", F.when(same, F.col("cand_text")).otherwise(F.col("base_text")))
    sound = rows.where("fault IS NULL")
    found = sound.join(analyzer(sound.select("path", "base_text", "cand_text", "base_sha256", "cand_sha256")), "path", "left")
    name = F.concat(F.lit("watch:"), F.col("path"))
    facts = {"audited": F.lit(True), "chain_valid": F.lit(True), "quarantined": F.lit(False), "hard_block": F.lit(False), "index_requested": F.lit(True), "stored_digest": F.lit("p"), "prepared_digest": F.lit("p")}
    same = {"document_id": name, "cand_document_id": name, "diff_base_sha256": F.col("base_sha256"), "expected_sha256": F.col("before_sha256"), "diff_cand_sha256": F.col("cand_sha256"), "blob_sha256": F.col("cand_sha256")}
    gated = risk.gate(found.withColumns(facts | same))
    none = F.col("decision").isNull() & F.col("analysis_status").isNull()
    action = F.when(none, "HOLD").otherwise(F.col("action"))
    reason = F.when(none, "RISK_ANALYSIS_UNAVAILABLE").otherwise(F.col("reason"))
    state = F.when(action == "INDEX", "INDEXED").when(action == "HOLD", "HOLD").otherwise("QUARANTINED")
    analysis = F.sha2(F.concat_ws("|", name, "base_sha256", "cand_sha256"), 256)
    keys = ["path", "sequence", "at", name.alias("document_id")]
    done = gated.select(*keys, analysis.alias("analysis_id"), F.col("before_sha256").alias("base_sha256"), "cand_sha256", state.alias("state"), action.alias("action"), reason.alias("reason"))
    kind = F.when(F.col("fault") == "superseded_in_batch", "SUPERSEDED").when(F.col("event") == "DELETED", "SOURCE_DELETED").otherwise("HOLD")
    null = F.lit(None).cast("string")
    held = rows.where("fault IS NOT NULL").select(*keys, null.alias("analysis_id"), F.col("before_sha256").alias("base_sha256"), "cand_sha256", kind.alias("state"), null.alias("action"), F.col("fault").alias("reason"))
    out, _ = scratch.written(done.union(held))
    scratch.forget(events.sparkSession, path)
    return out


def compared(decisions: DataFrame, log: DataFrame) -> DataFrame:
    """The decisions on analyses, with those to index turned away whose baseline isn't the current version in the index log."""
    own = decisions.where("action IS NOT NULL")
    current = index.current_versions(log.join(own.select("document_id"), "document_id", "left_semi")).select("document_id", "current_sha256")
    stale = (F.col("action") == "INDEX") & ~F.coalesce("current_sha256", F.lit("")).eqNullSafe(F.coalesce("base_sha256", F.lit("")))
    rows = own.join(current, "document_id", "left").withColumn("stale", stale).drop("current_sha256")
    turned = {"action": F.when(F.col("stale"), "QUARANTINE").otherwise(F.col("action")), "state": F.when(F.col("stale"), "QUARANTINED").otherwise(F.col("state")), "reason": F.when(F.col("stale"), "STALE_BASELINE_VERSION").otherwise(F.col("reason"))}
    return rows.withColumns(turned)


class GateSink:
    """Carries out the decisions of batches over two versioned tables below ``folder``: ``index`` and ``audit``."""

    def __init__(self, spark: SparkSession, folder: str, blobs: Callable[[], DataFrame], analyzer: Analyzer = assessed):
        self.spark, self.blobs, self.analyzer = spark, blobs, analyzer
        self.index, self.audit = VersionedTable(spark, f"{folder}/index"), VersionedTable(spark, f"{folder}/audit")

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        if int(self.audit.note() or -1) >= batch_id:
            return
        decisions = decided(batch, self.blobs(), self.analyzer)
        owner, phase, before = (self.index.note() or "-1::0").split(":")
        if int(owner) != batch_id or phase == "undone":
            phase, before = "", str(self.index.version())
        outcomes, path = scratch.written(compared(decisions, self.index.read(int(before), ENTRY)))
        if not phase:
            entry = F.when(F.col("action") == "INDEX", "INDEX").otherwise("REMOVE")
            self._enter(outcomes.where("NOT stale"), entry, f"{batch_id}:indexed:{before}")
        chain = self.audit.read(schema=AUDIT).join(outcomes.select("analysis_id"), "analysis_id", "left_semi")
        broken = workflow.verified(chain).where("NOT chain_valid").select("analysis_id")
        if phase != "settled":
            # what can't be recorded isn't indexed
            self._enter(outcomes.where("action = 'INDEX'").join(broken, "analysis_id", "left_semi"), F.lit("REMOVE"), f"{batch_id}:settled:{before}")
        try:
            self.record(self.chained(outcomes.join(broken, "analysis_id", "left_anti"), chain), batch_id)
        except Exception:
            self._enter(outcomes.where("action = 'INDEX'"), F.lit("REMOVE"), f"{batch_id}:undone:{before}")
            raise
        scratch.forget(self.spark, path)

    def _enter(self, rows: DataFrame, op: Column, note: str) -> None:
        """Appends a log entry for each row; a version's number orders its entries behind all before."""
        version = self.index.version()
        expected = F.when(op == "INDEX", F.coalesce("base_sha256", F.lit("")))
        self.index.append(rows.select("document_id", F.lit(version + 1).cast("bigint").alias("seq"), op.alias("op"), F.col("cand_sha256").alias("sha256"), expected.alias("expected")), version, note)

    def chained(self, outcomes: DataFrame, chain: DataFrame) -> DataFrame:
        """An audit event for each outcome, behind the last one of its analysis."""
        heads = chain.groupBy("analysis_id").agg(F.max("sequence").alias("last"), F.max_by("event_hash", "sequence").alias("head"))
        payload = F.to_json(F.struct("document_id", "action", "reason", F.col("cand_sha256").alias("candidate_sha256")))
        rows = outcomes.join(heads, "analysis_id", "left").select(
            "analysis_id", (F.coalesce("last", F.lit(0)) + 1).cast("bigint").alias("sequence"), F.lit("INDEX_GATE_APPLIED").alias("event_type"), payload.alias("payload"), F.col("at").cast("string").alias("created_at"), F.coalesce("head", F.lit(workflow.GENESIS)).alias("previous_hash")
        )
        return rows.withColumn("event_hash", F.sha2(F.concat("previous_hash", workflow.canonical(rows)), 256))

    def record(self, events: DataFrame, batch_id: int) -> None:
        self.audit.append(events, self.audit.version(), str(batch_id))

    def current(self) -> DataFrame:
        """(document_id, current_sha256, …) after all batches."""
        return index.current_versions(self.index.read(schema=ENTRY))


def sink_stream(events: DataFrame, sink: GateSink, checkpoint: str):
    """Starts the stream of events into the sink."""
    return events.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
