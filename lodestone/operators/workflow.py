"""The audit chain and the workflow state of analyses, from their ordered events."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

GENESIS = "0" * 64


def canonical(df: DataFrame) -> F.Column:
    """The event as JSON with sorted keys, without its place in the chain. The payload is a string within it."""
    names = sorted(["analysis_id", "sequence", "event_type", "payload", "created_at"])
    return F.to_json(F.struct(*[F.col(n).cast("string").alias(n) for n in names]), {"ignoreNullFields": "false"})


LINKED = ["analysis_id", "sequence", "event_type", "payload", "created_at", "previous_hash", "event_hash"]


def chained(events: DataFrame) -> DataFrame:
    """Adds previous_hash and event_hash. Writing a chain is sequential: the events of an analysis stream through one task in
    order, which holds the last hash alone."""
    kinds = {f.name: f.dataType.simpleString() for f in events.schema}
    schema = ", ".join(f"{c} {kinds.get(c, 'string')}" for c in LINKED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        analysis, head = None, GENESIS
        for batch in batches:
            before, after = [], []
            for name, body in zip(batch["analysis_id"].to_pylist(), batch["body"].to_pylist(), strict=True):
                if name != analysis:
                    analysis, head = name, GENESIS
                before.append(head)
                head = hashlib.sha256((head + body).encode()).hexdigest()
                after.append(head)
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in LINKED[:5]), pa.array(before, pa.string()), pa.array(after, pa.string())], LINKED)

    rows = events.where(F.col("analysis_id").isNotNull()).select(*LINKED[:5], canonical(events).alias("body"))
    return rows.repartition("analysis_id").sortWithinPartitions("analysis_id", "sequence").mapInArrow(run, schema)


def verified(chain: DataFrame) -> DataFrame:
    """(analysis_id, events, chain_valid): contiguous from 1, each linked to the one before, each hash as recomputed.
    Verification needs only the neighbour, so it is a window and not a fold."""
    order = Window.partitionBy("analysis_id").orderBy("sequence")
    ok = (
        (F.col("sequence") == F.row_number().over(order))
        & F.col("previous_hash").eqNullSafe(F.lag("event_hash", 1, GENESIS).over(order))
        & F.col("event_hash").eqNullSafe(F.sha2(F.concat("previous_hash", canonical(chain)), 256))
    )
    return chain.withColumn("ok", ok).groupBy("analysis_id").agg(F.count("*").alias("events"), F.bool_and("ok").alias("chain_valid"))


def with_states(events: DataFrame) -> DataFrame:
    """Each event with the workflow state after it. A submission carries a policy (ALLOW where its value is 50 or more);
    an applied outcome is INDEX where its value is under 20 and QUARANTINE where it is 90 or more."""
    order = Window.partitionBy("analysis_id").orderBy("sequence")
    allow = F.when(F.col("event_type") == "POLICY_SUBMISSION_APPLIED", F.col("value") >= 50)
    known = F.coalesce(F.last(allow, ignorenulls=True).over(order), F.lit(False))
    applied = F.col("event_type").isin("INDEX_GATE_APPLIED", "POLICY_SUBMISSION_APPLIED")
    outcome = F.when((F.col("event_type") == "INDEX_GATE_APPLIED") & (F.col("value") < 20), "INDEXED").when(F.col("value") >= 90, "QUARANTINED").when(known, "AWAITING_APPROVAL").otherwise("HOLD")
    state = (
        F.when(F.col("event_type") == "ANALYSIS_REQUESTED", "ANALYSIS_REQUESTED")
        .when(F.col("event_type") == "ANALYSIS_DISPATCH_FAILED", "ANALYSIS_FAILED")
        .when(F.col("event_type") == "ANALYSIS_SUPERSEDED", "SUPERSEDED")
        .when(applied, outcome)
    )
    return events.withColumn("allowed", known).withColumn("state", state)


def statuses(events: DataFrame) -> DataFrame:
    """(analysis_id, state, allowed_commands): the fold of all events, as the last of ordered states."""
    last = with_states(events).groupBy("analysis_id").agg(F.max_by(F.struct("state", "allowed"), "sequence").alias("s"))
    state, allowed = F.col("s.state"), F.col("s.allowed")
    commands = F.array_compact(
        F.array(
            F.when(allowed & state.isin("AWAITING_APPROVAL", "HOLD"), "APPROVE"),
            F.when(~state.isin("SUPERSEDED", "QUARANTINED", "HOLD"), "HOLD"),
            F.when(state != "SUPERSEDED", "REANALYZE"),
        )
    )
    return last.select("analysis_id", state.alias("state"), F.array_join(commands, ",").alias("allowed_commands"))


def events_of(events: DataFrame, asked: DataFrame) -> DataFrame:
    """The events of the analyses (analysis_id) that are asked for, each once however often it is asked for."""
    return events.join(asked.select("analysis_id").distinct(), "analysis_id", "left_semi")


def recorded(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """(analysis_id, outcome) of prepared analyses (analysis_id, content digest): INSERTED where the name is new, UNCHANGED
    where the content is the stored one, CONFLICT where it is another; of one name's incoming rows the first content counts."""
    first = incoming.groupBy("analysis_id").agg(F.min("content").alias("first"))
    known = first.join(stored.withColumnRenamed("content", "kept"), "analysis_id", "left")
    outcome = F.when(F.coalesce("kept", "first") != F.col("content"), "CONFLICT").when(F.col("kept").isNull(), "INSERTED").otherwise("UNCHANGED")
    return incoming.join(known, "analysis_id").select("analysis_id", outcome.alias("outcome"))


def appended(log: DataFrame, new: DataFrame, *order: str) -> DataFrame:
    """``new`` with the sequence that follows its analysis's last one in ``log``."""
    last = log.groupBy("analysis_id").agg(F.max("sequence").alias("last"))
    place = F.row_number().over(Window.partitionBy("analysis_id").orderBy(*order))
    return new.withColumn("place", place).join(last, "analysis_id", "left").withColumn("sequence", (F.col("place") + F.coalesce("last", F.lit(0))).cast("bigint")).drop("place", "last")


def pending(events: DataFrame, request: str, applied: str, superseded: str) -> DataFrame:
    """(analysis_id, created) of analyses whose latest request has no later submission and whose last event isn't that they
    were superseded."""
    when = lambda kind: F.max(F.when(F.col("event_type") == kind, F.col("ts")))
    rows = events.groupBy("analysis_id").agg(when(request).alias("asked"), when(applied).alias("done"), F.max_by("event_type", "event_id").alias("last"), F.min("ts").alias("created"))
    return rows.where(F.col("asked").isNotNull() & (F.col("done").isNull() | (F.col("done") < F.col("asked"))) & (F.col("last") != superseded)).select("analysis_id", "created")


def case_requests(cases: DataFrame) -> DataFrame:
    """A full request for each labelled case."""
    name = F.col("case_id")
    return cases.select(
        F.concat(F.lit("case-"), name).alias("analysis_id"), F.concat(F.lit("doc-"), name).alias("document_id"), F.concat(F.lit("req-"), name).alias("request_id"), F.lit(1).alias("version"), F.lit(1).alias("attempt"),
        F.sha2("before_text", 256).alias("baseline_sha256"), F.sha2("after_text", 256).alias("candidate_sha256"), "before_text", "after_text", "category",
    )
