"""Deterministic risk rules over changes, artifacts and hidden units; scores, findings and verdicts.

All rules of a document read its arrays of changes, artifacts and hidden units and make one array of findings, in the
order of the rules; the verdict is the greatest score, in bands. Nothing is shuffled but what groups units and artifacts
by document.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import policy

BLOCK_FROM, REVIEW_FROM, MOST_FINDINGS, MOST_HIDDEN, MOST_CHARACTERS = 70, 30, 100, 5, 500
FINDING = "struct<score:int,type:string,rule_order:int,severity:string,reason:string,before:string,after:string>"
ARTIFACT = "array<struct<type:string,reason:string>>"

# The reasons that findings give.
REASONS = {
    "controls": "Zero-width or bidirectional control characters were found.",
    "hidden": "Candidate text is present but visually hidden or suppressed.",
    "policy number": "A numeric value changed in policy-sensitive context.",
    "number": "A numeric value changed and requires human verification.",
    "date": "A date or effective period changed and requires policy review.",
    "hidden prompt": "A hidden instruction attempts to redirect an AI system.",
    "prompt": "Changed text contains an instruction pattern aimed at an AI system.",
    "semantic": "Policy-sensitive wording changed and requires contextual review.",
    "generic": "Document content changed without a stronger deterministic classification.",
}


def _finding(score, kind, order, severity, reason, before=None, after=None) -> Column:
    values = (score, kind, order, severity, reason, before, after)
    return F.struct(*[v if isinstance(v, Column) else F.lit(v) for v in values]).cast(FINDING)


def cut(text: Column, most: int = MOST_CHARACTERS) -> Column:
    """At most so many characters, with a sign where some are left out."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("…"))).otherwise(text)


def _joined(values: Column) -> Column:
    """Values as one text; null without any."""
    return F.when(F.size(values) > 0, F.array_join(values, " · "))


def _facts(c: Column) -> Column:
    """What the rules ask of one change, each evaluated once."""
    before, after = F.coalesce(c["before"], F.lit("")), F.coalesce(c["after"], F.lit(""))
    return F.struct(
        c["before"].alias("before"),
        c["after"].alias("after"),
        c["numbers"].alias("numbers"),
        (F.size(c["numbers"]["before"]) + F.size(c["numbers"]["after"]) > 0).alias("has_numbers"),
        policy.has_policy_term(F.concat_ws(" ", F.nullif(before, F.lit("")), F.nullif(after, F.lit("")))).alias("spaced_term"),
        policy.has_policy_term(F.concat(before, after)).alias("term"),
        policy.date_set(before).alias("dates_before"),
        policy.date_set(after).alias("dates_after"),
        policy.has_prompt_injection(after).alias("injected"),
    )


def _of_artifact(a: Column, hidden: Column) -> Column:
    """A hard block, hidden text or controls, tracked changes or references, anything else. What hidden units tell in more
    detail, hidden text doesn't tell again."""
    kind = F.upper(a["type"])
    pick = lambda hard, hidden, controls, outside, other: F.when(kind.isin(*policy.HARD_BLOCK_TYPES), hard).when(kind == "HIDDEN_TEXT", hidden).when(kind == "CONTROL_CHARACTERS", controls).when(kind.isin("TRACKED_CHANGES", "EXTERNAL_REFERENCE"), outside).otherwise(other)
    finding = _finding(pick(100, 80, 80, 45, 30), kind, pick(1, 2, 3, 4, 5), pick("CRITICAL", "HIGH", "HIGH", "MEDIUM", "MEDIUM"), a["reason"])
    return F.when(~((kind == "HIDDEN_TEXT") & (F.size(hidden) > 0)), finding)


def _of_number(f: Column) -> Column:
    pick = lambda yes, no: F.when(f["spaced_term"], yes).otherwise(no)
    finding = _finding(pick(75, 55), pick("POLICY_NUMBER_CHANGE", "NUMBER_CHANGE"), 7, pick("HIGH", "MEDIUM"), pick(REASONS["policy number"], REASONS["number"]), _joined(f["numbers"]["before"]), _joined(f["numbers"]["after"]))
    return F.when(f["has_numbers"], finding)


def _of_dates(f: Column) -> Column:
    pick = lambda yes, no: F.when(f["term"], yes).otherwise(no)
    finding = _finding(pick(70, 50), "POLICY_DATE_CHANGE", 8, pick("HIGH", "MEDIUM"), REASONS["date"], _joined(f["dates_before"]), _joined(f["dates_after"]))
    return F.when(f["dates_before"] != f["dates_after"], finding)


def _of_wording(found: Column, f: Column) -> Column:
    """Policy wording that no other rule has classed and no finding so far speaks of. Two texts that are both missing count
    as the same, so an addition is spoken of by any finding without a text before."""
    told = F.exists(found, lambda g: (g["before"].isNotNull() | g["after"].isNotNull()) & (g["before"].eqNullSafe(f["before"]) | g["after"].eqNullSafe(f["after"])))
    wanted = ~f["has_numbers"] & (f["dates_before"] == f["dates_after"]) & f["spaced_term"] & ~told
    return F.when(wanted, F.concat(found, F.array(_finding(50, "POLICY_SEMANTIC_CHANGE", 10, "MEDIUM", REASONS["semantic"], cut(f["before"]), cut(f["after"]))))).otherwise(found)


def _grouped(units: DataFrame | None, artifacts: DataFrame | None) -> list[DataFrame]:
    """(doc_id, hidden) and (doc_id, artifacts) as arrays, in a fixed order."""
    out = []
    if units is not None:
        order = "ord" if "ord" in units.columns else "text"
        hidden = units.where("hidden").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.coalesce("text", F.lit("")).alias("text")))).alias("hidden"))
        out.append(hidden.select("doc_id", F.transform("hidden", lambda u: u["text"]).alias("hidden")))
    if artifacts is not None:
        reason = F.col("reason") if "reason" in artifacts.columns else F.lit(None).cast("string")
        out.append(artifacts.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("type", reason.alias("reason")))).alias("artifacts")))
    return out


def with_findings(change_arrays: DataFrame, units: DataFrame | None = None, artifacts: DataFrame | None = None) -> DataFrame:
    """The rows of documents (doc_id, changes, controls, …) with ``findings`` in the order of the rules in place of
    changes and controls. Units are (doc_id, text, hidden[, ord]), artifacts (doc_id, type[, reason])."""
    rows = change_arrays
    for more in _grouped(units, artifacts):
        rows = rows.join(more, "doc_id", "left")
    for name, kind in (("hidden", "array<string>"), ("artifacts", ARTIFACT)):
        rows = rows.withColumn(name, F.coalesce(name, F.array().cast(kind)) if name in rows.columns else F.array().cast(kind))
    control = F.when(F.size("controls") > 0, F.array(F.struct(F.lit("CONTROL_CHARACTERS").alias("type"), F.lit(REASONS["controls"]).alias("reason")))).otherwise(F.array().cast(ARTIFACT))
    kept = [c for c in rows.columns if c not in ("changes", "controls", "hidden", "artifacts")]
    rows = rows.select(*kept, "hidden", F.concat("artifacts", control).alias("artifacts"), F.transform("changes", _facts).alias("facts"))
    hidden = F.col("hidden")
    shown = cut(F.array_join(F.slice(hidden, 1, MOST_HIDDEN), "\n"))
    none = F.array().cast(f"array<{FINDING}>")
    found = F.concat(
        F.array_compact(F.transform("artifacts", lambda a: _of_artifact(a, hidden))),
        F.when(F.size(hidden) > 0, F.array(_finding(80, "HIDDEN_TEXT", 6, "HIGH", REASONS["hidden"], None, shown))).otherwise(none),
        F.array_compact(F.transform("facts", _of_number)),
        F.array_compact(F.transform("facts", _of_dates)),
        F.array_compact(F.transform("facts", lambda f: F.when(f["injected"], _finding(85, "PROMPT_INJECTION", 9, "HIGH", REASONS["prompt"], None, cut(f["after"]))))),
        F.array_compact(F.transform(hidden, lambda u: F.when(policy.has_prompt_injection(u), _finding(95, "PROMPT_INJECTION", 9, "CRITICAL", REASONS["hidden prompt"], None, cut(u))))),
    )
    rows = rows.select(*kept, "facts", found.alias("findings"))
    rows = rows.select(*kept, "facts", F.aggregate("facts", F.col("findings"), _of_wording).alias("findings"))
    generic = F.array(_finding(35, "DOCUMENT_CONTENT_CHANGE", 11, "MEDIUM", REASONS["generic"]))
    return rows.select(*kept, F.when((F.size("facts") > 0) & (F.size("findings") == 0), generic).otherwise(F.col("findings")).alias("findings"))


def findings(change_arrays: DataFrame, units: DataFrame | None = None, artifacts: DataFrame | None = None) -> DataFrame:
    """(doc_id, finding_index, score, type, rule_order, severity, reason, before, after): the first of findings that are
    equal in type, texts and reason, ``MOST_FINDINGS`` of a document at most."""
    rows = with_findings(change_arrays, units, artifacts)
    key = lambda f: F.struct(f["type"], f["before"], f["after"], f["reason"])
    rows = rows.select("doc_id", "findings", F.transform("findings", key).alias("keys"))
    first = F.transform(F.array_distinct("keys"), lambda k: F.element_at("findings", F.array_position("keys", k).cast("int")))
    rows = rows.select("doc_id", F.posexplode(F.slice(first, 1, MOST_FINDINGS)).alias("place", "f"))
    return rows.select("doc_id", (F.col("place") + 1).alias("finding_index"), "f.*")


def banded(score: Column) -> tuple[Column, Column]:
    """Decision and index action of a score; what is null is blocked."""
    decision = F.when(score < REVIEW_FROM, "ALLOW").when(score < BLOCK_FROM, "REVIEW").otherwise("BLOCK")
    return decision, F.when(score < REVIEW_FROM, "INDEX").when(score < BLOCK_FROM, "HOLD").otherwise("QUARANTINE")


def integrity_issue(rows: DataFrame) -> Column:
    """The first reason why a request (base_sha256, cand_sha256, diff_base_sha256, diff_cand_sha256, base_normalized_sha256,
    cand_normalized_sha256) can't be trusted, or null. What is missing is not as it should be."""
    c = F.col
    checks = [(~c(f"diff_{side}_sha256").eqNullSafe(c(f"{side}_sha256")), f"Diff {name} SHA-256 does not match the immutable analysis request.") for side, name in (("base", "baseline"), ("cand", "candidate"))]
    digests = (("base", "baseline"), ("cand", "candidate"), ("base_normalized", "baseline normalized"), ("cand_normalized", "candidate normalized"))
    checks += [(~F.coalesce(c(f"{column}_sha256").rlike("^[0-9a-fA-F]{64}$"), F.lit(False)), f"The {name} SHA-256 is malformed.") for column, name in digests]
    return F.coalesce(*[F.when(bad, reason) for bad, reason in checks])


def verdicts(change_arrays: DataFrame, units: DataFrame | None = None, artifacts: DataFrame | None = None) -> DataFrame:
    """(doc_id, risk_score, decision, index_action) of every document and its further columns: the greatest score of its
    findings, else 0. A row whose ``issue`` (see ``integrity_issue``) isn't null is 100 whatever it holds."""
    rows = with_findings(change_arrays, units, artifacts)
    score = F.coalesce(F.array_max(F.transform("findings", lambda f: f["score"])), F.lit(0))
    if "issue" in rows.columns:
        score = F.when(F.col("issue").isNotNull(), 100).otherwise(score)
    rows = rows.withColumn("risk_score", score)
    decision, action = banded(F.col("risk_score"))
    kept = [c for c in change_arrays.columns if c not in ("doc_id", "changes", "controls")]
    return rows.select("doc_id", "risk_score", decision.alias("decision"), action.alias("index_action"), *kept)


def model_score(risk_score: Column, severities: Column) -> Column:
    """What a model's assessment counts: its own score or its gravest finding's, whichever is greater."""
    weight = F.create_map(*[F.lit(x) for kv in (("LOW", 20), ("MEDIUM", 50), ("HIGH", 80), ("CRITICAL", 100)) for x in kv])
    return F.greatest(risk_score, F.coalesce(F.array_max(F.transform(severities, lambda s: F.element_at(weight, s))), F.lit(0)))


def artifact_scores(artifacts: DataFrame, key: str) -> DataFrame:
    """(key, score, hard_block): the artifact rules of each document."""
    kind = policy.normalized_type(F.col("type"))
    hard = policy.is_hard_block(F.col("type"), F.col("hard_block"), F.col("empty"), F.col("size"))
    score = F.when(hard, 100).when(kind.isin("HIDDEN_TEXT", "CONTROL_CHARACTERS"), 80).when(kind.isin("TRACKED_CHANGES", "EXTERNAL_REFERENCE"), 45).otherwise(30)
    return artifacts.select(key, score.alias("score"), hard.alias("hard")).groupBy(key).agg(F.max("score").alias("score"), F.bool_or("hard").alias("hard_block"))


def gate(rows: DataFrame) -> DataFrame:
    """(…, action, reason): the ordered checks before anything is indexed. The first that fails decides; whatever no
    check clears is quarantined."""
    c = F.col
    deny = [
        (c("decision").isNull() | ~c("decision").isin("ALLOW", "REVIEW", "BLOCK"), "INVALID_POLICY_RESULT"),
        (~c("audited"), "ANALYSIS_NOT_AUDITED"),
        (~c("chain_valid"), "AUDIT_CHAIN_INVALID"),
        (c("quarantined"), "ANALYSIS_ALREADY_QUARANTINED"),
        (~c("stored_digest").eqNullSafe(c("prepared_digest")), "PREPARED_ANALYSIS_MISMATCH"),
        (~c("document_id").eqNullSafe(c("cand_document_id")), "DOCUMENT_ID_MISMATCH"),
        (~c("diff_base_sha256").eqNullSafe(c("base_sha256")), "BASELINE_SHA256_MISMATCH"),
        (c("expected_sha256").isNotNull() & ~c("expected_sha256").eqNullSafe(c("base_sha256")), "TRUSTED_BASELINE_SHA256_MISMATCH"),
        (~c("diff_cand_sha256").eqNullSafe(c("cand_sha256")), "CANDIDATE_SHA256_MISMATCH"),
        (c("policy_sha256").isNotNull() & ~c("policy_sha256").eqNullSafe(c("cand_sha256")), "POLICY_CANDIDATE_SHA256_MISMATCH"),
        ((c("decision") == "ALLOW") & c("policy_sha256").isNull(), "POLICY_CANDIDATE_SHA256_REQUIRED"),
        (c("blob_sha256").isNull(), "CANDIDATE_BLOB_MISSING"),
        (c("blob_sha256") != c("cand_sha256"), "CANDIDATE_BLOB_SHA256_MISMATCH"),
        (c("hard_block"), "HARD_BLOCK_ARTIFACT"),
        (c("analysis_status") != "COMPLETED", "ANALYSIS_NOT_COMPLETED"),
    ]
    reason = reduce(lambda out, x: out.when(F.coalesce(x[0], F.lit(True)), x[1]), deny, F.when(F.lit(False), ""))
    reason = reason.when(c("decision") == "REVIEW", "POLICY_REVIEW_HOLD").when(c("decision") == "BLOCK", "POLICY_BLOCK")
    reason = reason.when(~c("index_requested"), "INDEX_NOT_REQUESTED").when(c("index_action") != "INDEX", "POLICY_COMBINATION_NOT_INDEXABLE").otherwise("INDEXED")
    action = F.when(c("reason") == "INDEXED", "INDEX").when(c("reason").isin("POLICY_REVIEW_HOLD", "INDEX_NOT_REQUESTED"), "HOLD").otherwise("QUARANTINE")
    return rows.withColumn("reason", reason).withColumn("action", action)
