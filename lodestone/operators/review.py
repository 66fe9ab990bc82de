"""What a reviewing operator sees and does: mandatory reviews, command replays, undo, digests, changed lines."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import changes

# Phrases that send a change to a person.
MANDATORY = ("ignore previous", "system prompt", "지시를 무시", "프롬프트", "prompt injection")
MOST_BLOCKS, MOST_CHARACTERS = 30, 1600
SHOWN_TEXT, SHOWN_FINDINGS = 12_000, 50


def mandatory(change_type: Column, before: Column, after: Column) -> Column:
    """Whole files that come or go, and texts that speak to a model, are always for a person."""
    text = F.lower(F.concat(F.coalesce(before, F.lit("")), F.lit("\n"), F.coalesce(after, F.lit(""))))
    found = change_type.isin("ADDED", "DELETED")
    for phrase in MANDATORY:
        found = found | text.contains(phrase)
    return found


def changed_lines(pairs: DataFrame) -> DataFrame:
    """(doc_id, change_index, kind, before, after): changed blocks of raw lines, ``MOST_BLOCKS`` at most, trimmed and each
    of ``MOST_CHARACTERS`` at most: what a reviewer is shown."""
    lines = [F.split(F.regexp_replace(F.col(c), "(\r\n|\n|\r)$", ""), "\r\n|\n|\r") for c in ("base_text", "cand_text")]
    both = pairs.select("doc_id", lines[0].alias("b"), lines[1].alias("a")).where("b <> a")
    out = both.select("doc_id", F.posexplode(F.slice(changes.changed_blocks("b", "a"), 1, MOST_BLOCKS)).alias("change_index", "block"))

    def shown(part: str) -> Column:
        text = F.regexp_replace(F.array_join(F.col("block")[part], "\n"), r"^\s+|\s+$", "")
        return F.when(F.length(text) > MOST_CHARACTERS, F.concat(F.substring(text, 1, MOST_CHARACTERS - 3), F.lit("..."))).otherwise(text).alias(part)

    return out.select("doc_id", "change_index", F.col("block.kind").alias("kind"), shown("before"), shown("after"))


def replays(commands: DataFrame) -> DataFrame:
    """(command_id, outcome): the first command of a key is applied; the same one again is a replay, another a conflict."""
    order = Window.partitionBy("key").orderBy("at", "command_id")
    first = F.first("command").over(order)
    outcome = F.when(F.row_number().over(order) == 1, "APPLIED").when(first == F.col("command"), "REPLAY").otherwise("CONFLICT")
    return commands.select("command_id", outcome.alias("outcome"))


def undo(history: DataFrame, key: str, entry: str, selected: int) -> DataFrame:
    """The selected entry of each key and all later ones, in the order in which they are undone."""
    order = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(entry)))
    return history.where(F.col(entry) >= selected).withColumn("undo_order", order)


def digest(*fields: Column) -> Column:
    """SHA-256 over fields with their lengths before them, so that no two lists of fields look alike."""
    parts = [F.concat(F.octet_length(f).cast("string"), F.lit(":"), f) for f in fields]
    return F.sha2(F.concat(*parts), 256)


def authority_issues(status: DataFrame, analysis: DataFrame) -> DataFrame:
    """(key, issue): every rule on which a projected status and its prepared analysis disagree; no command may go out
    while one does. Rules compare null-safely, so what is missing on one side only is an issue.

    ``status``: key, analysis_id, document_id, version, attempt, changed_by, supersedes, prepared_at, cand_sha256,
    chain_valid, state, commands, policy(decision, index_action, cand_sha256) and outcome(analysis_id, document_id,
    cand_sha256, indexed, action), both null where there is none. ``analysis``: key, analysis_id, document_id,
    base_document_id, cand_document_id, version, attempt, changed_by, supersedes, prepared_at, base_sha256, cand_sha256,
    diff_base_sha256, diff_cand_sha256.
    """
    s, a = (lambda c, p=p: F.col(f"{p}.{c}") for p in ("s", "a"))
    differ = lambda x, y: ~x.eqNullSafe(y)
    both_differ = lambda *names: reduce(or_, [differ(s(n), a(n)) for n in names])
    policy, outcome, state, commands = s("policy"), s("outcome"), s("state"), s("commands")
    allow = F.coalesce((policy["decision"] == "ALLOW") & (policy["index_action"] == "INDEX"), F.lit(False))
    bound = allow & policy["cand_sha256"].eqNullSafe(a("cand_sha256"))
    none, indexed, action = outcome.isNull(), F.coalesce(outcome["indexed"], F.lit(False)), outcome["action"]
    foreign = differ(outcome["analysis_id"], a("analysis_id")) | differ(outcome["document_id"], a("document_id")) | differ(outcome["cand_sha256"], a("cand_sha256"))
    held = lambda act: ~none & ~indexed & action.eqNullSafe(F.lit(act))
    consistent = (
        F.when(state.isin("PREPARED", "ANALYSIS_REQUESTED", "ANALYSIS_FAILED"), policy.isNull() & none)
        .when(state == "AWAITING_APPROVAL", allow & held("HOLD"))
        .when(state == "HOLD", held("HOLD"))
        .when(state == "INDEXED", allow & ~none & indexed & action.eqNullSafe(F.lit("INDEX")))
        .when(state == "QUARANTINED", held("QUARANTINE"))
        .otherwise(True)
    )
    beyond = ((state == "SUPERSEDED") & (F.size(commands) > 0)) | ((state == "QUARANTINED") & F.exists(commands, lambda x: x != "REANALYZE"))
    rules = [
        ("ANALYSIS_IDENTITY_MISMATCH", both_differ("analysis_id", "document_id")),
        ("SNAPSHOT_IDENTITY_MISMATCH", differ(a("base_document_id"), a("document_id")) | differ(a("cand_document_id"), a("document_id"))),
        ("ANALYSIS_REVISION_MISMATCH", both_differ("version", "attempt")),
        ("STATUS_METADATA_MISMATCH", both_differ("changed_by", "supersedes", "prepared_at")),
        ("BASELINE_SHA_MISMATCH", differ(a("diff_base_sha256"), a("base_sha256"))),
        ("CANDIDATE_SHA_MISMATCH", both_differ("cand_sha256") | differ(a("diff_cand_sha256"), a("cand_sha256"))),
        ("AUDIT_CHAIN_INVALID", ~F.coalesce(s("chain_valid"), F.lit(False))),
        ("POLICY_SHA_MISMATCH", policy.isNotNull() & differ(policy["cand_sha256"], a("cand_sha256"))),
        ("COMMAND_POLICY_MISMATCH", F.array_contains(commands, "APPROVE") & ~(state.isin("AWAITING_APPROVAL", "HOLD") & bound)),
        ("COMMAND_STATE_MISMATCH", beyond),
        ("OUTCOME_IDENTITY_MISMATCH", ~none & foreign),
        ("CONTAINMENT_FAILURE", ~none & ~foreign & indexed & differ(action, F.lit("INDEX"))),
        ("POLICY_OUTCOME_MISMATCH", ~none & (indexed | action.eqNullSafe(F.lit("INDEX"))) & ~allow),
        ("STATE_OUTCOME_MISMATCH", ~consistent),
    ]
    joined = status.alias("s").join(analysis.alias("a"), s("key").eqNullSafe(a("key")))
    return joined.select(s("key").alias("key"), F.explode(F.array_compact(F.array(*[F.when(bad, code) for code, bad in rules]))).alias("issue"))


def effective_commands(status: DataFrame, issues: DataFrame) -> DataFrame:
    """(key, commands): the commands of a status; none while it has an issue."""
    named = issues.select("key").distinct().withColumn("bad", F.lit(True))
    return status.join(named, "key", "left").select("key", F.when(F.col("bad"), F.array().cast("array<string>")).otherwise(F.col("commands")).alias("commands"))


def lineage_broken(original: str, replacement: str, status: str, expected: Column) -> Column:
    """Whether a replacement analysis (an alias, like the others) doesn't go on with the original's evidence as its next
    attempt, or isn't the one expected."""
    o, r, s = (lambda c, p=p: F.col(f"{p}.{c}") for p in (original, replacement, status))
    same = reduce(and_, [r(c).eqNullSafe(o(c)) for c in ("document_id", "version", "base_sha256", "cand_sha256")])
    named = r("analysis_id").eqNullSafe(expected) & s("analysis_id").eqNullSafe(expected) & differs(r("analysis_id"), o("analysis_id"))
    follows = (r("attempt") == o("attempt") + 1) & r("supersedes").eqNullSafe(o("analysis_id")) & s("supersedes").eqNullSafe(o("analysis_id"))
    return ~F.coalesce(same & named & follows, F.lit(False))


def differs(x: Column, y: Column) -> Column:
    return ~x.eqNullSafe(y)


def reply_bound(rows: DataFrame) -> Column:
    """Whether the reply to a command is of that command, analysis and content, and its outcome and state follow from its
    action. Rows: sent and echoed (the command as sent and as in the reply), action, analysis_id, document_id, cand_sha256,
    status(analysis_id, document_id, cand_sha256, state, outcome), outcome(analysis_id, document_id, cand_sha256, action,
    indexed), replacement_id, replay."""
    c = F.col
    own = lambda x: reduce(and_, [x[n].eqNullSafe(c(n)) for n in ("analysis_id", "document_id", "cand_sha256")])
    status, outcome = c("status"), c("outcome")
    latest = status["outcome"]
    acted, indexed = outcome["action"], outcome["indexed"]
    stays = c("action").isin("HOLD", "REANALYZE")
    fits = F.when(stays, (acted == "HOLD") & ~indexed).otherwise(((acted == "INDEX") & indexed) | ((acted == "QUARANTINE") & ~indexed))
    replaced = (F.trim(F.coalesce("replacement_id", F.lit(""))) != "") & differs(c("replacement_id"), c("analysis_id")) & (status["state"] == "SUPERSEDED")
    heir = F.when(c("action") == "REANALYZE", replaced).otherwise(c("replacement_id").isNull())
    expected = F.when(c("action") == "HOLD", "HOLD").when(c("action") == "REANALYZE", "SUPERSEDED").when(indexed, "INDEXED").otherwise("QUARANTINED")
    fresh = latest.eqNullSafe(outcome) & (status["state"] == expected)
    bound = c("sent").eqNullSafe(c("echoed")) & own(status) & outcome.isNotNull() & own(outcome) & (latest.isNull() | own(latest))
    return F.coalesce(bound & fits & heir & (c("replay") | fresh), F.lit(False))


def evidence(rows: DataFrame) -> DataFrame:
    """What a model is shown of (base_text, cand_text, findings): texts and lists cut to fixed lengths."""
    return rows.withColumns({"before_text": F.substring("base_text", 1, SHOWN_TEXT), "after_text": F.substring("cand_text", 1, SHOWN_TEXT), "findings": F.slice("findings", 1, SHOWN_FINDINGS)})


def answer_outcome(rows: DataFrame) -> Column:
    """What becomes of an answer to hits(document_id, sha256), with the index's version before and after: evidence of one
    version is labelled S1, S2, …, and the answer has to cite some of it and nothing else."""
    hits = F.col("hits")
    one = F.size(F.array_distinct(hits)) == 1
    cited = F.array_distinct(F.transform(F.regexp_extract_all("answer", F.lit(r"\[S([0-9]+)\]"), F.lit(1)), lambda x: x.cast("int")))
    supported = (F.size(cited) > 0) & F.forall(cited, lambda x: x.between(1, F.size(hits)))
    return F.when(F.size(hits) == 0, "NO_EVIDENCE").when(~one, "MIXED_EVIDENCE").when(~F.col("before").eqNullSafe(F.col("after")), "INDEX_CHANGED").when(supported, "ANSWERED").otherwise("UNSUPPORTED")
