"""Replies of a model that judges changes: strict parsing, a second pass over what looks dangerous, a fallback.

A judge is a function of two columns, the evidence of a document (``review.evidence`` as a struct) and the phase, to the raw
reply as a string or null: a built-in expression, or an Arrow-batched pandas function over what stands behind it. It is
called for all rows of a batch at once; null evidence isn't asked, and its reply isn't read. Replies
are never trusted: one JSON object of the fixed shape, nothing beside it, severities of the fixed list; whatever else
comes counts as no reply, and what was found without the model stays in force.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators import risk

Judge = Callable[[Column, Column], Column]

# fixed values: the shape of a reply and what its parts count
SEVERITIES = ("LOW", "MEDIUM", "HIGH", "CRITICAL")
REPLY_KEYS = ("risk_score", "findings")
FINDING_KEYS = ("type", "before", "after", "reason", "severity", "location")
MOST_MODEL_FINDINGS, MOST_TYPE, MOST_TEXT = 50, 100, 2000
AUDIT_FROM, UNAVAILABLE_SCORE = 70, 50
UNAVAILABLE = "LLM_ANALYSIS_UNAVAILABLE"
UNAVAILABLE_REASON = "Contextual model analysis was unavailable; deterministic evidence remains authoritative and changed content cannot be auto-approved."

MODEL_FINDING = "struct<type:string,before:string,after:string,reason:string,severity:string,location:string>"


def stripped(raw: Column) -> Column:
    """The reply without white space around it, a think wrapper that holds none, and a code fence on lines of its own."""
    blank = r"^[\s\x1C-\x1F\u0085 　]+|[\s\x1C-\x1F\u0085 　]+$"
    text = F.regexp_replace(raw, blank, "")
    text = F.regexp_replace(text, r"^<think>\s*</think>\s*", "")
    inner = F.regexp_extract(text, r"(?s)^```[^\r\n]*\R(.*)\R[^\r\n]*```$", 1)
    return F.when(text.rlike(r"(?s)^```[^\r\n]*\R.*\R[^\r\n]*```$"), F.regexp_replace(inner, blank, "")).otherwise(text)


def _kind(v: Column) -> Column:
    """The type of a JSON value: OBJECT, ARRAY, STRING, VOID, BOOLEAN or a number's."""
    return F.regexp_extract(F.schema_of_variant(v), r"^[A-Z]+", 0)


def _only(keys: Column, allowed: tuple[str, ...]) -> Column:
    return F.size(F.array_except(keys, F.array(*map(F.lit, allowed)))) == 0


def _whole(v: Column) -> Column:
    """A whole number, also as a decimal without a fraction, as text or as a truth value; else null."""
    text = F.trim(v.try_cast("string"))
    number = text.rlike(r"^[+-]?[0-9]+(\.0*)?$") & _kind(v).isin("BIGINT", "DECIMAL", "DOUBLE", "STRING")
    return F.when(_kind(v) == "BOOLEAN", v.try_cast("boolean").cast("int")).when(number, F.regexp_extract(text, r"^[+-]?[0-9]+", 0).try_cast("int"))


def _text(o: Column, name: str, most: int, least: int | None) -> Column:
    """Whether an object's member is a text of the lengths allowed; without ``least`` it may be null or not there."""
    v = o[name]
    fits = (_kind(v) == "STRING") & F.length(v.try_cast("string")).between(least or 0, most)
    return F.coalesce(fits, F.lit(False)) if least else v.isNull() | (_kind(v) == "VOID") | F.coalesce(fits, F.lit(False))


def _fits(o: Column) -> Column:
    """Whether an object is a finding, whatever its severity."""
    place = o["location"].isNull() | _kind(o["location"]).isin("OBJECT", "VOID")
    severity = F.coalesce(_kind(o["severity"]) == "STRING", F.lit(False))
    return _only(F.map_keys(o), FINDING_KEYS) & _text(o, "type", MOST_TYPE, 1) & _text(o, "reason", MOST_TEXT, 1) & _text(o, "before", MOST_TEXT, None) & _text(o, "after", MOST_TEXT, None) & severity & place


def with_reply(rows: DataFrame, raw: Column, name: str) -> DataFrame:
    """The rows with ``name``, struct(issue, risk_score, findings), of a raw reply. ``issue`` is null for a sound one, else
    UNAVAILABLE, NOT_JSON, SHAPE or SEVERITY, and the rest is null. Names that repeat in an object aren't JSON here.

    Each step is a column of its own, as the next one reads it more than once.
    """
    c = lambda part: F.col(f"_{name}_{part}")
    add = lambda frame, **columns: frame.withColumns({f"_{name}_{k}": v for k, v in columns.items()})
    rows = add(rows, raw=raw)
    rows = add(rows, text=stripped(c("raw")))
    # what follows a first value would be passed over: within an object it is an error, or hides the member behind it, whose
    # name the text can't know
    rows = add(rows, whole=F.try_parse_json(F.concat(F.lit('{"reply":'), c("text"), F.lit(',"'), F.md5(c("text")), F.lit('":0}'))).try_cast("map<string,variant>"))
    rows = add(rows, value=F.when(F.map_contains_key(c("whole"), F.md5(c("text"))), c("whole")["reply"]))
    rows = add(rows, top=F.when(_kind(c("value")) == "OBJECT", c("value").try_cast("map<string,variant>")))
    rows = add(rows, number=c("top")["risk_score"], listed=c("top")["findings"])
    rows = add(rows, score=_whole(c("number")), list=F.when(c("listed").isNull(), F.array().cast("array<variant>")).when(_kind(c("listed")) == "ARRAY", c("listed").try_cast("array<variant>")))
    rows = add(rows, objects=F.transform(c("list"), lambda v: F.when(_kind(v) == "OBJECT", v.try_cast("map<string,variant>"))))
    sound = _only(F.map_keys(c("top")), REPLY_KEYS) & c("score").between(0, 100) & (F.size(c("objects")) <= MOST_MODEL_FINDINGS) & F.forall(c("objects"), lambda o: o.isNotNull() & _fits(o))
    get = lambda o, n: o[n].try_cast("string")
    known = F.forall(c("objects"), lambda o: get(o, "severity").isin(*SEVERITIES))
    issue = F.when(c("raw").isNull(), "UNAVAILABLE").when(c("value").isNull(), "NOT_JSON").when(~F.coalesce(sound, F.lit(False)), "SHAPE").when(~F.coalesce(known, F.lit(False)), "SEVERITY")
    rows = add(rows, issue=issue)
    found = F.transform(c("objects"), lambda o: F.struct(*[(F.when(_kind(o[n]) == "OBJECT", F.to_json(o[n])) if n == "location" else get(o, n)).alias(n) for n in FINDING_KEYS]))
    right = c("issue").isNull()
    rows = rows.withColumn(name, F.struct(c("issue").alias("issue"), F.when(right, c("score")).alias("risk_score"), F.when(right, found).alias("findings")))
    return rows.drop(*[x for x in rows.columns if x.startswith(f"_{name}_")])


def _score(reply: Column) -> Column:
    return risk.model_score(reply["risk_score"], F.transform(reply["findings"], lambda f: f["severity"]))


def _as_findings(reply: Column, source: str) -> Column:
    found = F.transform(reply["findings"], lambda f: F.struct(f["type"].alias("type"), f["before"].alias("before"), f["after"].alias("after"), f["reason"].alias("reason"), f["severity"].alias("severity"), F.lit(source).alias("source"), f["location"].alias("location")))
    return F.coalesce(found, F.array().cast(FOUND))


FOUND = "array<struct<type:string,before:string,after:string,reason:string,severity:string,source:string,location:string>>"


def judged(rows: DataFrame, judge: Judge, evidence: Column) -> DataFrame:
    """(doc_id, risk_score, decision, index_action, findings) of rows(doc_id, findings, …) of ``risk.with_findings`` with the
    model's view of each.

    A score of ``AUDIT_FROM`` or more, of rules or model, asks the model again; the higher score counts. Where a reply is
    missing or unsound, what came before stands, is no less than ``UNAVAILABLE_SCORE``, and a finding says so. A finding
    that blocks by itself keeps 100 whatever the model says. Of equal findings the first counts, and at most
    ``risk.MOST_FINDINGS`` are given.
    """
    rows = rows.withColumn("_static", F.coalesce(F.array_max(F.transform("findings", lambda f: f["score"])), F.lit(0)))
    hard = F.col("_static") >= 100
    # each pass is asked once: a reply is a column before anything reads it
    first = with_reply(rows, judge(evidence, F.lit("primary")), "_first")
    one = F.greatest(F.col("_static"), F.coalesce(_score(F.col("_first")), F.lit(0)))
    asks = F.col("_first.issue").isNull() & (one >= AUDIT_FROM)
    second = with_reply(first.withColumn("_one", one).withColumn("_asks", asks), judge(F.when(F.col("_asks"), evidence), F.lit("high_risk_audit")), "_second")
    failed = F.col("_first.issue").isNotNull() | F.col("_asks") & F.col("_second.issue").isNotNull()
    two = F.greatest(F.col("_one"), F.coalesce(_score(F.col("_second")), F.lit(0)), F.when(failed & ~hard, UNAVAILABLE_SCORE).otherwise(0))
    score = F.when(hard, 100).otherwise(F.least(two, F.lit(100))).cast("int")
    issue = F.coalesce("_first.issue", F.when(F.col("_asks"), F.col("_second.issue")))
    missing = F.array(F.struct(F.lit(UNAVAILABLE).alias("type"), F.lit(None).cast("string").alias("before"), F.lit(None).cast("string").alias("after"), F.lit(UNAVAILABLE_REASON).alias("reason"), F.lit("MEDIUM").alias("severity"), F.lit("SYSTEM").alias("source"), F.to_json(F.struct(issue.alias("error_type"))).alias("location")))
    static = F.transform("findings", lambda f: F.struct(f["type"].alias("type"), f["before"].alias("before"), f["after"].alias("after"), f["reason"].alias("reason"), f["severity"].alias("severity"), F.lit("STATIC").alias("source"), F.lit(None).cast("string").alias("location")))
    every = F.concat(static, _as_findings(F.col("_first"), "LLM_PRIMARY"), _as_findings(F.col("_second"), "LLM_AUDIT"), F.when(failed, missing).otherwise(F.array().cast(FOUND)))
    key = lambda f: F.struct(f["type"], f["before"], f["after"], f["reason"])
    out = second.select("doc_id", score.alias("risk_score"), every.alias("f"))
    out = out.withColumn("k", F.transform("f", key))
    chosen = F.slice(F.transform(F.array_distinct("k"), lambda k: F.element_at("f", F.array_position("k", k).cast("int"))), 1, risk.MOST_FINDINGS)
    decision, action = risk.banded(F.col("risk_score"))
    return out.select("doc_id", "risk_score", decision.alias("decision"), action.alias("index_action"), chosen.alias("findings"))
