"""Small records: commits of a log, event lines, locations, error envelopes and the evaluation report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What separates the fields of a log's row.
FIELD = "\x1f"

# fixed values: the status of each error; whatever isn't listed is an internal one
STATUSES = {
    "UNSUPPORTED_FORMAT": 422, "UNSUPPORTED_LEGACY_HWP": 422, "FORMAT_MISMATCH": 422, "FILE_TOO_LARGE": 422, "MALFORMED_ARCHIVE": 422,
    "ENCRYPTED_DOCUMENT": 422, "MALFORMED_DOCUMENT": 422, "INVALID_REQUEST": 422, "INTEGRITY_MISMATCH": 409, "ANALYSIS_NOT_FOUND": 404, "INDEX_DENIED": 409,
    "STALE_BASELINE_VERSION": 409, "AUTHENTICATION_FAILED": 401, "SERVICE_NOT_CONFIGURED": 503, "WORKFLOW_CONFLICT": 409, "RISK_SERVICE_ERROR": 502,
}
INTERNAL, INTERNAL_MESSAGE = "INTERNAL_GATEWAY_ERROR", "the gateway could not complete the request safely"


def commits(log: DataFrame, line: str) -> DataFrame:
    """The rows of a log with sha, subject and committed_at in place of their line; lines without a name or with fewer fields
    are none. What follows the second separator is the time."""
    parts = F.split(F.col(line), FIELD, 3)
    kept = [c for c in log.columns if c != line]
    rows = log.withColumn("_parts", parts).where((F.size("_parts") == 3) & (F.col("_parts")[0] != ""))
    return rows.select(*kept, F.col("_parts")[0].alias("sha"), F.col("_parts")[1].alias("subject"), F.col("_parts")[2].alias("committed_at"))


def event_lines(events: DataFrame) -> DataFrame:
    """(value): each event as one line of JSON with sorted names; what is null says so. Over a stream, what a text sink takes."""
    return events.select(F.to_json(F.struct(*sorted(events.columns)), {"ignoreNullFields": "false"}).alias("value"))


def merged_location(location: Column, extra: Column) -> Column:
    """A location with further entries, which replace its own; entries without a value are none, and so is a location without
    an entry."""
    new = F.map_filter(F.coalesce(extra, F.create_map().cast("map<string,string>")), lambda _, v: v.isNotNull())
    own = F.map_filter(F.coalesce(location, F.create_map().cast("map<string,string>")), lambda k, _: ~F.map_contains_key(new, k))
    merged = F.map_concat(own, new)
    return F.when(F.size(merged) > 0, merged)


def envelope(errors: DataFrame) -> DataFrame:
    """errors(…, code, message, retryable) as answers that can never let anything be indexed."""
    codes = F.create_map(*[F.lit(x) for kv in STATUSES.items() for x in kv])
    known = F.coalesce(F.map_contains_key(codes, F.col("code")), F.lit(False))
    code, message = F.when(known, F.col("code")).otherwise(INTERNAL), F.when(known, F.col("message")).otherwise(INTERNAL_MESSAGE)
    finding = F.struct(code.alias("type"), message.alias("reason"))
    return errors.select(
        *[c for c in errors.columns if c not in ("code", "message", "retryable")],
        F.lit("FAILED").alias("analysis_status"),
        F.lit("BLOCK").alias("decision"),
        F.lit(None).cast("int").alias("risk_score"),
        F.lit("QUARANTINE").alias("index_action"),
        F.array(finding).alias("findings"),
        code.alias("code"),
        message.alias("message"),
        F.when(known, F.coalesce("retryable", F.lit(False))).otherwise(True).alias("retryable"),
        F.when(known, F.element_at(codes, F.col("code"))).otherwise(500).cast("int").alias("status"),
    )


def report(results: DataFrame) -> DataFrame:
    """One row: totals, rates and the mean time of results(category, expected, actual, elapsed_ms), and the same as JSON."""
    c, a = F.col("category"), F.col("actual")
    rate = lambda kind, want: F.round(F.try_divide(F.count_if((c == kind) & (a == want)), F.count_if(c == kind)), 4)
    out = results.agg(
        F.count("*").alias("total"),
        F.count_if(a == F.col("expected")).alias("passed"),
        rate("attack", "BLOCK").alias("attack_detection_rate"),
        rate("normal", "ALLOW").alias("normal_allow_rate"),
        F.coalesce(F.round(F.avg("elapsed_ms"), 3), F.lit(0.0)).alias("average_analysis_ms"),
    )
    return out.withColumn("report", F.to_json(F.struct(*out.columns), {"ignoreNullFields": "false"}))
