"""Results that come later than what asked for them, joined by name and content.

A request (id, digest, asked_at) asks for the analysis of one content of an item; a result (id, digest, answered_at, ok) names
the content that it is of. A result counts only for the request of that very content, and only within ``wait`` seconds;
what a later edit has made of the item asks anew under another digest, so a late or stale result changes nothing. Within
the first ``RETRY`` seconds a failed try may be followed by one that succeeds; the first sound result counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WAIT, RETRY = 60, 3


def answered(requests: DataFrame, results: DataFrame, wait: int = WAIT, late: str = "0 seconds") -> DataFrame:
    """(id, digest, asked_at, answered_at, ok) of each request and each result that counts for it; with nulls where none does.
    The same join over tables and over streams: there the watermarks, ``late`` behind what is newest, tell when a
    request gets no result any more."""
    asked = requests.select("id", "digest", "asked_at").withWatermark("asked_at", late).alias("q")
    told = results.select(F.col("id").alias("of"), F.col("digest").alias("content"), "answered_at", "ok").withWatermark("answered_at", late).alias("r")
    within = F.expr(f"answered_at >= asked_at AND answered_at <= asked_at + INTERVAL {int(wait)} SECONDS")
    return asked.join(told, (F.col("id") == F.col("of")) & (F.col("digest") == F.col("content")) & within, "leftOuter").select("id", "digest", "asked_at", "answered_at", "ok")


def settled(rows: DataFrame) -> DataFrame:
    """(id, digest, asked_at, outcome, answered_at) of ``answered`` rows: READY by the first sound result, unless a failure came
    more than ``RETRY`` seconds before it; FAILED by the last failure that counts; UNAVAILABLE without any."""
    first = lambda c: F.min(F.when(c, F.col("answered_at")))
    by = rows.groupBy("id", "digest", "asked_at").agg(first(F.col("ok")).alias("good"), first(~F.col("ok")).alias("bad"))
    given_up = F.col("bad") + F.expr(f"INTERVAL {RETRY} SECONDS")
    ready = F.col("good").isNotNull() & (F.col("bad").isNull() | (F.col("good") <= given_up))
    outcome = F.when(ready, "READY").when(F.col("bad").isNotNull(), "FAILED").otherwise("UNAVAILABLE")
    return by.select("id", "digest", "asked_at", outcome.alias("outcome"), F.when(ready, F.col("good")).otherwise(F.col("bad")).alias("answered_at"))
