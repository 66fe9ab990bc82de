"""Chains of rows that name another one: what a row inherits, where its chain ends, and how long it is, by pointer doubling.

Each round joins the table with itself, so that every pointer jumps twice as far; the number of rounds grows with the
logarithm of the longest chain, whatever the number of rows. Rounds are written to the shared folder. The driver sees a
count a round: once it doesn't fall any more, what is still open runs in a circle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.sources import scratch


def chains(rows: DataFrame, keys: list[str], node: str, parent: str, *values: str) -> DataFrame:
    """(keys, node, root, steps, circle, values) of rows(keys, node, parent, values), each value being the nearest one that is
    set from the row on towards its root. A parent that isn't there ends the chain. Of a row that runs into a circle
    root, steps and values are null."""
    spark = rows.sparkSession
    there = rows.select(*keys, F.col(node).alias("_to"), F.lit(True).alias("_there"))
    own = rows.select(*keys, node, F.col(parent).alias("_to"), *values).join(there, [*keys, "_to"], "left")
    to = F.when(F.col("_there"), F.col("_to"))
    table, path = scratch.written(own.select(*keys, node, to.alias("_to"), F.when(to.isNull(), F.col(node)).alias("root"), to.isNotNull().cast("bigint").alias("steps"), *values))
    left = table.where("_to IS NOT NULL").count()
    while left:
        ahead = table.select(*keys, F.col(node).alias("_to"), F.col("_to").alias("_next"), F.col("root").alias("_root"), F.col("steps").alias("_steps"), *[F.col(v).alias(f"_{v}") for v in values])
        jumped = table.join(ahead, [*keys, "_to"], "left").select(
            *keys, node, F.col("_next").alias("_to"), F.coalesce("root", "_root").alias("root"), (F.col("steps") + F.coalesce("_steps", F.lit(0))).alias("steps"), *[F.coalesce(v, f"_{v}").alias(v) for v in values]
        )
        old = path
        table, path = scratch.written(jumped)
        scratch.forget(spark, old)
        before, left = left, table.where("_to IS NOT NULL").count()
        if left == before:
            break
    circle = F.col("_to").isNotNull()
    return table.select(*keys, node, "root", F.when(~circle, F.col("steps")).alias("steps"), circle.alias("circle"), *[F.when(~circle, F.col(v)).alias(v) for v in values])


def attempts(analyses: DataFrame) -> DataFrame:
    """(root, attempts, analysis_id, state, superseded) of analyses(analysis_id, supersedes, state): each chain of re-analyses by
    its first one, with the latest as its current one. All before it are superseded, whatever state they were left in."""
    found = chains(analyses, [], "analysis_id", "supersedes").where("NOT circle").join(analyses.select("analysis_id", "state"), "analysis_id")
    latest = F.max_by(F.struct("analysis_id", "state"), F.struct("steps", "analysis_id"))
    out = found.groupBy("root").agg((F.max("steps") + 1).alias("attempts"), latest.alias("l"), F.count("*").alias("n"))
    return out.select("root", "attempts", "l.analysis_id", "l.state", (F.col("n") - 1).alias("superseded"))
