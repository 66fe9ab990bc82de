"""Connected components of an edge table, distributed: alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import runtime


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row.n, row.h


def components(edges: DataFrame) -> DataFrame:
    """(doc_id, component) for every node of ``edges(u, v)``; component is the least node that can be reached.

    Each round is two grouped minima with joins, written to the shared folder in place of the round before; the number of
    rounds grows with the logarithm of the longest chain. The driver sees a count and a checksum a round, never edges.
    """
    spark = edges.sparkSession
    edges, path = runtime.written(edges.where("u <> v").selectExpr("greatest(u, v) AS u", "least(u, v) AS v").distinct())
    state = _state(edges)
    while state[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        old = path
        edges, path = runtime.written(small.union(least.select("u", F.col("m").alias("v"))).distinct())
        before, state = state, _state(edges)
        runtime.forget(spark, old)
        if state == before:
            break
    roots = edges.select(F.col("v").alias("doc_id")).distinct()
    return edges.select(F.col("u").alias("doc_id"), F.col("v").alias("component")).union(roots.select("doc_id", F.col("doc_id").alias("component")))
