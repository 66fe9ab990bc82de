"""The registered queries of the gateway's operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.plans import corpus, gateway, integrity, review
from lodestone.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "corpus", "entry", "gateway", "integrity", "review"]


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship query: the verdict table."""
    return integrity.verdicts(spark, sf_dir)
