"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontaminate, html_extract, impact_search, minhash_forest, ngram_join, piece_counts, quality, secrets, spelling, suffix_dedup, topk, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scan": secrets.query,
    "op2_html_extract": html_extract.query,
    "op3_suffix_dedup": suffix_dedup.query,
    "op4_decontaminate": decontaminate.query,
    "op5_bpe": bpe.query,
    "op6_quality": quality.query,
    "op7_topk": topk.query,
    "op8_toxicity": toxicity.query,
    "op9_token_counts": piece_counts.query,
    "op10_ngram_join": ngram_join.query,
    "op11_ranked_search": impact_search.query,
    "op12_spelling": spelling.query,
    "op13_minhash_dedup": minhash_forest.query,
}

ORACLE_SQL: dict[str, str] = {
    "op7_topk": topk.SQL,
    "op10_ngram_join": minhash_forest.sql(ngram_join.THRESHOLD),
    "op11_ranked_search": impact_search.SQL,
    "op12_spelling": spelling.SQL,
    "op13_minhash_dedup": minhash_forest.SQL,
}
