"""The inverted index against brute force."""

from __future__ import annotations

import random
import re

import pytest

from lodestone.operators import index, inverted


def brute(chunks, queries, k):
    out = []
    for i, q in queries:
        if not q or not q.strip():
            continue
        q = q.casefold()
        terms = list(dict.fromkeys(re.findall(r"\w+", q)))
        scores = [(-(3 * t.casefold().count(q) + sum(t.casefold().count(x) for x in terms)), d, n) for d, n, t in chunks if t]
        out += [(i, r, d, n, -s) for r, (s, d, n) in enumerate(sorted(x for x in scores if x[0] < 0)[:k], 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def chunks():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdé_1") for _ in range(rng.choice((1, 2, 2, 3, 5))))
    rows = [(d, n, " ".join(rng.choice((word(), word().upper(), "the other theory", "a.b", "??", "Straße")) for _ in range(rng.randint(0, 25)))) for d in range(60) for n in range(3)]
    return [*rows, (70, 0, None), (71, 0, ""), (72, 0, "zz " * 3000), (73, 0, "aaaa aa"), (73, 1, "aaaa aa")]


QUERIES = [(1, "the"), (2, "THE other"), (3, "a"), (4, "aa"), (5, "??"), (6, "  "), (7, None), (8, "nothing like it"), (9, "a.b a"), (10, "STRASSE the"), (11, "zz zz"), (12, "aaaa aa"), (12, "b"), (13, "é_ 1"), (14, "."), (15, "theory the theory")]


@pytest.mark.parametrize("size", [4096, 16, 2])
def test_search_is_brute_force(spark, chunks, size):
    rows = spark.createDataFrame(chunks, "doc_id long, chunk_index int, chunk string").repartition(3)
    asked = spark.createDataFrame(QUERIES, "query_id long, query string")
    built = inverted.build(rows, size)
    for k in (1, 3) if size == 16 else (3,):
        got = sorted(tuple(r) for r in inverted.search(built, asked, k).collect())
        assert got == brute(chunks, QUERIES, k)
        scanned = index.search(rows, asked.where("query_id <> 12"), k).collect()
        assert [r for r in got if r[0] != 12] == sorted((r.query_id, r.rank, r.doc_id, r.chunk_index, r.score) for r in scanned)
    built.forget()


def test_passes_and_empty_tables(spark, chunks, monkeypatch):
    monkeypatch.setattr(inverted, "MOST_WORDS", 3)
    rows = spark.createDataFrame(chunks[:60], "doc_id long, chunk_index int, chunk string")
    asked = spark.createDataFrame(QUERIES, "query_id long, query string")
    assert len(list(inverted.passes(asked))) > 3
    assert sorted(tuple(r) for r in inverted.search_once(rows, asked, 2).collect()) == brute(chunks[:60], QUERIES, 2)
    assert inverted.search_once(rows.limit(0), asked).count() == 0
    assert inverted.search_once(rows, asked.limit(0)).count() == 0


def test_only_the_buckets_of_its_tokens_are_read(spark, chunks):
    built = inverted.build(spark.createDataFrame(chunks, "doc_id long, chunk_index int, chunk string"), 64)
    folders = {r.bucket for r in built.postings.select("bucket").distinct().collect()}
    asked = {r.bucket for r in built.postings.where("contains(token, 'theory')").select("bucket").distinct().collect()}
    assert len(asked) == 1 and len(folders) > 15
    plan = built.postings.where(f"bucket IN ({min(asked)})")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
