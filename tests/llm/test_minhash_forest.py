"""MinHash near-dedup against brute force and SQL."""

from __future__ import annotations

import random
import re

import duckdb
import numpy as np
import pyarrow as pa

from lodestone.llm import minhash_forest, ngram_join
from lodestone.llm.text_arrays import mix

WORD = re.compile("[^\x20\x09-\x0d]+")


def shingles(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else set()


def brute(docs, threshold=85):
    sets = [(i, shingles(t)) for i, t in docs]
    root = {i: i for i, _ in docs}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            if i is not None and j is not None and x and 100 * len(x & y) >= threshold * len(x | y):
                u, v = find(i), find(j)
                root[max(u, v)] = min(u, v)
    return [(i, len(x), find(i), None if i is None else find(i) == i) for i, x in sets]


def changed(rng, text, share):
    w = text.split(" ")
    for k in rng.sample(range(len(w)), max(1, int(share * len(w)))):
        w[k] = "".join(rng.choice("abcdefg") for _ in range(5))
    return " ".join(w)


def words(rng, n):
    return " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 6))) for _ in range(n))


def key(row):
    return tuple((x is None, str(x)) for x in row)


def corpus():
    rng = random.Random(8)
    docs = [(i, words(rng, rng.randint(1, 150))) for i in range(150)]
    i = 200
    for text in [t for _, t in docs[:60]]:
        for _ in range(rng.randint(1, 4)):
            docs.append((i, changed(rng, text, rng.choice((0.005, 0.02, 0.045, 0.06)))))
            i += 1
    hot = words(rng, 120)
    docs += [(i + k, hot) for k in range(60)] + [(i + 100 + k, changed(rng, hot, 0.01)) for k in range(90)]
    # alike, but not enough: a region of many documents that don't link
    base = words(rng, 200)
    docs += [(i + 300 + k, changed(rng, base, 0.1)) for k in range(80)]
    docs += [(1, docs[40][1]), docs[7], docs[7], (None, hot), (None, None), (5000, None), (5001, ""), (5002, " \n\t"), (5003, "A b"), (5004, "a B"), (5005, "a"), (5006, words(rng, 30_000))]
    docs += [(5007, docs[-1][1] + " end")]
    rng.shuffle(docs)
    return docs


def test_minhash_dedup(spark, folder):
    docs = corpus()
    place = folder(docs)
    got = [tuple(r) for r in minhash_forest.query(spark, place).collect()]
    assert sorted(got, key=key) == sorted(brute(docs), key=key)
    assert minhash_forest.query(spark, folder([])).count() == 0
    unique = [d for d in {i: (i, t) for i, t in docs if i is not None}.values() if len(d[1] or "") < 50_000]
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder(unique)}/documents.parquet'")
        for sql, threshold in ((minhash_forest.SQL, 85), (minhash_forest.sql(ngram_join.THRESHOLD, ", doc_id = component_id AS kept"), 90)):
            assert sorted(con.execute(sql).fetchall()) == sorted(brute(unique, threshold))


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 1 << 63, 1000).astype(np.uint64)
    b = np.r_[a[:900], rng.integers(0, 1 << 63, 100).astype(np.uint64)]
    value = np.concatenate([np.sort(a), np.sort(b)])
    sign = minhash_forest.signatures(value, np.array([0, 1000, 1000, 2000]))
    assert not sign[1].any() and abs((sign[0] == sign[2]).mean() - 900 / 1100) < 0.15
    assert (sign[0] == [((mix(a) * m + n) >> np.uint64(32)).min() for m, n in zip(minhash_forest.MULTIPLY, minhash_forest.ADD, strict=True)]).all()


def test_depth_adapts_to_the_region():
    least, deep, region = minhash_forest.LEAST_DEPTH, minhash_forest.DEPTH, minhash_forest.REGION
    sparse = np.full(region - 1, least)
    dense = np.full(3 * region, least)
    dense[10], dense[20:24] = deep, least + 1
    depth = np.r_[0, sparse, least - 1, dense, 0]
    got = minhash_forest.linked_neighbours(depth)
    begin = len(sparse) + 2
    assert set(np.flatnonzero(got).tolist()) == {*range(1, len(sparse) + 1), begin + 10, *range(begin + 20, begin + 24)}


def test_candidates_over_partition_borders(spark, monkeypatch):
    """Each row in a partition of its own: regions are joined by their borders alone."""
    monkeypatch.setattr(minhash_forest, "PARTITION_BYTES", 64)
    rng = np.random.default_rng(3)
    sign = np.repeat(rng.integers(0, 1 << 32, (4, minhash_forest.ORDERS * minhash_forest.DEPTH)), 3, axis=0).astype(">u4")
    rows = pa.table({"doc_id": pa.array(range(12), pa.int64()), "signature": pa.array([s.tobytes() for s in sign], pa.binary())})
    edges, _ = minhash_forest.candidates(spark.createDataFrame(rows))
    got = {frozenset(r) for r in edges.distinct().collect()}
    assert all(len({x // 3 for x in pair}) == 1 for pair in got)
    assert {x for pair in got for x in pair} == set(range(12)) and len(got) >= 8


def test_texts_without_candidates_are_not_shuffled(spark, monkeypatch):
    """The exact step joins texts of candidates only, and such few others as its filter lets through."""
    from lodestone.llm import ngram_join

    rows = [(i, " ".join(f"w{i}x{k}" for k in range(40))) for i in range(1000)] + [(5000 + i, " ".join(f"v{k}" for k in range(60 + i % 2))) for i in range(6)]
    seen = []

    def noted(docs, ids, held=ngram_join.holding):
        seen.append(held(docs, ids))
        return seen[-1]

    monkeypatch.setattr(ngram_join, "holding", noted)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in minhash_forest.join(docs).collect()}
    assert got == {i: min(i, 5000) for i, _ in rows}
    assert len(seen) == 1
    ids = {r.doc_id for r in seen[0].collect()}
    assert {5000, 5001} <= ids and len(ids) < 100
