"""Ranked search against brute force and SQL."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from lodestone.llm import impact_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def brute(docs, items, k=20):
    held = [(i, Counter(TERM.findall(lower(t)))) for i, t in docs if i is not None and t]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    count, total = len(held), sum(n for *_, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    asked = {}
    for i, t in items:
        if i is not None and t is not None:
            asked[i] = min(asked.get(i, t), t)
    out = []
    for i, t in asked.items():
        scores = []
        for d, c, n in held:
            m = 75 + 25 * n * count // total
            s = sum(math.floor(1000 * math.log((2 * count + 2) / (2 * df[x] + 1))) * (10**9 * c[x] // (1000 * c[x] + 12 * m)) for x in TERM.findall(lower(t)) if x in c)
            if s > 0:
                scores.append((-s, d))
        out += [(i, r, d, -s) for r, (s, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


def words(rng, n):
    return " ".join(rng.choice("äbcé")+"".join(rng.choice("abÉZ1") for _ in range(rng.choice((0, 1, 1, 1, 2)))) for _ in range(n))


@pytest.fixture
def tables():
    rng = random.Random(3)
    docs = [(i, words(rng, rng.randint(1, 60))) for i in range(300)]
    docs += [(i + 1000, docs[i][1]) for i in range(60)] + docs[:5]
    docs += [(900, None), (901, ""), (902, " .,;\n"), (None, docs[0][1]), (903, "a" * 3000), (904, words(rng, 4000) + " x" * 500)]
    rng.shuffle(docs)
    items = [(i, words(rng, rng.randint(1, 12))) for i in range(40)] + [(50, "ab AB ab aB"), (51, "nothinglikeit"), (52, None), (53, ""), (None, "ab"), (54, "ab b1"), (54, "ab"), (55, docs[7][1] or "ab")]
    return docs, items


def benchmark(items):
    return pa.table({"item_id": pa.array([i for i, _ in items], pa.int64()), "text": pa.array([t for _, t in items], pa.string()), "doc_id": pa.array([7] * len(items), pa.int64())})


def test_ranked_search(spark, folder, tables):
    docs, items = tables
    place = folder(docs, benchmark=benchmark(items))
    got = sorted(tuple(r) for r in impact_search.query(spark, place).collect())
    assert got == brute(docs, items)
    with duckdb.connect() as con:
        for name in ("documents", "benchmark"):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{place}/{name}.parquet'")
        assert sorted(con.execute(impact_search.SQL).fetchall()) == got


def test_small_segments_blocks_and_tables(spark, folder, tables, monkeypatch):
    docs, items = tables
    place = folder(docs, benchmark=benchmark(items))
    frame, asked = spark.read.parquet(f"{place}/documents.parquet"), spark.read.parquet(f"{place}/benchmark.parquet")
    with monkeypatch.context() as m:
        m.setattr(impact_search, "SEGMENT_BYTES", 700)
        ids, texts = [pa.array(c, t) for c, t in zip(zip(*docs, strict=True), (pa.int64(), pa.string()), strict=True)]
        rows = list(impact_search._segments(iter(pa.record_batch([ids, texts], ["doc_id", "text"]).slice(a, 90) for a in range(0, len(docs), 90))))
        assert len(rows) > 20
    index = spark.createDataFrame(pa.Table.from_batches(rows)).repartition(5)
    # few terms a block: several blocks, of which each reads the index once
    got = impact_search.answer(index, asked, k=4, vocabulary=9)
    assert sorted(tuple(r) for r in got.collect()) == brute(docs, items, 4)
    assert impact_search.search(frame.limit(0), asked).count() == 0
    assert impact_search.search(frame, asked.limit(0)).count() == 0
    assert impact_search.search(frame.where("doc_id IN (900, 901, 902)"), asked).count() == 0


def test_a_long_text_is_counted_in_parts(monkeypatch):
    rng = random.Random(5)
    texts = [words(rng, 3), words(rng, 900), "", words(rng, 1), "b" * 2000 + " c"]
    monkeypatch.setattr(impact_search, "SEGMENT_BYTES", 256)
    data = [t.encode() for t in texts]
    names, term, row, n = impact_search._counted(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]))
    got = {(names[t].as_py().decode(), r): c for t, r, c in zip(term.tolist(), row.tolist(), n.tolist(), strict=True)}
    assert got == {(w, r): c for r, t in enumerate(texts) for w, c in Counter(TERM.findall(lower(t))).items()}
    assert len(set(names.to_pylist())) == len(names)


def test_threshold_search_stops_early():
    """One document stands out in both lists: not all of them are read."""
    n = 5000
    rng = np.random.default_rng(1)
    forward = rng.integers(1, 1000, (n, 2))
    forward[17] = 5000, 5000
    weights, ids = np.array([3, 2]), np.arange(n)[::-1].copy()
    docs = [np.argsort(-forward[:, i], kind="stable") for i in (0, 1)]
    impacts = [forward[d, i] * weights[i] for i, d in enumerate(docs)]
    seen = np.zeros(n, bool)
    best = impact_search.Best(3)
    looked = impact_search.threshold_search(best, docs, impacts, forward, weights, ids, seen)
    score = forward @ weights
    assert list(zip((-best.score).tolist(), best.ids.tolist(), strict=True)) == sorted(zip((-score).tolist(), ids.tolist(), strict=True))[:3]
    assert looked < n / 2 and not seen.any()
    # a later segment whose best possible score is below the third one isn't read at all
    assert impact_search.threshold_search(best, docs, [i // 100 for i in impacts], forward, weights, ids, seen) == 0


def test_lengths_beyond_a_long():
    n = np.array([10**9, 5])
    assert impact_search.lengths(n, 10**11, 10**14).tolist() == [75 + 25 * int(x) * 10**11 // 10**14 for x in n]
