"""Spelling variants against brute force and SQL."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from lodestone.llm import spelling

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(docs, noise=199):
    n = Counter()
    for i, t in docs:
        for run in RUN.findall(lower(t or "")) if i is not None else []:
            h = zlib.crc32(f"{i}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % noise == 0 else run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}
    form, count = {}, {}
    for w, c in n.items():
        near = [(-k, v) for v, k in n.items() if one_edit(v, w)]
        count[w] = len(near)
        form[w] = min(near)[1] if near and -min(near)[0] >= 5 * c else None
    out = []
    for w, c in n.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, c, count[w], n.get(form[w])))
    return sorted(out)


@pytest.fixture
def docs():
    rng = random.Random(4)
    stems = ["".join(rng.choice("abcéÿ×") for _ in range(rng.randint(6, 9))) for _ in range(25)]
    chain = ["zzzzzz" + "y" * i for i in range(4)]  # each so much more frequent than the next
    rows = []
    for i in range(600):
        found = []
        for _ in range(rng.randint(0, 30)):
            w = rng.choice(stems)
            at = rng.randrange(len(w))
            found.append(rng.choice((w, w, w.upper(), w[:at] + w[at + 1 :], w[:at] + rng.choice("abé") + w[at:], w[:at] + rng.choice("abé") + w[at + 1 :])))
        rows.append((i, " ".join(found)))
    rows += [(-i, f"{chain[k]}, " * 5) for k, times in enumerate((125, 25, 5, 1)) for i in range(times)]
    long = "é" * 30_000 + "ab" * 20_000
    rows += [(700, None), (701, ""), (702, "Àé-Àé"), (None, stems[0]), (703, f"{long} " * 5 + f"{long}c " * 25), *rows[:20]]
    rng.shuffle(rows)
    return rows


def test_spelling_variants(spark, folder, docs):
    place = folder(docs)
    got = sorted((tuple(r) for r in spelling.query(spark, place).collect()), key=lambda r: r[0])
    want = brute(docs)
    assert got == want
    assert any(r[1] != r[2] and r[1] for r in got) and any(r[0][:1] == "\xe9" and r[1] for r in got)
    assert spelling.query(spark, folder([])).count() == 0
    assert spelling.query(spark, folder([(1, None), (None, "abcdef " * 9)])).count() == 0
    # DuckDB's distance is quadratic in the length of a word
    place = folder([r for r in docs if len(r[1] or "") < 10_000])
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{place}/documents.parquet'")
        assert sorted(con.execute(spelling.SQL).fetchall(), key=lambda r: r[0]) == [r for r in want if len(r[0]) < 10_000]


def test_deletion_prints_tell_deletions():
    words = ["aabbbc", "abbbc", "aabbb", "xéxéxé", "a" * 70_000, "a" * 69_999]
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    key, row = spelling.deletion_prints(points, np.cumsum([0, *map(len, words)]))
    assert len(key) == len(words) + 3 + 3 + 2 + 6 + 1 + 1
    of = [set(key[row == i].tolist()) for i in range(len(words))]
    for i, a in enumerate(words[:4]):
        cuts = {a, *(a[:k] + a[k + 1 :] for k in range(len(a)))}
        assert len(of[i]) == len(cuts)
        for j, b in enumerate(words[:4]):
            assert len(of[i] & of[j]) == len(cuts & {b, *(b[:k] + b[k + 1 :] for k in range(len(b)))})
    assert key[4] in of[4] and len(of[4] & of[5]) == 1


def test_crc32_by_steps():
    rng = np.random.default_rng(6)
    data = rng.integers(0, 256, 5000).astype(np.uint8)
    start = rng.integers(0, 4000, 300)
    end = start + rng.integers(0, 100, 300)
    seed = np.array([zlib.crc32(b"%d:" % i) for i in range(300)], np.uint32)
    assert spelling.crc32(seed, data, start, end).tolist() == [zlib.crc32(b"%d:" % i + data[a:b].tobytes()) for i, (a, b) in enumerate(zip(start, end, strict=True))]


def test_pairs_whose_prints_collide(spark):
    rows = [("abcdef", 5, 1), ("abcdeg", 30, 1), ("abcdefg", 30, 1), ("uvwxyz", 9, 2)]
    got = spelling.near(spark.createDataFrame(rows, "word string, n bigint, id bigint"))
    assert sorted(map(tuple, got.collect())) == sorted([(a, b, n, m) for a, n, _ in rows for b, m, _ in rows if one_edit(a, b)])
