"""Operators over pairs of documents, and search: suffix dedup, n-gram join, decontamination, top-k, components."""

from __future__ import annotations

import hashlib
import random
import re
import tracemalloc
from collections import defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from lodestone.llm import components, decontaminate, ngram_join, suffix_dedup, topk


def words(rng, n):
    return " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(n))


def removed(docs):
    """By brute force: (n_bytes, n_removed, n_spans, kept digest) of each row."""
    least = {}
    for i, t in docs:
        b = (t or "").encode()
        if i is not None:
            for p in range(len(b) - 49):
                least[b[p : p + 50]] = min(i, least.get(b[p : p + 50], i))
    out = []
    for i, t in docs:
        b = (t or "").encode()
        gone = bytearray(len(b))
        if i is not None:
            for p in range(len(b) - 49):
                if least[b[p : p + 50]] < i:
                    gone[p : p + 50] = b"\1" * 50
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out.append((i, len(b), sum(gone), len([x for x in bytes(gone).split(b"\0") if x]), hashlib.sha256(kept).hexdigest()))
    return out


def key(row):
    return tuple((x is None, str(x)) for x in row)


def test_suffix_dedup(spark, folder):
    rng = random.Random(1)
    shared = [words(rng, 30) for _ in range(4)]
    docs = []
    for i in range(120):
        parts = [words(rng, rng.randint(0, 30)) for _ in range(3)]
        for _ in range(rng.randint(0, 2)):
            s = rng.choice(shared)
            a = rng.randint(0, 40)
            parts.insert(rng.randint(0, 3), s[a : a + rng.randint(40, 160)])
        docs.append((rng.randint(0, 500), " ".join(parts)))
    docs += [(900, "x" * 300), (901, "x" * 49), (902, "x" * 51), (903, "ab" * 100), (904, None), (905, ""), (None, shared[0]), (None, shared[0]), docs[3], docs[3], (906, docs[3][1] + "z"), (907, words(rng, 30_000) + shared[1])]
    rng.shuffle(docs)
    got = [tuple(r) for r in suffix_dedup.query(spark, folder(docs)).collect()]
    assert sorted(got, key=key) == sorted(removed(docs), key=key)
    assert suffix_dedup.query(spark, folder([])).count() == 0


def test_index_family_scans_batches_and_merges_by_size():
    family, rng = suffix_dedup.IndexFamily(), np.random.default_rng(2)
    seen, numbers = {}, {}
    for i in range(40):
        strings = rng.integers(97, 99, (int(rng.integers(1, 60)), 50)).astype(np.uint8)
        strings[:, 9:] = 97  # few enough distinct ones that batches meet
        strings[0, 0] = 0
        keys, owners = strings.reshape(-1).view("S50"), rng.integers(0, 100, len(strings))
        got = family.scan(keys, owners)
        for k, o, n in zip(map(bytes, strings), owners.tolist(), got.tolist(), strict=True):
            assert numbers.setdefault(k, n) == n
            seen[k] = min(seen.get(k, o), o)
        sizes = [len(level) for level, _ in family.levels]
        assert all(a >= 2 * b for a, b in zip(sizes, sizes[1:]))
        assert all((level[1:] > level[:-1]).all() for level, _ in family.levels)
    assert len(set(numbers.values())) == len(numbers) == sum(len(level) for level, _ in family.levels)
    assert {k: family.least[n] for k, n in numbers.items()} == seen


def test_batches_of_a_bucket(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BATCH_BYTES", 400)
    monkeypatch.setattr(suffix_dedup, "SLICE", 7)
    rng = np.random.default_rng(8)
    base = rng.integers(97, 123, 80).astype(np.uint8).tobytes()
    own, sent = suffix_dedup.Batches(), []
    for number in range(60):
        rows = []
        for j in range(int(rng.integers(1, 4))):
            count = int(rng.integers(1, 31))
            at = int(rng.integers(0, 32 - count))
            text = bytearray(base[at : at + count + 49])
            if rng.random() < 0.5:
                text[int(rng.integers(len(text)))] = 65
            rows.append((100 * j, count, int(rng.integers(0, 30)), bytes(text)))
        start, count, owner, text = zip(*rows, strict=True)
        own.add(number, suffix_dedup.squeeze(np.array(start, np.uint32), np.array(count, np.uint8), np.array(owner, np.int64), np.frombuffer(b"".join(text), np.uint8)))
        sent.append(rows)
    least = {}
    for rows in sent:
        for _, count, owner, text in rows:
            for i in range(count):
                least[text[i : i + 50]] = min(owner, least.get(text[i : i + 50], owner))
    got = {}
    for number, body in own.covered():
        first, count = suffix_dedup.spread(body, "u4", "u4")
        got[number] = {p for a, n in zip(first.tolist(), count.tolist(), strict=True) for p in range(a, a + n)}
    want = {number: {a + i for a, count, owner, text in rows for i in range(count) if least[text[i : i + 50]] < owner} for number, rows in enumerate(sent)}
    assert got == {k: v for k, v in want.items() if v} and len(own.done) > 5 and len(own.family.levels) > 1


def test_suffix_dedup_of_rows_without_files(spark):
    text = "the quick brown fox jumps over the lazy dog and runs far away"
    rows = [(2, text), (1, "a " + text), (3, "nothing of the kind")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: len(r.spans) for r in suffix_dedup.dedup(df.join(df.select("doc_id"), "doc_id")).collect()}
    assert got == {1: 0, 2: 1, 3: 0}


def joined(docs):
    """By brute force: n_shingles and component of each row."""
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, t in docs:
        w = re.findall("[^\x20\x09-\x0d]+", (t or "").translate(low))
        sets.append({tuple(w[j : j + 3]) for j in range(len(w) - 2)} if len(w) >= 3 else {tuple(w)} if w else set())
    parent = {i: i for i, _ in docs if i is not None}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in range(len(docs)):
        for b in range(a):
            i, j = docs[a][0], docs[b][0]
            if i is not None and j is not None and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b]):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return [(i, len(s), None if i is None else find(i)) for (i, _), s in zip(docs, sets, strict=True)]


def near_copies(rng, base, n, edits):
    out = []
    for _ in range(n):
        w = base.split()
        for _ in range(edits):
            w[rng.randrange(len(w))] = words(rng, 1)
        out.append(" ".join(w))
    return out


def test_ngram_join(spark, folder):
    rng = random.Random(4)
    docs = [(i, words(rng, rng.randint(0, 40))) for i in range(60)]
    for k, n in enumerate((8, 12, 30, 120)):
        base = words(rng, n)
        docs += [(1000 * k + 100 + j, t) for j, t in enumerate([base, base.upper(), *near_copies(rng, base, 12, 1), *near_copies(rng, base, 6, max(1, n // 40))])]
    long = words(rng, 6000)
    docs += [(9000, long), (8999, long + " tail"), (9001, None), (9002, " \n\t"), (9003, "Aé b"), (9004, "aé B"), (None, "aé b"), (None, None), docs[0], docs[70]]
    rng.shuffle(docs)
    got = [tuple(r) for r in ngram_join.query(spark, folder(docs)).collect()]
    assert sorted(got, key=key) == sorted(joined(docs), key=key)
    assert ngram_join.query(spark, folder([])).count() == 0


def test_signature_tree_finds_every_link():
    rng = np.random.default_rng(6)
    base = [np.sort(rng.choice(1 << 62, 120, replace=False).astype(np.uint64)) for _ in range(8)]
    sets = []
    for b in base:
        for _ in range(25):
            s = b.copy()
            s[rng.choice(120, int(rng.integers(0, 9)), replace=False)] = rng.integers(0, 1 << 62, 1).astype(np.uint64)
            sets.append(np.unique(s))
    rng.shuffle(sets)
    sets += [sets[0][:0], sets[3][:1]]

    def brute(pairs):
        label = np.arange(len(sets))
        for i, j in pairs:
            if len(sets[i]) and len(sets[j]) and ngram_join.similar(sets[i], sets[j], 90):
                label = ngram_join.connect(label, np.array([i]), np.array([j]))
        return label.tolist()

    n = len(sets)
    value, starts = np.concatenate(sets), np.cumsum([0, *map(len, sets)])
    one, two = np.full(n, -1), (np.arange(n) >= 90).astype(int)
    assert ngram_join.linked(value, starts, one, np.arange(n), 90).tolist() == brute((i, j) for i in range(n) for j in range(i))
    across = ngram_join.linked(value, starts, two, np.arange(n), 90)
    want = brute((i, j) for i in range(n) for j in range(i) if two[i] != two[j])
    everything = brute((i, j) for i in range(n) for j in range(i))
    # what links across is found; sets of a side may be joined besides, but only where they link
    for i in range(n):
        assert across[i] <= want[i] and everything[across[i]] == everything[i]


@pytest.mark.parametrize("threshold", [90, 80])
def test_candidates_hold_every_link(threshold):
    rng = np.random.default_rng(threshold)
    weight = rng.integers(0, 5, ngram_join.CELLS).astype(np.uint8)
    sets, docs = [], []
    for n in (4, 5, 9, 10, 19, 57, 300, 319, 322, 330, 640, 700):
        base = rng.integers(0, 1 << 63, n).astype(np.uint64)
        for _ in range(12):
            s = base.copy()
            s[rng.choice(n, int(rng.integers(0, n // 8 + 1)), replace=False)] = rng.integers(0, 1 << 63, 1).astype(np.uint64)
            sets.append(np.unique(np.r_[s, rng.integers(0, 1 << 63, int(rng.integers(0, n // 8 + 2))).astype(np.uint64)]))
            docs.append(len(docs) * 3 + 1)
    value, count = np.concatenate(sets), np.array([len(s) for s in sets])
    row = np.repeat(np.arange(len(sets)), count)
    words = ngram_join.words_of(count, threshold)
    bits = ngram_join.flat_bitmaps(value, row, words)
    begins = np.cumsum(words) - words
    first, at, rest = ngram_join.first_shingles(value, row, count, weight, threshold)
    body = lambda own: ngram_join.squeeze(np.array(docs)[own], count[own], bits[ngram_join.ranges(begins[own], words[own])], first[np.isin(at, own)], (at[np.isin(at, own)] - own[0]).astype(np.uint32), rest[np.isin(at, own)].astype(np.uint32))
    u, v = ngram_join._candidates([body(np.arange(0, 40)), body(np.arange(40, len(sets)))], threshold)
    label = ngram_join.connect(np.arange(3 * len(sets) + 1), u, v)
    links = 0
    for i in range(len(sets)):
        for j in range(i):
            if ngram_join.similar(sets[i], sets[j], threshold):
                links += 1
                assert label[docs[i]] == label[docs[j]]
    assert links > 30 and len(np.unique(label[docs])) > 3


def test_ngram_join_of_large_components_hot_shingles_and_rows_without_files(spark, monkeypatch):
    """Chunks, pivots, what stays apart of them, and shingles that many have, at limits small enough to be met."""
    rng = random.Random(12)
    base = words(rng, 60)
    docs = [(i, t) for i, t in enumerate(near_copies(rng, base, 40, 1))]
    far = " ".join(base.split()[:30]) + " " + words(rng, 30)
    docs += [(100 + i, t) for i, t in enumerate(near_copies(rng, far, 6, 1))] + [(200, thue := "".join("ab"[bin(i).count("1") & 1] for i in range(1024)) + " x y z"), (201, thue.translate(str.maketrans("ab", "ba")))]
    docs = [(i, t.translate(str.maketrans({})) if i != 201 else t.rsplit(" ", 3)[0] + " x y z") for i, t in docs]
    for name, value in (("CHUNK", 400), ("PIVOTS", 3), ("HOT", 8)):
        monkeypatch.setattr(ngram_join, name, value)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = [tuple(r) for r in ngram_join.join(df).collect()]
    assert sorted(got) == sorted(joined(docs))


def test_representatives_keep_columns_of_clashing_names(spark):
    rows = [(1, "a b c d", "x"), (1, "a b c d", "y"), (2, "A b c d", "z"), (3, None, "w"), (None, "a b c d", "n")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _text string")
    got = ngram_join.representatives(df)
    assert got.columns == df.columns
    kept = sorted((tuple(r) for r in got.collect()), key=str)
    assert [r[0] for r in kept] == [1, 3, None] and {r[2] for r in kept} <= {"x", "y", "w", "n"}


def test_components(spark):
    rng = random.Random(8)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(40)]
    parent = list(range(200))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.doc_id: r.component for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: find(i) for i in {x for a, b in edges if a != b for x in (a, b)}}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def embeddings(rows):
    return pa.table({"vec_id": pa.array([r[0] for r in rows], pa.int64()), "embedding": pa.array([r[1] for r in rows], pa.list_(pa.float32())), "label": pa.array([1] * len(rows), pa.int32()), "score": pa.array(["x"] * len(rows))})


def test_topk(spark, folder):
    rng = random.Random(2)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(6)]) for i in range(230)]
    rows += [(300 + i, rows[0][1]) for i in range(20)]  # ties
    rows += [(400, None), (450, [1.0, None, 0, 0, 0, 0]), (500, [float("nan")] * 6), (550, [float("inf")] + [0.0] * 5), (600, [0.5, 0.5]), (601, [0.25, 0.5]), (650, []), (None, rows[1][1]), (700, [0.0] * 6)]
    path = folder(embeddings=embeddings(rows))
    got = sorted(tuple(r) for r in topk.query(spark, path).select("query_id", "rank", "vec_id", "score").collect())
    duckdb.sql(f"CREATE OR REPLACE VIEW embeddings AS SELECT * FROM '{path}/embeddings.parquet'")
    assert got == sorted(duckdb.sql(topk.SQL).fetchall())
    assert topk.query(spark, folder(embeddings=embeddings([]))).count() == 0
    # queries without any candidate of their length, and none that can take part
    assert topk.query(spark, folder(embeddings=embeddings([(50, [1.0]), (51, [1.0, 2.0]), (100, None)]))).count() == 0


def test_topk_counts_all_scores_in_blocks(spark, monkeypatch):
    """Histograms of a few bins over blocks of a few queries give the same ranks, and count every score of a range."""
    rng = random.Random(5)
    rows = [(i, [rng.choice([-1.0, 0.25, 0.5, 1.0]) for _ in range(4)]) for i in range(300)]
    for name, value in (("BLOCK", 2), ("BINS", 4), ("ROWS", 3)):
        monkeypatch.setattr(topk, name, value)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = sorted(tuple(r) for r in topk.search(df, df.vec_id % 50 == 0).collect())
    v = {i: [int(np.floor(256 * x)) for x in e] for i, e in rows}
    want = []
    for q in range(0, 300, 50):
        best = sorted((-sum(a * b for a, b in zip(v[q], v[i], strict=True)), i) for i in v if i != q)[:5]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert got == sorted(want)


def test_topk_sends_only_what_can_be_among_the_best(spark):
    """The histograms must find each kth score: else the last pass would send every pair and the ranks still be right."""
    rng = random.Random(9)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(6)]) for i in range(600)]
    vectors = topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3), "vec_id", "embedding").cache()
    sent = topk._block_result(vectors, vectors.where("vec_id % 50 = 0"), 5, 300)
    most = sent.groupBy("query_id").count().agg({"count": "max"}).first()[0]
    assert 5 <= most <= 4 + 5 * 3


def test_decontamination(spark, folder):
    rng = random.Random(12)
    items = [(i, words(rng, rng.randint(16, 50)) + ". " + words(rng, 6)) for i in range(12)]
    docs = [(i, words(rng, rng.randint(1, 200))) for i in range(60)]
    leaked = {}
    for k, (i, t) in enumerate(items):
        w = t.split()
        if k % 3 == 1:  # a paraphrase: a few words replaced
            for _ in range(len(w) // 10):
                w[rng.randrange(len(w))] = words(rng, 1)
        leaked[100 + k] = i
        docs.append((100 + k, words(rng, 40) + " " + " ".join(w) + " " + words(rng, 40)))
    docs += [(200, None), (201, ""), (100, docs[60][1]), (None, items[0][1])]
    table = pa.table({"item_id": pa.array([i for i, _ in items] + [99, None, 98], pa.int64()), "text": pa.array([t for _, t in items] + [None, "lost words here", ""], pa.string())})
    path = folder(docs, benchmark=table)
    got = [(r.doc_id, r.item_id) for r in decontaminate.query(spark, path).collect()]
    assert sorted(got, key=key) == sorted([*leaked.items(), (100, 0), (None, 0)], key=key)
    assert decontaminate.query(spark, folder([], benchmark=table)).count() == 0
    assert decontaminate.query(spark, folder(docs, benchmark=table.slice(0, 0))).count() == 0


def test_common_subsequence():
    rng = random.Random(3)
    for _ in range(50):
        a, b = ([rng.randrange(6) for _ in range(rng.randint(1, 30))] for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            diagonal = 0
            for j, y in enumerate(b):
                diagonal, row[j + 1] = row[j + 1], diagonal + 1 if x == y else max(row[j], row[j + 1])
        assert decontaminate.common_subsequence(a, b) == row[-1]


def test_decontamination_finds_what_common_allows_at_every_length(spark, folder):
    """Copies, and items of which a quarter of the words is replaced or dropped, evenly or at random."""
    rng = random.Random(31)
    word = lambda: "".join(rng.choice("bcdfgklm") + rng.choice("aeiou") for _ in range(rng.randint(3, 5)))
    items, docs, want = [], [(i, " ".join(word() for _ in range(60))) for i in range(40)], set()
    for n in (3, 4, 5, 6, 7, 8, 11, 12, 16, 23, 24, 31, 32, 40, 48, 49, 55, 59, 64, 100, 200, 500):
        w = [word() for _ in range(n)]
        items.append((n, " ".join(w)))
        lost, tail = n // 4, max(1, n // 3)
        even = range(0, 4 * lost, 4)
        free = rng.sample([*range(n - tail), *rng.sample(range(n - tail, n), tail // 2)], lost)
        for k, gone in enumerate(((), even, even, free, free)):
            kept = [(word() if j in gone else x) for j, x in enumerate(w) if k not in (2, 4) or j not in gone]
            docs.append((1000 * (k + 1) + n, " ".join([word() for _ in range(37)] + kept + [word() for _ in range(29)])))
            want.add((1000 * (k + 1) + n, n))
    table = pa.table({"item_id": pa.array([i for i, _ in items], pa.int64()), "text": [t for _, t in items]})
    got = {(r.doc_id, r.item_id): r for r in decontaminate.query(spark, folder(docs, benchmark=table)).collect()}
    assert set(got) == want
    assert all(r.common >= 0.75 and -1 <= r.cosine <= 1.001 for r in got.values())


def test_decontamination_fits_the_space_on_all_rows(spark, folder, monkeypatch):
    """Every word of every document and of the items of all blocks has a place in the latent space."""
    monkeypatch.setattr(decontaminate, "BLOCK", 8)
    monkeypatch.setattr(decontaminate, "RANK", 40)
    rng = random.Random(41)
    docs = [(i, f"doc{i} common words {words(rng, 3)}") for i in range(2300)]
    items = pa.table({"item_id": pa.array(range(30), pa.int64()), "text": [f"rare{i} in item{i} of all{i} the items{i}" for i in range(30)]})
    path = folder(docs, benchmark=items)
    read = lambda name: spark.read.parquet(f"{path}/{name}.parquet")
    asked = [t for _, t in docs] + items["text"].to_pylist()
    word = decontaminate.word_tokens(*decontaminate.utf8(pa.array(asked)))[0]
    spaces = [m.value.space for m in decontaminate.matchers(read("documents").select("doc_id", "text"), read("benchmark"), fit_documents=None)]
    assert len(spaces) == 4 and all((np.abs(s[decontaminate.dims(word)]).sum(1) > 0).all() for s in spaces)


def test_retrieval_against_all_pairs(spark, folder):
    """What the retrieval finds against every item at every place of every document."""
    rng = random.Random(77)
    vocabulary = [words(rng, 1) + str(i) for i in range(400)]
    line = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [line(n) for n in (6, 9, 15, 22, 30, 41, 59, 90, 140)]
    docs = []
    for d in range(150):
        w = line(rng.randint(20, 160))
        if d % 3:
            item = list(rng.choice(items))
            for _ in range(rng.randint(0, len(item) // 3)):
                at = rng.randrange(len(item))
                item[at : at + 1] = rng.choice(([], line(1), [item[at], *line(1)]))
            at = rng.randint(0, len(w))
            w[at:at] = item
        docs.append((d, " ".join(w)))
    path = folder(docs, benchmark=pa.table({"item_id": pa.array(range(len(items)), pa.int64()), "text": [" ".join(i) for i in items]}))
    got = {(r.doc_id, r.item_id) for r in decontaminate.query(spark, path).collect()}
    of = decontaminate.items_of([(i, " ".join(w)) for i, w in enumerate(items)])
    close, wide = set(), set()
    for d, text in docs:
        w = decontaminate.word_tokens(*decontaminate.utf8(pa.array([text])))[0].tolist()
        for item in of:
            n = len(item.words)
            share = lambda region, item=item: decontaminate.common_subsequence(item.words, region) >= 0.75 * len(item.words) and decontaminate.common_subsequence(item.answer, region) >= 0.5 * len(item.answer)
            if any(share(w[s : s + n]) for s in range(max(1, len(w) - n + 1))):
                close.add((d, item.number))  # within a window of the item's own length
            if share(w):
                wide.add((d, item.number))
    assert got <= wide and len(close) > 60
    assert len(got & close) >= 0.9 * len(close)


def test_sizes_of_tables_without_files(spark, folder):
    from lodestone.llm import runtime

    path = folder([(i, "x" * 3000) for i in range(100)])
    files = spark.read.parquet(f"{path}/documents.parquet")
    own = spark.createDataFrame([(i, "x" * 3000) for i in range(100)], "doc_id long, text string")
    for df in (own, own.join(own.select("doc_id"), "doc_id"), files.join(files.select("doc_id"), "doc_id")):
        assert 50_000 < runtime.size_in_bytes(df) < 2_000_000 and runtime.parts(df, 10_000) < 200
    assert runtime.parts(files, 1 << 30) == 12 and runtime.parts(own.limit(0), 1) == 12


def test_latent_space_is_of_all_passages(spark):
    """Products and the space against dense algebra over every passage of more documents than were once drawn."""
    rng = random.Random(43)
    vocabulary = [words(rng, 1) + str(i) for i in range(60)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.choice((1, 5, 33)))) for _ in range(6000)] + [None, ""]
    # words of one document alone: a fit on some of the documents gives most of them no place
    texts += [f"only{i} stands{i} here{i}" for i in range(40)] + ["many " * 3000 + "ends"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    seen = decontaminate.hashed(docs)
    idf = decontaminate.inverse_frequencies(seen)
    rows, sets = [], []
    for t in texts:
        dim = decontaminate.dims(decontaminate.word_tokens(*decontaminate.utf8(pa.array([t or ""])))[0])
        sets.append(set(dim.tolist()))
        for a in range(0, len(dim), decontaminate.WINDOW):
            row = np.zeros(1 << decontaminate.BITS)
            np.add.at(row, dim[a : a + decontaminate.WINDOW], 1)
            rows.append((row * idf)[:, None])
    known = sorted(set().union(*sets))
    for d in known:
        assert abs(idf[d] - np.log((len(texts) + 1) / (sum(d in s for s in sets) + 1)) - 0.01) < 1e-4
    a = np.stack([r[known, 0] / np.linalg.norm(r) for r in rows])
    space = decontaminate.latent_space(seen, idf, rank=len(known))
    assert not np.delete(space, known, axis=0).any() and (np.abs(space[known]).sum(1) > 0).all()
    # all axes, each over its singular value: the inverse of A'A on what the product can tell from 0
    values, vectors = np.linalg.eigh(a.T @ a)
    keep = values > 1e-2 * values[-1]
    got = vectors[:, keep].T @ (space[known] @ space[known].T) @ vectors[:, keep]
    assert np.allclose(np.diag(got) * values[keep], 1, atol=0.15)


def test_benchmark_space_comes_from_every_document(spark, folder):
    """Words of one document each, of more documents than ``find`` and the pipeline once fitted on."""
    docs = [(i, f"own{i} alone{i}") for i in range(9000)]
    items = pa.table({"item_id": pa.array([1], pa.int64()), "text": ["what the benchmark asks"]})
    path = folder(docs, benchmark=items)
    read = lambda name: spark.read.parquet(f"{path}/{name}.parquet")
    (matcher,) = decontaminate.matchers(read("documents").select("doc_id", "text"), read("benchmark"))
    word = decontaminate.word_tokens(*decontaminate.utf8(pa.array([t for _, t in docs])))[0]
    used = np.bincount(decontaminate.dims(word), minlength=1 << decontaminate.BITS) > 0
    assert (np.abs(matcher.value.space[used]).sum(1) > 0).mean() > 0.9


def test_sums_of_runs():
    rng = np.random.default_rng(5)
    rows = rng.standard_normal((50, 3)).astype(np.float32)
    for size in ([1], [32, 1, 33, 64, 65, 2000, 1], [5] * 9, []):
        place = rng.integers(0, 50, sum(size))
        ends = np.cumsum(size).astype(int)
        want = [rows[place[e - n : e]].sum(0) for n, e in zip(size, ends, strict=True)]
        assert np.allclose(decontaminate.run_sums(rows, decontaminate.plan_of(place, np.array(size, np.int64))), np.array(want).reshape(-1, 3), atol=1e-3)


def test_texts_of_a_tree_are_bounded(monkeypatch):
    """Of tasks of exact sets only small ones share a tree; a task comes whole however its rows are batched."""
    monkeypatch.setattr(ngram_join, "SMALL_BYTES", 1000, raising=False)
    seen, real = [], ngram_join.numbered_shingles
    monkeypatch.setattr(ngram_join, "numbered_shingles", lambda data, *more: seen.append(len(data)) or real(data, *more))
    line = lambda t, i: " ".join(f"{w}{t}" for w in "some words that are the same here and there but at the very end".split()) * 2 + f" row{i}"
    rows = [(t, -1, 100 * t + i, line(t, i)) for t, n in enumerate((3, 2, 20, 1, 1, 9, 1)) for i in range(n)]
    schema = pa.schema([("task", pa.int64()), ("side", pa.int64()), ("doc_id", pa.int64()), ("text", pa.string())])
    batches = [pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows[a : a + 4], strict=True), schema, strict=True)], schema=schema) for a in range(0, len(rows), 4)]
    got = {(u, v) for b in ngram_join._link(60, 3)(iter(batches)) for u, v in zip(b["u"].to_pylist(), b["v"].to_pylist(), strict=True)}
    assert got == {(d, d // 100 * 100) for _, _, d, _ in rows if d % 100}
    sizes = [sum(len(r[3]) for r in rows if r[0] == t) for t in range(7)]
    assert sum(seen) == sum(sizes) and all(s <= 1000 or s in sizes for s in seen)
    assert len(seen) < 7


def test_entries_with_partners_are_those_of_all_pairs():
    """Sizes and places alone tell which documents may link: no pair that the trees would join is left out."""
    rng = np.random.default_rng(5)
    for threshold in (80, 90):
        value = rng.integers(0, 60, 600).astype(np.uint64)
        size = rng.integers(8, 60, 600)
        rest = size - rng.integers(0, size + 1 - -(-threshold * size // 100))
        meet = (value[:, None] == value) & ((100 + threshold) * np.minimum(rest[:, None], rest) >= threshold * (size[:, None] + size))
        np.fill_diagonal(meet, False)
        got = ngram_join.partners(value, size, rest, threshold)
        assert got.tolist() == meet.any(1).tolist()
        assert 0 < got.sum() < len(got)
    assert not len(ngram_join.partners(*(np.zeros(0, t) for t in (np.uint64, np.int64, np.int64)), 90))


def test_texts_that_join_nothing_are_not_shuffled(spark, monkeypatch):
    """Of 2000 texts of which ten are near copies, few reach the exact comparison's join, at either of its steps."""
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(40))) for i in range(2000)]
    rows += [(5000 + i, " ".join(f"v{k}" for k in range(40 + i % 2))) for i in range(10)]
    seen = []

    def noted(docs, ids, *then, held=ngram_join.holding):
        out = held(docs, ids)
        seen.append((out.count(), {r.doc_id for r in ids.collect()} - {r.doc_id for r in out.collect()}))
        made = held(docs, ids, *then)
        # one Python worker a task, whatever follows the filter
        assert made._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
        return made

    monkeypatch.setattr(ngram_join, "holding", noted)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in ngram_join.join(docs).collect()}
    assert got == {i: min(i, 5000) for i, _ in rows}
    assert len(seen) == 2 and all(n < 100 and not lost for n, lost in seen)


def test_written_tables_free_their_shuffles(spark):
    """The setting holds for the writing query alone, whatever it was before."""
    from lodestone.llm import runtime

    before = spark.conf.get(runtime.FREE)
    with runtime.freeing(spark):
        assert spark.conf.get(runtime.FREE) == "true"
    assert spark.conf.get(runtime.FREE) == before
    table, _ = runtime.written(spark.range(100).repartition(3, "id"))
    assert spark.conf.get(runtime.FREE) == before
    assert table.count() == table.distinct().count() == 100


def test_windows_and_cosines_are_those_of_each_window_by_itself():
    """What is looked up and added by strides for all windows at once is what each one's words give, and no window at the
    cosine that is asked for is lost to rounding."""
    rng = np.random.default_rng(3)
    words = [f"w{k}" for k in range(300)]
    texts = [" ".join(rng.choice(words, n)) for n in (20, 30, 32, 48, 12)]
    matcher = decontaminate.Matcher((rng.standard_normal((1 << decontaminate.BITS, 8)) * 0.1).astype(np.float16), decontaminate.items_of(list(enumerate(texts))))
    docs = [" ".join([*rng.choice(words, k), *texts[k % 5].split(), *rng.choice(words, 5)]) for k in range(0, 41)] + ["", "w1"]
    got = {(r, i.number): (round(c, 4), s) for r, i, c, s in matcher.matches(pa.array(docs))}
    for r, text in enumerate(docs[:41]):
        cosine, share = got[r, r % 5]
        dim = decontaminate.dims(decontaminate.word_tokens(*decontaminate.utf8(pa.array([text])))[0])
        best = -1.0
        for strides, numbers, _, vectors in matcher.groups:
            mine = vectors[numbers == r % 5]
            for a in range(0, len(dim), decontaminate.STRIDE) if len(mine) else ():
                window = matcher.space[dim[a : a + strides * decontaminate.STRIDE]].sum(0)
                best = max(best, float((mine @ window).max() / (np.linalg.norm(window) + 1e-9)))
        assert share == 1.0
        assert cosine <= round(best, 4) + 2e-4
    assert not [r for r, _ in got if r > 40]


def test_frequent_words_of_the_fit_are_a_dense_product(monkeypatch):
    """The product is A'(A basis), though only rare words' rows are added one by one."""
    rng = np.random.default_rng(3)
    d, columns = decontaminate, 30
    words = np.array([0, 5, 70, 0, 200, 33], np.uint32)
    dim = np.where(rng.random(int(words.sum())) < 0.8, rng.integers(0, 40, int(words.sum())), rng.integers(0, 1 << d.BITS, int(words.sum()))).astype(np.uint16)
    idf = np.full(1 << d.BITS, 3.0, np.float32)
    idf[:40] = 0.5 + np.arange(40, dtype=np.float32) / 100
    added, real = [], d.plan_of
    monkeypatch.setattr(d, "plan_of", lambda place, size: added.append(len(place)) or real(place, size))
    rows, at = [], 0
    for n in words.tolist():
        for a in range(at, at + n, d.WINDOW):
            row = np.bincount(dim[a : min(a + d.WINDOW, at + n)], minlength=1 << d.BITS) * idf
            rows.append(row / np.linalg.norm(row))
        at += n
    matrix = np.array(rows)
    column, sign = d._signs(columns)
    first = np.zeros((1 << d.BITS, columns))
    np.add.at(first, (np.arange(1 << d.BITS)[:, None], column), sign)
    batch = pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (words, dim)], ["words", "dims"])
    for basis in (None, rng.standard_normal((1 << d.BITS, columns)).astype(np.float32)):
        state = type("State", (), {"value": (idf, basis)})
        got = np.zeros((1 << d.BITS, columns))
        for out in d._multiply(state, columns)(iter([batch])):
            got[out["block"][0].as_py() * 1024 :][:1024] = np.frombuffer(out["sums"][0].as_buffer(), np.float32).reshape(-1, columns)
        assert np.allclose(got, matrix.T @ (matrix @ (first if basis is None else basis)), atol=1e-3)
    assert added and max(added) < len(dim) / 2


def test_words_of_texts_are_runs_of_letters_and_digits():
    texts = ["Ab-c d", "", "é9,,x", "--", "tail", "head tail\n"]
    word, row = decontaminate.word_tokens(*decontaminate.utf8(pa.array(texts)))
    want = [(i, w.lower()) for i, t in enumerate(texts) for w in re.findall(r"[0-9A-Za-zé]+", t)]
    alone = [decontaminate.word_tokens(*decontaminate.utf8(pa.array([w])))[0].tolist() for _, w in want]
    assert row.tolist() == [i for i, _ in want] and [[x] for x in word.tolist()] == alone and len(set(word.tolist())) == len({w for _, w in want})


def test_rows_of_runs_are_added_a_part_at_a_time():
    """Beside its result a sum of runs holds rows of ``RUNS`` runs and not of all: what is added stays in a core's cache."""
    rng = np.random.default_rng(8)
    rows, size = rng.standard_normal((500, 56)).astype(np.float32), rng.integers(1, 40, 20000)
    place = rng.integers(0, 500, int(size.sum()))
    plan = decontaminate.plan_of(place, size)
    tracemalloc.start()
    got = decontaminate.run_sums(rows, plan)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    ends = np.cumsum(size)
    assert np.allclose(got, np.add.reduceat(rows[place], ends - size, axis=0), atol=1e-3)
    # the result, that of the parts of long runs, and little more
    assert peak < 2.6 * got.nbytes


def test_prints_of_runs_are_those_of_prefix_sums():
    """One sum a word in place of one a byte, with the same fingerprints wherever a word stands."""
    from lodestone.llm import text_arrays

    rng = random.Random(4)
    texts = ["", "A", "a" * 70000, "Zz-zZ  x", "éà 1_2", "--", *("".join(rng.choice("abYZ09é .,-\n") for _ in range(rng.randint(0, 90))) for _ in range(200))]
    data, offsets = decontaminate.utf8(pa.array(texts))
    start, end, row = text_arrays.runs(decontaminate.WORD[data], offsets)
    want = text_arrays.Prefix(text_arrays.LOWER[data]).spans(start, end)
    assert np.array_equal(text_arrays.run_prints(data, start, end, text_arrays.byte_values(decontaminate.WORD)), want)
    word, of = decontaminate.word_tokens(data, offsets)
    assert np.array_equal(word, want) and np.array_equal(of, row)
