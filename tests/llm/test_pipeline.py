"""The pipeline on a small corpus whose fate is known, and its registration."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa

import __spark_entry__
import corpus_pipeline
from lodestone.llm import bpe


def test_pipeline(spark, folder):
    rng = random.Random(1)
    prose = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))
    item = prose(40)
    docs, known = [], []
    for i in range(120):
        junk = i % 4 == 0
        docs.append((i, " ".join(w + "&&&" for w in prose(40).split()) if junk else prose(60)))
        known.append((i, int(not junk)))
    docs += [(500, docs[1][1] + " more"), (501, docs[1][1]), (502, prose(30) + " " + item + " " + prose(30)), (503, prose(40) + " password = 'hunter2abc' end"), docs[2], (None, prose(40)), (504, None)]
    labels = pa.table({"doc_id": pa.array([k for k, _ in known], pa.int64()), "quality": pa.array([q for _, q in known], pa.int32()), "toxic": pa.array([0] * len(known), pa.int32())})
    path = folder(docs, labels=labels, benchmark=pa.table({"item_id": pa.array([1], pa.int64()), "text": [item]}))
    frame = spark.read.parquet(f"{path}/documents.parquet")
    columns = frame.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        frame = stage(spark, frame, path)
        assert frame.columns == columns, name
    rows = corpus_pipeline.run(spark, path).collect()
    clean = {i for i, t in docs if i is not None and t and "&&&" not in t} - {500, 501, 502}
    assert {r.doc_id for r in rows if r.doc_id is not None} - {504} == clean
    assert len([r for r in rows if r.doc_id == 2]) == 1 and any(r.doc_id is None for r in rows)
    codec, texts = bpe.codec(open(bpe.public_vocabulary(), encoding="utf-8").read()), dict(docs)
    for r in rows:
        if r.doc_id in clean:
            want = texts[r.doc_id].replace("password = 'hunter2abc", "[SECRET]")
            assert codec.decode(np.array(r.ids, np.int64)).decode() == want


def test_pipeline_of_empty_long_and_repeated_texts(spark, folder):
    labels = lambda known: pa.table({"doc_id": pa.array([k for k, _ in known], pa.int64()), "quality": pa.array([q for _, q in known], pa.int32()), "toxic": pa.array([0] * len(known), pa.int32())})
    none = pa.table({"item_id": pa.array([], pa.int64()), "text": pa.array([], pa.string())})
    assert corpus_pipeline.run(spark, folder([], labels=labels([]), benchmark=none)).count() == 0
    rng = random.Random(3)
    prose = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))
    docs = [(i, prose(50) if i % 3 else "&&& ### " * 20) for i in range(90)]
    long = prose(150_000)
    docs += [(200, long), (199, long), (198, long + " end"), (197, ""), (196, None), (None, None), (1, docs[1][1]), (1, docs[1][1])]
    known = [(i, int(bool(i % 3))) for i in range(90)]
    rows = corpus_pipeline.run(spark, folder(docs, labels=labels(known), benchmark=none)).collect()
    ids = [r.doc_id for r in rows]
    assert ids.count(1) == 1 and 198 in ids and not {199, 200} & set(ids) and not {i for i in range(90) if i % 3 == 0} & set(ids)
    assert {i for i in range(90) if i % 3} <= set(ids)


def test_near_copies_of_five_word_shingles(spark, folder):
    """Copies of similarity 0.75 to 0.95 by edited words and by added or cut passages, against a brute-force join."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 7)))
    docs = []
    for k, n in enumerate((20, 45, 60, 110, 200, 400)):
        w = [word() for _ in range(n)]
        docs.append((100 * k, " ".join(w)))
        docs += [(100 * k + j, " ".join([*w, *(word() for _ in range(n * j // 100))])) for j in (8, 12, 16, 20, 24, 30)]
        docs += [(100 * k + j + 1, " ".join(w[: n - n * j // 100])) for j in (8, 12, 16, 20, 24, 30)]
        for j, share in ((40, 55), (41, 50), (42, 45), (43, 40)):
            docs.append((100 * k + j, " ".join(word() if i % share == 9 else x for i, x in enumerate(w))))
    rng.shuffle(docs)
    sets = {i: {tuple(t.split()[j : j + 5]) for j in range(len(t.split()) - 4)} for i, t in docs}
    parent = {i: i for i in sets}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    middle = 0
    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                middle += 100 * both < 90 * (len(sets[a]) + len(sets[b]) - both)
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    path = folder(docs)
    kept = corpus_pipeline.keep_one_of_each_group(spark, spark.read.parquet(f"{path}/documents.parquet"), path)
    assert middle > 50 and sorted(r.doc_id for r in kept.collect()) == sorted(i for i in sets if find(i) == i)


def test_registered():
    names = __spark_entry__.queries()
    assert {n.split("_")[0] for n in names} >= {f"op{i}" for i in range(1, 11)} and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= set(names)


def test_decontamination_stage_fits_on_all_documents(spark, folder, monkeypatch):
    """The stage's latent space comes from every row that the stage before wrote."""
    from lodestone.llm import decontaminate

    seen, real = [], decontaminate.latent_space
    count = lambda passages: sum(len(r["words"]) // 4 for r in passages.select("words").collect())
    monkeypatch.setattr(decontaminate, "latent_space", lambda passages, *more: seen.append(count(passages)) or real(passages, *more))
    path = folder([(i, f"own{i} alone{i}") for i in range(6000)], benchmark=pa.table({"item_id": pa.array([1], pa.int64()), "text": ["what the benchmark asks"]}))
    assert corpus_pipeline.drop_benchmark(spark, spark.read.parquet(f"{path}/documents.parquet"), path).count() == 6000
    assert seen == [6001]


def test_fit_takes_one_python_worker_a_task(spark, folder, monkeypatch):
    """The fit's input is read and not made by another Python step of the same task."""
    from lodestone.llm import decontaminate

    plans, real = [], decontaminate.latent_space
    monkeypatch.setattr(decontaminate, "latent_space", lambda passages, *more: plans.append(passages._jdf.queryExecution().executedPlan().toString()) or real(passages, *more))
    path = folder([(1, "what is asked here"), (2, None)], benchmark=pa.table({"item_id": pa.array([1], pa.int64()), "text": ["what is asked"]}))
    assert corpus_pipeline.drop_benchmark(spark, spark.read.parquet(f"{path}/documents.parquet"), path).count() == 1
    assert len(plans) == 1 and "MapInArrow" not in plans[0]


def test_texts_are_encoded_in_runs_of_bounded_size():
    texts = ["a b c " * 20_000, None, "", "é" * 2000, *["word " * 1000] * 300, "long " * 200_000, "end"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], ["_id", "_text"])
    runs = list(bpe.slices(iter([batch, batch.slice(0, 0), batch.slice(3, 2)])))
    assert [t for r in runs for t in r["_text"].to_pylist()] == texts + texts[3:5] and [i for r in runs for i in r["_id"].to_pylist()] == [*range(len(texts)), 3, 4]
    assert all(r.num_rows == 1 or sum(len((t or "").encode()) for t in r["_text"].to_pylist()) <= bpe.PIECE for r in runs) and len(runs) > 4
