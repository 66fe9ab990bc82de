"""Quality and toxicity: held-out accuracy on the given tables, and defined cases."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.llm import quality, toxicity

SF = "/root/testdata/sf0.01"


def labels(rows):
    return pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "quality": pa.array([r[1] for r in rows], pa.int32()), "toxic": pa.array([r[2] for r in rows], pa.int32()), "text": pa.array([0] * len(rows), pa.int64())})


@pytest.mark.parametrize(("module", "label", "least"), [(quality, "quality", 0.85), (toxicity, "toxic", 0.9)])
def test_held_out_accuracy(spark, module, label, least):
    rows = module.query(spark, SF)
    assert rows.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    held = rows.where("held_out").join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id")
    assert held.agg(F.avg((F.col("predicted") == F.col(label)).cast("double"))).first()[0] >= least
    assert rows.where("score < 0 OR score > 1 OR score IS NULL").count() == 0


@pytest.mark.parametrize("module", [quality, toxicity])
def test_defined_cases(spark, folder, module):
    docs = [(i, ("good plain words here " if i % 2 else "### junk &&& $$$ scum ") * 5) for i in range(80)] + [(200, None), (201, ""), (None, "good words"), (3, "good plain words here " * 5), (202, "word " * 50_000)]
    known = [(i, i % 2, 1 - i % 2) for i in range(80)] + [(None, 1, 1), (5, None, None), (77777, 1, 0)]
    rows = module.query(spark, folder(docs, labels=labels(known))).collect()
    assert len(rows) == len(docs)
    assert all(0 <= r.score <= 1 and r.held_out is not None for r in rows)
    assert not next(r for r in rows if r.doc_id is None).held_out
    assert module.query(spark, folder([], labels=labels([]))).count() == 0
    assert {r.predicted for r in module.query(spark, folder(docs, labels=labels([]))).collect()} == {0}


def test_forward_backward_is_exact():
    """Marginals against the sum over all labellings."""
    rng = np.random.default_rng(1)
    field = toxicity.Field(np.zeros(1), 0.0, rng.normal(size=(2, 2)))
    size = np.array([1, 4, 3])
    none = np.zeros(0, np.int64)
    t = toxicity.Tokens(none, none, none, none, none, np.cumsum(size) - size, size)
    unary = rng.normal(size=8)
    forward, backward = field.chains(t, unary)
    for first, n in zip(t.first, size, strict=True):
        total, on = 0.0, np.zeros(n)
        for bits in np.ndindex(*[2] * n):
            weight = np.exp(sum(unary[first + i] * b for i, b in enumerate(bits)) + sum(field.moves[a, b] for a, b in zip(bits[:-1], bits[1:], strict=True)))
            total += weight
            on += weight * np.array(bits)
        p = on / total
        assert np.allclose(forward[first : first + n] + backward[first : first + n], np.log(p / (1 - p)))


def test_toxic_spans_are_code_points(spark, folder):
    docs = [(i, f"Çé voilà numéro {i} bonjour. mot idiot ici{i} là." if i % 2 else f"Çé voilà numéro {i} bonjour. mot tranquille ici{i} là.") for i in range(200)]
    df = spark.read.parquet(folder(docs, labels=labels([(i, 1, i % 2) for i in range(200)])) + "/documents.parquet")
    field = toxicity.train(df, spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, toxic int"), F.lit(True))
    for r in toxicity.tag(df, field).collect():
        text = docs[r.doc_id][1]
        assert [text[s.start : s.end] for s in r.spans] == ["idiot"] * (r.doc_id % 2)


def test_quality_scores_are_sparse_dot_products(spark):
    """Scores against a loop over tokens and n-grams of one text at a time."""
    from collections import Counter

    rng = np.random.default_rng(5)
    model = quality.Model(rng.normal(size=1 << quality.BITS).astype(np.float32), 0.3)
    texts = ["", "one", "a a b a b b, ,, a", "naïve wörds! and\tmore\n\n(words) and and and", "x " * 3000, None, "  .. "]
    kind = lambda b: 0 if b in b" \t\n\r\x0b\x0c" else 1 if chr(b).isalnum() and b < 128 or b >= 128 else 2

    def tokens_of(raw):
        out, at = [], 0
        while at < len(raw):
            end = at
            while end < len(raw) and kind(raw[end]) == kind(raw[at]):
                end += 1
            if kind(raw[at]):
                out.append(raw[at:end])
            at = end
        return out

    def number(raw):
        data = np.frombuffer(raw, np.uint8)
        return quality.Prefix(data).spans(np.array([0]), np.array([len(data)]))[0]

    want = []
    for t in texts:
        raw = tokens_of((t or "").encode())
        token = [number(x) for x in raw]
        found = [*token, *(quality.mix(np.array([a * np.uint64(3) + b], np.uint64))[0] for a, b in zip(token, token[1:]))]
        found += [quality.REPEATS[g - 1] for g in (1, 2) for i in range(g, len(raw)) if raw[i] == raw[i - g]]
        counts = Counter(int(f >> np.uint64(64 - quality.BITS)) for f in found)
        value = {f: np.log1p(n) for f, n in counts.items()}
        norm = np.sqrt(sum(v * v for v in value.values()))
        want.append(1 / (1 + np.exp(-(sum(model.weights[f] * v / norm for f, v in value.items()) + model.bias))))
    assert np.allclose(model.scores(pa.array(texts, pa.string())), want, atol=1e-5)
    rows = quality.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3), model, "doc_id").collect()
    assert np.allclose([r.score for r in sorted(rows)], want, atol=1e-5)


def test_toxicity_scores_of_a_batch_are_those_of_its_documents():
    """Marginals of whole batches, and scores out of them, against one document and one sentence at a time."""
    rng = np.random.default_rng(4)
    field = toxicity.Field(rng.normal(size=(3 + len(toxicity.PREFIXES)) << toxicity.BITS).astype(np.float32), -1.0, rng.normal(size=(2, 2)), (3.0, 0.4, -2.0))
    texts = ["", "you fool. you!\nnice day", "a", "Grässlich gut? gut " * 40, " . ! ", "ends with stop."]
    data, offsets = toxicity.utf8(pa.array(texts))
    greatest, total = toxicity.document_sums(field, data, offsets)
    for i, text in enumerate(texts):
        raw = np.frombuffer(text.encode(), np.uint8)
        t = toxicity.tokenise(raw, np.array([0, len(raw)]))
        p = []
        if len(t.word):
            unary = field.logits(toxicity.feature_numbers(t))
            for first, size in zip(t.first.tolist(), t.size.tolist(), strict=True):
                one = toxicity.Tokens(*[np.zeros(0, np.int64)] * 5, np.array([0]), np.array([size]))
                forward, backward = field.chains(one, unary[first : first + size])
                p += (1 / (1 + np.exp(-np.clip(forward + backward, -60, 60)))).tolist()
        assert np.isclose(greatest[i], max(p, default=0)) and np.isclose(total[i], sum(p))
        a, b, c = field.calibration
        assert np.isclose(field.document_scores(greatest, total)[i], 1 / (1 + np.exp(-(a * max(p, default=0) + b * np.log1p(sum(p)) + c))))


@pytest.mark.parametrize("module", [quality, toxicity])
def test_training_takes_one_bounded_text_of_a_doc_id(spark, module):
    rows = [(1, "b"), (1, "a"), (1, "a"), (2, None), (3, "x" * (quality.SAMPLE_BYTES + 1)), (4, "c")]
    known = spark.createDataFrame([(i, 1, 1) for i in (1, 2, 3, 4)], "doc_id long, quality int, toxic int")
    got = quality.training_sample(spark.createDataFrame(rows, "doc_id long, text string"), known, "quality", F.lit(True), 3).collect()
    assert len(got) <= 3 and all(r.doc_id != 3 for r in got) and {r.text for r in got if r.doc_id == 1} <= {"a"}
    module.train(spark.createDataFrame(rows, "doc_id long, text string"), known, F.lit(True))
