"""Quality classifier: hashed word n-gram logistic regression trained with follow-the-regularised-leader updates.

Tokens are runs of letters, digits and non-ASCII bytes, and runs of punctuation; features are hashed token unigrams and
bigrams, and n-grams that repeat a token whatever it is, with log term frequency, scaled to unit length. Training takes a bounded, documented sample of labelled rows
(``SAMPLE_ROWS``, chosen by a hash of doc_id); scoring is a sparse dot product inside map tasks, without a shuffle.

Defined cases: null or empty text has no features and scores sigmoid(bias); a null doc_id is scored, with held_out
false; rows that repeat are scored each; extra columns are ignored; an empty table gives an empty result; without
training rows every score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import runtime
from .text_arrays import SPACE, Prefix, mix, pieces, row_starts, utf8

BITS = 20
#: The most labelled rows that training reads, and the longest texts among them in bytes.
SAMPLE_ROWS, SAMPLE_BYTES = 6000, 64 << 10
#: Passes over the sample: at least so many, and more over a small one, up to so many updates.
EPOCHS, UPDATES = 4, 12_000
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.02, 0.5
THRESHOLD = 0.7
#: Fingerprints of the n-grams "a token, itself again" and "a token, any token, itself again", whatever the token is.
REPEATS = mix(np.array([101, 102], np.uint64))

#: 0 space, 1 letters, digits and non-ASCII, 2 the rest.
KIND = np.full(256, 2, np.uint8)
KIND[SPACE] = 0
KIND[48:58] = KIND[65:91] = KIND[97:123] = KIND[128:] = 1


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each run of one kind other than space."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    kind = KIND[data]
    edge = np.ones(len(data), bool)
    edge[1:] = kind[1:] != kind[:-1]
    edge[offsets[:-1][offsets[:-1] < len(data)]] = True
    start = np.flatnonzero(edge)
    end = np.r_[start[1:], len(data)]
    keep = kind[start] != 0
    start, end = start[keep], end[keep]
    return start, end, np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(start, offsets)))


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows: row offsets, feature numbers and values of unit length."""
    start, end, row = tokens(data, offsets)
    token = Prefix(data).spans(start, end)
    near = row[1:] == row[:-1]
    pair = mix(token[:-1] * np.uint64(3) + token[1:])[near]
    again = [np.flatnonzero((token[g:] == token[: len(token) - g]) & (row[g:] == row[: len(row) - g])) + g for g in (1, 2)]
    pattern = [np.full(len(at), REPEATS[g], np.uint64) for g, at in enumerate(again)]
    feature = (np.concatenate([token, pair, *pattern]) >> np.uint64(64 - BITS)).astype(np.int64)
    row = np.concatenate([row, row[1:][near], *(row[at] for at in again)])
    key = np.sort(row << BITS | feature)
    fresh = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    value = np.log1p(np.diff(np.r_[fresh, len(key)]))
    row, feature = key[fresh] >> BITS, key[fresh] & ((1 << BITS) - 1)
    rows = len(offsets) - 1
    norm = np.sqrt(np.bincount(row, value * value, rows))
    return row_starts(row, rows), feature, (value / norm[row]).astype(np.float32)


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def scores(self, text: pa.Array) -> np.ndarray:
        data, offsets = utf8(text)
        out = np.zeros(len(offsets) - 1)
        for a, b in pieces(offsets):
            starts, feature, value = features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            sums = np.r_[0.0, np.cumsum(self.weights[feature] * value, dtype=np.float64)]
            out[a:b] = sums[starts[1:]] - sums[starts[:-1]]
        return 1 / (1 + np.exp(-np.clip(out + self.bias, -40, 40)))


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]]) -> Model:
    """FTRL-proximal over (features, values, label) rows, in the order given. The bias is a feature that is always on."""
    bias = 1 << BITS
    z, n = np.zeros(bias + 1), np.zeros(bias + 1)

    def weights(at: np.ndarray | slice) -> np.ndarray:
        pull = np.sign(z[at]) * np.maximum(np.abs(z[at]) - L1, 0)
        return -pull / ((BETA + np.sqrt(n[at])) / ALPHA + L2)

    for _ in range(max(EPOCHS, UPDATES // max(1, len(rows)))):
        for feature, value, label in rows:
            at, x = np.r_[feature, bias], np.r_[value, 1.0]
            w = weights(at)
            gradient = (1 / (1 + np.exp(-np.clip(w @ x, -40, 40))) - label) * x
            grown = n[at] + gradient * gradient
            z[at] += gradient - (np.sqrt(grown) - np.sqrt(n[at])) / ALPHA * w
            n[at] = grown
    w = weights(slice(None))
    return Model(w[:bias].astype(np.float32), float(w[bias]))


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = utf8(batch["text"])
        starts, feature, value = features(data, offsets)
        feature = feature.astype(np.int32)
        cut = list(zip(starts[:-1], starts[1:], strict=True))
        yield pa.RecordBatch.from_arrays(
            [batch["label"], pa.array([feature[a:b].tobytes() for a, b in cut], pa.binary()), pa.array([value[a:b].tobytes() for a, b in cut], pa.binary())],
            ["label", "feature", "value"],
        )


def training_sample(documents: DataFrame, labels: DataFrame, label: str, usable: F.Column, rows: int) -> DataFrame:
    """(doc_id, text, label) of at most ``rows`` labelled rows that are usable, by a hash of doc_id; one text of each
    doc_id, of ``SAMPLE_BYTES`` at most.

    The chosen ids are at most ``rows``, which bounds the broadcast, and with it what is collected.
    """
    chosen = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & usable)
        .groupBy("doc_id")
        .agg(F.max(label).cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
    )
    short = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where(F.octet_length("text") <= SAMPLE_BYTES)
    return short.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))


def train(documents: DataFrame, labels: DataFrame, usable: F.Column, rows: int = SAMPLE_ROWS) -> Model:
    sample = training_sample(documents, labels, "quality", usable, rows)
    got = sample.select("label", "text").mapInArrow(_sparse, "label int, feature binary, value binary").toArrow()
    got = sorted(zip(*(got[c].to_pylist() for c in ("feature", "value", "label")), strict=True))
    order = np.random.default_rng(7).permutation(len(got))
    return fit([(np.frombuffer(got[i][0], np.int32), np.frombuffer(got[i][1], np.float32), got[i][2]) for i in order])


def score(documents: DataFrame, model: Model, *columns: str) -> DataFrame:
    """The named columns of each row and its score."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [batch[c] for c in columns] + [pa.array(shared.value.scores(batch[batch.num_columns - 1]))]
            yield pa.RecordBatch.from_arrays(out, [*columns, "score"])

    frame = documents.select(*columns, F.col("text").alias("_text"))
    kept = ", ".join(f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in columns)
    return frame.mapInArrow(run, f"{kept}, score double")


def keep(documents: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows that score ``threshold`` or more, with all their columns."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(shared.value.scores(batch["text"]) >= threshold))

    return documents.mapInArrow(run, documents.schema)


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = (runtime.table(spark, sf_dir, t) for t in ("documents", "labels"))
    model = train(documents, labels, ~held_out())
    scored = score(documents, model, "doc_id")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
