"""Toxicity: a linear-chain conditional random field tags toxic spans; marginals make document scores and offsets.

Chains are sentences (up to a token with . ! or ?, or a line end) of lower-cased tokens. Features of a token are hashes
of itself, of its prefixes and of the tokens before and after it. Training takes a bounded, documented sample of labelled documents
(``SAMPLE_ROWS``). Labels are of documents, so tokens are labelled first: greedily, the token or prefix that explains the
most toxic documents not yet explained and is all but absent from clean ones; its occurrences in toxic documents are
toxic tokens. The field is trained on these by gradient steps on the exact log-likelihood; forward-backward gives each
token's marginal. A document's score is a logistic function of its greatest marginal and of their sum.

Scoring is a map without a shuffle. Defined cases: null or empty text has no tokens and the score of marginals of zero;
a null doc_id is scored, with held_out false; rows that repeat are scored each; extra columns are ignored; an empty
table gives an empty result; without toxic training rows every score is below the threshold. Offsets are code points.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import runtime
from .quality import tokens, training_sample
from .text_arrays import LOWER, Prefix, mix, pieces, row_starts, utf8

BITS = 18
#: The most labelled documents, and sentences without a toxic token, that training reads.
SAMPLE_ROWS, CLEAN_SENTENCES = 3000, 12_000
STEPS, RATE, PENALTY = 60, 0.5, 1e-4
#: A token explains toxic documents if so many have it and so small a share of its documents is clean.
LEAST_DOCUMENTS, MOST_CLEAN = 3, 0.1
#: A token marks toxic documents if no clean one and so many toxic ones have it, after so many different tokens a document.
LEAST_MARKED, VARIETY = 5, 0.75
THRESHOLD, SPAN_THRESHOLD = 0.5, 0.5

#: Bytes of the prefixes that are features of a longer token.
PREFIXES = (4, 5, 6, 7, 8)

_STOP = np.zeros(256, bool)
_STOP[[33, 46, 63]] = True


@dataclass
class Tokens:
    """The tokens of some documents, in order, and the sentences that they form."""

    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    word: np.ndarray
    prefix: np.ndarray  # by length of PREFIXES; 0 where the token isn't longer
    first: np.ndarray  # of each sentence
    size: np.ndarray


def tokenise(data: np.ndarray, offsets: np.ndarray) -> Tokens:
    low = LOWER[data]
    start, end, row = tokens(low, offsets)
    if not len(start):
        none = np.zeros(0, np.int64)
        return Tokens(start, end, row, np.zeros(0, np.uint64), np.zeros((len(PREFIXES), 0), np.uint64), none, none)
    stop = np.r_[0, np.cumsum(_STOP[low])]
    line = np.r_[0, np.cumsum(low == 10)]
    last = stop[end] > stop[start]
    new = np.r_[True, (row[1:] != row[:-1]) | last[:-1] | (line[start[1:]] > line[end[:-1]])]
    first = np.flatnonzero(new)
    prints = Prefix(low)
    prefix = np.stack([np.where(end - start > k, prints.spans(start, np.minimum(start + k, end)), np.uint64(0)) for k in PREFIXES])
    return Tokens(start, end, row, prints.spans(start, end), prefix, first, np.diff(np.r_[first, len(start)]))


def feature_numbers(t: Tokens) -> np.ndarray:
    """Feature numbers of each token: itself, the one before, the one after, its prefixes; 0 where there is none."""
    shift = np.uint64(64 - BITS)
    before, after = np.roll(t.word, 1), np.roll(t.word, -1)
    own = (t.word >> shift).astype(np.int64)
    left = (mix(before + np.uint64(1)) >> shift).astype(np.int64)
    right = (mix(after + np.uint64(2)) >> shift).astype(np.int64)
    left[t.first] = 0
    right[t.first + t.size - 1] = 0
    prefix = [(p >> shift).astype(np.int64) + (k << BITS) for k, p in enumerate(t.prefix, 3)]
    return np.stack([own, left + (1 << BITS), right + (2 << BITS), *prefix])


@dataclass
class Field:
    weights: np.ndarray
    bias: float
    moves: np.ndarray  # of label i, then j: the weight moves[i, j]
    calibration: tuple[float, float, float] = (0.0, 0.0, -6.0)

    def logits(self, feature: np.ndarray) -> np.ndarray:
        return self.weights[feature].sum(0) + self.bias

    def chains(self, t: Tokens, unary: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Forward and backward log odds of each token; their sum is the marginal's."""
        m = self.moves
        order = np.argsort(-t.size, kind="stable")
        first, size = t.first[order], t.size[order]
        forward, backward = unary.copy(), np.zeros_like(unary)
        longest = int(size[0]) if len(size) else 0
        active = np.searchsorted(-size, -np.arange(longest), "left") if longest else []
        for step in range(1, longest):
            at = first[: active[step]] + step
            r = forward[at - 1]
            forward[at] += np.logaddexp(m[0, 1], m[1, 1] + r) - np.logaddexp(m[0, 0], m[1, 0] + r)
        for step in range(longest - 2, -1, -1):
            at = first[: active[step + 1]] + step
            s = unary[at + 1] + backward[at + 1]
            backward[at] = np.logaddexp(m[1, 0], m[1, 1] + s) - np.logaddexp(m[0, 0], m[0, 1] + s)
        return forward, backward

    def marginals(self, t: Tokens) -> np.ndarray:
        if not len(t.word):
            return np.zeros(0)
        forward, backward = self.chains(t, self.logits(feature_numbers(t)))
        return 1 / (1 + np.exp(-np.clip(forward + backward, -60, 60)))

    def document_scores(self, greatest: np.ndarray, total: np.ndarray) -> np.ndarray:
        a, b, c = self.calibration
        return 1 / (1 + np.exp(-np.clip(a * greatest + b * np.log1p(total) + c, -40, 40)))


def evidence(t: Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct tokens and prefixes of each row, the row, and a token that one stands after."""
    left = np.roll(t.word, 1)
    left[t.first] = 0
    word, row, before = [t.word], [t.row], [left]
    for prefix in t.prefix:
        has = prefix > 0
        word, row, before = [*word, prefix[has]], [*row, t.row[has]], [*before, left[has]]
    word, row, before = map(np.concatenate, (word, row, before))
    order = np.lexsort((word, row))
    word, row, before = word[order], row[order], before[order]
    fresh = np.r_[True, (word[1:] != word[:-1]) | (row[1:] != row[:-1])][: len(word)]
    return word[fresh], row[fresh].astype(np.int32), before[fresh].astype(np.uint32)


def toxic_words(word: np.ndarray, row: np.ndarray, left: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """The tokens and prefixes that mark toxic documents, of their ``evidence``. ``toxic`` is of rows.

    First greedily those that explain the most documents still unexplained. Then all that no clean document has, that
    enough toxic ones have, and that stand after ever other tokens: what comes with copies of one text doesn't.
    """
    rows = len(toxic)
    word, at = np.unique(word, return_inverse=True)
    at = at.astype(np.int32)
    clean = np.bincount(at[~toxic[row]], minlength=len(word))
    marked = np.bincount(at[toxic[row]], minlength=len(word))
    chosen, open_ = np.zeros(len(word), bool), toxic.copy()
    while len(word):
        gain = np.bincount(at[open_[row]], minlength=len(word))
        gain[clean > MOST_CLEAN * (clean + marked)] = 0
        best = int(gain.argmax())
        if gain[best] < max(LEAST_DOCUMENTS, 0.002 * rows * toxic.mean()):
            break
        chosen[best] = True
        open_[row[at == best]] = False
    frequent = (clean == 0) & (marked >= LEAST_MARKED)
    some = np.flatnonzero(toxic[row] & frequent[at])
    pair = np.unique(np.stack([at[some].astype(np.uint64), left[some]]), axis=1)[0].astype(np.int64) if len(some) else some
    chosen |= frequent & (np.bincount(pair, minlength=len(word)) >= VARIETY * marked)
    return word[chosen]


def fit(texts: list[str], labels: list[int]) -> Field:
    """Trains on whole texts. Prefixes are held as 64-bit numbers for the tokens of these texts only; ``SAMPLE_ROWS``
    bounds them."""
    data, offsets = utf8(pa.array(texts, pa.string()))
    field = Field(np.zeros((3 + len(PREFIXES)) << BITS, np.float32), -4.0, np.zeros((2, 2)))
    toxic = np.array(labels, bool)
    if not toxic.any():
        return field

    def runs() -> Iterator[tuple[int, Tokens]]:
        for a, b in pieces(offsets):
            yield a, tokenise(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])

    found, sentences = [], 0
    for a, t in runs():
        word, row, left = evidence(t)
        found.append((word, row + np.int32(a), left))
        sentences += len(t.first)
    if not sentences:
        return field
    lexicon = toxic_words(*map(np.concatenate, zip(*found, strict=True)), toxic)
    del found
    # all sentences with a toxic token, and a share of the others
    share, number, kept = CLEAN_SENTENCES / sentences, 0, []
    for a, t in runs():
        label = (np.isin(t.word, lexicon) | np.isin(t.prefix, lexicon).any(0)) & toxic[a + t.row]
        sentence = np.repeat(np.arange(len(t.first)), t.size)
        hit = np.bincount(sentence[label], minlength=len(t.first)) > 0
        hit |= mix(np.arange(number, number + len(t.first)).astype(np.uint64)) < np.uint64(min(share, 0.999) * 2.0**64)
        number += len(t.first)
        chosen = hit[sentence]
        kept.append((t.word[chosen], t.prefix[:, chosen], t.size[hit], label[chosen]))
    size = np.concatenate([k[2] for k in kept])
    none = np.zeros(0, np.int64)
    part = Tokens(none, none, none, np.concatenate([k[0] for k in kept]), np.concatenate([k[1] for k in kept], axis=1), np.cumsum(size) - size, size)
    y, feature = np.concatenate([k[3] for k in kept]).astype(np.float64), feature_numbers(part)
    pair = np.ones(len(y), bool)
    pair[part.first] = False
    pair = np.flatnonzero(pair)
    used, place = np.unique(feature, return_inverse=True)
    place = place.reshape(feature.shape)
    w, squares, move_squares, bias_squares = np.zeros(len(used)), np.full(len(used), 1e-8), np.full((2, 2), 1e-8), 1e-8
    for _ in range(STEPS):
        unary = w[place].sum(0) + field.bias
        forward, backward = field.chains(part, unary)
        p = 1 / (1 + np.exp(-np.clip(forward + backward, -60, 60)))
        slope = p - y
        gradient = sum(np.bincount(place[i], slope, len(used)) for i in range(len(place))) / len(y) * 100 + PENALTY * w
        f, s = forward[pair - 1], unary[pair] + backward[pair]
        joint = np.stack([np.zeros(len(pair)) + field.moves[0, 0], s + field.moves[0, 1], f + field.moves[1, 0], f + s + field.moves[1, 1]])
        joint = np.exp(joint - joint.max(0))
        joint /= joint.sum(0)
        seen = np.bincount((2 * y[pair - 1] + y[pair]).astype(int), minlength=4)
        moves = ((joint.sum(1) - seen) / len(y) * 100).reshape(2, 2) + PENALTY * field.moves
        squares += gradient**2
        move_squares += moves**2
        w -= RATE * gradient / np.sqrt(squares)
        field.moves = field.moves - 0.2 * RATE * moves / np.sqrt(move_squares)
        total = slope.mean() * 100
        bias_squares += total**2
        field.bias -= 0.2 * RATE * total / np.sqrt(bias_squares)
    field.weights[used] = w
    greatest, total = document_sums(field, data, offsets)
    x = np.stack([greatest, np.log1p(total), np.ones(len(greatest))])
    c = np.array([4.0, 0.0, -3.0])
    for _ in range(30):  # Newton steps of a penalised logistic regression
        p = 1 / (1 + np.exp(-np.clip(c @ x, -40, 40)))
        slope = x @ (p - toxic) + 0.05 * c
        c -= np.linalg.solve((x * (p * (1 - p) + 1e-9)) @ x.T + 0.05 * np.eye(3), slope)
    field.calibration = tuple(map(float, c))
    return field


def document_sums(field: Field, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Greatest marginal and sum of marginals of each document."""
    rows = len(offsets) - 1
    greatest, total = np.zeros(rows), np.zeros(rows)
    for a, b in pieces(offsets):
        t = tokenise(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        p = field.marginals(t)
        total[a:b] = np.bincount(t.row, p, b - a)
        np.maximum.at(greatest, a + t.row, p)
    return greatest, total


SPANS = "array<struct<start:bigint,end:bigint,probability:double>>"


def tag(df: DataFrame, field: Field, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per input row: its id, score, and the offending spans (tokens of ``SPAN_THRESHOLD`` or more)."""
    shared = df.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            data, offsets = utf8(batch["_text"])
            rows = batch.num_rows
            greatest, total, found = np.zeros(rows), np.zeros(rows), []
            for a, b in pieces(offsets):
                low, cut = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                t = tokenise(low, cut)
                p = own.marginals(t)
                total[a:b] = np.bincount(t.row, p, b - a)
                np.maximum.at(greatest, a + t.row, p)
                hit = np.flatnonzero(p >= SPAN_THRESHOLD)
                point = np.r_[0, np.cumsum((low & 0xC0) != 0x80)]
                origin = point[cut[t.row[hit]]]
                found.append((a + t.row[hit], point[t.start[hit]] - origin, point[t.end[hit]] - origin, p[hit]))
            row, start, end, p = (np.concatenate(x) for x in zip(*found, strict=True)) if found else [np.zeros(0, np.int64)] * 3 + [np.zeros(0)]
            spans = pa.StructArray.from_arrays([pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(p, pa.float64())], ["start", "end", "probability"])
            lists = pa.ListArray.from_arrays(pa.array(row_starts(row, rows), pa.int32()), spans)
            yield pa.RecordBatch.from_arrays([batch["_id"], pa.array(own.document_scores(greatest, total)), lists], ["_id", "score", "spans"])

    kind = df.schema[id_column].dataType.simpleString()
    out = df.select(F.col(id_column).alias("_id"), F.col(text_column).alias("_text")).mapInArrow(run, f"_id {kind}, score double, spans {SPANS}")
    return out.withColumnRenamed("_id", id_column)


def train(documents: DataFrame, labels: DataFrame, usable: F.Column, rows: int = SAMPLE_ROWS) -> Field:
    got = sorted((r.doc_id, r.text or "", r.label) for r in training_sample(documents, labels, "toxic", usable, rows).collect())
    return fit([g[1] for g in got], [g[2] for g in got])


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = (runtime.table(spark, sf_dir, t) for t in ("documents", "labels"))
    tagged = tag(documents, train(documents, labels, ~held_out()))
    return tagged.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "spans")
