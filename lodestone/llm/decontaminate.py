"""Benchmark decontamination by latent semantic retrieval.

1. All texts are split into words once, kept as two bytes a word; document frequencies of hashed words are counted over
   all documents.
2. A distributed randomised SVD of the TF-IDF matrix of all passages of all documents and items gives a latent space: each
   task multiplies its passages with the current basis (at first a sparse one of random signs) and sends sums by block of
   dimensions; the driver orthogonalises a matrix of fixed size.
3. Every window of ``WINDOW`` words (``SHORT_WINDOW`` for short items) of every document, at every ``STRIDE``th word, is
   projected and compared with every item, or with passages of a window's length that tile an item of over ``LONG``
   words; windows whose cosine is ``COSINE`` or more are candidates. Axes are scaled by their singular values, so that
   what is common to a language weighs no more than what tells passages apart. A cosine implies nothing for weighted
   words, so a region is a candidate too where so many runs of an item's words stand as must be left of it when the
   part that ``COMMON`` allows is replaced or dropped (``seed_rule``): such copies are found whatever their length.
4. Around a candidate, the longest common subsequence of words with the item must reach ``COMMON`` of the item, and that
   with the item's answer (its last sentence, or its last third) ``ANSWER`` of the answer: paraphrases keep word order.

Items are taken in blocks, which bounds the broadcast; documents are read once a block and are never shuffled.
Defined cases: null or empty texts and items without words match nothing; a null doc_id is reported as null; rows that
repeat are reported each; repeated items too; extra columns are ignored; empty tables give an empty result.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import runtime
from .quality import KIND
from .text_arrays import BASE, byte_values, mix, pieces, ranges, run_prints, runs, utf8

BITS, RANK, SPARE, ROUNDS = 15, 160, 8, 1
#: Items of a block; input of a task of the fit, each of which sends sums of 22 MB at most, and passages multiplied at once.
BLOCK, FIT_BYTES, FIT_PASSAGES = 4096, 128 << 20, 8192
#: Signs of each dimension in the first basis; rows that are added one by one before their sums are added.
SIGNS, ADDED = 4, 32
#: Columns of a basis multiplied at once, and runs whose rows are added at once: what is looked up and added stays in a core's cache.
SLICE, RUNS = 56, 1024
#: The dimensions in most documents, whose part of the fit's products is a dense product of counts.
DENSE = 64
#: Words of a window, of one for items of fewer than ``SHORT`` words, and from one window to the next.
WINDOW, SHORT_WINDOW, SHORT, STRIDE = 32, 16, 24, 8
#: Items of more words are compared by passages of a window's length.
LONG = 48
#: The longest run of words that is looked up, and the items whose runs are looked up at once.
SEED, SEED_ITEMS = 3, 256
COSINE, COMMON, ANSWER = 0.6, 0.75, 0.5
_DIM_BLOCK = 1024
#: Bytes of which words are runs.
WORD = KIND == 1
_INSIDE, _VALUES = WORD.astype(np.uint8).tobytes(), byte_values(WORD)
#: Bytes of text whose words are projected at once, so that their arrays stay in a core's cache.
PIECE = 64 << 10


def word_tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprint and row of each lower-cased word."""
    start, end, row = runs(np.frombuffer(data.tobytes().translate(_INSIDE), bool), offsets)
    return run_prints(data, start, end, _VALUES), row


def dims(word: np.ndarray) -> np.ndarray:
    return (word >> np.uint64(64 - BITS)).astype(np.int64)


HASHED = "words binary, dims binary"


def hashed(texts: DataFrame) -> DataFrame:
    """Of runs of documents: how many words each has (4 bytes), and the dimensions of these words (2 bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch["text"])
            for a, b in pieces(offsets, PIECE):
                word, row = word_tokens(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                both = np.bincount(row, minlength=b - a).astype(np.uint32), dims(word).astype(np.uint16)
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in both], ["words", "dims"])

    return texts.select("text").mapInArrow(run, HASHED)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(words of each document, dimension of each word)"""
    for batch in batches:
        for words, dim in zip(batch["words"], batch["dims"], strict=True):
            yield np.frombuffer(words.as_buffer(), np.uint32).astype(np.int64), np.frombuffer(dim.as_buffer(), np.uint16).astype(np.int64)


def _counted(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted keys: where each begins, and how many there are of it."""
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    return first, np.diff(np.r_[first, len(key)])


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    count, rows = np.zeros(1 << BITS, np.int64), 0
    for words, dim in _runs(batches):
        rows += len(words)
        key = np.sort(np.repeat(np.arange(len(words)), words) << BITS | dim)
        count += np.bincount(key[_counted(key)[0]] & ((1 << BITS) - 1), minlength=1 << BITS)
    at = np.flatnonzero(count)
    yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, at], pa.int64()), pa.array(np.r_[rows, count[at]], pa.int64())], ["dim", "n"])


def inverse_frequencies(seen: DataFrame) -> np.ndarray:
    """Of each dimension, over all documents of ``hashed``. The driver sees 2**BITS sums at most."""
    counts = seen.mapInArrow(_frequencies, "dim bigint, n bigint").groupBy("dim").agg(F.sum("n").alias("n")).collect()
    total = sum(r.n for r in counts if r.dim < 0)
    frequency = np.zeros(1 << BITS)
    for r in counts:
        if r.dim >= 0:
            frequency[r.dim] = r.n
    return np.log((total + 1) / (frequency + 1)).astype(np.float32) + np.float32(0.01)


def _passages(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """Passage and dimension of each word as one number, sorted, of non-overlapping passages of a document: ``FIT_PASSAGES``
    at once."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    total = 0

    def out() -> Iterator[np.ndarray]:
        words, dim = (np.concatenate(x) for x in zip(*held, strict=True))
        size = -(-words // WINDOW)
        place = np.arange(len(dim)) - np.repeat(np.cumsum(words) - words, words)
        passage = np.repeat(np.cumsum(size) - size, words) + place // WINDOW
        for n in range(0, int(size.sum()), FIT_PASSAGES):
            a, b = np.searchsorted(passage, (n, n + FIT_PASSAGES))
            yield np.sort((passage[a:b] - n << BITS | dim[a:b]).astype(np.int32))

    for words, dim in _runs(batches):
        size = int((-(-words // WINDOW)).sum())
        if held and total + size > FIT_PASSAGES:
            yield from out()
            held, total = [], 0
        held.append((words, dim))
        total += size
    if held:
        yield from out()


Plan = tuple[list[np.ndarray], np.ndarray, "Plan | None", np.ndarray, np.ndarray]


def plan_of(place: np.ndarray, size: np.ndarray) -> Plan:
    """How ``run_sums`` adds rows: the places added at each step, the order of the runs, and for long runs, which go in parts
    of ``ADDED`` places, how to add up the parts, of which runs these are, and where the parts of each run end."""
    parts = -(-size // ADDED)
    ends, rest = np.cumsum(parts) - 1, None
    more = np.flatnonzero(parts > 1)
    if len(more):
        rest = plan_of(ranges((ends + 1 - parts)[more], parts[more]), parts[more])
        last, size = size - (parts - 1) * ADDED, np.full(int(parts.sum()), ADDED)
        size[ends] = last
    order = np.argsort(-size, kind="stable")
    start, size = (np.cumsum(size) - size)[order], size[order]
    counts = np.searchsorted(-size, -np.arange(int(size.max(initial=0))))
    return [place[start[:n] + i] for i, n in enumerate(counts.tolist())], order, rest, more, ends


def run_sums(rows: np.ndarray, plan: Plan) -> np.ndarray:
    """Of each run of places: the sum of the rows there. ``RUNS`` runs go on together, place by place."""
    steps, order, rest, more, ends = plan
    out = np.empty((len(order), rows.shape[1]), rows.dtype)
    held = np.empty((2, min(RUNS, len(order)), rows.shape[1]), rows.dtype)
    for a in range(0, len(order), RUNS):
        which = order[a : a + RUNS]
        total, next_rows = held[:, : len(which)]
        # clip: what is in range needs no second buffer
        np.take(rows, steps[0][a : a + RUNS], axis=0, out=total, mode="clip")
        for at in steps[1:]:
            at = at[a : a + RUNS]
            if not len(at):
                break
            np.take(rows, at, axis=0, out=next_rows[: len(at)], mode="clip")
            total[: len(at)] += next_rows[: len(at)]
        out[which] = total
    if rest is None:
        return out
    whole = out[ends]
    whole[more] = run_sums(out, rest)
    return whole


def _signs(columns: int) -> tuple[np.ndarray, np.ndarray]:
    """The columns where each dimension's row of the first basis isn't 0, and the signs there."""
    rng = np.random.default_rng(11)
    return rng.integers(0, columns, (1 << BITS, SIGNS)), rng.choice(np.array([-1.0, 1.0]), (1 << BITS, SIGNS))


def _split(key: np.ndarray, count: np.ndarray, place: np.ndarray, passages: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How often each passage has each of the dimensions that have a place, and passage and dimension of all other words."""
    at = place[key & ((1 << BITS) - 1)]
    own = at >= 0
    counts = np.zeros((passages, DENSE), np.float32)
    counts[key[own] >> BITS, at[own]] = count[own]
    rest = np.repeat(key[~own], count[~own]).astype(np.int64)
    return counts, rest >> BITS, rest & ((1 << BITS) - 1)


def _multiply(state, columns: int):
    """Sums of A'(A basis) by block of dimensions, where A holds the unit TF-IDF rows of all passages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, basis = state.value
        often = np.argsort(idf, kind="stable")[:DENSE]
        place = np.full(1 << BITS, -1, np.int16)
        place[often] = np.arange(DENSE)
        if basis is None:
            column, sign = _signs(columns)
            basis = np.zeros((1 << BITS, columns), np.float32)
            np.add.at(basis, (np.arange(1 << BITS)[:, None], column), sign)
        slices = [slice(a, min(a + SLICE, columns)) for a in range(0, columns, SLICE)]
        weighted = [np.ascontiguousarray(basis[:, of], np.float32) * idf[:, None] for of in slices]
        del basis
        totals = [np.zeros((1 << BITS, of.stop - of.start), np.float32) for of in slices]
        for key in _passages(batches):
            first, count = _counted(key)
            key = key[first]
            square = np.bincount(key >> BITS, (count * idf[key & ((1 << BITS) - 1)]) ** 2).astype(np.float32)[:, None]
            counts, passage, dim = _split(key, count, place, len(square))
            size = np.bincount(passage, minlength=len(square))
            some = np.flatnonzero(size)
            to_passages = plan_of(dim, size[some])
            order = np.argsort(dim.astype(np.uint16), kind="stable")
            size = np.bincount(dim, minlength=1 << BITS)
            at = np.flatnonzero(size)
            to_words = plan_of(passage[order], size[at])
            for i in range(len(slices)):
                part = counts @ weighted[i][often]
                part[some] += run_sums(weighted[i], to_passages)
                # a word's row of the product is its weight times the sum over its passages, each over its norm twice
                part /= square
                totals[i][often] += counts.T @ part
                totals[i][at] += run_sums(part, to_words)
        total = np.concatenate(totals, axis=1) * idf[:, None]
        for k in range(len(total) // _DIM_BLOCK):
            block = total[k * _DIM_BLOCK : (k + 1) * _DIM_BLOCK]
            if block.any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([block.tobytes()], pa.binary())], ["block", "sums"])

    return run


def _add_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by block: one sum for each, of which one at a time is held."""
    own, total = None, None

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([own], pa.int32()), pa.array([total.astype(np.float32).tobytes()], pa.binary())], ["block", "sums"])

    for batch in batches:
        for k, sums in zip(batch["block"].to_pylist(), batch["sums"], strict=True):
            if k != own:
                if own is not None:
                    yield out()
                own, total = k, 0.0
            total = total + np.frombuffer(sums.as_buffer(), np.float32).astype(np.float64)
    if own is not None:
        yield out()


def orthonormal(product: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Left singular vectors and singular values, greatest first, by the small Gram matrix; what is 0 beside the
    greatest is left out."""
    gram = np.zeros((product.shape[1],) * 2)
    for i in range(0, len(product), 4096):
        part = product[i : i + 4096].astype(np.float64)
        gram += part.T @ part
    squares, vectors = np.linalg.eigh(gram)
    keep = np.flatnonzero(squares > 1e-12 * max(squares[-1], 1e-300))[::-1]
    values = np.sqrt(squares[keep])
    return product @ (vectors[:, keep] / values).astype(np.float32), values


def latent_space(passages: DataFrame, idf: np.ndarray, rank: int = RANK) -> np.ndarray:
    """The leading right singular vectors of the TF-IDF matrix of the passages of ``hashed`` texts, each over its singular
    value, by randomised subspace iteration."""
    spark = passages.sparkSession
    basis, columns = None, rank + SPARE
    for _ in range(ROUNDS + 1):
        width = columns if basis is None else basis.shape[1]
        sent = spark.sparkContext.broadcast((idf, None if basis is None else basis.astype(np.float16)))
        sums = passages.mapInArrow(_multiply(sent, width), "block int, sums binary").repartition(6, "block").sortWithinPartitions("block").mapInArrow(_add_blocks, "block int, sums binary").toArrow()
        sent.destroy()
        product = np.zeros((1 << BITS, width), np.float32)
        for block, part in zip(sums["block"].to_pylist(), sums["sums"], strict=True):
            product[block * _DIM_BLOCK : (block + 1) * _DIM_BLOCK] = np.frombuffer(part.as_buffer(), np.float32).reshape(-1, width)
        # the product is A'A applied to the basis before: its left singular vectors are the right ones of A
        basis, squares = orthonormal(product)
    known = squares[:rank] > 1e-6 * squares[:1]
    return basis[:, :rank][:, known] / np.sqrt(squares[:rank][known]).astype(np.float32)


@dataclass
class Item:
    number: int
    words: list[int]
    answer: list[int]


def items_of(rows: list[tuple[int, str | None]]) -> list[Item]:
    out = []
    for number, text in rows:
        data, offsets = utf8(pa.array([text or ""], pa.string()))
        word = word_tokens(data, offsets)[0].tolist()
        cut = [p for p in (text or "").replace("?", ".").replace("!", ".").replace("\n", ".").split(".") if p.strip()]
        last = word_tokens(*utf8(pa.array([cut[-1] if len(cut) > 1 else ""], pa.string())))[0].tolist()
        if word:
            out.append(Item(number, word, last if 3 <= len(last) < len(word) else word[-max(1, len(word) // 3) :]))
    return out


def common_subsequence(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, a bit for each word of ``a``."""
    places: dict[int, int] = defaultdict(int)
    for i, x in enumerate(a):
        places[x] |= 1 << i
    get = places.get
    full = (1 << len(a)) - 1
    row = full
    for x in b:
        hit = row & get(x, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def passage_starts(n: int) -> list[int]:
    """Where the passages of an item of ``n`` words begin: one of the whole item, or windows that tile a long one."""
    if n <= LONG:
        return [0]
    k = -(-n // WINDOW)
    return [i * (n - WINDOW) // (k - 1) for i in range(k)]


def seed_rule(n: int) -> tuple[int, int, int]:
    """Of an item of ``n`` words of which as many as ``COMMON`` allows are replaced or dropped: the length of a run of
    words that is left for certain (``SEED`` at most), how many runs of that length are, and how many words may go before
    the first."""
    lost = n - math.ceil(COMMON * n)
    k = min(SEED, -(-(n - lost) // (lost + 1)))
    return k, max(1, n - k + 1 - k * lost), k * lost


def word_runs(word: np.ndarray, row: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprint of the ``k`` words from each word on, and whether they are of one row."""
    n = max(0, len(word) - k + 1)
    value = word[:n]
    for i in range(1, k):
        value = mix(value * np.uint64(BASE) + word[i : n + i])
    return value, row[:n] == row[k - 1 : n + k - 1]


class Seeds:
    """The word runs of items of one run length, sorted, and a table of which top bits they have."""

    def __init__(self, k: int, numbers: list[int], items: list[Item]):
        self.k = k
        words = [np.array(items[i].words, np.uint64) for i in numbers]
        parts = [np.unique(word_runs(w, np.zeros(len(w), np.int64), k)[0]) for w in words]
        key, item = np.concatenate(parts), np.repeat(np.array(numbers), [len(x) for x in parts])
        order = np.argsort(key, kind="stable")
        self.key, self.item = key[order], item[order]
        self.known = np.zeros(1 << 18, bool)
        self.known[self.key >> np.uint64(46)] = True

    def regions(self, value: np.ndarray, whole: np.ndarray, last: np.ndarray, sizes: np.ndarray, needs: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(item, a word in the region, first word, end) where an item's words may stand; ``last`` ends each word's row."""
        none = np.zeros(0, np.int64)
        at = np.flatnonzero(self.known[value >> np.uint64(46)] & whole)
        low, high = (np.searchsorted(self.key, value[at], side) for side in ("left", "right"))
        n = high - low
        at = np.repeat(at, n)
        if not len(at):
            return none, none, none, none
        item = self.item[np.repeat(low - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(len(at))]
        order = np.lexsort((at, item))
        at, item = at[order], item[order]
        place = item * (len(last) + 1) + at
        count = np.searchsorted(place, item * (len(last) + 1) + np.minimum(at + sizes[item], last[at])) - np.arange(len(at))
        keep = count >= needs[item]
        at, item = at[keep], item[keep]
        if not len(at):
            return none, none, none, none
        # runs of near hits, cut so that none is longer than its item
        new = np.r_[True, (item[1:] != item[:-1]) | (last[at[1:]] != last[at[:-1]]) | (at[1:] - at[:-1] > sizes[item[1:]])]
        step = (at - at[np.flatnonzero(new)][np.cumsum(new) - 1]) // sizes[item]
        first = np.flatnonzero(new | np.r_[False, step[1:] != step[:-1]])
        final = np.r_[first[1:], len(at)] - 1
        return item[first], at[first], at[first] - before[item[first]], at[final] + sizes[item[first]]


@dataclass
class Matcher:
    space: np.ndarray  # of each dimension: its weighted place in the latent space, in half precision
    items: list[Item]

    def open(self) -> None:
        if self.space.dtype == np.float32:
            return
        # row by row: taking rows of an array that lies column by column would copy all of it each time
        self.space = np.ascontiguousarray(np.concatenate([self.space, np.zeros((1, self.space.shape[1]), np.float16)]), np.float32)
        self.sizes = np.array([len(i.words) for i in self.items])
        #: The words of each item, told apart by item.
        self.known = np.unique(np.concatenate([np.array(i.words, np.uint64) ^ mix(np.array([n], np.uint64)) for n, i in enumerate(self.items)]))
        passages: dict[int, list[tuple[int, int, np.ndarray]]] = defaultdict(list)
        seeds: dict[int, list[int]] = defaultdict(list)
        rules = [seed_rule(n) for n in self.sizes.tolist()]
        for number, item in enumerate(self.items):
            n = len(item.words)
            rows = self.space[dims(np.array(item.words, np.uint64))]
            for start in passage_starts(n):
                r = (rows[start : start + WINDOW] if n > LONG else rows).sum(0)
                passages[SHORT_WINDOW if n < SHORT else WINDOW].append((number, start, r / (np.linalg.norm(r) + 1e-9)))
            seeds[rules[number][0]].append(number)
        self.needs, self.before = (np.array([r[j] for r in rules], np.int64) for j in (1, 2))
        #: (windows' length in strides, passages' items, their places in these, their vectors)
        self.groups = [
            (window // STRIDE, *(np.array(x, t) for x, t in zip(zip(*of[i : i + BLOCK], strict=True), (np.int64, np.int64, np.float32), strict=True)))
            for window, of in sorted(passages.items())
            for i in range(0, len(of), BLOCK)
        ]
        self.seeds = [Seeds(k, of[i : i + SEED_ITEMS], self.items) for k, of in sorted(seeds.items()) for i in range(0, len(of), SEED_ITEMS)]

    def _strides(self, dim: np.ndarray, block: np.ndarray) -> np.ndarray:
        """Sums of the places of each stride's words. The last row of the space is what is no word."""
        place = block[:, None] + np.arange(STRIDE)
        filled = np.where(place < np.r_[block[1:], len(dim)][:, None], np.r_[dim, 0][np.minimum(place, len(dim))], len(self.space) - 1)
        filled = np.ascontiguousarray(filled.T)
        total = np.take(self.space, filled[0], axis=0)
        rows = np.empty_like(total)
        for at in filled[1:]:
            # clip: what is in range needs no second buffer
            total += np.take(self.space, at, axis=0, out=rows, mode="clip")
        return total

    def _may_hold(self, word: np.ndarray, item: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Whether so many of a region's words are the item's that they can have ``COMMON`` of it in common."""
        size = np.maximum(end - start, 0)
        ends = np.cumsum(size)
        place = np.arange(int(size.sum())) + np.repeat(start - (ends - size), size)
        key = word[place] ^ np.repeat(mix(item.astype(np.uint64)), size)
        hit = self.known[np.minimum(np.searchsorted(self.known, key), len(self.known) - 1)] == key
        total = np.r_[0, np.cumsum(hit)]
        return total[ends] - total[ends - size] >= COMMON * self.sizes[item]

    def _nearest(self, number: int, sums: np.ndarray, a: int, b: int, row: np.ndarray) -> float:
        """The greatest cosine of an item's passages with the windows at strides a to b."""
        best = -1.0
        for strides, numbers, _, vectors in self.groups:
            mine = vectors[numbers == number]
            if len(mine):
                for j in range(a, b):
                    window = sums[j : j + strides][row[j : j + strides] == row[j]].sum(0)
                    best = max(best, float((mine @ window).max() / (np.linalg.norm(window) + 1e-9)))
        return best

    def matches(self, text: pa.Array) -> Iterator[tuple[int, Item, float, float]]:
        """(row, item, cosine, part of the item in common)."""
        if not self.items:
            return
        self.open()
        data, offsets = utf8(text)
        for a, b in pieces(offsets, PIECE):
            word, row = word_tokens(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            if not len(word):
                continue
            first, last = np.searchsorted(row, np.arange(b - a), "left"), np.searchsorted(row, np.arange(b - a), "right")
            block = np.flatnonzero((np.arange(len(row)) - first[row]) % STRIDE == 0)
            sums = self._strides(dims(word), block)
            own = row[block]
            #: of each row and item: (first word, end, cosine or None) of regions
            regions: dict[tuple[int, int], list[tuple[int, int, float | None]]] = defaultdict(list)
            width, window = 1, sums.copy()
            norm = None
            for strides, numbers, starts, vectors in self.groups:
                # groups come by their windows' length, so a longer window goes on from a shorter one
                if strides != width or norm is None:
                    for step in range(width, strides):
                        apart = np.flatnonzero(own[step:] != own[:-step])
                        kept_rows = window[apart]
                        window[:-step] += sums[step:]
                        window[apart] = kept_rows
                    width, norm = strides, np.sqrt(np.einsum("ij,ij->i", window, window)) + 1e-9
                product = window @ vectors.T
                # a little less than what is asked for, so that rounding loses nothing; what passes is divided
                least = np.float32(COSINE - 1e-4) * norm
                some = np.flatnonzero(product.max(1) >= least)
                at, which = np.nonzero(product[some] >= least[some, None])
                at = some[at]
                cosine = product[at, which] / norm[at]
                near = cosine >= COSINE
                at, which, cosine = at[near], which[near], cosine[near]
                size = self.sizes[numbers[which]]
                low = block[at] - starts[which] - size // 2
                high = block[at] + size // 2 + np.where(size > LONG, size - starts[which], np.maximum(size, strides * STRIDE))
                for r, i, x, y, c in zip(own[at].tolist(), numbers[which].tolist(), low.tolist(), high.tolist(), cosine.tolist(), strict=True):
                    regions[r, i].append((x, y, c))
            for key, of in regions.items():
                of.sort()
                merged = [of[0]]
                last_low = of[0][0]
                for x, y, c in of[1:]:
                    if x - last_low <= WINDOW:
                        merged[-1] = (merged[-1][0], max(merged[-1][1], y), max(merged[-1][2], c))
                    else:
                        merged.append((x, y, c))
                    last_low = x
                regions[key] = merged
            runs = {k: word_runs(word, row, k) for k in {s.k for s in self.seeds}}
            for seeds in self.seeds:
                for i, p, x, y in zip(*(z.tolist() for z in seeds.regions(*runs[seeds.k], last[row], self.sizes, self.needs, self.before)), strict=True):
                    regions[int(row[p]), i].append((x, y, None))
            if not regions:
                continue
            flat = [(r, i, x, y, -1.0 if c is None else c) for (r, i), spans in regions.items() for x, y, c in spans]
            r, i, x, y = (np.array(z, np.int64) for z in list(zip(*flat, strict=True))[:4])
            x, y = np.maximum(first[r], x), np.minimum(last[r], y)
            kept: dict[tuple[int, int], list[tuple[int, int, float]]] = defaultdict(list)
            for at in np.flatnonzero(self._may_hold(word, i, x, y)).tolist():
                kept[flat[at][:2]].append((int(x[at]), int(y[at]), flat[at][4]))
            for (r, i), spans in kept.items():
                item, best, where = self.items[i], (0.0, 0.0), (0, 0)
                for x, y, c in spans:
                    region = word[x:y].tolist()
                    share = common_subsequence(item.words, region) / len(item.words)
                    if share >= COMMON and common_subsequence(item.answer, region) >= ANSWER * len(item.answer) and (share, c) > best:
                        best, where = (share, c), (x, y)
                if best[0]:
                    near = best[1] if best[1] >= COSINE else self._nearest(i, sums, *np.searchsorted(block, where).tolist(), own)
                    yield a + r, item, near, best[0]


def matchers(docs: DataFrame, benchmark: DataFrame, fit_documents: None = None) -> Iterator:
    """A broadcast matcher for each block of items. ``docs(doc_id, text)``, ``benchmark(item_id, text)``. The latent space is
    fitted on all passages of both; ``fit_documents`` has no other value than None, which says so."""
    spark = docs.sparkSession
    items = benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select("item_id", "text")
    blocks = -(-items.count() // BLOCK)
    if not blocks:
        return
    seen, path = runtime.written(hashed(docs))
    idf = inverse_frequencies(seen)
    # the items' words are written too: made within the fit's tasks, they would take each a second Python worker
    asked, asked_path = runtime.written(hashed(items))
    fitted = seen.union(asked).coalesce(runtime.parts(docs, FIT_BYTES, 6))
    space = (latent_space(fitted, idf, RANK) * idf[:, None]).astype(np.float16)
    for done in (path, asked_path):
        runtime.forget(spark, done)
    for k in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).collect()
        yield spark.sparkContext.broadcast(Matcher(space, items_of(sorted((r.item_id, r.text) for r in rows))))


def find(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, cosine, common) of each document that holds an item."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")

    def search(matcher):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                got = [(r, i.number, c, s) for r, i, c, s in matcher.value.matches(batch["text"])]
                row, item, cosine, share = zip(*got, strict=True) if got else [[]] * 4
                ids = batch["doc_id"].take(pa.array(row, pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, pa.array(item, pa.int64()), pa.array(cosine, pa.float64()), pa.array(share, pa.float64())], ["doc_id", "item_id", "cosine", "common"])

        return run

    schema = "doc_id bigint, item_id bigint, cosine double, common double"
    found = None
    for matcher in matchers(docs, benchmark):
        part = docs.mapInArrow(search(matcher), schema)
        found = part if found is None else found.union(part)
    return docs.sparkSession.createDataFrame([], schema) if found is None else found


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no item, with all their columns."""
    kept = docs
    for matcher in matchers(docs.select("doc_id", "text"), benchmark):

        def run(batches: Iterator[pa.RecordBatch], matcher=matcher) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                keep[[r for r, *_ in matcher.value.matches(batch["text"])]] = False
                yield batch.filter(pa.array(keep))

        kept = kept.mapInArrow(run, docs.schema)
    return kept


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(*(runtime.table(spark, sf_dir, t) for t in ("documents", "benchmark")))
