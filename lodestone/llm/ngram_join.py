"""N-gram Jaccard join by signature trees: documents whose word-shingle sets are similar, exactly, as components.

1. Order. Shingles are ordered by how frequent they are in all documents (a table of fixed size, by hash; any order gives
   right results, this one keeps what is common out of the way).
2. Candidates. Of linked sets, each has one of the other's shingles among its first size - ceil(threshold * size) + 1.
   Documents that share such a shingle with no set of a size and place that may link are found first, by sizes and places
   alone. Any other goes to the buckets of those shingles, as its size and a bitmap of its shingles, whose length follows from the size
   (the tree of the next shorter bitmaps gets folded ones of sets that can link into it). A bucket holds signature trees:
   leaves are (shingle, document), nodes hold OR-combined bitmaps, size ranges and ranges of shingles. A dual traversal
   drops node pairs that have no shingle in common, whose sizes can't link, whose greatest possible overlap is too
   small, or whose documents are connected already; what is left at the leaves gives candidate edges, a forest at most.
   Shingles that more than ``HOT`` documents may have go by (shingle, size class), and those of one class are taken as
   candidates of one another: a document holds them among its first only if nearly all of it is as common.
3. Components of the candidate edges hold every link. Their sets meet in tasks as signature trees of exact sets, whose
   shingles are numbered by their words, not by hashes, and the same traversal compares what it can't drop. Components of
   over ``CHUNK`` shingles are dealt: every chunk meets itself and a fixed number of pivots, which joins most copies; then
   only documents that are still apart from the largest part of their component meet all chunks.
4. Links become components again; equal sets are one class, joined by (size, 128-bit print of the set), salted.

No task holds a group of copies and no group is expanded into its pairs; nothing but counts and the table of frequencies
reaches the driver. Hashes of shingles have 64 bits; they decide which sets are equal (by prints of 128 bits) and the size
of a set, while links between different sets are decided by words.

Defined cases: null or empty text, or text of white space, has no shingles and is linked with nothing; a null doc_id
takes no part and has a null component; rows of one doc_id are nodes of one name; extra columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import runtime
from .components import components
from .suffix_dedup import concat, spread, squeeze
from .text_arrays import mix, numbered_shingles, pieces, ranges, row_starts, shingles, utf8

#: Links need 100 * intersection >= THRESHOLD * union.
SHINGLE, THRESHOLD = 3, 90
#: Bytes of stored input for each bucket, and the most partitions of a shuffle; beyond it one holds several buckets.
BUCKET_BYTES, MOST_PARTITIONS = 6 << 20, 1 << 16
#: Shingles of a task of exact sets; bytes of the texts of small tasks that share a tree; documents of a component that
#: meet all its chunks.
CHUNK, SMALL_BYTES, PIVOTS = 1 << 19, 1 << 22, 256
#: Children of a tree's node; node pairs looked at once, and words of their bitmaps.
FANOUT, BLOCK, BLOCK_WORDS = 8, 4096, 1 << 18
#: Least and most 64-bit words of a candidate's bitmap; between them there are so many shingles a word, over the part of
#: two linked sets that may differ.
LEAST_WORDS, MOST_WORDS, PER_WORD = 4, 64, 4.2
#: Cells of the table of frequencies, and from how many documents on a shingle is hot.
CELLS, HOT = 1 << 22, 1 << 14
#: What comes less often than so is rare, however often.
COMMON = 8
#: Partial sums of a hot class of equal sets.
SALTS = 64
#: Words of the bitmaps of a bucket's tree, but for those of one shingle.
TREE_WORDS = 1 << 20
#: Entries that a task holds before it sends them: what goes to a bucket at once stays well under a megabyte, as larger rows
#: fill the executors' heaps.
HELD = 1 << 17
#: Bits of the filter of doc_ids, as a power of two: 8 MB at any size.
FILTER_BITS = 26


@lru_cache(maxsize=4)
def classes(threshold: int) -> np.ndarray:
    """First size of each size class: what links with a class is in it or next to it."""
    out = [1]
    while out[-1] < 1 << 40:
        out.append(out[-1] * 100 // threshold + 1)
    return np.array(out)


def set_prints(value: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit prints of each row's whole set; 0 where it is empty."""
    size = np.diff(starts)
    out = []
    for salt in (0, 0x5851F42D4C957F2D):
        sums = np.r_[np.uint64(0), np.cumsum(mix(value ^ np.uint64(salt)), dtype=np.uint64)]
        out.append(np.where(size > 0, mix(sums[starts[1:]] - sums[starts[:-1]] + size.astype(np.uint64)), np.uint64(0)))
    return out[0], out[1]


def per_word(threshold: int) -> int:
    """The most shingles for each word of a bitmap: the less linked sets may differ, the fewer bits tell them from others."""
    return int(PER_WORD * (100 + threshold) / max(1, 100 - threshold))


def words_of(size: np.ndarray, threshold: int) -> np.ndarray:
    """Words of a candidate's bitmap: a power of two."""
    need = np.clip(-(-size // per_word(threshold)), LEAST_WORDS, MOST_WORDS)
    return (1 << np.ceil(np.log2(need)).astype(np.int64)).astype(np.int64)


def flat_bitmaps(value: np.ndarray, row: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Bitmaps of so many words one after the other: a bit for each of a row's values, by its low bits."""
    out = np.zeros(int(words.sum()), np.uint64)
    at = (value & (words[row] * 64 - 1).astype(np.uint64)).astype(np.int64)
    np.bitwise_or.at(out, (np.cumsum(words) - words)[row] + (at >> 6), np.uint64(1) << (at & 63).astype(np.uint64))
    return out


def connect(label: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Labels after joining ``u`` and ``v``; each is the least number of its component, before and after."""
    while True:
        a, b = label[u], label[v]
        low, high = np.minimum(a, b), np.maximum(a, b)
        if (low == high).all():
            return label
        np.minimum.at(label, high, low)
        while (label[label] != label).any():
            label = label[label]


class SignatureTree:
    """Levels of nodes over sets: OR-combined bitmaps, size ranges, ranges of the values that they are ordered by, and by
    how much sets outnumber their bits. ``owner`` names the node of a component graph that each set belongs to."""

    def __init__(self, bits: np.ndarray, size: np.ndarray, order: np.ndarray, owner: np.ndarray):
        self.owner, self.n = owner, len(size)
        slack = size - np.bitwise_count(bits).sum(1)
        self.levels = [(bits, size, size, slack, order, order)]
        while len(self.levels[-1][1]) > FANOUT:
            bits, low, high, slack, first, last = self.levels[-1]
            at = np.arange(0, len(low), FANOUT)
            ends = np.r_[at[1:], len(low)] - 1
            self.levels.append((np.bitwise_or.reduceat(bits, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(slack, at), first[at], last[ends]))

    def names(self, label: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest label of the sets of each node."""
        at, own = np.arange(0, self.n, FANOUT**level), label[self.owner]
        return np.minimum.reduceat(own, at), np.maximum.reduceat(own, at)


Leaf = Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def traverse(left: SignatureTree, right: SignatureTree, label: np.ndarray, threshold: int, leaf: Leaf, ordered: bool = False) -> np.ndarray:
    """Labels after the dual traversal of two trees; a tree may meet itself. ``leaf`` says of set pairs that can't be
    dropped and aren't connected which to join. With ``ordered`` only sets of equal order values meet."""
    itself = left is right
    block = max(16, min(BLOCK, BLOCK_WORDS // left.levels[0][0].shape[1]))

    def walk(level: int, x: np.ndarray, y: np.ndarray, label: np.ndarray) -> np.ndarray:
        a, b = left.levels[level], right.levels[level]
        for i in range(0, len(x), block):
            p, q = x[i : i + block], y[i : i + block]
            fits = (100 * a[2][p] >= threshold * b[1][q]) & (100 * b[2][q] >= threshold * a[1][p])
            if ordered:
                fits &= (a[4][p] <= b[5][q]) & (b[4][q] <= a[5][p])
            p, q = p[fits], q[fits]
            most = np.bitwise_count(a[0][p] & b[0][q]).sum(1) + np.minimum(a[3][p], b[3][q])
            fits = (100 + threshold) * most >= threshold * (a[1][p] + b[1][q])
            p, q = p[fits], q[fits]
            (low, high), (other, top) = left.names(label, level), right.names(label, level)
            apart = ~((low[p] == high[p]) & (other[q] == top[q]) & (low[p] == other[q]))
            p, q = p[apart], q[apart]
            if not len(p):
                continue
            if level:
                step = np.arange(FANOUT)
                u = np.broadcast_to(p[:, None, None] * FANOUT + step[:, None], (len(p), FANOUT, FANOUT)).ravel()
                v = np.broadcast_to(q[:, None, None] * FANOUT + step[None, :], (len(q), FANOUT, FANOUT)).ravel()
                keep = (u < len(left.levels[level - 1][1])) & (v < len(right.levels[level - 1][1]))
                if itself:
                    keep &= u <= v
                label = walk(level - 1, u[keep], v[keep], label)
            else:
                keep = leaf(p, q, label)
                label = connect(label, left.owner[p[keep]], right.owner[q[keep]])
        return label

    level = min(len(left.levels), len(right.levels)) - 1
    x, y = (g.ravel() for g in np.meshgrid(np.arange(len(left.levels[level][1])), np.arange(len(right.levels[level][1])), indexing="ij"))
    keep = x <= y if itself else np.ones(len(x), bool)
    return walk(level, x[keep], y[keep], label)


def _fresh(value: np.ndarray, row: np.ndarray, ids: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(values, rows, sizes, doc_ids) of the sets that can link with another: of equal ones only that of the least
    doc_id, and none that is too small to differ and link."""
    starts = row_starts(row, len(ids))
    count = np.diff(starts)
    one, two = set_prints(value, starts)
    order = np.lexsort((ids, two, one))
    fresh = np.zeros(len(ids), bool)
    fresh[order[np.r_[True, (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])]]] = True
    fresh &= 100 * count >= threshold * (count + 1)
    keep = fresh[row]
    return value[keep], np.cumsum(fresh)[row[keep]] - 1, count[fresh], ids[fresh]


def _documents(batches: Iterator[pa.RecordBatch], threshold: int, size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        batch = batch.filter(batch["doc_id"].is_valid())
        data, offsets = utf8(batch["text"])
        ids = batch["doc_id"].to_numpy(zero_copy_only=False).astype(np.int64)
        for a, b in pieces(offsets):
            value, row = shingles(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], size)
            value, row, count, own = _fresh(value, row, ids[a:b], threshold)
            if len(value):
                yield value, row, count, own


def _cell(value: np.ndarray) -> np.ndarray:
    return (value >> np.uint64(64 - CELLS.bit_length() + 1)).astype(np.int64)


def frequencies(docs: DataFrame, threshold: int, size: int) -> np.ndarray:
    """The binary logarithm of how many documents have a shingle of each cell of the table. A task sends only cells that
    stand out of its own, and sums below ``COMMON`` count as 0; the driver sees a number a cell at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, np.int32)
        for value, *_ in _documents(batches, threshold, size):
            np.add.at(total, _cell(value), 1)
        mean = float(total.sum(dtype=np.int64)) / CELLS
        at = np.flatnonzero(total > max(1, mean + 1.5 * mean**0.5))
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at].astype(np.int64))], ["cell", "n"])

    with runtime.freeing(docs.sparkSession):
        counted = docs.mapInArrow(run, "cell int, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).where(f"n >= {COMMON}").toArrow()
    out = np.zeros(CELLS, np.uint8)
    out[counted["cell"].to_numpy()] = np.log2(counted["n"].to_numpy()).astype(np.uint8)
    return out


SENT = "bucket int, body binary, hot binary, u bigint, v bigint"


def _bucket(value: np.ndarray, buckets: int) -> np.ndarray:
    return ((mix(value) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _sent(rows: list[tuple[int, bytes | None, bytes | None]], u: np.ndarray, v: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Messages for buckets, and edges that only pass through, over all of them."""
    n = len(u)
    bucket = pa.array(np.r_[np.array([r[0] for r in rows], np.int32), _bucket(u.view(np.uint64), buckets).astype(np.int32)])
    blobs = [pa.array([r[i] for r in rows] + [None] * n, pa.binary()) for i in (1, 2)]
    ends = [pa.concat_arrays([pa.nulls(len(rows), pa.int64()), pa.array(e, pa.int64())]) for e in (u, v)]
    return pa.RecordBatch.from_arrays([bucket, *blobs, *ends], ["bucket", "body", "hot", "u", "v"])


def _star(key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of (key, doc) entries: one entry for each key, with its least doc, and edges from the others to it."""
    order = np.lexsort((doc, key))
    key, doc = key[order], doc[order]
    first = np.r_[True, key[1:] != key[:-1]] if len(key) else np.zeros(0, bool)
    least = doc[np.flatnonzero(first)][np.cumsum(first) - 1] if len(key) else doc
    other = doc != least
    edge = np.unique(np.stack([doc[other], least[other]]), axis=1) if other.any() else np.zeros((2, 0), np.int64)
    return key[first], doc[first], edge[0], edge[1]


def _by_bucket(place: np.ndarray, entries: tuple[np.ndarray, ...]) -> Iterator[tuple[int, tuple[np.ndarray, ...]]]:
    """Each bucket, and what of the entries goes there."""
    order = np.argsort(place, kind="stable")
    place, entries = place[order], tuple(e[order] for e in entries)
    edge = np.flatnonzero(np.r_[True, place[1:] != place[:-1]]) if len(place) else place
    for a, b in zip(edge.tolist(), [*edge.tolist(), len(place)][1:], strict=True):
        yield int(place[a]), tuple(e[a:b] for e in entries)


def first_shingles(value: np.ndarray, row: np.ndarray, count: np.ndarray, weight: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(value, row, how many of the set come from it on) of the shingles by which a set can't miss one that it links with."""
    order = np.lexsort((value, weight[_cell(value)], row))
    value, starts = value[order], np.cumsum(count) - count
    place = np.arange(len(row)) - starts[row]
    keep = place < (count + 1 - -(-threshold * count // 100))[row]
    return value[keep], row[keep], (count[row] - place)[keep]


def _sign(buckets: int, threshold: int, size: int, shared, bare: bool = False):
    """What documents send to buckets. If ``bare``, it goes without bitmaps, and documents with hot shingles pass through."""
    bounds = classes(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = shared.value
        held: list[tuple[np.ndarray, ...]] = []
        total = sets = 0

        def send() -> pa.RecordBatch:
            value, at, rest = (np.concatenate([h[i] for h in held]) for i in range(3))
            ids, count, bits = (np.concatenate([h[i] for h in held]) for i in (3, 4, 5))
            words = words_of(count, threshold)
            begins = np.cumsum(words) - words
            out: dict[int, list[bytes | None]] = {}
            hot = weight[_cell(value)] >= HOT.bit_length() - 1
            if bare:
                passing = np.unique(ids[at[hot]])
                place, entries = _bucket(value[~hot], buckets), (value[~hot], at[~hot], rest[~hot])
                for k, (part, of, left) in _by_bucket(place, entries):
                    rows, inverse = np.unique(of, return_inverse=True)
                    out[k] = [squeeze(ids[rows], count[rows], part, inverse.astype(np.uint32), left.astype(np.uint32)), None]
                return _sent([(k, *two) for k, two in out.items()], passing, passing, buckets)
            own = np.searchsorted(bounds, count[at[hot]], "right") - 1
            tagged = [mix(value[hot] ^ mix((own + step).astype(np.uint64) + np.uint64(1))) for step in (0, 1)]
            key, doc, u, v = _star(np.concatenate(tagged), np.tile(ids[at[hot]], 2))
            for blobs, place, entries in ((0, _bucket(value[~hot], buckets), (value[~hot], at[~hot], rest[~hot])), (1, _bucket(key, buckets), (key, doc))):
                for k, part in _by_bucket(place, entries):
                    if blobs:
                        body = squeeze(*part)
                    else:
                        rows, inverse = np.unique(part[1], return_inverse=True)
                        body = squeeze(ids[rows], count[rows], bits[ranges(begins[rows], words[rows])], part[0], inverse.astype(np.uint32), part[2].astype(np.uint32))
                    out.setdefault(k, [None, None])[blobs] = body
            return _sent([(k, *two) for k, two in out.items()], np.ascontiguousarray(u), v, buckets)

        for value, row, count, own in _documents(batches, threshold, size):
            bits = np.zeros(0, np.uint64) if bare else flat_bitmaps(value, row, words_of(count, threshold))
            value, row, rest = first_shingles(value, row, count, weight, threshold)
            held.append((value, row + sets, rest, own, count, bits))
            total, sets = total + len(value), sets + len(own)
            if total > HELD:
                yield send()
                held, total, sets = [], 0, 0
        if held:
            yield send()

    return run


def partners(value: np.ndarray, size: np.ndarray, rest: np.ndarray, threshold: int) -> np.ndarray:
    """Which entries (a first shingle, its set's size, how many of the set come from it on) have another one of the same
    shingle with whose set the overlap may be large enough."""
    if not len(value):
        return np.zeros(0, bool)
    order = np.lexsort((size, value))
    value, size, rest = value[order], size[order], rest[order]
    # sets x and y can link if y has at most so many shingles as x has room for, and x as y
    room = ((100 + threshold) * rest - threshold * size) // threshold
    group = np.cumsum(np.r_[False, value[1:] != value[:-1]]) << 32
    most = np.maximum.accumulate(group + room)
    before = np.r_[-1, most[:-1]]
    # the greatest but one: what a greater one takes the place of counts
    second = np.maximum.accumulate(np.minimum(group + room, before))
    last = np.searchsorted(group + size, group + room, "right") - 1
    own = (last >= np.arange(len(value))) & (most[last] == group + room)
    out = np.zeros(len(value), bool)
    out[order] = (last >= 0) & (np.where(own, second[last], most[last]) >= group + size)
    return out


def _paired(bodies: list[bytes], threshold: int) -> np.ndarray:
    """The documents of a bucket that may link with another one there. ``bodies`` is emptied on the way."""
    parts = []
    while bodies:
        ids, size, value, row, rest = spread(bodies.pop(), "i8", "i8", "u8", "u4", "u4")
        parts.append((ids[row], size[row], value, rest.astype(np.int64)))
    ids, size, value, rest = (np.concatenate(x) for x in zip(*parts, strict=True))
    return np.unique(ids[partners(value, size, rest, threshold)])


def _candidates(bodies: list[bytes], threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """A forest of edges that connects the documents of a bucket that may link. ``bodies`` is emptied on the way."""
    parts = []
    while bodies:
        parts.append(spread(bodies.pop(), "i8", "i8", "u8", "u8", "u4", "u4"))
    shift = np.cumsum([0, *(len(p[0]) for p in parts)])
    ids, size, flat, value = (np.concatenate([p[i] for p in parts]) for i in range(4))
    row = np.concatenate([p[4].astype(np.int64) + s for p, s in zip(parts, shift[:-1].tolist(), strict=True)])
    rest = np.concatenate([p[5] for p in parts]).astype(np.int64)
    del parts
    words = words_of(size, threshold)
    begins = np.cumsum(words) - words
    # rows of one doc_id are one node; a value that comes once joins nothing
    name, node = np.unique(ids, return_inverse=True)
    label = np.arange(len(name))
    order = np.argsort(value, kind="stable")
    ranked = value[order]
    twin = np.zeros(len(order), bool)
    twin[1:] = ranked[1:] == ranked[:-1]
    twin[:-1] |= twin[1:]
    shared = order[twin]
    for width in np.unique(words[row[shared]]).tolist():
        # sets of twice the width that can link with one of this width come folded
        folded = (words == 2 * width) & (threshold * size <= 100 * width * per_word(threshold))
        use = shared[((words == width) | folded)[row[shared]]]
        own, at = np.unique(row[use], return_inverse=True)
        bits = np.zeros((len(own), width), np.uint64)
        plain, two = np.flatnonzero(words[own] == width), np.flatnonzero(folded[own])
        bits[plain] = flat[ranges(begins[own[plain]], words[own[plain]])].reshape(-1, width)
        bits[two] = np.bitwise_or.reduce(flat[ranges(begins[own[two]], words[own[two]])].reshape(-1, 2, width), axis=1)
        order = np.lexsort((bits[at, 0], size[row[use]], value[use]))
        use, at = use[order], at[order]
        # only equal values meet: a tree over as many of them as a bounded number of bitmaps allows
        first = np.flatnonzero(np.r_[True, value[use][1:] != value[use][:-1]])
        runs = first[np.unique(first * width // TREE_WORDS, return_index=True)[1]]
        for a, b in zip(runs.tolist(), [*runs[1:].tolist(), len(use)], strict=True):
            label = _grown(label, value[use[a:b]], rest[use[a:b]], bits[at[a:b]], size[row[use[a:b]]], node[row[use[a:b]]], threshold)
    other = np.flatnonzero(label != np.arange(len(label)))
    return name[other], name[label[other]]


def _grown(label: np.ndarray, value: np.ndarray, rest: np.ndarray, bits: np.ndarray, size: np.ndarray, owner: np.ndarray, threshold: int) -> np.ndarray:
    """Labels after joining the owners of sets that share a value and may link, by the traversal of one tree."""
    if len(value) < 2:
        return label
    tree = SignatureTree(bits, size, value, owner)

    def leaf(p: np.ndarray, q: np.ndarray, label: np.ndarray) -> np.ndarray:
        return (value[p] == value[q]) & ((100 + threshold) * np.minimum(rest[p], rest[q]) >= threshold * (size[p] + size[q]))

    # neighbours first: most copies are connected before any pairs of nodes are looked at
    p = np.arange(len(value) - 1)
    slack = tree.levels[0][3]
    most = np.concatenate([np.bitwise_count(tree.levels[0][0][p[i : i + BLOCK]] & tree.levels[0][0][p[i : i + BLOCK] + 1]).sum(1) for i in range(0, len(p), BLOCK)])
    near = ((100 + threshold) * (most + np.minimum(slack[:-1], slack[1:])) >= threshold * (size[:-1] + size[1:])) & leaf(p, p + 1, label)
    label = connect(label, owner[p[near]], owner[p[near] + 1])
    return traverse(tree, tree, label, threshold, leaf, ordered=True)


def _meet(threshold: int, bare: bool = False):
    """Candidate edges of buckets; if ``bare``, the documents that may have some, each as an edge to itself. Rows are sorted
    by bucket."""
    none = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def edges(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], schema=none)

    def close(held: list[tuple[bytes | None, bytes | None]]) -> Iterator[pa.RecordBatch]:
        bodies, hot = ([h[i] for h in held if h[i] is not None] for i in (0, 1))
        held.clear()
        if bodies and bare:
            ids = _paired(bodies, threshold)
            yield edges(ids, ids)
        elif bodies:
            yield edges(*_candidates(bodies, threshold))
        if hot := [spread(h, "u8", "i8") for h in hot]:
            yield edges(*_star(*(np.concatenate(x) for x in zip(*hot, strict=True)))[2:])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held = None, []
        for batch in batches:
            passing = batch.filter(batch["u"].is_valid())
            if passing.num_rows:
                yield pa.RecordBatch.from_arrays([passing["u"], passing["v"]], schema=none)
            batch = batch.filter(pc.is_null(batch["u"]))
            for k, body, hot in zip(batch["bucket"].to_pylist(), batch["body"].to_pylist(), batch["hot"].to_pylist(), strict=True):
                if k != bucket and held:
                    yield from close(held)
                bucket = k
                held.append((body, hot))
        if held:
            yield from close(held)

    return run


def similar(a: np.ndarray, b: np.ndarray, threshold: int) -> bool:
    """Whether two sorted sets link."""
    if len(a) > len(b):
        a, b = b, a
    if 100 * len(a) < threshold * len(b):
        return False
    both = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return 100 * both >= threshold * (len(a) + len(b) - both)


def linked(value: np.ndarray, starts: np.ndarray, side: np.ndarray, name: np.ndarray, threshold: int) -> np.ndarray:
    """Labels of ``name``'s nodes after joining those whose sets link; sets of two sides meet across, else all."""
    label = np.arange(int(name.max(initial=-1)) + 1)
    count = np.diff(starts)
    use = np.flatnonzero(count > 0)
    # near copies mostly share their least shingle, so neighbours in this order fill a node well
    use = use[np.lexsort((count[use], value[starts[:-1][use]], side[use]))]
    sets = [value[starts[i] : starts[i + 1]] for i in use.tolist()]
    count, side, name = count[use], side[use], name[use]
    if not len(sets):
        return label
    for i in range(1, len(sets)):
        if side[i] == side[i - 1] and label[name[i]] != label[name[i - 1]] and similar(sets[i - 1], sets[i], threshold):
            label = connect(label, name[i - 1 : i], name[i : i + 1])
    words = 1 << max(3, int(4 * count.max()).bit_length() - 6)
    words = min(words, 1 << max(3, int((64 << 20) // len(sets)).bit_length() - 4))
    n = int((side == 0).sum())
    trees = []
    for a, b in ((0, n), (n, len(sets))):
        if b > a:
            flat = np.concatenate(sets[a:b])
            trees.append((a, SignatureTree(flat_bitmaps(mix(flat), np.repeat(np.arange(b - a), count[a:b]), np.full(b - a, words)).reshape(-1, words), count[a:b], np.zeros(b - a), name[a:b])))

    def leaf_of(x: int, y: int) -> Leaf:
        def leaf(p: np.ndarray, q: np.ndarray, label: np.ndarray) -> np.ndarray:
            keep, joined = np.zeros(len(p), bool), {}

            def find(k: int) -> int:
                while k in joined:
                    k = joined[k]
                return k

            for at, (j, k) in enumerate(zip((p + x).tolist(), (q + y).tolist(), strict=True)):
                u, v = find(int(label[name[j]])), find(int(label[name[k]]))
                if u != v and similar(sets[j], sets[k], threshold):
                    keep[at] = True
                    joined[max(u, v)] = min(u, v)
            return keep

        return leaf

    (x, left), (y, right) = trees[0], trees[-1]
    return traverse(left, right, label, threshold, leaf_of(x, y))


def _link(threshold: int, size: int):
    """Of rows sorted by task: (doc_id, the least doc_id that it is linked with here). Small tasks share a tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        Rows = list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
        ended: Rows = []
        held: Rows = []
        task = None

        def apart(ended: Rows, held: Rows) -> bool:
            """A task of two sides is alone in its tree; others join as long as their text is small."""
            return bool(ended and held) and (sum(len(h[3]) for h in ended + held) > SMALL_BYTES or ended[-1][1][-1] >= 0 or held[-1][1][-1] >= 0)

        def flush(held: Rows) -> pa.RecordBatch:
            ids, side, data = (np.concatenate([h[i] for h in held]) for i in (0, 1, 3))
            offsets = np.cumsum(np.r_[0, np.concatenate([h[2] for h in held])])
            value, row = numbered_shingles(data, offsets, size)
            names, name = np.unique(ids, return_inverse=True)
            label = linked(value, row_starts(row, len(ids)), side, name, threshold)
            other = np.flatnonzero(label != np.arange(len(label)))
            return pa.RecordBatch.from_arrays([pa.array(names[other]), pa.array(names[label[other]])], ["u", "v"])

        for batch in batches:
            tasks, sides = batch["task"].to_numpy(zero_copy_only=False), batch["side"].to_numpy(zero_copy_only=False)
            data, offsets = utf8(batch["text"])
            ids = batch["doc_id"].to_numpy(zero_copy_only=False)
            edge = np.flatnonzero(np.r_[True, (tasks[1:] != tasks[:-1])]).tolist() if len(tasks) else []
            for a, b in zip(edge, [*edge, len(tasks)][1:], strict=True):
                if held and tasks[a] != task:
                    if apart(ended, held):
                        yield flush(ended)
                        ended = []
                    ended, held = ended + held, []
                task = tasks[a]
                held.append((ids[a:b].astype(np.int64), sides[a:b].astype(np.int64), np.diff(offsets[a : b + 1]), data[offsets[a] : offsets[b]].copy()))
        if apart(ended, held):
            yield flush(ended)
            ended = []
        if ended or held:
            yield flush(ended + held)

    return run


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch["text"])
            out = np.zeros((3, batch.num_rows), np.int64)
            for a, b in pieces(offsets):
                value, row = shingles(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], size)
                starts = row_starts(row, b - a)
                out[:, a:b] = np.diff(starts), *(x.view(np.int64) for x in set_prints(value, starts))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *map(pa.array, out)], ["doc_id", "n_shingles", "one", "two"])

    return run


def links(docs: DataFrame, sets: DataFrame, threshold: int = THRESHOLD, size: int = SHINGLE) -> DataFrame:
    """(doc_id, component) of documents(doc_id, text) that are linked with another text; equal sets may be left out
    but for one of them. ``sets`` holds the size of each document's set."""
    spark = docs.sparkSession
    buckets = runtime.parts(docs, BUCKET_BYTES)
    shared = spark.sparkContext.broadcast(frequencies(docs, threshold, size))

    def met(sent: DataFrame, bare: bool) -> DataFrame:
        return sent.repartitionById(min(buckets, MOST_PARTITIONS), F.col("bucket")).sortWithinPartitions("bucket").mapInArrow(_meet(threshold, bare), "u bigint, v bigint")

    # bitmaps are most of what is sent, so only documents that share a first shingle with another one send theirs
    able, first = runtime.written(met(docs.mapInArrow(_sign(buckets, threshold, size, shared, True), SENT), True).select(F.col("u").alias("doc_id")).distinct())
    candidates, path = runtime.written(components(met(holding(docs, able, _sign(buckets, threshold, size, shared), SENT), False)))
    shared.destroy()
    out = confirmed(docs, sets, candidates, threshold, size)
    for old in (first, path):
        runtime.forget(spark, old)
    return out


Step = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def holding(docs: DataFrame, ids: DataFrame, then: Step = iter, schema: str | None = None) -> DataFrame:
    """The rows of docs(doc_id, text) whose doc_id may be in ``ids``: all that are, and such others as share a bit of a filter
    of fixed size, which the join after it drops. Texts that join nothing are not shuffled for it. What ``then`` makes of these
    rows comes from the same Python worker, as each further one would hold memory of its own."""
    spark = docs.sparkSession
    bit = F.expr(f"shiftrightunsigned(xxhash64(doc_id), {64 - FILTER_BITS})")
    words = ids.select(bit.alias("bit")).groupBy(F.expr("bit >> 6").alias("word")).agg(F.expr("bit_or(shiftleft(1L, CAST(bit & 63 AS int)))").alias("bits")).toArrow()
    table = np.zeros(1 << FILTER_BITS - 6, np.int64)
    table[words["word"].to_numpy()] = words["bits"].to_numpy()
    shared = spark.sparkContext.broadcast(table)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch["bit"].to_numpy()
            yield batch.select(["doc_id", "text"]).filter(pa.array(shared.value[at >> 6] >> (at & 63) & 1 == 1))

    docs = docs.select("doc_id", "text")
    return docs.withColumn("bit", bit).mapInArrow(lambda batches: then(kept(batches)), schema or docs.schema)


def confirmed(docs: DataFrame, sets: DataFrame, candidates: DataFrame, threshold: int, size: int) -> DataFrame:
    """(doc_id, component) of the documents whose sets link within components of candidates(doc_id, component), decided by
    words: the exact step of ``links``, for candidates of any origin."""
    spark = docs.sparkSession
    partitions = min(runtime.parts(docs, BUCKET_BYTES), MOST_PARTITIONS)

    def compared(tasks: DataFrame, ids: DataFrame) -> DataFrame:
        """Edges found in tasks(doc_id, task, side), whose doc_ids are those of ``ids``."""
        dealt = holding(docs, ids).join(tasks, "doc_id").repartition(partitions, "task").sortWithinPartitions("task", "side")
        return dealt.select("task", "side", "doc_id", "text").mapInArrow(_link(threshold, size), "u bigint, v bigint")

    weight = sets.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.sum("n_shingles").alias("weight"))
    weighed = candidates.join(weight, "doc_id")
    totals = weighed.groupBy("component").agg(F.count("*").alias("n"), F.ceil(F.sum("weight") / CHUNK).alias("chunks"))
    placed = candidates.join(totals, "component").withColumn("chunk", F.pmod(F.xxhash64("doc_id"), "chunks"))
    chunked = F.xxhash64("component", "chunk")
    own = placed.select("doc_id", F.when(F.col("chunks") > 1, chunked).otherwise(F.col("component")).alias("task"), F.lit(-1).alias("side"))
    pivots = placed.where((F.col("chunks") > 1) & (F.pmod(F.xxhash64("doc_id", F.lit(1)), "n") < PIVOTS))
    pivots = pivots.withColumn("mine", F.col("chunk")).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1))).where("chunk <> mine")
    found, kept = runtime.written(compared(own.union(pivots.select("doc_id", chunked.alias("task"), F.lit(-1).alias("side"))), candidates))
    large = placed.where("chunks > 1")
    if large.limit(1).count():
        named = large.join(components(found).withColumnRenamed("component", "part"), "doc_id", "left").withColumn("part", F.coalesce("part", "doc_id"))
        sizes = named.groupBy("component", "part").count()
        main = sizes.groupBy("component").agg(F.max_by("part", F.struct("count", "part")).alias("main"))
        apart = named.join(main, "component").withColumn("rest", F.col("part") != F.col("main"))
        groups = apart.where("rest").join(weight, "doc_id").groupBy("component").agg(F.ceil(F.sum("weight") / CHUNK).alias("groups"))
        apart = apart.join(groups, "component").withColumn("group", F.pmod(F.xxhash64("doc_id"), "groups"))
        numbers = lambda count: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(count) - 1))
        named_task = lambda kind, *names: F.xxhash64(F.lit(kind), "component", *names).alias("task")
        rest = apart.where("rest").select("doc_id", "component", "chunks", "groups", "group")
        # what is apart meets itself, group by group, and the largest part, chunk by chunk
        own = rest.withColumn("other", numbers("groups"))
        side = F.when(F.col("group") == F.col("other"), -1).otherwise((F.col("group") > F.col("other")).cast("int"))
        within = own.select("doc_id", F.xxhash64(F.lit("rest"), "component", F.least("group", "other"), F.greatest("group", "other")).alias("task"), side.alias("side"))
        first = rest.withColumn("chunk", numbers("chunks")).select("doc_id", named_task("main", "group", "chunk"), F.lit(0).alias("side"))
        second = apart.where("NOT rest").withColumn("group", numbers("groups")).select("doc_id", named_task("main", "group", "chunk"), F.lit(1).alias("side"))
        found = found.union(compared(within.union(first).union(second), large))
    out, _ = runtime.written(components(found))
    runtime.forget(spark, kept)
    return out


def join(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", threshold: int = THRESHOLD, size: int = SHINGLE) -> DataFrame:
    """One row per input row: doc_id, n_shingles and component_id, the least doc_id that links reach."""
    docs = df.select(F.col(id_column).cast("bigint").alias("doc_id"), F.col(text_column).alias("text"))
    sets, _ = runtime.written(docs.mapInArrow(_sets(size), "doc_id bigint, n_shingles bigint, one bigint, two bigint"))
    found = links(docs, sets, threshold, size)
    return classed(sets, found)


def classed(sets: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of all rows of sets(doc_id, n_shingles, one, two): components of links joined with
    those of equal sets."""
    named = sets.where("n_shingles > 0 AND doc_id IS NOT NULL").join(found, "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    named = named.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    # the least of a class by way of partial ones, and back to no more rows than there are partial ones of it
    by = ["n_shingles", "one", "two"]
    partial = named.groupBy(*by, "salt").agg(F.min("component").alias("least"))
    least = partial.join(partial.groupBy(*by).agg(F.min("least").alias("class")), by).select(*by, "salt", "class")
    out = named.join(least, [*by, "salt"]).select("doc_id", "n_shingles", F.col("class").alias("component_id"))
    return out.union(sets.where("n_shingles = 0 OR doc_id IS NULL").select("doc_id", "n_shingles", "doc_id"))


def representatives(df: DataFrame, threshold: int = THRESHOLD, size: int = SHINGLE) -> DataFrame:
    """The rows of ``df`` whose doc_id is the least of its component, with all their columns. Of rows with equal doc_id and
    text one stays, whatever their other columns hold. Rows with a null doc_id stay."""
    gone = join(df, threshold=threshold, size=size).where("component_id <> doc_id").select("doc_id").distinct()
    digest = "_text"
    while digest in df.columns:
        digest += "_"
    named = df.where("doc_id IS NOT NULL").join(gone, "doc_id", "left_anti").withColumn(digest, F.sha2("text", 256))
    return named.dropDuplicates(["doc_id", digest]).select(*(F.col(f"`{c}`") for c in df.columns)).union(df.where("doc_id IS NULL"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(runtime.table(spark, sf_dir, "documents"))
