"""Suffix-array dedup: removes passages of 50 or more bytes that an earlier document has, whole texts, exactly.

A byte goes if it lies in a 50-byte string that also starts in a document with a smaller doc_id; the input decides,
not what is left of it, and matches never cross documents.

Plan. Suffixes are sampled so that any two equal 50-byte strings hold the same sampled suffix (the one whose 20-byte seed
has the least hash of the 31 in the string, leftmost on ties). Then:

1. Texts are packed into pieces (compressed blobs of many documents), written once to the shared folder.
2. Each piece sends its distinct seeds, 4 bytes each, to the bucket of the seed's hash; the bucket sends back those that
   more than one document has. Most suffixes end here.
3. Each piece sends the regions around its shared suffixes to their buckets, once for all copies within the piece. A
   bucket holds an index family: each arriving batch gets the suffix array of its distinct regions, in byte order to
   the depth of a match, is merge-scanned against the existing levels, and levels merge geometrically by size. So each
   string gets one number whatever region it comes in, and with it the least doc_id that has it.
4. Strings of which an earlier document has the number go back to their pieces, which cut them out.

Hashes only deal and filter; strings, and the regions that are joined before they are sent, are compared as bytes. A seed or
region that a third of all documents share reaches its bucket once a piece, not once a document. There are never more
messages than regions, as empty ones aren't sent. The family lives as long as its task; between runs it isn't stored.

Defined cases: null or empty text has no bytes and no spans; a null doc_id takes no part (nothing is removed from its
row, nor for it); rows of one doc_id never remove each other's bytes; extra columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import runtime
from .text_arrays import BASE, distinct, eights, mix, pieces, utf8

LENGTH, SEED = 50, 20
#: Bytes of stored input for each bucket, and the limits of a piece's text.
BUCKET_BYTES, LEAST_PIECE, MOST_PIECE = 6 << 20, 256 << 10, 4 << 20
#: The most partitions of a shuffle; beyond it one holds several buckets, which it takes one after the other.
MOST_PARTITIONS = 1 << 16
#: Bytes of messages of a batch of a bucket, and strings that are copied at once.
BATCH_BYTES, SLICE = 1 << 20, 1 << 17

PIECE = "piece bigint, ids binary, known binary, sizes binary, body binary"
MESSAGE = "bucket int, piece bigint, done boolean, body binary"


def squeeze(*arrays: np.ndarray) -> bytes:
    """A compressed blob of arrays, each with its length before it."""
    return zstandard.compress(b"".join(len(a).to_bytes(8, "little") + a.tobytes() for a in (x.view(np.uint8) for x in arrays)), 1)


def spread(blob: bytes, *types: str) -> list[np.ndarray]:
    raw, at, out = zstandard.decompress(blob), 0, []
    for kind in types:
        size = int.from_bytes(raw[at : at + 8], "little")
        out.append(np.frombuffer(raw, kind, size // np.dtype(kind).itemsize, at + 8))
        at += 8 + size
    return out


def concat(arrays: list[np.ndarray], kind: str) -> np.ndarray:
    return np.concatenate(arrays) if arrays else np.zeros(0, kind)


def pack(piece_bytes: int):
    """A task's documents as rows of PIECE. A piece's number is made of the partition and its place in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serial = TaskContext.get().partitionId() << 32
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def row() -> pa.RecordBatch:
            ids, known, sizes, body = (np.concatenate(x) for x in zip(*held, strict=True))
            values = [serial, ids.tobytes(), known.tobytes(), sizes.tobytes(), zstandard.compress(body.tobytes(), 1)]
            types = [pa.int64(), *[pa.binary()] * 4]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], [c.split()[0] for c in PIECE.split(", ")])

        for batch in batches:
            data, offsets = utf8(batch["text"])
            known = np.array(batch["doc_id"].is_valid())
            ids = batch["doc_id"].fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for a, b in pieces(offsets, piece_bytes):
                held.append((ids[a:b], known[a:b], np.diff(offsets[a : b + 1]), data[offsets[a] : offsets[b]]))
                size += int(offsets[b] - offsets[a])
                if size >= piece_bytes:
                    yield row()
                    held, size, serial = [], 0, serial + 1
        if held:
            yield row()

    return run


class Piece:
    """The documents of one piece again."""

    def __init__(self, ids: bytes, known: bytes, sizes: bytes, body: bytes):
        self.ids, self.known = np.frombuffer(ids, np.int64), np.frombuffer(known, bool)
        self.offsets = np.r_[0, np.cumsum(np.frombuffer(sizes, np.int64))]
        self.data = np.frombuffer(zstandard.decompress(body), np.uint8)

    def suffixes(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For runs of documents: first string and number of strings of each sampled suffix, its seed and its document."""
        for a, b in pieces(self.offsets):
            low = int(self.offsets[a])
            data, offsets = self.data[low : self.offsets[b]], self.offsets[a : b + 1] - low
            found = sample(data, offsets)
            if found is None:
                continue
            start, count, seed = found
            row = np.searchsorted(offsets, start, "right") - 1
            keep = self.known[row + a]
            start, count, seed, row = start[keep], count[keep], seed[keep], row[keep]
            yield start + low, count, seed, row + a


def seed_prints(data: np.ndarray) -> np.ndarray:
    """A hash of the ``SEED`` bytes from each place on."""
    eight, n = eights(data), len(data) - SEED + 1
    value = mix(eight[:n] + np.uint64(SEED))
    value = mix(value * np.uint64(BASE) + eight[8 : n + 8])
    return mix(value * np.uint64(BASE) + (eight[16 : n + 16] & np.uint64(0xFFFFFFFF)))


def sample(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Runs of 50-byte strings (first, count) that share a sampled suffix, and the suffix's seed."""
    if len(data) < LENGTH:
        return None
    seeds = seed_prints(data)
    bits = np.uint64(32)  # the same everywhere, so that ties are the same everywhere
    least = (seeds >> bits << bits) | np.arange(len(seeds), dtype=np.uint64)
    width, reach = LENGTH - SEED + 1, 1
    while reach * 2 <= width:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if reach < width:
        least = np.minimum(least[: len(least) - (width - reach)], least[width - reach :])
    at = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    valid = np.zeros(len(at) + 1, np.int32)
    sizes = np.diff(offsets)
    inside = sizes >= LENGTH
    np.add.at(valid, offsets[:-1][inside], 1)
    np.add.at(valid, (offsets[1:] - LENGTH + 1)[inside], -1)
    string = np.flatnonzero(np.cumsum(valid[:-1]) > 0)
    if not len(string):
        return None
    at = at[string]
    first = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (string[1:] != string[:-1] + 1)])
    # least fingerprints are small; mixed again, they fill all buckets alike
    return string[first], np.diff(np.r_[first, len(string)]), mix(seeds[at[first]])


def bucket_of(seed: np.ndarray, buckets: int) -> np.ndarray:
    return ((seed >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def messages(rows: list[tuple[int, int, bool, bytes]]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * 4
    types = [pa.int32(), pa.int64(), pa.bool_(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["bucket", "piece", "done", "body"])


def send_seeds(buckets: int):
    """Of each piece: its distinct seeds by bucket, and which of them several of its documents have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, *parts in zip(*(batch[i].to_pylist() for i in range(5)), strict=True):
                piece = Piece(*parts)
                got = [(seed, piece.ids[row]) for _, _, seed, row in piece.suffixes()]
                seed, owner = concat([g[0] for g in got], "u8"), concat([g[1] for g in got], "i8")
                order = np.lexsort((owner, seed))
                seed, owner = seed[order], owner[order]
                first = np.flatnonzero(np.r_[True, seed[1:] != seed[:-1]]) if len(seed) else np.zeros(0, np.int64)
                last = np.r_[first[1:], len(seed)] - 1
                many = owner[first] != owner[last]
                seed = seed[first]
                bounds = np.searchsorted(bucket_of(seed, buckets), np.arange(buckets + 1))
                low = seed.astype(np.uint32)
                yield messages([(k, number, False, squeeze(low[a:b], many[a:b])) for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)) if b > a])

    return run


def by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple[int, bytes]]]]:
    """(bucket, its messages) of rows sorted by bucket."""
    bucket, held = None, []
    for batch in batches:
        for k, number, body in zip(batch["bucket"].to_pylist(), batch["piece"].to_pylist(), batch["body"].to_pylist(), strict=True):
            if k != bucket and bucket is not None:
                yield bucket, held
                held = []
            bucket = k
            held.append((number, body))
    if bucket is not None:
        yield bucket, held


def shared_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for bucket, held in by_bucket(batches):
        got = [(number, *spread(body, "u4", "?")) for number, body in held]
        seeds = np.sort(concat([g[1] for g in got], "u4"))
        twice = seeds[1:][seeds[1:] == seeds[:-1]]
        shared = np.unique(np.concatenate([twice, *(seed[many] for _, seed, many in got)]))
        out = []
        for number, seed, _ in got:
            own = seed[shared[np.minimum(np.searchsorted(shared, seed), len(shared) - 1)] == seed] if len(shared) else seed[:0]
            if len(own):
                out.append((bucket, number, False, squeeze(own)))
        yield messages(out)


def send_strings(buckets: int):
    """Of each piece: the strings around its shared suffixes, by bucket. Copies of later documents within the piece are
    covered already and go as done."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            number = left["piece"][0].as_py()
            piece = Piece(*(left[c][0].as_py() for c in ("ids", "known", "sizes", "body")))
            wanted = concat([np.uint64(k << 32) | spread(body, "u4")[0].astype(np.uint64) for k, body in zip(right["bucket"].to_pylist(), right["body"].to_pylist(), strict=True)], "u8")
            wanted.sort()
            kept = []
            for start, count, seed, row in piece.suffixes():
                key = (bucket_of(seed, buckets).astype(np.uint64) << np.uint64(32)) | (seed & np.uint64(0xFFFFFFFF))
                hit = np.searchsorted(wanted, key)
                keep = wanted[np.minimum(hit, len(wanted) - 1)] == key
                kept.append((start[keep], count[keep], seed[keep], piece.ids[row[keep]]))
            start, count, seed, owner = (concat([k[i] for k in kept], t) for i, t in enumerate(("i8", "i8", "u8", "i8")))
            if len(start):
                order = np.argsort(owner, kind="stable")
                start, count, seed, owner = start[order], count[order], seed[order], owner[order]
                first, same = distinct(piece.data, start, start + count + LENGTH - 1)
                least = np.full(len(first), np.iinfo(np.int64).max)
                np.minimum.at(least, same, owner)
                later = owner > least[same]
                if later.any():
                    out.append((number % buckets, number, True, squeeze(start[later].astype(np.uint32), count[later].astype(np.uint32))))
                start, count, seed, owner = start[~later], count[~later], seed[~later], owner[~later]
                bucket = bucket_of(seed, buckets)
                order = np.argsort(bucket, kind="stable")
                start, count, owner, bucket = start[order], count[order], owner[order], bucket[order]
                edge = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]).tolist() if len(bucket) else []
                for a, b in zip(edge, [*edge, len(bucket)][1:], strict=True):
                    size = count[a:b] + LENGTH - 1
                    ends = np.cumsum(size)
                    text = piece.data[np.arange(ends[-1]) + np.repeat(start[a:b] - (ends - size), size)]
                    out.append((int(bucket[a]), number, False, squeeze(start[a:b].astype(np.uint32), count[a:b].astype(np.uint8), owner[a:b], text)))
        return pa.Table.from_batches([messages(out)])

    return run


class IndexFamily:
    """A logarithmic family of suffix arrays over one bucket.

    A level is the suffix array of so many strings, in the order of their first ``LENGTH`` bytes, with the number of
    each distinct string. A new batch gets a suffix array of its own, is merge-scanned against every level for strings
    that are there already, and what is new in it becomes a level; a level merges with the one before it while that is
    not at least twice its size, so that sizes fall geometrically and every string is merged a logarithmic number of times.
    """

    def __init__(self):
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        #: Of each distinct string: the least doc_id that has it so far.
        self.least = np.zeros(0, np.int64)

    @staticmethod
    def merged(one: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two sorted arrays as one, and its order: a stable sort merges two sorted runs in linear time."""
        both = np.concatenate([one, other])
        order = np.argsort(both, kind="stable")
        return both[order], order

    def scan(self, strings: np.ndarray, owners: np.ndarray) -> np.ndarray:
        """The number of each string of a batch, which is in the family from now on."""
        order = np.argsort(strings, kind="stable")  # the batch's suffix array
        ranked = strings[order]
        first = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]]) if len(ranked) else np.zeros(0, np.int64)
        keys, low = ranked[first], np.minimum.reduceat(owners[order], first) if len(first) else owners
        number = np.full(len(keys), -1)
        for level, numbers in self.levels:
            both, place = self.merged(level, keys)
            same = np.flatnonzero(both[1:] == both[:-1])  # a level's string stands right before the batch's
            number[place[same + 1] - len(level)] = numbers[place[same]]
        new = number < 0
        number[new] = np.arange(new.sum()) + len(self.least)
        self.least = np.concatenate([self.least, np.full(new.sum(), np.iinfo(np.int64).max)])
        self.least[number] = np.minimum(self.least[number], low)
        if new.any():
            self._add(keys[new], number[new])
        out = np.empty(len(strings), np.int64)
        out[order] = np.repeat(number, np.diff(np.r_[first, len(ranked)]))
        return out

    def _add(self, keys: np.ndarray, numbers: np.ndarray) -> None:
        while self.levels and len(self.levels[-1][0]) < 2 * len(keys):
            level, others = self.levels.pop()
            keys, order = self.merged(level, keys)
            numbers = np.concatenate([others, numbers])[order]
        self.levels.append((keys, numbers))


def _regions(bodies: list[bytes]) -> tuple[np.ndarray, ...]:
    """Of a batch of messages: message, first string and number of strings of each region, its owner, and the bytes of
    all regions with where each begins."""
    parts = [spread(body, "u4", "u1", "i8", "u1") for body in bodies]
    message = np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])
    start, count, owner = (np.concatenate([p[i] for p in parts]) for i in range(3))
    count = count.astype(np.int64)
    size = count + LENGTH - 1
    return message, start.astype(np.int64), count, owner, np.concatenate([p[3] for p in parts]), np.cumsum(size) - size


class Batches:
    """The messages of one bucket, taken into its index family batch by batch."""

    def __init__(self):
        self.family = IndexFamily()
        #: Of each batch: its pieces, its regions, and the numbers of the strings of its distinct regions.
        self.done: list[tuple[list[int], tuple[np.ndarray, ...]]] = []
        self.numbers: list[int] = []
        self.bodies: list[bytes] = []
        self.size = 0

    def add(self, number: int, body: bytes) -> None:
        self.numbers.append(number)
        self.bodies.append(body)
        self.size += len(body)
        if self.size >= BATCH_BYTES:
            self.close()

    def close(self) -> None:
        if not self.bodies:
            return
        message, start, count, owner, text, at = _regions(self.bodies)
        first, same = distinct(text, at, at + count + LENGTH - 1)
        least = np.full(len(first), np.iinfo(np.int64).max)
        np.minimum.at(least, same, owner)
        step = np.cumsum(count[first]) - count[first]
        place = np.repeat(at[first] - step, count[first]) + np.arange(int(count[first].sum()))
        windows = np.lib.stride_tricks.sliding_window_view(text, LENGTH)
        strings = np.concatenate([windows[place[i : i + SLICE]].reshape(-1).view(f"S{LENGTH}") for i in range(0, len(place), SLICE)]) if len(place) else np.zeros(0, f"S{LENGTH}")
        ids = self.family.scan(strings, np.repeat(least, count[first]))
        self.done.append((self.numbers, (message.astype(np.int32), start.astype(np.uint32), count.astype(np.uint8), owner, same.astype(np.int32), ids.astype(np.int32), step)))
        self.numbers, self.bodies, self.size = [], [], 0

    def covered(self) -> Iterator[tuple[int, bytes]]:
        """Of each piece: runs of strings that an earlier document has, as first and count."""
        self.close()
        for numbers, (message, start, count, owner, same, ids, step) in self.done:
            count = count.astype(np.int64)
            ends = np.cumsum(count)
            inside = np.arange(int(count.sum())) - np.repeat(ends - count, count)
            gone = self.family.least[ids[np.repeat(step[same], count) + inside]] < np.repeat(owner, count)
            place, of = (np.repeat(start.astype(np.int64), count) + inside)[gone], np.repeat(message, count)[gone]
            bounds = np.searchsorted(of, np.arange(len(numbers) + 1))
            for number, a, b in zip(numbers, bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                if b > a:
                    own = np.sort(place[a:b])
                    first = np.flatnonzero(np.r_[True, own[1:] != own[:-1] + 1])
                    yield number, squeeze(own[first].astype(np.uint32), np.diff(np.r_[first, len(own)]).astype(np.uint32))


def covered_strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by bucket: what to cut of each piece."""
    bucket, own = None, Batches()

    def close() -> pa.RecordBatch:
        return messages([(bucket, number, True, body) for number, body in own.covered()])

    for batch in batches:
        passing = batch.filter(batch["done"])
        if passing.num_rows:
            yield passing
        batch = batch.filter(pc.invert(batch["done"]))
        for k, number, body in zip(batch["bucket"].to_pylist(), batch["piece"].to_pylist(), batch["body"].to_pylist(), strict=True):
            if k != bucket:
                if bucket is not None:
                    yield close()
                bucket, own = k, Batches()
            own.add(number, body)
    if bucket is not None:
        yield close()


RESULT = "doc_id bigint, n_bytes bigint, spans array<struct<start:bigint,end:bigint>>, kept binary"


def _cut(left: pa.Table, right: pa.Table) -> pa.Table:
    fields = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary())])
    if not left.num_rows:
        return fields.empty_table()
    piece = Piece(*(left[c][0].as_py() for c in ("ids", "known", "sizes", "body")))
    runs = [spread(body, "u4", "u4") for body in right["body"].to_pylist()]
    start, count = (concat([r[i] for r in runs], "u4").astype(np.int64) for i in (0, 1))
    n = len(piece.data)
    change = np.zeros(n + 1, np.int32)
    np.add.at(change, start, 1)
    np.add.at(change, np.minimum(start + count + LENGTH - 1, n), -1)
    gone = np.cumsum(change[:n], dtype=np.int32) > 0
    offsets = piece.offsets
    border = np.zeros(n + 1, bool)
    border[offsets] = True
    opens = np.flatnonzero(gone & (border[:n] | ~np.r_[False, gone[:-1]]))
    closes = np.flatnonzero(gone & (border[1:] | ~np.r_[gone[1:], False])) + 1
    row = np.searchsorted(offsets, opens, "right") - 1
    spans = pa.StructArray.from_arrays([pa.array(opens - offsets[row]), pa.array(closes - offsets[row])], ["start", "end"])
    lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(len(piece.ids) + 1)), pa.int32()), spans)
    kept = piece.data[~gone]
    sizes = np.r_[0, np.cumsum(~gone)][offsets]
    binary = pa.Array.from_buffers(pa.binary(), len(piece.ids), [None, pa.py_buffer(sizes.astype(np.int32)), pa.py_buffer(kept)])
    return pa.Table.from_arrays([pa.array(piece.ids, mask=~piece.known), pa.array(np.diff(offsets)), lists, binary], schema=fields)


def dedup(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_bytes, the removed spans (byte offsets, ends exclusive) and the bytes kept."""
    docs = df.select(F.col(id_column).cast("bigint").alias("doc_id"), F.col(text_column).alias("text"))
    buckets = runtime.parts(docs, BUCKET_BYTES)
    partitions = min(buckets, MOST_PARTITIONS)
    piece_bytes = min(MOST_PIECE, max(LEAST_PIECE, runtime.size_in_bytes(docs) // 64))
    packed = runtime.checkpoint(docs.mapInArrow(pack(piece_bytes), PIECE))

    def dealt(sent: DataFrame) -> DataFrame:
        return sent.repartition(partitions, "bucket").sortWithinPartitions("bucket", "piece")

    shared = dealt(packed.mapInArrow(send_seeds(buckets), MESSAGE)).mapInArrow(shared_seeds, MESSAGE)
    strings = packed.groupBy("piece").cogroup(shared.groupBy("piece")).applyInArrow(send_strings(buckets), MESSAGE)
    covered = dealt(strings).mapInArrow(covered_strings, MESSAGE)
    return packed.groupBy("piece").cogroup(covered.groupBy("piece")).applyInArrow(_cut, RESULT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.col("spans")
    removed = F.aggregate(spans, F.lit(0).cast("bigint"), lambda total, s: total + s["end"] - s["start"])
    return dedup(runtime.table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", removed.alias("n_removed"), F.size(spans).cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
