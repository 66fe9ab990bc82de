"""Exact top-k search by distributed histogram selection.

Components become integers floor(256 * x); a score is an integer inner product. Of each query of a block, every task scores
all its vectors and counts all their scores in a histogram of ``BINS`` bins over the query's range; the summed histograms
tell in which bin the kth score lies, that bin becomes the range of the next, finer histogram, until a bin is one score
wide. A last pass keeps what scores more than the kth value and, among equals, the smallest vec_ids.

A task sends the bins from the top down to the one in which its own count reaches the count still wanted: lower ones
can't hold the kth value of all. Bins are powers of two, so that a bin's number is a shift. A block is about ``BLOCK``
queries, which bounds what is broadcast, counted in a task and seen by the driver (one range a query); candidates are
read once a block and round and never shuffled.

Defined cases: vectors that are null or hold a null or non-finite component, and rows with a null vec_id, take no
part; vectors of another length than the query's are no candidates; rows of the query's own vec_id are its own; a
query that repeats is asked once, a candidate that repeats counts each time; extra columns are ignored; without
queries or candidates the result is empty. Twice the greatest score that the components allow must fit a long; products are exact in doubles below 2**53 and
in longs beyond.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import runtime

K, SCALE, STEP = 5, 256, 50
#: Queries of a block, bins of a histogram (a power of two), and queries and candidates that are scored at once.
BLOCK, BINS, ROWS = 16384, 512, 512


@dataclass
class Block:
    """Queries of one length, and for each the range [low, low + 2**bits) that holds its kth score; 0 bits where known."""

    ids: np.ndarray
    vectors: np.ndarray
    low: np.ndarray
    bits: np.ndarray
    need: np.ndarray

    @property
    def shift(self) -> np.ndarray:
        """Bits of a bin."""
        return np.maximum(0, self.bits - (BINS.bit_length() - 1))


def quantised(df: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    x = F.col(vector_column)
    whole = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return df.where(F.col(id_column).isNotNull() & x.isNotNull() & F.coalesce(whole, F.lit(False))).select(
        F.col(id_column).cast("bigint").alias("vec_id"), F.transform(x, lambda c: F.floor(c.cast("double") * SCALE).cast("bigint")).alias("v")
    )


def _matrices(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, vectors) of a batch, by length of vector."""
    lists, ids = batch["v"], batch["vec_id"].to_numpy()
    offsets = lists.offsets.to_numpy()
    values, size = lists.values.to_numpy(zero_copy_only=False), np.diff(offsets)
    for n in np.unique(size):
        at = np.flatnonzero(size == n)
        for i in range(0, len(at), ROWS):
            rows = at[i : i + ROWS]
            yield ids[rows], values[offsets[rows][:, None] + np.arange(n)]


def _scores(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    n = queries.shape[1]
    if n and float(np.abs(queries).max(initial=0)) * float(np.abs(rows).max(initial=0)) * n < 1 << 53:
        return (queries.astype(np.float64) @ rows.T.astype(np.float64)).astype(np.int64)
    return queries @ rows.T


def _histogram(blocks):
    """Of each query: its number, a bin of its range, and how many of the task's scores fall into it, from the top."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, Block] = {n: b for n, b in blocks.value.items() if (b.bits > 0).any()}
        counts = {n: np.zeros((len(b.ids), BINS), np.int32) for n, b in own.items()}
        for batch in batches:
            for ids, rows in _matrices(batch):
                if (b := own.get(rows.shape[1])) is None:
                    continue
                for i in range(0, len(b.ids), ROWS):
                    at = slice(i, i + ROWS)
                    above = _scores(b.vectors[at], rows) - b.low[at, None]
                    place = above >> b.shift[at, None]
                    mine = (above >= 0) & (place < (1 << np.minimum(b.bits[at], BINS.bit_length() - 1))[:, None]) & (b.ids[at, None] != ids)
                    place += np.arange(len(place))[:, None] * BINS
                    counts[rows.shape[1]][at] += np.bincount(place[mine], minlength=len(place) * BINS).reshape(-1, BINS)
        for n, b in own.items():
            down = counts[n][:, ::-1]
            before = np.cumsum(down, axis=1, dtype=np.int64) - down
            q, place = np.nonzero((down > 0) & (before < b.need[:, None]) & (b.bits > 0)[:, None])
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (np.full(len(q), n), q, BINS - 1 - place, down[q, place])], ["n", "q", "bin", "count"])

    return run


def _best(blocks):
    """What scores more than the kth value, and the smallest vec_ids among what equals it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, Block] = blocks.value
        equal: dict[tuple[int, int], list[int]] = {}

        def rows(q: np.ndarray, v: np.ndarray, s: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (q, v, s)], ["query_id", "vec_id", "score"])

        for batch in batches:
            for ids, vectors in _matrices(batch):
                n = vectors.shape[1]
                if (b := own.get(n)) is None:
                    continue
                for start in range(0, len(b.ids), ROWS):
                    at = slice(start, start + ROWS)
                    score = _scores(b.vectors[at], vectors)
                    other = b.ids[at, None] != ids
                    q, c = np.nonzero((score > b.low[at, None]) & other)
                    if len(q):
                        yield rows(b.ids[q + start], ids[c], score[q, c])
                    q, c = np.nonzero((score == b.low[at, None]) & other)
                    order = np.lexsort((ids[c], q))
                    q, c = q[order] + start, c[order]
                    rank = np.arange(len(q)) - np.searchsorted(q, q)
                    keep = rank < b.need[q]
                    for i, j in zip(q[keep].tolist(), ids[c[keep]].tolist(), strict=True):
                        held = equal.setdefault((n, i), [])
                        held.append(j)
                        if len(held) > 4 * b.need[i]:
                            equal[n, i] = sorted(held)[: b.need[i]]
        got = [(own[n].ids[i], j, own[n].low[i]) for (n, i), held in equal.items() for j in sorted(held)[: own[n].need[i]]]
        if got:
            yield rows(*map(np.array, zip(*got, strict=True)))

    return run


def _narrowed(b: Block, q: np.ndarray, place: np.ndarray, count: np.ndarray) -> None:
    """Takes the bin of each query's kth score as its range. Rows are sorted by query, highest bin first."""
    first = np.searchsorted(q, np.arange(len(b.ids) + 1))
    total = np.cumsum(count)
    before = total - count
    above = before - before[np.minimum(first[q], max(0, len(q) - 1))] if len(q) else before
    hit = np.flatnonzero((above < b.need[q]) & (above + count >= b.need[q]))
    open_ = b.bits > 0
    # fewer than k candidates: all of them
    few = open_.copy()
    few[q[hit]] = False
    b.low[few] -= 1
    b.bits[few] = 0
    shift = b.shift
    b.low[q[hit]] += place[hit] << shift[q[hit]]
    b.need[q[hit]] -= above[hit]
    b.bits[q[hit]] = shift[q[hit]]


def _block_result(vectors: DataFrame, queries: DataFrame, k: int, most: int) -> DataFrame:
    """The k best and what ties with them task by task; ``most`` bounds the components."""
    context = vectors.sparkSession.sparkContext
    blocks = {}
    table = queries.toArrow()
    held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    for batch in table.to_batches():
        for ids, rows in _matrices(batch):
            held.setdefault(rows.shape[1], []).append((ids, rows))
    for n, parts in held.items():
        ids, first = np.unique(np.concatenate([p[0] for p in parts]), return_index=True)
        v = np.concatenate([p[1] for p in parts])[first]
        bound = np.abs(v).sum(1) * most + 1
        bits = np.array([int(2 * x + 1).bit_length() for x in bound])
        blocks[n] = Block(ids, v, -bound, bits, np.full(len(ids), k))
    while any((b.bits > 0).any() for b in blocks.values()):
        sent = context.broadcast(blocks)
        counts = vectors.mapInArrow(_histogram(sent), "n bigint, q bigint, bin bigint, count bigint").groupBy("n", "q", "bin").agg(F.sum("count").alias("count"))
        # only the k highest of the bins of a query can hold its kth score
        top = counts.withColumn("r", F.row_number().over(Window.partitionBy("n", "q").orderBy(F.desc("bin")))).where(F.col("r") <= k).toArrow()
        found = [top[c].to_numpy() for c in ("n", "q", "bin", "count")]
        sent.destroy()
        for n, b in blocks.items():
            q, place, count = (x[found[0] == n] for x in found[1:])
            order = np.lexsort((-place, q))
            _narrowed(b, q[order], place[order], count[order])
    return vectors.mapInArrow(_best(context.broadcast(blocks)), "query_id bigint, vec_id bigint, score bigint")


def search(df: DataFrame, is_query: F.Column, k: int = K, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of all rows for each row where ``is_query`` holds."""
    vectors = quantised(df, id_column, vector_column)
    queries = quantised(df.where(is_query), id_column, vector_column)
    blocks = -(-queries.count() // BLOCK)
    most = vectors.agg(F.max(F.array_max(F.transform("v", F.abs)))).first()[0] or 0 if blocks else 0
    found = None
    for i in range(blocks):
        part = _block_result(vectors, queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == i), k, most)
        found = part if found is None else found.union(part)
    if found is None:
        found = vectors.sparkSession.createDataFrame([], "query_id bigint, vec_id bigint, score bigint")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(runtime.table(spark, sf_dir, "embeddings"), F.col("vec_id") % STEP == 0)


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND list_count(embedding) = len(embedding) AND list_bool_and(list_transform(embedding, lambda x: isfinite(x)))
),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 5
"""
