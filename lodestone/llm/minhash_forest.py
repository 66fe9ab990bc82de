"""MinHash near-dedup by an LSH forest: documents whose word-shingle sets are similar, as components.

1. Signatures. Of each set ``ORDERS`` * ``DEPTH`` MinHash values, and a 128-bit print of the whole set. Of equal sets only the
   one of the least doc_id goes on: groups of copies, however large, are one document in the forest.
2. Orders. A signature is cut into ``ORDERS`` runs of ``DEPTH`` values. Each order sorts all documents by its run, over all
   partitions, as a binary key: a prefix tree whose leaves are the documents. A range partitioning whose last key is
   the doc_id also splits regions of many equal runs.
3. Candidates. Neighbours in an order are candidates if they agree in enough leading values: as few as ``LEAST_DEPTH`` in a
   region of at most ``REGION`` documents, more where a region of that depth holds more, up to all ``DEPTH``, at which
   any number may agree. All documents of a region are chained through their neighbours, so none needs to stand next
   to the one it links with. Ends of partitions are joined by their borders, two rows a partition.
4. Components of the candidates meet in tasks that compare full sets by words and join what links (``ngram_join.confirmed``).

Only neighbours are ever named: candidates are at most one a document and order, whatever a region's size; nothing is
capped, as a region too large for its depth is cut into deeper ones, which hold the pairs that agree in more.

Two sets of similarity s agree in the first d values of an order with probability s^d, so they are no candidates with
(1 - s^d)^ORDERS: at 0.85, 9e-5 in regions of the least depth and 0.6 % for a pair that only the greatest depth joins, and
that no third document joins either; at 0.95, 2e-6 at the greatest. Links that are found are exact.

Defined cases: null or empty text, or text of white space, has no shingles and is linked with nothing, as are sets too
small to differ and link; a null doc_id takes no part, and has a null component and a null ``kept``; rows of one doc_id
are nodes of one name; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import runtime
from .components import components
from .ngram_join import classed, confirmed, set_prints
from .text_arrays import mix, pieces, row_starts, shingles, utf8

#: Links need 100 * intersection >= THRESHOLD * union.
SHINGLE, THRESHOLD = 3, 85
#: Orders, and values of each; the least number of values in which candidates agree, and how many documents may do so.
ORDERS, DEPTH, LEAST_DEPTH, REGION = 16, 8, 5, 32
#: Bytes of a MinHash value.
VALUE = 4
#: Bytes of keys of a partition of an order.
PARTITION_BYTES = 16 << 20

_RNG = np.random.default_rng(85)
MULTIPLY = _RNG.integers(0, 1 << 63, ORDERS * DEPTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
ADD = _RNG.integers(0, 1 << 63, ORDERS * DEPTH, dtype=np.uint64)


def signatures(value: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """MinHash values of each row's set, big-endian so that bytes sort as numbers do; zeros where it is empty."""
    out = np.zeros((len(starts) - 1, len(MULTIPLY)), ">u4")
    full = np.flatnonzero(np.diff(starts))
    if len(full):
        value, at = mix(value), starts[full]
        for i, (a, b) in enumerate(zip(MULTIPLY, ADD, strict=True)):
            out[full, i] = np.minimum.reduceat((value * a + b) >> np.uint64(32), at)
    return out


def _signed(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch["text"])
            for a, b in pieces(offsets):
                value, row = shingles(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], size)
                starts = row_starts(row, b - a)
                one, two = (x.view(np.int64) for x in set_prints(value, starts))
                sign = pa.FixedSizeBinaryArray.from_buffers(pa.binary(VALUE * len(MULTIPLY)), b - a, [None, pa.py_buffer(signatures(value, starts).tobytes())])
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(a, b - a), pa.array(np.diff(starts)), pa.array(one), pa.array(two), sign.cast(pa.binary())], ["doc_id", "n_shingles", "one", "two", "signature"])

    return run


def linked_neighbours(depth: np.ndarray) -> np.ndarray:
    """Which neighbours are candidates, by the number of leading values in which each pair of them agrees."""
    out = depth >= DEPTH
    for d in range(LEAST_DEPTH, DEPTH):
        inside = np.r_[False, depth >= d, False]
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        run = np.zeros(len(depth) + 1, np.int64)
        run[edge[::2]] += edge[1::2] - edge[::2]
        run[edge[1::2]] -= edge[1::2] - edge[::2]
        out |= (depth == d) & (np.cumsum(run)[:-1] < REGION)
    return out


NEIGHBOURS = "u bigint, v bigint, part int, last boolean, tree int, key binary"


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidates of sorted rows (tree, key, doc_id), and the first and last row. Of a region that goes on in another batch or
    partition only the part here counts, which makes no less candidates."""
    part, none = TaskContext.get().partitionId(), pa.nulls

    def border(row: tuple[int, bytes, int], last: bool) -> pa.RecordBatch:
        tree, key, doc = row
        return pa.RecordBatch.from_arrays([pa.array([doc], pa.int64()), none(1, pa.int64()), pa.array([part], pa.int32()), pa.array([last]), pa.array([tree], pa.int32()), pa.array([key], pa.binary())], NAMES)

    held: tuple[int, bytes, int] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        tree, doc = batch["tree"].to_numpy(), batch["doc_id"].to_numpy()
        key = np.frombuffer(utf8(batch["key"])[0].tobytes(), ">u4").reshape(-1, DEPTH)
        if held is None:
            yield border((int(tree[0]), key[0].tobytes(), int(doc[0])), False)
        else:
            tree, doc, key = np.r_[held[0], tree], np.r_[held[2], doc], np.concatenate([np.frombuffer(held[1], ">u4")[None], key])
        held = int(tree[-1]), key[-1].tobytes(), int(doc[-1])
        same = np.logical_and.accumulate(key[1:] == key[:-1], axis=1).sum(1)
        same[tree[1:] != tree[:-1]] = 0
        at = np.flatnonzero(linked_neighbours(same) & (doc[1:] != doc[:-1]))
        n = len(at)
        yield pa.RecordBatch.from_arrays([pa.array(doc[at]), pa.array(doc[at + 1]), none(n, pa.int32()), none(n, pa.bool_()), none(n, pa.int32()), none(n, pa.binary())], NAMES)
    if held is not None:
        yield border(held, True)


NAMES = [c.split()[0] for c in NEIGHBOURS.split(", ")]


def candidates(signed: DataFrame, threshold: int = THRESHOLD) -> tuple[DataFrame, str]:
    """(u, v): neighbours of signed(doc_id, signature) in the orders of the forest, and the path of their table."""
    width = VALUE * DEPTH
    leaves = signed.select(F.explode(F.sequence(F.lit(0), F.lit(ORDERS - 1))).alias("tree"), "doc_id", "signature")
    leaves = leaves.select("tree", F.expr(f"substring(signature, tree * {width} + 1, {width})").alias("key"), "doc_id")
    parts = max(12, -(-signed.count() * ORDERS * (width + 16) // PARTITION_BYTES))
    near = leaves.repartitionByRange(parts, "tree", "key", "doc_id").sortWithinPartitions("tree", "key", "doc_id").mapInArrow(_neighbours, NEIGHBOURS)
    near, path = runtime.written(near)
    # the last row of a partition and the first of the next one of the same order
    before = Window.partitionBy("tree").orderBy("part", "last")
    ends = near.where("part IS NOT NULL").select(F.col("u").alias("v"), F.lag("u").over(before).alias("u"), "key", F.lag("key").over(before).alias("other"))
    prefix = lambda c: F.substring(c, 1, VALUE * LEAST_DEPTH)
    met = ends.where((F.col("u") != F.col("v")) & (prefix("key") == prefix("other"))).select("u", "v")
    return near.where("part IS NULL").select("u", "v").union(met), path


def join(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", threshold: int = THRESHOLD, size: int = SHINGLE) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, the least doc_id that links reach, and whether it is kept."""
    spark = df.sparkSession
    docs = df.select(F.col(id_column).cast("bigint").alias("doc_id"), F.col(text_column).alias("text"))
    sets, _ = runtime.written(docs.mapInArrow(_signed(size), "doc_id bigint, n_shingles bigint, one bigint, two bigint, signature binary"))
    # smaller sets can't differ and link
    able = sets.where(F.col("doc_id").isNotNull() & (100 * F.col("n_shingles") >= threshold * (F.col("n_shingles") + 1)))
    names = ["n_shingles", "one", "two"]
    firsts = able.groupBy(*names).agg(F.min("doc_id").alias("doc_id"))
    signed, path = runtime.written(able.join(firsts, [*names, "doc_id"]).select("doc_id", "signature"))
    edges, near = candidates(signed, threshold)
    met, last = runtime.written(components(edges))
    for old in (path, near):
        runtime.forget(spark, old)
    found = confirmed(docs, sets, met, threshold, size)
    runtime.forget(spark, last)
    return classed(sets, found).withColumn("kept", F.col("doc_id") == F.col("component_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(runtime.table(spark, sf_dir, "documents"))


def sql(threshold: int, further: str = "") -> str:
    """Links between all pairs of documents that share a shingle of three words, and what they reach."""
    return rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents WHERE doc_id IS NOT NULL
),
places AS (SELECT doc_id, unnest(w) AS s1, unnest(w[2:]) AS s2, unnest(w[3:]) AS s3, len(w) AS n FROM words),
shingles AS MATERIALIZED (SELECT DISTINCT doc_id, s1 || ' ' || coalesce(s2, '') || ' ' || coalesce(s3, '') AS s FROM places WHERE s3 IS NOT NULL OR n < 3 AND s1 IS NOT NULL AND (s2 IS NOT NULL OR n = 1)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS n FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS MATERIALIZED (SELECT u, v FROM common c JOIN sizes a ON a.doc_id = u JOIN sizes b ON b.doc_id = v WHERE 100 * c.n >= {threshold} * (a.n + b.n - c.n)),
edges AS MATERIALIZED (SELECT u, v FROM links UNION ALL SELECT v, u FROM links),
reach AS (SELECT doc_id, doc_id AS r FROM documents WHERE doc_id IS NOT NULL UNION SELECT reach.doc_id, edges.v FROM reach JOIN edges ON edges.u = reach.r)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id{further}
FROM (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id) LEFT JOIN sizes USING (doc_id)
"""


SQL = sql(THRESHOLD, ", doc_id = component_id AS kept")
