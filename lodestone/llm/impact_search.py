"""Ranked lexical search by Fagin's threshold algorithm over a segmented index.

1. ``build`` turns documents into segments, rows of a table in the shared folder: a dictionary of terms, and for each term
   the documents that hold it and how often. Texts are read once, whatever is asked later.
2. Queries come in blocks, whose terms are looked up in all dictionaries; the sums of documents, terms and document
   frequencies over all segments give the weights.
3. Each task answers a block over its segments by the threshold algorithm. A segment's lists are sorted by impact, and a
   forward table of the block's terms gives the whole score of any document. Lists are read round-robin, ``STEP`` entries
   at a time; each document that is new is scored by lookups; the threshold is the score of a document that would stand
   in every list where reading has come to. A segment ends when the threshold is strictly below the kth best score, which
   is carried from segment to segment of the task, so later segments mostly end sooner.
4. The best of tasks meet by item, first in ``SALTS`` groups.

Only queries, their weights and k rows a query and task leave a segment. A block has about ``VOCABULARY`` terms, as many
documents stand in a forward table at once as ``CELLS`` allows, and a block's result is written before the next one's
terms are sent: nothing that is held grows with documents or queries. Terms are compared as bytes throughout.

Defined cases: null or empty text, or text without a term, isn't counted and found by nothing; rows with a null doc_id take
no part; rows of one doc_id are documents each; of rows of one item_id that of the least text is asked, a null item_id
or an item without terms not at all; equal scores go by ascending doc_id; extra columns are ignored; an empty table of
either kind gives an empty result.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import runtime
from .suffix_dedup import concat, spread, squeeze
from .text_arrays import LOWER, distinct, ranges, utf8, words

K = 20
#: Weights of the score, as the contract fixes them.
LEVEL, SLOPE, WHOLE, CURVE = 75, 25, 1_000_000_000, 12
#: Bytes of text and documents of a segment.
SEGMENT_BYTES, SEGMENT_DOCUMENTS = 4 << 20, 4096
#: About how many terms a block of queries has, and the most cells of a forward table.
VOCABULARY, CELLS = 4096, 1 << 23
#: Entries that are read from each list at a time.
STEP = 8
SALTS = 512

#: What stands between terms: ASCII but for digits and letters.
OUTSIDE = np.zeros(256, bool)
OUTSIDE[:128] = True
OUTSIDE[48:58] = OUTSIDE[65:91] = OUTSIDE[97:123] = False
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
SMALL = str.maketrans({c: c + 32 for c in range(65, 91)})

SEGMENT = "docs bigint, total bigint, dictionary binary, postings binary"
FOUND = "item_id bigint, doc_id bigint, score bigint, task int"


def _cuts(low: np.ndarray, offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first byte, last byte, offsets, rows): parts of about this many bytes, which end between terms."""
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        if offsets[last] - offsets[first] <= 2 * limit:
            yield offsets[first], offsets[last], offsets[first : last + 1] - offsets[first], np.arange(first, last)
        else:
            at = int(offsets[first])
            while at < offsets[last]:
                end = min(at + limit, int(offsets[last]))
                while end < offsets[last] and not OUTSIDE[low[end]]:
                    end += 1
                yield at, end, np.array([0, end - at]), np.array([first])
                at = end
        first = last


def _counted(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.LargeBinaryArray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct terms of texts, and (term, row, occurrences), sorted."""
    low, rows = LOWER[data], len(offsets) - 1
    names: list[bytes] = []
    sizes, keys, counts = [], [], []
    shift = 0
    for a, b, ends, row in _cuts(low, offsets, SEGMENT_BYTES):
        start, end, at = words(low[a:b], ends, OUTSIDE)
        if len(start):
            first, term = distinct(low[a:b], start, end)
            key, n = np.unique(term.astype(np.int64) * rows + row[at], return_counts=True)
            sizes.append(end[first] - start[first])
            names.append(low[a:b][ranges(start[first], sizes[-1])].tobytes())
            keys.append(key + shift * rows)
            counts.append(n)
            shift += len(first)
    if not names:
        return _dictionary(np.zeros(0, np.uint8), np.zeros(0, np.int64)), *(np.zeros(0, np.int64) for _ in range(3))
    data, size, key, n = np.frombuffer(b"".join(names), np.uint8), np.concatenate(sizes), np.concatenate(keys), np.concatenate(counts)
    if len(names) > 1:
        ends = np.cumsum(size)
        first, same = distinct(data, ends - size, ends)
        data, size = data[ranges((ends - size)[first], size[first])], size[first]
        key, at = np.unique(same[key // rows].astype(np.int64) * rows + key % rows, return_inverse=True)
        n = np.bincount(at, n).astype(np.int64)
    return _dictionary(data, size), key // rows, key % rows, n


def _dictionary(data: np.ndarray, size: np.ndarray) -> pa.LargeBinaryArray:
    ends = np.r_[0, np.cumsum(size)].astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(np.ascontiguousarray(data))])


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    size = count = 0

    def row() -> pa.RecordBatch:
        ids, lengths, data = (np.concatenate([h[i] for h in held]) for i in range(3))
        names, term, doc, n = _counted(data, np.r_[0, np.cumsum(lengths)])
        own, doc = np.unique(doc, return_inverse=True)  # documents with a term
        total = np.bincount(doc, n, len(own)).astype(np.int64)
        lists = np.searchsorted(term, np.arange(len(names) + 1))
        columns = [len(own)], [int(total.sum())], [squeeze(np.frombuffer(names.buffers()[1], np.int64), np.frombuffer(names.buffers()[2], np.uint8), np.diff(lists).astype(np.uint32))]
        postings = squeeze(ids[own], total, doc.astype(np.uint16 if len(own) < 1 << 16 else np.uint32).view(np.uint8), n.astype(np.uint32))
        return pa.RecordBatch.from_arrays([*(pa.array(c) for c in columns), pa.array([postings])], ["docs", "total", "dictionary", "postings"])

    for batch in batches:
        batch = batch.filter(batch["doc_id"].is_valid())
        ids = batch["doc_id"].to_numpy(zero_copy_only=False).astype(np.int64)
        data, offsets = utf8(batch["text"])
        first = 0
        while first < len(ids):
            room = np.searchsorted(offsets, offsets[first] + SEGMENT_BYTES - size, "right") - 1
            last = int(min(len(ids), max(first + 1, room), first + SEGMENT_DOCUMENTS - count))
            held.append((ids[first:last], np.diff(offsets[first : last + 1]), data[offsets[first] : offsets[last]].copy()))
            size, count = size + int(offsets[last] - offsets[first]), count + last - first
            first = last
            if size >= SEGMENT_BYTES or count >= SEGMENT_DOCUMENTS or first < len(ids):
                yield row()
                held, size, count = [], 0, 0
    if held:
        yield row()


def build(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> tuple[DataFrame, str]:
    """The index of all documents as a table in the shared folder, and its path, for ``runtime.forget``."""
    own = docs.select(F.col(id_column).cast("bigint").alias("doc_id"), F.col(text_column).alias("text"))
    return runtime.written(own.mapInArrow(_segments, SEGMENT))


@dataclass
class Queries:
    """A block of queries: their terms, by number, and how often each query has which; weights once they are known."""

    ids: list[int]
    terms: list[bytes]
    use: list[tuple[np.ndarray, np.ndarray]]
    weight: np.ndarray | None = None
    documents: int = 0
    total: int = 0


def blocks(items: DataFrame, vocabulary: int = VOCABULARY) -> Iterator[Queries]:
    """Queries in blocks; a block is full once it has this many terms."""
    ids, use, number = [], [], {}
    for item, text in items.toLocalIterator():
        counts = Counter(t.encode() for t in TERM.findall(text.translate(SMALL)))
        if not counts:
            continue
        ids.append(item)
        use.append((np.array([number.setdefault(t, len(number)) for t in counts]), np.array(list(counts.values()), np.int64)))
        if len(number) >= vocabulary:
            yield Queries(ids, list(number), use)
            ids, use, number = [], [], {}
    if ids:
        yield Queries(ids, list(number), use)


def _lists(dictionary: bytes, terms: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query term, start, length) of the lists of a segment that the terms have."""
    ends, data, length = spread(dictionary, "i8", "u1", "u4")
    names = pa.Array.from_buffers(pa.large_binary(), len(length), [None, pa.py_buffer(ends), pa.py_buffer(data)])
    at = pc.fill_null(pc.index_in(terms, value_set=names), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    have = np.flatnonzero(at >= 0)
    length = length.astype(np.int64)
    return have, (np.cumsum(length) - length)[at[have]], length[at[have]]


def _frequencies(block):
    """How many documents have which term of the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = pa.array(block.value.terms, pa.large_binary())
        total = np.zeros(len(terms), np.int64)
        for batch in batches:
            for dictionary in batch["dictionary"].to_pylist():
                have, _, length = _lists(dictionary, terms)
                total[have] += length
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["term", "df"])

    return run


def lengths(n: np.ndarray, documents: int, total: int) -> np.ndarray:
    """The m of documents of so many terms."""
    if SLOPE * int(n.max(initial=0)) * documents < 1 << 63:
        return LEVEL + SLOPE * n * documents // total
    return np.array([LEVEL + SLOPE * int(x) * documents // total for x in n], np.int64)


class Best:
    """The k best of a query so far: highest scores first, equal ones by ascending doc_id."""

    def __init__(self, k: int):
        self.k, self.score, self.ids = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    @property
    def last(self) -> int:
        """The kth score; 0, which no document that counts has, while there are fewer."""
        return int(self.score[-1]) if len(self.score) == self.k else 0

    def add(self, score: np.ndarray, ids: np.ndarray) -> None:
        keep = score >= max(1, self.last)
        score, ids = np.r_[self.score, score[keep]], np.r_[self.ids, ids[keep]]
        order = np.lexsort((ids, -score))[: self.k]
        self.score, self.ids = score[order], ids[order]


def threshold_search(best: Best, docs: list[np.ndarray], impacts: list[np.ndarray], forward: np.ndarray, weights: np.ndarray, ids: np.ndarray, seen: np.ndarray) -> int:
    """Fagin's threshold algorithm over lists of (document, impact), sorted by falling impact. ``forward`` has a row for each
    document with what it has of each list's term, of which ``weights`` makes impacts; ``seen`` is a scratch mask, all
    False before and after. Gives how many documents were looked up."""
    at, looked = 0, []
    threshold = sum(int(x[0]) for x in impacts)
    while threshold >= max(1, best.last):
        new = np.concatenate([d[at : at + STEP] for d in docs])
        new = np.unique(new[~seen[new]])
        seen[new] = True
        looked.append(new)
        best.add(forward[new] @ weights, ids[new])
        at += STEP
        # what isn't seen yet stands behind what was read last, or not at all in a list that has ended
        live = [i for i, d in enumerate(docs) if len(d) > at]
        threshold = sum(int(impacts[i][at - 1]) for i in live)
        docs, impacts = [docs[i] for i in live], [impacts[i] for i in live]
    looked = concat(looked, "i8")
    seen[looked] = False
    return len(looked)


def _answers(block, k: int):
    """The k best documents of a task for each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Queries = block.value
        terms = pa.array(own.terms, pa.large_binary())
        best = [Best(k) for _ in own.ids]
        for batch in batches:
            for dictionary, postings in zip(batch["dictionary"].to_pylist(), batch["postings"].to_pylist(), strict=True):
                have, start, length = _lists(dictionary, terms)
                ids, total, doc, tf = spread(postings, "i8", "i8", "u1", "u4")
                doc = doc.view(np.uint16 if len(ids) < 1 << 16 else np.uint32)
                m = lengths(total, own.documents, own.total)
                at, term = ranges(start, length), np.repeat(have, length)
                doc, tf = doc[at].astype(np.int64), tf[at].astype(np.int64)
                rows = max(1, CELLS // len(terms))
                order = np.argsort(doc // rows, kind="stable") if len(ids) > rows else np.arange(len(doc))
                edges = np.searchsorted(doc[order] // rows, np.arange(-(-len(ids) // rows) + 1))
                for i in range(len(edges) - 1):
                    part = order[edges[i] : edges[i + 1]]
                    _one(own, best, term[part], doc[part] - i * rows, tf[part], m[i * rows :], ids[i * rows : (i + 1) * rows])
        task = TaskContext.get().partitionId()
        for q, found in zip(own.ids, best, strict=True):
            n = len(found.ids)
            if n:
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, q)), pa.array(found.ids), pa.array(found.score), pa.array(np.full(n, task, np.int32))], ["item_id", "doc_id", "score", "task"])

    return run


def _one(own: Queries, best: list[Best], term: np.ndarray, doc: np.ndarray, tf: np.ndarray, m: np.ndarray, ids: np.ndarray) -> None:
    """All queries of a block over the postings of one forward table."""
    value = WHOLE * tf // (1000 * tf + CURVE * m[doc])
    forward = np.zeros((len(ids), len(own.terms)), np.int32)
    forward[doc, term] = value
    order = np.lexsort((-value, term))
    doc, impact = doc[order], value[order] * own.weight[term[order]]
    lists = np.searchsorted(term[order], np.arange(len(own.terms) + 1))
    seen = np.zeros(len(ids), bool)
    for found, (use, times) in zip(best, own.use, strict=True):
        held = np.flatnonzero(lists[use + 1] > lists[use])
        use, times = use[held], times[held]
        spans = [slice(a, b) for a, b in zip(lists[use].tolist(), lists[use + 1].tolist(), strict=True)]
        impacts = [impact[s] * t for s, t in zip(spans, times.tolist(), strict=True)]
        columns = _Columns(forward, use)
        threshold_search(found, [doc[s] for s in spans], impacts, columns, own.weight[use] * times, ids, seen)


class _Columns:
    """Some columns of a table, copied only for rows that are asked for."""

    def __init__(self, table: np.ndarray, columns: np.ndarray):
        self.table, self.columns = table, columns

    def __getitem__(self, rows: np.ndarray) -> np.ndarray:
        return self.table[rows[:, None], self.columns].astype(np.int64)


def weigh(index: DataFrame, queries: Queries) -> Queries:
    """The block with the weights of its terms in this index."""
    context = index.sparkSession.sparkContext
    totals = index.agg(F.coalesce(F.sum("docs"), F.lit(0)).alias("n"), F.coalesce(F.sum("total"), F.lit(0)).alias("l")).first()
    sent = context.broadcast(queries)
    counted = index.select("dictionary").mapInArrow(_frequencies(sent), "term bigint, df bigint").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    sent.destroy()
    df = np.zeros(len(queries.terms), np.int64)
    df[counted["term"].to_numpy()] = counted["df"].to_numpy()
    weight = np.array([math.floor(1000 * math.log((2 * totals.n + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
    return Queries(queries.ids, queries.terms, queries.use, weight, totals.n, totals.l)


def answer(index: DataFrame, items: DataFrame, k: int = K, vocabulary: int = VOCABULARY) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of an index for each of items(item_id, text)."""
    spark = index.sparkSession
    asked = items.where("item_id IS NOT NULL AND text IS NOT NULL").groupBy(F.col("item_id").cast("bigint").alias("item_id")).agg(F.min("text").alias("text"))
    path = f"{runtime.shared_folder(spark)}/table-{uuid.uuid4().hex}"
    spark.createDataFrame([], FOUND).write.parquet(path)
    for queries in blocks(asked, vocabulary):
        queries = weigh(index, queries)
        if queries.documents:
            sent = spark.sparkContext.broadcast(queries)
            index.select("dictionary", "postings").mapInArrow(_answers(sent, k), FOUND).write.mode("append").parquet(path)
            sent.destroy()
    found = spark.read.schema(FOUND).parquet(path)
    for by in (["item_id", F.pmod("task", F.lit(SALTS))], ["item_id"]):
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "doc_id"))).where(F.col("rank") <= k)
    out, _ = runtime.written(found.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"))
    runtime.forget(spark, path)
    return out


def search(docs: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """As ``answer``, over an index of ``docs`` that is built for it and deleted after."""
    index, path = build(docs)
    out = answer(index, items, k)
    runtime.forget(docs.sparkSession, path)
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(runtime.table(spark, sf_dir, "documents"), runtime.table(spark, sf_dir, "benchmark"))


SQL = r"""
WITH terms AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t
  FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL
),
docs AS (SELECT r, doc_id, t, CAST(len(t) AS BIGINT) AS n FROM terms WHERE len(t) > 0),
totals AS (SELECT count(*) AS c, CAST(sum(n) AS BIGINT) AS l FROM docs),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(t) AS term FROM docs) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * c + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), totals),
items AS (
  SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT item_id, min(text) AS text FROM benchmark WHERE item_id IS NOT NULL GROUP BY item_id)
),
asked AS (SELECT item_id, term, count(*) AS times FROM items GROUP BY ALL),
scores AS (
  SELECT item_id, r, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * c) // l)))) AS BIGINT) AS score
  FROM asked JOIN w USING (term) JOIN tf USING (term) JOIN docs USING (r), totals GROUP BY item_id, r
),
ranked AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS k FROM scores JOIN docs USING (r) WHERE score > 0)
SELECT item_id, CAST(k AS INTEGER) AS rank, doc_id, score FROM ranked WHERE k <= 20
"""
