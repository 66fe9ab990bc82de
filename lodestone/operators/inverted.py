"""An inverted index over chunks, and substring search by it.

A chunk scores three points for each time that the whole query stands in it and one for each time that a distinct word of
the query does, as substrings. A word of the query holds word characters only, so wherever it stands it lies within one
maximal run of them: its count in a chunk is the sum, over the chunk's tokens, of its count in the token times the
token's. So words are looked up in the dictionary of tokens, and texts aren't read at all:

* ``chunks`` (ref, doc_id, chunk_index, t): folded chunks, numbered as they are written; ``BLOCK`` numbers are a block.
* ``postings`` (bucket, token, block, most, places, counts): of a token, the chunks of a block that hold it, and the
  greatest count. A folder for each bucket of tokens, so that a query reads the buckets of its own tokens. Lists are made
  where the chunks lie; a block that two tasks read has two lists of a token, which add up.
* ``dictionary`` (token): the distinct tokens.

One automaton of the words of all queries of a pass finds the tokens that hold them; the tokens' lists meet by block. There
the greatest counts bound every query's score: blocks that can't reach the kth best so far are passed over; of the others
come the chunks that may be among the best, with what their words score. The whole query can stand only in chunks that
hold all its words: only their texts are read, and counted exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone import session
from lodestone.functions import policy
from lodestone.sources import scratch

#: Chunks of a block; folders of postings; cells that are counted at once; queries and distinct words of a pass.
BLOCK, BUCKETS, CELLS = 4096, 32, 1 << 22
MOST_QUERIES, MOST_WORDS = 1024, 4096
WORD = r"([\p{L}\p{N}_]+)"


@dataclass
class Index:
    """The tables of an index, and their paths."""

    chunks: DataFrame
    postings: DataFrame
    dictionary: DataFrame
    paths: tuple[str, ...]
    block: int

    def forget(self) -> None:
        for path in self.paths:
            scratch.forget(self.chunks.sparkSession, path)


def words(text: F.Column) -> F.Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(1))


LISTS = "token string, block bigint, most int, places array<int>, counts array<int>"


def _listed(size: int):
    """The lists of runs of chunks (ref, w), w being the tokens of each in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = None, []

        def close() -> pa.RecordBatch:
            tokens = pa.concat_arrays([t for t, _ in held]).dictionary_encode()
            place = np.concatenate([p for _, p in held])
            key, n = np.unique(tokens.indices.to_numpy().astype(np.int64) * size + place, return_counts=True)
            token, place = np.divmod(key, size)
            first = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
            ends = pa.array(np.r_[first, len(token)].astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (place, n)]
            most = np.maximum.reduceat(n, first).astype(np.int32)
            return pa.RecordBatch.from_arrays([tokens.dictionary.take(pa.array(token[first])), pa.array(np.full(len(first), block)), pa.array(most), *lists], ["token", "block", "most", "places", "counts"])

        for batch in batches:
            ref, lists = batch["ref"].to_numpy(), batch["w"]
            ends = lists.offsets.to_numpy()
            edge = np.flatnonzero(np.r_[True, ref[1:] // size != ref[:-1] // size, True]) if len(ref) else []
            for a, b in zip(edge[:-1], edge[1:], strict=True):
                if held and ref[a] // size != block:
                    yield close()
                    held = []
                block = int(ref[a] // size)
                if ends[b] > ends[a]:
                    held.append((lists.values.slice(ends[a], ends[b] - ends[a]), np.repeat(ref[a:b] % size, np.diff(ends[a : b + 1]))))
        if held:
            yield close()

    return run


def build(rows: DataFrame, size: int = BLOCK) -> Index:
    """The index of rows(doc_id, chunk_index, chunk) in blocks of at most ``size``; a null chunk holds nothing."""
    session.ship(rows.sparkSession)
    folded = rows.select("doc_id", "chunk_index", policy.casefold(F.col("chunk")).alias("t")).where("t IS NOT NULL")
    chunks, first = scratch.written(folded.withColumn("ref", F.monotonically_increasing_id()))
    lists = chunks.select("ref", words(F.col("t")).alias("w")).mapInArrow(_listed(size), LISTS).withColumn("bucket", F.pmod(F.xxhash64("token"), F.lit(BUCKETS)).cast("int"))
    postings, second = scratch.written(lists.hint("rebalance", "bucket").sortWithinPartitions("bucket", "token", "block"), "bucket")
    dictionary, third = scratch.written(postings.select("token").distinct())
    return Index(chunks, postings, dictionary, (first, second, third), size)


def passes(asked: DataFrame) -> Iterator[list[tuple[int, int, str, list[str]]]]:
    """Queries (number, query_id, folded text, distinct words) of asked(query_id, query), as many as a pass takes."""
    rows = asked.toDF("query_id", "query").where(F.col("query").rlike(r"\S")).withColumn("q", policy.casefold(F.col("query")))
    held, seen = [], set()
    for row in rows.select("query_id", "q", F.array_distinct(words(F.col("q"))).alias("terms")).toLocalIterator():
        held.append((len(held), row.query_id, row.q, row.terms))
        seen.update(row.terms)
        if len(held) >= MOST_QUERIES or len(seen) >= MOST_WORDS:
            yield held
            held, seen = [], set()
    if held:
        yield held


HIT = "token string, words array<int>, times array<int>"


def _hits(shared):
    """The tokens that hold words, which ones, and how often without overlaps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = ahocorasick.Automaton()
        for n, word in enumerate(shared.value):
            finder.add_word(word, (n, len(word)))
        finder.make_automaton()
        for batch in batches:
            out = []
            for token in batch["token"].to_pylist():
                free: dict[int, int] = {}
                times: dict[int, int] = {}
                for end, (n, length) in finder.iter(token):
                    if end - length >= free.get(n, -1):
                        free[n] = end
                        times[n] = times.get(n, 0) + 1
                if times:
                    out.append((token, list(times), list(times.values())))
            columns = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32())), strict=True)], ["token", "words", "times"])

    return run


def _flat(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column, one after the other, and how many each row has."""
    ends = column.offsets.to_numpy()
    return column.values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]].astype(np.int64), np.diff(ends).astype(np.int64)


def _counted(held: list[list[np.ndarray]], count: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """How often each word stands in each chunk of a block, and at most in any."""
    most, places, listed, counts, words, hit, times = (np.concatenate([h[i] for h in held]) for i in range(7))
    row, start = np.repeat(np.arange(len(hit)), hit), np.cumsum(listed) - listed
    bound = np.bincount(words, times * most[row], count).astype(np.int64)
    total, length = np.zeros(count * size, np.int32), listed[row]
    cut = np.flatnonzero(np.diff(np.cumsum(length) // CELLS, prepend=-1))
    for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(row)], strict=True):
        n = length[a:b]
        ends = np.cumsum(n)
        at = np.arange(int(n.sum())) + np.repeat(start[row[a:b]] - (ends - n), n)
        np.add.at(total, np.repeat(words[a:b], n) * size + places[at], (np.repeat(times[a:b], n) * counts[at]).astype(np.int32))
    return total.reshape(count, size), bound


def _scored(shared, k: int, size: int):
    """Of rows (block, most, places, counts, words, times) sorted by block: the chunks that may be among the ``k`` best of a
    query, with what its words score and how often it may stand there whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, count = shared.value
        kth = np.ones(len(queries), np.int64)

        def close(block: int, held: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
            total, bound = _counted(held, count, size)
            out = []
            for q, own in enumerate(queries):
                if bound[own].sum() + 3 * bound[own].min() < kth[q]:
                    continue
                rows = total[own]
                score, whole = rows.sum(0, dtype=np.int64), rows.min(0)
                kth[q] = max(kth[q], np.partition(score, size - k)[size - k] if k < size else 0)
                at = np.flatnonzero(score + 3 * whole >= kth[q])
                out.append((np.full(len(at), q), block * size + at, score[at], whole[at]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), pa.int64(), pa.int32()), strict=True)], ["q", "ref", "score", "whole"])

        block, held = None, []
        for batch in batches:
            blocks = batch["block"].to_numpy()
            edge = np.flatnonzero(np.r_[True, blocks[1:] != blocks[:-1], True]) if len(blocks) else []
            for a, b in zip(edge[:-1], edge[1:], strict=True):
                if held and blocks[a] != block:
                    yield from close(block, held)
                    held = []
                block, part = int(blocks[a]), batch.slice(a, b - a)
                (places, listed), (counts, _), (words, hit), (times, _) = (_flat(part[c]) for c in ("places", "counts", "words", "times"))
                held.append([part["most"].to_numpy().astype(np.int64), places, listed, counts, words, hit, times])
        if held:
            yield from close(block, held)

    return run


def _by_words(index: Index, queries: list[tuple[int, int, str, list[str]]], k: int) -> tuple[DataFrame, str]:
    """(q, ref, score) of queries with words, what may be among the best of each, and the path of their table."""
    spark = index.chunks.sparkSession
    number: dict[str, int] = {}
    own = [np.array([number.setdefault(t, len(number)) for t in terms]) for *_, terms in queries]
    words = spark.sparkContext.broadcast(list(number))
    hits = index.dictionary.mapInArrow(_hits(words), HIT)
    hits, path = scratch.written(hits.withColumn("bucket", F.pmod(F.xxhash64("token"), F.lit(BUCKETS)).cast("int")))
    words.destroy()
    # the buckets that are asked for, which are at most BUCKETS: the folders of others aren't read
    used = [r.bucket for r in hits.select("bucket").distinct().collect()]
    lists = index.postings.where(F.col("bucket").isin(used)).join(hits, ["bucket", "token"]).select("block", "most", "places", "counts", "words", "times")
    shared = spark.sparkContext.broadcast((own, len(number)))
    met = lists.repartition("block").sortWithinPartitions("block").mapInArrow(_scored(shared, k, index.block), "q int, ref bigint, score bigint, whole int")
    best, kept = scratch.written(met)
    shared.destroy()
    texts = spark.createDataFrame([(n, q) for n, (*_, q, _) in enumerate(queries)], "q int, query string")
    # texts of those only that may hold the whole query; an inner join, as all others have their score
    maybe = best.where("whole > 0").join(F.broadcast(texts), "q").join(index.chunks.select("ref", "t"), "ref")
    exact = maybe.select("q", "ref", (F.col("score") + 3 * policy.occurrences(F.col("t"), F.col("query"))).alias("score"))
    out, last = scratch.written(best.where("whole = 0").select("q", "ref", "score").union(exact))
    for old in (path, kept):
        scratch.forget(spark, old)
    return out, last


def search(index: Index, asked: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, doc_id, chunk_index, score): the best chunks for each of asked(query_id, query); none for a blank one.
    Rows of one query id are queries of their own. A query without a word is counted in all chunks, which no list tells."""
    spark = index.chunks.sparkSession
    kinds = {f.name: f.dataType.simpleString() for f in index.chunks.schema}
    schema = f"q int, query_id bigint, rank int, doc_id {kinds['doc_id']}, chunk_index {kinds['chunk_index']}, score bigint"
    place = scratch.new_path(spark)
    spark.createDataFrame([], schema).write.parquet(place)
    for number, queries in enumerate(passes(asked)):
        worded, plain, old = [q for q in queries if q[3]], [q for q in queries if not q[3]], None
        found = spark.createDataFrame([], "q int, ref bigint, score bigint")
        if worded:
            by_words, old = _by_words(index, worded, k)
            names = spark.createDataFrame([(n, q[0]) for n, q in enumerate(worded)], "q int, own int")
            found = by_words.join(F.broadcast(names), "q").select(F.col("own").alias("q"), "ref", "score")
        if plain:
            texts = F.array(*[F.struct(F.lit(q[0]).cast("int").alias("q"), F.lit(q[2]).alias("query")) for q in plain])
            each = index.chunks.select("ref", "t", F.explode(texts).alias("a")).select("a.q", "ref", (3 * policy.occurrences(F.col("t"), F.col("a.query"))).alias("score"))
            found = found.union(each.where("score > 0"))
        named = spark.createDataFrame([(q[0], q[1]) for q in queries], "q int, query_id bigint")
        hits = found.join(index.chunks.select("ref", "doc_id", "chunk_index"), "ref").join(F.broadcast(named), "q")
        order = Window.partitionBy("q").orderBy(F.desc("score"), "doc_id", "chunk_index")
        ranked = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        ranked.select((F.col("q") + number * MOST_QUERIES).cast("int").alias("q"), "query_id", F.col("rank").cast("int").alias("rank"), "doc_id", "chunk_index", "score").write.mode("append").parquet(place)
        if old:
            scratch.forget(spark, old)
    return spark.read.schema(schema).parquet(place).drop("q")


def search_once(rows: DataFrame, asked: DataFrame, k: int = 5) -> DataFrame:
    """``search`` over rows(doc_id, chunk_index, chunk) by an index that goes when the answers are there."""
    index = build(rows)
    out = search(index, asked, k)
    index.forget()
    return out
