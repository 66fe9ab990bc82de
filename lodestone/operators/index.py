"""The versioned chunk index: text windows, the fold of an index log into current versions, and lexical search."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, StringType

from lodestone.functions import policy
from lodestone.operators import inverted

CHUNK, OVERLAP, MOST_QUERIES = 800, 100, 1024
#: Chunks that are scored at once.
SCORED = 2048


def windows(texts: list[str | None], size: int = CHUNK, overlap: int = OVERLAP) -> list[list[str]]:
    """Windows of at most ``size`` characters of each text, overlapping by ``overlap``. A window that isn't the last ends at
    the last line end or blank of its second half, if there is one.

    The breaks of all texts are found once, as places in one array of code points; then every text takes its next
    window at the same time, by a search among the breaks.
    """
    clean = ["\n".join(map(str.strip, t.splitlines())).strip() if t else "" for t in texts]
    length = np.array([len(t) for t in clean], np.int64)
    origin = np.cumsum(length) - length
    points = np.frombuffer("".join(clean).encode("utf-32-le", "surrogatepass"), "<u4")
    breaks = np.r_[-1, np.flatnonzero((points == 10) | (points == 32))]
    out: list[list[str]] = [[] for _ in clean]
    row, at = np.flatnonzero(length), np.zeros(int((length > 0).sum()), np.int64)
    while len(row):
        end = np.minimum(at + size, length[row])
        last = breaks[np.searchsorted(breaks, origin[row] + end) - 1] - origin[row]
        end = np.where((end < length[row]) & (last >= at + size // 2), last, end)
        for i, a, b in zip(row.tolist(), at.tolist(), end.tolist(), strict=True):
            if piece := clean[i][a:b].strip():
                out[i].append(piece)
        more = end < length[row]
        row, at, end = row[more], at[more], end[more]
        at = np.where(end - overlap > at, end - overlap, end)
    return out


@pandas_udf(ArrayType(StringType()))
def chunk_array(text: pd.Series) -> pd.Series:
    return pd.Series(windows(text.tolist()))


def chunks(df: DataFrame, text: str = "text") -> DataFrame:
    """One row for each chunk of ``text``, with its number from 0, in place of the text."""
    keys = [c for c in df.columns if c != text]
    return df.select(*keys, F.posexplode(chunk_array(text)).alias("chunk_index", "chunk"))


def current_versions(log: DataFrame) -> DataFrame:
    """(document_id, current_sha256, rejected): the index log folded in order.

    INDEX makes its version current if ``expected`` is null or equals the current version (`` `` stands for none);
    REMOVE deletes a version and, if it was current, restores the newest one left. One document's log is one array, so
    its length is bounded by the edits of one document.
    """
    entry = F.struct("seq", "op", "sha256", "expected")
    logs = log.groupBy("document_id").agg(F.array_sort(F.collect_list(entry)).alias("log"))
    start = F.struct(F.lit(None).cast("string").alias("current"), F.expr("CAST(array() AS array<struct<seq:bigint,sha256:string>>)").alias("kept"), F.lit(0).alias("rejected"))

    def step(state: F.Column, e: F.Column) -> F.Column:
        current, kept, rejected = state["current"], state["kept"], state["rejected"]
        stale = e["expected"].isNotNull() & ~e["expected"].eqNullSafe(F.coalesce(current, F.lit("")))
        others = F.filter(kept, lambda v: v["sha256"] != e["sha256"])
        indexed = F.concat(others, F.array(F.struct(e["seq"].cast("bigint").alias("seq"), e["sha256"].alias("sha256"))))
        newest = F.element_at(F.array_sort(others), -1)["sha256"]
        restored = F.when(F.size(others) > 0, newest)
        is_index = e["op"] == "INDEX"
        return F.struct(
            F.when(is_index, F.when(stale, current).otherwise(e["sha256"])).when(current == e["sha256"], restored).otherwise(current).alias("current"),
            F.when(is_index, F.when(stale, kept).otherwise(indexed)).otherwise(others).alias("kept"),
            (rejected + F.when(is_index & stale, 1).otherwise(0)).alias("rejected"),
        )

    folded = logs.select("document_id", F.aggregate("log", start, step).alias("s"))
    return folded.select("document_id", F.col("s.current").alias("current_sha256"), F.size("s.kept").alias("versions"), F.col("s.rejected").alias("rejected"))


def applied(gated: DataFrame) -> DataFrame:
    """``current_versions`` after a gate's actions (document_id, action, base_sha256, cand_sha256, was_indexed): INDEX puts the
    candidate in place of the baseline it was compared with; anything else takes it out where it had been indexed, which
    restores the version before it."""
    entry = lambda seq, op, sha, expected: F.struct(F.lit(seq).cast("bigint").alias("seq"), F.lit(op).alias("op"), sha.alias("sha256"), expected.alias("expected"))
    none, base, cand = F.lit(None).cast("string"), F.col("base_sha256"), F.col("cand_sha256")
    index = F.col("action") == "INDEX"
    log = F.array_compact(
        F.array(
            F.when(base.isNotNull(), entry(1, "INDEX", base, none)),
            F.when(F.col("was_indexed") & ~index, entry(2, "INDEX", cand, none)),
            F.when(index, entry(3, "INDEX", cand, F.coalesce(base, F.lit("")))).otherwise(entry(3, "REMOVE", cand, none)),
        )
    )
    return current_versions(gated.select("document_id", F.inline(log)))


def terms_of(query: Column) -> Column:
    """The distinct words of a folded query."""
    return F.array_distinct(F.regexp_extract_all(query, F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1)))


class Scorer:
    """Scores of folded chunks for a block of queries: three points for each time that the whole query stands in a chunk,
    one for each time that one of its distinct words does, without overlaps of the same text. One automaton finds all."""

    def __init__(self, queries: list[tuple[int, str, list[str]]], k: int):
        self.ids, self.k = np.array([q[0] for q in queries]), k
        weight: dict[str, dict[int, int]] = {}
        for n, (_, whole, terms) in enumerate(queries):
            for text, points in ((whole, 3), *((t, 1) for t in terms)):
                of = weight.setdefault(text, {})
                of[n] = of.get(n, 0) + points
        self.finder = ahocorasick.Automaton()
        for n, text in enumerate(weight):
            self.finder.add_word(text, (n, len(text)))
        self.finder.make_automaton()
        self.start = np.cumsum([0, *map(len, weight.values())])
        self.query = np.array([q for of in weight.values() for q in of], np.int64)
        self.points = np.array([p for of in weight.values() for p in of.values()], np.int64)

    def scores(self, texts: list[str]) -> np.ndarray:
        """A row for each text, a column for each query."""
        at, found = [], []
        for i, text in enumerate(texts):
            free: dict[int, int] = {}
            for end, (n, size) in self.finder.iter(text):
                if end - size >= free.get(n, -1):
                    free[n] = end
                    at.append(i)
                    found.append(n)
        found = np.array(found, np.int64)
        many = self.start[found + 1] - self.start[found]
        ends = np.cumsum(many)
        place = np.arange(int(many.sum())) + np.repeat(self.start[found] - (ends - many), many)
        cell = np.repeat(np.array(at, np.int64), many) * len(self.ids) + self.query[place]
        return np.bincount(cell, self.points[place], len(texts) * len(self.ids)).astype(np.int64).reshape(len(texts), -1)

    def best(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What can be among the ``k`` best of a query: of each run of chunks those that score no less than its kth."""
        kth = np.ones(len(self.ids), np.int64)
        for batch in batches:
            texts = batch["t"].to_pylist()
            for i in range(0, len(texts), SCORED):
                score = self.scores([t or "" for t in texts[i : i + SCORED]])
                if len(score) >= self.k:
                    kth = np.maximum(kth, np.partition(score, len(score) - self.k, axis=0)[len(score) - self.k])
                row, q = np.nonzero(score >= kth)
                at = pa.array(i + row)
                yield pa.RecordBatch.from_arrays([pa.array(self.ids[q]), batch["doc_id"].take(at), batch["chunk_index"].take(at), pa.array(score[row, q])], ["query_id", "doc_id", "chunk_index", "score"])


def search(index: DataFrame, queries: list[tuple[int, str]] | DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, doc_id, chunk_index, score): the best chunks for each query (id, text); none for a blank one.

    Queries are dealt by hash into blocks of about ``MOST_QUERIES``, each of which goes to all chunks; chunks stay where
    they are, and only what can be among the best is shuffled. Rows of one query id are queries of their own.
    """
    spark = index.sparkSession
    asked = queries if isinstance(queries, DataFrame) else spark.createDataFrame(queries, "query_id bigint, query string")
    rows = asked.toDF("query_id", "query").where(F.col("query").rlike(r"\S")).withColumn("q", policy.casefold(F.col("query")))
    rows = rows.select(F.col("query_id").cast("bigint").alias("query_id"), "q", terms_of(F.col("q")).alias("terms"))
    folded = index.select("doc_id", "chunk_index", policy.casefold(F.col("chunk")).alias("t"))
    kinds = {f.name: f.dataType.simpleString() for f in index.schema}
    schema = f"query_id bigint, doc_id {kinds['doc_id']}, chunk_index {kinds['chunk_index']}, score bigint"
    blocks = -(-rows.count() // MOST_QUERIES)
    found = []
    for b in range(blocks):
        mine = sorted((r.query_id, r.q, r.terms) for r in rows.where(F.pmod(F.xxhash64("query_id", "q"), F.lit(blocks)) == b).collect())
        if mine:
            scorer = spark.sparkContext.broadcast((mine, k))
            found.append(folded.mapInArrow(lambda batches, s=scorer: Scorer(*s.value).best(batches), schema))
    if not found:
        return spark.createDataFrame([], f"query_id bigint, rank int, doc_id {kinds['doc_id']}, chunk_index {kinds['chunk_index']}, score bigint")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id", "chunk_index")
    ranked = reduce(DataFrame.union, found).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "doc_id", "chunk_index", "score")


def chunks_of(index: DataFrame, versions: DataFrame, sha256: Column | None = None) -> DataFrame:
    """The chunks (document_id, sha256, chunk_index, …) of documents' current versions (document_id, current_sha256), or of
    the version that is named: an equi-join on both."""
    wanted = versions.select("document_id", (F.col("current_sha256") if sha256 is None else sha256).alias("sha256"))
    return index.join(wanted, ["document_id", "sha256"], "left_semi")


def chunk_counts(index: DataFrame, versions: DataFrame, sha256: Column | None = None) -> DataFrame:
    """(document_id, sha256, n_chunks) of the versions that ``chunks_of`` reads; a version without chunks counts 0."""
    wanted = versions.select("document_id", (F.col("current_sha256") if sha256 is None else sha256).alias("sha256")).where("sha256 IS NOT NULL")
    counted = index.groupBy("document_id", "sha256").agg(F.count("*").alias("n"))
    return wanted.join(counted, ["document_id", "sha256"], "left").select("document_id", "sha256", F.coalesce("n", F.lit(0)).alias("n_chunks"))


def search_current(index: DataFrame, versions: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, document_id, sha256, chunk_index, score) over current versions only. ``index`` and ``versions``
    are read as they are passed: tables pinned to one version give one consistent answer."""
    own = chunks_of(index, versions)
    hits = inverted.search_once(own.select(F.struct("document_id", "sha256").alias("doc_id"), "chunk_index", "chunk"), queries, k)
    return hits.select("query_id", "rank", "doc_id.document_id", "doc_id.sha256", "chunk_index", "score")
