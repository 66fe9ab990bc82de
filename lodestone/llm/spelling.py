"""Spelling variant grouping by a symmetric-delete join.

1. ``counts``: the words of all texts and how often each comes; a batch counts its own before anything is shuffled.
2. Keys. Every word gives itself and its distinct single deletions, as 64-bit prints of code points, in time linear in the
   word: a deletion's print is made of prefix sums, no string is cut. Words of one key may differ by one edit; an equi-join
   on keys gives candidate pairs. A key is shared by itself and words with one more code point, so by at most
   (letters * (length + 1) + 1) words whatever the corpus: no key is hot, however frequent its words are.
3. Pairs are held against the words themselves: exactly one inserted, deleted or replaced code point.
4. Near words are aggregated by word; the form is the most frequent one, where that is ``RATIO`` times as frequent.
5. Roots by pointer doubling: form of form. A form is ``RATIO`` times as frequent as its word, so the greatest count bounds
   the length of chains and the number of rounds; each round is a join of the table of the round before, written to the
   shared folder.

Prints only deal and join: pairs are verified by content, also between words whose prints collide.

Defined cases: null or empty text has no words; rows with a null doc_id take no part; rows of one doc_id count each; ties go
to the smaller word in code-point order; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import runtime
from .text_arrays import BASE_INVERSE, LOWER, Prefix, distinct, mix, pieces, ranges, runs, utf8

#: Words have this many code points and occurrences at least.
LETTERS, OCCURRENCES = 6, 5
#: A form is so many times as frequent as its word.
RATIO = 5
#: One of so many (doc_id, word) is misspelt, by its crc32.
MISSPELT = 199

#: ``[A-Za-z\\u00C0-\\u00FF]``, in UTF-8: ASCII letters, and 0xC3 with the byte after it.
LEAD = 0xC3
INSIDE = np.zeros(256, bool)
INSIDE[65:91] = INSIDE[97:123] = INSIDE[LEAD] = True


def _crc_table() -> np.ndarray:
    value = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        value = (value >> np.uint32(1)) ^ np.where(value & np.uint32(1), np.uint32(0xEDB88320), np.uint32(0))
    return value


CRC = _crc_table()


def crc32(seed: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The crc32 of spans of bytes, each after what has the crc32 ``seed``."""
    out = ~seed.astype(np.uint32)
    order = np.argsort(start - end, kind="stable")  # longest first
    at, left, value = start[order], (end - start)[order], out[order]
    for i in range(min(64, int(left[0]) if len(left) else 0)):
        n = np.searchsorted(-left, -i, "left")
        value[:n] = CRC[(value[:n] ^ data[at[:n] + i]) & np.uint32(255)] ^ (value[:n] >> np.uint32(8))
    out[order] = ~value
    for i in np.flatnonzero(end - start > 64).tolist():
        out[i] = zlib.crc32(data[start[i] : end[i]].tobytes(), int(seed[i]))
    return out


def misspelt(word: str, h: int) -> str:
    """The word without its code point h % length."""
    at = h % len(word)
    return word[:at] + word[at + 1 :]


def _words(low: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row, code points) of the runs that may be words."""
    inside = INSIDE[low]
    after = np.flatnonzero(low[:-1] == LEAD) + 1
    inside[after] = True
    start, end, row = runs(inside, offsets)
    wide = np.r_[0, np.cumsum(low == LEAD)]
    points = end - start - (wide[end] - wide[start])
    long = points >= LETTERS
    return start[long], end[long], row[long], points[long]


def _counts(noise: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(batch["doc_id"].is_valid())
            data, offsets = utf8(batch["text"])
            seeds = np.array([zlib.crc32(b"%d:" % i) for i in batch["doc_id"].to_pylist()], np.uint32)
            for a, b in pieces(offsets):
                low = LOWER[data[offsets[a] : offsets[b]]]
                start, end, row, points = _words(low, offsets[a : b + 1] - offsets[a])
                cut: Counter[str] = Counter()
                if noise and len(start):
                    h = crc32(seeds[a + row], low, start, end)
                    hit = h % np.uint32(noise) == 0
                    for i in np.flatnonzero(hit & (points > LETTERS)).tolist():
                        cut[misspelt(low[start[i] : end[i]].tobytes().decode(), int(h[i]))] += 1
                    start, end = start[~hit], end[~hit]
                if len(start):
                    first, same = distinct(low, start, end)
                    size = (end - start)[first]
                    ends = np.r_[0, np.cumsum(size)].astype(np.int64)
                    names = pa.Array.from_buffers(pa.large_string(), len(first), [None, pa.py_buffer(ends), pa.py_buffer(low[ranges(start[first], size)])])
                    yield pa.RecordBatch.from_arrays([names.cast(pa.string()), pa.array(np.bincount(same).astype(np.int64))], ["word", "n"])
                if cut:
                    yield pa.RecordBatch.from_arrays([pa.array(list(cut)), pa.array(list(cut.values()), pa.int64())], ["word", "n"])

    return run


def counts(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", least: int = OCCURRENCES, noise: int | None = MISSPELT) -> DataFrame:
    """(word, n) of all words that come ``least`` times or more. One of ``noise`` (document, word) loses a code point by the
    rule of the contract; none with None."""
    own = docs.select(F.col(id_column).cast("bigint").alias("doc_id"), F.col(text_column).alias("text"))
    return own.mapInArrow(_counts(noise), "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def deletion_prints(points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(print, row) of each word and of its distinct single deletions; words are rows of code points."""
    size = np.diff(offsets)
    total = Prefix(points)
    sums, down = total.sums, total.down
    start, end = offsets[:-1], offsets[1:]
    whole = mix((sums[end] - sums[start]) * down[start] + size.astype(np.uint64))
    row = np.repeat(np.arange(len(size)), size)
    at = np.arange(len(points))
    # of equal code points in a row only the first: without any of them the rest is the same
    fresh = np.ones(len(points), bool)
    fresh[1:] = (points[1:] != points[:-1]) | (row[1:] != row[:-1])
    row, at = row[fresh], at[fresh]
    before = (sums[at] - sums[start[row]]) * down[start[row]]
    behind = (sums[end[row]] - sums[at + 1]) * down[start[row]] * np.uint64(BASE_INVERSE)
    cut = mix(before + behind + (size[row] - 1).astype(np.uint64))
    return np.r_[whole, cut], np.r_[np.arange(len(size)), row]


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch["id"].to_numpy()
        texts = batch["word"].to_pylist()
        held: list[str] = []
        first = size = 0
        for i, text in enumerate(texts):
            held.append(text)
            size += len(text)
            if size > 1 << 17 or i + 1 == len(texts):
                points = np.frombuffer("".join(held).encode("utf-32-le"), np.uint32)
                key, row = deletion_prints(points, np.cumsum([0, *map(len, held)]))
                for a in range(0, len(key), 1 << 18):
                    yield pa.RecordBatch.from_arrays([pa.array(key[a : a + (1 << 18)].view(np.int64)), pa.array(ids[first + row[a : a + (1 << 18)]])], ["key", "id"])
                first, held, size = i + 1, [], 0


def near(words: DataFrame) -> DataFrame:
    """(word, near, n, near_n), both ways, of words(word, n, id) that differ by one code point; ``id`` is any print of the word."""
    keys = words.select("word", "id").mapInArrow(_keys, "key bigint, id bigint")
    pairs = keys.select("key", F.col("id").alias("one")).join(keys.select("key", F.col("id").alias("two")), "key").where("one <= two").select("one", "two").distinct()
    side = lambda name: words.select(F.col("id").alias(name), F.struct("word", "n").alias(f"{name}_word"))
    met = pairs.join(side("one"), "one").join(side("two"), "two")
    met = met.where((F.levenshtein("one_word.word", "two_word.word", 1) == 1) & ((F.col("one") < F.col("two")) | (F.col("one_word.word") < F.col("two_word.word"))))
    both = met.select(F.explode(F.array(F.struct(F.col("one_word").alias("a"), F.col("two_word").alias("b")), F.struct(F.col("two_word").alias("a"), F.col("one_word").alias("b")))).alias("p"))
    return both.select("p.a.word", F.col("p.b.word").alias("near"), "p.a.n", F.col("p.b.n").alias("near_n"))


def roots(linked: DataFrame, longest: int) -> tuple[DataFrame, str]:
    """(word, root) of linked(word, form) whose chains have at most ``longest`` steps, and the path of its table."""
    table, path = runtime.written(linked.select("word", F.col("form").alias("root")))
    for _ in range(max(0, math.ceil(math.log2(longest))) if longest > 1 else 0):
        further = table.select(F.col("word").alias("root"), F.col("root").alias("further"))
        old = path
        table, path = runtime.written(table.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root")))
        runtime.forget(linked.sparkSession, old)
    return table, path


def variants(counted: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of counted(word, n)."""
    spark = counted.sparkSession
    words, path = runtime.written(counted.withColumn("id", F.xxhash64("word")))
    best = near(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form"))).alias("best"))
    form_n = -F.col("best.less")
    strong = form_n >= F.col("n") * ratio
    formed = words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(strong, F.col("best.form")).alias("form"), F.when(strong, form_n).alias("form_n")
    )
    formed, kept = runtime.written(formed)
    most = formed.agg(F.max("n").alias("most"), F.min("n").alias("least")).first()
    longest = int(math.log(most.most / max(1, most.least), ratio)) + 1 if most.most else 0
    linked, last = roots(formed.where("form IS NOT NULL"), longest)
    out = formed.join(linked, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
    out, _ = runtime.written(out)
    for old in (path, kept, last):
        runtime.forget(spark, old)
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(counts(runtime.table(spark, sf_dir, "documents")))


SQL = r"""
WITH RECURSIVE runs AS (
  SELECT doc_id, run, count(*) AS n, length(run) AS size
  FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents WHERE doc_id IS NOT NULL)
  WHERE length(run) >= 6 GROUP BY ALL
),
crc AS (
  SELECT *, xor(4294967295, list_reduce(
    flatten(list_transform(string_split(doc_id || ':' || run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [CAST(unicode(c) AS BIGINT)] ELSE [CAST(195 AS BIGINT), unicode(c) - 64] END)),
    lambda c, b: list_reduce([CAST(1 AS BIGINT), 2, 3, 4, 5, 6, 7, 8], lambda v, i: xor(v >> 1, CASE WHEN v & 1 = 1 THEN 3988292384 ELSE 0 END), xor(c, b)),
    CAST(4294967295 AS BIGINT))) AS h
  FROM runs
),
words AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n
  FROM (SELECT n, CASE WHEN h % 199 = 0 THEN substr(run, 1, h % size) || substr(run, h % size + 2) ELSE run END AS word FROM crc)
  WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5
),
-- levenshtein compares bytes here: each further letter becomes an ASCII character that no word has
bytes AS (
  SELECT word, n, translate(word, (SELECT string_agg(chr(CAST(i AS INTEGER)), '' ORDER BY i) FROM range(192, 256) t(i)), (SELECT string_agg(chr(CAST(i AS INTEGER)), '' ORDER BY i) FROM range(33, 97) t(i))) AS b
  FROM words
),
near AS (
  SELECT a.word, a.n, b.word AS near, b.n AS near_n
  FROM bytes a JOIN bytes b ON length(b.b) BETWEEN length(a.b) - 1 AND length(a.b) + 1 AND a.word <> b.word AND levenshtein(a.b, b.b) = 1
),
best AS (SELECT word, count(*) AS n_near, arg_min(near, (-near_n, near)) AS form, max(near_n) AS form_n FROM near GROUP BY word),
formed AS (
  SELECT word, words.n, coalesce(n_near, 0) AS n_near, CASE WHEN best.form_n >= 5 * words.n THEN form END AS form, CASE WHEN best.form_n >= 5 * words.n THEN best.form_n END AS form_n
  FROM words LEFT JOIN best USING (word)
),
chain AS (
  SELECT word, word AS root FROM formed
  UNION ALL
  SELECT chain.word, formed.form FROM chain JOIN formed ON formed.word = chain.root WHERE formed.form IS NOT NULL
)
SELECT f.word, f.form, c.root, f.n, CAST(f.n_near AS BIGINT) AS n_near, f.form_n
FROM formed f JOIN chain c ON c.word = f.word JOIN formed r ON r.word = c.root AND r.form IS NULL
"""
