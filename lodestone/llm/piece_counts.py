"""Token counts: count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton enumerates the vocabulary's matches in a word; dynamic programming carries the best score
and the piece count of each prefix, not the pieces. Tie rules are those of the public unigram tokenizer: the match that
begins earliest is tried first, and only a strictly better score replaces it; a character that no piece covers is an
unknown piece of the least score less 10. White space becomes the word-start sign as the vocabulary's model writes it,
and words are scored one by one, as no piece goes across a word start. An unknown character counts a piece for each of
its bytes, as the model's byte fallback writes it. Scores are summed in doubles, word by word; the public library sums
floats over a whole text, which round once a text has an unknown character.

The vocabulary file is a merge vocabulary whose scores are ranks; it is used as a unigram vocabulary as it is. Equal
words of a task are counted once, kept in a bounded cache. A map without a shuffle. Defined cases: null or empty text
has no pieces; rows that repeat are counted each; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from pathlib import Path

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import runtime
from .text_arrays import distinct

CACHE, CACHED = 300_000, 256
#: After the last match.
NONE = (-2, None)
SPACE = "▁"
UNKNOWN_PENALTY = 10.0


class Counter:
    def __init__(self, pieces: list[tuple[str, float]], byte_fallback: bool = True):
        """Ordinary pieces and their scores; with ``byte_fallback`` an unknown character is a piece for each byte."""
        self.byte_fallback = byte_fallback
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
        if pieces:
            self.automaton.make_automaton()
        self.longest = max((len(p) for p, _ in pieces), default=1)
        self.unknown = min((s for _, s in pieces), default=0.0) - UNKNOWN_PENALTY
        self.cache: dict[str, int] = {}

    def word(self, word: str) -> int:
        """The number of pieces of the best segmentation. Matches come by their end, longest first; scores and counts are held
        for as many places as the longest piece is long."""
        size = self.longest + 1
        best, count = [0.0] * size, [0] * size
        matches = self.automaton.iter(word) if len(self.automaton) else iter(())
        at, match = next(matches, NONE)
        for end in range(1, len(word) + 1):
            top, pieces, single = None, 0, False
            while at + 1 == end:
                length, score = match
                begin = (end - length) % size
                total = best[begin] + score
                if top is None or total > top:
                    top, pieces = total, count[begin] + 1
                single |= length == 1
                at, match = next(matches, NONE)
            if not single:
                begin = (end - 1) % size
                total = best[begin] + self.unknown
                if top is None or total > top:
                    top, pieces = total, count[begin] + (len(word[end - 1].encode()) if self.byte_fallback else 1)
            best[end % size], count[end % size] = top, pieces
        total = count[len(word) % size]
        if len(word) <= CACHED:
            if len(self.cache) >= CACHE:
                self.cache.clear()
            self.cache[word] = total
        return total

    def texts(self, texts: list[str]) -> np.ndarray:
        """Piece counts of texts. Equal words are looked up once."""
        marked = [(SPACE + t.replace(" ", SPACE)) if t else "" for t in texts]
        whole = "".join(marked)
        out = np.zeros(len(texts), np.int64)
        if not whole:
            return out
        points = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), "<u4")
        sign = points == ord(SPACE)
        edge = sign.copy()
        edge[1:] &= ~sign[:-1]
        begins = np.cumsum([0, *map(len, marked)])[:-1]
        edge[begins[begins < len(points)]] = True
        start = np.flatnonzero(edge)
        end = np.r_[start[1:], len(points)]
        first, inverse = distinct(points, start, end)
        get, count = self.cache.get, self.word
        words = [whole[a:b] for a, b in zip(start[first].tolist(), end[first].tolist(), strict=True)]
        known = np.array([get(w) or count(w) for w in words], np.int64)[inverse]
        row = np.searchsorted(begins, start, "right") - 1
        np.add.at(out, row, known)
        return out


def ordinary_pieces(model: bytes) -> list[tuple[str, float]]:
    """Pieces and scores of a vocabulary model; control, unknown and byte pieces are not matched."""
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_proto=model)
    return [(own.id_to_piece(i), own.get_score(i)) for i in range(own.get_piece_size()) if not (own.is_control(i) or own.is_unknown(i) or own.is_byte(i))]


_LOADED: dict[str, Counter] = {}


def counter(model: bytes) -> Counter:
    key = hashlib.sha256(model).hexdigest()
    if key not in _LOADED:
        _LOADED[key] = Counter(ordinary_pieces(model))
    return _LOADED[key]


def count(df: DataFrame, vocabulary: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per input row: its id and n_pieces. ``vocabulary`` is the path of the model file on the driver."""
    model = df.sparkSession.sparkContext.broadcast(Path(vocabulary).read_bytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(model.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["_id"], pa.array(own.texts([t or "" for t in batch["_text"].to_pylist()]))], ["_id", "n_pieces"])

    kind = df.schema[id_column].dataType.simpleString()
    out = df.select(F.col(id_column).alias("_id"), F.col(text_column).alias("_text")).mapInArrow(run, f"_id {kind}, n_pieces bigint")
    return out.withColumnRenamed("_id", id_column)


def public_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count(runtime.table(spark, sf_dir, "documents"), public_vocabulary())
