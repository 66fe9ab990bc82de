"""BPE encoding and decoding with a public byte-level vocabulary, exactly as its tokenizer does it.

Encoding is a backtracking encoder. An Aho-Corasick automaton over the vocabulary gives the longest token that starts
at each place; a token may follow another only if the merges would leave the two apart (the pair-compatibility table,
filled as pairs are met); where no token can follow, the encoder steps back and tries the next shorter one. Places
that failed are marked, so each is visited a bounded number of times and the time is linear. Texts are first cut at
added tokens and by the vocabulary's split pattern; equal pieces of a task are encoded once, kept in a bounded cache.

Decoding gathers token bytes through an offset table: one byte array of all tokens and where each begins.

A map without a shuffle; the vocabulary is read once by the driver and reaches the tasks as a broadcast of a size
bounded by the file. Defined cases: null or empty text has no tokens and decodes to the empty text; rows that repeat
are encoded each; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import runtime
from .text_arrays import distinct, pieces, utf8

#: The most pieces that a worker keeps encoded; beyond it the cache starts anew.
CACHE = 200_000
#: The most entries of the pair-compatibility table that a worker keeps.
PAIRS = 200_000
#: Bytes of text that are encoded at once: what is held beside a batch is a multiple of that, and not of the batch.
PIECE = 512 << 10
#: Kinds of code points in the split pattern.
OTHER, LETTER, NUMBER, WHITE = range(4)
#: Code points that Unicode 17 made letters or numbers; the tokenizer, of an earlier version, has them as other.
NEWER = (
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F), (0x209D, 0x209F), (0xA7CE, 0xA7CF),
    (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4), (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D), (0x107BB, 0x107BF),
    (0x10940, 0x10959), (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A), (0x11DB0, 0x11DDB), (0x11DE0, 0x11DE9),
    (0x11DF1, 0x11DF1), (0x1246F, 0x1246F), (0x12475, 0x1247F), (0x12550, 0x12686), (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3),
    (0x16FF2, 0x16FF6), (0x187F8, 0x187FF), (0x18CD6, 0x18CDA), (0x18D09, 0x18D20), (0x18D80, 0x18DF2), (0x18E00, 0x19191),
    (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168), (0x1D6A6, 0x1D6A6), (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81),
    (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2), (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED),
    (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD), (0x323B0, 0x33479),
    (0x3D000, 0x3FC3F),
)


@lru_cache(maxsize=1)
def kinds() -> np.ndarray:
    table = np.zeros(0x110000, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (WHITE, r"\s+")):
        for m in regex.finditer(pattern, every):
            a, b = ord(every[m.start()]), ord(every[m.end() - 1])
            table[a : b + 1] = kind
    table[0xD800:0xE000] = OTHER
    for a, b in NEWER:
        table[a : b + 1] = OTHER
    return table


def pieces_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each piece in the joined texts, and its text: the split pattern of the vocabulary, for whole
    arrays. A piece is a run of letters, numbers or other signs with at most one space before it; white space else; an
    apostrophe on its own takes the English endings s, t, m, d, re, ve and ll."""
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    n = len(points)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none
    begins = np.cumsum([0, *map(len, texts)])[:-1]
    kind = kinds()[points]
    first = np.zeros(n + 1, bool)
    first[begins] = True
    first[n] = True
    edge = np.ones(n + 1, bool)
    edge[1:n] = (kind[1:] != kind[:-1]) | first[1:n]
    start = np.flatnonzero(edge[:n])
    end = np.flatnonzero(edge[1:]) + 1
    white = kind[start] == WHITE
    # a run of white space before something else gives up its last character, and a space joins what follows
    gives = white & ~first[end]
    last = end[gives] - 1
    edge[last] = True
    joins = last[points[last] == 32]
    edge[joins + 1] = False
    # apostrophes that are a piece of their own
    sign = start[(end - start == 1) & ~white]
    sign = sign[(points[sign] == 39) & edge[sign]]
    sign = sign[~first[sign + 1]]
    one, two = points[sign + 1], np.where(first[np.minimum(sign + 2, n)], 0, points[np.minimum(sign + 2, n - 1)])
    ends = np.where(np.isin(one, [115, 116, 109, 100]), 1, np.where((one == 114) & (two == 101) | (one == 118) & (two == 101) | (one == 108) & (two == 108), 2, 0))
    sign, ends = sign[ends > 0], ends[ends > 0]
    edge[sign + 1] = False
    edge[sign + 1 + ends] = True
    start = np.flatnonzero(edge[:n])
    return start, np.r_[start[1:], n], np.searchsorted(begins, start, "right") - 1


def byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies write for each byte."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


class Codec:
    """Encoder and decoder of one vocabulary: (file content of a byte-level BPE in JSON)."""

    def __init__(self, content: str):
        model = json.loads(content)
        byte_of = {c: b for b, c in enumerate(byte_letters())}
        vocab = {bytes(byte_of[c] for c in k): v for k, v in model["model"]["vocab"].items()}
        self.added = {a["content"]: a["id"] for a in model["added_tokens"]}
        size = max([*vocab.values(), *self.added.values()]) + 1
        self.bytes = [b""] * size
        for k, v in vocab.items():
            self.bytes[v] = k
        merges = [m if isinstance(m, list) else m.split(" ", 1) for m in model["model"]["merges"]]
        of = lambda s: vocab[bytes(byte_of[c] for c in s)]
        #: (left, right) -> (rank, merged)
        self.merge = {(of(a), of(b)): (rank, of(a + b)) for rank, (a, b) in enumerate(merges)}
        self.parts = {}
        for (a, b), (rank, merged) in self.merge.items():
            self.parts.setdefault(merged, (a, b, rank))
        self.single = [vocab[bytes([b])] for b in range(256)]
        automaton = ahocorasick.Automaton()
        for k, v in vocab.items():
            if len(k) == 1 or v in self.parts:
                automaton.add_word(k.decode("latin-1"), v)
        automaton.make_automaton()
        self.automaton = automaton
        #: token -> the longest token that is a proper prefix of it, or -1
        self.shorter = {}
        usable = {k: v for k, v in vocab.items() if len(k) == 1 or v in self.parts}
        for k, v in usable.items():
            self.shorter[v] = next((usable[k[:i]] for i in range(len(k) - 1, 0, -1) if k[:i] in usable), -1)
        for text, token in self.added.items():
            self.bytes[token] = text.encode()
        self.offsets = np.cumsum([0, *map(len, self.bytes)])
        self.flat = np.frombuffer(b"".join(self.bytes), np.uint8)
        self.specials = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.sizes = list(map(len, self.bytes))
        self.known: dict[tuple[int, int], bool] = {}
        self.cache: dict[str, str] = {}

    def compatible(self, left: int, right: int) -> bool:
        """Whether the merges leave these two tokens apart; entered into the table."""
        if len(self.known) >= PAIRS:
            self.known.clear()
        self.known[left, right] = apart = self._apart(left, right)
        return apart

    def _apart(self, left: int, right: int) -> bool:
        """No merge across the border of these two comes before the merges that made them."""
        limit = 1 << 60
        while True:
            joined = self.merge.get((left, right))
            if joined and joined[0] < limit:
                return False
            a, b = self.parts.get(left), self.parts.get(right)
            # undo the later of the two last merges; the border pair before it must not have merged earlier than it
            if a is None and b is None:
                return True
            if b is None or a is not None and a[2] > b[2]:
                limit, left = a[2], a[1]
            else:
                limit, right = b[2] + 1, b[0]

    def encode_bytes(self, word: bytes) -> list[int]:
        n, letters, longest, sizes = len(word), word.decode("latin-1"), self.automaton.iter_long, self.sizes
        known, shorter = self.known, self.shorter
        out: list[int] = []
        at, last = 0, -1
        token = next(longest(letters))[1] if n else -1
        dead: set[int] = set()
        while at < n:
            while token >= 0:
                end = at + sizes[token]
                if end not in dead:
                    if last < 0:
                        break
                    fits = known.get((last, token))
                    if self.compatible(last, token) if fits is None else fits:
                        break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at, last = end, token
                if at < n:
                    token = next(longest(letters, at))[1]
            else:  # nothing fits here: step back
                dead.add(at)
                last = out.pop()
                at -= sizes[last]
                token, last = shorter[last], out[-1] if out else -1
        return out

    def piece(self, text: str) -> str:
        if len(self.cache) >= CACHE:
            self.cache.clear()
        self.cache[text] = got = ",".join(map(str, self.encode_bytes(text.encode())))
        return got

    def encode(self, texts: list[str]) -> list[str]:
        """Decimal ids of each text, joined by commas. Equal pieces of the texts are looked up once."""
        cut = [self._cut(t) for t in texts]
        runs = [r for c in cut for r in c if not isinstance(r, int)]
        start, end, run = pieces_of(runs)
        whole = "".join(runs)
        points = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), "<u4")
        first, inverse = distinct(points, start, end)
        get, piece = self.cache.get, self.piece
        words = [whole[a:b] for a, b in zip(start[first].tolist(), end[first].tolist(), strict=True)]
        written = np.array([get(w) or piece(w) for w in words], object)[inverse] if len(words) else np.zeros(0, object)
        bounds = np.searchsorted(run, np.arange(len(runs) + 1)).tolist()
        done = iter([",".join(written[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)])
        return [",".join(str(r) if isinstance(r, int) else next(done) for r in c) for c in cut]

    def _cut(self, text: str) -> list[str | int]:
        """The non-empty runs of ordinary text and the ids of added tokens, in order."""
        if not any(a in text for a in self.added):
            return [text] if text else []
        out: list[str | int] = []
        at = 0
        for m in self.specials.finditer(text):
            out += [text[at : m.start()]] * (m.start() > at) + [self.added[m[0]]]
            at = m.end()
        return out + [text[at:]] * (at < len(text))

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of these ids, gathered through the offset table."""
        start = self.offsets[ids]
        length = self.offsets[ids + 1] - start
        ends = np.cumsum(length)
        if not len(ends):
            return b""
        return self.flat[np.arange(ends[-1]) + np.repeat(start - (ends - length), length)].tobytes()


_LOADED: dict[str, Codec] = {}


def codec(content: str) -> Codec:
    """One codec per worker and vocabulary."""
    key = hashlib.sha256(content.encode()).hexdigest()
    if key not in _LOADED:
        _LOADED[key] = Codec(content)
    return _LOADED[key]


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of the batches, in runs of about ``PIECE`` bytes of text; a longer text is a run of its own."""
    for batch in batches:
        for a, b in pieces(utf8(batch["_text"])[1], PIECE):
            yield batch.slice(a, b - a)


SCHEMA = "n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def encode(df: DataFrame, vocabulary: str, id_column: str = "doc_id", text_column: str = "text", keep_ids: bool = False) -> DataFrame:
    """One row per input row: its id, the token count and digests of the ids and of the decoded text; with
    ``keep_ids`` also the ids. ``vocabulary`` is the path of the vocabulary file on the driver."""
    content = df.sparkSession.sparkContext.broadcast(Path(vocabulary).read_text(encoding="utf-8"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(content.value)
        for part in slices(batches):
            counts, digests, decoded, kept = [], [], [], []
            for written in own.encode([t or "" for t in part["_text"].to_pylist()]):
                ids = np.fromstring(written, np.int64, sep=",") if written else np.zeros(0, np.int64)
                counts.append(len(ids))
                digests.append(hashlib.sha256(written.encode()).hexdigest())
                decoded.append(hashlib.sha256(own.decode(ids).decode("utf-8", "replace").encode()).hexdigest())
                if keep_ids:
                    kept.append(ids.astype(np.int32))
            arrays = [part["_id"], pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())]
            names = ["_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                arrays, names = [*arrays, pa.array(kept, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(arrays, names)

    kind = df.schema[id_column].dataType.simpleString()
    frame = df.select(F.col(id_column).alias("_id"), F.col(text_column).alias("_text"))
    return frame.mapInArrow(run, f"_id {kind}, {SCHEMA}" + ", ids array<int>" * keep_ids).withColumnRenamed("_id", id_column)


def decode(df: DataFrame, vocabulary: str, ids_column: str = "ids", text_column: str = "text") -> DataFrame:
    """The rows and columns of ``df`` with the text that the ids of each row stand for, in place of a column of that
    name; null for null."""
    content = df.sparkSession.sparkContext.broadcast(Path(vocabulary).read_text(encoding="utf-8"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(content.value)
        for batch in batches:
            rows = batch["_ids"].to_pylist()
            text = [None if r is None else own.decode(np.array(r, np.int64)).decode("utf-8", "replace") for r in rows]
            columns = [batch[i] for i in range(batch.num_columns - 1)] + [pa.array(text, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [*kept_names, text_column])

    kept = df.drop(text_column)
    kept_names = kept.columns
    shape = kept.select("*", F.lit("").alias(text_column)).schema
    return df.select(*(F.col(f"`{c}`") for c in kept_names), F.col(ids_column).alias("_ids")).mapInArrow(run, shape)


def public_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(runtime.table(spark, sf_dir, "documents"), public_vocabulary())
