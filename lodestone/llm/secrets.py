"""Secret scans: assignment-aware lexing of whole texts.

Three base patterns are always reported. Beyond them, a lexer walks the assignment operators of a text and parses each
into a name-literal pair (quoted strings with escapes, ``+`` concatenations, bare words, nested keys). Names that are
assigned a literal become constants; a later pair whose value is such a name (or a sum of names and literals) takes
the constant's value, so that a secret is found where the literal stands. A literal is scored by how sensitive its
target names are and how much it looks like a credential; those of ``THRESHOLD`` or more are reported.

A map without a shuffle: each text is scanned inside its task, in time and memory linear in its length: values keep spans
and, of what they add up to, a summary of fixed size, never text. Defined cases: null or
empty text has no spans; rows that repeat are scanned each; extra columns are ignored; an empty table gives an empty
result. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import math
import re
from array import array
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import runtime

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
#: In the order in which spans of one start are listed; lexed spans come last.
KINDS = ("assign", "access", "hex", "lexed")

#: An assignment operator, and what may follow it: a quoted literal or a bare word.
OPERATOR = re.compile(r"""(?<![=!<>:])(?::=|=>|=|:)(?![=/])""")
VALUE = re.compile(r"""\s*(?:[rbuf]{0,2}("(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|`[^`\n]*`)|([A-Za-z0-9_$][A-Za-z0-9_$+/.=-]*))""")
#: What joins values, over line ends too; after a bare word only on its line, as a list may follow.
PLUS = re.compile(r"\s*(?:\+|\.\.)\s*(?=[\"'`A-Za-z_])")
PLUS_HERE = re.compile(r"[ \t]*(?:\+|\.\.)\s*(?=[\"'`A-Za-z_])")
#: Backwards from an operator: blanks, closing quotes or brackets, and the name, which begins with a letter, _ or $.
NAME_BACK = re.compile(r"""[ \t]*["'\]`]{0,2}([\w$.-]*[A-Za-z_$])""", re.ASCII)
IDENTIFIER = re.compile(r"[A-Za-z_$][\w$.]*\Z", re.ASCII)
PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")

#: Weights of the parts of a target name.
SENSITIVE = {
    "password": 3.0, "passwd": 3.0, "pwd": 2.5, "passphrase": 3.0, "secret": 3.0, "secrets": 3.0, "token": 2.5, "apikey": 3.0,
    "credential": 2.5, "credentials": 2.5, "auth": 1.5, "bearer": 2.0, "private": 1.5, "access": 1.0, "api": 1.0, "key": 1.0,
    "signing": 1.0, "encryption": 1.0, "client": 0.3, "webhook": 0.5, "session": 0.5, "salt": 1.0, "pass": 1.5,
}
#: Parts that make a name harmless.
HARMLESS = {"count": -2.0, "counts": -2.0, "length": -2.0, "limit": -2.0, "name": -1.0, "field": -1.5, "path": -1.5, "file": -1.5, "url": -1.0, "type": -1.5, "max": -1.5, "min": -1.5}
#: Values that stand for a secret without being one.
PLACEHOLDER = re.compile(
    r"(?i)(?:(?:your|my|the|some|example|sample|dummy|test|change|replace)(?:pass(?:word|wd)?|secret|token|api_?key|key|value|me|it|this)?(?![A-Za-z0-9])"
    r"|(?:placeholder|todo|none|null|true|false|undefined)(?![A-Za-z0-9])|xxx+|\*+|\.\.+|<|\$\{|\{\{|%\()"
)
#: So many first characters tell a placeholder.
HEAD = 32
THRESHOLD = 4.0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the three base patterns, leftmost and non-overlapping within a kind."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def name_weight(name: str) -> float:
    parts = [p.lower() for p in PARTS.findall(name)]
    joined = {"api" + "key"} if "api" in parts and "key" in parts else set()
    return max((SENSITIVE.get(p, 0.0) for p in [*parts, *joined]), default=0.0) + sum(HARMLESS.get(p, 0.0) for p in parts) + 0.25 * (sum(p in SENSITIVE for p in parts) > 1)


#: Lengths and numbers of words from here on weigh the same.
FULL = 1 << 10
KINDS_OF = (str.islower, str.isupper, str.isdigit, lambda c: not c.isalnum())


class Summary:
    """What is weighed of a value: its length, first characters, words and whether it begins and ends with a blank, the kinds
    and the set of its characters (ASCII as they are, others by their last five bits), and its variety in bits. Summaries
    of parts add up to that of their concatenation; the variety of a literal is its entropy, that of a sum the
    logarithm of how many characters its parts have."""

    __slots__ = ("chars", "edges", "head", "kinds", "length", "variety", "words")

    def __init__(self, length: int, head: str, words: int, edges: tuple[bool, bool], kinds: int, chars: int, variety: float):
        self.length, self.head, self.words, self.edges, self.kinds, self.chars, self.variety = length, head, words, edges, kinds, chars, variety

    @classmethod
    def of(cls, value: str) -> Summary:
        n, count = len(value), Counter(value)
        kinds = sum(any(map(f, count)) << i for i, f in enumerate(KINDS_OF))
        chars = 0
        for o in map(ord, count):
            chars |= 1 << (o if o < 128 else 128 + o % 32)
        variety = -sum(c / n * math.log2(c / n) for c in count.values()) if n else 0.0
        return cls(min(n, FULL), value[:HEAD], min(len(value.split()), FULL), (value[:1].isspace(), value[-1:].isspace()), kinds, chars, variety)

    def __add__(self, other: Summary) -> Summary:
        if not self.length or not other.length:
            return self if self.length else other
        joined = self.words > 0 and other.words > 0 and not self.edges[1] and not other.edges[0]
        words, chars = min(self.words + other.words - joined, FULL), self.chars | other.chars
        head = self.head if len(self.head) >= HEAD else (self.head + other.head)[:HEAD]
        return Summary(min(self.length + other.length, FULL), head, words, (self.edges[0], other.edges[1]), self.kinds | other.kinds, chars, math.log2(chars.bit_count()))

    @property
    def weight(self) -> float:
        """By length, variety and mixture of characters; placeholders and prose count against."""
        if self.length < 6 or PLACEHOLDER.match(self.head) or self.chars >> 32 & 1 and self.words > 3:
            return -4.0
        return 0.5 * (self.length >= 8) + 0.5 * (self.length >= 16) + 0.6 * max(0.0, self.variety - 2.0) + 0.5 * (self.kinds.bit_count() - 1)


def lexed_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, 3, end) of literals that reach a sensitive name, directly or through constants."""
    #: By name: the number of its value, and its summary, or the span of the literal that it is.
    constants: dict[str, tuple[int, Summary | tuple[int, int]]] = {}
    #: Parts of values one after the other: a span, or the number of another value and -1; and where each value's begin.
    first, second, begins = array("q"), array("q"), array("q", [0])
    sensitive = bytearray()
    backwards = text[::-1]

    def summary(x: Summary | tuple[int, int]) -> Summary:
        return x if isinstance(x, Summary) else Summary.of(text[x[0] : x[1]])

    for op in OPERATOR.finditer(text):
        name = NAME_BACK.match(backwards, len(text) - op.start())
        value = VALUE.match(text, op.end()) if name else None
        if not value:
            continue
        whole: Summary | tuple[int, int] | None = None
        while value:
            plus = PLUS
            if value[1] is not None:
                part, own = (value.start(1) + 1, value.end(1) - 1), None
            else:
                own = constants.get(value[2]) if IDENTIFIER.match(value[2]) else None
                part = (value.start(2), value.end(2))
                if own is None:
                    plus = PLUS_HERE
            first.append(own[0] if own else part[0])
            second.append(-1 if own else part[1])
            part = own[1] if own else part
            whole = part if whole is None else summary(whole) + summary(part)
            more = plus.match(text, value.end())
            value = VALUE.match(text, more.end()) if more else None
        key, number = name[1][::-1], len(sensitive)
        begins.append(len(first))
        weight = name_weight(key)
        if weight > 0:
            whole = summary(whole)
        sensitive.append(weight > 0 and weight + whole.weight >= THRESHOLD)
        constants[key] = constants[key.rpartition(".")[2]] = number, whole
    found: dict[tuple[int, int], None] = {}
    for number in range(len(sensitive) - 1, -1, -1):  # parts are numbered before what they are part of
        if sensitive[number]:
            for i in range(begins[number], begins[number + 1]):
                if second[i] < 0:
                    sensitive[first[i]] = True
                else:
                    found[first[i], second[i]] = None
    return [(start, 3, end) for start, end in found]


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


SCHEMA = "n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_lexed bigint"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text in batch["_text"].to_pylist():
            base = base_spans(text) if text else []
            lexed = lexed_spans(text) if text else []
            counts = Counter(k for _, k, _ in base)
            rows.append((counts[0], counts[1], counts[2], hashlib.sha256(written(base).encode()).hexdigest(), written(base + lexed), len(lexed)))
        columns = list(zip(*rows, strict=True)) or [[]] * 6
        types = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        yield pa.RecordBatch.from_arrays([batch["_id"], *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], ["_id", *names])


def scan(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per input row: its id, counts per base kind, the digest of the base spans, and all spans."""
    kind = df.schema[id_column].dataType.simpleString()
    out = df.select(F.col(id_column).alias("_id"), F.col(text_column).alias("_text")).mapInArrow(_scan, f"_id {kind}, {SCHEMA}")
    return out.withColumnRenamed("_id", id_column)


def redact(df: DataFrame, text_column: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """The same rows and columns, with each merged span of the text replaced by ``mark``; null stays null."""

    def clean(text: str | None) -> str | None:
        if not text:
            return text
        out, at = [], 0
        for start, _, end in sorted(base_spans(text) + lexed_spans(text)):
            if end <= at:
                continue
            if start >= at:
                out += [text[at:start], mark]
            at = end
        return "".join([*out, text[at:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text_column)
            yield batch.set_column(at, text_column, pa.array([clean(t) for t in batch[text_column].to_pylist()], pa.string()))

    return df.mapInArrow(run, df.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(runtime.table(spark, sf_dir, "documents"))
