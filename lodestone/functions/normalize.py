"""Text normal forms. Unicode composition and the names of controls have no built-in function, so they run as an Arrow batch
over rows that aren't plain ASCII; the rest is built-in."""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from lodestone.functions import policy

#: Zero-width code points and bidirectional classes that are shown as visible tokens.
ZERO_WIDTH = (0x034F, 0x180E, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF)
BIDI_CLASSES = ("BN", "FSI", "LRE", "LRI", "LRO", "PDF", "PDI", "RLE", "RLI", "RLO")
#: Texts that composition and tokens leave as they are.
PLAIN = r"^[\x20-\x7E\t\n\r]*$"


@cache
def _plain() -> re.Pattern:
    return re.compile(PLAIN)


@cache
def control_tokens() -> dict[int, str]:
    """For ``str.translate``: what stands for each invisible control that isn't white space."""
    names = str.maketrans("- ", "__")
    points = {p for p in range(sys.maxunicode + 1) if unicodedata.category(chr(p)) in ("Cc", "Cf") or unicodedata.bidirectional(chr(p)) in BIDI_CLASSES}
    return {p: f" ⟦U+{p:04X}:{unicodedata.name(chr(p), 'UNNAMED_CONTROL').translate(names)}⟧ " for p in sorted({*points, *ZERO_WIDTH}) if not chr(p).isspace()}


@pandas_udf(StringType())
def _nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: t if t is None else unicodedata.normalize("NFC", t))


def shown_text(text: str) -> str:
    """``shown`` of one text, for use in batches."""
    return text if _plain().match(text) else unicodedata.normalize("NFC", text).translate(control_tokens())


@pandas_udf(StringType())
def _shown(text: pd.Series) -> pd.Series:
    return text.map(lambda t: t if t is None else shown_text(t))


def _where_needed(change, text: Column) -> Column:
    """Plain texts stay in the JVM: Python gets a null in their place."""
    return F.coalesce(change(F.when(~text.rlike(PLAIN), text)), text)


def nfc(text: Column) -> Column:
    """Composed form."""
    return _where_needed(_nfc, text)


def shown(text: Column) -> Column:
    """Composed, with invisible controls as tokens that name them; white space as it was."""
    return _where_needed(_shown, text)


def normalized(text: Column) -> Column:
    """Composed, invisible controls as tokens, white space as single spaces, trimmed."""
    return policy.collapse(shown(text))


def body(text: Column) -> Column:
    """Line ends as \\n, composed, lines trimmed, blank lines dropped."""
    lines = F.split(F.regexp_replace(nfc(text), "\r\n|\r", "\n"), "\n")
    stripped = F.transform(lines, lambda x: F.regexp_replace(x, r"^[\s\x1C-\x1F\u0085 　]+|[\s\x1C-\x1F\u0085 　]+$", ""))
    return F.array_join(F.filter(stripped, lambda x: x != ""), "\n")
