"""Fixed vocabularies of the risk rules and the predicates over them, as built-in column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns, terms, types and code points that results must agree on.
PROMPT_PATTERNS = (
    r"ignore\s+(all\s+|any\s+)?previous\s+instructions?",
    r"ignore\s+(the\s+)?system\s+prompt",
    r"reveal\s+(the\s+)?system\s+prompt",
    r"you\s+are\s+now\s+",
    r"developer\s+message",
    r"system\s+message",
    r"이전\s*(지시|명령|프롬프트).{0,20}무시",
    r"(지시|명령|프롬프트).{0,20}무시하고",
    r"시스템\s*프롬프트.{0,20}(공개|출력|노출)",
    r"새로운\s*(지시|명령).{0,20}(따라|수행)",
)
POLICY_TERMS = (
    "승인", "한도", "금지", "필수", "예외", "권한", "보안", "개인정보", "외부 전송", "보존 기간",
    "approval", "limit", "prohibited", "required", "exception", "permission", "security", "personal data",
)
HARD_BLOCK_TYPES = (
    "ACTIVE_CONTENT", "ARCHIVE_LIMIT_EXCEEDED", "ENCRYPTED", "ENCRYPTED_DOCUMENT", "FORMAT_MISMATCH", "MACRO", "MALFORMED_ARCHIVE",
    "MALFORMED_DOCUMENT", "OLE", "PATH_TRAVERSAL", "SCRIPT", "SCRIPT_PAYLOAD", "UNSAFE_ARCHIVE", "UNSCANNABLE_ACTIVE_CONTENT",
    "UNSCANNABLE_CONTENT", "VBA", "ZIP_BOMB",
)
CONTROL_POINTS = (
    0x061C, 0x200B, 0x200C, 0x200D, 0x200E, 0x200F, 0x202A, 0x202B, 0x202C, 0x202D, 0x202E, 0x2060, 0x2066, 0x2067, 0x2068, 0x2069, 0xFEFF,
)
DATE_PATTERN = r"(?:\b\d{4}[-./]\d{1,2}[-./]\d{1,2}\b|\b\d{4}년\s*\d{1,2}월\s*\d{1,2}일\b)"
NUMERIC_UNIT = r"(?:bps?|[%％]|퍼센트|[십백천만억조경]+\s*원|[십백천만억조경]+|원|달러|유로|엔|USD|KRW|EUR|JPY|년|개월|월|주|일|시간|분|초|명|개|건|회|배|곳|차|단계|등급|점|세|호|층|페이지|TB|GB|MB|KB|KiB|MiB|GiB)"
CONTROL_TOKEN = r"⟦U\+[0-9A-F]{4,6}:[A-Z0-9_]+⟧"
#: The sign class is a range of code points from + to −, as results must have it; ``STRICT_SIGN`` is what it seems to mean.
WIDE_SIGN, STRICT_SIGN = "[+-−]", "[-+−]"


def numeric_pattern(sign: str = WIDE_SIGN) -> str:
    """A date or a grouped decimal, with currency and unit; the lexeme is not preceded by a word character."""
    number = rf"(?:\d{{4}}[-/.]\d{{1,2}}[-/.]\d{{1,2}}|{sign}?(?:\d{{1,3}}(?:[,_]\d{{3}})+|\d+)(?:\.\d+)?)"
    return rf"((?:[₩$€¥]\s*)?{number}(?:\s*{NUMERIC_UNIT})?)"


def casefold(text: Column) -> Column:
    """Full case folding: lower case of upper case expands and joins what folds alike; a final sigma folds to the plain
    one, and the dotless i, which has no other case here, stays."""
    upper = F.replace(F.upper(F.replace(text, F.lit("ı"), F.lit("\ue000"))), F.lit("\ue000"), F.lit("ı"))
    return F.replace(F.lower(upper), F.lit("ς"), F.lit("σ"))


def has_prompt_injection(text: Column) -> Column:
    return F.coalesce(text.rlike("(?iu)" + "|".join(f"(?:{p})" for p in PROMPT_PATTERNS)), F.lit(False))


def has_policy_term(text: Column) -> Column:
    def found(low: Column) -> Column:
        return reduce(lambda out, term: out | low.contains(term), POLICY_TERMS, F.lit(False))

    # folded once for all terms
    return F.coalesce(F.transform(F.array(casefold(text)), found)[0], F.lit(False))


def _ranges(points: tuple[int, ...]) -> str:
    """Ascending code points as ranges of a character class, of which a pattern tests few."""
    firsts = [p for p in points if p - 1 not in points]
    lasts = [p for p in points if p + 1 not in points]
    return "".join(chr(a) if a == b else f"{chr(a)}-{chr(b)}" for a, b in zip(firsts, lasts, strict=True))


def control_points(text: Column) -> Column:
    """Sorted distinct U+XXXX of suspicious control characters. A text of lower code points alone isn't searched."""
    found = F.regexp_extract_all(text, F.lit(f"([{_ranges(CONTROL_POINTS)}])"), F.lit(1))
    names = F.array_sort(F.array_distinct(F.transform(found, lambda c: F.concat(F.lit("U+"), F.hex(F.encode(c, "UTF-16BE"))))))
    return F.when(text.isNull() | text.rlike(f"[{chr(CONTROL_POINTS[0])}-{chr(CONTROL_POINTS[-1])}]"), names).otherwise(F.array().cast("array<string>"))


def collapse(text: Column) -> Column:
    """White space to single spaces, trimmed."""
    return F.trim(F.regexp_replace(text, r"[\s\u0085   -     　\x1C-\x1F]+", " "))


def without_control_tokens(text: Column) -> Column:
    """Tokens that stand for controls hold hexadecimal digits, which are no numbers of the text."""
    return F.regexp_replace(text, CONTROL_TOKEN, " ")


def numeric_values(text: Column, sign: str = WIDE_SIGN) -> Column:
    """Ordered numeric, date and amount lexemes of a normalized text."""
    found = F.regexp_extract_all(without_control_tokens(text), F.lit(rf"(?iuU)(?<![\p{{L}}\p{{N}}_]){numeric_pattern(sign)}"), F.lit(1))
    return F.transform(found, lambda x: F.trim(x))


def date_set(text: Column) -> Column:
    """Sorted distinct dates of a text."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?U)({DATE_PATTERN})"), F.lit(1))))


def normalized_type(kind: Column) -> Column:
    """Upper case, with runs of - and _ as one _ and none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.upper(F.trim(kind)), "[-_]+", "_"), "^_|_$", "")


def is_hard_block(kind: Column, hard_block: Column, empty: Column, size: Column) -> Column:
    exempt = F.coalesce(empty, F.lit(False)) | F.coalesce(size == 0, F.lit(False))
    return F.coalesce(hard_block, F.lit(False)) | (normalized_type(kind).isin(*HARD_BLOCK_TYPES) & ~exempt)


def is_near_white(color: Column, least: int = 242) -> Column:
    """All channels of #RRGGBB (the last six digits of longer ones) are ``least`` or more."""
    digits = F.upper(F.regexp_replace(color, "^#", ""))
    digits = F.when(F.length(digits) == 8, F.substring(digits, 3, 6)).otherwise(digits)
    channels = [F.conv(F.substring(digits, i, 2), 16, 10).cast("int") >= least for i in (1, 3, 5)]
    return F.coalesce(digits.rlike("^[0-9A-F]{6}$") & channels[0] & channels[1] & channels[2], F.lit(False))


def occurrences(text: Column, part: Column) -> Column:
    """How often ``part`` stands in ``text``, without overlaps."""
    return F.when(F.length(part) > 0, ((F.length(text) - F.length(F.replace(text, part, F.lit("")))) / F.length(part)).cast("bigint")).otherwise(0)
