"""Change capture between file snapshots, and aligned differences between document versions."""

from __future__ import annotations

import re
from itertools import takewhile
from operator import eq

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, StringType, StructType

from lodestone.functions import normalize, policy
from lodestone.operators.alignment import KINDS, unequal_blocks


def snapshot_events(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, event, before_sha256, after_sha256) of files that came, went or changed: one full outer join by path."""
    b, a = before.withColumnRenamed("sha256", "before_sha256"), after.withColumnRenamed("sha256", "after_sha256")
    event = F.when(F.col("before_sha256").isNull(), "CREATED").when(F.col("after_sha256").isNull(), "DELETED").otherwise("MODIFIED")
    joined = b.join(a, "path", "full_outer").where(~F.col("before_sha256").eqNullSafe(F.col("after_sha256")))
    return joined.select("path", event.alias("event"), "before_sha256", "after_sha256")


def scan_events(scans: DataFrame) -> DataFrame:
    """(scan, path, event, before_sha256, after_sha256) of scans (scan, path, sha256), numbered without gaps: what each found
    against the one before; the first is the baseline."""
    last = scans.agg(F.max("scan").alias("last"), F.min("scan").alias("first"))
    known = scans.join(F.broadcast(last))
    before = known.where("scan < last").select((F.col("scan") + 1).alias("scan"), "path", F.col("sha256").alias("before_sha256"))
    after = known.where("scan > first").select("scan", "path", F.col("sha256").alias("after_sha256"))
    event = F.when(F.col("before_sha256").isNull(), "CREATED").when(F.col("after_sha256").isNull(), "DELETED").otherwise("MODIFIED")
    joined = before.join(after, ["scan", "path"], "full_outer").where(~F.col("before_sha256").eqNullSafe(F.col("after_sha256")))
    return joined.select("scan", "path", event.alias("event"), "before_sha256", "after_sha256")


BLOCKS = ArrayType(StructType().add("kind", StringType()).add("before", ArrayType(StringType())).add("after", ArrayType(StringType())))
NUMBERS = ArrayType(StructType().add("before", ArrayType(StringType())).add("after", ArrayType(StringType())))
LINE_END = re.compile("\r\n|\n|\r")


def _list(values) -> list:
    return [] if values is None else list(values)


@pandas_udf(BLOCKS)
def _changed_blocks(before: pd.Series, after: pd.Series) -> pd.Series:
    return pd.Series([[dict(zip(("kind", "before", "after"), block, strict=True)) for block in unequal_blocks(_list(b), _list(a))] for b, a in zip(before, after, strict=True)])


@pandas_udf(NUMBERS)
def _changed_numbers(values: pd.Series) -> pd.Series:
    def parts(pair) -> dict:
        found = unequal_blocks(_list(pair["before"]), _list(pair["after"]))
        return {side: [v for block in found for v in block[n]] for n, side in ((1, "before"), (2, "after"))}

    return values.map(lambda pairs: None if pairs is None else [parts(p) for p in pairs])


def units(text: str) -> list[str]:
    """Normalized non-empty lines of a text."""
    return [line for line in (" ".join(part.split()) for part in LINE_END.split(normalize.shown_text(text))) if line]


def _shared(a: str, b: str, most: int) -> int:
    """The length of the common start of two texts, ``most`` at most."""
    low, high = 0, most
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a.startswith(b[low:mid], low) else (low, mid - 1)
    return low


def _shared_end(a: str, b: str, most: int) -> int:
    """The length of their common end."""
    low, high = 0, most
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a.endswith(b[len(b) - mid : len(b) - low], 0, len(a) - low) else (low, mid - 1)
    return low


def edited(before: str, after: str) -> list[tuple[str, list, list]] | None:
    """``unequal_blocks`` of the units of two texts by the lines between their common start and end alone, or None where
    these don't tell.

    They do where the common start is a longest common block, as no longer one fits in: what follows it is nothing on one
    side, or a single unit on each. They do as well where nothing stands before the common end but a single unit on one
    side: the other side as a whole is a longest common block, and if it fits in earlier too, all units are that one.
    """
    head = before.rfind("\n", 0, _shared(before, after, min(len(before), len(after)))) + 1
    tail = _shared_end(before, after, min(len(before), len(after)) - head)
    starts = lambda text: (at := len(text) - tail) == head or text[at - 1] == "\n"
    if tail and not (starts(before) and starts(after)):
        at = after.find("\n", len(after) - tail)
        tail = len(after) - at - 1 if at >= 0 else 0
    b, a = units(before[head : len(before) - tail]), units(after[head : len(after) - tail])
    if b == a:
        return []
    if not after[len(after) - tail :].strip(" \t\r\n"):
        same = sum(1 for _ in takewhile(bool, map(eq, b, a)))
        x, y = b[same:], a[same:]
        if not x or not y or len(x) == len(y) == 1:
            return [(KINDS[bool(x), bool(y)], x, y)]
    if not after[:head].strip(" \t\r\n"):
        same = sum(1 for _ in takewhile(bool, map(eq, reversed(b), reversed(a))))
        x, y = b[: len(b) - same], a[: len(a) - same]
        if len(x) + len(y) == 1:
            return [(KINDS[bool(x), bool(y)], x, y)]
    return None


@pandas_udf(BLOCKS)
def _changed_units(before: pd.Series, after: pd.Series) -> pd.Series:
    def blocks(b: str | None, a: str | None) -> list[dict]:
        b, a = b or "", a or ""
        found = edited(b, a) if b != a else []
        return [dict(zip(("kind", "before", "after"), block, strict=True)) for block in (unequal_blocks(units(b), units(a)) if found is None else found)]

    return pd.Series([blocks(b, a) for b, a in zip(before, after, strict=True)])


# the optimizer may copy an expression into a filter that it infers, as from a generator; these are to run once a row
changed_blocks, changed_numbers, changed_units = _changed_blocks.asNondeterministic(), _changed_numbers.asNondeterministic(), _changed_units.asNondeterministic()


def _as_changes(blocks: Column) -> Column:
    """Blocks of units as numbered changes of texts; a side without units is null."""
    text = lambda units: F.when(F.size(units) > 0, F.array_join(units, " "))
    return F.transform(blocks, lambda c, i: F.struct(i.alias("change_index"), c["kind"].alias("kind"), text(c["before"]).alias("before"), text(c["after"]).alias("after")))


def with_numbers(changes: Column) -> Column:
    """Each change with the number lexemes that only one side has at their place, as numbers(before, after)."""
    of = lambda c: policy.numeric_values(F.coalesce(c, F.lit("")))
    sides = F.transform(changes, lambda c: F.struct(of(c["before"]).alias("before"), of(c["after"]).alias("after")))
    none = F.transform(changes, lambda c: F.struct(F.array().cast("array<string>").alias("before"), F.array().cast("array<string>").alias("after")))
    return F.zip_with(changes, F.coalesce(changed_numbers(F.when(F.exists(sides, lambda s: s["before"] != s["after"]), sides)), none), lambda c, n: c.withField("numbers", n))


def change_arrays(pairs: DataFrame, *kept: str | Column) -> DataFrame:
    """(doc_id, changes, controls) and the further columns: each pair's changes with their changed numbers as one array,
    empty where the normalized units are equal, and the suspicious controls of the candidate; equal texts never reach
    Python."""
    base, cand = F.col("base_text"), F.col("cand_text")
    differ = ~base.eqNullSafe(cand)
    aligned = pairs.select("doc_id", changed_units(F.when(differ, base), F.when(differ, cand)).alias("blocks"), policy.control_points(cand).alias("controls"), *kept)
    rest = [c for c in aligned.columns if c not in ("doc_id", "blocks")]
    return aligned.select("doc_id", _as_changes(F.col("blocks")).alias("changes"), *rest).select("doc_id", with_numbers(F.col("changes")).alias("changes"), *rest)


def changes(pairs: DataFrame) -> DataFrame:
    """(doc_id, change_index, kind, before, after, numbers)."""
    return change_arrays(pairs).select("doc_id", F.inline("changes"))


def numeric_changes(changed: DataFrame) -> DataFrame:
    """(doc_id, change_index, before, after): the number lexemes of each change that only one side has at their place."""
    rows = changed.where((F.size("numbers.before") > 0) | (F.size("numbers.after") > 0))
    return rows.select("doc_id", "change_index", F.array_join("numbers.before", " | ").alias("before"), F.array_join("numbers.after", " | ").alias("after"))
