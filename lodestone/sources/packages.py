"""Documents out of stored files: Markdown, DOCX and HWPX as rows of text units, artifacts and errors.

``read_files`` lists a folder with Spark's binary reader; ``parsed`` turns each file into rows
(path, sha256, row_kind, ord, text, hidden, scope, type, reason). A file that can't be trusted becomes an ERROR row, never a
failed job; its verdict is a block. Packages are read in memory, member by member, under ``LIMITS``.
"""

from __future__ import annotations

import io
import posixpath
import re
import stat
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import policy

#: Ceilings of what is parsed.
LIMITS = {"upload": 20 << 20, "entries": 1000, "expanded": 100 << 20, "xml": 10 << 20, "ratio": 100.0, "nodes": 200_000, "characters": 2_000_000, "units": 100_000, "artifacts": 1000}
SUFFIXES = {".md": "MARKDOWN", ".markdown": "MARKDOWN", ".docx": "DOCX", ".hwpx": "HWPX"}
HWPX_TYPE = b"application/hwp+zip"
IMAGES = (".png", ".jpg", ".jpeg", ".gif", ".bmp", ".webp", ".tif", ".tiff")
SCHEMA = "path string, sha256 string, row_kind string, ord int, text string, hidden boolean, scope string, type string, reason string"


class Refused(Exception):
    """Why a file isn't parsed: a type and a reason."""


@dataclass
class Rows:
    units: list[tuple[str, bool, str]] = field(default_factory=list)
    artifacts: dict[tuple[str, str], None] = field(default_factory=dict)
    characters: int = 0

    def unit(self, text: str, hidden: bool = False, scope: str = "BODY") -> None:
        if not text:
            return
        self.characters += len(text)
        if self.characters > LIMITS["characters"] or len(self.units) >= LIMITS["units"]:
            raise Refused("MALFORMED_DOCUMENT", "text exceeds the limits")
        self.units.append((text, hidden, scope))
        if hidden and text.strip():
            self.artifact("HIDDEN_TEXT", "text is in the file but isn't expected to be seen")
        if any(ord(c) in policy.CONTROL_POINTS for c in text):
            self.artifact("CONTROL_CHARACTERS", "zero-width or bidirectional control characters")

    def artifact(self, kind: str, reason: str) -> None:
        self.artifacts[kind, reason] = None
        if len(self.artifacts) > LIMITS["artifacts"]:
            raise Refused("MALFORMED_DOCUMENT", "artifacts exceed the limits")


def local(name: str) -> str:
    return name.rpartition("}")[2]


def value(node: ElementTree.Element | None, name: str) -> str | None:
    return None if node is None else next((v for k, v in node.attrib.items() if local(k) == name), None)


class Package:
    """The members of a ZIP package that passes all checks."""

    def __init__(self, content: bytes):
        if content[:4] != b"PK\x03\x04":
            raise Refused("FORMAT_MISMATCH", "no package signature")
        try:
            self.zip = zipfile.ZipFile(io.BytesIO(content))
        except (zipfile.BadZipFile, OSError, ValueError) as e:
            raise Refused("MALFORMED_ARCHIVE", "the directory can't be read") from e
        infos = self.zip.infolist()
        seen: set[str] = set()
        if not infos or len(infos) > LIMITS["entries"] or sum(i.file_size for i in infos) > LIMITS["expanded"]:
            raise Refused("ARCHIVE_LIMIT_EXCEEDED", "too many or too large members")
        for i in infos:
            name = i.filename.removesuffix("/")
            if "\\" in name or "\0" in name or name != posixpath.normpath(name) or name.startswith(("/", "..")) or ":" in name.split("/")[0]:
                raise Refused("PATH_TRAVERSAL", "a member's path isn't canonical")
            if name.casefold() in seen:
                raise Refused("UNSAFE_ARCHIVE", "two members of one name")
            seen.add(name.casefold())
            if i.flag_bits & 1:
                raise Refused("ENCRYPTED_DOCUMENT", "encrypted members")
            if stat.S_ISLNK(i.external_attr >> 16) or i.compress_type not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
                raise Refused("UNSAFE_ARCHIVE", "a link or an unknown compression")
            if i.file_size > LIMITS["ratio"] * max(1, i.compress_size):
                raise Refused("ZIP_BOMB", "a member expands too far")
        self.names = {i.filename: i.file_size for i in infos if not i.is_dir()}

    def read(self, name: str, most: int = LIMITS["expanded"]) -> bytes:
        if self.names.get(name, 0) > most:
            raise Refused("MALFORMED_DOCUMENT", f"member {name} is too large")
        try:
            with self.zip.open(name) as f:
                got = f.read(most + 1)
        except (KeyError, zipfile.BadZipFile, zlib.error, RuntimeError, NotImplementedError, OSError, EOFError) as e:
            raise Refused("MALFORMED_DOCUMENT", f"member {name} is missing or damaged") from e
        if len(got) != self.names[name]:
            raise Refused("MALFORMED_ARCHIVE", "a member isn't as long as the directory says")
        return got

    def xml(self, name: str) -> ElementTree.Element:
        raw = self.read(name, LIMITS["xml"])
        if re.search(rb"<!(?:DOCTYPE|ENTITY)", raw, re.I):
            raise Refused("MALFORMED_DOCUMENT", f"{name} declares entities")
        try:
            root = ElementTree.fromstring(raw)
        except ElementTree.ParseError as e:
            raise Refused("MALFORMED_DOCUMENT", f"{name} is no XML") from e
        if sum(1 for _ in root.iter()) > LIMITS["nodes"]:
            raise Refused("MALFORMED_DOCUMENT", f"{name} has too many nodes")
        return root


def pale(color: str | None) -> bool:
    """Near white, as ``policy.is_near_white`` has it."""
    digits = (color or "").lstrip("#")[-6:]
    return bool(re.fullmatch("[0-9A-Fa-f]{6}", digits)) and all(int(digits[i : i + 2], 16) >= 242 for i in (0, 2, 4))


def number(text: str | None, unit: float) -> float | None:
    try:
        return None if text is None else float(text) / unit
    except ValueError:
        return None


def markdown(content: bytes, rows: Rows) -> None:
    try:
        text = content.decode("utf-8-sig")
    except UnicodeDecodeError as e:
        raise Refused("MALFORMED_DOCUMENT", "no UTF-8") from e
    for line in text.splitlines():
        if line.strip():
            rows.unit(line)


def _run_style(node: ElementTree.Element | None) -> dict[str, object]:
    """What a run's or style's properties say of being seen."""
    out: dict[str, object] = {}
    for p in node if node is not None else ():
        name, v = local(p.tag), value(p, "val")
        if name in ("vanish", "webHidden"):
            out[name] = (v or "true").lower() not in ("0", "false", "off", "no")
        elif name == "color":
            out["pale"] = pale(v)
        elif name == "sz":
            out["size"] = number(v, 2)
        elif name == "highlight":
            out["lit"] = (v or "none").lower() not in ("none", "white")
        elif name == "rStyle":
            out["ref"] = v
    return out


def _hidden(style: dict[str, object]) -> bool:
    size = style.get("size")
    return bool(style.get("vanish") or style.get("webHidden") or style.get("pale") and not style.get("lit") or isinstance(size, float) and size <= 1)


def docx(content: bytes, rows: Rows) -> None:
    package = Package(content)
    relations = [r for r in package.xml("_rels/.rels").iter() if local(r.tag) == "Relationship"] if "_rels/.rels" in package.names else []
    mains = [(value(r, "Target") or "").lstrip("/") for r in relations if (value(r, "Type") or "").endswith("/officeDocument")]
    if len(mains) != 1 or mains[0] not in package.names:
        raise Refused("FORMAT_MISMATCH", "no single main part")
    styles: dict[str | None, tuple[str | None, dict]] = {}
    defaults: dict[str, object] = {}
    if "word/styles.xml" in package.names:
        root = package.xml("word/styles.xml")
        defaults = _run_style(next((n for d in root.iter() if local(d.tag) == "rPrDefault" for n in d if local(n.tag) == "rPr"), None))
        for s in (n for n in root if local(n.tag) == "style"):
            parts = {local(n.tag): n for n in s}
            styles[value(s, "styleId")] = (value(parts.get("basedOn"), "val"), _run_style(parts.get("rPr")))
            if (value(s, "default") or "").lower() in ("1", "true", "on"):
                styles[f"default {value(s, 'type')}"] = styles[value(s, "styleId")]

    @cache
    def inherited(ref: object) -> dict[str, object]:
        chain: dict[object, dict] = {}
        while ref:
            if ref in chain:
                raise Refused("MALFORMED_DOCUMENT", "styles inherit in a circle")
            based, chain[ref] = styles.get(ref, (None, {}))  # type: ignore[call-overload]
            ref = based
        return {k: v for own in reversed(chain.values()) for k, v in own.items()}

    for name in sorted(package.names, key=lambda n: (n != mains[0], n)):
        low = name.lower()
        if re.search(r"vbaproject|activex|/embeddings/", low):
            rows.artifact("ACTIVE_CONTENT", f"active part {name}")
        elif low.endswith(".rels"):
            for r in package.xml(name).iter():
                if (value(r, "TargetMode") or "").lower() == "external":
                    link = (value(r, "Type") or "").endswith("/hyperlink")
                    rows.artifact("EXTERNAL_REFERENCE" if link else "ACTIVE_CONTENT", f"external target in {name}")
        elif name == mains[0] or re.fullmatch(r"word/(header|footer|footnotes|endnotes|comments)\d*\.xml", low):
            scope = "BODY" if name == mains[0] else "AUXILIARY"
            root = package.xml(name)
            if any(local(n.tag) in ("ins", "del", "moveFrom", "moveTo", "delText", "delInstrText", "instrText") for n in root.iter()):
                rows.artifact("TRACKED_CHANGES", f"changes or instructions in {name}")
            for p in (n for n in root.iter() if local(n.tag) == "p"):
                kept = next((s for x in p if local(x.tag) == "pPr" for s in x if local(s.tag) == "pStyle"), None)
                for run in (n for n in p.iter() if local(n.tag) == "r"):
                    own = _run_style(next((n for n in run if local(n.tag) == "rPr"), None))
                    style = defaults | inherited(value(kept, "val") or "default paragraph") | inherited(own.get("ref") or "default character") | own
                    text = "".join({"t": n.text or "", "delText": n.text or "", "tab": "\t", "br": "\n"}.get(local(n.tag), "") for n in run.iter())
                    rows.unit(text, _hidden(style), scope)


def hwpx(content: bytes, rows: Rows) -> None:
    package = Package(content)
    if package.names.keys() < {"mimetype", "Contents/content.hpf", "Contents/header.xml"} or "mimetype" not in package.names or package.read("mimetype").strip() != HWPX_TYPE:
        raise Refused("FORMAT_MISMATCH", "no package of this format")
    descriptor = package.xml("Contents/content.hpf")
    parts = {}
    for item in (n for n in descriptor.iter() if local(n.tag) == "item"):
        href = value(item, "href") or ""
        target = posixpath.normpath(f"Contents/{href}")
        parts[value(item, "id")] = target if target in package.names else href
    spine = [parts.get(value(n, "idref")) for n in descriptor.iter() if local(n.tag) == "itemref"]
    if not spine or any(s not in package.names for s in spine):
        raise Refused("MALFORMED_DOCUMENT", "the spine names a part that isn't there")
    hidden = {}
    for c in (n for n in package.xml("Contents/header.xml").iter() if local(n.tag) == "charPr"):
        size = number(value(c, "height"), 100)
        flag = any((value(c, k) or "").lower() in ("1", "true", "on") for k in ("hidden", "invisible"))
        hidden[value(c, "id")] = flag or pale(value(c, "textColor")) or size is not None and size <= 1
    for name in spine:
        for run in (n for n in package.xml(name).iter() if local(n.tag) == "run"):
            text = "".join(n.text or "" for n in run.iter() if local(n.tag) == "t")
            rows.unit(text, hidden.get(value(run, "charPrIDRef"), False))
    for name in sorted({p for p in parts.values() if p in package.names and p.lower().endswith(".xml")} - {*spine, "Contents/header.xml"}):
        for part in package.xml(name).iter():
            if (part.text or "").strip():
                rows.unit(part.text.strip(), scope="AUXILIARY")
    for name, size in package.names.items():
        if name.startswith("Scripts/") and size or name.startswith("BinData/") and not name.lower().endswith(IMAGES):
            rows.artifact("ACTIVE_CONTENT", f"active part {name}")


PARSERS = {"MARKDOWN": markdown, "DOCX": docx, "HWPX": hwpx}


def parse(path: str, content: bytes) -> list[tuple]:
    """(row_kind, ord, text, hidden, scope, type, reason) of one file."""
    rows = Rows()
    try:
        kind = SUFFIXES.get(posixpath.splitext(path)[1].lower())
        if kind is None:
            raise Refused("UNSUPPORTED_FORMAT", "no parser for this suffix")
        if len(content) > LIMITS["upload"]:
            raise Refused("UPLOAD_LIMIT", "the file is too large")
        PARSERS[kind](content, rows)
    except Refused as e:
        return [("ERROR", 0, None, None, None, e.args[0], e.args[1])]
    except Exception as e:  # a parser's own failure is the file's: it fails closed, and the job goes on
        return [("ERROR", 0, None, None, None, "MALFORMED_DOCUMENT", f"the parser failed: {type(e).__name__}")]
    units = [("UNIT", i, t, h, s, None, None) for i, (t, h, s) in enumerate(rows.units)]
    return units + [("ARTIFACT", i, None, None, None, k, r) for i, (k, r) in enumerate(rows.artifacts)]


def intact(content: Column, sha256: Column) -> Column:
    """Whether a content is the one on record."""
    return F.coalesce(F.sha2(content, 256) == sha256, F.lit(False))


def over_limits(characters: Column, units: Column) -> Column:
    """Whether totals of a document are over the ceilings of an extraction."""
    return (characters > LIMITS["characters"]) | (units > LIMITS["units"])


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, sha256, size, content) of the files of a folder and those below it, with a parser for their suffix."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    known = F.lower(F.regexp_extract("path", r"(\.[A-Za-z]+)$", 1)).isin(*SUFFIXES)
    return files.where(known).select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("size"), "content")


def parsed(files: DataFrame) -> DataFrame:
    """The rows of each file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(r.path, r.sha256, *row) for r in batch.itertuples() for row in parse(r.path, r.content)]
            yield pd.DataFrame(out, columns=[c.split()[0] for c in SCHEMA.split(", ")])

    return files.select("path", "sha256", "content").mapInPandas(run, SCHEMA)


def snapshot_scores(rows: DataFrame) -> DataFrame:
    """(path, score, hard_block) of parsed files: errors and active content block, hidden text and controls weigh 80."""
    kind = F.when(F.col("row_kind") == "ERROR", "MALFORMED_DOCUMENT").otherwise(F.col("type"))
    hard = F.coalesce(kind.isin(*policy.HARD_BLOCK_TYPES), F.lit(False))
    score = F.when(hard, 100).when(kind.isin("HIDDEN_TEXT", "CONTROL_CHARACTERS"), 80).when(kind.isin("TRACKED_CHANGES", "EXTERNAL_REFERENCE"), 45).when(kind.isNotNull(), 30).otherwise(0)
    return rows.groupBy("path").agg(F.max(score).alias("score"), F.bool_or(hard).alias("hard_block"))
