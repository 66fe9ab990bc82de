"""Stored files: packages built here, parsed to rows."""

from __future__ import annotations

import io
import zipfile

import pytest

from lodestone.operators import changes
from lodestone.sources import packages

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
REL = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://x/officeDocument" Target="word/document.xml"/></Relationships>'


def archive(members, encrypted=False):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in members.items():
            z.writestr(name, text)
    return out.getvalue()


def word(body, **more):
    return archive({"_rels/.rels": REL, "word/document.xml": f"<w:document {W}><w:body>{body}</w:body></w:document>", **more})


def run(text, properties=""):
    return f"<w:p><w:r><w:rPr>{properties}</w:rPr><w:t>{text}</w:t></w:r></w:p>"


def hwp(body, **more):
    header = '<head><charPr id="0" height="1000" textColor="#000000"/><charPr id="1" height="100" textColor="#FFFFFF"/></head>'
    descriptor = '<package><manifest><item id="s0" href="section0.xml"/></manifest><spine><itemref idref="s0"/></spine></package>'
    return archive({"mimetype": "application/hwp+zip", "Contents/content.hpf": descriptor, "Contents/header.xml": header, "Contents/section0.xml": f"<sec>{body}</sec>", **more})


def kinds(path, content):
    rows = packages.parse(path, content)
    return [(r[2], r[3]) for r in rows if r[0] == "UNIT"], sorted(r[5] for r in rows if r[0] != "UNIT")


@pytest.mark.parametrize(
    ("path", "content", "units", "found"),
    [
        ("a.md", "﻿One\n\n two\n".encode(), [("One", False), (" two", False)], []),
        ("a.md", b"\xff\xfe", [], ["MALFORMED_DOCUMENT"]),
        ("a.md", "x​y".encode(), [("x​y", False)], ["CONTROL_CHARACTERS"]),
        ("a.docx", word(run("Seen") + run("Unseen", "<w:vanish/>") + run("Pale", '<w:color w:val="FFFFFF"/>')), [("Seen", False), ("Unseen", True), ("Pale", True)], ["HIDDEN_TEXT"]),
        ("a.docx", word(run("Lit", '<w:color w:val="FFFFFF"/><w:highlight w:val="black"/>')), [("Lit", False)], []),
        ("a.docx", word(run("By style", '<w:rStyle w:val="b"/>'), **{"word/styles.xml": f'<w:styles {W}><w:style w:styleId="a"><w:rPr><w:vanish/></w:rPr></w:style><w:style w:styleId="b"><w:basedOn w:val="a"/></w:style></w:styles>'}), [("By style", True)], ["HIDDEN_TEXT"]),
        ("a.docx", word(run("x", '<w:rStyle w:val="a"/>'), **{"word/styles.xml": f'<w:styles {W}><w:style w:styleId="a"><w:basedOn w:val="a"/></w:style></w:styles>'}), [], ["MALFORMED_DOCUMENT"]),
        ("a.docx", word(run("x"), **{"word/vbaProject.bin": "m"}), [("x", False)], ["ACTIVE_CONTENT"]),
        ("a.docx", word("<w:ins>" + run("x") + "</w:ins>"), [("x", False)], ["TRACKED_CHANGES"]),
        ("a.docx", b"no package", [], ["FORMAT_MISMATCH"]),
        ("a.docx", archive({"../x": "y"}), [], ["PATH_TRAVERSAL"]),
        ("a.docx", word("<!DOCTYPE x>"), [], ["MALFORMED_DOCUMENT"]),
        ("a.docx", archive({"zeros": "0" * 1_000_000}), [], ["ZIP_BOMB"]),
        ("a.hwpx", hwp('<run charPrIDRef="0"><t>Seen</t></run><run charPrIDRef="1"><t>Unseen</t></run>'), [("Seen", False), ("Unseen", True)], ["HIDDEN_TEXT"]),
        ("a.hwpx", hwp("<run><t>x</t></run>", **{"Scripts/a.js": "1", "BinData/a.png": "1"}), [("x", False)], ["ACTIVE_CONTENT"]),
        ("a.hwpx", word(run("x")), [], ["FORMAT_MISMATCH"]),
        ("a.hwp", b"x", [], ["UNSUPPORTED_FORMAT"]),
    ],
)
def test_parse(path, content, units, found):
    assert kinds(path, content) == (units, found)


def test_files_become_rows_and_snapshots_events(spark, tmp_path):
    for name, content in {"in/a.md": b"# One", "in/sub/b.docx": word(run("x"), **{"word/vbaProject.bin": "m"}), "in/c.docx": b"bad", "in/notes.txt": b"no"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(content)
    files = packages.read_files(spark, str(tmp_path / "in"))
    assert sorted(r.path.rpartition("/")[2] for r in files.collect()) == ["a.md", "b.docx", "c.docx"]
    scores = {r.path.rpartition("/")[2]: (r.score, r.hard_block) for r in packages.snapshot_scores(packages.parsed(files)).collect()}
    assert scores == {"a.md": (0, False), "b.docx": (100, True), "c.docx": (100, True)}
    before = files.select("path", "sha256").collect()
    frame = spark.createDataFrame([(r.path, r.sha256) for r in before], "path string, sha256 string")
    (tmp_path / "in/a.md").write_bytes(b"# Two")
    (tmp_path / "in/c.docx").unlink()
    (tmp_path / "in/d.md").write_bytes(b"new")
    events = changes.snapshot_events(frame, packages.read_files(spark, str(tmp_path / "in")).select("path", "sha256"))
    assert {(r.path.rpartition("/")[2], r.event) for r in events.collect()} == {("a.md", "MODIFIED"), ("c.docx", "DELETED"), ("d.md", "CREATED")}
