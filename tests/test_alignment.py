"""Alignment by longest common blocks against the standard library's, whose rule it keeps."""

from __future__ import annotations

import difflib
import random
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.operators.alignment import SuffixAutomaton, matching_blocks, unequal_blocks
from lodestone.operators.changes import change_arrays, edited, units

KINDS = {"insert": "ADD", "delete": "DELETE", "replace": "REPLACE"}


def by_library(a, b):
    found = difflib.SequenceMatcher(a=a, b=b, autojunk=False).get_opcodes()
    return [(KINDS[kind], list(a[i:j]), list(b[k:m])) for kind, i, j, k, m in found if kind != "equal"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from("ab"), max_size=40), st.lists(st.sampled_from("abc"), max_size=40))
def test_repetitive_sequences(a, b):
    assert unequal_blocks(a, b) == by_library(a, b)


@settings(max_examples=200, deadline=None)
@given(st.data())
def test_edited_sequences(data):
    a = data.draw(st.lists(st.integers(0, 30), max_size=60))
    b = list(a)
    for _ in range(data.draw(st.integers(0, 6))):
        at = data.draw(st.integers(0, len(b)))
        move = b[at : at + data.draw(st.integers(0, 8))]
        b[at : at + data.draw(st.integers(0, 5))] = data.draw(st.sampled_from([[], move + move, [99], a[:5]]))
    assert unequal_blocks(a, b) == by_library(a, b)


def test_longer_sequences_at_random():
    rng = random.Random(1)
    for letters in (1, 2, 3, 12, 400):
        for _ in range(6):
            a, b = ([rng.randrange(letters) for _ in range(rng.randint(0, 220))] for _ in range(2))
            assert unequal_blocks(a, b) == by_library(a, b)


def test_places_of_substrings():
    rng = random.Random(2)
    units = [rng.randrange(3) for _ in range(80)]
    automaton = SuffixAutomaton(units)
    for size in range(1, 81):
        want: dict[tuple, list[int]] = {}
        for end in range(size, 81):
            want.setdefault(tuple(units[end - size : end]), []).append(end)
        assert sorted(automaton.places(size).values()) == sorted(want.values())


@pytest.mark.parametrize(
    "sides",
    [
        lambda n: (["x"] * n, ["x"] * (n - 7)),
        lambda n: (["x", "y"] * (n // 2), ["y", "x", "x"] * (n // 3)),
        lambda n: ([f"{i}" if i % 2 else f"a{i}" for i in range(n)], [f"{i}" if i % 2 else f"b{i}" for i in range(n)]),  # every other line
        lambda n: ([f"{i}" for i in range(n)], [f"{i}" for i in reversed(range(n))]),
        lambda n: ([f"{i * i % 97 % 5}" for i in range(n)], [f"{i * i % 89 % 5}" for i in range(n)]),
    ],
)
def test_long_sequences_take_seconds(sides):
    a, b = sides(20_000)
    began = time.process_time()
    blocks = matching_blocks(a, b)
    assert time.process_time() - began < 30
    for i, j, size in blocks:
        assert a[i : i + size] == b[j : j + size]
    small = sides(300)
    assert unequal_blocks(*small) == by_library(*small)


LINES = st.lists(st.sampled_from(["a", "a", "b", " a", "cafe\u0301", "caf\u00e9", "", " ", "\u200b", "\u0301"]), max_size=6)
ENDS = st.sampled_from(["\n", "\n", "\r\n", "\r", "\n\n"])


@settings(max_examples=1500, deadline=None)
@given(LINES, LINES, LINES, LINES, ENDS, st.booleans())
def test_edited_lines_tell_what_whole_texts_do(head, one, other, tail, end, last):
    before, after = (end.join([*head, *part, *tail]) + end * last for part in (one, other))
    want = by_library(units(before), units(after))
    for b, a, blocks in ((before, after, want), (before, before + "x", by_library(units(before), units(before + "x"))), (before, "x" + end + before, by_library(units(before), units("x" + end + before)))):
        assert edited(b, a) in (None, [(kind, x, y) for kind, x, y in blocks])


def test_single_edits_are_told_by_their_lines():
    text = "\n".join(f"line {n % 3}" for n in range(50))
    edits = [text + "\nmore", text[:-1] + "x", text + "\n\n", "first\n" + text, text.replace("line 1", "line  1")]
    assert all(edited(text, e) is not None and edited(e, text) is not None for e in edits[:4])
    assert edited(text, edits[0]) == [("ADD", [], ["more"])] and edited(edits[3], text) == [("DELETE", ["first"], [])] and edited(text, edits[2]) == []


def test_documents_of_repeated_lines(spark):
    before = "\n".join(["same line"] * 4000)
    after = "\n".join(["same line"] * 2000 + ["new line"] + ["same line"] * 2000)
    rows = change_arrays(spark.createDataFrame([(1, before, after), (2, before, before)], "doc_id int, base_text string, cand_text string")).collect()
    got = {r.doc_id: [(c.kind, c.before, c.after) for c in r.changes] for r in rows}
    assert got == {1: [("ADD", None, "new line")], 2: []}
