"""Alignment of two sequences by longest common blocks, for sequences of any length.

The rule: the longest common block is taken, of equally long ones that which starts earliest in the first sequence, then
earliest in the second; what lies before and behind it is aligned alike. A suffix automaton of one side, which the other
side is read through, finds the greatest length in linear time and all places of that length with it. As the taken
block is the earliest of its length, nothing before it is as long, so all blocks of the greatest length are taken in one
pass from left to right, and only shorter ones are left for the gaps between. Lengths fall with each step into a gap,
and blocks of length n take n units, so there are at most about sqrt(2 * units) such steps, however repetitive both sides
are. Gaps wait on a list; nothing recurs.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Hashable, Sequence

KINDS = {(False, True): "ADD", (True, False): "DELETE", (True, True): "REPLACE"}


class SuffixAutomaton:
    """States of the substrings of a sequence of numbers: a state stands for all substrings with the same end places."""

    __slots__ = ("ends", "length", "link", "steps")

    def __init__(self, units: Sequence[int]):
        self.length, self.link, self.steps = [0], [-1], [{}]
        #: The state of each prefix.
        self.ends: list[int] = []
        length, link, steps = self.length, self.link, self.steps
        last = 0
        for unit in units:
            new = len(length)
            length.append(length[last] + 1)
            link.append(0)
            steps.append({})
            at = last
            while at >= 0 and unit not in steps[at]:
                steps[at][unit] = new
                at = link[at]
            if at >= 0:
                to = steps[at][unit]
                if length[at] + 1 != length[to]:
                    copy = len(length)
                    length.append(length[at] + 1)
                    link.append(link[to])
                    steps.append(dict(steps[to]))
                    while at >= 0 and steps[at].get(unit) == to:
                        steps[at][unit] = copy
                        at = link[at]
                    link[to] = link[new] = copy
                else:
                    link[new] = to
            last = new
            self.ends.append(new)

    def places(self, size: int) -> dict[int, list[int]]:
        """By state: where substrings of this size end, in order."""
        of: dict[int, int] = {}
        out: dict[int, list[int]] = {}
        for end, state in enumerate(self.ends, 1):
            path = []
            while state not in of and self.length[state] >= size > 0:
                path.append(state)
                if self.length[self.link[state]] < size:
                    of[state] = state
                    break
                state = self.link[state]
            if end >= size:
                whole = of[state]
                for s in path:
                    of[s] = whole
                out.setdefault(whole, []).append(end)
        return out


def _longest(a: Sequence[int], b: Sequence[int]) -> tuple[int, list[tuple[int, int]]]:
    """The greatest length of a common block, and the blocks of that length from left to right, as starts."""
    automaton = SuffixAutomaton(b)
    length, link, steps = automaton.length, automaton.link, automaton.steps
    state = size = best = 0
    found: list[tuple[int, int]] = []  # ends of the greatest length so far, with their states
    for end, unit in enumerate(a, 1):
        while state and unit not in steps[state]:
            state = link[state]
            size = length[state]
        to = steps[state].get(unit)
        if to is None:
            continue
        state, size = to, size + 1
        if size > best:
            best, found = size, []
        if size == best:
            found.append((end, state))
    if not best:
        return 0, []
    places, blocks = automaton.places(best), []
    after = beyond = 0
    for end, state in found:
        if end - best < after:
            continue
        ends = places[state]
        at = bisect_left(ends, beyond + best)
        if at < len(ends):
            blocks.append((end - best, ends[at] - best))
            after, beyond = end, ends[at]
    return best, blocks


def matching_blocks(before: Sequence[Hashable], after: Sequence[Hashable]) -> list[tuple[int, int, int]]:
    """(start, start, size) of the common blocks, in order; blocks that touch on both sides are one."""
    number: dict[Hashable, int] = {}
    a, b = ([number.setdefault(unit, len(number)) for unit in side] for side in (before, after))
    blocks: list[tuple[int, int, int]] = []
    gaps = [(0, len(a), 0, len(b))]
    while gaps:
        low, high, left, right = gaps.pop()
        one, other = a[low:high], b[left:right]
        if set(one).isdisjoint(other):
            continue
        size, found = _longest(one, other)
        i0, j0 = low, left
        for i, j in found:
            begin, start = low + i, left + j
            blocks.append((begin, start, size))
            gaps.append((i0, begin, j0, start))
            i0, j0 = begin + size, start + size
        gaps.append((i0, high, j0, right))
    merged: list[tuple[int, int, int]] = []
    for i, j, size in sorted(blocks):
        if merged and merged[-1][0] + merged[-1][2] == i and merged[-1][1] + merged[-1][2] == j:
            merged[-1] = (*merged[-1][:2], merged[-1][2] + size)
        else:
            merged.append((i, j, size))
    return merged


def unequal_blocks(before: Sequence[Hashable], after: Sequence[Hashable]) -> list[tuple[str, list, list]]:
    """(kind, before, after) of what lies between the common blocks."""
    out, i0, j0 = [], 0, 0
    for i, j, size in [*matching_blocks(before, after), (len(before), len(after), 0)]:
        if i0 < i or j0 < j:
            out.append((KINDS[i0 < i, j0 < j], list(before[i0:i]), list(after[j0:j])))
        i0, j0 = i + size, j + size
    return out
