"""Heading- and fence-aware splitting of one markdown document.

A row-local generator (one document in, its pieces out), called per Arrow batch by
``operators.chunking``. Fence and heading state runs line by line through a
document, which no built-in expression can carry.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate
from typing import NamedTuple

# The characters of Unicode White_Space. Python's own notion adds
# U+001C..U+001F, so strip() and split() must not be used without this set.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

_NON_SPACE_RUN = re.compile(f"[^{WHITE_SPACE}]+")
_PYTHON_ONLY_SPACE = re.compile("[\x1c-\x1f]")
_HEADING = re.compile(f"[{WHITE_SPACE}]*(#{{1,6}})(?=[{WHITE_SPACE}]|$)(.*)", re.DOTALL)
_FENCE = re.compile(f"[{WHITE_SPACE}]*(`{{3,}}|~{{3,}})(.*)", re.DOTALL)


class Piece(NamedTuple):
    heading_path: list[str]
    text: str
    line_start: int
    line_end: int


class _Fence:
    """Open/closed state of fenced code while lines go by."""

    def __init__(self) -> None:
        self.marker = ""

    def feed(self, line: str) -> bool:
        """Take one line; True when the line opens, closes or lies in a fence."""
        if not self.marker and "```" not in line and "~~~" not in line:
            return False
        found = _FENCE.match(line)
        if not self.marker:
            self.marker = found.group(1) if found else ""
            return bool(found)
        if found and found.group(1).startswith(self.marker) and _blank(found.group(2)):
            self.marker = ""
        return True


def _blank(line: str) -> bool:
    return not line.strip(WHITE_SPACE)


def count_tokens(line: str) -> int:
    if _PYTHON_ONLY_SPACE.search(line):
        return len(_NON_SPACE_RUN.findall(line))
    return len(line.split())


def split_lines(source: str) -> list[str]:
    r"""Lines ended by ``\n`` or ``\r\n``; a lone ``\r`` is ordinary text."""
    *ended, last = source.split("\n")
    lines = [line[:-1] if line.endswith("\r") else line for line in ended]
    return [*lines, last] if last else lines


def parse_heading(line: str) -> tuple[int, str] | None:
    """``(level, title)`` of an ATX heading line."""
    found = _HEADING.match(line) if "#" in line else None
    if found is None:
        return None
    title = found.group(2).strip(WHITE_SPACE).rstrip("#").strip(WHITE_SPACE)
    return len(found.group(1)), title


def sections(lines: list[str]) -> Iterator[tuple[list[str], int, int]]:
    """``(heading path, first line, end line)`` spans; the heading line leads its span."""
    fence, trail, begin = _Fence(), [], 0
    for number, line in enumerate(lines):
        heading = None if fence.feed(line) else parse_heading(line)
        if heading:
            yield [title for _, title in trail], begin, number
            trail = [*(h for h in trail if h[0] < heading[0]), heading]
            begin = number
    yield [title for _, title in trail], begin, len(lines)


def windows(lines: list[str], budget: int, overlap: int) -> Iterator[tuple[int, int]]:
    """Half-open line ranges of at most ``budget`` tokens covering a section.

    A range holds at least one line and is stretched so that it never ends inside
    a fence. The next range starts at the last line that repeats ``overlap`` tokens.
    """
    n = len(lines)
    upto = [0, *accumulate(map(count_tokens, lines))]
    if budget == 0 or upto[n] <= budget:
        yield 0, n
        return
    fence = _Fence()
    cut_after = [0] * (n + 1)  # nearest fence-safe cut at or after each line
    opened = [bool(fence.feed(line) and fence.marker) for line in lines]
    safe = n
    for at in range(n, -1, -1):
        if at == n or at == 0 or not opened[at - 1]:
            safe = at
        cut_after[at] = safe
    begin = end = 0
    while end < n:
        end = cut_after[max(begin + 1, bisect_right(upto, upto[begin] + budget) - 1)]
        yield begin, end
        if overlap:
            begin = max(begin + 1, bisect_right(upto, upto[end] - overlap) - 1)
        else:
            begin = end


def pieces(source: str, budget: int, overlap: int) -> Iterator[Piece]:
    """Chunks of one document, in order, with 1-based inclusive line numbers."""
    lines = split_lines(source)
    for trail, first, last in sections(lines):
        for begin, end in windows(lines[first:last], budget, overlap):
            begin, end = first + begin, first + end
            while begin < end and _blank(lines[begin]):
                begin += 1
            while begin < end and _blank(lines[end - 1]):
                end -= 1
            if begin < end:
                yield Piece(trail, "\n".join(lines[begin:end]), begin + 1, end)
