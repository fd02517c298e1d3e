"""The chunker, against fixed cases and line-by-line properties."""

import hypothesis.strategies as st
from hypothesis import given

from siftmark.functions.markdown import (
    count_tokens,
    parse_heading,
    pieces,
    sections,
    split_lines,
    windows,
)


def chunks(source, budget=256, overlap=32):
    return list(pieces(source, budget, overlap))


def test_nesting_and_line_numbers():
    found = chunks(
        "# Boats\nall kinds\n### Oars\nof ash wood\n## Sails\nred\nor white\n# Nets\nmended\n## Floats\n"
    )
    assert [(c.heading_path, c.line_start, c.line_end) for c in found] == [
        (["Boats"], 1, 2),
        (["Boats", "Oars"], 3, 4),
        (["Boats", "Sails"], 5, 7),
        (["Nets"], 8, 9),
        (["Nets", "Floats"], 10, 10),
    ]
    assert found[2].text == "## Sails\nred\nor white"


def test_preamble_and_heading_whitespace():
    found = chunks("dear reader,\n##no space here\n\n##\twith a tab\nthe end\n")
    assert [(c.heading_path, c.line_start) for c in found] == [([], 1), (["with a tab"], 4)]
    assert found[0].text == "dear reader,\n##no space here"


def test_fences_keep_their_lines_together():
    code = "\n".join(f"step {n} of nine" for n in range(1, 10))
    for fence in ("```", "~~~~"):
        found = chunks(f"# Recipe\n{fence}sh\n{code}\n{fence}\nserve it warm\n", 5, 0)
        (fenced,) = [c for c in found if fence in c.text]
        assert fenced.text.count(fence) == 2 and code in fenced.text
        assert found[-1].text.endswith("serve it warm")


def test_overlap_and_budget():
    lines = [f"verse {n}" for n in range(30)]
    found = chunks("\n".join(["# Song", *lines]), 8, 4)
    assert (found[0].line_start, found[-1].line_end) == (1, 31)
    assert all(b.line_start == a.line_end - 1 for a, b in zip(found, found[1:]))
    assert all(count_tokens(c.text) <= 8 for c in found)
    plain = chunks("\n".join(["# Song", *lines]), 8, 0)
    assert [c.line_start for c in plain[1:]] == [c.line_end + 1 for c in plain[:-1]]


def spans(tokens, budget, overlap):
    return list(windows([" ".join(["w"] * t) for t in tokens], budget, overlap))


def test_worked_window_examples():
    assert spans([2] + [1] * 20, 5, 2) == [
        (0, 4), (2, 7), (5, 10), (8, 13), (11, 16), (14, 19), (17, 21),
    ]
    fenced = ["# Code", "```rust", *["let x = 1;"] * 6, "```", "tail one", "tail two"]
    assert list(windows(fenced, 8, 4)) == [(0, 9), (7, 10), (8, 11)]
    assert spans([4, 4, 4, 20, 2], 12, 6) == [(0, 3), (1, 3), (2, 3), (3, 4), (4, 5)]
    assert spans([4, 4, 4, 20, 2], 12, 0) == [(0, 3), (3, 4), (4, 5)]
    assert spans([2] * 6, 4, 9) == [(0, 2), (1, 3), (2, 4), (3, 5), (4, 6)]
    assert spans([100, 100], 0, 5) == [(0, 2)]


def test_headings():
    assert parse_heading("# C#") == (1, "C")
    assert parse_heading("   ## x ##  ") == (2, "x")
    assert parse_heading("#") == (1, "")
    assert parse_heading("# x") == (1, "x")
    for line in ("#x", "####### x", "text # x", "﻿# x", "#\x1cx"):
        assert parse_heading(line) is None


def test_line_and_token_primitives():
    assert split_lines("a\r\nb\rc\n\nd\r") == ["a", "b\rc", "", "d\r"]
    assert split_lines("") == [] and split_lines("\n") == [""]
    assert count_tokens(" a b　c ") == 3
    assert count_tokens("a\x1cb c") == 2


def test_unusual_fences():
    found = chunks("# A\n```\n# not a heading\n")  # never closed
    assert len(found) == 1 and found[0].line_end == 3
    assert [c.heading_path for c in chunks("```x```\n# inside\n```\n# out\n")] == [[], ["out"]]
    assert len(chunks("````\n```\n# in\n````\n# out\n")) == 2
    assert len(chunks("~~~\n```\n# in\n~~~ tail\n# in\n~~~\n# out\n")) == 2
    assert chunks(" \n\t\n") == [] and chunks("") == []


def test_blank_edges_are_trimmed_but_indent_stays():
    (only,) = chunks("\n\n   indented\n\nend  \n\n")
    assert (only.text, only.line_start, only.line_end) == ("   indented\n\nend  ", 3, 5)


_LINES = st.lists(
    st.sampled_from(["", "w", "w w w", "w w w w w w w", "```", "~~~", "````", "# h", "## h2", "  "]),
    max_size=25,
)


def _open_after(lines):
    """Naive fence state after every line."""
    marker, states = "", []
    for line in lines:
        run = len(line) - len(line.lstrip("`~"))
        if marker and run >= len(marker) and line[0] == marker[0]:
            marker = ""
        elif not marker and run >= 3:
            marker = line[:run]
        states.append(bool(marker))
    return states


@given(_LINES, st.integers(1, 12), st.integers(0, 12))
def test_windows_cover_and_end_outside_fences(lines, budget, overlap):
    found = list(windows(lines, budget, overlap))
    states = _open_after(lines)
    assert found[0][0] == 0 and found[-1][1] == len(lines)
    for (a, b), (c, d) in zip(found, found[1:]):
        assert a < c <= b <= d and not states[b - 1]
    tokens = [len(line.split()) for line in lines]
    for begin, end in found:
        within = sum(tokens[begin:end]) <= budget or end - begin <= 1
        assert within or any(states[begin : end - 1])


@given(_LINES, st.integers(0, 8), st.integers(0, 4))
def test_pieces_quote_the_source_lines(lines, budget, overlap):
    source = "\n".join(lines)
    whole = split_lines(source)
    assert [s[1:] for s in sections(whole)][-1][1] == len(whole)
    covered = set()
    for piece in pieces(source, budget, overlap):
        assert piece.text == "\n".join(whole[piece.line_start - 1 : piece.line_end])
        covered.update(range(piece.line_start - 1, piece.line_end))
    assert covered >= {i for i, line in enumerate(whole) if line.strip()}
