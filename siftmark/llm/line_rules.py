"""Quality rules, lines first: failing lines go, then documents that lost too much.

Every line with a word is judged alone: *punctuation* (too many marks for its letters,
or a one- or two-word line without an end mark), *navigation* (separator words as in
menus and breadcrumbs) and *boilerplate* (a short line with a stock phrase). Failing
lines are removed. A document is rejected if the removed lines held more than
``MOST_LOST`` percent of its word characters, or if the base rules reject it: fewer
than 20 words, or over 30 percent of the words in repeated 8-word windows.

Words are runs without ASCII white space. Null and empty texts have no words, so the
base rules reject them; ``clean_text`` is then empty. Each row is judged on its own,
so repeated rows get equal results. Texts of any length are read whole.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import append_columns, mix64

# What the contract counts as symbols, and the rules of a line.
SYMBOLS = "#*$%&|<>"
MARKS = "#*$%&|<>!~^="
MARKS_PERCENT = 15
END_MARKS = ".!?:;,\"')…”’"
NAVIGATION = ["|", ">", "<", "/", "-", "»", "«", "›", "‹", "·", "•"]
NAVIGATION_PERCENT = 20
NAVIGATION_LEAST = 3
BOILERPLATE = [
    "all rights reserved",
    "accept cookies",
    "click here",
    "cookie policy",
    "enable javascript",
    "privacy policy",
    "sign up for our newsletter",
    "subscribe to our",
    "terms of service",
    "terms of use",
    "akzeptieren sie alle cookies",
    "alle rechte vorbehalten",
    "cookies akzeptieren",
    "datenschutzerklärung",
    "hier klicken",
    "javascript aktivieren",
    "klicken sie hier",
    "newsletter abonnieren",
    "nutzungsbedingungen",
    "abonnez-vous",
    "accepter les cookies",
    "accepter tous les cookies",
    "activer javascript",
    "cliquez ici",
    "mentions légales",
    "politique de confidentialité",
    "tous droits réservés",
    "aceptar cookies",
    "aceptar las cookies",
    "aviso legal",
    "haga clic",
    "habilite javascript",
    "política de privacidad",
    "términos de uso",
    "todos los derechos reservados",
]
BOILERPLATE_WORDS = 20
MOST_LOST = 30
MIN_WORDS = 20
REPEAT_PERCENT = 30
WINDOW = 8

_BLANKS = b" \t\n\x0b\x0c\r"
_INNER = bytes(range(0x80, 0xC0))  # bytes that continue a character of UTF-8
_SYMBOLS, _MARKS = SYMBOLS.encode(), MARKS.encode()
_ENDS = tuple(c.encode() for c in END_MARKS)
_NAVIGATION = frozenset(c.encode() for c in NAVIGATION)


def _any_case(phrase: str) -> str:
    """A pattern for lines whose A-Z are lowered already."""
    return "".join(re.escape(c) if c.isascii() else f"(?:{c}|{c.upper()})" for c in phrase)


_STOCK = re.compile("|".join(map(_any_case, BOILERPLATE)).encode())
_FACTORS = mix64(np.arange(1, WINDOW + 1, dtype=np.uint64)) | np.uint64(1)


def _letters(data: bytes) -> int:
    return len(data.translate(None, _BLANKS + _INNER))


def line_fails(line: bytes, words: list[bytes]) -> bool:
    """Whether one line with words breaks a rule."""
    chars = _letters(line)
    if 100 * (len(line) - len(line.translate(None, _MARKS))) > MARKS_PERCENT * chars:
        return True
    if len(words) < 3 and not words[-1].endswith(_ENDS):
        return True
    separators = sum([w in _NAVIGATION for w in words])
    if separators >= NAVIGATION_LEAST and 100 * separators >= NAVIGATION_PERCENT * len(words):
        return True
    return len(words) <= BOILERPLATE_WORDS and bool(_STOCK.search(line.lower()))


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of ``WINDOW`` words found at two places or more."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    each = mix64(np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64))
    window = np.zeros(n, np.uint64)
    for k in range(WINDOW):
        window += each[k : n + k] * _FACTORS[k]
    order = np.argsort(window, kind="stable")
    same = window[order[1:]] == window[order[:-1]]
    if not same.any():
        return 0
    at = np.unique(np.r_[order[1:][same], order[:-1][same]])
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + WINDOW, -1)
    return int((np.cumsum(edges)[:-1] > 0).sum())


def judge(data: bytes) -> tuple:
    """All measures and the clean text of one text."""
    words = data.split()
    lines = data.split(b"\n")
    kept_lines, seen, with_words, failed, lost = [], set(), 0, 0, 0
    for line in lines:
        of_line = line.split()
        if of_line:
            with_words += 1
            seen.add(line)
            if line_fails(line, of_line):
                failed += 1
                lost += _letters(line)
                continue
        kept_lines.append(line)
    chars, repeats = _letters(data), repeated_words(words)
    base = len(words) < MIN_WORDS or 100 * repeats > REPEAT_PERCENT * len(words)
    return (
        len(words),
        chars,
        len(data) - len(data.translate(None, _SYMBOLS)),
        with_words - len(seen),
        repeats,
        base,
        not base and 100 * lost <= MOST_LOST * chars,
        failed,
        lost,
        b"\n".join(kept_lines) if failed else data,
    )


FIELDS = [
    ("n_words", T.LongType()),
    ("word_chars", T.LongType()),
    ("n_symbols", T.LongType()),
    ("n_dup_lines", T.LongType()),
    ("n_repeat_words", T.LongType()),
    ("base_failed", T.BooleanType()),
    ("kept", T.BooleanType()),
    ("n_failed_lines", T.LongType()),
    ("lost_chars", T.LongType()),
    ("clean_text", T.StringType()),
]
_ARROW = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.int64()] * 2 + [pa.string()]


def apply_line_rules(docs: DataFrame, text: str = "text", clean: bool = True) -> DataFrame:
    """``docs`` with the columns of ``FIELDS``; ``clean=False`` leaves out the clean text."""
    last = len(FIELDS) if clean else len(FIELDS) - 1

    def make():
        def work(column: pa.Array) -> list[pa.Array]:
            texts = pc.fill_null(column, "").cast(pa.binary()).to_pylist()
            found = list(zip(*map(judge, texts), strict=True)) if texts else [[]] * len(FIELDS)
            made = [pa.array(v, t) for v, t in zip(found[: len(FIELDS) - 1], _ARROW, strict=False)]
            if clean:
                made.append(pa.array(found[-1], pa.binary()).cast(pa.string()))
            return made

        return work

    return append_columns(docs, text, FIELDS[:last], make)
