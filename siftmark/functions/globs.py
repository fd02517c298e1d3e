"""Ignore globs as regular expressions for ``rlike`` on relative paths.

``*`` and ``?`` also match ``/``; a pattern covers the whole path. ``**/``, ``/**``
and ``/**/`` stand for any number of whole components.
"""

from __future__ import annotations

import logging
import re
from collections.abc import Callable, Iterable

log = logging.getLogger("siftmark")

# Glob token -> regular expression, tried in this order.
_TOKENS = [
    (re.compile(r"(?<![^{,])\*\*(?=$|[,}])"), ".*"),
    (re.compile(r"(?<![^{,])\*\*/(?:\*\*/)*"), "(?:.*/)?"),
    (re.compile(r"/(?:\*\*/)*\*\*(?=$|[,}])"), "/.*"),
    (re.compile(r"/(?:\*\*/)+"), "/(?:.*/)?"),
    (re.compile(r"\*+"), ".*"),
    (re.compile(r"\?"), "."),
]
_CLASS = re.compile(r"\[([!^]?)(\]?[^\]]*)\]", re.DOTALL)


class InvalidGlob(ValueError):
    """The pattern has an unclosed class or brace, or ends in a backslash."""


def glob_to_regex(glob: str) -> str:
    """A Java regular expression that finds the paths the glob covers."""
    return "(?s)^(?:" + _body(glob) + r")\z"


def _body(glob: str) -> str:
    out, at, depth = [], 0, 0
    while at < len(glob):
        char = glob[at]
        for token, pattern in _TOKENS:
            found = token.match(glob, at)
            if found:
                out.append(pattern)
                at = found.end()
                break
        else:
            if char == "[":
                found = _CLASS.match(glob, at)
                if not found:
                    raise InvalidGlob(f"unclosed character class in {glob!r}")
                out.append(_class_regex(found.group(2), negated=bool(found.group(1)), glob=glob))
                at = found.end()
                continue
            if char == "{":
                depth += 1
                out.append("(?:")
            elif char == "}" and depth == 0:
                raise InvalidGlob(f"unopened alternation in {glob!r}")
            elif char == "}":
                depth -= 1
                out.append(")")
            elif char == "," and depth:
                out.append("|")
            elif char == "\\":
                at += 1
                if at == len(glob):
                    raise InvalidGlob(f"dangling backslash in {glob!r}")
                out.append(_literal(glob[at]))
            else:
                out.append(_literal(char))
            at += 1
    if depth:
        raise InvalidGlob(f"unclosed alternation in {glob!r}")
    return "".join(out)


def _literal(char: str) -> str:
    return char if char.isalnum() or ord(char) > 127 else "\\" + char


def _class_regex(body: str, negated: bool, glob: str) -> str:
    parts, at = [], 0
    while at < len(body):
        low, high = body[at], body[at]
        if at + 2 < len(body) and body[at + 1] == "-":
            high = body[at + 2]
            at += 2
        if low > high:
            raise InvalidGlob(f"range {low}-{high} in {glob!r} is out of order")
        parts.append(_literal(low) if low == high else f"{_literal(low)}-{_literal(high)}")
        at += 1
    return f"[{'^' if negated else ''}{''.join(parts)}]"


def _valid(globs: Iterable[str]) -> list[str]:
    """Globs that can be understood; the others are logged."""
    valid = []
    for glob in globs:
        try:
            _body(glob)
            valid.append(glob)
        except InvalidGlob as err:
            log.warning("ignore pattern dropped: %s", err)
    return valid


def ignore_regex(globs: Iterable[str]) -> str | None:
    """One pattern for all valid globs; invalid ones are logged and dropped."""
    return "|".join(f"(?:{glob_to_regex(g)})" for g in _valid(globs)) or None


def ignore_test(globs: Iterable[str]) -> Callable[[str], bool]:
    """The same as a Python function of a path; a root itself (no path) is never ignored."""
    whole = "|".join(f"(?:{_body(g)})" for g in _valid(globs))
    if not whole:
        return lambda path: False
    found = re.compile(whole, re.DOTALL).fullmatch
    return lambda path: bool(path and found(path))
