"""English Snowball ("Porter2") stemming, from the published algorithm.

``stem`` handles one lower-case word; ``stem_values`` maps the dictionary of an
Arrow string array. Only the worker-side helpers live here:
which rows they see is decided by the DataFrame plans that call them.
"""

from __future__ import annotations

import re

import pyarrow as pa

from .text import VERBATIM

# Fixed values of the published algorithm -------------------------------------
_SPECIAL = {
    "skis": "ski",
    "skies": "sky",
    "dying": "die",
    "lying": "lie",
    "tying": "tie",
    "idly": "idl",
    "gently": "gentl",
    "ugly": "ugli",
    "early": "earli",
    "only": "onli",
    "singly": "singl",
    "sky": "sky",
    "news": "news",
    "howe": "howe",
    "atlas": "atlas",
    "cosmos": "cosmos",
    "bias": "bias",
    "andes": "andes",
}
_KEEP_AFTER_1A = frozenset(
    "inning outing canning herring earring proceed exceed succeed".split()
)
_R1_PREFIX = re.compile("gener|commun|arsen")
_STEP2 = {
    "tional": "tion",
    "enci": "ence",
    "anci": "ance",
    "abli": "able",
    "entli": "ent",
    "izer": "ize",
    "ization": "ize",
    "ational": "ate",
    "ation": "ate",
    "ator": "ate",
    "alism": "al",
    "aliti": "al",
    "alli": "al",
    "fulness": "ful",
    "ousli": "ous",
    "ousness": "ous",
    "iveness": "ive",
    "iviti": "ive",
    "biliti": "ble",
    "bli": "ble",
    "ogi": "og",
    "fulli": "ful",
    "lessli": "less",
    "li": "",
}
_STEP3 = {
    "tional": "tion",
    "ational": "ate",
    "alize": "al",
    "icate": "ic",
    "iciti": "ic",
    "ical": "ic",
    "ful": "",
    "ness": "",
    "ative": "",
}
_STEP4 = (
    "al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize ion".split()
)
_LI_ENDINGS = "cdeghkmnrt"
# -----------------------------------------------------------------------------

_VOWEL = "[aeiouy]"
_OTHER = "[^aeiouy]"
_REGION = re.compile(f".*?{_VOWEL}{_OTHER}")
_HAS_VOWEL = re.compile(_VOWEL)
_SHORT_END = re.compile(f"(?:{_OTHER}{_VOWEL}[^aeiouywxY]|^{_VOWEL}{_OTHER})$")
_CONSONANT_Y = re.compile(f"^y|(?<={_VOWEL})y")
_DOUBLED = re.compile(r"(?:bb|dd|ff|gg|mm|nn|pp|rr|tt)$")


class _Longest:
    """Finds the longest of some suffixes; most words have none and cost one test."""

    def __init__(self, suffixes) -> None:
        by_length = sorted(suffixes, key=len, reverse=True)
        self._any = tuple(by_length)
        self._pattern = re.compile(f"(?:{'|'.join(by_length)})$")

    def search(self, word: str) -> re.Match | None:
        return self._pattern.search(word) if word.endswith(self._any) else None


_STEP1A = _Longest(["sses", "ied", "ies", "us", "ss", "s"])
_STEP1B = _Longest(["eed", "eedly", "ed", "edly", "ing", "ingly"])
_STEP2_END = _Longest(_STEP2)
_STEP3_END = _Longest(_STEP3)
_STEP4_END = _Longest(_STEP4)


def _region_starts(word: str) -> tuple[int, int]:
    first = _R1_PREFIX.match(word) or _REGION.match(word)
    if first is None:
        return len(word), len(word)
    second = _REGION.match(word, first.end())
    return first.end(), second.end() if second else len(word)


def _plural(word: str) -> str:
    found = _STEP1A.search(word)
    if found is None:
        return word
    ending, head = found.group(), word[: found.start()]
    if ending == "sses":
        return head + "ss"
    if ending in ("ied", "ies"):
        return head + ("i" if len(head) > 1 else "ie")
    if ending == "s" and _HAS_VOWEL.search(head[:-1]):
        return head
    return word


def _participle(word: str, r1: int) -> str:
    found = _STEP1B.search(word)
    if found is None:
        return word
    ending, head = found.group(), word[: found.start()]
    if ending.startswith("ee"):
        return head + "ee" if found.start() >= r1 else word
    if not _HAS_VOWEL.search(head):
        return word
    if head.endswith(("at", "bl", "iz")):
        return head + "e"
    if _DOUBLED.search(head):
        return head[:-1]
    if len(head) == r1 and _SHORT_END.search(head):
        return head + "e"
    return head


def _derivational(word: str, r1: int, r2: int) -> str:
    found = _STEP2_END.search(word)
    if found and found.start() >= r1:
        before = word[found.start() - 1 : found.start()]
        ending = found.group()
        if (ending != "li" or before in _LI_ENDINGS) and (ending != "ogi" or before == "l"):
            word = word[: found.start()] + _STEP2[ending]
    found = _STEP3_END.search(word)
    if found and found.start() >= (r2 if found.group() == "ative" else r1):
        word = word[: found.start()] + _STEP3[found.group()]
    found = _STEP4_END.search(word)
    if found and found.start() >= r2:
        if found.group() != "ion" or word[: found.start()].endswith(("s", "t")):
            word = word[: found.start()]
    if word.endswith("e"):
        cut = len(word) - 1
        if cut >= r2 or (cut >= r1 and not _SHORT_END.search(word[:-1])):
            word = word[:-1]
    elif word.endswith("ll") and len(word) - 1 >= r2:
        word = word[:-1]
    return word


def stem(word: str) -> str:
    """Stem of a lower-case alphabetic word; other input is returned unchanged."""
    if len(word) < 3:
        return word
    if word in _SPECIAL:
        return _SPECIAL[word]
    if "y" in word:
        word = _CONSONANT_Y.sub("Y", word)
    r1, r2 = _region_starts(word)
    word = _plural(word)
    if word not in _KEEP_AFTER_1A:
        word = _participle(word, r1)
        if len(word) > 2 and word[-1] in "yY" and word[-2] not in "aeiouy":
            word = word[:-1] + "i"
        word = _derivational(word, r1, r2)
    return word.replace("Y", "y")


_MEMO_LIMIT = 1 << 19
_memo: dict[str, str] = {}


def stem_token(token: str) -> str:
    """Stem a plain token; one marked by :func:`..text.mark_verbatim` loses its mark."""
    known = _memo.get(token)
    if known is None:
        known = token[1:] if token.startswith(VERBATIM) else stem(token)
        if len(_memo) >= _MEMO_LIMIT:
            _memo.clear()
        _memo[token] = known
    return known


def stem_values(values: pa.Array) -> pa.Array:
    """Stems of an array of distinct tokens, verbatim ones marked."""
    return pa.array([stem_token(v) for v in values.to_pylist()], pa.string())
