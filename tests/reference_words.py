"""Brute-force tokeniser over real UAX #29 segments, for checking the pattern."""

import regex

_BOUNDARY = regex.compile(r"(?w)\b", regex.V1)
_ALNUM = regex.compile(r"[\p{Alphabetic}\p{N}]")
SEPARATORS = set("_.:-")


def segments(text: str) -> list[str]:
    cuts = sorted({0, len(text), *(m.start() for m in _BOUNDARY.finditer(text))})
    return [text[a:b] for a, b in zip(cuts, cuts[1:])]


def icu_segments(spark):
    """Word boundaries of the ICU library in the session's JVM.

    Its dictionary joins ideographs into words, which the default rules do not.
    """
    icu = spark._jvm.com.ibm.icu
    cutter = icu.text.BreakIterator.getWordInstance(icu.util.ULocale.ROOT)
    ideographs = regex.compile(r"\p{Ideographic}[\p{M}\p{Cf}]*+")

    def cut(text: str) -> list[str]:
        units = text.encode("utf-16-le")
        cutter.setText(text)
        at, found = cutter.first(), []
        while (stop := cutter.next()) != -1:
            seg = units[2 * at : 2 * stop].decode("utf-16-le")
            found += ideographs.findall(seg) if ideographs.match(seg) else [seg]
            at = stop
        return found

    return cut


def words(text: str, cut=segments) -> list[str]:
    found, word, open_join = [], "", False
    for seg in cut(text):
        if word and set(seg) <= SEPARATORS:
            word, open_join = word + seg, True
        elif _ALNUM.search(seg):
            if word and not open_join:
                found.append(word)
                word = ""
            word, open_join = word + seg, False
        else:
            if word:
                found.append(word)
            word, open_join = "", False
    found.append(word)
    cut = [regex.sub(r"[^\p{Alphabetic}\p{N}]+$", "", w) for w in found]
    return [w for w in cut if w]
