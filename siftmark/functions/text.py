"""Text analysis as Catalyst expressions: words, identifier tokens, snippets.

Segmentation follows the default Unicode word boundaries (UAX #29) with one
addition: runs of ``_ . : -`` glue the words on either side into one identifier.
The whole rule is a single Java regular expression, so tokenising never leaves
the JVM and one pass over the text finds every word.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import SNIPPET_CHARS

# The characters that join the parts of an identifier.
SEPARATORS = "_.:-"

# Word_Break property values as Java character classes (without brackets).
# Single Latin-1 characters compile to a bit table, so they lead every hot class.
_LATIN = "abcdefghijklmnopqrstuvwxyz" + "".join(c for c in map(chr, range(0xDF, 0x100)) if c != "÷")
_ASCII_DIGITS = "0123456789"
_COMMON = _LATIN + _ASCII_DIGITS
_UNSPACED = (
    r"\p{IsIdeographic}\p{IsHiragana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}"
    r"\p{IsTai_Le}\p{IsNew_Tai_Lue}\p{IsTai_Tham}\p{IsTai_Viet}\p{IsAhom}"
)
_KATAKANA = r"[[^\x00-\u2fff]&&[\p{IsKatakana}\u3031-\u3035\u30fc\uff70]]"
_LETTER = rf"{_LATIN}[\p{{IsAlphabetic}}&&[^{_UNSPACED}{_KATAKANA}\p{{M}}]]"
_DIGIT = rf"{_ASCII_DIGITS}\p{{Nd}}"
_JOIN = r"\p{Pc}\u202f"
_ALNUM = r"\p{IsAlphabetic}\p{N}"
_EXTEND = r"[\p{M}\p{Cf}&&[^\u200b]]"
_EXTEND_ONLY = r"[\p{M}\p{Cf}&&[^\u200b\p{IsAlphabetic}]]"
_ALPHA_MARK = r"\p{M}&&[\p{IsAlphabetic}]"
_SINGLE = rf"[{_ALNUM}&&[^{_LETTER}{_DIGIT}{_KATAKANA}\p{{M}}]]"

# Punctuation that stays inside a word between two letters / two digits.
_MID_LETTER = r"'.\u2018\u2019\u00b7\u2024\u2027\u055f\u05f4\u0387:\ufe13\ufe55\uff1a\ufe52\uff07\uff0e"
_MID_DIGIT = r",;'.\u2018\u2019\u2024\u037e\u0589\u060c\u060d\u066c\u07f8\u2044\ufe10\ufe14\ufe50\ufe54\uff0c\uff1b\ufe52\uff07\uff0e"

# Runs are matched forwards only: marks belong to the character before them however
# many there are, so nothing has to look back over them. Runs of common letters take
# the first branch; blanks and controls end a word before any of the costlier classes
# is tried.
_WORD_CHAR = rf"(?:[{_LETTER}{_DIGIT}{_KATAKANA}]|{_SINGLE})"
_HEBREW = r"\p{IsHebrew}&&[\p{L}]"
_OPEN = r"(?![\x00-\x20])"
_QUOTED = (
    rf"(?![\x00-\x7f])[{_HEBREW}]{_EXTEND}*+(?:\"{_EXTEND}*+(?=[{_HEBREW}])|'{_EXTEND}*+(?=[.:\-]++{_WORD_CHAR}))"
)
_LETTERS = (
    rf"(?:[{_LATIN}]|{_QUOTED}|[{_LETTER}])(?:[{_LATIN}]++|{_OPEN}(?:{_EXTEND_ONLY}*+(?:{_QUOTED}"
    rf"|[{_LETTER}[{_ALPHA_MARK}]])|{_EXTEND}*+[{_MID_LETTER}]{_EXTEND}*+(?=[{_LETTER}])))*+"
)
_DIGITS = (
    rf"[{_DIGIT}](?:[{_ASCII_DIGITS}]++|{_OPEN}(?:{_EXTEND_ONLY}*+[{_DIGIT}[{_ALPHA_MARK}]]"
    rf"|{_EXTEND}*+[{_MID_DIGIT}]{_EXTEND}*+[{_DIGIT}]))*+"
)
_RUN = rf"(?>(?:{_LETTERS}|{_DIGITS})(?:{_OPEN}{_EXTEND_ONLY}*+(?:{_LETTERS}|{_DIGITS}))*+)"
_KATAKANA_RUN = rf"[{_KATAKANA}](?:{_EXTEND_ONLY}*+[{_KATAKANA}[{_ALPHA_MARK}]])*+"
_LONE = rf"{_SINGLE}(?:{_EXTEND_ONLY}*+[{_ALPHA_MARK}])*+"
_JOINER = rf"[{_JOIN}]"
_GLUE = rf"[{_JOIN}.:\-]"
_SPACED = rf"(?:{_RUN}|{_KATAKANA_RUN})"
_START = rf"[{_LETTER}{_DIGIT}{_KATAKANA}]"

_GLUE_RUN = rf"(?:{_JOINER}{_EXTEND}*+|[.:\-])++"

# An underscore belongs to a spaced script's letter beside it, so it does not glue
# that letter to one of an unspaced script.
_AFTER_SPACED = rf"{_OPEN}{_EXTEND}*+(?!_++{_EXTEND}*+{_SINGLE}){_GLUE_RUN}(?={_START}|{_SINGLE})"
_AFTER_LONE = rf"{_OPEN}{_EXTEND}*+(?!_++{_EXTEND}*+{_START}){_GLUE}++(?={_START}|{_SINGLE})"

# Common letters, then (after marks that would need a letter or digit behind them) a blank,
# the end or ASCII that joins nothing: they are a word whatever the rest of the rule says.
_PLAIN_WORD = rf"[{_LATIN}]++(?=[.:'\-]*+(?:[\x00-\x20!-&(-,/;-@\[-\^`{{-\x7f]|\z))"

# Every quantifier is possessive: matching is linear in the text. Most words are plain, or
# have no glue behind them and end in the second branch.
WORD_PATTERN = (
    rf"(?:{_PLAIN_WORD}|(?=[0-9_a-z[^\x00-\x7f]])(?:{_RUN}(?!{_OPEN}{_EXTEND}*+{_GLUE})"
    rf"|(?:(?={_JOINER})(?<!{_JOINER})(?:{_JOINER}{_EXTEND}*+)++(?={_START}))?+"
    rf"(?:{_SPACED}{_AFTER_SPACED}|{_LONE}{_AFTER_LONE})*+(?:{_SPACED}|{_LONE})))"
)
# A separator after the first letter or digit; words always end in one.
INTERNAL_SEPARATOR = rf"[^{_JOIN}][{SEPARATORS}]"
_MAYBE_IDENTIFIER = r"[_.:\-]\S"
ALL_ALPHABETIC = r"^\p{IsAlphabetic}++$"
# Stands before tokens that are not stemmed; no token contains it.
VERBATIM = "\x00"


def _column(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def words(text: Column | str) -> Column:
    """Lower-cased identifier-aware words, in text order, duplicates kept."""
    return F.regexp_extract_all(F.lower(_column(text)), F.lit(WORD_PATTERN), F.lit(0))


def has_internal_separator(word: Column) -> Column:
    return word.rlike(INTERNAL_SEPARATOR)


def identifier_parts(word: Column) -> Column:
    """Non-empty pieces of an identifier between its separators."""
    return F.filter(F.split(word, f"[{SEPARATORS}]+"), lambda part: part != "")


def all_alphabetic(word: Column) -> Column:
    return word.rlike(ALL_ALPHABETIC)


def mark_verbatim(found: Column) -> Column:
    """Mark the tokens of an array that must not be stemmed.

    What is alphabetic is decided here, for index and query alike: workers need no
    Unicode tables of their own.
    """
    return F.transform(
        found, lambda t: F.when(all_alphabetic(t), t).otherwise(F.concat(F.lit(VERBATIM), t))
    )


def tokens(text: Column | str) -> Column:
    """Unstemmed token stream: each word, then its parts if it is an identifier."""
    text = _column(text)

    def expand(plain: Column) -> Column:
        with_parts = F.flatten(
            F.transform(
                plain,
                lambda w: F.when(
                    has_internal_separator(w), F.concat(F.array(w), identifier_parts(w))
                ).otherwise(F.array(w)),
            )
        )
        # Most texts hold no identifier, which one quick look over the text settles.
        return F.when(text.rlike(_MAYBE_IDENTIFIER), with_parts).otherwise(plain)

    # Binding through a one-element array evaluates the pattern once.
    return F.transform(F.array(words(text)), expand)[0]


def snippet(text: Column | str, limit: int = SNIPPET_CHARS) -> Column:
    """First ``limit`` code points, with an ellipsis iff something was cut."""
    text = _column(text)
    return F.when(
        F.char_length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("…"))
    ).otherwise(text)


def heading_line(heading_path: Column | str) -> Column:
    return F.array_join(_column(heading_path), " > ")


def indexable_text(heading_path: Column | str, text: Column | str) -> Column:
    """What the embedder sees: the heading trail, a newline, the chunk text."""
    heading_path, text = _column(heading_path), _column(text)
    return F.when(F.size(heading_path) == 0, text).otherwise(
        F.concat(heading_line(heading_path), F.lit("\n"), text)
    )


def contains_phrase(text: Column | str, phrase: str) -> Column:
    """Case-insensitive verbatim containment."""
    return F.contains(F.lower(_column(text)), F.lower(F.lit(phrase)))


def text_hash(text: Column | str) -> Column:
    return F.sha2(F.encode(_column(text), "UTF-8"), 256)
