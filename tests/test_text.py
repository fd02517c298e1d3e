"""Words, identifiers, stemming, snippets."""

import random

import hypothesis.strategies as st
import pyarrow as pa
import pytest
import reference_words
from hypothesis import given, settings
from pyspark.sql import functions as F

from siftmark.functions import text as X
from siftmark.functions.text import VERBATIM
from siftmark.functions.stemming import stem, stem_token, stem_values
from siftmark.operators.lexical import query_terms
from siftmark.session import local_rows

WORD_CASES = {
    "tokio::spawn": ["tokio::spawn", "tokio", "spawn"],
    "call my_var.": ["call", "my_var", "my", "var"],
    "...": [],
    "": [],
    "__init__": ["__init"],
    "_foo": ["_foo"],
    "::foo -x .5": ["foo", "x", "5"],
    "don't pay 3,000": ["don't", "pay", "3,000"],
    "C++ and C#": ["c", "and", "c"],
    "a.b.c-d": ["a.b.c-d", "a", "b", "c", "d"],
    "日本語 text": ["日", "本", "語", "text"],
    "日_本": ["日_本", "日", "本"],
    "日_b": ["日", "_b"],
    "b_日": ["b", "日"],
    "カタカナ a": ["カタカナ", "a"],
    "m²": ["m", "²"],
    "café x": ["cafe", "x"],
    "İstanbul": ["i̇stanbul"],
}


def column(spark, values, expr):
    rows = local_rows(spark, i=list(range(len(values))), t=pa.array(values, pa.string()))
    return [r.v for r in rows.select("i", expr("t").alias("v")).orderBy("i").collect()]


def test_token_cases(spark):
    found = column(spark, list(WORD_CASES), X.tokens)
    assert dict(zip(WORD_CASES, found)) == WORD_CASES


# Alphabet without marks next to mid-word punctuation, where the checker's own
# boundary rules differ from the standard.
_ATOMS = list("aBzé1 9__..:-,;\n\t\"") + [
    "日", "本", "ひ", "カ", "ー", "ก", "א", "ב", "²",
    "½", "Ⅷ", "한", "ⓐ", "\U0001f600", "१", "Σ", "ß",
]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(st.sampled_from(_ATOMS), max_size=14), min_size=40, max_size=80))
def test_words_match_brute_force_segments(spark, texts):
    lowered = column(spark, texts, F.lower)
    assert column(spark, texts, X.words) == [reference_words.words(t) for t in lowered]


def test_marks_and_hebrew_quotes_match_icu(spark):
    """Any number of marks around mid-word characters, against the JVM's ICU."""
    rng = random.Random(4)
    letters, points = list("aB19éאבשカ²") + ["日"], list("..:-,;'\" _")

    def marked():
        c = rng.choice(letters + points)
        marks = ["\u0301", "\u0308"] + ["\u05b0"] * (c in letters and c != "²")
        return c + "".join(rng.choices(marks, k=rng.choice([0, 0, 0, 1, 2, 3, 4])) * (c != "_"))

    texts = ["".join(marked() for _ in range(rng.randrange(1, 10))) for _ in range(1500)]
    for before, after in (("a", "b"), ("א", "ב"), ("1", "2"), ("中", "x"), ("中", "文")):
        for mid in "',._\"":
            texts += [
                before + "\u0301" * i + mid + "\u0301" * (j * (mid != "_")) + after
                for i in range(6)
                for j in range(6)
            ]
    texts += ["א'.a", "א'", "א'_x", "א'\u0301-9", "א\"ב"]
    cut = reference_words.icu_segments(spark)
    lowered = column(spark, texts, F.lower)
    assert column(spark, texts, X.words) == [reference_words.words(t, cut) for t in lowered]


def test_words_match_brute_force_on_given_text(spark):
    for name, col in (("documents", "text"), ("pages", "html"), ("conversations", "text")):
        rows = spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet")
        for row in rows.select(X.words(col).alias("w"), F.lower(col).alias("t")).collect():
            assert row.w == reference_words.words(row.t)


def test_long_runs_stay_linear(spark):
    text = "a" + "_" * 300_000 + " b " + "._-" * 100_000 + "x" + "́" * 100_000
    assert column(spark, [text], X.words)[0][:2] == ["a", "b"]


STEMS = """
running run  quickly quick  indexed index  consigned consign  consistency consist
consolation consol  conspiracy conspiraci  knackeries knackeri  knightly knight
generously generous  generalization general  communication communic  hoping hope
hopping hop  skies sky  dying die  cries cri  ties tie  by by  say say  gas gas
this this  kiwis kiwi  abilities abil  relational relat  conditional condit
rational ration  digitizer digit  operator oper  feudalism feudal  hopefulness hope
sensibiliti sensibl  triplicate triplic  formative format  electrical electr
allowance allow  replacement replac  adoption adopt  probate probat  controlling control
agreed agre  feed feed  plastered plaster  sing sing  troubled troubl  sized size
falling fall  hissing hiss  failing fail  filing file  happy happi  proceed proceed
news news  abyss abyss  geology geolog  carelessly careless  bed bed  yes yes
"""


def test_stems_of_the_published_vocabulary():
    words = STEMS.split()
    for word, expected in zip(words[::2], words[1::2]):
        assert stem(word) == expected, word


def test_only_alphabetic_tokens_are_stemmed(spark):
    found = column(spark, ["hunting foxes2 a_b::running", "été şàngings"], lambda c: X.mark_verbatim(X.tokens(c)))
    assert [t.startswith(VERBATIM) for t in found[0]] == [False, True, True, False, False, False]
    assert stem_values(pa.array(found[0])).to_pylist() == [
        "hunt", "foxes2", "a_b::running", "a", "b", "run",
    ]
    assert not any(t.startswith(VERBATIM) for t in found[1])
    assert stem_token(VERBATIM + "hunting") == "hunting"
    assert query_terms(spark, "Hunting my_foxes hunt") == {"hunt": 2, "my_foxes": 1, "my": 1, "fox": 1}


@given(st.text("abcdefghilmnoprstuvyz", min_size=1, max_size=12))
def test_stem_never_grows_much_or_vanishes(word):
    assert 0 < len(stem(word)) <= len(word) + 1


def test_predicates_and_parts(spark):
    words = ["a_b", "_a", "a.b-c", "x", "x1", "été"]
    assert column(spark, words, lambda c: X.has_internal_separator(F.col(c))) == [
        True, False, True, False, False, False,
    ]
    assert column(spark, words, lambda c: X.all_alphabetic(F.col(c))) == [
        False, False, False, True, False, True,
    ]
    assert column(spark, words, lambda c: X.identifier_parts(F.col(c)))[2] == ["a", "b", "c"]


def test_snippet_counts_code_points(spark):
    long, emoji = "é" * 405, "\U0001f600" * 401
    found = column(spark, ["short", long, emoji, "x" * 400], X.snippet)
    assert found[0] == "short" and found[3] == "x" * 400
    assert len(found[1]) == 401 and found[1].endswith("…")
    assert found[2] == "\U0001f600" * 400 + "…"


def test_indexable_text(spark):
    rows = spark.createDataFrame(
        [([], "t"), (["A"], "t"), (["A", "B"], "t")], "h array<string>, t string"
    )
    found = [r.v for r in rows.select(X.indexable_text("h", "t").alias("v")).collect()]
    assert found == ["t", "A\nt", "A > B\nt"]


@pytest.mark.parametrize(
    ("text", "phrase", "expected"),
    [("The  End", "the end", False), ("THE END", "the end", True), ("ÉTÉ", "ét", True)],
)
def test_phrase_is_verbatim_but_caseless(spark, text, phrase, expected):
    assert column(spark, [text], lambda c: X.contains_phrase(c, phrase)) == [expected]
