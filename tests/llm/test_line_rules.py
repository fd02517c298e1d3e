"""Line rules against plain counting, word by word and line by line."""

import re
from collections import Counter

import pytest

from siftmark.llm import line_rules as X

WORD = re.compile(r"[^\x20\x09-\x0d]+")


def plain(text):
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    times = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    base = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return (
        len(words),
        sum(map(len, words)),
        sum(text.count(c) for c in X.SYMBOLS),
        len(lines) - len(set(lines)),
        len(covered),
        base,
    )


GOOD = """The old mill stands by the river, and its wheel has not turned for years.
Every spring a heron comes back to the weir and waits there for the first warm day.
My aunt keeps the key, so we asked her to let us look at the rooms upstairs once more.
Nobody had swept the stairs, yet the light through the small window was lovely."""


def test_measures(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    texts = [r.text for r in docs]
    texts += ["a b c d e f g h " * 3, "a " * 30, "x\x0by\x0cz\rq", "é" * 9 + " 中文", "a\nb\na\n \nb", ""]
    for text in texts:
        assert X.judge(text.encode())[:6] == plain(text)


@pytest.mark.parametrize(
    "line",
    [
        "Word%%% after*** word### and$$$ again&&& so%%%",
        "HOME!! NEWS!! SHOP!! NOW!!",
        "Home | News | Sports | Shop | About",
        "All rights reserved.",
        "Please accept cookies to go on reading this page.",
        "Menu",
    ],
)
def test_failing_lines_go(line):
    found = X.judge(f"{GOOD}\n{line}\n\nThe end of it.".encode())
    assert found[6] and found[7] == 1
    assert found[9].decode() == f"{GOOD}\n\nThe end of it."


def test_documents_that_lose_too_much_go():
    junk = "\n".join(f"w{i}%%% x{i}### y{i}$$$ z{i}&&& v{i}*** u{i}%%%" for i in range(30))
    assert not X.judge(f"{GOOD}\n{junk}".encode())[6]
    assert X.judge(GOOD.encode())[6:10] == (True, 0, 0, GOOD.encode())


def test_labelled_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = X.apply_line_rules(docs).join(labels, "doc_id").collect()
    good = [r for r in rows if r.quality == 1 and not r.base_failed]
    assert sum(r.kept for r in good) == len(good)
    poor = [r for r in rows if r.quality == 0]
    assert sum(not r.kept for r in poor) >= 0.95 * len(poor)


def test_odd_rows(odd_docs, no_docs):
    rows = X.apply_line_rules(odd_docs).collect()
    assert len(rows) == 9
    for row in rows:
        text = row.text or ""
        assert (row.n_words, row.word_chars, row.n_symbols) == plain(text)[:3]
        assert (row.n_dup_lines, row.n_repeat_words, row.base_failed) == plain(text)[3:]
        assert row.kept in (True, False) and (row.clean_text == "" or text)
    assert X.apply_line_rules(no_docs).count() == 0


def test_boilerplate_of_four_languages():
    from siftmark.llm.line_rules import line_fails

    stock = [
        "Alle Rechte vorbehalten.", "Tous droits réservés.", "TOUS DROITS RÉSERVÉS.",
        "Bitte akzeptieren Sie alle Cookies.", "Lea nuestra Política de Privacidad aquí.",
        "Subscribe to our weekly letter today.",
    ]
    prose = [
        "Alle hatten ihre Rechte und gingen nach Hause.", "Tous les droits de la ville furent vendus.",
        "El aviso llegó tarde a la casa.", "Die Kekse waren gut und alle aßen davon.",
    ]
    for line in stock:
        assert line_fails(line.encode(), line.encode().split()), line
    for line in prose:
        assert not line_fails(line.encode(), line.encode().split()), line
