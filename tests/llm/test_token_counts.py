"""Token counts against the tokenizer library."""

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from siftmark.llm.token_counts import LONG, RankMerger, _counter, count_tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(PATH)
    return lambda texts: [
        len(e.ids) for e in tokenizer.encode_batch(texts, add_special_tokens=False)
    ]


def test_counts_equal_the_library(library):
    pick = random.Random(5)
    letters = [chr(c) for c in [*range(32, 0x500), *range(0x4E00, 0x4E40), *range(0x2000, 0x2030)]]
    texts = ["".join(pick.choices(letters, k=pick.randrange(80))) for _ in range(400)]
    texts += ["".join(pick.choices(" \n\t\xa0ab.'s1", k=pick.randrange(60))) for _ in range(400)]
    texts += ["", " ", "a<|endoftext|> b<|endoftext|>", "\x1c x\x1dy", "aaaaaaa" * 9, "we'll I'M"]
    assert _counter(PATH)(texts) == library(texts)


def test_long_pre_tokens_equal_the_library(library):
    pick = random.Random(6)
    texts = ["a" * (3 * LONG), "ab" * LONG, "".join(pick.choices("abcdef", k=5 * LONG)), " " * 2000]
    assert _counter(PATH)(texts) == library(texts)


def test_both_ways_of_merging_agree():
    merger, pick = RankMerger(PATH), random.Random(7)
    pieces = ["".join(pick.choices("theindo", k=pick.randrange(2, 90))).encode() for _ in range(200)]
    assert merger.count(pieces).tolist() == [merger._by_rank(p) for p in pieces]


def test_odd_rows(odd_docs, no_docs, library):
    rows = count_tokens(odd_docs, PATH).collect()
    assert len(rows) == 9
    for row in rows:
        assert row.n_bytes == len((row.text or "").encode())
        assert row.n_tokens == library([row.text or ""])[0]
        assert row.over_limit == (row.n_tokens > 1024)
    assert count_tokens(no_docs, PATH).count() == 0
