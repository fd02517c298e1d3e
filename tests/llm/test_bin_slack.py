"""Tight packing by exact round trip, against exhaustive filling and lower bounds."""

import random
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from siftmark.llm import bin_slack
from siftmark.llm.bin_slack import END_ID, Plan, fullest, pack_tightly

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_fullest_is_the_best_of_all_combinations():
    draw = random.Random(4)
    for _ in range(200):
        pieces = [draw.randrange(1, 30) for _ in range(draw.randrange(0, 9))]
        room = draw.randrange(0, 60)
        left = np.zeros(100, np.int64)
        for p in pieces:
            left[p] += 1
        taken = fullest(left, room)
        assert all(left[n] >= each > 0 for n, each in taken.items())
        most = max(
            s
            for k in range(len(pieces) + 1)
            for c in combinations(pieces, k)
            if (s := sum(c)) <= room
        )
        assert sum(n * each for n, each in taken.items()) == most


def first_fit(pieces, capacity):
    rooms = []
    for piece in pieces:
        for i, room in enumerate(rooms):
            if piece <= room:
                rooms[i] -= piece
                break
        else:
            rooms.append(capacity - piece)
    return len(rooms)


def test_plan_places_every_piece_once():
    draw = random.Random(5)
    counts = {draw.randrange(1, 65): draw.randrange(1, 400) for _ in range(40)}
    plan = Plan.of(counts, 64)
    filled = {}
    for length, n in counts.items():
        sequence, offset = plan.places(np.full(n, length), np.arange(n))
        for s, o in zip(sequence.tolist(), offset.tolist(), strict=True):
            filled.setdefault(s, []).append((o, length))
    assert sorted(filled) == list(range(plan.sequences))
    for held in filled.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 64
    decreasing = sorted((n for length, k in counts.items() for n in [length] * k), reverse=True)
    assert plan.sequences <= first_fit(decreasing, 64)


def check(docs, length):
    pieces = pack_tightly(docs, PATH, length=length).collect()
    rows = docs.select("doc_id", "text").collect()
    encoded = Tokenizer.from_file(PATH).encode_batch([r.text or "" for r in rows], add_special_tokens=False)
    wanted = []
    for row, e in zip(rows, encoded, strict=True):
        ids = [*e.ids, END_ID]
        wanted += [
            (repr(row.doc_id), a // length, a, ids[a : a + length]) for a in range(0, len(ids), length)
        ]
    own = [(repr(p.doc_id), p.piece, p.start, np.frombuffer(p.ids, "<u4").tolist()) for p in pieces]
    assert sorted(own) == sorted(wanted)
    filled = {}
    for p in pieces:
        assert len(p.ids) == 4 * p.length
        filled.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for held in filled.values():
        at = 0
        for offset, n in sorted(held):
            assert offset == at
            at += n
        assert at <= length
    return len(filled), sum(p.length for p in pieces)


def test_round_trip(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(5)
    sequences, tokens = check(docs, bin_slack.SEQUENCE)
    assert sequences <= -(-tokens // bin_slack.SEQUENCE) + 1


@pytest.mark.parametrize("length", [1, 64])
def test_odd_rows(odd_docs, no_docs, length):
    check(odd_docs, length)
    assert pack_tightly(no_docs, PATH, length=length).count() == 0


def test_repeated_run_gives_the_same_places(spark):
    docs = spark.createDataFrame([(i, "word " * (i % 50)) for i in range(500)], "doc_id long, text string")
    runs = [
        sorted(tuple(r) for r in pack_tightly(docs.repartition(n, "doc_id"), PATH, length=64).collect())
        for n in (3, 3)
    ]
    assert runs[0] == runs[1]
