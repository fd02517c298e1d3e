"""Packing by exact round trip."""

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from siftmark.llm.common import WordGenerations
from siftmark.llm.packing import END_ID, encoder, pack, piece_digests, sequences

PATH = public_tokenizers.path("word_bpe_49k.json")


def ids_of(texts):
    found = Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)
    return [[*e.ids, END_ID] for e in found]


def test_words_encode_as_the_library_does():
    texts = ["The don't <|endoftext|>x, İstanbul é ΣαΣ 12ab", "", "a\xa0b 3.5%%%"]
    for column in (pa.array(texts), pa.array(["before", *texts, "after"]).slice(1, len(texts))):
        ids, n = encoder(PATH)(column, END_ID)
        assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == ids_of(texts)


def test_word_generations():
    known = WordGenerations(100)
    for i in range(50):
        words = ["often", f"rare{i}"]
        new = known.missing(words)
        assert new == (words if i == 0 else words[1:])
        known.grow(new, [w.encode() for w in new])
        assert list(known.values(words)) == [w.encode() for w in words]
        known.make_room()
        assert len(known.young) + len(known.old) < 12


def check(docs, length):
    """Every id of every row in one piece, windows gapless and full but the last."""
    pieces = pack(docs, PATH, length=length).collect()
    rows = docs.select("doc_id", "text").collect()
    wanted = sorted(
        (repr(r.doc_id), i) for r, i in zip(rows, ids_of([r.text or "" for r in rows]), strict=True)
    )
    flow = sorted(pieces, key=lambda p: (p.sequence_id, p.offset))
    at, found = 0, []
    for p in flow:
        assert p.sequence_id * length + p.offset == at
        at += p.length
        assert p.offset + p.length <= length and p.length > 0
        own = np.frombuffer(p.ids, "<u4").tolist()
        assert len(own) == p.length
        if p.start == 0:
            found.append((repr(p.doc_id), []))
        assert p.start == len(found[-1][1])
        found[-1][1].extend(own)
    assert sorted(found) == wanted
    return pieces


def test_round_trip(spark):
    check(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), 4096)


def test_odd_rows_and_short_windows(odd_docs, no_docs):
    check(odd_docs, 64)
    assert pack(no_docs, PATH).count() == 0


def test_digests_and_sequences(spark):
    docs = spark.createDataFrame([(i, f"text number {i} of a few") for i in range(40)], "doc_id long, text string")
    pieces = pack(docs, PATH, length=32)
    sums = {(r.doc_id, r.start): r.ids_crc32 for r in piece_digests(pieces).collect()}
    rows = pieces.collect()
    assert sums == {(r.doc_id, r.start): zlib.crc32(r.ids) for r in rows}
    packed = sequences(pieces).collect()
    for s in packed:
        assert len(s.input_ids) == 4 * s.n_tokens
        for b in s.boundaries:
            own = next(r for r in rows if (r.doc_id, r.start) == (b.doc_id, b.start))
            assert bytes(s.input_ids[4 * b.offset : 4 * (b.offset + b.length)]) == bytes(own.ids)
    assert sorted(s.n_tokens for s in packed)[1:] == [32] * (len(packed) - 1)


def test_steps_give_freed_memory_back(monkeypatch):
    import pyarrow as pa

    from siftmark.llm import common

    pool, released = pa.default_memory_pool(), []

    class Pool:
        def release_unused(self):
            released.append(pool.bytes_allocated())

    monkeypatch.setattr(common.pa, "default_memory_pool", Pool)
    batch = pa.record_batch([pa.array(["x" * 100] * 10)], ["t"])
    parts = list(common.slices([batch], "t", 300))
    assert pa.Table.from_batches(parts).num_rows == 10
    assert len(released) == len(parts) > 1
