"""Concatenate-and-cut packing: all documents as one token stream, cut at fixed windows.

Pass one tokenises every text once, writes the ids and, beside them, the running token
count inside each partition. The totals of the partitions (one number per task, the
only thing that reaches the driver) give each partition its global offset. Pass two
adds the offsets and cuts at multiples of the window; what each window received from
each document are its boundary records. Only the last sequence has padding.

A text is cut into words at ASCII white space, which no token of the word tokenizer
crosses, so each distinct word is tokenised once per worker. Null and empty texts give
the closing id alone. Repeated rows are packed each. The ids are written before they
are numbered: a lost executor cannot move a document.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import WordGenerations, slices, without

SEQUENCE = 4096
END_ID = 2

_words: dict[str, WordGenerations] = {}
_tokenizers: dict[str, object] = {}


#: Words of Latin letters and closing marks, as the tokenizer's patterns cut them: letters
#: in one pre-token, the marks in a second. Letters that become several when lowered are not.
_MARKS = ".,;:!?%*&$#|"
_PLAIN = "^[A-Za-zÀ-ÖØ-öø-įı-ɏ]+[.,;:!?%*&$#|]*$"
_LINE = 500


def _plain_pieces(words: pa.Array) -> np.ndarray:
    """How many pre-tokens a word of letters and closing marks has; 0 for other words."""
    core = pc.binary_length(pc.ascii_rtrim(words, characters=_MARKS))
    marked = pc.not_equal(core, pc.binary_length(words)).to_numpy(zero_copy_only=False)
    plain = pc.match_substring_regex(words, _PLAIN).to_numpy(zero_copy_only=False)
    return np.where(plain, 1 + marked, 0)


def encoder(path: str):
    """Texts to their ids, each closed by an end id; words are remembered by this worker.

    Returns all ids one after the other (unsigned 32-bit) and how many each text has.
    """
    # Spark runs a worker on every core; threads of their own only wait for each other.
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    if path not in _tokenizers:
        tokenizer = Tokenizer.from_file(path)
        ends = np.zeros(max(tokenizer.get_vocab().values()) + 1, bool)
        for token, at in tokenizer.get_vocab().items():
            ends[at] = token.endswith("</w>")
        _tokenizers[path] = tokenizer, ends
        _words[path] = WordGenerations()
    (tokenizer, ends), known = _tokenizers[path], _words[path]

    def encoded(words: list[str]) -> list[list[int]]:
        return [e.ids for e in tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def learn(texts: list[str]) -> None:
        pieces = _plain_pieces(pa.array(texts, pa.string()))
        alone = np.flatnonzero(pieces == 0).tolist()
        # Plain words are encoded many to a line; a line's ids are dealt out again by
        # the ids that close a pre-token.
        plain = np.flatnonzero(pieces > 0)
        lines = [plain[a : a + _LINE] for a in range(0, len(plain), _LINE)]
        for line, ids in zip(
            lines, encoded([" ".join([texts[i] for i in at.tolist()]) for at in lines]), strict=True
        ):
            stops = np.flatnonzero(ends[ids]) + 1
            due = np.cumsum(pieces[line])
            if len(stops) != due[-1]:
                alone += line.tolist()
                continue
            data, cuts = np.array(ids, "<u4").tobytes(), (4 * stops[due - 1]).tolist()
            known.grow(
                [texts[i] for i in line.tolist()],
                [data[a:b] for a, b in zip([0, *cuts], cuts, strict=False)],
            )
        known.grow(
            [texts[i] for i in alone],
            [np.array(x, "<u4").tobytes() for x in encoded([texts[i] for i in alone])],
        )

    def encode(texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        words = split.flatten().dictionary_encode()
        distinct = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        new = known.missing(distinct)
        for a in range(0, len(new), 20_000):
            learn(new[a : a + 20_000])
        held = [*known.values(distinct), np.array([end_id], "<u4").tobytes()]
        known.make_room()
        # A text is its words and the end id; Arrow copies their ids one after the other.
        stops = split.offsets.to_numpy()[1:] - split.offsets[0].as_py()
        codes = np.insert(words.indices.to_numpy(), stops, len(distinct))
        ids = pa.array(held, pa.binary()).take(pa.array(codes))
        bounds = np.frombuffer(ids.buffers()[1], np.int32)[: len(codes) + 1] // 4
        n = np.diff(bounds[stops + np.arange(1, len(stops) + 1)], prepend=0)
        return np.frombuffer(ids.buffers()[2], "<u4")[: int(bounds[-1])], n.astype(np.int64)

    return encode


def consecutive(ids: np.ndarray, n: np.ndarray) -> pa.Array:
    """Binary values of ``n`` unsigned 32-bit ids each, one after the other in ``ids``."""
    bounds = np.r_[0, 4 * np.cumsum(n)].astype(np.int32)
    return pa.Array.from_buffers(
        pa.binary(), len(n), [None, pa.py_buffer(bounds), pa.py_buffer(ids)]
    )


def tokenized(docs: DataFrame, path: str, key: str, text: str, end_id: int = END_ID) -> DataFrame:
    """Written table (part, start, key, n, ids): ids as bytes, start within its part."""
    schema = docs.select(F.col(key)).schema
    kind = docs.schema[key].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, done, part = encoder(path), 0, TaskContext.get().partitionId()
        for rows in slices(batches, text):
            ids, n = run(rows.column(text), end_id)
            start = done + np.cumsum(n) - n
            done += int(n.sum())
            yield pa.record_batch(
                [
                    pa.array(np.full(len(n), part, np.int64)),
                    pa.array(start),
                    rows.column(key),
                    pa.array(n),
                    consecutive(ids, n),
                ],
                ["part", "start", key, "n", "ids"],
            )

    out = f"part long, start long, `{schema[0].name}` {kind}, n long, ids binary"
    rows = docs.select(F.col(key), F.col(text))
    return materialize(rows.mapInArrow(encode, out), "packing_ids")


def pack(
    docs: DataFrame,
    path: str,
    key: str = "doc_id",
    text: str = "text",
    length: int = SEQUENCE,
    end_id: int = END_ID,
) -> DataFrame:
    """One row per piece: key, start, length, ids, doc_tokens, sequence_id, offset.

    ``ids`` are little-endian unsigned 32-bit. ``start`` counts the document's ids
    before the piece, ``offset`` the ids before it in its sequence. A document without
    a row in ``docs`` has no piece; an empty table gives none.
    """
    held = tokenized(docs, path, key, text, end_id)
    kind = docs.schema[key].dataType.simpleString()
    totals = held.groupBy("part").agg(F.max(F.col("start") + F.col("n")).alias("n")).collect()
    at, offsets = 0, {}
    for row in sorted(totals, key=lambda r: r.part):
        offsets[row.part], at = at, at + row.n

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in slices(batches, "ids"):
            parts = rows.column("part").to_numpy()
            begin = rows.column("start").to_numpy() + [offsets[p] for p in parts.tolist()]
            n = rows.column("n").to_numpy()
            first, last = begin // length, (begin + n - 1) // length
            pieces = last - first + 1
            row = np.repeat(np.arange(len(n)), pieces)
            sequence = first[row] + np.arange(len(row)) - np.repeat(
                np.cumsum(pieces) - pieces, pieces
            )
            start = np.maximum(sequence * length, begin[row]) - begin[row]
            stop = np.minimum((sequence + 1) * length, (begin + n)[row]) - begin[row]
            held = rows.column("ids").cast(pa.binary())  # the pieces follow each other in its buffer
            first = held.offset and int(np.frombuffer(held.buffers()[1], np.int32)[held.offset])
            data = np.frombuffer(held.buffers()[2], np.uint8)[first:] if len(held) else b""
            yield pa.record_batch(
                [
                    rows.column(key).take(pa.array(row)),
                    pa.array(start),
                    pa.array(stop - start),
                    consecutive(data, stop - start),
                    pa.array(n[row]),
                    pa.array(sequence),
                    pa.array((begin[row] + start) % length),
                ],
                [key, "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
            )

    out = (
        f"`{key}` {kind}, start long, length long, ids binary, doc_tokens long,"
        " sequence_id long, offset long"
    )
    return held.mapInArrow(cut, out)


def piece_digests(pieces: DataFrame) -> DataFrame:
    """The pieces with ``ids_crc32`` in place of ``ids``."""
    return without(
        pieces.withColumn("ids_crc32", F.crc32("ids")), ["ids"]
    )


def sequences(pieces: DataFrame, key: str = "doc_id") -> DataFrame:
    """Training rows: the ids of each sequence and its boundary records.

    A sequence holds at most its window of ids, so a group here is bounded. Returns
    sequence_id, input_ids (bytes of unsigned 32-bit), n_tokens and ``boundaries``,
    an array of (offset, key, start, length) by offset.
    """
    entry = F.struct("offset", F.col(key), "start", "length", "ids")
    held = pieces.groupBy("sequence_id").agg(F.array_sort(F.collect_list(entry)).alias("held"))
    joined = F.aggregate(
        "held", F.lit(b"").cast("binary"), lambda acc, x: F.concat(acc, x["ids"])
    )
    return held.select(
        "sequence_id",
        joined.alias("input_ids"),
        F.aggregate("held", F.lit(0).cast("long"), lambda a, x: a + x["length"]).alias("n_tokens"),
        F.transform(
            "held",
            lambda x: F.struct(
                x["offset"].alias("offset"),
                x[key].alias(key),
                x["start"].alias("start"),
                x["length"].alias("length"),
            ),
        ).alias("boundaries"),
    )


