"""Best-fit packing by minimum bin slack.

Every document is tokenised once and cut into pieces that fit a sequence; the pieces
are written with their rank among the equal pieces of their partition. How the
sequences are filled depends on the lengths alone, and there are at most ``SEQUENCE``
of those, so the number of pieces of each length is all that reaches the driver.

There a sequence takes the longest piece left and, of all pieces left, the combination
that fills the rest of the sequence most: a subset-sum over the available lengths on a
bitset (a bit per sum, a shift per power of two of a length's pieces), traced back so
that long pieces are preferred. It is removed as often as the pieces suffice, as the
next sequences would be filled alike. The pieces then find their places by their rank
among all pieces of their length: the prefix sums of the counts of the partitions give
the first rank of each, by a window of one row per partition.

Null and empty texts give the closing id alone. Repeated rows are packed each. An empty
table gives no rows. The pieces are written before they are ranked: a lost executor
cannot move one.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import materialize
from .common import slices
from .packing import consecutive, encoder

SEQUENCE = 2048
END_ID = 0

_SHIFT = 48  # ranks below 2**48 and lengths below 2**15 share a long


def fullest(left: np.ndarray, room: int) -> dict[int, int]:
    """Lengths and how many of each fill ``room`` most; ``left[n]`` are available of n."""
    mask, sums, steps = (1 << (room + 1)) - 1, 1, []
    lengths = np.flatnonzero(left[: room + 1])[::-1]
    for length in lengths.tolist():
        rest, share = min(int(left[length]), room // length), 1
        while rest:
            share = min(share, rest)
            more = sums | (sums << (share * length)) & mask
            if more != sums:
                steps.append((length, share, sums))
                sums = more
            rest, share = rest - share, share * 2
        if sums >> room:
            break
    at, taken = sums.bit_length() - 1, {}
    for length, share, before in reversed(steps):
        if not before >> at & 1:
            taken[length] = taken.get(length, 0) + share
            at -= share * length
    return taken


class Plan(NamedTuple):
    """Runs of pieces of one length: the first (length, rank), the sequence and offset it
    has, and how many of one sequence follow each other."""

    first: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    each: np.ndarray
    sequences: int

    @classmethod
    def of(cls, counts: dict[int, int], capacity: int) -> Plan:
        left = np.zeros(capacity + 1, np.int64)
        for length, n in counts.items():
            left[length] = n
        used, runs, sequences = np.zeros_like(left), [], 0
        while left.any():
            longest = int(np.flatnonzero(left)[-1])
            left[longest] -= 1
            taken = fullest(left, capacity - longest)
            left[longest] += 1
            taken[longest] = taken.get(longest, 0) + 1
            times = min(int(left[n]) // each for n, each in taken.items())
            offset = 0
            for n, each in sorted(taken.items(), reverse=True):
                runs.append(((n << _SHIFT) + int(used[n]), sequences, offset, each))
                offset += n * each
                used[n] += each * times
                left[n] -= each * times
            sequences += times
        columns = np.array(sorted(runs), np.int64).reshape(-1, 4).T
        return cls(*columns, sequences)

    def places(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """sequence_id and offset of the pieces of these lengths and ranks."""
        if not len(length):
            return rank, rank
        key = (length << _SHIFT) + rank
        run = np.searchsorted(self.first, key, "right") - 1
        more, within = np.divmod(key - self.first[run], self.each[run])
        return self.sequence[run] + more, self.offset[run] + within * length


def cut_pieces(
    docs: DataFrame, path: str, key: str, text: str, length: int, end_id: int
) -> DataFrame:
    """Written table (part, rank, key, piece, length, ids): rank within its part and length."""
    field = docs.select(F.col(key)).schema[0]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(path), TaskContext.get().partitionId()
        before = np.zeros(length + 1, np.int64)
        for rows in slices(batches, text):
            ids, n = encode(rows.column(text), end_id)
            pieces = -(-n // length)
            row = np.repeat(np.arange(len(n)), pieces)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            size = np.minimum(n[row] - piece * length, length)
            order = np.argsort(size, kind="stable")
            counts = np.bincount(size, minlength=length + 1)
            rank = np.empty(len(size), np.int64)
            rank[order] = np.arange(len(size)) - np.repeat(np.cumsum(counts) - counts, counts)
            rank += before[size]
            before += counts
            yield pa.record_batch(
                [
                    pa.array(np.full(len(size), part, np.int64)),
                    pa.array(rank),
                    rows.column(key).take(pa.array(row)),
                    pa.array(piece.astype(np.int32)),
                    pa.array(size),
                    consecutive(ids, size),
                ],
                ["part", "rank", key, "piece", "length", "ids"],
            )

    kind = field.dataType.simpleString()
    out = f"part long, rank long, `{field.name}` {kind}, piece int, length long, ids binary"
    rows = docs.select(F.col(key), F.col(text))
    return materialize(rows.mapInArrow(cut, out), "slack_pieces")


def pack_tightly(
    docs: DataFrame,
    path: str,
    key: str = "doc_id",
    text: str = "text",
    length: int = SEQUENCE,
    end_id: int = END_ID,
) -> DataFrame:
    """One row per piece: key, piece, start, length, ids, sequence_id, offset.

    ``ids`` are little-endian unsigned 32-bit; only documents of more than ``length``
    ids have several pieces. The pieces of a sequence follow each other from offset 0.
    """
    pieces = cut_pieces(docs, path, key, text, length, end_id)
    counted = materialize(
        pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "slack_counts"
    )
    totals = counted.groupBy("length").agg(F.sum("n").alias("n")).collect()  # a row per length
    plan = Plan.of({r.length: r.n for r in totals}, length)

    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counted.select(
        "part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")
    )

    @F.arrow_udf("sequence_id long, offset long")
    def place(size: pa.Array, rank: pa.Array) -> pa.Array:
        found = plan.places(size.to_numpy(), rank.to_numpy())
        return pa.StructArray.from_arrays([pa.array(x) for x in found], ["sequence_id", "offset"])

    placed = pieces.join(firsts, ["part", "length"]).withColumn(
        "_at", place("length", F.col("first") + F.col("rank"))
    )
    return placed.select(
        F.col(key),
        "piece",
        (F.col("piece").cast("long") * length).alias("start"),
        "length",
        "ids",
        "_at.sequence_id",
        "_at.offset",
    )
