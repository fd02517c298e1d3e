"""Dense global numbering without funnelling the data through one task."""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass
from functools import reduce
from itertools import accumulate
from operator import or_

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import local_rows, materialize, partitions_for

_POS = "_pos"
_SLAB = "_slab"
_PARTS_PER_SLAB = 16
_PART_SHIFT = 33  # documented layout of monotonically_increasing_id
_ROW_MASK = (1 << _PART_SHIFT) - 1

# A list cut to at most this many rows may be numbered by one plain window.
WINDOW_ROWS = 200_000
# A top-k may merge this many rows (k of every task) in one task.
MERGED_ROWS = 10_000_000
# Ids of a lookup become filters of this many values each, which the parquet reader
# tests one by one instead of by their span.
_IN_GROUP = 10
# Wanted rows beyond this many (16 bytes each) are joined without a broadcast.
_BROADCAST_ROWS = 100_000
_ROWS_PER_RANGE = 1_000


@dataclass(frozen=True)
class NumberedTable:
    """A written table whose rows carry positions, plus the per-partition offsets.

    ``offsets`` has one ``(partition, first id, rows)`` entry per written
    partition, so it is bounded by the task count and never grows with the rows.
    ``zones`` has the least and largest value of a key of each partition, if one was named.
    """

    staged: DataFrame
    offsets: tuple[tuple[int, int, int], ...]
    id_name: str
    zones: tuple[tuple[str, str], ...] = ()

    @property
    def count(self) -> int:
        return sum(rows for _, _, rows in self.offsets)

    def rows(self) -> DataFrame:
        """All rows with their dense ids; the offsets join is a tiny broadcast."""
        return self._number(self.staged)

    def lookup(self, ids: list[int]) -> DataFrame:
        """Rows of the given ids, through a filter the parquet reader can push down."""
        firsts = [first for _, first, _ in self.offsets]
        positions, slabs = [], set()
        for row_id in sorted(i for i in set(ids) if 0 <= i < self.count):
            part, first, _ = self.offsets[bisect_right(firsts, row_id) - 1]
            positions.append((part << _PART_SHIFT) + row_id - first)
            slabs.add(part // _PARTS_PER_SLAB)
        groups = [positions[i : i + _IN_GROUP] for i in range(0, len(positions), _IN_GROUP)]
        wanted = reduce(or_, [F.col(_POS).isin(g) for g in groups], F.lit(False))
        return self._number(self.staged.where(F.col(_SLAB).isin(sorted(slabs)) & wanted))

    def around(self, key: str) -> DataFrame:
        """Rows of the slabs with a partition whose zone holds ``key``, all if none are known."""
        if not self.zones:
            return self.rows()
        slabs = {
            part // _PARTS_PER_SLAB
            for (part, _, _), (low, high) in zip(self.offsets, self.zones, strict=True)
            if low is not None and low <= key <= high
        }
        return self._number(self.staged.where(F.col(_SLAB).isin(sorted(slabs))))

    def fetch(self, wanted: DataFrame, key: str, at_most: int) -> DataFrame:
        """``wanted`` with the columns of the rows whose id is in its column ``key``.

        The ids become (slab, position) pairs by the offsets, so that dynamic partition
        pruning opens only the slabs that hold them, however many they are. ``at_most``
        bounds the rows of ``wanted``.
        """
        offsets = local_rows(
            self.staged.sparkSession,
            _part=pa.array([part for part, _, _ in self.offsets], pa.int64()),
            _first=pa.array([first for _, first, _ in self.offsets], pa.int64()),
            _stop=pa.array([first + rows for _, first, rows in self.offsets], pa.int64()),
        )
        within = (F.col(key) >= F.col("_first")) & (F.col(key) < F.col("_stop"))
        # One offset per task and ``at_most`` rows: both sides are bounded.
        placed = wanted.where(F.col(key) >= 0).join(F.broadcast(offsets), within)
        position = F.shiftleft("_part", _PART_SHIFT) + F.col(key) - F.col("_first")
        placed = placed.select(
            *wanted.columns,
            F.floor(F.col("_part") / _PARTS_PER_SLAB).cast("int").alias(_SLAB),
            position.alias(_POS),
        )
        side = F.broadcast(placed) if at_most <= _BROADCAST_ROWS else placed
        return self.staged.join(side, [_SLAB, _POS]).drop(_SLAB, _POS)

    def _number(self, staged: DataFrame) -> DataFrame:
        offsets = local_rows(
            staged.sparkSession,
            _part=pa.array([part for part, _, _ in self.offsets], pa.int32()),
            _first=pa.array([first for _, first, _ in self.offsets], pa.int64()),
        )
        row_id = F.col("_first") + F.col(_POS).bitwiseAND(F.lit(_ROW_MASK))
        columns = [c for c in staged.columns if c not in (_POS, _SLAB)]
        part = F.shiftright(_POS, _PART_SHIFT).cast("int")
        return (
            staged.withColumn("_part", part)
            .join(F.broadcast(offsets), "_part")
            .select(row_id.alias(self.id_name), *columns)
        )


def range_partition(
    df: DataFrame, key: Column, ties: list[str], total: int | None = None
) -> DataFrame:
    """Range-partition rows by a string key and sort each partition.

    Equal keys are told apart by a hash of the ``ties``, so a frequent key spans
    several ranges, and a row's place follows from its contents alone.
    """
    total = df.count() if total is None else total
    parts = partitions_for(df.sparkSession, total, _ROWS_PER_RANGE)
    tie = F.xxhash64(*ties) if ties else F.lit(0).cast("long")
    keyed = df.withColumn("_key", key).withColumn("_tie", tie)
    order = ["_key", "_tie"]
    ranged = keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order, *ties)
    return ranged.drop(*order)


def number_in_place(
    ordered: DataFrame, id_name: str, name: str, zone: Column | None = None
) -> NumberedTable:
    """Number the rows of a DataFrame whose partitions are already in global order.

    The written table is foldered by slabs of neighbouring partitions, so a lookup
    opens only the slabs that can hold its ids. ``zone`` is a string key to keep the
    range of for each partition.
    """
    part = F.shiftright(_POS, _PART_SHIFT)
    staged = materialize(
        ordered.withColumn(_POS, F.monotonically_increasing_id()).withColumn(
            _SLAB, F.floor(part / _PARTS_PER_SLAB).cast("int")
        ).sortWithinPartitions(_SLAB, _POS),
        name,
        partition_by=_SLAB,
    )
    counted = (
        staged.groupBy(F.shiftright(_POS, _PART_SHIFT).cast("int").alias("_part"))
        .agg(
            F.count("*").alias("n"),
            *[] if zone is None else [F.min(zone).alias("low"), F.max(zone).alias("high")],
        )
        .orderBy("_part")
        .collect()
    )
    firsts = [0, *accumulate(row.n for row in counted)]
    offsets = tuple((row._part, first, row.n) for row, first in zip(counted, firsts))
    zones = () if zone is None else tuple((row.low, row.high) for row in counted)
    return NumberedTable(staged, offsets, id_name, zones)


def first_rows(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows in the total order ``order``.

    A usual ``k`` is a per-task top-k and one small merge. As that merge holds ``k``
    rows of every task, a very large ``k`` is numbered in parallel instead.
    """
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if k * tasks <= MERGED_ROWS:
        return df.orderBy(*order).limit(k)
    return with_rank(df, order, "_rank", None).where(F.col("_rank") <= k).drop("_rank")


def with_rank(df: DataFrame, order: list[Column], rank: str, at_most: int | None) -> DataFrame:
    """Add the 1-based position of every row in the total order ``order``.

    ``at_most`` is the row bound the caller has already imposed by a limit. Small
    lists take one window; anything larger, or unbounded, is range-partitioned.
    """
    if at_most is not None and at_most <= WINDOW_ROWS:
        position = F.row_number().over(Window.orderBy(*order)).cast("long")
        return df.withColumn(rank, position)
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order)
    numbered = number_in_place(ordered, rank, "ranked")
    return numbered.rows().withColumn(rank, F.col(rank) + 1)
