"""Exact cosine top-k over vectors laid out by clusters.

Every vector belongs to its nearest centre and to a shell of that cell, by its distance
from the centre. A small table keeps the least and largest distance of each shell, so the
triangle inequality bounds the score of all its vectors, and a query opens a shell's
folder only if that bound can reach its k-th best score. The centres are fitted on a
bounded sample; they decide how much is skipped, never what is found.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..schemas import RANKED
from ..session import materialize, table_path
from .dense import VectorIndex, _matrix, dot
from .lexical import SCORE_DIGITS, top_k

#: Vectors of a cell about, and the most cells (with their shells: folders) of an index.
CELL_VECTORS, MOST_CELLS = 20_000, 1_024
#: The centres are fitted on the vectors of the smallest hashes of their ids, at most so
#: many for each centre and so many components in all.
SAMPLE_EACH, SAMPLE_VALUES = 64, 8_000_000
SHELLS, SHELL_WIDTH = 16, 0.125
_FITS = 5
_SLACK = 1e-6  # scores are compared after rounding to nine digits


def _distances(vectors: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each vector the nearest centre and the distance from it."""
    cell = ((centres**2).sum(1) - 2 * vectors @ centres.T).argmin(1)
    return cell, np.linalg.norm(vectors - centres[cell], axis=1)


def fit_centres(vectors: np.ndarray, cells: int) -> np.ndarray:
    """A few rounds of k-means, started from vectors spread over the sample."""
    centres = vectors[np.linspace(0, len(vectors) - 1, cells).astype(int)].copy()
    for _ in range(_FITS):
        cell, _ = _distances(vectors, centres)
        for c in range(cells):
            if (cell == c).any():
                centres[c] = vectors[cell == c].mean(0)
    return centres


@dataclass(frozen=True)
class ClusteredIndex:
    """``rows`` is (chunk_id, embedding, shell), foldered by shell.

    ``shells`` has a row (shell, least distance, largest distance, largest squared norm,
    vectors) for each of at most ``SHELLS * MOST_CELLS`` shells.
    """

    rows: DataFrame
    dim: int
    centres: np.ndarray
    shells: np.ndarray

    @classmethod
    def build(
        cls, vectors: DataFrame, dim: int | None = None, cells: int | None = None
    ) -> ClusteredIndex:
        """Normalise and lay out ``vectors``; a crowded shell spans many tasks and files."""
        flat = VectorIndex.build(vectors, dim)
        seen = Observation()
        unit = materialize(flat.rows.observe(seen, F.count(F.lit(1)).alias("n")), "unit_vectors")
        return cls.of_unit(unit, flat.dim, seen.get["n"], cells)

    @classmethod
    def of_unit(
        cls, unit: DataFrame, dim: int, count: int, cells: int | None = None
    ) -> ClusteredIndex:
        """The same for ``count`` vectors that are normalised already."""
        spark, dim = unit.sparkSession, dim if count else 0
        wanted = cells or min(MOST_CELLS, count // CELL_VECTORS)
        cells = max(1, min(wanted, count))
        most = max(cells, min(cells * SAMPLE_EACH, SAMPLE_VALUES // max(dim, 1)))
        taken = unit.orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(most).select("embedding")
        sample = taken.toArrow().column("embedding").combine_chunks()
        centres = np.zeros((1, dim))
        if len(sample):
            sample = sample.chunk(0) if isinstance(sample, pa.ChunkedArray) else sample
            centres = fit_centres(_matrix(sample, dim), min(cells, len(sample)))

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                held = _matrix(batch.column("embedding"), dim)
                cell, far = _distances(held, centres)
                shell = cell * SHELLS + np.minimum(far // SHELL_WIDTH, SHELLS - 1).astype(int)
                yield pa.record_batch(
                    [
                        batch.column("chunk_id"),
                        batch.column("embedding"),
                        pa.array(far),
                        pa.array((held**2).sum(1)),
                        pa.array(shell.astype(np.int32)),
                    ],
                    ["chunk_id", "embedding", "far", "norm", "shell"],
                )

        placed = unit.select("chunk_id", "embedding").mapInArrow(
            assign, "chunk_id long, embedding array<float>, far double, norm double, shell int"
        )
        keys = ["shell", "chunk_id"]
        placed = placed.repartitionByRange(*keys).sortWithinPartitions(*keys)
        path = table_path(spark, "clustered_vectors")
        placed.write.partitionBy("shell").parquet(path)
        rows = spark.read.schema(placed.schema).parquet(path)
        measured = rows.groupBy("shell").agg(
            F.min("far"), F.max("far"), F.max("norm"), F.count("*").cast("double")
        )
        shells = np.array([tuple(r) for r in measured.orderBy("shell").collect()], float)
        return cls(rows.drop("far", "norm"), dim, centres, shells.reshape(-1, 5))

    def bounds(self, query: np.ndarray) -> np.ndarray:
        """What no vector of each shell can score more than."""
        shell, least, most, norm, _ = self.shells.T
        centres = self.centres[(shell // SHELLS).astype(int)]
        size = np.linalg.norm(query)
        by_radius = centres @ query + most * size
        if size == 0:
            return by_radius
        away = np.linalg.norm(centres - query / size, axis=1)
        apart = np.maximum(0, np.maximum(away - most, least - away))
        return np.minimum(by_radius, size * (1 + norm - apart**2) / 2)

    def _inside(self, shells: np.ndarray, query: Sequence[float], k: int) -> DataFrame:
        held = self.rows.where(F.col("shell").isin([int(s) for s in shells]))
        score = F.round(dot("embedding", query), SCORE_DIGITS)
        return top_k(held.select("chunk_id", score.alias("score")), k)

    def open_shells(self, query: Sequence[float], k: int) -> np.ndarray:
        """Shells that can hold one of the best ``k``: those of the best bounds that have
        ``k`` vectors give the threshold."""
        bound = self.bounds(np.asarray(query, float))
        order = np.argsort(-bound, kind="stable")
        held = np.cumsum(self.shells[order, 4])
        first = order[: int(np.searchsorted(held, k)) + 1]
        if len(first) == len(order):
            return self.shells[order, 0]
        found = self._inside(self.shells[first, 0], query, k)
        least = found.agg(F.count("*").alias("n"), F.min("score").alias("score")).first()
        able = bound >= (least.score - _SLACK if least.n == k else -np.inf)
        return self.shells[able, 0]

    def search(self, query: Sequence[float], k: int) -> DataFrame:
        """Best ``k`` chunks as (chunk_id, score); no threshold is applied."""
        if k <= 0 or self.dim == 0:
            return self.rows.sparkSession.createDataFrame([], RANKED)
        if len(query) != self.dim:
            raise ValueError(f"query has {len(query)} components, index has {self.dim}")
        return self._inside(self.open_shells(query, k), query, k)

    def __len__(self) -> int:
        return int(self.shells[:, 4].sum())

    def is_empty(self) -> bool:
        return len(self) == 0
