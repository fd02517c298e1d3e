"""Flat cosine index: normalised vectors in a table, exact top-k by dot product."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import RANKED
from .lexical import SCORE_DIGITS, top_k


def _matrix(vectors: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column as a float64 matrix; every list must hold ``dim`` values."""
    sizes = np.diff(vectors.offsets.to_numpy())
    if vectors.null_count or (sizes != dim).any():
        raise ValueError(f"every vector must have {dim} components, found {set(sizes.tolist())}")
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(len(vectors), dim)


def l2_normalize(embedding: Column | str, dim: int) -> Column:
    """Unit-length vectors; a zero vector stays as it is, a wrong length fails."""

    @F.arrow_udf("array<float>")
    def normalize(vectors: pa.Array) -> pa.Array:
        rows = _matrix(vectors, dim)
        norms = np.linalg.norm(rows, axis=1, keepdims=True)
        unit = np.divide(rows, norms, out=rows, where=norms > 0).astype(np.float32)
        bounds = np.arange(len(rows) + 1, dtype=np.int32) * dim
        return pa.ListArray.from_arrays(bounds, pa.array(unit.ravel()))

    return normalize(embedding)


def dot(embedding: Column | str, query: Sequence[float]) -> Column:
    """Dot product with a fixed vector, one matrix product per Arrow batch."""
    fixed = np.asarray(query, dtype=np.float64)

    @F.arrow_udf("double")
    def product(vectors: pa.Array) -> pa.Array:
        return pa.array(_matrix(vectors, len(fixed)) @ fixed)

    return product(embedding)


@dataclass(frozen=True)
class VectorIndex:
    """``rows`` is (chunk_id, embedding) with unit vectors of length ``dim``."""

    rows: DataFrame
    dim: int

    @classmethod
    def build(cls, vectors: DataFrame, dim: int | None = None) -> VectorIndex:
        """Normalise ``vectors``; ``dim`` defaults to the length of any stored vector."""
        if dim is None:
            sample = vectors.select(F.size("embedding").alias("n")).first()
            dim = sample.n if sample else 0
        unit = l2_normalize("embedding", dim).alias("embedding")
        return cls(vectors.select("chunk_id", unit), dim)

    def search(self, query: Sequence[float], k: int) -> DataFrame:
        """Best ``k`` chunks as (chunk_id, score); no threshold is applied.

        Each task keeps its own best ``k`` and only those rows are merged.
        """
        if k <= 0 or self.dim == 0:
            return self.rows.sparkSession.createDataFrame([], RANKED)
        if len(query) != self.dim:
            raise ValueError(f"query has {len(query)} components, index has {self.dim}")
        score = F.round(dot("embedding", query), SCORE_DIGITS)
        return top_k(self.rows.select("chunk_id", score.alias("score")), k)

    def __len__(self) -> int:
        return 0 if self.dim == 0 else self.rows.count()

    def is_empty(self) -> bool:
        return self.dim == 0 or self.rows.isEmpty()
