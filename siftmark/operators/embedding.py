"""Embed only what the cache does not hold, and hand vectors back per chunk."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import text_hash
from ..schemas import EMBEDDING_CACHE
from ..session import materialize, partitions_for
from ..sources.model import Embedder

_EMBED_ROWS = 256
# A text repeated on more than 1/HOT_SHARE of the rows is joined by broadcast, so
# at most HOT_SHARE such texts can exist.
HOT_SHARE = 1_000
_HOT_MINIMUM = 10_000


def embed_rows(texts: DataFrame, embedder: Embedder) -> DataFrame:
    """(text_hash, text) to cache rows, in worker-side batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, _EMBED_ROWS):
                part = batch.slice(start, _EMBED_ROWS)
                found = np.asarray(embedder.embed(part.column("text").to_pylist()), np.float32)
                if found.ndim != 2 or len(found) != part.num_rows:
                    raise ValueError("an embedder must return one row per text")
                count, dim = found.shape
                bounds = np.arange(count + 1, dtype=np.int32) * dim
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("text_hash"),
                        pa.array(np.full(count, dim, dtype=np.int32)),
                        pa.ListArray.from_arrays(bounds, pa.array(found.ravel())),
                    ],
                    names=EMBEDDING_CACHE.names,
                )

    return texts.select("text_hash", "text").mapInArrow(run, EMBEDDING_CACHE)


def newest_last(entries: DataFrame) -> DataFrame:
    """Cache entries with a ``generation`` that rises with every write."""
    if "generation" in entries.columns:
        return entries
    return entries.withColumn("generation", F.lit(""))


def copies_per_text(hashed: DataFrame) -> DataFrame:
    """(text_hash, leader, copies): the lowest id and the row count of each text."""
    return hashed.groupBy("text_hash").agg(
        F.min("chunk_id").alias("leader"), F.count("*").alias("copies")
    )


def hit_counts(copies: DataFrame, cached: DataFrame) -> DataFrame:
    """One row (hits, misses); each copy of a missing text counts as a miss."""
    keys = cached.select("text_hash").distinct().withColumn("known", F.lit(True))
    known = F.col("known").isNotNull()
    return copies.join(keys, "text_hash", "left").agg(
        F.coalesce(F.sum(F.when(known, F.col("copies"))), F.lit(0)).alias("hits"),
        F.coalesce(F.sum(F.when(~known, F.col("copies"))), F.lit(0)).alias("misses"),
    )


@dataclass(frozen=True)
class EmbeddedTexts:
    vectors: DataFrame  # (chunk_id, embedding)
    dim: int | None
    added: DataFrame | None  # new cache rows, already written to the shared folder
    hits: int
    misses: int


def get_or_embed(texts: DataFrame, cached: DataFrame, embedder: Embedder) -> EmbeddedTexts:
    """Vectors for (chunk_id, text) rows, running the model once per missing text.

    Hashes, not texts, go through the grouping and the cache joins. Texts are joined
    once more, by chunk id, to the one leader row of each missing hash.
    """
    hashed = materialize(texts.select("chunk_id", text_hash("text").alias("text_hash")), "hashes")
    copies = materialize(copies_per_text(hashed), "copies")
    counts = hit_counts(copies, cached).first()
    added = None
    entries = cached
    if counts.misses:
        missing = copies.join(cached, "text_hash", "left_anti").select(
            F.col("leader").alias("chunk_id"), "text_hash"
        )
        leaders = missing.join(texts.select("chunk_id", "text"), "chunk_id")
        # Inference dwarfs this exchange: spread new texts evenly, wherever they lie.
        parts = partitions_for(texts.sparkSession, counts.misses, _EMBED_ROWS)
        even = leaders.repartition(parts, "text_hash")
        added = materialize(embed_rows(even, embedder), "embeddings")
        entries = newest_last(cached).unionByName(added.withColumn("generation", F.lit("~")))
    sample = entries.select("dim").first()
    return EmbeddedTexts(
        vectors=attach_vectors(hashed, copies, entries, counts.hits + counts.misses),
        dim=sample.dim if sample else None,
        added=added,
        hits=counts.hits,
        misses=counts.misses,
    )


def attach_vectors(hashed: DataFrame, copies: DataFrame, entries: DataFrame, rows: int) -> DataFrame:
    """(chunk_id, embedding) of every row whose hash is among the cache entries.

    Very frequent texts leave the shuffle: their vectors, at most ``HOT_SHARE`` of
    them, are broadcast instead. Of several entries of one text the last written counts.
    """
    last = F.max(F.struct("generation", "embedding")).getField("embedding")
    unique = newest_last(entries).groupBy("text_hash").agg(last.alias("embedding"))
    limit = max(_HOT_MINIMUM, rows // HOT_SHARE)
    hot = [r.text_hash for r in copies.where(F.col("copies") > limit).select("text_hash").collect()]
    joined = hashed.join(unique, "text_hash")
    if hot:
        is_hot = F.col("text_hash").isin(hot)
        frequent = hashed.where(is_hot).join(F.broadcast(unique.where(is_hot)), "text_hash")
        joined = hashed.where(~is_hot).join(unique, "text_hash").unionByName(frequent)
    return joined.select("chunk_id", "embedding")
