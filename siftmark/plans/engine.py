"""Build the tables once, answer queries over them."""

from __future__ import annotations

import logging
import time
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from functools import cached_property

from pyspark.sql import DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..functions.markdown import WHITE_SPACE
from ..functions.text import indexable_text, snippet
from ..operators.chunking import build_chunks, order_documents
from ..operators.clustered import ClusteredIndex
from ..operators.dense import VectorIndex
from ..operators.documents import document_chunks, document_text
from ..operators.embedding import get_or_embed
from ..operators.fusion import candidate_pool, collapse, fuse, with_phrase_bonus
from ..operators.lexical import Bm25Index
from ..operators.ordering import NumberedTable
from ..schemas import HITS, RANKED
from ..session import drop_tables, materialize
from ..sources.embedding_cache import EmbeddingCache
from ..sources.files import load_documents
from ..sources.model import Embedder, OnnxEmbedder

log = logging.getLogger("siftmark")


@contextmanager
def _phase(name: str) -> Iterator[None]:
    started = time.monotonic()
    yield
    log.info("%s ms=%d", name, (time.monotonic() - started) * 1000)


# From so many vectors on they are laid out by clusters; the results are the same.
CLUSTERED_VECTORS = 100_000


def _written(index: VectorIndex) -> VectorIndex | ClusteredIndex:
    """The index as a table, by clusters if it is large."""
    seen = Observation()
    rows = materialize(index.rows.observe(seen, F.count(F.lit(1)).alias("n")), "vectors")
    if seen.get["n"] < CLUSTERED_VECTORS:
        return VectorIndex(rows, index.dim)
    return ClusteredIndex.of_unit(rows, index.dim, seen.get["n"])


class SearchEngine:
    """Hybrid search over one set of chunks.

    The chunk table is written at build time. Lexical and dense tables are written
    when first needed, so lookups never pay for them. The first search scans the forward
    relation; posting lists are laid out for the second, as they cost several scans.
    """

    def __init__(
        self, spark: SparkSession, cfg: Config, table: NumberedTable, embedder: Embedder | None
    ) -> None:
        self.spark, self.cfg, self.embedder = spark, cfg, embedder
        self.table = table
        self.chunks = table.rows()
        self._searched = False

    def __enter__(self) -> SearchEngine:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    def close(self) -> None:
        """Delete the tables this application wrote; results still lazy need them."""
        drop_tables(self.spark)

    def use_vectors(self, vectors: DataFrame, dim: int | None = None) -> None:
        """Take the dense index from a (chunk_id, embedding) table instead of a model."""
        self.vectors = _written(VectorIndex.build(vectors, dim))

    @classmethod
    def build(
        cls, spark: SparkSession, cfg: Config, embedder: Embedder | None = None
    ) -> SearchEngine:
        """Index the markdown files under ``cfg.roots``."""
        return cls._build(spark, cfg, load_documents(spark, cfg), embedder)

    @classmethod
    def from_documents(
        cls, docs: DataFrame, cfg: Config, embedder: Embedder | None = None
    ) -> SearchEngine:
        """Index a (root, path, source) table."""
        return cls._build(docs.sparkSession, cfg, order_documents(docs), embedder)

    @classmethod
    def _build(cls, spark, cfg, ordered, embedder) -> SearchEngine:
        with _phase("chunk table"):
            table = build_chunks(ordered, cfg)
        if cfg.lexical_only:
            embedder = None
        elif embedder is None:
            with _phase("model files"):
                embedder = OnnxEmbedder.load(spark, cfg)
        return cls(spark, cfg, table, embedder)

    @cached_property
    def lexical(self) -> Bm25Index:
        with _phase("lexical tables"):
            return Bm25Index.build(self.chunks, stem=self.cfg.stem, inverted=False)

    def _lexical_for_search(self) -> Bm25Index:
        if self._searched and self.lexical.inverted is None:
            with _phase("posting lists"):
                self.lexical = self.lexical.with_lists()
        self._searched = True
        return self.lexical

    @cached_property
    def vectors(self) -> VectorIndex | ClusteredIndex:
        """Dense index over every chunk's indexable text, through the embedding cache."""
        with _phase("dense tables"):
            texts = self.chunks.select(
                F.col("id").alias("chunk_id"), indexable_text("heading_path", "text").alias("text")
            )
            cache = EmbeddingCache.at(self.spark, self.cfg)
            found = get_or_embed(texts, cache.load(), self.embedder)
            log.info("texts with cached vectors=%d without=%d", found.hits, found.misses)
            index = _written(VectorIndex.build(found.vectors, found.dim))
            if found.added is not None:
                try:
                    cache.save(found.added)
                except Exception as err:  # the vectors are usable without the cache
                    log.warning("the new vectors could not be cached: %s", err)
            return index

    def search(
        self, query: str, k: int | None = None, query_vector: Sequence[float] | None = None
    ) -> DataFrame:
        """Best hits of a query, at most ``cfg.per_page`` for each of ``k`` paths.

        ``query_vector`` replaces the embedder's vector of the query.
        """
        query = query.strip(WHITE_SPACE)
        k = self.cfg.default_top_k if k is None else k
        if not query or k <= 0:
            return self.spark.createDataFrame([], HITS)
        with _phase("query"):
            pool = candidate_pool(k)
            lexical = self._lexical_for_search().search(query, pool)
            dense = self.spark.createDataFrame([], RANKED)
            if query_vector is None and self.embedder is not None and self.table.count:
                query_vector = [float(x) for x in self.embedder.embed_query(query)]
            if query_vector is not None and self.table.count:
                dense = self.vectors.search(query_vector, pool)
            fused = fuse(lexical, dense, k=pool, at_most=pool)
            return self._hits(fused.select("chunk_id", "score"), query, k, pool)

    def _hits(self, fused: DataFrame, query: str, k: int, pool: int) -> DataFrame:
        texts = self.table.fetch(fused, "chunk_id", pool)
        return collapse(candidate_rows(texts, query), k, self.cfg.per_page).select(*HITS.names)

    def get_chunk(self, chunk_id: int) -> Row | None:
        rows = self.table.lookup([chunk_id]).take(1)
        return rows[0] if rows else None

    def get_document(self, path: str) -> str | None:
        return document_text(self.table, path)

    def document_chunks(self, path: str) -> DataFrame:
        return document_chunks(self.table, path)

    def stats(self) -> dict:
        counted = self.chunks.agg(F.countDistinct("path").alias("files")).first()
        dense = self.embedder is not None
        return {
            "files": counted.files,
            "chunks": self.table.count,
            "lexical_terms": self.lexical.term_count(),
            "dense": dense,
            "dim": self.vectors.dim if dense else 0,
        }


def candidate_rows(joined: DataFrame, query: str) -> DataFrame:
    """Output columns of pooled chunks, phrase bonus included; full texts stay behind."""
    return with_phrase_bonus(joined, query).select(
        "chunk_id",
        "path",
        "heading_path",
        "line_start",
        "line_end",
        "score",
        snippet("text").alias("snippet"),
    )
