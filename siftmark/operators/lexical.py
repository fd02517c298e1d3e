"""BM25 over weighted term frequencies, as relations.

``forward``   one row per chunk: length, distinct terms and their frequencies
``postings``  the same exploded: (term, chunk_id, tf, doc_len)

A chunk is one row, so its frequencies are counted inside that row and the forward
relation needs no exchange at all. The only full shuffle of an index build is the
one that lays the postings out by term.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..config import HEADING_BOOST, K1, B
from ..functions.stemming import stem_token, stem_values
from ..functions.text import mark_verbatim, tokens
from ..schemas import FORWARD, RANKED
from ..session import local_rows, materialize, partitions_for, table_path
from . import ordering
from .block_max import BLOCK_CHUNKS, BlockSearch, HotLists

_CHUNKS_PER_BUCKET = 10_000
#: Tokens that are counted in one step of a Python worker, whatever the batches hold.
_STEP_TOKENS = 200_000
# A term in more chunks than this, and in more than a thousandth of all, is hot. So hot
# terms number at most a thousand times the distinct terms of a mean chunk.
HOT_LIST = 20_000
_HOT_SHARE = 1_000
SCORE_DIGITS = 9  # ranks compare rounded scores, so summation order cannot matter


def forward(chunks: DataFrame, stem: bool = True) -> DataFrame:
    """Weighted term frequencies and length of every chunk (row-local)."""
    found = mark_verbatim if stem else lambda column: column
    analysed = chunks.select(
        F.col("id").alias("chunk_id"),
        found(tokens(F.array_join("heading_path", "\n"))).alias("heading"),
        found(tokens("text")).alias("body"),
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool = pa.default_memory_pool()
        for batch in batches:
            for rows in _steps(batch):
                yield _count_batch(rows, stem)
                pool.release_unused()

    return analysed.mapInArrow(count, FORWARD)


def _steps(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Runs of rows that hold about ``_STEP_TOKENS`` tokens."""
    if not batch.num_rows:
        return
    held = sum(np.diff(batch.column(name).offsets.to_numpy()) for name in ("heading", "body"))
    part = np.cumsum(held) // _STEP_TOKENS
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield batch.slice(a, b - a)


def _count_batch(batch: pa.RecordBatch, stem: bool) -> pa.RecordBatch:
    """Sum the weights of equal (row, term) pairs of one batch."""
    rows, weights, values = [], [], []
    doc_len = np.zeros(batch.num_rows)
    for name, weight in (("heading", HEADING_BOOST), ("body", 1.0)):
        lists = batch.column(name)
        sizes = np.diff(lists.offsets.to_numpy())
        rows.append(np.repeat(np.arange(batch.num_rows), sizes))
        weights.append(np.full(sizes.sum(), weight))
        values.append(lists.flatten())
        doc_len += weight * sizes
    merged = pa.concat_arrays([v.cast(pa.string()) for v in values])
    coded = merged.dictionary_encode()
    codes, dictionary = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
    if stem:
        stems = stem_values(dictionary).dictionary_encode()
        codes, dictionary = stems.indices.to_numpy(zero_copy_only=False)[codes], stems.dictionary
    width = max(len(dictionary), 1)
    keys, place = np.unique(np.concatenate(rows) * width + codes, return_inverse=True)
    tf = np.bincount(place, weights=np.concatenate(weights), minlength=len(keys))
    bounds = np.searchsorted(keys, np.arange(batch.num_rows + 1) * width).astype(np.int32)
    terms = dictionary.take(pa.array(keys % width))
    return pa.RecordBatch.from_arrays(
        [
            batch.column("chunk_id"),
            pa.array(doc_len),
            pa.ListArray.from_arrays(bounds, terms),
            pa.ListArray.from_arrays(bounds, pa.array(tf, pa.float64())),
        ],
        names=FORWARD.names,
    )


def postings(forward_rows: DataFrame) -> DataFrame:
    """(term, chunk_id, tf, doc_len)."""
    exploded = forward_rows.select("chunk_id", "doc_len", "tfs", F.posexplode("terms").alias("at", "term"))
    return exploded.select("term", "chunk_id", F.get("tfs", F.col("at")).alias("tf"), "doc_len")


def _stats() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("n_docs"),
        F.coalesce(F.avg("doc_len"), F.lit(0.0)).alias("avg_doc_len"),
    ]


def corpus_stats(forward_rows: DataFrame) -> DataFrame:
    """One row: chunk count (token-less chunks included) and mean weighted length."""
    return forward_rows.agg(*_stats())


def document_frequency(posting_rows: DataFrame) -> DataFrame:
    return posting_rows.groupBy("term").agg(F.count("*").alias("df"))


def idf(n_docs: Column, df: Column) -> Column:
    return F.log(1 + (n_docs - df + 0.5) / (df + 0.5))


def bm25_weight(tf: Column, doc_len: Column, avg_doc_len: float) -> Column:
    """Saturated, length-normalised term weight (without IDF)."""
    norm = doc_len / F.lit(avg_doc_len) if avg_doc_len > 0 else F.lit(0.0)
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * norm))


def query_terms(spark: SparkSession, query: str, stem: bool = True) -> Counter:
    """Terms of a query with their multiplicity; a repeated term counts repeatedly."""
    found = mark_verbatim(tokens("q")) if stem else tokens("q")
    terms = local_rows(spark, q=[query]).select(found.alias("t")).collect()[0].t
    return Counter(map(stem_token, terms) if stem else terms)


@dataclass(frozen=True)
class Bm25Index:
    """A written lexical index and its two corpus constants.

    ``terms`` is the dictionary (term, df), foldered by the same hash bucket as the
    posting lists, so a query learns its frequencies without reading any list; it is
    written when first needed. ``inverted`` is laid out by term: foldered by a hash bucket
    of the term and sorted by (term, chunk_id), so a query opens a few folders and skips to
    its posting lists. Without it, a search scans the forward relation once for lists and
    frequencies alike. Terms in more than ``hot_list`` chunks have their postings in
    ``hot``, by blocks of chunks.
    """

    forward: DataFrame
    inverted: DataFrame | None
    buckets: int
    n_docs: int
    avg_doc_len: float
    stem: bool
    hot: HotLists | None = None
    hot_list: int = HOT_LIST

    @classmethod
    def build(
        cls,
        chunks: DataFrame,
        stem: bool = True,
        inverted: bool = True,
        hot_list: int = HOT_LIST,
        block_chunks: int = BLOCK_CHUNKS,
    ) -> Bm25Index:
        spark = chunks.sparkSession
        rows, stats = _write_forward(chunks, stem)
        n_docs, mean = stats["n_docs"], stats["avg_doc_len"]
        buckets = partitions_for(spark, n_docs, _CHUNKS_PER_BUCKET)
        index = cls(rows, None, buckets, n_docs, mean, stem)
        return index.with_lists(hot_list, block_chunks) if inverted else index

    def with_lists(self, hot_list: int = HOT_LIST, block_chunks: int = BLOCK_CHUNKS) -> Bm25Index:
        """The index with its posting lists laid out by term."""
        hot_list, hot = max(hot_list, self.n_docs // _HOT_SHARE), None
        all_lists = lists = postings(self.forward)
        terms = self.terms
        frequent = terms.where(F.col("df") > hot_list).select("term")
        if self.n_docs > hot_list and not frequent.isEmpty():
            # Bounded as said at HOT_LIST.
            lists = all_lists.join(F.broadcast(frequent), "term", "left_anti")
            hot = HotLists.build(
                all_lists.join(F.broadcast(frequent), "term"),
                bm25_weight(F.col("tf"), F.col("doc_len"), self.avg_doc_len),
                _bucket("term", self.buckets),
                block_chunks,
            )
        index = replace(
            self, inverted=_write_inverted(lists, self.buckets), hot=hot, hot_list=hot_list
        )
        index.__dict__["terms"] = terms
        return index

    @cached_property
    def terms(self) -> DataFrame:
        return _write_terms(self.forward, self.buckets)

    def postings(self) -> DataFrame:
        if self.inverted is None:
            return postings(self.forward)
        rare = self.inverted.drop("bucket")
        return rare if self.hot is None else rare.unionByName(self.hot.postings.drop("block", "slab"))

    def _folders(self, terms: list[str]) -> list[int]:
        """Buckets that can hold the given terms."""
        spark = self.forward.sparkSession
        found = local_rows(spark, term=terms).select(_bucket("term", self.buckets).alias("b"))
        return sorted({row.b for row in found.collect()})

    def frequencies(self, terms: list[str]) -> dict[str, int]:
        """Document frequency of the given terms that occur; one row per term."""
        rows = self.terms.where(
            F.col("bucket").isin(self._folders(terms)) & F.col("term").isin(terms)
        )
        return {row.term: row.df for row in rows.select("term", "df").collect()}

    def matching(self, terms: list[str]) -> DataFrame:
        """Posting lists of the given terms, hot ones excepted if there are blocks."""
        if self.inverted is None:
            return self.postings().where(F.col("term").isin(terms))
        return self.inverted.where(
            F.col("bucket").isin(self._folders(terms)) & F.col("term").isin(terms)
        ).drop("bucket")

    def search(self, query: str, k: int) -> DataFrame:
        """Best ``k`` chunks as (chunk_id, score), by score then id."""
        spark = self.forward.sparkSession
        wanted = query_terms(spark, query, self.stem)
        if not wanted or k <= 0 or self.n_docs == 0:
            return spark.createDataFrame([], RANKED)
        scanned = None
        if self.inverted is None:
            scanned = materialize(self.matching(sorted(wanted)), "matched")
            # A row per query term.
            counted = {r.term: r.df for r in document_frequency(scanned).collect()}
        else:
            counted = self.frequencies(sorted(wanted))
        if not counted:
            return spark.createDataFrame([], RANKED)
        # The expression of the queries, over one row per query term.
        known = local_rows(spark, term=list(counted), df=list(counted.values()))
        value = idf(F.lit(self.n_docs), F.col("df")).alias("idf")
        weights = {r.term: wanted[r.term] * r.idf for r in known.select("term", value).collect()}
        blocks = self.block_search(weights, counted)
        if blocks is not None:
            return top_k(blocks.scores(k), k)
        matched = self.matching(sorted(counted)) if scanned is None else scanned
        return top_k(score_postings(matched, weights, self.avg_doc_len), k)

    def block_search(
        self, weights: dict[str, float], counted: dict[str, int]
    ) -> BlockSearch | None:
        """The query by blocks, or None if none of its terms is hot."""
        hot = {t: w for t, w in weights.items() if counted[t] > self.hot_list}
        if self.hot is None or not hot:
            return None
        rare = {t: w for t, w in weights.items() if t not in hot}
        rows = self.matching(sorted(rare)) if rare else self.matching([""]).limit(0)

        def score(postings: DataFrame, some: dict[str, float]) -> DataFrame:
            return score_postings(postings, some, self.avg_doc_len)

        return BlockSearch(self.hot, rows, rare, hot, self._folders(sorted(hot)), score)

    def term_count(self) -> int:
        return self.terms.count()

    def __len__(self) -> int:
        return self.n_docs

    def is_empty(self) -> bool:
        return self.n_docs == 0


def _bucket(term: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def _write_forward(chunks: DataFrame, stem: bool) -> tuple[DataFrame, dict]:
    """The written forward relation, and its :func:`corpus_stats` observed in the write."""
    seen = Observation()
    observed = forward(chunks, stem).observe(seen, *_stats())
    return materialize(observed, "forward"), seen.get


def _write_inverted(posting_rows: DataFrame, buckets: int) -> DataFrame:
    """Foldered by bucket, sorted by (term, chunk_id).

    Without hot terms a list is bounded, so buckets are dealt out by hash in one reading.
    """
    spark = posting_rows.sparkSession
    keys = ["bucket", "term", "chunk_id"]
    laid_out = (
        posting_rows
        .withColumn("bucket", _bucket("term", buckets))
        .repartition("bucket")
        .sortWithinPartitions(*keys)
    )
    path = table_path(spark, "postings")
    laid_out.write.partitionBy("bucket").parquet(path)
    return spark.read.schema(laid_out.schema).parquet(path)


def _write_terms(forward_rows: DataFrame, buckets: int) -> DataFrame:
    """(term, df, bucket) of every term: a row of a chunk holds a term once."""
    exploded = forward_rows.select(F.explode("terms").alias("term"))
    counted = document_frequency(exploded).withColumn("bucket", _bucket("term", buckets))
    laid_out = counted.repartition("bucket").sortWithinPartitions("bucket", "term")
    return materialize(laid_out, "terms", partition_by="bucket")


def score_postings(matched: DataFrame, weights: dict[str, float], avg_doc_len: float) -> DataFrame:
    """Sum of query-weighted BM25 contributions per chunk.

    The broadcast side has one row per query term.
    """
    terms = local_rows(
        matched.sparkSession, term=list(weights), weight=[float(w) for w in weights.values()]
    )
    contribution = F.col("weight") * bm25_weight(F.col("tf"), F.col("doc_len"), avg_doc_len)
    return (
        matched.join(F.broadcast(terms), "term")
        .groupBy("chunk_id")
        .agg(F.sum(contribution).alias("score"))
        .withColumn("score", F.round("score", SCORE_DIGITS))
    )


def top_k(scored: DataFrame, k: int) -> DataFrame:
    """Best ``k`` rows by score, then id."""
    best = ordering.first_rows(scored, [F.desc("score"), F.asc("chunk_id")], k)
    return best.select("chunk_id", "score")
