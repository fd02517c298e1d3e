"""Block maxima for frequent terms: postings that cannot reach the top-k are not read.

Chunks are cut into blocks of neighbouring ids, the same for all terms, and blocks into
slabs. Of every frequent ("hot") term the largest weight in each block is kept in a small
table, and the postings are foldered by slab and sorted by term. A query reads the lists
of its rare terms, takes a threshold from the full scores of their best chunks, and
opens only those blocks of the hot terms in which rare score plus block maxima reach it.
Bounds are exact, so the result is that of reading every posting.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import RANKED
from ..session import local_rows, materialize, table_path

BLOCK_CHUNKS = 1_024
SLAB_BLOCKS = 256
#: Blocks of the highest maxima that are opened for the threshold.
FIRST_BLOCKS = 4
#: Seed blocks that are sent to the tasks as values.
MOST_SEEDS = 4_096
_BROADCAST_BLOCKS = 100_000
_SLACK = 1e-6  # scores are compared after rounding to nine digits


@dataclass(frozen=True)
class HotLists:
    """Postings (term, chunk_id, tf, doc_len, block, slab) and maxima (term, block, top).

    The maxima are foldered by the term's bucket like the dictionary.
    """

    postings: DataFrame
    maxima: DataFrame
    block_chunks: int

    @classmethod
    def build(
        cls, postings: DataFrame, weight: Column, bucket: Column, block_chunks: int = BLOCK_CHUNKS
    ) -> HotLists:
        """Write both tables; the postings without a shuffle, by the tasks that read them.

        Chunks of a task are mostly neighbours, so it has few slabs.
        """
        block = F.floor(F.col("chunk_id") / block_chunks)
        keys = ["slab", "term", "chunk_id"]
        placed = postings.withColumn("block", block).withColumn(
            "slab", F.floor(F.col("block") / SLAB_BLOCKS)
        )
        placed = placed.sortWithinPartitions(*keys)
        rows = _foldered(placed, "hot_postings", "slab")
        tops = rows.groupBy("term", "block").agg(F.max(weight).alias("top"))
        order = ["bucket", "term", "block"]
        tops = tops.withColumn("bucket", bucket)
        tops = tops.repartitionByRange(*order).sortWithinPartitions(*order)
        return cls(rows, _foldered(tops, "hot_maxima", "bucket"), block_chunks)

    def block_of(self, chunk_id: str) -> Column:
        return F.floor(F.col(chunk_id) / self.block_chunks)

    def reach(self, weights: dict[str, float], folders: list[int]) -> DataFrame:
        """(block, reach): what the given terms can add to a chunk of the block at most."""
        terms = _weighted(self.maxima.sparkSession, weights)
        known = self.maxima.where(
            F.col("bucket").isin(folders) & F.col("term").isin(list(weights))
        )
        return (
            known.join(F.broadcast(terms), "term")  # a row per query term
            .groupBy("block")
            .agg(F.sum(F.col("weight") * F.col("top")).alias("reach"))
        )

    def inside(self, terms: list[str], blocks: DataFrame, count: int) -> DataFrame:
        """Postings of ``terms`` in ``blocks`` (``count`` of them), from their slabs only."""
        slab = F.floor(F.col("block") / SLAB_BLOCKS)
        # One value per slab, that is per SLAB_BLOCKS * block_chunks chunks at most.
        slabs = sorted(r.slab for r in blocks.select(slab.alias("slab")).distinct().collect())
        held = self.postings.where(F.col("slab").isin(slabs) & F.col("term").isin(terms))
        wanted = blocks.select("block")
        side = F.broadcast(wanted) if count <= _BROADCAST_BLOCKS else wanted
        return held.join(side, "block").select("term", "chunk_id", "tf", "doc_len")


def _foldered(df: DataFrame, name: str, folder: str) -> DataFrame:
    path = table_path(df.sparkSession, name)
    df.write.partitionBy(folder).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _weighted(spark: SparkSession, weights: dict[str, float]) -> DataFrame:
    return local_rows(
        spark, term=list(weights), weight=[float(w) for w in weights.values()]
    )


@dataclass(frozen=True)
class BlockSearch:
    """One query over rare postings and hot lists.

    ``score`` turns postings of some weighted terms into (chunk_id, score); ``rare`` are
    the postings of ``rare_weights``.
    """

    hot: HotLists
    rare: DataFrame
    rare_weights: dict[str, float]
    hot_weights: dict[str, float]
    folders: list[int]
    score: object

    def _exact(self, blocks: DataFrame, count: int) -> DataFrame:
        """Scores that are complete in ``blocks`` and lower bounds elsewhere."""
        rows = self.rare
        if count:
            rows = rows.unionByName(self.hot.inside(list(self.hot_weights), blocks, count))
        return self.score(rows, self.rare_weights | self.hot_weights)

    def open_blocks(self, k: int) -> tuple[DataFrame, int]:
        """The blocks (block, reach) of hot terms that can hold one of the best ``k``."""
        spark = self.rare.sparkSession
        reach = materialize(self.hot.reach(self.hot_weights, self.folders), "block_reach")
        partial = spark.createDataFrame([], RANKED)
        if self.rare_weights:
            partial = materialize(self.score(self.rare, self.rare_weights), "rare_scores")
        best = partial.orderBy(F.desc("score"), "chunk_id").limit(min(k, MOST_SEEDS))
        seeds = best.select(self.hot.block_of("chunk_id").alias("block")).unionByName(
            reach.orderBy(F.desc("reach"), "block").limit(FIRST_BLOCKS).select("block")
        )
        seeds = sorted({r.block for r in seeds.collect()})
        opened = local_rows(spark, block=seeds) if seeds else reach.select("block").limit(0)
        found = self._exact(opened, len(seeds)).orderBy(F.desc("score")).limit(k)
        least = found.agg(F.count("*").alias("n"), F.min("score").alias("score")).first()
        threshold = least.score - _SLACK if least.n == k else 0.0
        known = partial.groupBy(self.hot.block_of("chunk_id").alias("block")).agg(
            F.max("score").alias("known")
        )
        can = F.col("reach") + F.coalesce("known", F.lit(0.0)) >= threshold
        wanted = reach.join(known, "block", "left").where(can).select("block", "reach")
        wanted = materialize(wanted, "open_blocks")
        return wanted, wanted.count()

    def scores(self, k: int) -> DataFrame:
        """(chunk_id, score), exact for every chunk among the best ``k``."""
        return self._exact(*self.open_blocks(k))
