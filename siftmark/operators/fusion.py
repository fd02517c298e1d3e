"""Reciprocal rank fusion, phrase bonus and collapsing per document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import DEFAULT_WEIGHTS, PHRASE_BONUS, RRF_K, Weights
from ..functions.text import contains_phrase
from .ordering import first_rows, with_rank


def candidate_pool(k: int) -> int:
    """Rows kept from each list and from the fused list."""
    return max(1, 4 * k)


def _ranked(hits: DataFrame, prefix: str, at_most: int | None) -> DataFrame:
    if "rank" not in hits.columns:
        hits = with_rank(hits, [F.desc("score"), F.asc("chunk_id")], "rank", at_most)
    return hits.select(
        "chunk_id",
        F.col("rank").alias(f"{prefix}_rank"),
        F.col("score").alias(f"{prefix}_score"),
    )


def fuse(
    lexical: DataFrame,
    dense: DataFrame,
    weights: Weights = DEFAULT_WEIGHTS,
    k: int = 10,
    at_most: int | None = None,
) -> DataFrame:
    """Best ``k`` of two ranked lists: (chunk_id, score, lexical_rank, dense_rank).

    Lists are (chunk_id, score) and ranked by score then id, or bring their own
    1-based ``rank``. ``at_most`` is the limit the caller put on each list.
    """

    def share(weight: float, rank: str) -> Column:
        return F.coalesce(F.lit(weight) / (F.lit(RRF_K) + F.col(rank)), F.lit(0.0))

    score = share(weights.lexical, "lexical_rank") + share(weights.dense, "dense_rank")
    both = (
        _ranked(lexical, "lexical", at_most)
        .join(_ranked(dense, "dense", at_most), "chunk_id", "full_outer")
        .withColumn("score", score)
    )
    order = [F.desc("score"), F.desc_nulls_last("dense_score"), F.asc("chunk_id")]
    return first_rows(both, order, k).select("chunk_id", "score", "lexical_rank", "dense_rank")


def with_phrase_bonus(candidates: DataFrame, phrase: str) -> DataFrame:
    """Raise the score of candidates whose ``text`` holds the phrase verbatim."""
    bonus = F.when(contains_phrase("text", phrase), PHRASE_BONUS).otherwise(0.0)
    return candidates.withColumn("score", F.col("score") + bonus)


def collapse(candidates: DataFrame, k: int, per_page: int) -> DataFrame:
    """Keep at most ``per_page`` candidates of each of the first ``k`` paths.

    Needs ``chunk_id``, ``score`` and ``path``; adds ``chunks_matched``, the number
    of candidates per path. Walking down the list ends at the first candidate of
    path number ``k + 1``. ``per_page`` 0 keeps the first ``k`` candidates.
    Positions are compared through the sort key itself, so nothing needs a rank
    over the whole list.
    """
    position = F.struct((-F.col("score")).alias("s"), F.col("chunk_id").alias("c"))
    placed = candidates.withColumn("_at", position).withColumn(
        "chunks_matched", F.count("*").over(Window.partitionBy("path"))
    )
    if per_page == 0:
        return first_rows(placed, [F.asc("_at")], k).drop("_at")
    leaders = candidates.groupBy("path").agg(F.min(position).alias("first"))
    stop = (
        first_rows(leaders, [F.asc("first")], k + 1)
        .agg(F.when(F.count("*") > k, F.max("first")).alias("stop"))
    )
    nth = F.row_number().over(Window.partitionBy("path").orderBy("_at"))
    return (
        placed.withColumn("_nth", nth)
        .where(F.col("_nth") <= per_page)
        .join(F.broadcast(stop), F.col("stop").isNull() | (F.col("_at") < F.col("stop")))
        .orderBy("_at")
        .drop("_at", "_nth", "stop")
    )
