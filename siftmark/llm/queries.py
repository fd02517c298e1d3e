"""The operators as queries over the given tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    audit_repair,
    bin_slack,
    chat,
    geometric_search,
    license_scan,
    line_rules,
    lsh_forest,
    packing,
    quality_grades,
    template_leaks,
    token_counts,
    toxicity,
    url_rules,
)
from .common import held_out, read
from .oracles import ORACLES


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate(read(spark, sf_dir, "conversations")).drop("mask")


def op2_template_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = template_leaks.find_leaks(docs, read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.*")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(read(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return packing.piece_digests(packing.pack(docs, tokenizer("word_bpe_49k.json")))


def toxic_model(docs: DataFrame, labels: DataFrame) -> toxicity.ToxicModel:
    """Fitted on labels outside the held-out fifth."""
    learned = labels.where(~held_out(F.col("doc_id"))).select("doc_id", F.col("toxic").alias("label"))
    return toxicity.fit(docs, learned)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxic_model(docs, read(spark, sf_dir, "labels"))
    scored = toxicity.score_documents(docs, model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op6_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lsh_forest.near_duplicates(read(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    counted = token_counts.count_tokens(docs, tokenizer("byte_bpe_50k.json"))
    return counted.drop("text")


def op8_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return line_rules.apply_line_rules(docs, clean=False).drop("text")


def op9_quality_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    grade = quality_grades.grade_of_labels(F.col("quality"), F.col("toxic"))
    labels = read(spark, sf_dir, "labels").where(~held_out(F.col("doc_id")))
    model = quality_grades.fit(docs, labels.select("doc_id", grade.alias("label")))
    graded = quality_grades.grade_documents(docs, model)
    return graded.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "expected_grade",
        F.element_at("p_above", 1).alias("p_readable"),
        F.element_at("p_above", -1).alias("p_good"),
        (F.element_at("p_above", 1) >= 0.5).alias("kept"),
    )


def op10_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    labelled = url_rules.labels_by_number(pages, read(spark, sf_dir, "labels"))
    return url_rules.judge_urls(pages, labelled).drop("url")


def op11_geometric_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return geometric_search.rank(docs, read(spark, sf_dir, "benchmark"))


def op12_audit_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = audit_repair.damage(read(spark, sf_dir, "conversations"))
    return audit_repair.repair(turns, dropped=F.col("dropped"))


def op13_bin_slack(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    pieces = bin_slack.pack_tightly(docs, tokenizer("word_bpe_49k.json"))
    return packing.piece_digests(pieces)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat_perspectives": op1_chat_perspectives,
    "op2_template_leaks": op2_template_leaks,
    "op3_license_scan": op3_license_scan,
    "op4_packing": op4_packing,
    "op5_toxicity": op5_toxicity,
    "op6_lsh_forest": op6_lsh_forest,
    "op7_token_counts": op7_token_counts,
    "op8_line_rules": op8_line_rules,
    "op9_quality_grades": op9_quality_grades,
    "op10_url_rules": op10_url_rules,
    "op11_geometric_search": op11_geometric_search,
    "op12_audit_repair": op12_audit_repair,
    "op13_bin_slack": op13_bin_slack,
}
__all__ = ["ORACLES", "QUERIES"]
