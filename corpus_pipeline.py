"""A training-data pipeline of five operators over ``documents``.

Toxicity, quality rules, near-duplicates, benchmark decontamination, packing: each
stage takes what its predecessor kept, written as Parquet. All but the last return the
columns of ``documents``; the quality rules also remove failing lines, so ``text`` and
``n_chars`` of a kept document are those of its clean text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftmark.llm import line_rules, lsh_forest, packing, template_leaks, toxicity
from siftmark.llm.common import read
from siftmark.llm.queries import tokenizer, toxic_model
from siftmark.session import materialize

#: Near-duplicates of the pipeline: five-word shingles, a similarity of 0.8.
NEAR = lsh_forest.Rule(words=5, percent=80)
_ROW = "_row_of_stage"


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go."""
    model = toxic_model(docs, read(spark, sf_dir, "labels"))
    scored = toxicity.score_documents(docs, model)
    return scored.where(F.col("predicted") == 0).select(*docs.columns)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line rules reject go; of the others, failing lines go."""
    judged = line_rules.apply_line_rules(docs).where("kept")
    made = {"text": F.col("clean_text"), "n_chars": F.char_length("clean_text").cast("long")}
    return judged.select(*[made[c].alias(c) if c in made else F.col(c) for c in docs.columns])


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates stays, that of the smallest id.

    Rows, not ids, are compared: of repeated rows one stays, a null id comes after all
    others, and of two texts under one id each belongs to its own group. Where all ids are
    different the rows are told apart by them; else each gets a number of its own.
    """
    odd = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 OR doc_id IS NULL")
    if odd.isEmpty():
        found = lsh_forest.near_duplicates(docs, rule=NEAR)
        gone = found.where(~F.col("kept")).select("doc_id")
        return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    rows = materialize(docs.withColumn(_ROW, F.monotonically_increasing_id()), "pipeline_rows")
    found = lsh_forest.near_duplicates(rows.select(_ROW, "text"), key=_ROW, rule=NEAR)
    named = found.select(_ROW, "component_id").join(rows.select(_ROW, "doc_id"), _ROW)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", _ROW))
    kept = named.groupBy("component_id").agg(first.getField(_ROW).alias(_ROW)).select(_ROW)
    return rows.join(kept, _ROW, "left_semi").select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak a benchmark item go."""
    found = template_leaks.find_leaks(docs, read(spark, sf_dir, "benchmark"))
    return found.where(F.size("leaks") == 0).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, packed into sequences: one row per piece, with its ids' checksum."""
    pieces = packing.pack(docs, tokenizer("word_bpe_49k.json"))
    return packing.piece_digests(pieces)


STAGES = [
    ("toxicity", toxicity_stage),
    ("quality_rules", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline_{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: SQL cannot express a learned model, MinHash candidates or a tokenizer; the stages are
#: tested against brute force.
ORACLE_SQL = None
