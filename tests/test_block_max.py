"""Block maxima: the same results as reading every posting, from few blocks."""

import random
import re

import pytest
from pyspark.sql import functions as F

from siftmark.operators.lexical import Bm25Index


def chunk_rows(spark, texts):
    rows = [(i, "p", "r", [], t, 1, 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(
        rows,
        "id long, path string, root string, heading_path array<string>, text string,"
        " line_start long, line_end long",
    )


@pytest.fixture(scope="module")
def indexes(spark):
    draw = random.Random(5)
    texts = []
    for i in range(3000):
        words = ["the"] * draw.randrange(4) + ["of"] * draw.randrange(3)
        words += draw.choices([f"w{j}" for j in range(200)], k=draw.randrange(1, 20))
        if 1000 <= i < 1010:
            words += ["seldom"] * draw.randrange(1, 4)
        if 2000 <= i < 2020:
            words += ["the"] * 30
        texts.append(" ".join(words))
    chunks = chunk_rows(spark, texts)
    return (
        Bm25Index.build(chunks, stem=False, hot_list=1_000, block_chunks=50),
        Bm25Index.build(chunks, stem=False, inverted=False),
    )


@pytest.mark.parametrize(
    ("query", "k"),
    [
        ("seldom the", 1), ("the", 10), ("the of the", 5_000), ("w3 w7 the of", 10),
        ("w3 the", 5_000), ("seldom", 10), ("of nowhere", 1), ("nowhere", 10),
    ],
)
def test_same_rows_as_reading_everything(indexes, query, k):
    blocks, plain = indexes
    assert blocks.search(query, k).collect() == plain.search(query, k).collect()


def searched(index, query):
    from siftmark.operators.lexical import idf, query_terms
    from siftmark.session import local_rows

    wanted = query_terms(index.forward.sparkSession, query, False)
    counted = index.frequencies(sorted(wanted))
    known = local_rows(index.forward.sparkSession, term=list(counted), df=list(counted.values()))
    value = idf(F.lit(index.n_docs), F.col("df")).alias("idf")
    weights = {r.term: wanted[r.term] * r.idf for r in known.select("term", value).collect()}
    return index.block_search(weights, counted)


def test_few_blocks_are_opened(indexes):
    index = indexes[0]
    assert index.hot.maxima.where("term = 'the'").count() == 60
    for query, k, most in (("seldom the", 5, 6), ("the", 3, 6)):
        found = searched(index, query)
        opened, count = found.open_blocks(k)
        assert 0 < count <= most
        ids = {r.block for r in opened.collect()}
        assert ids & ({20} if "seldom" in query else {40})


def test_other_slabs_are_not_scanned(spark, indexes, monkeypatch):
    from siftmark.operators import block_max

    monkeypatch.setattr(block_max, "SLAB_BLOCKS", 4)
    draw = random.Random(6)
    texts = ["the " * draw.randrange(1, 4) + ("seldom" if i == 1000 else "often") for i in range(2000)]
    index = Bm25Index.build(chunk_rows(spark, texts), stem=False, hot_list=500, block_chunks=50)
    found = searched(index, "seldom the")
    opened, count = found.open_blocks(1)
    assert count == 1
    inside = index.hot.inside(["the"], opened, count)
    plan = inside._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*slab#\d+\S* (=|IN|as) ?[^\]]*5", plan)
    assert inside.select("chunk_id").agg(F.min("chunk_id"), F.max("chunk_id")).first() == (1000, 1049)


def test_rare_queries_do_not_touch_the_hot_lists(indexes):
    plan = indexes[0].search("seldom w3", 5)._jdf.queryExecution().optimizedPlan().toString()
    assert "slab" not in plan and "hot_postings" not in plan


def test_statistics_are_observed_in_the_write(spark, indexes):
    tracker = spark.sparkContext.statusTracker()
    index = indexes[0]
    assert index.n_docs == 3000
    assert index.avg_doc_len == pytest.approx(index.forward.agg(F.avg("doc_len")).first()[0])
    assert Bm25Index.build(chunk_rows(spark, []), stem=False).search("the", 3).collect() == []
    from siftmark.operators.lexical import _write_forward

    spark.sparkContext.setJobGroup("one", "one")
    _write_forward(chunk_rows(spark, ["a b", "c"]), False)
    assert len(tracker.getJobIdsForGroup("one")) == 1
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
