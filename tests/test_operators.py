"""Lexical, dense, fusion, collapsing and numbering on small relations."""

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from siftmark import Config, Weights
from siftmark.functions.stemming import stem_token
from siftmark.operators import ordering
from siftmark.operators.chunking import (
    build_chunks,
    document_order_key,
    order_documents,
    path_components,
)
from siftmark.operators.dense import VectorIndex
from siftmark.operators.documents import document_chunks, document_parts, normal_path
from siftmark.operators.fusion import candidate_pool, collapse, fuse, with_phrase_bonus
from siftmark.operators.lexical import Bm25Index, forward, postings

CHUNKS = "id long, path string, root string, heading_path array<string>, text string"
RANKED = "chunk_id long, score double"


def chunk_frame(spark, rows):
    frame = [(i, f"page-{i}", "somewhere", h, t) for i, h, t in rows]
    return spark.createDataFrame(frame, CHUNKS)


def ids(df):
    return [r.chunk_id for r in df.collect()]


# --- BM25 ---------------------------------------------------------------------


def test_weighted_frequencies_and_lengths(spark):
    rows = [(0, ["Alpha", "Beta"], "## Beta\nbeta gamma"), (1, [], "... !!"), (2, [], "beta")]
    built = {r.chunk_id: r for r in forward(chunk_frame(spark, rows)).collect()}
    assert dict(zip(built[0].terms, built[0].tfs)) == {"alpha": 2.0, "beta": 4.0, "gamma": 1.0}
    assert [built[i].doc_len for i in range(3)] == [7.0, 0.0, 1.0]
    index = Bm25Index.build(chunk_frame(spark, rows))
    assert (len(index), index.term_count(), index.is_empty()) == (3, 3, False)
    assert index.avg_doc_len == pytest.approx(8 / 3)
    assert index.search("beta", 0).collect() == [] and index.search("nope", 3).collect() == []


def brute_bm25(texts, query, k):
    docs = [Counter(map(stem_token, t.lower().split())) for t in texts]
    avg = sum(sum(d.values()) for d in docs) / len(docs)
    scores = defaultdict(float)
    for term in map(stem_token, query.lower().split()):
        n = sum(term in d for d in docs)
        idf = math.log(1 + (len(docs) - n + 0.5) / (n + 0.5))
        for i, d in enumerate(docs):
            if term in d:
                norm = 1.2 * (0.25 + 0.75 * sum(d.values()) / avg)
                scores[i] += idf * d[term] * 2.2 / (d[term] + norm)
    return sorted(((i, round(s, 9)) for i, s in scores.items()), key=lambda x: (-x[1], x[0]))[:k]


@pytest.mark.parametrize("inverted", [True, False])
def test_bm25_equals_brute_force(spark, inverted):
    rng = random.Random(5)
    vocab = ["run", "running", "runs", "tide", "tides", "alpha", "beta", "the", "the", "the"]
    texts = [" ".join(rng.choices(vocab, k=rng.randint(1, 30))) for _ in range(120)]
    frame = chunk_frame(spark, [(i, [], t) for i, t in enumerate(texts)])
    index = Bm25Index.build(frame, inverted=inverted)
    for query in ("the", "running tide", "the alpha the the beta", "tides tide"):
        found = [(r.chunk_id, r.score) for r in index.search(query, 25).collect()]
        expected = brute_bm25(texts, query, 25)
        assert [i for i, _ in found] == [i for i, _ in expected]
        assert [s for _, s in found] == pytest.approx([s for _, s in expected], abs=1e-8)
    frequency = Counter(r.term for r in index.postings().collect())
    assert {r.term: r.df for r in index.terms.collect()} == frequency
    assert index.frequencies(["tide", "the", "unseen"]) == {t: frequency[t] for t in ("tide", "the")}
    terms = {(r.term, r.chunk_id): (r.tf, r.doc_len) for r in index.postings().collect()}
    assert terms == {
        (r.term, r.chunk_id): (r.tf, r.doc_len) for r in postings(index.forward).collect()
    }


def test_very_large_k_is_numbered_in_parallel(spark, monkeypatch):
    frame = chunk_frame(spark, [(i, [], "tide " * (i % 9 + 1)) for i in range(60)])
    index = Bm25Index.build(frame)
    usual = [tuple(r) for r in index.search("tide", 25).collect()]
    monkeypatch.setattr(ordering, "WINDOW_ROWS", 10)
    monkeypatch.setattr(ordering, "MERGED_ROWS", 10)
    found = [tuple(r) for r in index.search("tide", 25).collect()]
    assert sorted(found, key=lambda r: (-r[1], r[0])) == usual
    ranked = fuse(index.search("tide", 25), index.search("tide", 25), k=25, at_most=25).collect()
    ranked.sort(key=lambda r: (-r.score, r.chunk_id))
    assert [r.chunk_id for r in ranked] == [i for i, _ in usual]
    rows = spark.createDataFrame([(i, 0.1 * (i % 4), f"p{i % 7}") for i in range(40)], RANKED + ", path string")
    for per_page in (0, 2):
        found = collapse(rows, 5, per_page).collect()
        found.sort(key=lambda r: (-r.score, r.chunk_id))
        plain = [(r.chunk_id, r.score, r.path) for r in rows.collect()]
        assert [r.chunk_id for r in found] == sequential_collapse(plain, 5, per_page)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_index_build_and_search_plans(spark):
    frame = chunk_frame(spark, [(i, [], f"word{i % 7} tide") for i in range(50)])
    assert "Exchange" not in plan(forward(frame))
    index = Bm25Index.build(frame)
    found = plan(index.matching(["tide"]))
    assert "PartitionFilters: [isnotnull(bucket" in found and "PushedFilters: [IsNotNull(term)" in found
    assert "TakeOrderedAndProject" in plan(index.search("tide", 3))


# --- dense --------------------------------------------------------------------


def vector_frame(spark, rows):
    return spark.createDataFrame(list(enumerate(rows)), "chunk_id long, embedding array<float>")


def test_vectors(spark):
    (hit,) = VectorIndex.build(vector_frame(spark, [[5.0, 12.0]])).search([5 / 13, 12 / 13], 1).collect()
    assert hit.score == pytest.approx(1, abs=1e-6)
    index = VectorIndex.build(vector_frame(spark, [[0.0, 2.0], [-3.0, 0.0], [2.0, 2.0], [1.0, 7.0]]))
    assert ids(index.search([0.0, 1.0], 3)) == [0, 3, 2]
    last = index.search([1.0, 0.0], 9).collect()[-1]
    assert (last.chunk_id, last.score) == (1, -1.0)
    (zero,) = VectorIndex.build(vector_frame(spark, [[0.0] * 3])).search([0.0, 0.0, 1.0], 1).collect()
    assert (zero.chunk_id, zero.score) == (0, 0.0)
    with pytest.raises(Exception, match="must have 3 components"):
        VectorIndex.build(vector_frame(spark, [[1.0, 2.0]]), dim=3).rows.collect()
    with pytest.raises(ValueError):
        index.search([1.0, 2.0, 3.0], 1)
    empty = VectorIndex.build(vector_frame(spark, [[1.0]]).limit(0))
    assert len(empty) == 0 and empty.is_empty() and empty.search([], 3).collect() == []
    assert len(index) == 4 and not index.is_empty()


def test_dense_search_keeps_only_the_best_rows_per_task(spark):
    index = VectorIndex.build(vector_frame(spark, [[1.0, 0.0]] * 10))
    found = plan(index.search([1.0, 0.0], 3))
    assert "TakeOrderedAndProject" in found and "Exchange" not in found


# --- fusion -------------------------------------------------------------------


def ranked(spark, rows):
    return spark.createDataFrame([(i, float(s)) for i, s in rows], RANKED)


def plain_fusion(lexical, dense, weights, k):
    """Reciprocal ranks of two sorted lists, added up; equal sums by dense score, then id."""
    sums = defaultdict(float)
    for rows, weight in ((lexical, weights.lexical), (dense, weights.dense)):
        for place, (i, _) in enumerate(rows):
            sums[i] += weight / (61 + place)
    score = dict(dense)
    order = sorted(sums, key=lambda i: (-round(sums[i], 9), -score.get(i, -math.inf), i))
    return [(i, round(sums[i], 9)) for i in order[:k]]


@pytest.mark.parametrize("at_most", [100, None])
def test_fusion_of_random_lists(spark, at_most):
    draw = random.Random(17)
    for k, weights in ((60, Weights()), (7, Weights(0.25, 1.5)), (1, Weights(2.0, 0.0))):
        lists = []
        for n in (draw.randrange(25), draw.randrange(25)):
            rows = [(i, draw.randrange(6)) for i in draw.sample(range(40), n)]
            lists.append(sorted(rows, key=lambda r: (-r[1], r[0])))
        found = fuse(
            *(ranked(spark, rows) for rows in lists), weights=weights, k=k, at_most=at_most
        ).collect()
        assert [(r.chunk_id, round(r.score, 9)) for r in found] == plain_fusion(*lists, weights, k)
        for name, rows in zip(("lexical_rank", "dense_rank"), lists, strict=True):
            places = {i: n + 1 for n, (i, _) in enumerate(rows)}
            assert [r[name] for r in found] == [places.get(r.chunk_id) for r in found]


def test_fuse_accepts_given_ranks(spark):
    lists = [
        spark.createDataFrame(rows, RANKED + ", rank long")
        for rows in ([(21, 2.0, 1), (20, 2.0, 2)], [(20, 0.1, 1), (21, 0.1, 2)])
    ]
    out = fuse(*lists).collect()
    assert [r.chunk_id for r in out] == [20, 21] and out[0].score == out[1].score


def test_documents_are_found_by_their_zones(spark, monkeypatch):
    """Of many slabs only those whose range of paths holds the path are opened."""
    monkeypatch.setattr(ordering, "_ROWS_PER_RANGE", 10)
    monkeypatch.setattr(ordering, "_PARTS_PER_SLAB", 1)
    rows = [(root, f"d{i % 7}/p-{i}.md", f"text {root} {i}") for root in ("r1", "r2") for i in range(60)]
    rows += [("r1", "d0", "a folder's name"), ("r2", "d0/p", "x")]
    docs = spark.createDataFrame(rows, "root string, path string, source string")
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    try:
        table = build_chunks(order_documents(docs), Config())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(table.zones) == len(table.offsets) > 4
    for path in ("d3/p-17.md", "./d3//p-17.md", "d0", "d0/p", "d9/none", ""):
        found = document_chunks(table, path)
        plain = document_chunks(table.rows(), path).collect()
        assert found.collect() == plain
    around = table.around("d3\x01p-17.md")
    slabs = {i for i, (low, high) in enumerate(table.zones) if low <= "d3\x01p-17.md" <= high}
    assert 0 < len(slabs) <= 3 < len(table.zones)
    assert around.count() == sum(table.offsets[i][2] for i in slabs)
    assert "PartitionFilters: [isnotnull(_slab" in found._jdf.queryExecution().executedPlan().toString() or (
        "_slab" in around._jdf.queryExecution().executedPlan().toString()
    )


def test_pool_and_bonus(spark):
    assert [candidate_pool(k) for k in (0, 1, 8)] == [1, 4, 32]
    rows = spark.createDataFrame([(1, 0.5, "The Tide"), (2, 0.5, "tide the")], RANKED + ", text string")
    assert [r.score for r in with_phrase_bonus(rows, "THE tide").collect()] == [0.52, 0.5]


def sequential_collapse(rows, k, per_page):
    ordered = sorted(rows, key=lambda r: (-r[1], r[0]))
    if per_page == 0:
        return [r[0] for r in ordered[:k]]
    kept, seen = [], Counter()
    for chunk_id, _, path in ordered:
        if path not in seen and len(seen) == k:
            break
        seen[path] += 1
        if seen[path] <= per_page:
            kept.append(chunk_id)
    return kept


def test_collapse_equals_walking_the_list(spark):
    rng = random.Random(3)
    for case in range(24):
        paths = [f"p{i}" for i in range(rng.randint(1, 6))]
        rows = [
            (i, rng.choice([0.1, 0.2, 0.3]), "p0" if rng.random() < 0.4 else rng.choice(paths))
            for i in range(rng.randint(0, 20))
        ]
        k, per_page = rng.randint(1, 5), case % 4
        out = collapse(spark.createDataFrame(rows, RANKED + ", path string"), k, per_page).collect()
        assert [r.chunk_id for r in out] == sequential_collapse(rows, k, per_page)
        counts = Counter(path for _, _, path in rows)
        assert all(r.chunks_matched == counts[r.path] for r in out)


# --- numbering and lookups ----------------------------------------------------


def test_paths_compare_by_component(spark):
    paths = ["a/b.md", "a-b.md", "a.md", "a/b/c.md", "a/B.md", "A.md", "é.md", "a//b.md", "a/b"]
    frame = spark.createDataFrame([("/r", p) for p in paths], "root string, path string")

    def parts(path):
        return [p for p in path.encode().split(b"/") if p]

    by_array = frame.orderBy(path_components("path"), "path").collect()
    by_key = frame.orderBy(document_order_key(frame), "path").collect()
    expected = sorted(paths, key=lambda p: (parts(p), p))
    assert [r.path for r in by_array] == [r.path for r in by_key] == expected


def test_repeated_keys_are_dealt_over_partitions(spark):
    keys = ["hot"] * 600 + [f"k{i:03}" for i in range(300)]
    frame = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k string, i int")
    placed = ordering.range_partition(frame, F.col("k"), ["i"])
    rows = placed.withColumn("p", F.spark_partition_id()).collect()
    assert sorted(r.i for r in rows) == list(range(900))
    assert [r.k for r in sorted(rows, key=lambda r: r.p)] == sorted(keys)
    assert max(Counter(r.p for r in rows).values()) < 450
    again = ordering.range_partition(frame.repartition(7), F.col("k"), ["i"])
    assert [r.i for r in again.collect()] == [r.i for r in placed.collect()]


def test_numbering_is_dense_and_lookups_exact(spark):
    frame = spark.createDataFrame([(f"k{i:04}",) for i in range(1000)], "k string")
    table = ordering.number_in_place(
        ordering.range_partition(frame, F.col("k"), []), "id", "numbered"
    )
    assert table.count == 1000
    rows = {r.id: r.k for r in table.rows().collect()}
    assert rows == {i: f"k{i:04}" for i in range(1000)}
    wanted = [0, 1, 499, 500, 999, 1000, -1, *range(30, 60)]
    found = {r.id: r.k for r in table.lookup(wanted).collect()}
    assert found == {i: rows[i] for i in wanted if i in rows}
    assert "PushedFilters: [In(_pos" in plan(table.lookup([5, 7]))
    ids_wanted = spark.createDataFrame([(i, f"note {i}") for i in wanted], "i long, note string")
    for at_most in (100, 10**9):
        got = {r.i: (r.k, r.note) for r in table.fetch(ids_wanted, "i", at_most).collect()}
        assert got == {i: (rows[i], f"note {i}") for i in wanted if i in rows}


def test_rank_without_a_bound_equals_the_window(spark):
    rng = random.Random(9)
    rows = [(i, rng.choice([0.1, 0.5, 0.9])) for i in range(500)]
    frame = spark.createDataFrame(rows, RANKED)
    order = [F.desc("score"), F.asc("chunk_id")]
    small = ordering.with_rank(frame, order, "rank", 500).collect()
    large = ordering.with_rank(frame, order, "rank", None).collect()
    assert sorted((r.rank, r.chunk_id) for r in small) == sorted((r.rank, r.chunk_id) for r in large)


def test_document_parts_concatenate_to_the_document(spark):
    rows = [(0, "a.md", "/1", [], "one"), (1, "b.md", "/1", [], "x"), (2, "a.md", "/2", [], "two")]
    chunks = spark.createDataFrame(rows, CHUNKS)
    parts = sorted((r.path, r.id, r.part) for r in document_parts(chunks).collect())
    assert parts == [("a.md", 0, "one"), ("a.md", 2, "\n\ntwo"), ("b.md", 1, "x")]
    assert [r.id for r in document_chunks(chunks, "a.md").collect()] == [0, 2]


def test_normal_path():
    for given, expected in {
        "a//b.md": "a/b.md", "a/./b.md": "a/b.md", "a/b/": "a/b", "/a": "/a", "./a": "./a",
        "a/.b": "a/.b", "a": "a", "": "",
    }.items():
        assert normal_path(given) == expected


def test_tokens_are_counted_in_bounded_steps(spark, monkeypatch):
    import pyarrow as pa

    from siftmark.operators import lexical

    monkeypatch.setattr(lexical, "_STEP_TOKENS", 30)
    kinds = pa.list_(pa.string())
    columns = [pa.array(range(50)), pa.array([["h"]] * 50, kinds), pa.array([["a", "b", "a"]] * 50, kinds)]
    batch = pa.record_batch(columns, ["chunk_id", "heading", "body"])
    steps = list(lexical._steps(batch))
    assert max(s.num_rows for s in steps) * 4 <= 30 + 4
    cut = pa.Table.from_batches([lexical._count_batch(s, False) for s in steps])
    assert cut.to_pylist() == pa.Table.from_batches([lexical._count_batch(batch, False)]).to_pylist()
