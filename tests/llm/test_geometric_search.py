"""Ranked search against scoring every document."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from siftmark.llm import geometric_search as g


def plain(docs, items, k):
    """(item, rank, doc, score), every document scored for every query."""
    counted = [(i, Counter(g.terms(t))) for i, t in docs]
    counted = [(i, c) for i, c in counted if c]
    total = sum(c.total() for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        scored = []
        for doc, count in counted:
            m = 25 + 75 * count.total() * len(counted) // total
            score = sum(
                times * math.floor(1000 * math.log((2 * len(counted) + 2) / (2 * df[t] + 1)))
                * (10**9 * count[t] // (1000 * count[t] + 8 * m))
                for t, times in Counter(g.terms(text)).items()
            )
            if score > 0:
                scored.append((doc, score))
        scored.sort(key=lambda r: (-r[1], r[0] is not None, r[0]))
        out += [(item, i + 1, *r) for i, r in enumerate(scored[:k])]
    return sorted(out, key=repr)


def found(spark, docs, items, k=10):
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    q = spark.createDataFrame(items, "item_id long, text string")
    return sorted([tuple(r) for r in g.rank(d, q, k).collect()], key=repr)


def corpus(n, seed):
    """Topics with words of their own, common words, near copies and repeats."""
    draw = random.Random(seed)
    docs = []
    for i in range(n):
        topic = draw.randrange(8)
        words = [f"t{topic}w{int(draw.random() ** 2 * 30)}" for _ in range(draw.randrange(3, 40))]
        words += draw.choices(["the", "and", "of"], k=draw.randrange(30))
        docs.append((i, " ".join(words)))
    return docs + [(n + i, t) for i, (_, t) in enumerate(docs[: n // 10])] + docs[:5]


@pytest.mark.parametrize("k", [1, 10])
def test_equals_scoring_everything(spark, k, monkeypatch):
    for name, value in {"SHARD_DOCS": 100, "BLOCK": 8, "TERMS_EACH": 60, "CHARACTERS_EACH": 600}.items():
        monkeypatch.setattr(g, name, value)
    docs = corpus(600, 1)
    draw = random.Random(2)
    items = [(i, " ".join(draw.choices(docs[draw.randrange(600)][1].split(), k=8))) for i in range(25)]
    items += [(3, "the the of"), (7, "no such word"), (8, None), (None, "T1W1, t1w2!"), (3, "the the of")]
    assert found(spark, docs, items, k) == plain(docs, items, k)


def test_blocks_are_skipped_and_bounds_hold():
    docs = corpus(3000, 3)
    queries = g.Queries.of([0, 1], [Counter(g.terms(t)) for t in ("t1w29 t1w28 the", "t2w3 t3w3 t4w3")])
    at = {t: i for i, t in enumerate(queries.vocabulary)}
    rows = [{at[t]: 1000 * n for t, n in Counter(g.terms(t)).items() if t in at} for _, t in docs]
    ptr = np.cumsum([0] + [len(r) for r in rows])
    cols = np.array([t for r in rows for t in sorted(r)])
    impacts = np.array([r[t] for r in rows for t in sorted(r)])
    partners = queries.partners()
    shard = g.build_shard(ptr, cols, impacts, partners)
    for t, p in enumerate(partners):
        members = []
        for b in range(shard.lists[t], shard.lists[t + 1]):
            docs_of = shard.members[shard.blocks[b] : shard.blocks[b + 1]].tolist()
            members += docs_of
            at_row = shard.rows[t] + (b - shard.lists[t]) * len(p)
            top = shard.maxima[at_row : at_row + len(p)]
            for j, other in enumerate(p.tolist()):
                true = max(rows[d].get(other, 0) for d in docs_of)
                assert true <= int(top[j]) * g.GRAIN < true + g.GRAIN
        assert sorted(members) == [d for d, r in enumerate(rows) if t in r]
    import pyarrow as pa

    weights = [np.full(len(ids), 50, np.int64) for ids in queries.terms]
    places = [[np.searchsorted(partners[t], ids) for t in ids.tolist()] for ids in queries.terms]
    best = [g._Best(3, 1) for _ in queries.terms]
    opened = g.search_shard(shard, pa.array(range(len(docs))), queries, weights, places, best, False)
    assert opened < len(shard.blocks) // 2
    for q, ids in enumerate(queries.terms):
        scores = sorted((-sum(50 * r.get(t, 0) for t in ids.tolist()), d) for d, r in enumerate(rows))
        assert [(-s, d) for s, d in scores[:3]] == best[q].rows


def test_odd_rows(spark, odd_docs, no_docs):
    items = [(1, "sentence words text"), (2, "word"), (3, ""), (4, "É 中文")]
    q = spark.createDataFrame(items, "item_id long, text string")
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    got = sorted([tuple(r) for r in g.rank(odd_docs, q).collect()], key=repr)
    assert got == plain(rows, items, 10)
    assert g.rank(no_docs, q).count() == 0
    assert g.rank(odd_docs, q.limit(0)).count() == 0
