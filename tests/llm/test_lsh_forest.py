"""Near-duplicates against all pairs of full shingle sets."""

import random
import re

import numpy as np
import pytest

from siftmark.llm import lsh_forest
from siftmark.llm.lsh_forest import Rule, components, near_duplicates, shingle_sets

WORD = re.compile(r"[^\x20\x09-\x0d]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def shingles(text, words):
    found = WORD.findall((text or "").translate(LOWER))
    if len(found) < words:
        return {tuple(found)} if found else set()
    return {tuple(found[i : i + words]) for i in range(len(found) - words + 1)}


def brute(rows, rule):
    sets = {i: shingles(t, rule.words) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= rule.percent * len(x | y):
                low, high = sorted([find(a), find(b)])
                parent[high] = low
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def result(df):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in df.collect()}


@pytest.mark.parametrize("rule", [Rule(), Rule(5, 80)])
def test_given_documents(spark, rule):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert result(near_duplicates(docs, rule=rule)) == brute(rows, rule)


def test_a_crowd_around_one_text(spark):
    """Copies that are close to one text only, in a region far wider than the window."""
    pick = random.Random(3)
    base = [f"w{pick.randrange(10**6)}" for _ in range(60)]
    rows = [(500, " ".join(base))]
    for i in range(150):
        words = list(base)
        for at in pick.sample(range(60), 1 if i % 3 else 3):
            words[at] = f"v{i}x{at}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(near_duplicates(docs)) == brute(rows, Rule())


@pytest.mark.parametrize("rule", [Rule(), Rule(5, 80)])
def test_links_behind_many_near_misses(spark, rule):
    """Pages of one template, all just under the threshold; a few pairs just above it."""
    pick = random.Random(5)
    part = round(200 * (100 - rule.percent + 2) / (2 * (rule.percent - 2)))
    common = [f"w{pick.randrange(10**6)}" for _ in range(200 + rule.words)]
    tails = [[f"u{i}x{k}" for k in range(part)] for i in range(200)]
    for i in range(0, 48, 2):
        tails[i + 1][:3] = tails[i][:3]
    rows = [(pick.randrange(10**9), " ".join(common + t)) for t in tails]
    wanted = brute(rows, rule)
    assert sum(not kept for _, _, kept in wanted.values()) == 24
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(near_duplicates(docs, rule=rule)) == wanted


def test_odd_rows(spark, odd_docs, no_docs):
    docs = odd_docs.where("doc_id is not null")
    rows = near_duplicates(docs).collect()
    assert len(rows) == 8
    wanted = brute([(r.doc_id, r.text) for r in docs.collect()], Rule())
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in rows} == wanted
    assert near_duplicates(odd_docs).count() == 8  # a row without an id is left out
    assert near_duplicates(no_docs).count() == 0


def test_case_blanks_and_short_texts(spark):
    rows = [
        (1, "A b"), (2, "a\x0b B"), (3, "a b c"), (4, "A b"), (5, "É x y z"),
        (6, "é x y z"), (7, "word"), (8, "WORD "),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(near_duplicates(docs)) == brute(rows, Rule())


def test_shingle_sets_hold_whole_texts():
    texts = ["x " * 9000 + "end of it", "y" * 10_000, "", "a b c d"]
    made, starts = shingle_sets(texts, 3)
    assert np.diff(starts).tolist() == [len(shingles(t, 3)) for t in texts]


def test_components_of_a_chain_and_a_hub(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, 101 + i) for i in range(50)] + [(200, 201)]
    df = spark.createDataFrame(links, "a long, b long")
    found = {r.id: r.comp for r in components(df).collect()}
    assert found == {i: 0 if i < 100 else 100 if i < 200 else 200 for i in found}
    assert len(found) == 61 + 51 + 2
    assert components(df.limit(0)).count() == 0


def test_tree_edges_between_partitions(spark, monkeypatch):
    """Very small partitions: neighbours across their borders are found too."""
    monkeypatch.setattr(lsh_forest, "ROWS_EACH", 40)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert result(near_duplicates(docs)) == brute(rows, Rule())


def test_texts_among_keeps_all_that_are_asked_for(spark, monkeypatch):
    texts = spark.range(5000).selectExpr("id", "concat('t', id) as text")
    ids = texts.where("id % 7 = 0").select("id")
    wanted = {r.id for r in ids.collect()}
    for bits in (1 << 26, 1 << 10):  # also when the filter is far too small
        monkeypatch.setattr(lsh_forest, "FILTER_BITS", bits)
        kept = {r.id: r.text for r in lsh_forest.texts_among(texts, ids).collect()}
        assert wanted <= kept.keys() and all(t == f"t{i}" for i, t in kept.items())
        assert bits == 1 << 10 or len(kept) - len(wanted) < 0.08 * 5000
    assert lsh_forest.texts_among(texts, ids.limit(0)).count() == 0


def test_prefixes_meet_if_sets_are_similar():
    """Similar sets share an early token of the smaller within the prefix of the larger."""
    draw = np.random.default_rng(6)
    for percent in (80, 85):
        met = 0
        for _ in range(300):
            base = draw.integers(0, 2**63, draw.integers(1, 80)).astype(np.uint64)
            sets = []
            for _ in range(2):
                kept = base[draw.random(len(base)) > 0.03]
                own = draw.integers(0, 2**63, draw.integers(0, 3)).astype(np.uint64)
                sets.append(np.unique(np.r_[kept, own, base[:1]]))
            sets.sort(key=len)
            made, starts = np.concatenate(sets), np.cumsum([0] + [len(x) for x in sets])
            counts = np.full(lsh_forest.COUNTS, 2, np.int64)
            counts[draw.integers(0, lsh_forest.COUNTS, lsh_forest.COUNTS // 2)] = 9
            token, owner, place, early = lsh_forest.prefixes(made, starts, counts, percent)
            shared = len(np.intersect1d(*sets))
            if 100 * shared >= percent * (len(sets[0]) + len(sets[1]) - shared):
                met += 1
                small = {t: p for t, o, p, e in zip(token.tolist(), owner.tolist(), place.tolist(), early.tolist(), strict=True) if o == 0 and e}
                large = {t: p for t, o, p in zip(token.tolist(), owner.tolist(), place.tolist(), strict=True) if o == 1}
                common = small.keys() & large.keys()
                assert common
                first = min(common, key=small.get)
                room = min(len(sets[0]) - small[first], len(sets[1]) - large[first])
                assert (100 + percent) * room >= percent * (len(sets[0]) + len(sets[1]))
        assert met > 50


@pytest.mark.parametrize("blocks", [(1_000, 400), (7, 3)])
def test_crowds_in_blocks(spark, monkeypatch, blocks):
    """Many near misses without a hub, and links between components, cut into small blocks."""
    monkeypatch.setattr(lsh_forest, "MAIN_EACH", blocks[0])
    monkeypatch.setattr(lsh_forest, "OTHERS_EACH", blocks[1])
    pick = random.Random(9)
    base = [f"w{pick.randrange(10**6)}" for _ in range(120)]
    rows = []
    for i in range(160):
        words = list(base)
        for at in pick.sample(range(120), pick.randrange(1, 5)):
            words[at] = f"v{pick.randrange(10**6)}"
        rows.append((1000 - i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(near_duplicates(docs)) == brute(rows, Rule())
