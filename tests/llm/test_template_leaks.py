"""Decontamination: planted leaks, slot checks, and all items against all texts."""

import pytest

from siftmark.llm.template_leaks import find_leaks

QUESTION = (
    "A train leaves Paris at 60 km per hour and Alice walks 5 miles while Alice eats 3 apples. "
    "How many apples does Alice have left after 5 miles?"
)


@pytest.fixture(scope="module")
def bench(spark):
    rows = [(7, QUESTION), (8, "too short"), (9, None), (10, "")]
    return spark.createDataFrame(rows, "item_id long, text string")


def leaks(spark, bench, text):
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    return [(x.item_id, x.kind) for x in find_leaks(docs, bench).first().leaks]


def test_exact_and_reparameterised(spark, bench):
    other = QUESTION.replace("Paris", "Rome").replace("60", "75").replace("Alice", "Bob")
    other = other.replace("5 miles", "9 miles").replace(" 3 ", " 4 ")
    assert leaks(spark, bench, f"Before it. {QUESTION} After it.") == [(7, "exact")]
    assert leaks(spark, bench, f"Before it. {other} After it.") == [(7, "reparameterised")]
    assert leaks(spark, bench, QUESTION.lower().replace("paris", "Paris")) != []


def test_slots_must_agree(spark, bench):
    mixed = QUESTION
    for name, unit in (("Bob", "7 miles"), ("Carl", "8 miles"), ("Dan", "9 miles")):
        mixed = mixed.replace("Alice", name, 1).replace("5 miles", unit, 1)
    assert leaks(spark, bench, mixed) == []


def test_fragments_and_clean_texts(spark, bench):
    assert leaks(spark, bench, "We saw that A train leaves Paris at 60 km today.") == []
    assert leaks(spark, bench, "1 2 3 4 5 6 7 8 9 10 11 12") == []


def test_given_tables_and_blocks(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    bench = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    items = [r.text for r in bench.collect()]
    wanted = {r.doc_id for r in docs.collect() if any(i in r.text for i in items)}
    found = {r.doc_id for r in find_leaks(docs, bench).where("size(leaks) > 0").collect()}
    assert found == wanted
    blocked = find_leaks(docs, bench, block_items=7).where("size(leaks) > 0").collect()
    assert {r.doc_id for r in blocked} == wanted


def test_odd_rows(spark, odd_docs, no_docs, bench):
    rows = find_leaks(odd_docs, bench).collect()
    assert len(rows) == 9 and all(r.leaks == [] for r in rows)
    assert find_leaks(no_docs, bench).count() == 0
    assert all(r.leaks == [] for r in find_leaks(odd_docs, bench.limit(0)).collect())


def test_exact_copies_of_any_item(spark):
    """Numbers, names, short items and long verbatim parts, in running text."""
    long = " ".join(f"word{i % 23}of{i}" for i in range(59))
    items = {
        1: "What is 12 x 7 + 30 / 4 - 18 ?",
        2: "3 17 22 91 4 8 15 16 23 42 108 77 65 31 9",
        3: "Choose: Alice, Bob, Carol. Dave, Erin, Frank. Grace, Heidi, Ivan.",
        4: "Solve for x",
        5: "Why?",
        6: long,
    }
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    copies = [(i, f"Some text before it. {t} And more after it.") for i, t in items.items()]
    copies.append((7, "As it says " + " ".join(long.split()[20:49]) + " and so on."))
    copies += [(8, "Nobody knows why? it is so."), (9, "Solve it for her, 12 x 7 times, 4 8 15 16.")]
    copies += [(10, "As it says " + " ".join(long.split()[20:32]) + " and so on.")]
    copies += [(11, "Before it. What is 13 x 9 + 41 / 6 - 25 ? After it.")]
    docs = spark.createDataFrame(copies, "doc_id long, text string")
    found = {r.doc_id: [(x.item_id, x.kind) for x in r.leaks] for r in find_leaks(docs, bench).collect()}
    wanted = {i: [(i, "exact")] for i in items} | {7: [(6, "exact")], 8: [], 9: [], 10: []}
    assert found == wanted | {11: [(1, "reparameterised")]}
