"""Every registered query against its SQL oracle on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry

SF_DIR = "/root/testdata/sf0.001"
TABLES = "documents embeddings conversations benchmark labels pages".split()


@pytest.fixture(scope="module")
def oracle():
    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"CREATE VIEW {name} AS FROM read_parquet('{SF_DIR}/{name}.parquet')")
    return connection


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 8 and rows[0].score >= rows[-1].score


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, oracle, name):
    found = entry.queries()[name](spark, SF_DIR)
    columns = sorted(found.columns)
    rows = sorted(repr([row[c] for c in columns]) for row in found.collect())
    assert rows
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return
    expected = oracle.sql(sql)
    assert sorted(expected.columns) == columns
    places = [expected.columns.index(c) for c in columns]
    assert rows == sorted(repr([row[i] for i in places]) for row in expected.fetchall())


def test_bm25_postings_has_a_row_per_posting(spark, oracle):
    found = entry.queries()["bm25_postings"](spark, SF_DIR)
    assert found.columns == ["term", "chunk_id", "tf", "doc_len"]
    assert found.count() == found.select("term", "chunk_id").distinct().count()
    sql = entry.oracle_sql()["bm25_postings"]
    terms = oracle.sql(f"SELECT term, count(*) FROM ({sql}) GROUP BY term").fetchall()
    assert {r.term: r["count"] for r in found.groupBy("term").count().collect()} == dict(terms)
