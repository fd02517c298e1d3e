"""URL rules on a small corpus with signal, against the SQL statement and by hand."""

import itertools
import random

import duckdb
import pytest

from siftmark.llm import url_rules as X
from siftmark.llm.oracles import URL_RULES


@pytest.fixture(scope="module")
def corpus():
    pick = random.Random(2)
    pages, labels = [], []
    for i in range(400):
        host = pick.choice(["a.spam.com", "b.good.com", "news.org", "shop.net", "c.spam.com"])
        path = pick.choice(["/en/buy", "/en/read", "/fr/read", "/de/x-y"])
        url = f"http{pick.choice(['', 's'])}://{host}{path}/{i}" + pick.choice(["", "?utm=1&b", "#top", ".html"])
        bad = ("spam" in host and "buy" in path) or ("fr" in path and pick.random() < 0.7)
        pages.append((i, url))
        if i % 3:
            labels.append((i, int(not bad), 0))
    odd = [None, "", "no scheme", "http://", "HTTP://WWW.Example.NET", "x://Y.example.net/en/a?b#c",
           "http://a.org/fr/1/", "http://example.com/de/", "http://fexample.com/de/", "http://net/z://q"]
    pages += [(1000 + i, u) for i, u in enumerate(odd)] + [(2000, None), (5, pages[5][1])]
    labels += [(7, None, None), (8, None, 1), (10, 1, None)]
    return pages, labels


def test_against_sql(spark, corpus):
    pages, labels = corpus
    p = spark.createDataFrame(pages, "page_id long, url string")
    p = p.selectExpr("*", "url as host", "url as path", "url as rule", "url as tokens")
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    rows = X.judge_urls(p, X.labels_by_number(p, known)).drop("url").collect()
    db = duckdb.connect()
    db.sql("create table pages (page_id bigint, url varchar)")
    db.sql("create table labels (doc_id bigint, quality int, toxic int)")
    db.executemany("insert into pages values (?, ?)", pages)
    db.executemany("insert into labels values (?, ?, ?)", labels)
    wanted = db.sql(URL_RULES)
    at = [wanted.columns.index(c) for c in rows[0].asDict()]
    assert sorted(map(repr, map(tuple, rows))) == sorted(
        repr(tuple(r[i] for i in at)) for r in wanted.fetchall()
    )
    mined = {r.mined_rule for r in rows} - {None}
    assert any("spam" in m and "p:buy" in m for m in mined) and "p:fr" in mined
    by_id = {r.page_id: r for r in rows}
    assert (by_id[1000].host, by_id[1000].path, by_id[1000].verdict) == ("", "", "allow")
    assert by_id[1004].host == "www.example.net" and by_id[1004].rule is None
    assert by_id[1005].rule == "example.net/en/" and by_id[1005].verdict == "allow"
    assert by_id[1007].rule == "example.com/de/" and by_id[1008].rule is None
    assert by_id[1009].rule == "net/" and by_id[1009].path == "/z://q"


def test_mined_rules_by_hand(spark, corpus):
    pages, labels = corpus
    p = spark.createDataFrame(pages, "page_id long, url string")
    known = X.labels_by_number(p, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    rows = [(set(r.tokens), r.bad) for r in known.where("bad is not null").collect() if r.tokens]
    limits, base = X.Limits(), sum(b for _, b in rows) / len(rows)
    found = {}
    for k in range(1, limits.longest + 1):
        sets = {c for tokens, _ in rows for c in itertools.combinations(sorted(tokens), k)}
        for c in sets:
            hits = [b for tokens, b in rows if tokens.issuperset(c)]
            sure = sum(hits) / len(hits)
            if (len(hits) >= limits.min_count and sum(hits) >= limits.min_support * len(rows)
                    and sure >= max(limits.min_confidence, limits.min_lift * base)):
                found[c] = sure
    kept = {
        c: s
        for c, s in found.items()
        if not any(set(d) < set(c) and found[d] >= s for d in found)
    }
    assert {tuple(r.tokens): r.confidence for r in X.mine_rules(known).collect()} == kept


def test_no_labels_and_no_pages(spark, corpus):
    p = spark.createDataFrame(corpus[0], "page_id long, url string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = X.judge_urls(p, X.labels_by_number(p, none)).collect()
    assert len(rows) == len(corpus[0]) and all(r.mined_rule is None for r in rows)
    assert X.judge_urls(p.limit(0), X.labels_by_number(p, none)).count() == 0
