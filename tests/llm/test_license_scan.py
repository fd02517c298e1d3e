"""Licence scan: every template found, prose left alone, all lines of the given texts."""

from siftmark.llm.license_scan import TEMPLATES, scan

LINES = {
    "Released under the MIT License.": "mit",
    "This work is licensed under the GNU General Public License, version 3.": "gpl",
    "Licensed under the Apache License, Version 2.0.": "apache-2.0",
    "Licensed under CC BY-NC 4.0.": "cc-by-nc",
    "All rights reserved.": "proprietary",
}
PROSE = [
    "He lost his license on the way to the public library.",
    "Permission to speak freely is granted to all guests.",
    "The software version was free of errors without any warranty claims this year.",
    "Mit dem Rad fuhr er zur Arbeit.",
]


def test_templates_and_prose(spark):
    notices = [(t, f) for f in TEMPLATES for t in TEMPLATES[f]]
    texts = [f"Some words.\n{t}\nMore words." for t, _ in notices] + PROSE
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: (r.paragraph, r.family) for r in scan(docs).where("confirmed").collect()}
    assert found == {i: (1, f) for i, (_, f) in enumerate(notices)}


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    wanted = sorted(
        (r.doc_id, n, LINES[line])
        for r in docs.collect()
        for n, line in enumerate(r.text.split("\n"))
        if line in LINES
    )
    found = scan(docs).collect()
    assert sorted((r.doc_id, r.paragraph, r.family) for r in found if r.confirmed) == wanted


def test_odd_rows(spark, odd_docs, no_docs):
    notice = spark.createDataFrame([(9, "MIT\nReleased under the MIT License.")], "doc_id long, text string")
    docs = odd_docs.unionByName(notice.union(notice), allowMissingColumns=True)
    rows = sorted((r.doc_id, r.paragraph, r.family) for r in scan(docs).collect())
    assert rows == [(9, 0, "mit")] * 2 + [(9, 1, "mit")] * 2  # a name alone is a notice too
    assert scan(no_docs).count() == 0


NOTICES = {
    "License: MIT": "mit", "License: BSD": "bsd", "MIT": "mit", "CC0": "public-domain", "AGPL": "agpl",
    "SPDX-License-Identifier: MIT": "mit", "SPDX-License-Identifier: Apache-2.0": "apache-2.0",
    "License: GPL-3.0-or-later": "gpl", "This code is MIT licensed.": "mit",
    "GNU General Public License v2": "gpl", "Apache License 2.0": "apache-2.0",
    "Mozilla Public License 2.0": "mpl-2.0", "GNU Affero General Public License": "agpl",
    "GNU Lesser General Public License": "lgpl", "License: CC BY-SA 4.0": "cc-by-sa",
    "CC BY-NC 4.0": "cc-by-nc", "CC BY 4.0": "cc-by", "// SPDX-License-Identifier: BSD-3-Clause": "bsd",
}
NO_NOTICES = [
    "License: ISC", "EUPL-1.2", "SPDX-License-Identifier: EUPL-1.2", "ISC", "Mit dem Rad.", "mit ihm",
    "Komm mit nach Hause!", "The lesser evil", "An apache helicopter landed", "license 2 0", "cc me",
    "The license costs 20 euros.", "Mozilla released a browser", "public library", "Version 2.0",
]


def test_short_notices(spark):
    texts = [*NOTICES, *NO_NOTICES]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {texts[r.doc_id]: (r.family, r.confirmed) for r in scan(docs).collect()}
    assert {t: f for t, (f, _) in found.items() if t in NOTICES} == NOTICES
    assert all(found[t][1] for t in NOTICES)
    assert [t for t in NO_NOTICES if t in found and found[t][1]] == []
    assert [t for t in NO_NOTICES if t in found] == []


def test_features_equal_plain_ones(spark):
    from pyspark.sql import functions as F

    from siftmark.llm import license_scan as L

    texts = [t for texts in TEMPLATES.values() for t in texts] + [*NOTICES, *NO_NOTICES, *PROSE, "a", "x y"]

    def plain(words):
        made = {" ".join(words[i : i + n]) for n in (2, 3) for i in range(len(words) - n + 1)}
        if len(words) <= L.SHORT:
            made |= {"=" + w for w in words if w in L.NAME_WORDS}
            foreign = min(3, len(set(words) - set(L._KNOWN_WORDS)))
            made |= {f"+{foreign}"} if foreign else set()
        return made

    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("w", L.words_of(F.col("t")))
    for r in df.withColumn("f", L.features_of(F.col("w"))).collect():
        assert r.w == L._split(r.t)
        assert len(r.f) == len(set(r.f)) and set(r.f) == plain(r.w)


def test_every_paragraph_is_counted(spark, monkeypatch):
    from siftmark.llm import license_scan as L

    kept, write = {}, L.materialize
    monkeypatch.setattr(L, "materialize", lambda df, name: kept.setdefault(name, write(df, name)))
    lines = ["one two three four five six seven eight nine ten eleven", "MIT", "Released under the MIT License."]
    texts = [(i, "\n".join(lines[: 2 + (i == 7)])) for i in range(3000)]
    found = scan(spark.createDataFrame(texts, "doc_id long, text string"))
    assert found.where("confirmed AND paragraph = 2").count() == 1
    counted = {tuple(r.features): r.n for r in kept["license_unknown"].collect()}
    assert counted == {(): 3000, ("=mit",): 3000}
