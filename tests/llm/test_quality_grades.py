"""Ordinal regression: gradients of its fit by results, held-out accuracy, odd rows."""

import numpy as np
import pytest

from siftmark.llm import quality_grades as X
from siftmark.llm.queries import op9_quality_grades

SF = "/root/testdata/sf0.01"


def test_three_grades_are_told_apart():
    texts, grades = [], []
    for i in range(90):
        grade = i % 3
        words = [f"w{i}x{k}" for k in range(30)] + ["awful", "plain", "great"][grade : grade + 1] * 8
        texts.append(" ".join(words))
        grades.append(grade)
    model = X.fit_rows(X._rows(texts), grades)
    assert list(model.thresholds) == sorted(model.thresholds)
    score = X._scorer(model)(["awful " * 9, "plain " * 9, "great " * 9])
    assert list(score) == sorted(score)
    assert [int((s > model.thresholds).sum()) for s in score] == [0, 1, 2]


def test_held_out_accuracy(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = op9_quality_grades(spark, SF).where("held_out").join(labels, "doc_id").collect()
    assert len(rows) > 50
    assert np.mean([r.kept == (r.quality == 1) for r in rows]) >= 0.93
    assert np.mean([r.kept for r in rows if r.quality == 1]) >= 0.95
    assert all(r.p_readable >= r.p_good for r in rows)
    assert all(r.expected_grade == pytest.approx(r.p_readable + r.p_good) for r in rows)


def test_odd_rows_and_labels(spark, odd_docs, no_docs):
    docs = odd_docs.where("doc_id is not null").drop("label")
    labels = spark.createDataFrame([(4, 2), (4, 1), (6, 0), (7, None)], "doc_id long, label int")
    model = X.fit(docs, labels)
    rows = X.grade_documents(docs, model).collect()
    assert len(rows) == 8 and len({r.expected_grade for r in rows if r.doc_id == 4}) == 1
    assert len({r.expected_grade for r in rows if not (r.text or "").strip()}) == 1
    assert X.grade_documents(no_docs, model).count() == 0
    constant = X.fit(docs, labels.limit(0))
    assert len({r.expected_grade for r in X.grade_documents(docs, constant).collect()}) == 1


def plain_score(text, model):
    """Weights of the words' buckets, averaged, and of the measures of the text."""
    words = text.split()
    total = sum(float(model.weights[b]) for w in words for b in X.word_buckets(w)) / max(1, len(words))
    return total + sum(float(model.weights[X.BUCKETS + i]) * m for i, m in enumerate(X.measures(text, words)))


def test_scorer_equals_the_plain_sum():
    draw = np.random.default_rng(2)
    model = X.OrdinalModel(draw.normal(size=X.BUCKETS + X.MEASURES), np.array([0.0, 1.0]))
    texts = ["", "one", "one one Two", "é中 #$ 12", "word " * 5000, *[" ".join(draw.choice(list("abcdef"), 9)) for _ in range(20)]]
    wanted = [plain_score(t, model) for t in texts]
    assert X._scorer(model)(texts) == pytest.approx(wanted)
    # The sparse rows that the fit sees hold the same features.
    kind = np.dtype([("f", "<i4"), ("v", "<f4")])
    rows = [np.frombuffer(r, kind) for r in X._rows(texts)]
    assert [float(r["v"] @ model.weights[r["f"]]) for r in rows] == pytest.approx(wanted, abs=1e-4)


def test_first_step_follows_the_numeric_gradient(monkeypatch):
    """One step of the fit moves every parameter by the sign of its derivative."""
    draw = np.random.default_rng(3)
    texts = [" ".join(draw.choice([f"w{i}" for i in range(12)], 15)) for _ in range(40)]
    grades = [int(g) for g in draw.integers(0, 4, 40)]
    rows = X._rows(texts)
    kind = np.dtype([("f", "<i4"), ("v", "<f4")])
    flat = [np.frombuffer(r, kind) for r in rows]
    size = X.BUCKETS + X.MEASURES
    square = sum(np.bincount(r["f"], r["v"].astype(float) ** 2, size) for r in flat) / len(flat)
    scale = np.where(square > 0, 1 / np.maximum(np.sqrt(square), 0.02), 0.0)

    def likelihood(w, cuts):
        thresholds = [cuts[0]]
        for c in cuts[1:]:
            thresholds.append(thresholds[-1] + np.exp(c))
        total = 0.0
        for r, g in zip(flat, grades, strict=True):
            z = sum(float(v) * scale[f] * w[f] for f, v in r)
            above = [1.0, *(1 / (1 + np.exp(-(z - t))) for t in thresholds), 0.0]
            total += np.log(above[g] - above[g + 1])
        return total / len(flat) - X.PENALTY * float(w @ w) / 2

    monkeypatch.setattr(X, "STEPS", 1)
    model = X.fit_rows(rows, grades)
    share = [np.mean([g > t for g in grades]) for t in range(3)]
    start = [-np.log(s / (1 - s)) for s in share]
    cuts = np.array([start[0], np.log(start[1] - start[0]), np.log(start[2] - start[1])])
    used = np.flatnonzero(square)
    for f in used[draw.permutation(len(used))[:25]].tolist():
        w = np.zeros(size)
        w[f] = 1e-5
        up = likelihood(w, cuts)
        w[f] = -1e-5
        slope = (up - likelihood(w, cuts)) / 2e-5
        if abs(slope) > 1e-6:
            assert np.sign(model.weights[f]) == np.sign(slope)
    moved = np.log(np.diff(model.thresholds))
    new = [model.thresholds[0], *moved]
    for i in range(3):
        ends = [cuts.copy(), cuts.copy()]
        ends[0][i] += 1e-5
        ends[1][i] -= 1e-5
        slope = (likelihood(np.zeros(size), ends[0]) - likelihood(np.zeros(size), ends[1])) / 2e-5
        if abs(slope) > 1e-6:
            assert np.sign(new[i] - cuts[i]) == np.sign(slope)
