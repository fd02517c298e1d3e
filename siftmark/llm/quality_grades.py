"""Ordinal quality model: cumulative-link regression on graded ratings.

Hashed words and word shapes share one weight vector; ordered thresholds cut its score
into grades: P(grade > g) = sigmoid(score - threshold_g). The document's score is the
mean of its words' weights plus weights of a few whole-text measures, so texts of any
length are read whole and a word's weight is computed once per worker.

The model is fitted on the labelled rows with the smallest hashes, at most
``MOST_ROWS`` of them; scoring covers every row. Null and empty texts score as texts
without words. Rows with a null grade are not trained on. Repeated rows get equal
scores. Fewer than two grades among the labels give a constant model.
"""

from __future__ import annotations

import math
import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WordCache, append_columns, labelled_sample, texts_of

#: Labelled documents a fit uses at most.
MOST_ROWS = 6000
BUCKETS = 1 << 14
STEPS = 300
RATE = 0.05
PENALTY = 1e-4
MEASURES = 6


class OrdinalModel(NamedTuple):
    weights: np.ndarray  # of the buckets, then of the measures
    thresholds: np.ndarray  # rising, one fewer than grades


def _shape(word: str) -> str:
    """Letters as x or X, digits as 0, other characters as they are; runs cut to two."""
    out: list[str] = []
    for c in word:
        kind = ("X" if c.isupper() else "x") if c.isalpha() else "0" if c.isdigit() else c
        if out[-2:] != [kind, kind]:
            out.append(kind)
    return "".join(out)


def word_buckets(word: str) -> tuple[int, int]:
    """Buckets of a word and of its shape."""
    return (
        zlib.crc32(("w" + word.lower()).encode()) % BUCKETS,
        zlib.crc32(("s" + _shape(word)).encode()) % BUCKETS,
    )


def measures(text: str, words: list[str]) -> list[float]:
    """Whole-text measures, each within about 0 to 1."""
    n = len(words)
    if not n:
        return [1.0] + [0.0] * (MEASURES - 1)
    letters = max(1, len(text))
    again = sum(map(str.__eq__, words, words[1:]))
    return [
        0.0,
        min(1.0, math.log1p(n) / 10),
        len(set(words)) / n,
        again / n,
        sum(map(text.count, "#*$%&|<>!")) / letters,
        min(1.0, letters / n / 20),
    ]


def _rows(texts: list[str]) -> list[bytes]:
    """Sparse features of each text: (bucket, value) pairs, then the measures."""
    kind = np.dtype([("f", "<i4"), ("v", "<f4")])
    out, known = [], {}
    for text in texts:
        words = text.split()
        found: list[int] = []
        for w in words:
            if w not in known:
                known[w] = word_buckets(w)
            found += known[w]
        buckets, counts = np.unique(np.array(found, np.int64), return_counts=True)
        row = np.zeros(len(buckets) + MEASURES, kind)
        row["f"] = np.r_[buckets, BUCKETS + np.arange(MEASURES)]
        row["v"] = np.r_[counts / max(1, len(words)), measures(text, words)]
        out.append(row.tobytes())
    return out


def fit(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    most: int = MOST_ROWS,
) -> OrdinalModel:
    """Fit on at most ``most`` labelled rows, those with the smallest hash of the key.

    ``labels`` has the key and ``label``, grades from 0 up.
    """

    def make():
        return lambda column: [pa.array(_rows(texts_of(column)), pa.binary())]

    taken = labelled_sample(docs, labels, key, text, most)
    sparse = append_columns(taken, "text", [("x", T.BinaryType())], make).select("x", "label")
    held = sparse.toArrow()  # bounded by ``most`` rows
    return fit_rows(held["x"].to_pylist(), held["label"].to_pylist())


def fit_rows(rows: list[bytes], grades: list[int]) -> OrdinalModel:
    """Maximum likelihood with an L2 penalty, by Adam on the full batch."""
    size = BUCKETS + MEASURES
    top = max(grades, default=0)
    if len(set(grades)) < 2:
        return OrdinalModel(np.zeros(size), np.array([-5.0] * top + [5.0] * (not top)))
    kind = np.dtype([("f", "<i4"), ("v", "<f4")])
    flat = [np.frombuffer(r, kind) for r in rows]
    owner = np.repeat(np.arange(len(flat)), [len(r) for r in flat])
    f, v = np.concatenate([r["f"] for r in flat]), np.concatenate([r["v"] for r in flat])
    v = v.astype(np.float64)
    # Frequencies are small numbers: scale each feature by its root mean square.
    scale = np.sqrt(np.bincount(f, v * v, size) / len(flat))
    scale = np.where(scale > 0, 1 / np.maximum(scale, 0.02), 0.0)
    v *= scale[f]
    y = np.array(grades)
    above = y[:, None] > np.arange(top)[None, :]  # whether the grade is above each threshold
    share = np.clip(above.mean(0), 1e-3, 1 - 1e-3)
    first = -np.log(share / (1 - share))
    start = np.r_[np.zeros(size), first[0], np.log(np.maximum(np.diff(first), 1e-2))]
    params, m, s = start.copy(), np.zeros_like(start), np.zeros_like(start)
    for step in range(1, STEPS + 1):
        w, cuts = params[:size], params[size:]
        thresholds = cuts[0] + np.r_[0.0, np.cumsum(np.exp(cuts[1:]))]
        score = np.bincount(owner, v * w[f], len(flat))
        p_above = 1 / (1 + np.exp(-(score[:, None] - thresholds[None, :])))
        full = np.c_[np.ones(len(y)), p_above, np.zeros(len(y))]
        of_grade = np.maximum(full[np.arange(len(y)), y] - full[np.arange(len(y)), y + 1], 1e-9)
        slope = np.c_[np.zeros(len(y)), p_above * (1 - p_above), np.zeros(len(y))]
        low, high = slope[np.arange(len(y)), y], slope[np.arange(len(y)), y + 1]
        d_score = (low - high) / of_grade / len(y)
        d_cut = np.zeros(top)
        np.add.at(d_cut, np.maximum(y - 1, 0), np.where(y > 0, -low / of_grade, 0) / len(y))
        np.add.at(d_cut, np.minimum(y, top - 1), np.where(y < top, high / of_grade, 0) / len(y))
        behind = np.cumsum(d_cut[::-1])[::-1]
        d_w = np.bincount(f, v * d_score[owner], size) - PENALTY * w
        grad = np.r_[d_w, behind[0], behind[1:] * np.exp(cuts[1:])]
        m, s = 0.9 * m + 0.1 * grad, 0.999 * s + 0.001 * grad * grad
        params += RATE * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    cuts = params[size:]
    thresholds = cuts[0] + np.r_[0.0, np.cumsum(np.exp(cuts[1:]))]
    return OrdinalModel(params[:size] * scale, thresholds)


def _scorer(model: OrdinalModel):
    weights, known = model.weights, WordCache(9_000_000)
    tail = weights[BUCKETS:].tolist()

    def score(texts: list[str]) -> np.ndarray:
        known.make_room()
        split = [t.split() for t in texts]
        new = list(set().union(*split) - known.keys())
        if new:
            pairs = np.array([word_buckets(w) for w in new], np.int64)
            known.grow(new, weights[pairs].sum(1).tolist())
        out = []
        for text, words in zip(texts, split, strict=True):
            total = math.fsum([known[w] for w in words]) / max(1, len(words))
            out.append(total + sum(a * b for a, b in zip(tail, measures(text, words), strict=True)))
        return np.array(out)

    return score


def grade_documents(docs: DataFrame, model: OrdinalModel, text: str = "text") -> DataFrame:
    """``docs`` with ``expected_grade`` and ``p_above`` (one probability per threshold)."""

    def make():
        score = _scorer(model)

        def work(column: pa.Array) -> list[pa.Array]:
            z = score(texts_of(column))
            p = 1 / (1 + np.exp(-np.clip(z[:, None] - model.thresholds[None, :], -500, 500)))
            return [pa.array(p.sum(1)), pa.array(list(p), pa.list_(pa.float64()))]

        return work

    fields = [("expected_grade", T.DoubleType()), ("p_above", T.ArrayType(T.DoubleType()))]
    return append_columns(docs, text, fields, make)


def grade_of_labels(quality: Column, toxic: Column) -> Column:
    """Graded rating of two binary labels: 0 poor, 1 readable but toxic, 2 good."""
    return F.when(quality == 0, 0).when((quality == 1) & (toxic == 1), 1).when(quality == 1, 2)
