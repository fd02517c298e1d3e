"""Clustered vectors: the rows of the flat index, from few shells."""

import re

import numpy as np
import pytest

from siftmark.operators.clustered import SHELLS, ClusteredIndex, _distances
from siftmark.operators.dense import VectorIndex


def vector_rows(spark, rows):
    return spark.createDataFrame(
        [(i, [float(x) for x in v]) for i, v in enumerate(rows)],
        "chunk_id long, embedding array<float>",
    )


@pytest.fixture(scope="module")
def both(spark):
    draw = np.random.default_rng(3)
    centres = draw.normal(size=(12, 8))
    rows = [3 * centres[i % 12] + 0.3 * draw.normal(size=8) for i in range(1500)]
    rows += [rows[5]] * 700 + [np.zeros(8)] * 3  # a third are copies
    df = vector_rows(spark, rows)
    return ClusteredIndex.build(df, cells=24), VectorIndex.build(df), centres


@pytest.mark.parametrize("k", [1, 20, 1_000, 5_000])
def test_same_rows_as_the_flat_index(both, k):
    clustered, flat, centres = both
    draw = np.random.default_rng(k)
    for query in (centres[0].tolist(), draw.normal(size=8).tolist(), [0.0] * 8):
        assert clustered.search(query, k).collect() == flat.search(query, k).collect()


def test_bounds_hold_and_few_shells_are_opened(both):
    clustered, _, centres = both
    query = centres[3]
    bound = dict(zip(clustered.shells[:, 0].astype(int).tolist(), clustered.bounds(query).tolist(), strict=True))
    for r in clustered.rows.collect():
        assert np.dot(r.embedding, query) <= bound[r.shell] + 1e-9
    opened = clustered.open_shells(query.tolist(), 10)
    assert 0 < len(opened) <= len(clustered.shells) // 3
    plan = clustered.search(query.tolist(), 10)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*shell", plan)


def test_every_vector_is_in_the_shell_of_its_nearest_centre(both):
    clustered, flat, _ = both
    rows = clustered.rows.collect()
    assert len(rows) == len(clustered) == len(flat)
    cell, _ = _distances(np.array([r.embedding for r in rows], float), clustered.centres)
    assert [r.shell // SHELLS for r in rows] == cell.tolist()


def test_none_and_wrong_length(spark, both):
    empty = ClusteredIndex.build(vector_rows(spark, []))
    assert empty.is_empty() and len(empty) == 0 and empty.search([1.0], 3).count() == 0
    with pytest.raises(ValueError):
        both[0].search([1.0], 3)
    one = ClusteredIndex.build(vector_rows(spark, [[3.0, 4.0]]), cells=9)
    (hit,) = one.search([0.6, 0.8], 3).collect()
    assert hit.chunk_id == 0 and hit.score == pytest.approx(1.0, abs=1e-6)


def test_engine_takes_clusters_for_many_vectors(spark, monkeypatch):
    from siftmark.plans import engine

    df = vector_rows(spark, np.eye(4))
    assert isinstance(engine._written(VectorIndex.build(df)), VectorIndex)
    monkeypatch.setattr(engine, "CLUSTERED_VECTORS", 4)
    assert isinstance(engine._written(VectorIndex.build(df)), ClusteredIndex)
