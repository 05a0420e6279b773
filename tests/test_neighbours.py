"""Exact neighbours against all pairs, over one cell and many, with ties, hot cells and a limit of distance."""

import numpy as np
import pyarrow as pa
import pytest

from quillspark.operators.neighbours import VISITED, _visits, nearest


def plain(q, r, k, skip_self, most):
    out = {}
    for i, a in q:
        near = sorted((sum((x - y) ** 2 for x, y in zip(a, b, strict=True)), j) for j, b in r if not (skip_self and i == j))
        out[i] = [(j, d) for d, j in near if d <= most * most][:k]
    return {i: v for i, v in out.items() if v}


@pytest.mark.parametrize("block,pivots,skip,most", [(1000, 64, True, float("inf")), (20, 16, True, float("inf")), (25, 8, False, 4.0)])
def test_equal_to_all_pairs(spark, block, pivots, skip, most):
    rng = np.random.default_rng(7)
    # A third of the rows are copies of one vector; others lie in clusters of whole numbers, so distances tie.
    vectors = [[3.0, 3.0, 3.0, 3.0]] * 70 + rng.integers(0, 4, (70, 4)).astype(float).tolist() + (rng.integers(0, 3, (70, 4)) + 40).astype(float).tolist()
    rows = [(k, k % 5, v) for k, v in enumerate(vectors)]
    ref = spark.createDataFrame(rows, "id long, cls int, features array<double>").repartition(4)
    got = {}
    for r in nearest(ref, ref, 4, skip, most, block, pivots).collect():
        got.setdefault(r["id"], {})[r["rank"]] = (r["other"], r["distance"])
        assert r["cls"] == r["other"] % 5
    pairs = [(k, v) for k, _, v in rows]
    assert {i: [v[n] for n in sorted(v)] for i, v in got.items()} == plain(pairs, pairs, 4, skip, most)


def test_few_and_no_rows(spark):
    ref = spark.createDataFrame([(1, 0, [0.0]), (2, 1, [5.0])], "id long, cls int, features array<double>")
    assert sorted((r["id"], r["other"], r["distance"]) for r in nearest(ref, ref, 3).collect()) == [(1, 2, 25.0), (2, 1, 25.0)]
    assert nearest(ref, ref.where("false"), 3).collect() == []
    assert nearest(ref.where("false"), ref, 3).collect() == []


def test_visits_come_in_bounded_batches():
    """Queries that visit all of 128 cells."""
    pivots, n = np.zeros((128, 4)), 2_000
    batch = pa.RecordBatch.from_pydict({"id": np.arange(n), "features": pa.array(np.zeros((n, 4)).tolist())})
    made = list(_visits(pivots, np.ones(128), np.ones((128, 2)), 2, float("inf"))([batch]))
    assert sum(b.num_rows for b in made) == n * 128 and max(b.num_rows for b in made) <= VISITED
