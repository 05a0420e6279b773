"""Joins of boxes: whole tables on eight images, and copies of boxes against all pairs."""

import random

import pytest

from quillspark.operators import spatial as B
from quillspark.plans import table_queries as T


@pytest.mark.parametrize("name", ["box_overlap_join", "box_best_overlap", "box_overlap_counts", "box_nearest_right", "box_segment_groups"])
def test_all_boxes_of_eight_images_are_joined(spark, sf, name):
    q = T.QUERIES[name]
    assert "p_partkey % 8 AS img" in q.sql
    images = {r["img"] for r in q.run(spark, sf).select("img").distinct().collect()}
    assert images <= set(range(8)) and max(images, default=4) > 3


def test_copies_of_boxes(spark):
    rng = random.Random(5)
    shapes = [(rng.randrange(200), rng.randrange(200), rng.randrange(1, 90), rng.randrange(1, 90)) for _ in range(25)]
    rows = [(k % 2, k, x, y, x + w, y + h) for k in range(160) for x, y, w, h in [rng.choice(shapes)]]
    a, b = (spark.createDataFrame(r, "img int, id long, x0 int, y0 int, x1 int, y1 int") for r in (rows[:80], rows[80:]))
    share = lambda p, q: max(0, min(p[4], q[4]) - max(p[2], q[2])) * max(0, min(p[5], q[5]) - max(p[3], q[3]))
    pairs = {(p[0], p[1], q[1], share(p, q)) for p in rows[:80] for q in rows[80:] if p[0] == q[0] and share(p, q)}
    got = [tuple(r) for r in B.overlap_join(a, b).select("img", "a_id", "b_id", "shared").collect()]
    assert len(got) == len(pairs) and set(got) == pairs
    counts = {r["a_id"]: r["n"] for r in B.overlap_counts(a, b).collect()}
    assert counts == {p[1]: sum(x[1] == p[1] for x in pairs) for p in rows[:80]}
    best = {r["a_id"]: (r["shared"], -r["b_id"]) for r in B.best_overlap(a, b).collect()}
    assert best == {i: max((x[3], -x[2]) for x in pairs if x[1] == i) for i in {x[1] for x in pairs}}
    ahead = {p[1]: min(((q[2] - p[4], q[1]) for q in rows[:80] if p[0] == q[0] and q[2] >= p[4] and q[3] < p[5] and p[3] < q[5]), default=None) for p in rows[:80]}
    assert {r["id"]: (r["gap"], r["other"]) for r in B.nearest_right(a).collect()} == {i: v for i, v in ahead.items() if v}
