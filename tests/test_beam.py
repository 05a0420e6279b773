"""The beam search against the same steps in plain Python, and suppression of overlapping boxes against its definition."""

import random

import pytest

from quillspark.operators import automata, spatial


def plain_beam(arcs, accept, beam):
    best = {0: (0.0, [])}
    front = dict(best)
    while front:
        few = sorted(front.items(), key=lambda e: (e[1][0], e[0]))[:beam]
        step = {}
        for at, (cost, labels) in few:
            for s, d, _, o, c in arcs:
                if s == at:
                    new = (cost + c, labels + [o] if o else labels)
                    step[d] = min(step.get(d, new), new)
        front = {d: new for d, new in step.items() if d not in best or new[0] < best[d][0]}
        best |= front
    ends = [(best[i][0] + a, best[i][1]) for i, a in accept.items() if i in best]
    return min(ends) if ends else None


@pytest.mark.parametrize("beam", [1, 3])
def test_beam_paths(spark, beam):
    rng = random.Random(12)
    machines = {k: ([(s := rng.randrange(9), min(9, s + rng.randrange(1, 4)), 97, rng.choice([0, 97, 98]), rng.random()) for _ in range(30)], {9: 0.5, 8: rng.random()}) for k in range(6)}
    arcs = spark.createDataFrame([(k, *a) for k, m in machines.items() for a in m[0]], "fst long, src int, dst int, inp int, out int, cost double")
    nodes = spark.createDataFrame([(k, i, m[1].get(i)) for k, m in machines.items() for i in range(10)], "fst long, id int, accept double")
    got = {r["fst"]: (r["cost"], r["labels"]) for r in automata.best_paths(arcs, nodes, beam).collect()}
    want = {k: plain_beam(*m, beam) for k, m in machines.items()}
    assert set(got) == {k for k, w in want.items() if w}
    for k, (cost, labels) in got.items():
        assert cost == pytest.approx(want[k][0]) and labels == want[k][1]


def test_suppression(spark):
    rng = random.Random(4)
    rows = [(img, k, x := rng.randrange(80), y := rng.randrange(80), x + rng.randrange(1, 30), y + rng.randrange(1, 30)) for img in range(3) for k in range(40)]
    kept = {}
    for r in sorted(rows, key=lambda b: (b[0], -(b[5] - b[3]), b[1])):
        mine = kept.setdefault(r[0], [])
        if not any(o[2] < r[4] and r[2] < o[4] and o[3] < r[5] and r[3] < o[5] for o in mine):
            mine.append(r)
    got = spatial.suppress_overlaps(spark.createDataFrame(rows, "img long, id long, x0 int, y0 int, x1 int, y1 int")).collect()
    assert sorted(map(tuple, got)) == sorted(r for v in kept.values() for r in v)
