"""Nearest sources, zones, skeletons, chains and polygons against plain loops on random pages."""

import math
import random

import pytest
from pyspark.sql import functions as F

from quillspark.operators import curves, nearest, zones


def image(rng, w, h, ink):
    return {(x, y): 255 if rng.random() < ink else 0 for x in range(w) for y in range(h)}


def table(spark, images, value="v"):
    return spark.createDataFrame([(k, x, y, v) for k, im in images.items() for (x, y), v in im.items()], f"img long, x int, y int, {value} int")


@pytest.fixture(scope="module")
def sparse():
    rng = random.Random(2)
    return {0: image(rng, 17, 23, 0.02), 1: image(rng, 30, 9, 0.1), 2: image(rng, 5, 5, 0.0), 3: {(x, 0): 255 * (x in (3, 9)) for x in range(13)}}


@pytest.mark.parametrize("metric,size", [("squared", lambda a, b: a * a + b * b), ("l1", lambda a, b: abs(a) + abs(b)), ("max", lambda a, b: max(abs(a), abs(b)))])
def test_nearest_source(spark, sparse, metric, size):
    for r in nearest.nearest_source(table(spark, sparse), F.col("v") != 0, metric).collect():
        seeds = [p for p, v in sparse[r["img"]].items() if v]
        if not seeds:
            assert r["distance"] is None and r["source_x"] is None
            continue
        # Of equally near columns the least x, and in it the nearer row, then the upper one.
        want = min((size(r["x"] - a, r["y"] - b), a, abs(r["y"] - b), b) for a, b in seeds)
        assert (r["distance"], r["source_x"], r["source_y"]) == (want[0], want[1], want[3])


def test_labels_spread_to_the_nearest(spark):
    rng = random.Random(5)
    labels = {0: {(x, y): rng.choice([0] * 20 + [1, 2, 3, nearest.DONTCARE]) for x in range(19) for y in range(14)}, 1: {(0, 0): 0, (1, 0): nearest.DONTCARE}}
    df = table(spark, labels, "label")
    seeds = lambda im: [(p, v) for p, v in im.items() if v and v != nearest.DONTCARE]

    def near(im, x, y, given):
        return min(((x - a) ** 2 + (y - b) ** 2, a, abs(y - b), b, v) for (a, b), v in given)[-1] if given else im[x, y]

    spread = {(r["img"], r["x"], r["y"]): r["label"] for r in nearest.propagate_labels(df).collect()}
    decided = {(r["img"], r["x"], r["y"]): r["label"] for r in nearest.remove_dontcares(df).collect()}
    onto = {(r["img"], r["x"], r["y"]): r["label"] for r in nearest.propagate_labels_to(df.withColumn("label", F.col("x") % 2), df).collect()}
    for k, im in labels.items():
        every = [(p, v) for p, v in im.items() if v]
        for (x, y), v in im.items():
            assert spread[k, x, y] == (v or near(im, x, y, every))
            assert decided[k, x, y] == (near(im, x, y, seeds(im)) if v == nearest.DONTCARE else v)
            assert onto[k, x, y] == (near(im, x, y, every) if x % 2 else 0)


def plain_cut(ink, box, noise, least):
    """Leaves of one page by recursion: box is the zone before it is shrunk, noise the ink that a line may hold for each pixel of its length."""
    mine = [(x, y) for x, y in ink if box[0] <= x < box[2] and box[1] <= y < box[3]]
    if not mine:
        return []
    shrunk = (min(x for x, _ in mine), min(y for _, y in mine), max(x for x, _ in mine) + 1, max(y for _, y in mine) + 1)
    limit = (int((shrunk[3] - shrunk[1]) * noise[0]), int((shrunk[2] - shrunk[0]) * noise[1]))
    found = []
    for axis in (0, 1):
        profile = [sum(p[axis] == k for p in mine) - limit[axis] for k in range(box[axis], box[axis + 2])]
        held = [k for k, n in enumerate(profile) if n > 0]
        gaps = [(b - a - 1, -a, (a + 1 + b) // 2 + box[axis]) for a, b in zip(held, held[1:]) if b > a + 1]
        found.append(max(gaps, default=(-1, 0, None)))
    (gap_x, _, at_x), (gap_y, _, at_y) = found
    if gap_y > least[1] and (gap_y >= gap_x or gap_x <= least[0]):
        parts = [(shrunk[0], shrunk[1], shrunk[2], at_y), (shrunk[0], at_y, shrunk[2], shrunk[3])]
    elif gap_x > least[0]:
        parts = [(shrunk[0], shrunk[1], at_x, shrunk[3]), (at_x, shrunk[1], shrunk[2], shrunk[3])]
    else:
        return [shrunk]
    return [leaf for part in parts for leaf in plain_cut(ink, part, noise, least)]


@pytest.mark.parametrize("noise,least", [((0, 0), (0, 0)), ((3, 4), (1, 2))])
def test_xy_cut(spark, noise, least):
    rng = random.Random(8)
    pages = {}
    for k in range(5):
        ink = set()
        for _ in range(6):
            x, y, w, h = rng.randrange(40), rng.randrange(30), rng.randrange(1, 14), rng.randrange(1, 9)
            ink |= {(x + a, y + b) for a in range(w) for b in range(h) if rng.random() < 0.8}
        pages[k] = ink
    pages[5] = {(7, 7)}
    rows = [(k, x, y, 60, 50) for k, ink in pages.items() for x, y in ink]
    df = spark.createDataFrame(rows, "img long, x int, y int, width int, height int")
    got = {}
    for r in zones.xy_cut(df, *noise, *least).collect():
        got.setdefault(r["img"], []).append((r["x0"], r["y0"], r["x1"], r["y1"]))
    for k, ink in pages.items():
        assert sorted(got[k]) == sorted(plain_cut(ink, (0, 0, 60, 50), (noise[0] / 50, noise[1] / 60), least))
    assert zones.xy_cut(df.where("false")).collect() == []


def plain_thin(im, w, h):
    state = {p: 1 if v else 0 for p, v in im.items()}
    get = lambda x, y: state.get((x, y), 0)
    while True:
        lost = False
        for side in (0, 2, 4, 6):
            gone = []
            for x in range(1, w - 1):
                for y in range(1, h - 1):
                    if get(x, y) != 1 or get(x + curves.AROUND[side][0], y + curves.AROUND[side][1]):
                        continue
                    ring = [get(x + dx, y + dy) != 0 for dx, dy in curves.AROUND]
                    on = [k for k in range(8) if ring[k]]
                    parts, seen = 0, set()
                    for k in on:
                        if k in seen:
                            continue
                        parts, todo = parts + 1, [k]
                        while todo:
                            a = todo.pop()
                            seen.add(a)
                            todo += [b for b in on if b not in seen and max(abs(curves.AROUND[a][i] - curves.AROUND[b][i]) for i in (0, 1)) == 1]
                    if parts >= 2:
                        state[x, y] = 2
                    else:
                        gone.append((x, y))
            lost = lost or bool(gone)
            for p in gone:
                state[p] = 0
        if not lost:
            return {p for p, v in state.items() if v == 2}


def shapes():
    rng = random.Random(6)
    im = {(x, y): 0 for x in range(70) for y in range(50)}
    for _ in range(9):
        x, y, w, h = rng.randrange(60), rng.randrange(40), rng.randrange(2, 30), rng.randrange(2, 12)
        for a in range(w):
            for b in range(h):
                if (x + a, y + b) in im:
                    im[x + a, y + b] = 255
    return {0: im, 1: image(rng, 20, 20, 0.6), 2: image(rng, 4, 4, 1.0), 3: image(rng, 12, 12, 0.0)}


@pytest.mark.parametrize("tile,halo", [(32, 4), (256, 32)])
def test_thin_equals_a_plain_loop(spark, tile, halo):
    images = shapes()
    got = {k: set() for k in images}
    for r in curves.thin(table(spark, images), tile, halo).collect():
        got[r["img"]].add((r["x"], r["y"]))
    for k, im in images.items():
        assert got[k] == plain_thin(im, 1 + max(x for x, _ in im), 1 + max(y for _, y in im))


def plain_split(points, a, b, most, out):
    (ax, ay), (bx, by) = points[a], points[b]
    size, best, at = math.hypot(bx - ax, by - ay), 0.0, None
    for k in range(a, b + 1):
        px, py = points[k][0] - ax, points[k][1] - ay
        d = math.hypot(px, py) if size < 1e-4 else abs((bx - ax) * py - (by - ay) * px) / size
        if d > best:
            best, at = d, k
    if at is None or best < most:
        return
    plain_split(points, a, at, most, out)
    out.append(at)
    plain_split(points, at, b, most, out)


def test_chains_and_polygons(spark):
    images = shapes()
    skeleton = curves.thin(table(spark, images))
    lines = {0: {p: 0 for p in images[0]}, 1: {(x, y): 255 * (3 <= x <= 40 and y == 5 or x == 40 and 5 <= y <= 20 or (x, y) == (2, 2)) for x in range(50) for y in range(30)}}
    for r in skeleton.where("img = 0").collect():
        lines[0][r["x"], r["y"]] = 255
    chains = curves.trace_chains(table(spark, lines))
    held = {}
    for r in chains.collect():
        held.setdefault((r["img"], r["component"], r["nth"]), {})[r["place"]] = (r["x"], r["y"])
    held = {k: [c[i] for i in range(len(c))] for k, c in held.items()}
    # Every inner pixel is in one chain once, and neighbours in a chain touch.
    for k, im in lines.items():
        w, h = 1 + max(x for x, _ in im), 1 + max(y for _, y in im)
        inner = sorted(p for p, v in im.items() if v and 0 < p[0] < w - 1 and 0 < p[1] < h - 1)
        assert sorted(p for key, c in held.items() if key[0] == k for p in c) == inner
    assert all(max(abs(a[0] - b[0]), abs(a[1] - b[1])) == 1 for c in held.values() for a, b in zip(c, c[1:]))
    # The bent line is one chain from its upper left end to its lower end.
    bent = max((c for key, c in held.items() if key[0] == 1), key=len)
    assert bent == [(x, 5) for x in range(3, 41)] + [(40, y) for y in range(6, 21)]
    key = ["img", "component", "nth"]
    got = {}
    for r in curves.approximate(chains, key, 1.0).collect():
        got.setdefault(tuple(r[c] for c in key), set()).add(r["place"])
    for k, points in held.items():
        if len(points) < 3:
            want = set(range(len(points)))
        else:
            out = []
            plain_split(points, 0, len(points) - 1, 1.0, out)
            want = {0, *out, len(points) - 1}
        assert got[k] == want


def test_long_chain_in_few_rounds(spark):
    """A spiral of right angles with over 10,000 pixels: all corners and nothing else."""
    points, x, y, step, turn = [(0, 0)], 0, 0, 100, 0
    corners = [0]
    while len(points) < 10_000:
        dx, dy = ((1, 0), (0, 1), (-1, 0), (0, -1))[turn % 4]
        for _ in range(step):
            x, y = x + dx, y + dy
            points.append((x, y))
        corners.append(len(points) - 1)
        turn, step = turn + 1, step + (200 if turn % 2 else 0)
    df = spark.createDataFrame([(0, k, a, b) for k, (a, b) in enumerate(points)], "img long, place long, x int, y int")
    assert sorted(r["place"] for r in curves.approximate(df, ["img"]).collect()) == corners
