"""Thinning to skeletons, tracing of chains, and their approximation by polygons.

Thinning works on tiles: a tile with a border of the pixels around it is one array of a task, and
HALO // 4 whole passes run there before neighbours have to be asked again. Only ink is moved, and
only tiles whose surroundings changed take part in the next round.

Chains are traced component by component, as a chain never leaves its component. The
approximation splits every segment of every chain that is still open at its farthest point, one
aggregation a round, so rounds grow with the depth of the splits.

Defined cases: an image without ink gives no rows; pixels on the border of an image are never
thinned nor traced; chains of one and two pixels are their own polygons.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.operators.durable import cut
from quillspark.operators.images import label_components

TILE, HALO = 256, 32

#: The neighbours of a pixel, in the order in which they are tried.
AROUND = ((1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1), (0, -1), (1, -1))

_OFF, _ON, _SKELETON = 0, 1, 2


def _parts_around(at: list[np.ndarray]) -> np.ndarray:
    """Connected parts of the ink around each pixel; corners touch the sides next to them."""
    return sum(((~at[k]) & (at[k + 1] | at[(k + 2) % 8])).astype(np.int8) for k in (0, 2, 4, 6))


def _thin_tile(state: np.ndarray, inner: np.ndarray, passes: int) -> bool:
    """Up to passes whole passes in place; whether any pixel changed. inner tells the pixels that may change."""
    changed = False
    for _ in range(passes):
        before = state.copy()
        for side in (0, 2, 4, 6):
            ink = np.pad(state != _OFF, 1)
            shifted = [ink[1 + dx : 1 + dx + state.shape[0], 1 + dy : 1 + dy + state.shape[1]] for dx, dy in AROUND]
            border = (state == _ON) & inner & ~shifted[side]
            keeps = border & (_parts_around(shifted) >= 2)
            state[keeps] = _SKELETON
            state[border & ~keeps] = _OFF
        if (state == before).all():
            break
        changed = True
    return changed


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, np.ndarray]]:
    """(img, tx, ty) and the columns x, y, state, width, height of each tile of sorted rows."""
    key, held = None, []
    names = ("x", "y", "state", "width", "height")
    for batch in batches:
        where = np.stack([np.asarray(batch[c]).astype(np.int64) for c in ("img", "tx", "ty")], axis=1)
        rows = np.stack([np.asarray(batch[c]).astype(np.int64) for c in names], axis=1)
        if not len(rows):
            continue
        edges = np.flatnonzero(np.concatenate(([True], (where[1:] != where[:-1]).any(axis=1), [True])))
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            now = tuple(where[a].tolist())
            if held and now != key:
                yield key, np.concatenate(held)
                held = []
            key = now
            held.append(rows[a:b])
    if held:
        yield key, np.concatenate(held)


_THINNED = "img long, x int, y int, state int, width int, height int, changed boolean"


def _thin_round(tile: int, halo: int):
    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (img, tx, ty), rows in _tiles(batches):
            x0, y0 = tx * tile - halo, ty * tile - halo
            state = np.zeros((tile + 2 * halo, tile + 2 * halo), np.int8)
            state[rows[:, 0] - x0, rows[:, 1] - y0] = rows[:, 2]
            width, height = int(rows[0, 3]), int(rows[0, 4])
            x, y = (np.arange(len(state)) + start for start in (x0, y0))
            inner = ((x > 0) & (x < width - 1))[:, None] & ((y > 0) & (y < height - 1))[None, :]
            core = (slice(halo, halo + tile), slice(halo, halo + tile))
            before = state[core].copy()
            _thin_tile(state, inner, halo // 4)
            after = state[core]
            kept = np.argwhere(after != _OFF)
            n, differs = len(kept), bool((after != before).any())
            # A tile that lost all ink tells that it changed by a row without a pixel.
            values = [kept[:, 0] + x0 + halo, kept[:, 1] + y0 + halo, after[kept[:, 0], kept[:, 1]]]
            if not n and differs:
                n, values = 1, [np.array([tx * tile]), np.array([ty * tile]), np.array([_OFF])]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, img)), *(pa.array(np.asarray(v).astype(np.int32)) for v in values), pa.array(np.full(n, width, np.int32)), pa.array(np.full(n, height, np.int32)), pa.array(np.full(n, differs))],
                ["img", "x", "y", "state", "width", "height", "changed"],
            )

    return over


def _sized(df: DataFrame) -> DataFrame:
    """Ink of (img, x, y, v) with the size of its image, which starts at 0, 0."""
    sizes = df.groupBy("img").agg((F.max("x") + 1).cast("int").alias("width"), (F.max("y") + 1).cast("int").alias("height"))
    ink = df.where("v <> 0").select(F.col("img").cast("long").alias("img"), F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"))
    return ink.join(sizes.select(F.col("img").cast("long").alias("img"), "width", "height"), "img")


def thin(df: DataFrame, tile: int = TILE, halo: int = HALO) -> DataFrame:
    """(img, x, y): the skeletons of the images (img, x, y, v).

    Pixels with an empty side, in turn right, upper, left and lower, stay for good if the ink
    around them has several parts, and go otherwise; until a whole turn takes none away.
    """
    ink = cut(_sized(df).withColumn("state", F.lit(_ON)).withColumn("changed", F.lit(True)))
    while ink.where("changed").limit(1).count():
        span = lambda c: F.sequence(F.floor((F.col(c) - halo) / tile), F.floor((F.col(c) + halo) / tile))
        placed = ink.withColumn("tx", F.explode(span("x"))).withColumn("ty", F.explode(span("y")))
        # Only tiles that may see a change go on; the others keep their pixels.
        moved = ink.where("changed").select("img", F.floor(F.col("x") / tile).alias("cx"), F.floor(F.col("y") / tile).alias("cy")).distinct()
        near = F.expr("sequence(-1L, 1L)")
        touched = moved.withColumn("tx", F.explode(F.transform(near, lambda d: d + F.col("cx")))).withColumn("ty", F.explode(F.transform(near, lambda d: d + F.col("cy")))).select("img", "tx", "ty").distinct()
        real = placed.where("state <> 0").join(touched, ["img", "tx", "ty"], "left_semi")
        done = real.repartition("img", "tx", "ty").sortWithinPartitions("img", "tx", "ty").mapInArrow(_thin_round(tile, halo), _THINNED)
        home = ink.where("state <> 0").withColumn("tx", F.floor(F.col("x") / tile)).withColumn("ty", F.floor(F.col("y") / tile))
        rest = home.join(touched, ["img", "tx", "ty"], "left_anti").withColumn("changed", F.lit(False))
        ink = cut(done.unionByName(rest.select(*done.columns)))
    return ink.where(F.col("state") == _SKELETON).select("img", "x", "y")


def _trace(points: set[tuple[int, int]]) -> Iterator[list[tuple[int, int]]]:
    """Chains of one component: from its first free pixel by x, then y, one way, then the other way from the same pixel."""
    for start in sorted(points):
        if start not in points:
            continue

        def run(at: tuple[int, int]) -> list[tuple[int, int]]:
            out = []
            while True:
                at = next(((at[0] + dx, at[1] + dy) for dx, dy in AROUND if (at[0] + dx, at[1] + dy) in points), None)
                if at is None:
                    return out
                points.discard(at)
                out.append(at)

        points.discard(start)
        one = [start, *run(start)]
        other = run(start)
        yield one[::-1] + other if other else one


def _chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by component; a component is held until its last pixel has come."""
    key, held = None, set()

    def flush() -> pa.RecordBatch:
        rows = [(key[0], *chain[0], start, place, x, y) for start, chain in enumerate(_trace(held)) for place, (x, y) in enumerate(chain)]
        names = ("img", "_x", "_y", "nth", "place", "x", "y")
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32())
        made = {n: pa.array(list(c), k) for n, k, c in zip(names, kinds, zip(*rows, strict=True), strict=True)}
        made["component"] = pa.array([key[1]] * len(rows), pa.int64())
        return pa.RecordBatch.from_pydict({n: made[n] for n in ("img", "component", "nth", "place", "x", "y")})

    for batch in batches:
        for img, label, x, y in zip(*(batch[c].to_pylist() for c in ("img", "label", "x", "y")), strict=True):
            if held and (img, label) != key:
                yield flush()
                held = set()
            key = (img, label)
            held.add((x, y))
    if held:
        yield flush()


def trace_chains(df: DataFrame) -> DataFrame:
    """(img, component, nth, place, x, y): the chains of the images (img, x, y, v), in the order of their pixels."""
    inner = _sized(df).where("x > 0 and y > 0 and x < width - 1 and y < height - 1").select("img", "x", "y", F.lit(255).alias("v"))
    labels = label_components(inner, eight=True).select("img", "label", F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"))
    return labels.repartition("img", "label").sortWithinPartitions("img", "label").mapInArrow(_chains, "img long, component long, nth int, place long, x int, y int")


def approximate(chains: DataFrame, key: list[str], most: float = 1.0) -> DataFrame:
    """The vertices (key, place, x, y) of polygons that stay nearer than most to the chains (key, place, x, y), place counting from 0.

    A segment is split at its farthest point, the first of equals, unless that is nearer than most.
    """
    chains = cut(chains)
    ends = chains.groupBy(*key).agg(F.max("place").alias("last"))
    whole = chains.join(ends, key).select(*key, "place", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), "last")
    points = cut(whole.select(*key, "place", "x", "y", "last", F.lit(0).cast("long").alias("a"), F.col("last").alias("b")))
    corners = points.where("place = 0 or place = last or last < 2").select(*key, "place")
    points = points.where("last > 1")
    vertices = [corners]
    while points.limit(1).count():
        segment = [*key, "a", "b"]
        at = lambda which, name: F.max(F.when(F.col("place") == F.col(which), F.struct("x", "y"))).alias(name)
        tips = points.groupBy(*segment).agg(at("a", "_p"), at("b", "_q"))
        dx, dy = F.col("_q.x") - F.col("_p.x"), F.col("_q.y") - F.col("_p.y")
        size = F.sqrt(dx * dx + dy * dy)
        px, py = F.col("x") - F.col("_p.x"), F.col("y") - F.col("_p.y")
        far = F.when(size < 1e-4, F.sqrt(px * px + py * py)).otherwise(F.abs(dx * py - dy * px) / size)
        apart = points.join(tips, segment).withColumn("d", far)
        farthest = F.max(F.struct("d", (-F.col("place")).alias("_first")))
        split = cut(apart.groupBy(*segment).agg(farthest.alias("_m")).where((F.col("_m.d") > 0) & (F.col("_m.d") >= most)).select(*segment, (-F.col("_m._first")).alias("m")))
        vertices.append(split.select(*key, F.col("m").alias("place")))
        met = points.join(split, segment)
        side = F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.col("m").alias("a"), F.col("b").alias("b")))
        halves = met.select(*key, "place", "x", "y", "last", F.explode(F.filter(side, lambda s: (F.col("place") >= s["a"]) & (F.col("place") <= s["b"]))).alias("_s"))
        points = cut(halves.select(*key, "place", "x", "y", "last", "_s.a", "_s.b").where("b - a > 1"))
    return reduce(DataFrame.unionByName, vertices).join(chains, [*key, "place"]).select(*key, "place", "x", "y")
