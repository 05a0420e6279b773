"""Nearest sources in images at any distance, with work that grows with the pixels.

Separable: a window over each column finds the nearest source above and below, then each row
takes the best column for each of its pixels. By squared distance that is the lower envelope of
one parabola for each column, by city-block distance two running minima, by chessboard distance a
search over minima of spans; a row is at most as long as the image is wide, and rows are dealt
over all tasks.

Images are pixel tables (img, x, y, ...). Of equally near sources that of least x counts, then
the one of the nearer row, then the upper one.

Defined cases: pixels that an image lacks get no row, but do not hide the sources of their column;
in an image without a source distance and source are null; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

XY = ("img", "x", "y")
METRICS = ("squared", "l1", "max")


def _whole(df: DataFrame, is_source) -> DataFrame:
    """(img, x, y, source, real): df, and pixels that are not real where its images have holes."""
    real = df.select(*XY, is_source.alias("source"), F.lit(True).alias("real"))
    extent = df.groupBy("img").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.count(F.lit(1)).alias("n"))
    holed = extent.where("n < (x1 - x0 + 1L) * (y1 - y0 + 1L)").select("img", "y0", "y1")
    grid = df.select("img", "x").distinct().join(holed, "img").select("img", "x", F.explode(F.sequence("y0", "y1")).alias("y"))
    holes = grid.join(df.select(*XY), list(XY), "left_anti")
    return real.unionByName(holes.select(*XY, F.lit(False).alias("source"), F.lit(False).alias("real")))


def _columns(df: DataFrame, is_source) -> DataFrame:
    """(img, x, y, d, at, real): for each pixel the nearest source of its column, d away at the y at; of two the upper one."""
    df = _whole(df, is_source)
    own = F.when(F.col("source"), F.col("y"))
    column = Window.partitionBy("img", "x").orderBy("y")
    above = F.last(own, ignorenulls=True).over(column.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    below = F.first(own, ignorenulls=True).over(column.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    near = df.select(*XY, "real", above.alias("_a"), below.alias("_b"))
    upper = F.col("_b").isNull() | (F.col("y") - F.col("_a") <= F.col("_b") - F.col("y"))
    at = F.when(F.col("_a").isNotNull() & upper, F.col("_a")).otherwise(F.col("_b"))
    return near.select(*XY, "real", F.abs(F.col("y") - at).cast("long").alias("d"), at.alias("at"))


def _envelope(x: np.ndarray, d: np.ndarray) -> np.ndarray:
    """For each of the ascending places x the index of the place k of least (x - x[k])**2 + d[k]**2, the first of equals; d < 0 tells that a column has no source."""
    held: list[int] = []
    upto: list[int] = []  # the last place where the held parabola before counts
    for q in np.flatnonzero(d >= 0).tolist():
        xq, fq = int(x[q]), int(d[q]) ** 2 + int(x[q]) ** 2
        while held:
            v = held[-1]
            # v counts as long as it is not above q, so whole numbers do.
            cross = (fq - int(d[v]) ** 2 - int(x[v]) ** 2) // (2 * (xq - int(x[v])))
            if len(held) == 1 or cross > upto[-1]:
                upto.append(cross)
                break
            held.pop()
            upto.pop()
        held.append(q)
    if not held:
        return np.full(len(x), -1)
    return np.array(held)[np.searchsorted(np.array(upto, np.int64), x, side="left")]


def _running(x: np.ndarray, d: np.ndarray) -> np.ndarray:
    """As _envelope() for |x - x[k]| + d[k]: the best column from the left and from the right."""
    far = np.int64(1) << 40
    cost = np.where(d < 0, far, d)
    index = np.arange(len(x))

    def best(values: np.ndarray, first: bool) -> np.ndarray:
        least = np.minimum.accumulate(values)
        # The place where the running minimum was reached first, or last.
        new = np.concatenate(([True], values[1:] < least[:-1] if first else values[1:] <= least[:-1]))
        return np.maximum.accumulate(np.where(new, index, 0))

    left = best(cost - x, True)
    right = len(x) - 1 - best((cost + x)[::-1], False)[::-1]
    of = lambda k: np.abs(x - x[k]) + cost[k]
    chosen = np.where(of(left) <= of(right), left, right)
    return np.where(cost[chosen] >= far, -1, chosen)


def _spans(x: np.ndarray, d: np.ndarray) -> np.ndarray:
    """As _envelope() for max(|x - x[k]|, d[k]): the least radius r such that a column within r is at most r away, then the first such column."""
    far = np.int64(1) << 40
    cost, n = np.where(d < 0, far, d), len(x)
    table = [cost]
    while 2 << (len(table) - 1) <= n:
        half = 1 << (len(table) - 1)
        table.append(np.minimum(table[-1][:-half], table[-1][half:]))

    def least(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        k = np.frexp((hi - lo).astype(np.float64))[1] - 1
        out = np.full(len(lo), far)
        for level in np.unique(k):
            at = k == level
            out[at] = np.minimum(table[level][lo[at]], table[level][hi[at] - (1 << level)])
        return out

    near = lambda r: (np.searchsorted(x, x - r, "left"), np.searchsorted(x, x + r, "right"))
    lo, hi = np.full(n, -1), np.full(n, int(max(x[-1] - x[0], d.max(), 0)))
    while (hi - lo > 1).any():
        mid = (lo + hi) // 2
        good = least(*near(np.maximum(mid, 0))) <= mid
        lo, hi = np.where(good | (hi - lo <= 1), lo, mid), np.where(good & (hi - lo > 1), mid, hi)
    # The first column in reach: by halving the span from its left end.
    start, end = near(hi)
    found = least(start, end) <= hi
    first, last = start.copy(), end.copy()
    while (last - first > 1).any():
        mid = (first + last) // 2
        inside = least(first, np.maximum(mid, first + 1)) <= hi
        wide = last - first > 1
        first, last = np.where(wide & ~inside, mid, first), np.where(wide & inside, mid, last)
    return np.where(found, first, -1)


_BEST = {"squared": _envelope, "l1": _running, "max": _spans}
_SIZE = {"squared": lambda a, b: a * a + b * b, "l1": lambda a, b: a + b, "max": np.maximum}


def _rows(metric: str, schema: pa.Schema):
    """For mapInArrow over rows sorted by img, y, x: each image row is held until its last pixel has come."""

    def row(img, y, x, d, at, real) -> pa.RecordBatch:
        k = _BEST[metric](x, d)
        none = k < 0
        k = np.maximum(k, 0)
        distance = _SIZE[metric](np.abs(x - x[k]), np.maximum(d[k], 0))
        values = {"img": np.full(len(x), img), "x": x, "y": np.full(len(x), y), "distance": distance, "source_x": x[k], "source_y": at[k]}
        made = pa.RecordBatch.from_arrays([pa.array(values[f.name], f.type, mask=none if f.name in ("distance", "source_x", "source_y") else None) for f in schema], schema=schema)
        return made.filter(pa.array(real))

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def flush() -> pa.RecordBatch:
            return row(*key, *(np.concatenate([h[k] for h in held]) for k in range(4)))

        for batch in batches:
            img, y = (np.asarray(batch[c]) for c in ("img", "y"))
            x, at = np.asarray(batch["x"]).astype(np.int64), np.asarray(batch["at"].fill_null(0)).astype(np.int64)
            d, real = np.asarray(batch["d"].fill_null(-1)).astype(np.int64), np.asarray(batch["real"].to_numpy(zero_copy_only=False), bool)
            edges = np.flatnonzero(np.concatenate(([True], (img[1:] != img[:-1]) | (y[1:] != y[:-1]), [True]))) if len(x) else []
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                now = (img[a], y[a])
                if held and now != key:
                    yield flush()
                    held = []
                key = now
                held.append((x[a:b], d[a:b], at[a:b], real[a:b]))
        if held:
            yield flush()

    return over


def nearest_source(df: DataFrame, is_source, metric: str = "squared") -> DataFrame:
    """(img, x, y, distance, source_x, source_y): the nearest pixel for which the column is_source holds."""
    schema = pa.schema([("img", pa.int64()), ("x", pa.int32()), ("y", pa.int32()), ("distance", pa.int64()), ("source_x", pa.int32()), ("source_y", pa.int32())])
    near = _columns(df, is_source).select(F.col("img").cast("long").alias("img"), "x", "y", "d", "at", "real")
    sorted_rows = near.repartition("img", "y").sortWithinPartitions("img", "y", "x")
    return sorted_rows.mapInArrow(_rows(metric, schema), "img long, x int, y int, distance long, source_x int, source_y int")


def distance_transform(df: DataFrame, metric: str = "squared") -> DataFrame:
    """(img, x, y, distance) to the nearest nonzero pixel of (img, x, y, v)."""
    return nearest_source(df, F.col("v") != 0, metric).select(*XY, "distance")


#: Fixed value: a label that stands for no decision.
DONTCARE = 0xFFFFFF


def _labelled(df: DataFrame, is_source, is_target) -> DataFrame:
    near = nearest_source(df, is_source).select(*XY, "source_x", "source_y")
    found = df.select("img", F.col("x").alias("source_x"), F.col("y").alias("source_y"), F.col("label").alias("_near"))
    met = df.join(near, list(XY)).join(found, ["img", "source_x", "source_y"], "left")
    return met.select(*XY, F.when(is_target & F.col("_near").isNotNull(), F.col("_near")).otherwise(F.col("label")).alias("label"))


def propagate_labels(df: DataFrame) -> DataFrame:
    """(img, x, y, label): pixels of label 0 take the label of the nearest other pixel."""
    return _labelled(df, F.col("label") != 0, F.col("label") == 0)


def propagate_labels_to(target: DataFrame, seed: DataFrame) -> DataFrame:
    """Nonzero pixels of target take the label of the nearest nonzero pixel of seed, a label image of the same pixels."""
    met = target.select(*XY, F.col("label").alias("_target")).join(seed.select(*XY, "label"), list(XY))
    near = nearest_source(met, F.col("label") != 0).select(*XY, "source_x", "source_y")
    found = seed.select("img", F.col("x").alias("source_x"), F.col("y").alias("source_y"), F.col("label").alias("_near"))
    out = F.when((F.col("_target") != 0) & F.col("_near").isNotNull(), F.col("_near")).otherwise(F.col("_target"))
    return met.select(*XY, "_target").join(near, list(XY)).join(found, ["img", "source_x", "source_y"], "left").select(*XY, out.alias("label"))


def remove_dontcares(df: DataFrame) -> DataFrame:
    """Pixels without a decision take the label of the nearest pixel that has one and is not background."""
    open_ = F.col("label").bitwiseAND(F.lit(DONTCARE)) == DONTCARE
    return _labelled(df, (F.col("label") != 0) & ~open_, open_)
