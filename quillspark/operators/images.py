"""Images as pixel tables (img, x, y, v), label images (img, x, y, label) and run tables (img, line, start, end).

Run ends are exclusive. Neighbourhood operators spread every pixel to the places it reaches and
aggregate, or use frames of a window along one axis; both need one shuffle for each axis.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.operators.durable import cut

XY = ("img", "x", "y")


def _v(df: DataFrame, e: Column) -> DataFrame:
    return df.select(*XY, e.alias("v"))


def extent(df: DataFrame) -> DataFrame:
    return df.groupBy("img").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), (F.max("x") + 1).alias("x1"), (F.max("y") + 1).alias("y1"), F.min("v").alias("lo"), F.max("v").alias("hi"))


def with_extent(df: DataFrame) -> DataFrame:
    """Pixels with their image's extent; a window, so no second scan."""
    w = Window.partitionBy("img")
    low = [F.min(c).over(w).alias(n) for c, n in (("x", "x0"), ("y", "y0"), ("v", "lo"))]
    return df.select("*", *low, (F.max("x").over(w) + 1).alias("x1"), (F.max("y").over(w) + 1).alias("y1"), F.max("v").over(w).alias("hi"))


def crop(df, x0, y0, x1, y1): return df.where((F.col("x") >= x0) & (F.col("x") < x1) & (F.col("y") >= y0) & (F.col("y") < y1)).select("img", (F.col("x") - x0).alias("x"), (F.col("y") - y0).alias("y"), "v")
def shift(df, dx, dy): return df.select("img", (F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"), "v")
def circular_shift(df, dx, dy): return with_extent(df).select("img", F.pmod(F.col("x") + dx, F.col("x1")).alias("x"), F.pmod(F.col("y") + dy, F.col("y1")).alias("y"), "v")
def flip_x(df): return with_extent(df).select("img", (F.col("x1") - 1 - F.col("x")).alias("x"), "y", "v")
def flip_y(df): return with_extent(df).select("img", "x", (F.col("y1") - 1 - F.col("y")).alias("y"), "v")
def rotate_right(df): return with_extent(df).select("img", (F.col("y1") - 1 - F.col("y")).alias("x"), F.col("x").alias("y"), "v")
def transpose(df): return df.select("img", F.col("y").alias("x"), F.col("x").alias("y"), "v")
def skew(df, slope): return df.select("img", (F.col("x") + F.floor(F.col("y") * slope).cast("int")).alias("x"), "y", "v")


def pad(df: DataFrame, nx: int, ny: int, value: int = 0) -> DataFrame:
    """Borders of `value` on all sides; the border's pixels are made from the edge pixels."""
    def side(c, lo, hi, n):
        return F.when((c == lo) & (c == hi - 1), F.sequence(c - n, c + n)).when(c == lo, F.sequence(c - n, c)).when(c == hi - 1, F.sequence(c, c + n)).otherwise(F.array(c))

    e = with_extent(df)
    wide = e.select("img", "x", "y", "v", F.explode(side(F.col("x"), F.col("x0"), F.col("x1"), nx)).alias("px"), "y0", "y1")
    tall = wide.select("*", F.explode(side(F.col("y"), F.col("y0"), F.col("y1"), ny)).alias("py"))
    inside = (F.col("px") == F.col("x")) & (F.col("py") == F.col("y"))
    return tall.select("img", (F.col("px") + nx).alias("x"), (F.col("py") + ny).alias("y"), F.when(inside, F.col("v")).otherwise(value).alias("v"))


def erase_boundary(df, nx, ny, value=0):
    e = with_extent(df)
    edge = (F.col("x") < F.col("x0") + nx) | (F.col("x") >= F.col("x1") - nx) | (F.col("y") < F.col("y0") + ny) | (F.col("y") >= F.col("y1") - ny)
    return _v(e, F.when(edge, value).otherwise(F.col("v")))


def tighten(df: DataFrame) -> DataFrame:
    """Cropped to the box of nonzero pixels, less its last row and column."""
    box = df.where("v <> 0").groupBy("img").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"))
    return df.join(box, "img").where("x >= x0 and x < x1 and y >= y0 and y < y1").select("img", (F.col("x") - F.col("x0")).alias("x"), (F.col("y") - F.col("y0")).alias("y"), "v")


def binarize_middle(df): return _v(with_extent(df), F.expr("if(v < (lo + hi) div 2, 0, 255)"))
def binarize_range(df, fraction): return _v(with_extent(df), F.when(F.col("v") < F.col("lo") + (F.col("hi") - F.col("lo")) * fraction, 0).otherwise(255))
def binarize(df, threshold): return _v(df, F.when(F.col("v") < threshold, 0).otherwise(255))
def invert(df): return _v(df, 255 - F.col("v"))


def remove_boxes(df: DataFrame, boxes: DataFrame, value: int = 0) -> DataFrame:
    """Pixels inside (img, x0, y0, x1, y1) become `value`; the boxes are spread to pixels, so the join is by place."""
    spread = boxes.select("img", F.explode(F.sequence(F.col("x0"), F.col("x1") - 1)).alias("x"), "y0", "y1").select("img", "x", F.explode(F.sequence(F.col("y0"), F.col("y1") - 1)).alias("y")).distinct()
    return _v(df.join(spread.withColumn("gone", F.lit(True)), list(XY), "left"), F.when(F.col("gone"), value).otherwise(F.col("v")))


def _spread(df: DataFrame, offsets: Sequence[tuple[int, int]], extra: Sequence[float] | None = None) -> DataFrame:
    items = [F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"), F.lit(1.0 if extra is None else extra[k]).alias("w")) for k, (dx, dy) in enumerate(offsets)]
    s = df.select("img", "x", "y", "v", F.explode(F.array(*items)).alias("o"))
    return s.select("img", (F.col("x") + F.col("o.dx")).alias("x"), (F.col("y") + F.col("o.dy")).alias("y"), "v", F.col("o.w").alias("w"), ((F.col("o.dx") == 0) & (F.col("o.dy") == 0)).alias("own"))


def neighbourhood(df: DataFrame, offsets: Sequence[tuple[int, int]], f, extra: Sequence[float] | None = None) -> DataFrame:
    """f (an aggregate of v and w) over the pixels at the offsets that exist; only places of the image are kept."""
    full = offsets if (0, 0) in offsets else [*offsets, (0, 0)]
    weights = None if extra is None else [*extra, *([0.0] if (0, 0) not in offsets else [])]
    g = _spread(df, full, weights).groupBy(*XY).agg(f.alias("v"), F.max("own").alias("own"))
    return g.where("own").drop("own")


def rect(rx: int, ry: int): return [(dx, dy) for dx in range(-rx, rx + 1) for dy in range(-ry, ry + 1)]
def disc(r: int): return [(dx, dy) for dx, dy in rect(r, r) if dx * dx + dy * dy <= r * r]


def _sliding(df: DataFrame, axis: str, r: int, f) -> DataFrame:
    """An aggregate over the pixels within r along an axis: one shuffle, whatever r."""
    other = "y" if axis == "x" else "x"
    return _v(df, f.over(Window.partitionBy("img", other).orderBy(axis).rangeBetween(-r, r)))


def erode_rect(df, rx, ry): return _sliding(_sliding(df, "x", rx, F.min("v")), "y", ry, F.min("v"))
def dilate_rect(df, rx, ry): return _sliding(_sliding(df, "x", rx, F.max("v")), "y", ry, F.max("v"))
def open_rect(df, rx, ry): return dilate_rect(erode_rect(df, rx, ry), rx, ry)
def close_rect(df, rx, ry): return erode_rect(dilate_rect(df, rx, ry), rx, ry)
def erode_disc(df, r): return neighbourhood(df, disc(r), F.min("v"))
def dilate_disc(df, r): return neighbourhood(df, disc(r), F.max("v"))
def median_filter(df, rx, ry): return neighbourhood(df, rect(rx, ry), F.expr("array_sort(collect_list(v))[cast(count(v) / 2 as int)]"))
def local_mean(df, r): return neighbourhood(df, rect(r, r), F.avg("v"))


def sauvola(df: DataFrame, r: int, k: float, span: float = 128.0) -> DataFrame:
    """Local threshold mean * (1 + k * (sd / span - 1)) over a square window."""
    sums = neighbourhood(df, rect(r, r), F.struct(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))).withColumnRenamed("v", "t")
    cut = F.col("t.m") * (1 + k * (F.col("t.s") / span - 1))
    return _v(df.join(sums, list(XY)), F.when(F.col("v") < cut, 0).otherwise(255))


def laplacian(df, sign=1):
    """4 * centre less the neighbours inside the image, times sign."""
    four = [(1, 0), (-1, 0), (0, 1), (0, -1)]
    return neighbourhood(df, [(0, 0), *four], F.sum(F.col("v") * F.col("w")), [4.0 * sign, *[-1.0 * sign] * 4])


def gradient(df: DataFrame) -> DataFrame:
    """(img, x, y, gx, gy): central differences, of the inner pixels."""
    wx, wy = Window.partitionBy("img", "y").orderBy("x"), Window.partitionBy("img", "x").orderBy("y")
    g = df.select(*XY, (F.lead("v").over(wx) - F.lag("v").over(wx)).alias("gx"), (F.lead("v").over(wy) - F.lag("v").over(wy)).alias("gy"))
    return g.where("gx is not null and gy is not null")


def local_extrema(df: DataFrame, largest: bool = True) -> DataFrame:
    """Pixels strictly above (below) all existing 8 neighbours."""
    eight = [o for o in rect(1, 1) if o != (0, 0)]
    best = F.max(F.when(~F.col("own"), F.col("v"))) if largest else F.min(F.when(~F.col("own"), F.col("v")))
    g = _spread(df, [*eight, (0, 0)]).groupBy(*XY).agg(best.alias("b"), F.max(F.when(F.col("own"), F.col("v"))).alias("v"), F.max("own").alias("own"))
    return g.where("own").where(F.col("v") > F.col("b") if largest else F.col("v") < F.col("b")).select(*XY, "v")


def count_neighbours(df): return neighbourhood(df, [o for o in rect(1, 1) if o != (0, 0)], F.sum(F.when((F.col("v") != 0) & ~F.col("own"), 1).otherwise(0)))
def projection(df, axis): return df.where("v <> 0").groupBy("img", F.col(axis).alias("at")).agg(F.count(F.lit(1)).alias("n"))
def centroid(df): return df.groupBy("img").agg((F.sum(F.col("x") * F.col("v")) / F.sum("v")).alias("cx"), (F.sum(F.col("y") * F.col("v")) / F.sum("v")).alias("cy"))
def boxes(labels): return labels.where("label <> 0").groupBy("img", "label").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), (F.max("x") + 1).alias("x1"), (F.max("y") + 1).alias("y1"), F.count(F.lit(1)).alias("n"))
def border_mean(df): return with_extent(df).where("x = x0 or y = y0 or x = x1 - 1 or y = y1 - 1").groupBy("img").agg(F.avg("v").alias("mean"))
def integral(df): return _v(_v(df, F.sum("v").over(Window.partitionBy("img", "y").orderBy("x"))), F.sum("v").over(Window.partitionBy("img", "x").orderBy("y")))
def pixel_and(a, b, dx=0, dy=0): return a.where("v <> 0").join(shift(b, dx, dy).where("v <> 0").drop("v"), list(XY))
def pixel_or(a, b, dx=0, dy=0): return a.where("v <> 0").unionByName(shift(b, dx, dy).where("v <> 0")).groupBy(*XY).agg(F.max("v").alias("v"))
def difference(a, b): return a.where("v <> 0").select(*XY).join(b.where("v <> 0").select(*XY, F.lit(1).alias("o")), list(XY), "full").withColumnRenamed("o", "b")
def pack_label(column, paragraph, line): return F.shiftleft(column, 16).bitwiseOR(F.shiftleft(paragraph, 8)).bitwiseOR(line)
def unpack_label(label): return F.shiftright(label, 16).bitwiseAND(31), F.shiftright(label, 8).bitwiseAND(255), label.bitwiseAND(255)


def runs(df: DataFrame) -> DataFrame:
    """Runs of nonzero pixels along x, by gaps and islands."""
    w = Window.partitionBy("img", "y").orderBy("x")
    g = df.where("v <> 0").withColumn("g", F.col("x") - F.row_number().over(w))
    return g.groupBy("img", F.col("y").alias("line"), "g").agg(F.min("x").alias("start"), (F.max("x") + 1).alias("end")).drop("g")


def from_runs(r): return r.select("img", F.explode(F.sequence(F.col("start"), F.col("end") - 1)).alias("x"), F.col("line").alias("y"), F.lit(255).alias("v"))
def transpose_runs(r): return runs(transpose(from_runs(r)))


def merge_runs(r: DataFrame) -> DataFrame:
    """Touching and overlapping runs of a line as one."""
    w = Window.partitionBy("img", "line").orderBy("start", "end")
    reach = r.withColumn("reach", F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    named = reach.withColumn("g", F.sum(F.when(F.col("start") <= F.col("reach"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return named.groupBy("img", "line", "g").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("g")


def or_runs(a, b): return merge_runs(a.select("img", "line", "start", "end").unionByName(b.select("img", "line", "start", "end")))


def and_runs(a: DataFrame, b: DataFrame) -> DataFrame:
    """Intersections: an equi-join on the line with a range condition."""
    b = b.select("img", "line", F.col("start").alias("s2"), F.col("end").alias("e2"))
    return a.join(b, ["img", "line"]).where("start < e2 and s2 < end").select("img", "line", F.greatest("start", "s2").alias("start"), F.least("end", "e2").alias("end"))


def invert_runs(r: DataFrame, width: int) -> DataFrame:
    """The gaps of the lines that have runs, within 0..width."""
    w = Window.partitionBy("img", "line").orderBy("start")
    gaps = r.select("img", "line", F.coalesce(F.lag("end").over(w), F.lit(0)).alias("start"), F.col("start").alias("end"))
    tail = r.groupBy("img", "line").agg(F.max("end").alias("start")).withColumn("end", F.lit(width))
    return gaps.unionByName(tail).where("start < end")


def erode_runs(r, size):
    q = size - 1
    return r.select("img", "line", (F.col("start") + q // 2).alias("start"), (F.col("end") - (q - q // 2)).alias("end")).where("start < end")


def dilate_runs(r, size, width):
    q = size - 1
    return merge_runs(r.select("img", "line", F.greatest(F.lit(0), F.col("start") - (q - q // 2)).alias("start"), F.least(F.lit(width), F.col("end") + q // 2).alias("end")))


def run_lengths(r): return r.groupBy("img", (F.col("end") - F.col("start")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def label_components(df: DataFrame, eight: bool = False) -> DataFrame:
    """(img, x, y, label): connected nonzero pixels, labelled by the least run of each component.

    Runs of neighbouring lines that touch are linked, and the least label spreads along the
    links with pointer jumping, so the number of rounds grows with the logarithm of the
    longest chain of runs.
    """
    touch = 1 if eight else 0
    r = cut(runs(df).withColumn("id", F.xxhash64("img", "line", "start")))
    below = r.select("img", (F.col("line") - 1).alias("line"), F.col("start").alias("s2"), F.col("end").alias("e2"), F.col("id").alias("other"))
    links = r.join(below, ["img", "line"]).where(f"start < e2 + {touch} and s2 < end + {touch}").select("id", "other")
    both = cut(links.unionByName(links.select(F.col("other").alias("id"), F.col("id").alias("other"))))
    label = r.select("id", F.col("id").alias("label"))
    while True:
        near = both.join(label.withColumnRenamed("id", "other"), "other").groupBy("id").agg(F.min("label").alias("near"))
        step = label.join(near, "id", "left").select("id", "label", F.least("label", F.coalesce("near", "label")).alias("new"))
        jump = step.select(F.col("id").alias("new"), F.col("new").alias("over"))
        done = cut(step.join(jump, "new", "left").select("id", "label", F.least("new", F.coalesce("over", "new")).alias("new")))
        moved = done.where("label <> new").limit(1).count()
        label = done.select("id", F.col("new").alias("label"))
        if not moved:
            break
    return r.join(label, "id").select("img", F.explode(F.sequence(F.col("start"), F.col("end") - 1)).alias("x"), F.col("line").alias("y"), "label")


def distance_transform(df: DataFrame, most: int, metric: str = "squared") -> DataFrame:
    """(img, x, y, distance) to the nearest nonzero pixel within `most`: L1, chessboard or squared Euclidean."""
    size = {"l1": lambda a, b: abs(a) + abs(b), "max": lambda a, b: max(abs(a), abs(b)), "squared": lambda a, b: a * a + b * b}[metric]
    limit = most * most if metric == "squared" else most
    reach = [(a, b) for a, b in rect(most, most) if size(a, b) <= limit]
    seeds = _spread(df.where("v <> 0"), reach, [float(size(a, b)) for a, b in reach]).groupBy(*XY).agg(F.min("w").cast("long").alias("distance"))
    return df.select(*XY).join(seeds, list(XY), "left")
