"""Smoothing, gradients and resampling of pixel tables (img, x, y, v) as DataFrame operators."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.operators.images import XY, with_extent


def gauss_weights(sigma: float) -> list[float]:
    """Normalised weights at distances 0 to 1 + int(3 sigma)."""
    raw = [math.exp(-k * k / (2 * sigma * sigma)) for k in range(2 + int(3 * sigma))]
    total = 2 * sum(raw) - raw[0]
    return [w / total for w in raw]


def gauss_axis(df: DataFrame, keys: Sequence[str], axis: str, sigma: float) -> DataFrame:
    """(keys..., axis, v): Gaussian smoothing along unbroken lines of places; beyond its ends a line goes on with its last values.

    Every place hands its value on with the weights; an end also hands on the weights that would fall outside.
    """
    w = gauss_weights(sigma)
    r = len(w) - 1

    def offers(pairs):
        return F.array(*(F.struct(F.lit(d).alias("d"), F.lit(float(x)).alias("w")) for d, x in pairs))

    tails = [(k, sum(w[k + 1 :])) for k in range(r)]
    none = offers([(0, 0.0)])
    line = Window.partitionBy(*keys)
    ends = df.select(*keys, axis, "v", F.min(axis).over(line).alias("_lo"), F.max(axis).over(line).alias("_hi"))
    given = F.concat(offers([(d, w[abs(d)]) for d in range(-r, r + 1)]), F.when(F.col(axis) == F.col("_lo"), offers(tails)).otherwise(none), F.when(F.col(axis) == F.col("_hi"), offers([(-k, x) for k, x in tails])).otherwise(none))
    spread = ends.select(*keys, axis, "v", "_lo", "_hi", F.explode(given).alias("_o")).select(*keys, (F.col(axis) + F.col("_o.d")).alias(axis), (F.col("v") * F.col("_o.w")).alias("v"), "_lo", "_hi")
    return spread.where(F.col(axis).between(F.col("_lo"), F.col("_hi"))).groupBy(*keys, axis).agg(F.sum("v").alias("v"))


def gauss2d(df: DataFrame, sx: float, sy: float) -> DataFrame:
    """Columns smoothed with sy, then rows with sx."""
    return gauss_axis(gauss_axis(df, ["img", "x"], "y", sy), ["img", "y"], "x", sx).select(*XY, "v")


def forward_gradients(df: DataFrame) -> DataFrame:
    """(img, x, y, gx, gy, gm): differences to the next pixel right and above; 0 at pixels without both."""
    by_row, by_column = Window.partitionBy("img", "y").orderBy("x"), Window.partitionBy("img", "x").orderBy("y")
    near = df.select(*XY, (F.lead("v").over(by_row) - F.col("v")).alias("gx"), (F.lead("v").over(by_column) - F.col("v")).alias("gy"), F.lead("x").over(by_row).alias("_x"), F.lead("y").over(by_column).alias("_y"))
    both = F.coalesce((F.col("_x") == F.col("x") + 1) & (F.col("_y") == F.col("y") + 1), F.lit(False))
    g = near.select(*XY, F.when(both, F.col("gx")).otherwise(0).alias("gx"), F.when(both, F.col("gy")).otherwise(0).alias("gy"))
    return g.withColumn("gm", F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")))


#: Rows that one task of a scaling sorts and sums, about.
TASK_ROWS = 250_000


def _fetch(asked: DataFrame, df: DataFrame, tasks: int | None = None) -> DataFrame:
    """Pixels asked for by place (_sx, _sy), clamped to the image, with their values; dealt to so many tasks, if told."""
    clamp = [F.greatest(F.col(f"{c}0"), F.least(F.col(f"{c}1") - 1, F.col(f"_s{c}"))).cast("int").alias(f"_s{c}") for c in ("x", "y")]
    rest = [c for c in asked.columns if c not in ("_sx", "_sy")]
    source = df.select("img", F.col("x").alias("_sx"), F.col("y").alias("_sy"), F.col("v").alias("_v"))
    asked = asked.select(*rest, *clamp)
    if tasks:
        return asked.repartition(tasks, "img", "_sx", "_sy").join(source.hint("merge"), ["img", "_sx", "_sy"])
    return asked.join(source, ["img", "_sx", "_sy"])


def rotate_sample(df: DataFrame, cos: float, sin: float) -> DataFrame:
    """Rotation about the middle of the image, each pixel from the place it maps back to, moved by one half and rounded."""
    size = with_extent(df).select(*XY, "x0", "x1", "y0", "y1")
    cx, cy = F.col("x1") / 2.0, F.col("y1") / 2.0
    dx, dy = F.col("x") - cx, F.col("y") - cy
    back = size.withColumn("_sx", F.floor(dx * cos - dy * sin + cx + 1)).withColumn("_sy", F.floor(dx * sin + dy * cos + cy + 1))
    return _fetch(back, df).select(*XY, F.col("_v").alias("v"))


def scale_interpolate(df: DataFrame, sx: float, sy: float, whole: bool = True) -> DataFrame:
    """The image scaled to int(sx * width) by int(sy * height) places, each bilinear between four clamped neighbours.

    With `whole`, places are rounded to whole pixels first, so each gets one pixel's value.
    """
    size = df.groupBy("img").agg(F.lit(0).alias("x0"), F.lit(0).alias("y0"), (F.max("x") + 1).alias("x1"), (F.max("y") + 1).alias("y1"))
    size = size.withColumn("nx", F.greatest(F.lit(1), (F.col("x1") * sx).cast("int"))).withColumn("ny", F.greatest(F.lit(1), (F.col("y1") * sy).cast("int")))
    places = size.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("nx") - 1))).withColumn("y", F.explode(F.sequence(F.lit(0), F.col("ny") - 1)))
    places = places.withColumn("px", F.col("x") * F.col("x1") / F.col("nx")).withColumn("py", F.col("y") * F.col("y1") / F.col("ny"))
    if whole:
        places = places.withColumn("px", F.floor(F.col("px") + 0.5)).withColumn("py", F.floor(F.col("py") + 0.5))
    fx, fy = F.col("px") - F.floor("px"), F.col("py") - F.floor("py")
    corners = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), ((fx if i else 1 - fx) * (fy if j else 1 - fy)).alias("w")) for i in (0, 1) for j in (0, 1)))
    four = places.withColumn("c", F.explode(corners)).select(*XY, "x0", "x1", "y0", "y1", F.col("c.w").alias("w"), (F.floor("px") + F.col("c.i")).alias("_sx"), (F.floor("py") + F.col("c.j")).alias("_sy"))
    # Pixels pack so well that tasks merged by their bytes would hold any number of rows.
    tasks = 1 + int(4 * sx * sy * df.count()) // TASK_ROWS
    return _fetch(four, df, tasks).repartition(tasks, *XY).groupBy(*XY).agg(F.sum(F.col("w") * F.col("_v")).alias("v"))
