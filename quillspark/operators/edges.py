"""Edges and corners of pixel tables: suppression, fractiles, hysteresis and curvature as DataFrame operators."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.operators.images import XY, rect

#: Steps of the flood fill from a strong pixel; the step to the left and below is not among them.
FLOOD_STEPS = ((1, 0), (0, 1), (-1, 0), (0, -1), (1, 1), (-1, 1), (1, -1))


def around(df: DataFrame, value: str, *keep: str) -> DataFrame:
    """(img, x, y, keep..., n): n maps `dx,dy` to the value there, of pixels that have all eight neighbours.

    Every pixel hands its value to nine places; one shuffle by place.
    """
    items = F.array(*(F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in rect(1, 1)))
    spread = df.select(*XY, *keep, F.col(value).cast("double").alias("_v"), F.explode(items).alias("_o"))
    own = (F.col("_o.dx") == 0) & (F.col("_o.dy") == 0)
    cells = [F.max(F.when((F.col("_o.dx") == -dx) & (F.col("_o.dy") == -dy), F.col("_v"))).alias(_cell(dx, dy)) for dx, dy in rect(1, 1)]
    placed = spread.groupBy("img", (F.col("x") + F.col("_o.dx")).alias("x"), (F.col("y") + F.col("_o.dy")).alias("y")).agg(*(F.max(F.when(own, F.col(k))).alias(k) for k in keep), *cells, F.count("_v").alias("_n"))
    return placed.where("_n = 9").drop("_n")


def _cell(dx: int, dy: int) -> str:
    return f"n{dx + 1}{dy + 1}"


def suppress(gradients: DataFrame) -> DataFrame:
    """(img, x, y, gm) of the inner pixels whose magnitude is above what interpolation gives one step back along the gradient, and not below one step ahead."""
    near = around(gradients, "gm", "gx", "gy")
    ux, uy = F.abs("gx"), F.abs("gy")
    bx, by = F.when(F.col("gx") >= 0, 1).otherwise(-1), F.when(F.col("gy") >= 0, 1).otherwise(-1)
    steep = ux > uy
    ahead = near.withColumns({"_bx": bx, "_by": by, "_big": F.greatest(ux, uy), "_small": F.least(ux, uy), "_ax": F.when(steep, bx).otherwise(0), "_ay": F.when(steep, 0).otherwise(by)})

    def at(x, y):
        return F.coalesce(*(F.when((x == dx) & (y == dy), F.col(_cell(dx, dy))) for dx, dy in rect(1, 1)))

    def between(sign):
        return F.col("_small") * at(sign * F.col("_bx"), sign * F.col("_by")) + (F.col("_big") - F.col("_small")) * at(sign * F.col("_ax"), sign * F.col("_ay"))

    own = F.col("_big") * F.col(_cell(0, 0))
    return ahead.where((own > between(-1)) & (own >= between(1))).select(*XY, F.col(_cell(0, 0)).alias("gm"))


def nonzero_fractile(df: DataFrame, value: str, fraction: float, bins: int) -> DataFrame:
    """(img, fractile) of the nonzero values by a histogram of `bins` buckets; the least value where there are under two or all are equal."""
    v = F.col(value)
    some = df.where(v != 0)
    size = some.groupBy("img").agg(F.min(v).alias("lo"), F.max(v).alias("hi"), F.count(F.lit(1)).alias("count"))
    bucket = F.least(F.lit(bins - 1), F.floor(F.lit(bins) / (F.col("hi") - F.col("lo")) * (v - F.col("lo")))).cast("int")
    hist = some.join(size.where("hi > lo"), "img").groupBy("img", bucket.alias("b")).agg(F.count(F.lit(1)).alias("n"))
    piles = hist.groupBy("img").agg(F.array_sort(F.collect_list(F.struct("b", "n"))).alias("h"))  # at most `bins` entries
    limit = F.floor(F.col("count") * fraction)
    start = F.struct(F.lit(0).cast("long").alias("s"), F.lit(0).alias("i"))
    steps = F.aggregate("h", start, lambda a, p: F.when(a["s"] < limit, F.struct((a["s"] + p["n"]).alias("s"), (p["b"] + 1).alias("i"))).otherwise(a))["i"]
    return size.join(piles, "img", "left").select("img", F.when(F.col("h").isNull(), F.col("lo")).otherwise((F.col("hi") - F.col("lo")) * F.when(limit > 0, steps).otherwise(0) / bins + F.col("lo")).alias("fractile"))


def hysteresis(df: DataFrame, value: str, low: float, high: float) -> DataFrame:
    """(img, x, y, v): 1 for pixels of `high` or more and those of `low` or more that the flood reaches from them, 0.5 for others of `low` or more, else 0.

    One image to a task.
    """

    def flood(pdf):
        x, y, v = pdf["x"].to_numpy(np.int64), pdf["y"].to_numpy(np.int64), pdf["g"].to_numpy(float)
        place = {(a, b): k for k, (a, b) in enumerate(zip(x.tolist(), y.tolist(), strict=True)) if v[k] >= low or v[k] >= high}
        out = np.where((v >= low) | (v >= high), 0.5, 0.0)
        todo = np.flatnonzero(v >= high).tolist()
        out[todo] = 1.0
        while todo:
            k = todo.pop()
            for dx, dy in FLOOD_STEPS:
                j = place.get((x[k] + dx, y[k] + dy))
                if j is not None and out[j] != 1.0:
                    out[j] = 1.0
                    todo.append(j)
        return pd.DataFrame({"img": pdf["img"], "x": pdf["x"], "y": pdf["y"], "v": out})

    kind = df.schema["img"].dataType.simpleString()
    return df.select(*XY, F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("g")).groupBy("img").applyInPandas(flood, f"img {kind}, x int, y int, v double")


def level_curvature(df: DataFrame, scaled: bool = False) -> DataFrame:
    """(img, x, y, v): curvature of the level curves at inner pixels, 0 where the image is flat; `scaled` leaves out the division by the squared gradient."""
    n = around(df, "v")

    def p(dx, dy):
        return F.col(_cell(dx, dy))

    dx, dy = 0.5 * (p(1, 0) - p(-1, 0)), 0.5 * (p(0, 1) - p(0, -1))
    dxx, dyy = 2 * p(0, 0) - p(-1, 0) - p(1, 0), 2 * p(0, 0) - p(0, -1) - p(0, 1)
    dxy = p(-1, -1) + p(1, 1) - p(1, -1) - p(-1, 1)
    curve, steep = dxx * dy * dy - 2 * dxy * dx * dy + dyy * dx * dx, dx * dx + dy * dy
    return n.select(*XY, F.when(steep == 0, 0.0).otherwise(curve if scaled else curve / steep).alias("v"))
