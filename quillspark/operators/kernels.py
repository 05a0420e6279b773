"""Kernels on pixel tables (img, x, y, v): reductions, hit-or-miss, lines, transfers, slices and rectangle counts.

All of them are one aggregation or one join by place; none collects an image.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.operators import images as I


def resample(df: DataFrame, step: int) -> DataFrame:
    """Number of nonzero pixels of each square of step * step."""
    at = df.select("img", F.expr(f"x div {step}").cast("int").alias("x"), F.expr(f"y div {step}").cast("int").alias("y"), (F.col("v") != 0).cast("long").alias("v"))
    return at.groupBy("img", "x", "y").agg(F.sum("v").alias("v"))


def reduce_and(df: DataFrame) -> DataFrame:
    """Half the size: 255 where all four pixels of a square are nonzero; squares cut by the border are zero."""
    n = resample(df, 2)
    return n.select("img", "x", "y", F.when(F.col("v") == 4, 255).otherwise(0).alias("v"))


def hit_or_miss(df: DataFrame, ink: Sequence[tuple[int, int]], paper: Sequence[tuple[int, int]]) -> DataFrame:
    """255 where every offset of `ink` holds a nonzero pixel and no offset of `paper` does; outside the image is paper."""
    marks = [(-dx, -dy, 1) for dx, dy in ink] + [(-dx, -dy, 0) for dx, dy in paper]
    offsets = F.array(*(F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"), F.lit(k).alias("ink")) for dx, dy, k in marks))
    votes = df.where("v <> 0").select("img", "x", "y", F.explode(offsets).alias("o")).select("img", (F.col("x") + F.col("o.dx")).alias("x"), (F.col("y") + F.col("o.dy")).alias("y"), "o.ink")
    met = votes.select("img", "x", "y", F.col("ink").alias("hit"), (1 - F.col("ink")).alias("miss"), F.lit(0).alias("own"))
    own = df.select("img", "x", "y", F.lit(0).alias("hit"), F.lit(0).alias("miss"), F.lit(1).alias("own"))
    sums = met.unionByName(own).groupBy("img", "x", "y").agg(F.sum("hit").alias("hit"), F.sum("miss").alias("miss"), F.max("own").alias("own")).where("own = 1")
    return sums.select("img", "x", "y", F.when((F.col("hit") == len(ink)) & (F.col("miss") == 0), 255).otherwise(0).alias("v"))


def line_offsets(length: int, angle: float) -> list[tuple[int, int]]:
    """Places of a line element through the origin, half its length to either side."""
    half = length // 2
    return list(dict.fromkeys((round(k * math.cos(angle)), round(k * math.sin(angle))) for k in range(-half, half + 1)))


def erode_line(df: DataFrame, length: int, angle: float) -> DataFrame: return I.neighbourhood(df, line_offsets(length, angle), F.min("v"))


def blit(dest: DataFrame, source: DataFrame, dx: int, dy: int, op: str) -> DataFrame:
    """dest with source moved by (dx, dy) combined by "and", "or", "xor" or "set"; places without a source pixel stay."""
    moved = source.select("img", (F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"), F.col("v").alias("s"))
    v, s = F.col("v"), F.col("s")
    made = {"and": v.bitwiseAND(s), "or": v.bitwiseOR(s), "xor": v.bitwiseXOR(s), "set": s}[op]
    return dest.join(moved, ["img", "x", "y"], "left").select("img", "x", "y", F.when(s.isNull(), v).otherwise(made).alias("v"))


def count_rect(df: DataFrame, x0: int, y0: int, x1: int, y1: int) -> DataFrame:
    """(img, bits, any, ratio): nonzero pixels of a rectangle, whether there is one, and their share."""
    inside = df.where((F.col("x") >= x0) & (F.col("x") < x1) & (F.col("y") >= y0) & (F.col("y") < y1))
    bits = F.sum((F.col("v") != 0).cast("long"))
    return inside.groupBy("img").agg(bits.alias("bits"), (bits > 0).alias("any"), (bits / F.count(F.lit(1))).alias("ratio"))


def row_slice(df: DataFrame, x: int): return df.where(F.col("x") == x).select("img", F.col("y").alias("at"), "v")
def column_slice(df: DataFrame, y: int): return df.where(F.col("y") == y).select("img", F.col("x").alias("at"), "v")


def put_row(df: DataFrame, x: int, values: DataFrame) -> DataFrame:
    """df with the slice at x replaced by (img, at, v)."""
    new = values.select("img", F.lit(x).alias("x"), F.col("at").alias("y"), F.col("v").alias("s"))
    return df.join(new, ["img", "x", "y"], "left").select("img", "x", "y", F.coalesce("s", "v").alias("v"))


def skeleton_points(df: DataFrame, test) -> DataFrame:
    """255 where a nonzero pixel inside a border of one has a number of nonzero neighbours that passes."""
    n = I.count_neighbours(df).withColumnRenamed("v", "n")
    e = I.with_extent(df).join(n, ["img", "x", "y"])
    inside = (F.col("x") > F.col("x0")) & (F.col("x") < F.col("x1") - 2) & (F.col("y") > F.col("y0")) & (F.col("y") < F.col("y1") - 2)
    return e.select("img", "x", "y", F.when(inside & (F.col("v") != 0) & test(F.col("n")), 255).otherwise(0).alias("v"))


def zero_crossings(df: DataFrame) -> DataFrame:
    """1 where the sign differs from that of one of four neighbours: (1, 1), (0, 1), (1, 0) and (-1, 1); borders are 0."""
    offsets = [(0, 0), (-1, -1), (0, -1), (-1, 0), (1, -1)]  # where a pixel is looked at from
    signs = df.select("img", "x", "y", F.signum(F.col("v").cast("double")).cast("int").alias("v"))
    seen = I.neighbourhood(signs, offsets, F.struct(F.min("v").alias("lo"), F.max("v").alias("hi")))
    inside = (F.col("x") > F.col("x0")) & (F.col("x") < F.col("x1") - 1) & (F.col("y") > F.col("y0")) & (F.col("y") < F.col("y1") - 1)
    e = I.with_extent(signs).select("img", "x", "y", inside.alias("inside")).join(seen, ["img", "x", "y"])
    return e.select("img", "x", "y", F.when(F.col("inside") & (F.col("v.lo") != F.col("v.hi")), 1).otherwise(0).alias("v"))
