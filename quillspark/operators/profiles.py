"""Projection profiles: gaps, islands with hysteresis, and cuts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def profile_islands(profile: DataFrame, low: int, high: int) -> DataFrame:
    """(img, island, start, end): stretches of (img, at, n) with n >= low that reach `high`, numbered in order."""
    w = Window.partitionBy("img").orderBy("at")
    g = profile.where(F.col("n") >= low).withColumn("g", F.col("at") - F.row_number().over(w))
    s = g.groupBy("img", "g").agg(F.min("at").alias("start"), (F.max("at") + 1).alias("end"), F.max("n").alias("top")).where(F.col("top") >= high)
    return s.select("img", F.row_number().over(Window.partitionBy("img").orderBy("start")).alias("island"), "start", "end")


def gaps(profile: DataFrame, size: int) -> DataFrame:
    """(img, start, end): places 0..size without ink."""
    w = Window.partitionBy("img").orderBy("at")
    ink = profile.where("n > 0")
    inner = ink.select("img", (F.coalesce(F.lag("at").over(w), F.lit(-1)) + 1).alias("start"), F.col("at").alias("end"))
    tail = ink.groupBy("img").agg((F.max("at") + 1).alias("start")).withColumn("end", F.lit(size))
    return inner.unionByName(tail).where("start < end")


def widest_gap(profile: DataFrame, size: int) -> DataFrame:
    """The longest gap of each image; of equal ones the first."""
    g = gaps(profile, size).withColumn("w", F.col("end") - F.col("start"))
    return g.groupBy("img").agg(F.max(F.struct("w", (-F.col("start")).alias("s"), "end")).alias("m")).select("img", (-F.col("m.s")).alias("start"), "m.end")


def cut_words(profile: DataFrame, size: int, words: int) -> DataFrame:
    """The words - 1 widest inner gaps as cuts, left to right; none where there are fewer."""
    inner = gaps(profile, size).where(f"start > 0 and end < {size}")
    ranked = inner.withColumn("k", F.row_number().over(Window.partitionBy("img").orderBy(F.desc(F.col("end") - F.col("start")), "start")))
    most = ranked.withColumn("n", F.max("k").over(Window.partitionBy("img")))
    return most.where((F.col("k") < words) & (F.col("n") >= words - 1)).select("img", "start", "end")


def gaussian(profile: DataFrame, sigma: float) -> DataFrame:
    """(img, at, v): a normalised Gaussian over the places that exist, half-width 1 + int(3 sigma)."""
    import math

    r = 1 + int(3 * sigma)
    weights = {k: math.exp(-k * k / (2 * sigma * sigma)) for k in range(-r, r + 1)}
    items = F.array(*(F.struct(F.lit(k).alias("d"), F.lit(w).alias("w")) for k, w in weights.items()))
    s = profile.select("img", "at", "n", F.explode(items).alias("o")).select("img", (F.col("at") + F.col("o.d")).alias("at"), F.col("n"), F.col("o.w").alias("w"), (F.col("o.d") == 0).alias("own"))
    return s.groupBy("img", "at").agg((F.sum(F.col("n") * F.col("w")) / F.sum("w")).alias("v"), F.max("own").alias("own")).where("own").drop("own")


def row_spacing(lines: DataFrame) -> DataFrame:
    """(page, spacing, n): distances between the baselines of a page's neighbouring lines."""
    w = Window.partitionBy("page").orderBy("baseline")
    d = lines.select("page", (F.col("baseline") - F.lag("baseline").over(w)).alias("spacing")).where("spacing is not null")
    return d.groupBy("page", "spacing").agg(F.count(F.lit(1)).alias("n"))
