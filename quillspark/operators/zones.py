"""Recursive X-Y cuts of pages into zones, all open zones of all pages at once.

A round projects the ink of every open zone on both axes in two aggregations, takes noise off,
shrinks the zone to its ink, finds the widest inner gap of each profile, and cuts the zone in
the middle of the wider one if that exceeds its limit. Zones without such a gap are leaves, and
their pixels take no part in later rounds; so rounds grow with the depth of the cuts only, and a
round's rows with the ink of the open zones.

Pages are tables (img, x, y) of ink pixels with the page's size in columns width and height.

Defined cases: a page without ink has no zone; a zone of one pixel is a leaf; of two equally wide
gaps of one axis the first counts, of equal gaps of both axes the one that is cut horizontally.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.operators.durable import cut

_ZONE = ("img", "zone")


def _profile(ink: DataFrame, axis: str) -> DataFrame:
    """(img, zone, at, n): ink on each line of the zone across axis."""
    return ink.groupBy(*_ZONE, F.col(axis).alias("at")).agg(F.count(F.lit(1)).alias("n"))


def _gaps(profile: DataFrame, noise: DataFrame, axis: str, origin: str) -> DataFrame:
    """(img, zone, gap_<axis>, cut_<axis>) of the widest inner gap between lines that hold more than the zone's noise."""
    held = profile.join(noise.select(*_ZONE, F.col(f"noise_{axis}").alias("_noise"), F.col(origin).alias("_from")), list(_ZONE)).where("n > _noise")
    after = F.lag("at").over(Window.partitionBy(*_ZONE).orderBy("at")) + 1
    gaps = held.select(*_ZONE, "at", after.alias("_start"), "_from").where("at > _start")
    middle = F.col("_from") + F.expr("(at - _from + _start - _from) div 2")
    widest = F.max(F.struct((F.col("at") - F.col("_start")).alias("gap"), (-F.col("at")).alias("_first"), middle.alias("cut")))
    return gaps.groupBy(*_ZONE).agg(widest.alias("_w")).select(*_ZONE, F.col("_w.gap").alias(f"gap_{axis}"), F.col("_w.cut").cast("int").alias(f"cut_{axis}"))


def xy_cut(ink: DataFrame, noise_x: float = 0, noise_y: float = 0, least_x: int = 0, least_y: int = 0) -> DataFrame:
    """(img, zone, x0, y0, x1, y1): the leaves, with exclusive ends; zone is the path of cuts, 0 for the lower or left part.

    noise_x is the ink that a column of a full page may hold as noise, noise_y that of a row;
    zones have their share by height or width. Gaps must be wider than least_x (between columns) or least_y (between rows).
    """
    page = ink.select("img", "x", "y", "width", "height", F.lit("").alias("zone"), F.lit(0).alias("from_x"), F.lit(0).alias("from_y"))
    ink, leaves = cut(page), []
    while ink.limit(1).count():
        boxes = ink.groupBy(*_ZONE).agg(
            F.min("x").alias("x0"), F.min("y").alias("y0"), (F.max("x") + 1).alias("x1"), (F.max("y") + 1).alias("y1"),
            F.first("width").alias("width"), F.first("height").alias("height"), F.first("from_x").alias("from_x"), F.first("from_y").alias("from_y"),
        )
        # A column's noise goes by the zone's height, a row's by its width.
        noise: dict[str, Column] = {
            "noise_x": ((F.col("y1") - F.col("y0")) * (F.lit(float(noise_x)) / F.col("height"))).cast("int"),
            "noise_y": ((F.col("x1") - F.col("x0")) * (F.lit(float(noise_y)) / F.col("width"))).cast("int"),
        }
        boxes = boxes.withColumns(noise)
        told = boxes
        for axis in "xy":
            told = told.join(_gaps(_profile(ink, axis), boxes, axis, f"from_{axis}"), list(_ZONE), "left")
        gap = {a: F.coalesce(F.col(f"gap_{a}"), F.lit(-1)) for a in "xy"}
        wide = {"x": gap["x"] > least_x, "y": gap["y"] > least_y}
        rows_first = gap["y"] >= gap["x"]
        axis = F.when(wide["y"] & (rows_first | ~wide["x"]), "y").when(wide["x"], "x")
        told = cut(told.select(*_ZONE, "x0", "y0", "x1", "y1", axis.alias("axis"), F.when(axis == "y", F.col("cut_y")).otherwise(F.col("cut_x")).alias("cut")))
        leaves.append(told.where("axis is null").select(*_ZONE, "x0", "y0", "x1", "y1"))
        split = told.where("axis is not null").select(*_ZONE, "axis", "cut", F.col("x0").alias("_x0"), F.col("y0").alias("_y0"))
        met = ink.join(split, list(_ZONE))
        above = F.when(F.col("axis") == "y", F.col("y")).otherwise(F.col("x")) >= F.col("cut")
        start = lambda a: F.when(above & (F.col("axis") == a), F.col("cut")).otherwise(F.col(f"_{a}0"))
        ink = cut(met.select("img", "x", "y", "width", "height", F.concat("zone", F.when(above, "1").otherwise("0")).alias("zone"), start("x").alias("from_x"), start("y").alias("from_y")))
    return reduce(DataFrame.unionByName, leaves, ink.select(*_ZONE, *(F.col("x").alias(c) for c in ("x0", "y0", "x1", "y1"))))
