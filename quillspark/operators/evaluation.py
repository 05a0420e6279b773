"""Comparing two segmentations, page statistics, least squares and weighted draws as DataFrame operators."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.operators import resample as M
from quillspark.operators import stats as S

#: Buckets that carry running weights to the driver and back.
BUCKETS = 1024


def _sides(cells: DataFrame, noise: tuple[int, int]) -> DataFrame:
    """(side, label, n, total): the cells of every model and image segment, and its overlap with what is not noise.

    A model's cell with the image's noise counts as a part; an image's cell with the model's noise does not.
    """
    model = cells.where(F.col("a") != noise[0]).select(F.lit("model").alias("side"), F.col("a").alias("label"), "n", (F.col("b") != noise[1]).alias("clear"), F.lit(True).alias("part"))
    image = cells.where(F.col("b") != noise[1]).select(F.lit("image").alias("side"), F.col("b").alias("label"), "n", (F.col("a") != noise[0]).alias("clear"), (F.col("a") != noise[0]).alias("part"))
    total = F.sum(F.when(F.col("clear"), F.col("n")).otherwise(0)).over(Window.partitionBy("side", "label"))
    return model.unionByName(image).withColumn("total", total)


def segment_report(cells: DataFrame, threshold: float, least: int, noise: tuple[int, int]) -> DataFrame:
    """(side, segments, parts, split, unmatched) from cells (a, b, n) of labels above 0.

    A part is a cell with more than `threshold` of its segment, or with `least` or more; a
    segment of several parts is split; one that meets only noise is unmatched and is one part.
    """
    is_part = F.col("part") & ((F.col("n") / F.col("total") > threshold) | (F.col("n") >= least))
    each = _sides(cells, noise).groupBy("side", "label", "total").agg(F.sum(F.when((F.col("total") > 0) & is_part, 1).otherwise(0)).alias("k"))
    lost = F.col("total") == 0
    return each.groupBy("side").agg(F.count(F.lit(1)).alias("segments"), F.sum(F.when(lost, 1).otherwise(F.col("k"))).alias("parts"), F.sum((~lost & (F.col("k") > 1)).cast("long")).alias("split"), F.sum(lost.cast("long")).alias("unmatched"))


def share_histogram(cells: DataFrame, buckets: int, noise: tuple[int, int]) -> DataFrame:
    """(side, bucket, n): how many cells have which share of their segment."""
    share = F.least(F.lit(buckets - 1), F.floor(F.col("n") / F.col("total") * buckets)).cast("int")
    return _sides(cells, noise).where("part and total > 0").groupBy("side", share.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def one_to_one(cells: DataFrame, threshold: float, least: int, noise: tuple[int, int]) -> DataFrame:
    """(a, b, n) of the cells with 1 - threshold of both margins and at least `least`, while no other cell of their row or column has that much."""
    row, column = Window.partitionBy("a"), Window.partitionBy("b")
    big = F.when(F.col("n") >= least, 1).otherwise(0)
    c = cells.where((F.col("a") != noise[0]) & (F.col("b") != noise[1]))
    c = c.select("*", F.sum("n").over(row).alias("row"), F.sum("n").over(column).alias("col"), F.sum(big).over(row).alias("row_big"), F.sum(big).over(column).alias("col_big"))
    return c.where((F.col("n") >= least) & (F.col("n") >= (1 - threshold) * F.greatest("row", "col")) & (F.col("row_big") == 1) & (F.col("col_big") == 1)).select("a", "b", "n")


def settled_median(hist: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The percentile at one half; if its pile is empty, the middle of the piles around it."""
    at = S.percentile(hist, 0.5, by).withColumnRenamed("percentile", "p")
    pairs = hist.where("n > 0").join(F.broadcast(at), list(by)) if by else hist.where("n > 0").join(F.broadcast(at))  # one row a group
    pile = F.floor("p")
    found = pairs.groupBy(*by, "p").agg(F.max(F.when(F.col("bucket") <= pile, F.col("bucket"))).alias("below"), F.min(F.when(F.col("bucket") >= pile, F.col("bucket"))).alias("above"), F.sum("n").alias("n"))
    empty = (F.col("below") < F.col("above")) & (F.col("n") > 1)
    return found.select(*by, F.when(empty, (F.col("below") + F.col("above")) / 2).otherwise(F.col("p")).alias("median"))


def x_height(boxes: DataFrame, height: str, by: str, limit: int = 200, low: int = 2, sigma: float = 4.0) -> DataFrame:
    """(by, x_height): the peak of the smoothed histogram of heights below `limit`, from `low` up; of equal peaks the last."""
    hist = S.histogram(boxes.where(F.col(height) < limit), F.col(height), [by])
    dense = hist.groupBy(by).agg(F.max("bucket").alias("top")).select(by, F.explode(F.sequence(F.lit(0), F.col("top"))).alias("bucket"))
    full = dense.join(hist, [by, "bucket"], "left").select(by, "bucket", F.coalesce("n", F.lit(0)).cast("double").alias("v"))
    smooth = M.gauss_axis(full, [by], "bucket", sigma).where(F.col("bucket") >= low)
    return smooth.groupBy(by).agg(F.max(F.struct(F.round("v", 9).alias("v"), "bucket")).alias("m")).select(by, F.col("m.bucket").alias("x_height"))


def page_skew(rows: DataFrame, by: str, gradient: str, error: str, blobs: str, least: int = 4, fraction: float = 0.5) -> DataFrame:
    """(by, gradient, error): order statistics int(fraction * n) over a page's rows of `least` blobs or more, or over all if it has none."""
    enough = F.col(blobs) >= least
    used = rows.withColumn("_any", F.max(enough).over(Window.partitionBy(by))).where(enough | ~F.col("_any"))
    m = S.fractile(used, gradient, fraction, [by]).withColumnRenamed("fractile", "gradient")
    return m.join(S.fractile(used, error, fraction, [by]).withColumnRenamed("fractile", "error"), by)


def chi_squared_limit(degrees: int, alpha: float) -> float:
    """The value that a chi-squared variable exceeds with probability alpha; odd degrees count as the next even number."""
    half = (degrees + 1) // 2

    def beyond(x):
        return sum(math.exp(-x / 2 + k * math.log(x / 2) - math.lgamma(k + 1)) for k in range(half))

    low, high = 1e-12, 1.0
    while beyond(high) > alpha:
        high *= 2
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if beyond(middle) > alpha else (low, middle)
    return high


def least_squares(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """(k, weight) by the normal equations: one pass, and a row of (features + 1)**2 sums to the driver."""
    d = len(features)
    sums = [F.sum(F.col(a).cast("double") * F.col(b)).alias(f"s{i}_{j}") for i, a in enumerate(features) for j, b in enumerate([*features, target])]
    r = df.agg(*sums).first()
    table = np.array([[r[f"s{i}_{j}"] or 0.0 for j in range(d + 1)] for i in range(d)], float)
    weights = np.linalg.lstsq(table[:, :d], table[:, d], rcond=None)[0]
    return df.sparkSession.createDataFrame([(k, float(w)) for k, w in enumerate(weights)], "k int, weight double")


def weighted_draws(rows: DataFrame, draws: DataFrame) -> DataFrame:
    """(draw, id): for each (draw, u), u in [0, 1), the row (id, weight) whose stretch of the running weights holds u.

    Rows stand in the order of (id mod BUCKETS, id). Only the buckets' sums meet at the driver.
    Null and negative weights are 0 and are never drawn.
    """
    r = rows.select("id", F.greatest(F.coalesce("weight", F.lit(0)), F.lit(0)).cast("double").alias("weight"), F.pmod("id", F.lit(BUCKETS)).cast("int").alias("bucket")).where("weight > 0")
    sums = {x["bucket"]: x["s"] for x in r.groupBy("bucket").agg(F.sum("weight").alias("s")).collect()}
    names = sorted(sums)
    starts = [0.0]
    for b in names:
        starts.append(starts[-1] + sums[b])
    if not names:
        return draws.select("draw", F.lit(None).cast(rows.schema["id"].dataType).alias("id")).limit(0)
    value = F.col("u") * starts[-1]
    place = F.size(F.filter(F.lit(starts[:-1]), lambda s: s <= value))
    inside = Window.partitionBy("bucket").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    start = F.element_at(F.create_map(*(F.lit(x) for p in zip(names, starts, strict=False) for x in p)), F.col("bucket"))
    low = r.select("bucket", (start + F.sum("weight").over(inside) - F.col("weight")).alias("at"), F.lit(None).cast(draws.schema["draw"].dataType).alias("draw"), "id")
    asked = draws.select(F.element_at(F.lit(names), place).alias("bucket"), value.alias("at"), "draw", F.lit(None).cast(rows.schema["id"].dataType).alias("id"))
    upto = Window.partitionBy("bucket").orderBy("at", F.col("draw").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    return low.unionByName(asked).withColumn("id", F.last("id", True).over(upto)).where("draw is not null").select("draw", "id")


def merge_datasets(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Rows of all datasets by column name; features may differ in length, columns that one lacks are null there."""
    for other in others:
        first = first.unionByName(other, allowMissingColumns=True)
    return first


def split_samples(df: DataFrame, key: str, fraction: float) -> DataFrame:
    """All rows with a column `testing`, true for exactly int(fraction * n) of them: the first in the order of (key mod BUCKETS, key).

    Only the buckets' counts meet at the driver, and only one bucket is ranked.
    """
    b = F.coalesce(F.pmod(key, F.lit(BUCKETS)).cast("int"), F.lit(BUCKETS))
    counts = {r["b"]: r["count"] for r in df.groupBy(b.alias("b")).count().collect()}
    left, whole, edge = int(fraction * sum(counts.values())), [], None
    for k in sorted(counts):
        if counts[k] > left:
            edge = k
            break
        whole.append(k)
        left -= counts[k]
    if edge is None:
        return df.withColumn("testing", F.lit(True))
    rest = df.where(b != edge).withColumn("testing", b.isin(*whole) if whole else F.lit(False))
    ranked = df.where(b == edge).withColumn("testing", F.row_number().over(Window.partitionBy(b).orderBy(key)) <= left)
    return rest.unionByName(ranked)
