"""Histograms, fractiles, confusion counts and other aggregates as DataFrame operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.operators.durable import cut


def histogram(df: DataFrame, bucket: Column, by: Sequence[str] = (), clip: tuple[int, int] | None = None) -> DataFrame:
    """(by..., bucket, n); values beyond `clip` fall into its end buckets."""
    b = F.least(F.greatest(bucket, F.lit(clip[0])), F.lit(clip[1])) if clip else bucket
    return df.groupBy(*by, b.cast("int").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def mode(hist: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The fullest bucket; of equal ones the highest."""
    return hist.groupBy(*by).agg(F.max(F.struct("n", "bucket")).alias("m")).select(*by, F.col("m.bucket").alias("mode"))


def moments(hist: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean and population deviation of the buckets."""
    b, n = F.col("bucket"), F.col("n")
    mean = F.sum(b * n) / F.sum(n)
    return hist.groupBy(*by).agg(mean.alias("mean"), F.sqrt(F.greatest(F.lit(0.0), F.sum(b * b * n) / F.sum(n) - mean * mean)).alias("sd"))


def _running(hist: DataFrame, by: Sequence[str]) -> DataFrame:
    upto = Window.partitionBy(*by).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*by)
    return hist.withColumn("upto", F.sum("n").over(upto)).withColumn("total", F.sum("n").over(whole))


def percentile(hist: DataFrame, fraction: float, by: Sequence[str] = ()) -> DataFrame:
    """The place where `fraction` of the mass lies below, linear inside a unit bucket."""
    at = _running(hist, by).where(F.col("upto") >= F.col("total") * fraction)
    first = at.groupBy(*by).agg(F.min(F.struct("bucket", "upto", "n", "total")).alias("f"))
    inside = (F.col("f.total") * fraction - (F.col("f.upto") - F.col("f.n"))) / F.col("f.n")
    return first.select(*by, (F.col("f.bucket") + inside).alias("percentile"))


def half_mass(hist: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The least k such that the first k buckets hold half of the mass."""
    return _running(hist, by).where("2 * upto >= total").groupBy(*by).agg((F.min("bucket") + 1).alias("half_mass"))


def smooth(hist: DataFrame, radius: int, by: Sequence[str] = ()) -> DataFrame:
    """Triangular smoothing: weight radius - distance; sums over a dense range of buckets."""
    spread = hist.select(*by, "bucket", "n", F.explode(F.sequence(F.lit(1 - radius), F.lit(radius - 1))).alias("d"))
    return spread.groupBy(*by, (F.col("bucket") + F.col("d")).alias("bucket")).agg(F.sum(F.col("n") * (radius - F.abs("d"))).alias("n"))


def otsu(hist: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The threshold of the greatest variance between classes; of equal ones the first."""
    upto = Window.partitionBy(*by).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*by)
    b = F.col("bucket").cast("double")
    r = hist.withColumn("w0", F.sum("n").over(upto)).withColumn("s0", F.sum(b * F.col("n")).over(upto))
    r = r.withColumn("w", F.sum("n").over(whole)).withColumn("s", F.sum(b * F.col("n")).over(whole)).where("w0 < w")
    gap = F.col("s0") / F.col("w0") - (F.col("s") - F.col("s0")) / (F.col("w") - F.col("w0"))
    r = r.withColumn("between", F.round(F.col("w0") * (F.col("w") - F.col("w0")) * gap * gap, 3))
    return r.groupBy(*by).agg(F.max(F.struct("between", (-F.col("bucket")).alias("b"))).alias("m")).select(*by, (-F.col("m.b")).alias("threshold"))


#: Groups whose rows of three numbers are broadcast.
BROADCAST_GROUPS = 100_000


def fractile(df: DataFrame, value: str, fraction: float, by: Sequence[str] = (), buckets: int = 4096) -> DataFrame:
    """sorted[int(fraction * n)] without interpolation, by an exact rank; nulls come first.

    Two levels: counts of `buckets` ranges between a group's ends tell the range that holds the
    rank, and only the distinct values of that range are ranked, so no group is sorted whole. A
    row a group is joined back to the rows: as a broadcast up to BROADCAST_GROUPS groups, which
    are counted first, so that no row is moved by its group; beyond that a group is a small share.
    """
    group, v = F.struct(*by) if by else F.struct(F.lit(0)), F.col(value).cast("double")
    rows = df.select(*by, F.col(value).alias("fractile"), group.alias("_g"), v.alias("_v"))
    ends = cut(rows.groupBy("_g").agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi")))
    few = F.broadcast if ends.count() <= BROADCAST_GROUPS else lambda groups: groups
    place = F.least(F.floor((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * buckets), F.lit(buckets - 1))
    ranged = rows.join(few(ends), "_g").withColumn("_b", F.when(F.col("_v").isNull(), -1).when(F.col("_lo") == F.col("_hi"), 0).otherwise(place).cast("long"))
    counts = ranged.groupBy("_g", "_b").agg(F.count(F.lit(1)).alias("_n"))
    own = Window.partitionBy("_g")
    upto, size = F.sum("_n").over(own.orderBy("_b")), F.sum("_n").over(own)
    ranks = counts.select("_g", "_b", (upto - F.col("_n")).alias("_before"), upto.alias("_upto"), F.least(F.floor(size * fraction), size - 1).alias("_at"))
    target = ranks.where("_before <= _at and _at < _upto").select("_g", "_b", (F.col("_at") - F.col("_before")).alias("_left"))
    inside = ranged.join(few(target), ["_g", "_b"]).groupBy("_g", *by, "fractile", "_left").agg(F.count(F.lit(1)).alias("_n"))
    inside = inside.withColumn("_upto", F.sum("_n").over(own.orderBy("fractile")))
    return inside.where("_upto > _left and _upto - _n <= _left").select(*by, "fractile")


def confusion(df: DataFrame, predicted: str, true: str) -> DataFrame:
    """(pred, true, n) of rows with both classes known (>= 0)."""
    known = df.where((F.col(predicted) >= 0) & (F.col(true) >= 0))
    return known.groupBy(F.col(predicted).alias("pred"), F.col(true).alias("true")).agg(F.count(F.lit(1)).alias("n"))


def confusion_error(matrix: DataFrame) -> DataFrame:
    """Off-diagonal mass, total and share."""
    off = F.sum(F.when(F.col("pred") != F.col("true"), F.col("n")).otherwise(0))
    return matrix.agg(off.alias("wrong"), F.sum("n").alias("total"), F.round(off / F.sum("n"), 9).alias("error"))


def confusions(matrix: DataFrame) -> DataFrame:
    """Off-diagonal cells, most frequent first."""
    return matrix.where(F.col("pred") != F.col("true")).orderBy(F.desc("n"), "pred", "true")


def least_squares_line(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Slope and intercept."""
    return df.groupBy(*by).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))


def segmentation_counts(df: DataFrame, a: str, b: str) -> DataFrame:
    """Contingency of two labellings, 0 is background: (over, under, total) segments."""
    cells = df.where((F.col(a) != 0) & (F.col(b) != 0)).groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    over = cells.groupBy(a).agg((F.count(F.lit(1)) - 1).alias("k")).agg(F.sum("k").alias("over"))
    under = cells.groupBy(b).agg((F.count(F.lit(1)) - 1).alias("k")).agg(F.sum("k").alias("under"))
    return over.join(F.broadcast(under)).join(F.broadcast(cells.agg(F.count(F.lit(1)).alias("cells"))))  # one row each


def top_n(df: DataFrame, n: int, value: str, tie: str, by: Sequence[str] = ()) -> DataFrame:
    """The n largest of each group; the earlier of equal ones stays first."""
    if not by:
        return df.orderBy(F.desc(value), tie).limit(n)
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(value), tie))).where(F.col("rank") <= n)


def dense_relabel(df: DataFrame, label: str, keep: Sequence[int] = (0, 0xFFFFFF)) -> DataFrame:
    """A column `dense`: labels renumbered from 1 in numeric order; background and don't-care stay."""
    labels = df.where(~F.col(label).isin(*keep)).select(label).distinct()
    coded = labels.withColumn("dense", F.dense_rank().over(Window.orderBy(label)))
    return df.join(coded, label, "left").withColumn("dense", F.coalesce("dense", F.col(label)))


def evaluate_lines(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Corpus error rate: edit distances over truth lengths."""
    d = F.levenshtein(F.col(truth), F.col(predicted))
    return df.agg(F.sum(d).alias("errors"), F.sum(F.length(truth)).alias("total"), F.round(F.sum(d) / F.sum(F.length(truth)), 9).alias("rate"))
