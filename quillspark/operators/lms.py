"""Lines of least median of squared residuals: candidates through pairs of points, all candidates of all groups at once.

The candidates of a group go through pairs of points that a hash of trial and id picks. The median of
each candidate's squared residuals is an exact order statistic by two-level counts, so no
group is sorted, and the candidate of least median wins.

Defined cases: a group of one point gives the horizontal line through it, of two the line through
both; a pair of equal x gives the horizontal line between them; of equal medians the first trial counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.operators.durable import cut
from quillspark.operators.stats import BROADCAST_GROUPS, fractile

#: Pairs of points that are tried for each group.
TRIALS = 12


def _few(groups: DataFrame) -> DataFrame:
    """groups, a row a group, as a broadcast up to BROADCAST_GROUPS, so that no point is moved by its group."""
    return F.broadcast(groups) if groups.count() <= BROADCAST_GROUPS else groups


def _least(drawn: DataFrame, key: list[str], salt: str) -> DataFrame:
    """(key, _p): the point of least md5 of salt, trial and id in each group.

    The least first 60 bits come from sums of fixed size, which no task has to sort its rows
    for; the whole hash decides among the points that share them.
    """
    h = F.md5(F.concat_ws(":", F.lit(salt), "trial", F.col("id").cast("string")))
    hashed = drawn.withColumn("_h", h).withColumn("_top", F.conv(F.substring("_h", 1, 15), 16, 10).cast("long"))
    tops = cut(hashed.groupBy(*key).agg(F.min("_top").alias("_top")))
    left = hashed.join(_few(tops), [*key, "_top"])
    return cut(left.groupBy(*key).agg(F.min(F.struct(F.col("_h").alias("h"), "id", "x", "y")).alias("_p")))


def candidates(points: DataFrame, by: list[str], trials: int = TRIALS) -> DataFrame:
    """(by, trial, m, c): lines y = m x + c of points (by, id, x, y) with ids that are unique in their group."""
    drawn = points.withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(trials - 1))))
    key = [*by, "trial"]
    first = _least(drawn, key, "first").withColumnRenamed("_p", "p")
    other = drawn.join(_few(first.select(*key, F.col("p.id").alias("_id"))), key).where(F.col("id") != F.col("_id")).drop("_id")
    both = first.join(_least(other, key, "second").withColumnRenamed("_p", "q"), key, "left")
    level = F.coalesce((F.col("p.y") + F.col("q.y")) / 2, F.col("p.y"))
    sloped = F.col("p.x") != F.col("q.x")
    m = F.when(sloped, (F.col("q.y") - F.col("p.y")) / (F.col("q.x") - F.col("p.x"))).otherwise(0.0)
    return both.select(*key, m.alias("m"), F.when(sloped, F.col("p.y") - m * F.col("p.x")).otherwise(level).alias("c"))


def fit_lines(points: DataFrame, by: list[str], trials: int = TRIALS) -> DataFrame:
    """(by, m, c, error): for each group of points (by, id, x, y) its best candidate and the median of its squared residuals, that of place n // 2."""
    points = points.select(*by, "id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    lines = cut(candidates(points, by, trials))
    rest = F.col("y") - F.col("m") * F.col("x") - F.col("c")
    errors = points.join(_few(lines), by).select(*by, "trial", (rest * rest).alias("_e"))
    medians = fractile(errors, "_e", 0.5, [*by, "trial"]).withColumnRenamed("fractile", "error")
    best = medians.join(lines, [*by, "trial"]).groupBy(*by).agg(F.min(F.struct("error", "trial", "m", "c")).alias("b"))
    return best.select(*by, "b.m", "b.c", "b.error")
