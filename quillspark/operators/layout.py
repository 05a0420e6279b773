"""Layout on lines and boxes (img, id, x0, y0, x1, y1; y grows upwards): order, paragraphs, words, spacing, page output."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _pair(boxes: DataFrame, side: str) -> DataFrame:
    return boxes.select("img", *(F.col(c).alias(f"{side}_{c}") for c in ("id", "x0", "y0", "x1", "y1")))


def _overlap(a: str, b: str):
    return (F.col(f"{a}_x1") >= F.col(f"{b}_x0")) & (F.col(f"{b}_x1") >= F.col(f"{a}_x0"))


def precedence(boxes: DataFrame) -> DataFrame:
    """(img, first, then): the reading-order edges between the lines of an image.

    Lines that overlap in x go from the higher top down; others from left to right, unless a
    line whose base lies strictly between theirs overlaps both. The pairs are those of a page.
    """
    pairs = _pair(boxes, "a").join(_pair(boxes, "b"), "img").where("a_id < b_id")
    over = _overlap("a", "b")
    high = pairs.where(over).select("img", "a_id", "b_id", (F.col("a_y1") > F.col("b_y1")).alias("forward"))
    beside = pairs.where(~over)
    between = (F.col("s_y0") > F.least("a_y0", "b_y0")) & (F.col("s_y0") < F.greatest("a_y0", "b_y0"))
    parted = beside.join(_pair(boxes, "s"), "img").where(_overlap("s", "a") & _overlap("s", "b") & between).select("img", "a_id", "b_id").distinct()
    free = beside.join(parted, ["img", "a_id", "b_id"], "left_anti").select("img", "a_id", "b_id", (F.col("a_x1") <= F.col("b_x0")).alias("forward"))
    e = high.unionByName(free)
    return e.select("img", F.when(F.col("forward"), F.col("a_id")).otherwise(F.col("b_id")).alias("first"), F.when(F.col("forward"), F.col("b_id")).otherwise(F.col("a_id")).alias("then"))


def good_dimensions(boxes: DataFrame, aspect: tuple[float, float], log_aspect: float, width: int, height: int) -> DataFrame:
    """Boxes whose aspect (width by height) lies in a range, off from 1 by a power of two at least, and that are large enough."""
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    a = (w / h).cast("double")
    return boxes.where((h > 0) & a.between(*aspect) & (F.abs(F.log2(a)) >= log_aspect) & (w >= width) & (h >= height))


def words_of_rows(boxes: DataFrame, gap: int, row: str = "line") -> DataFrame:
    """(img, row, word, x0, x1, n): the boxes of a row in runs whose gaps are `gap` at most."""
    w = Window.partitionBy("img", row).orderBy("x0", "id")
    before = F.max("x1").over(w.rowsBetween(Window.unboundedPreceding, -1))
    starts = boxes.withColumn("new", (before.isNull() | (F.col("x0") - before > gap)).cast("int"))
    named = starts.withColumn("word", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return named.groupBy("img", row, "word").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.count(F.lit(1)).alias("n"))


def row_spacing(boxes: DataFrame, row: str = "line") -> DataFrame:
    """(img, row, n, mean_gap, narrowest, widest) of the gaps between the boxes of a row in the order of x0."""
    w = Window.partitionBy("img", row).orderBy("x0", "id")
    gaps = boxes.withColumn("gap", F.col("x0") - F.lag("x1").over(w)).where("gap is not null")
    return gaps.groupBy("img", row).agg(F.count(F.lit(1)).alias("n"), F.avg("gap").alias("mean_gap"), F.min("gap").alias("narrowest"), F.max("gap").alias("widest"))


def row_height_mode(boxes: DataFrame, row: str = "line") -> DataFrame:
    """(img, row, height, n): the most frequent height of a row's boxes, the least of equals."""
    counts = boxes.groupBy("img", row, (F.col("y1") - F.col("y0")).alias("height")).agg(F.count(F.lit(1)).alias("n"))
    best = F.max(F.struct("n", (-F.col("height")).alias("low")))
    return counts.groupBy("img", row).agg(best.alias("b")).select("img", row, (-F.col("b.low")).alias("height"), F.col("b.n").alias("n"))


def paragraphs(lines: DataFrame, indent: int, leading: float) -> DataFrame:
    """(img, id, paragraph): lines from the top down; one starts a paragraph if it is indented or far below the line before."""
    w = Window.partitionBy("img").orderBy(F.desc("y1"), "id")
    far = F.lag("y0").over(w) - F.col("y1") > leading * (F.col("y1") - F.col("y0"))
    starts = F.lag("id").over(w).isNull() | far | (F.col("x0") - F.lag("x0").over(w) >= indent)
    return lines.withColumn("new", starts.cast("int")).select("img", "id", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("paragraph"))


def inside_page(boxes: DataFrame, width: int, height: int, margin: int) -> DataFrame:
    """Boxes smaller than the page and clear of its margin."""
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    return boxes.where((w < width) & (h < height) & (F.col("x0") >= margin) & (F.col("y0") >= margin) & (F.col("x1") <= width - margin) & (F.col("y1") <= height - margin))


def box_line(symbol, x0, y0, x1, y1): return F.format_string("%s %d %d %d %d", symbol, x0, y0, x1, y1)


def page_text(words: DataFrame, page: str, order: list[str], text: str) -> DataFrame:
    """(page, text): the words of a page in order, by single spaces."""
    held = F.sort_array(F.collect_list(F.struct(*order, text)))
    return words.groupBy(page).agg(F.array_join(F.transform(held, lambda s: s[text]), " ").alias("text"))


def uniform_certainties(chars: DataFrame, word: str, certainty: str, variation: float, floor: float) -> DataFrame:
    """(word, uniform): whether no character of a word is much less certain than the others.

    The worst certainty must reach the mean of the others less `variation` deviations, or
    `floor` if that is lower; words of under three characters pass.
    """
    c = F.col(certainty).cast("double")
    g = chars.groupBy(word).agg(F.count(F.lit(1)).alias("n"), F.min(c).alias("worst"), F.sum(c).alias("s"), F.sum(c * c).alias("q"))
    n, s, q = F.col("n") - 1, F.col("s") - F.col("worst"), F.col("q") - F.col("worst") * F.col("worst")
    sd = F.sqrt(F.greatest(F.lit(0.0), (n * q - s * s) / F.nullif(n * (n - 1), F.lit(0))))
    limit = F.least(s / F.nullif(n, F.lit(0)) - variation * sd, F.lit(floor))
    return g.select(word, F.when(F.col("n") < 3, True).otherwise(F.col("worst") >= limit).alias("uniform"))
