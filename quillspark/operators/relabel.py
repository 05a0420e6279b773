"""Palettes, joined feature rows, medians by group and accuracy by size as DataFrame operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def recolor(label: Column, palette: Sequence[int]) -> Column:
    """The palette entry of a label; labels beyond the palette start again at its first entry."""
    return F.element_at(F.array(*map(F.lit, palette)), F.pmod(label, F.lit(len(palette))).cast("int") + 1)


def augment(features: Column, extra: Column) -> Column:
    """Feature rows with further features appended."""
    return F.concat(features, extra)


def group_median(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """The exact median of each group, between the middle two of an even number."""
    return df.groupBy(*by).agg(F.expr(f"percentile({value}, 0.5)").alias("median"))


def accuracy_by_size(df: DataFrame, right: Column, size: Column, width: int) -> DataFrame:
    """(bucket, n, right): how many rows of each size bucket are right."""
    return df.groupBy(F.floor(size / width).cast("long").alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.sum(right.cast("long")).alias("right"))
