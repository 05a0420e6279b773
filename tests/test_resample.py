"""Scaling is dealt to tasks by its rows."""

from pyspark.sql import functions as F

from quillspark.operators import resample


def test_scaling_is_dealt_by_rows(spark, monkeypatch):
    p = spark.range(4000).select((F.col("id") % 3).alias("img"), F.expr("cast(id div 3 % 40 as int)").alias("x"), F.expr("cast(id div 120 as int)").alias("y"), (F.col("id") % 255).cast("int").alias("v")).cache()
    one = resample.scale_interpolate(p, 1.5, 0.7).withColumn("v", F.round("v", 6))
    monkeypatch.setattr(resample, "TASK_ROWS", 1000)
    many = resample.scale_interpolate(p, 1.5, 0.7).withColumn("v", F.round("v", 6))
    assert many.rdd.getNumPartitions() == 1 + int(4 * 1.5 * 0.7 * 4000) // 1000
    assert sorted(map(tuple, many.collect())) == sorted(map(tuple, one.collect()))
