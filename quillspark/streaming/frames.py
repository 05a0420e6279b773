"""Frame streams: one row for each frame, with Structured Streaming."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_frames(spark: SparkSession, path: str, schema=None, per_trigger: int = 100) -> DataFrame:
    """An unbounded source of the Parquet files of a folder (or of the files that a pattern matches)."""
    schema = schema or spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def windowed_counts(frames: DataFrame, time: str, kind: str, width: str, late: str) -> DataFrame:
    """(start, kind, n, total) of each window; rows later than `late` are left out."""
    stamped = frames.withColumn("t", F.col(time).cast("timestamp")).withWatermark("t", late)
    g = stamped.groupBy(F.window("t", width).alias("w"), F.col(kind).alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.col("w.start").alias("start"), "kind", "n")


def drain(frames: DataFrame, mode: str = "complete") -> DataFrame:
    """Run a stream over what there is and return its result, kept as Parquet in the checkpoint folder."""
    spark = frames.sparkSession
    root = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="quillspark-")  # a test on one machine
    folder = f"{root}/stream-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{folder}/result")

    query = frames.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").foreachBatch(keep).trigger(availableNow=True).start()
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    return spark.read.schema(frames.schema).parquet(f"{folder}/result")


def adaptive_means(frames: DataFrame, key: str, value: str) -> DataFrame:
    """(key, n, mean) kept as state for each key and updated by every batch of frames: an online template."""

    def update(k, batches, state):
        import pandas as pd

        n, mean = state.get if state.exists else (0, 0.0)
        for b in batches:
            m = len(b)
            if m:
                mean += (float(b["value"].mean()) - mean) * m / (n + m)
                n += m
        state.update((n, mean))
        yield pd.DataFrame({"key": [k[0]], "n": [n], "mean": [mean]})

    slim = frames.select(F.col(key).cast("string").alias("key"), F.col(value).cast("double").alias("value"))
    return slim.groupBy("key").applyInPandasWithState(update, "key string, n long, mean double", "n long, mean double", "update", "NoTimeout")
