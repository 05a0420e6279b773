"""Lineage is cut at reliable checkpoints: in loops, plans must not grow by the round."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """df as a checkpoint in the folder of spark.checkpoint.dir, which outlives the executors.

    Only a session on one machine may be without that setting (a test): it gets a folder of its own.
    """
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="quillspark-")
        context.setCheckpointDir(folder)
    # A checkpoint hands on the size that Spark estimates for its plan. Of a join that is the product of its sides'
    # sizes, so in a loop its digits double by the round and fill the driver; rows of a plain RDD have no such estimate.
    session = df.sparkSession
    rows = DataFrame(session._jsparkSession.createDataFrame(df._jdf.toJavaRDD(), df._jdf.schema()), session)
    return rows.checkpoint(eager=True)
