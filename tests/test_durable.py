"""Tables that loops write and read again."""

from pyspark.sql import functions as F

from quillspark.operators.durable import cut


def estimate(df):
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def test_size_estimates_do_not_grow_by_the_round(spark):
    rows = cut(spark.range(20).select("id", F.lit(1).alias("n")))
    first = estimate(rows)
    for _ in range(4):
        rows = cut(rows.join(rows.select("id", F.col("n").alias("more")), "id").select("id", (F.col("n") + F.col("more")).alias("n")))
    assert estimate(rows) == first
    assert {r["n"] for r in rows.collect()} == {16}


def test_rows_come_back_as_they_are(spark):
    given = spark.sql("SELECT 1L AS id, NULL AS none, array(1, NULL) AS list, struct('x' AS a, 2.5D AS b) AS s, map('k', 1) AS m, TIMESTAMP_NTZ '2020-01-02 03:04:05' AS at, X'00FF' AS raw, CAST(1.25 AS DECIMAL(10, 2)) AS d")
    kept = cut(given)
    assert kept.schema == given.schema and kept.collect() == given.collect()
