"""All registered queries of the library and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.plans import array_queries, evaluation_queries, image_queries, layout_queries, table_queries
from quillspark.plans.query import Query, table


def _flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and largest quantities of the price buckets of each return flag."""
    bucket = F.floor(F.col("l_extendedprice") / 1000).cast("long")
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag", bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.max("l_quantity").alias("max_qty"))


_FLAGSHIP = """SELECT l_returnflag, CAST(floor(l_extendedprice / 1000) AS BIGINT) AS bucket, count(*) AS n, max(l_quantity) AS max_qty
    FROM lineitem GROUP BY 1, 2"""

QUERIES: dict[str, Query] = {"flagship_price_profile": Query(_flagship, _FLAGSHIP)} | array_queries.QUERIES | image_queries.QUERIES | table_queries.QUERIES | evaluation_queries.QUERIES | layout_queries.QUERIES


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q.run for name, q in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: q.sql for name, q in QUERIES.items() if q.sql}
