"""Helpers shared by the operators of this package."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as the contracts of this package define words.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reliable(df: DataFrame) -> DataFrame:
    """Cut the lineage at a checkpoint in the folder that spark.checkpoint.dir names.

    Its files outlive the executors. Only a session on one machine may be without that setting
    (a test): it gets a folder of its own.
    """
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="quillspark-")
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


#: Narrow rows that one partition of a compact table holds.
COMPACT_ROWS = 50_000


def compact(df: DataFrame) -> DataFrame:
    """reliable() of a table of narrow rows, in as few partitions as its number of rows needs.

    A small table in many partitions costs each later shuffle a file for each pair of them.
    """
    kept = reliable(df)
    return kept.coalesce(max(1, -(-kept.count() // COMPACT_ROWS)))


def named(name: str):
    """The column of exactly this name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def ascii_lower(column):
    """A-Z to a-z, all other characters as they are."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def word_count(column):
    """Words between ASCII white space; null counts as empty."""
    return F.regexp_count(F.coalesce(column, F.lit("")), F.lit(WORD)).cast("long")


#: Bits of the largest sketch (16 MB), and of one of its rows as Spark's bitmap functions lay them out.
SKETCH_BITS, SKETCH_ROW = 1 << 27, 32_768


def sketch(keys: DataFrame, key) -> tuple[DataFrame, int]:
    """(bitmap rows, number of bits) of all values of key, a long: a filter of bounded size that misses none.

    Sixteen bits a key up to SKETCH_BITS in all; beyond that it lets more strangers through, so
    an exact join has to follow.
    """
    n, bits = keys.count(), SKETCH_ROW
    while bits < min(16 * n, SKETCH_BITS):
        bits *= 2
    at = keys.select(F.pmod(key, F.lit(bits)).alias("at"))
    rows = at.groupBy(F.expr(f"at div {SKETCH_ROW}").alias("_row")).agg(F.expr(f"bitmap_construct_agg(at % {SKETCH_ROW})").alias("_bits"))
    return compact(rows), bits


def maybe(rows: DataFrame, key, sketched: tuple[DataFrame, int], also: bool = True) -> DataFrame:
    """rows whose key may be in the sketch; with also=False, those whose key is surely not. Nothing is shuffled."""
    bitmap, bits = sketched
    packed = rows.select(F.struct("*").alias("_given"), F.pmod(key, F.lit(bits)).alias("_at"))
    met = packed.join(F.broadcast(bitmap), F.expr(f"_at div {SKETCH_ROW} = _row"), "left")
    byte = f"cast(conv(hex(substring(_bits, cast(_at % {SKETCH_ROW} div 8 as int) + 1, 1)), 16, 10) as int)"
    hit = F.expr(f"_bits is not null and shiftright({byte}, cast(_at % 8 as int)) % 2 = 1")
    return met.where(hit if also else ~hit).select("_given.*")
