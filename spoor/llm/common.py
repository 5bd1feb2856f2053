"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spoor.session import run_path as run_path
from spoor.session import stage as stage



def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Hand Python workers few rows at a time, and read as few from files: texts may be megabytes long."""
    for key in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize"):
        if int(spark.conf.get(key)) > rows:
            spark.conf.set(key, str(rows))


def narrow(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under new names: extra or clashing columns stay outside."""
    return df.select(*[F.col(f"`{old}`").alias(new) for new, old in columns.items()])


def remainder(column: str, divisor: int) -> Column:
    """CRC32 of a value's text, modulo; a null counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % divisor




def hash_sample(rows: DataFrame, id_column: str, size: int, parts: Sequence[str] = ()) -> DataFrame:
    """About twice ``size`` rows of each part: those whose id has a small enough hash, all if there are fewer.

    The share follows from a count of the part, so that what a later top-n gathers does not grow with the
    number of tasks. Rows of one id are all in or all out.
    """
    steps = 1 << 30
    if parts:
        # Staged, so that the planner broadcasts the counts only if they are small.
        counts = stage(rows.groupBy(*parts).agg(F.count("*").alias("_n")), "sample-counts")
        joined = rows.join(counts, list(parts))
    else:
        joined = rows.withColumn("_n", F.lit(max(1, rows.count())))
    low = F.pmod(F.xxhash64(id_column), F.lit(steps))
    return joined.filter(low < F.least(F.lit(1.0), F.lit(2.0 * size) / F.col("_n")) * steps).drop("_n")


def running(rows: DataFrame, parts: Sequence[str], bucket: str, order: Sequence[str], size: Column,
            into: str = "before") -> DataFrame:
    """Sum of ``size`` over the rows before each row, in the order (bucket, order) of its part.

    No part is ever gathered in one task: bucket sums are added up first (a table of
    parts x buckets rows, both bounded by the caller), then each bucket is numbered on
    its own. Rows that agree in everything get different places.
    """
    sized = rows.withColumn("_size", size.cast("long"))
    keys = [*parts, bucket]
    sums = sized.groupBy(*keys).agg(F.sum("_size").alias("_sum"))
    line = W.partitionBy(*parts).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    starts = sums.select(*keys, F.coalesce(F.sum("_sum").over(line), F.lit(0)).alias("_start"))
    inside = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    placed = sized.withColumn("_in", F.coalesce(F.sum("_size").over(inside), F.lit(0)))
    return (placed.join(starts, keys).withColumn(into, F.col("_start") + F.col("_in"))
            .drop("_size", "_start", "_in"))
