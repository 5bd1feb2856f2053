"""Summaries of a case kept as small mergeable sketches, a row for each day, so questions need no scan of events.

Distinct counts are HyperLogLog sketches, rankings are frequent-item sketches; totals and times are exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LG_CONFIG = 14               # 2^14 registers: distinct counts within about 1 %
TRACKED = 4096               # items that a ranking keeps count of
COUNTED = {"unique_ips": "ip", "unique_user_agents": "ua", "unique_urls": "url", "unique_domains": "domain"}
RANKED = ("ip", "ua", "url", "domain", "referrer", "method", "status")


def day_sketches(events: DataFrame) -> DataFrame:
    """``day``, totals, sketches of distinct values, sketches of frequent ones; events without a time are day null."""
    return events.groupBy(F.to_date("ts").alias("day")).agg(
        F.count("*").alias("total_events"), F.sum("bytes").alias("total_bytes"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"),
        # A sketch passes over empty text, which here is a value like any other.
        *[F.hll_sketch_agg(F.concat(F.lit("="), F.col(c)), F.lit(LG_CONFIG)).alias(name) for name, c in COUNTED.items()],
        *[F.expr(f"approx_top_k_accumulate(cast({c} as string), {TRACKED})").alias(f"top_{c}") for c in RANKED])


def write_sketches(events: DataFrame, path: str, case_id: int) -> None:
    """Sketches of one case's events, beside those of other cases; of a case written again the new ones count."""
    day_sketches(events).write.mode("overwrite").parquet(f"{path}/case_id={int(case_id)}")


def _days(spark: SparkSession, path: str, case_id: int, start, end) -> DataFrame:
    rows = spark.read.parquet(path).filter(F.col("case_id") == case_id)
    if start is not None:
        rows = rows.filter(F.col("day") >= F.lit(start).cast("date"))
    return rows if end is None else rows.filter(F.col("day") <= F.lit(end).cast("date"))


def sketched_summary(spark: SparkSession, path: str, case_id: int, start=None, end=None) -> DataFrame:
    """The row of ``stats_summary`` for whole days, both bounds inclusive, distinct counts from merged sketches."""
    def distinct(name: str) -> Column:
        return F.coalesce(F.hll_sketch_estimate(F.hll_union_agg(name)), F.lit(0)).cast("long").alias(name)
    return _days(spark, path, case_id, start, end).agg(
        F.coalesce(F.sum("total_events"), F.lit(0)).alias("total_events"), *[distinct(n) for n in COUNTED],
        F.coalesce(F.sum("total_bytes"), F.lit(0)).alias("total_bytes"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))


def sketched_top(spark: SparkSession, path: str, case_id: int, field: str, n: int = 20, start=None, end=None) -> DataFrame:
    """``label, count`` of a field's most frequent values.

    Counts are exact while a day has fewer distinct values than the sketch tracks, else upper estimates; blank values are left out after the cut.
    """
    if field not in RANKED:
        raise ValueError(f"no ranking is kept for {field}")
    # Grouped by nothing, so that a period without days has no row rather than an empty sketch.
    merged = _days(spark, path, case_id, start, end).groupBy(F.lit(1)).agg(F.expr(f"approx_top_k_combine(top_{field}, {TRACKED})").alias("k"))
    rows = merged.select(F.inline(F.expr(f"approx_top_k_estimate(k, {int(n)})")))
    return rows.select(F.col("item").alias("label"), "count").filter(~F.col("label").isin("", "-"))
