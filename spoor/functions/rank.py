"""Top-N tables with shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_TOP_N = 20
MAX_TOP_N = 1000


def clamp_top_n(n) -> int:
    """A usable N: whole numbers limited to 1..1000, anything else 20."""
    try:
        return max(1, min(int(n), MAX_TOP_N))
    except (TypeError, ValueError):
        return DEFAULT_TOP_N


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    """100 * part / whole, half to even; a zero whole counts as one."""
    base = F.when(whole == 0, 1).otherwise(whole)
    return F.bround(F.lit(100) * part / base, digits)


def with_pct(ranked: DataFrame) -> DataFrame:
    """Add ``pct`` of the largest row and ``share`` of the rows shown.

    Only for ranked tables of at most ``MAX_TOP_N`` rows: the window has no
    partition key.
    """
    everything = Window.partitionBy()
    return (ranked
            .withColumn("pct", percent(F.col("count"), F.max("count").over(everything)))
            .withColumn("share", percent(F.col("count"), F.sum("count").over(everything))))


def drop_blank_terms(ranked: DataFrame) -> DataFrame:
    """Remove blank labels from an already cut ranking."""
    return ranked.filter(~F.col("label").isin("", "-"))


def top_n(rows: DataFrame, value: Column, n, tie: Column | None = None,
          measure: Column | None = None) -> DataFrame:
    """``label, count`` of the N largest groups; ties in key order.

    Partial aggregation before the shuffle absorbs hot keys, and the cut is a
    per-task heap (TakeOrderedAndProject), not a global sort.
    """
    counted = rows.groupBy(value.alias("label")).agg((measure if measure is not None
                                                      else F.count("*")).alias("count"))
    order = tie if tie is not None else F.col("label")
    return counted.orderBy(F.desc("count"), order).limit(clamp_top_n(n))
