"""Totals, rankings, shares and the traffic histogram of a case."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spoor.functions.ip import ip_key
from spoor.functions.rank import clamp_top_n, drop_blank_terms, percent, top_n, with_pct

HISTOGRAM_BUCKETS = 60

# Status classes, and the widths a histogram may choose from.
STATUS_CLASSES = (
    ("2xx Success", "success", 200, 299),
    ("3xx Redirect", "redirect", 300, 399),
    ("4xx Client error", "client_error", 400, 499),
    ("5xx Server error", "server_error", 500, 599),
)
WIDTH_SECONDS = (1, 5, 10, 30, 60, 300, 600, 1800, 3600, 10800, 43200, 86400, 604800)
WIDTH_MONTHS = (1, 3, 12, 60, 120, 240, 600, 1200)

RANKED_FIELDS = {"top_ips": "ip", "top_user_agents": "ua", "top_urls": "url",
                 "top_domains": "domain", "top_referrers": "referrer", "top_methods": "method"}


def stats_summary(events: DataFrame, approximate: bool = False) -> DataFrame:
    """One row of totals. ``approximate`` counts distinct values by sketch,
    which spares the shuffle of every distinct URL."""
    distinct = F.approx_count_distinct if approximate else F.count_distinct
    return events.agg(
        F.count("*").alias("total_events"), distinct(F.col("ip")).alias("unique_ips"),
        distinct(F.col("ua")).alias("unique_user_agents"),
        distinct(F.col("url")).alias("unique_urls"),
        distinct(F.col("domain")).alias("unique_domains"),
        F.coalesce(F.sum("bytes"), F.lit(0)).alias("total_bytes"),
        F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))


def rank_field(events: DataFrame, field: str, n=20) -> DataFrame:
    """``label, count, pct, share`` of the most frequent values of a field.

    Blank values take part in the cut and are removed after it.
    """
    tie = ip_key(F.col("label")) if field == "ip" else None
    return with_pct(drop_blank_terms(top_n(events, F.col(field), n, tie)))


def top_ips(events, n=20):
    return rank_field(events, "ip", n)


def top_user_agents(events, n=20):
    return rank_field(events, "ua", n)


def top_urls(events, n=20):
    return rank_field(events, "url", n)


def top_domains(events, n=20):
    return rank_field(events, "domain", n)


def top_referrers(events, n=20):
    return rank_field(events, "referrer", n)


def top_methods(events, n=20):
    return rank_field(events, "method", n)


def status_codes(events: DataFrame) -> DataFrame:
    """``label, count`` of every status code."""
    return events.groupBy(F.col("status").alias("label")).agg(F.count("*").alias("count"))


def top_status(events: DataFrame, n=20) -> DataFrame:
    return with_pct(status_codes(events).orderBy(F.desc("count"), "label").limit(clamp_top_n(n)))


def classify_status(codes: DataFrame) -> DataFrame:
    """Fold ``label, count`` of status codes into four classes.

    Always four rows; the share is of all codes, also those outside them.
    """
    columns = [F.coalesce(F.sum(F.when(F.col("label").between(lo, hi), F.col("count"))),
                          F.lit(0)).alias(cls) for _, cls, lo, hi in STATUS_CLASSES]
    total = F.coalesce(F.sum("count"), F.lit(0)).alias("total")
    rows = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(label).alias("label"),
                              F.lit(cls).alias("cls"), F.col(cls).alias("count"),
                              percent(F.col(cls), F.col("total")).alias("share"))
                     for i, (label, cls, _, _) in enumerate(STATUS_CLASSES)])
    return codes.agg(*columns, total).select(F.inline(rows)).orderBy("place").drop("place")


def status_classes(events: DataFrame) -> DataFrame:
    return classify_status(status_codes(events))


def top_ip_bytes(events: DataFrame, n=20) -> DataFrame:
    """Addresses by bytes received; ``count`` is the sum of bytes."""
    return with_pct(top_n(events, F.col("ip"), n, ip_key(F.col("label")), F.sum("bytes")))


def _month(ts: Column) -> Column:
    return F.year(ts) * 12 + F.month(ts) - 1


def _index(ts: Column, kind: str, width: Column) -> Column:
    value = F.unix_seconds(ts) if kind == "seconds" else _month(ts).cast("bigint")
    return ((value - F.pmod(value, width)) / width).cast("bigint")


def _ladder(lo: Column, hi: Column, buckets: int) -> Column:
    """First width, from fine to coarse, that needs no more than ``buckets``."""
    choice = F.when(F.lit(False), F.struct(F.lit("").alias("kind"), F.lit(0).alias("width")))
    for kind, widths in (("seconds", WIDTH_SECONDS), ("months", WIDTH_MONTHS)):
        for width in widths:
            w = F.lit(width)
            fits = _index(hi, kind, w) - _index(lo, kind, w) < buckets
            choice = choice.when(fits, F.struct(F.lit(kind).alias("kind"), w.alias("width")))
    return choice.otherwise(F.struct(F.lit("months").alias("kind"),
                                     F.lit(WIDTH_MONTHS[-1] * 10).alias("width")))


def traffic_histogram(events: DataFrame, buckets: int = HISTOGRAM_BUCKETS) -> DataFrame:
    """``t, count`` over at most ``buckets`` equal steps, empty ones included.

    The driver reads first and last time to choose the step; all else is one
    aggregation to at most ``buckets`` rows.
    """
    spark = events.sparkSession
    span = events.agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    step = span.select(_ladder(F.col("lo"), F.col("hi"), buckets).alias("s"), *[
        F.struct(F.unix_seconds(c).alias("seconds"), _month(F.col(c)).alias("months")).alias(c) for c in ("lo", "hi")]).first()
    kind, width = step["s"]["kind"], F.lit(step["s"]["width"])
    index = _index(F.col("ts"), kind, width)
    counted = events.groupBy(index.alias("i")).agg(F.count("*").alias("count"))
    empty = step["lo"]["seconds"] is None
    first, last = (0, -1) if empty else (step[c][kind] // step["s"]["width"] for c in ("lo", "hi"))
    edges = spark.range(first, last + 1).withColumnRenamed("id", "i")
    start = (F.timestamp_seconds(F.col("i") * width) if kind == "seconds" else
             F.make_timestamp(F.floor(F.col("i") * width / 12).cast("int"),
                              (F.pmod(F.col("i") * width, F.lit(12)) + 1).cast("int"),
                              F.lit(1), F.lit(0), F.lit(0), F.lit(0)))
    return (edges.join(counted, "i", "left").orderBy("i")
            .select(F.date_format(start, "yyyy-MM-dd HH:mm").alias("t"),
                    F.coalesce("count", F.lit(0)).alias("count")))


def traffic_peak(histogram: DataFrame) -> DataFrame:
    """``t, count`` of the highest step, the first of equals."""
    return histogram.orderBy(F.desc("count"), "t").limit(1)
