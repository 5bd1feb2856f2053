"""The event table: Parquet by case, verdict and day, in each day by address."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from spoor.functions.ip import cidr_bounds, ip_key
from spoor.functions.text import tag_url
from spoor.rules import DEFAULT_RULES, RuleSet
from spoor.sources.parse import parse_lines, validate_event
from spoor.sources.text import file_formats, scan_log_text

CLUSTER = ("verdict", "day", "ip_key", "ts")
FILTER_SIZE = 20_000         # addresses a row group's membership filter is made for


def write_events(events: DataFrame, path: str, case_id: int,
                 rules: RuleSet = DEFAULT_RULES, cluster: bool = True, mode: str = "append") -> dict[str, int]:
    """Append validated events to a case and count them: ``ok, failed, unparsed``.

    Refused rows, and lines that are no event, are kept apart with the reason.

    One pass writes both, and readers prune by partition. The address key is
    stored so that CIDR filters reach the Parquet reader, and the tags so that
    the rule table runs once and not in every later query. To apply another
    rule table later, drop the ``tags`` column after reading.

    With ``cluster`` the rows of a day are put in order of address over all files, so a file, and a row group
    in it, holds a narrow range of keys and a block of addresses is found by their bounds; each row group also
    has a membership filter of its addresses. An address that fills files is split by time. Tags are made after
    that shuffle, whose sampling pass would otherwise run the rules a second time.
    """
    counts, verdict = Observation(), F.col("verdict")
    rows = (validate_event(events.withColumn("ip_key", ip_key(F.col("ip"))))
            .withColumns({"status": F.col("status").try_cast("int"), "day": F.to_date("ts")}))
    if cluster:
        rows = rows.repartitionByRange(*CLUSTER).sortWithinPartitions(*CLUSTER)
    (rows.withColumn("tags", tag_url(F.col("url"), rules))
     .observe(counts, F.count_if(verdict == "ok").alias("ok"), F.count_if(verdict == "unparsed").alias("unparsed"),
              F.count_if(~verdict.isin("ok", "unparsed")).alias("failed"))
     .write.mode(mode).option("parquet.bloom.filter.enabled#ip", "true").option("parquet.bloom.filter.expected.ndv#ip", str(FILTER_SIZE))
     .partitionBy("verdict", "day").parquet(f"{path}/case_id={int(case_id)}"))
    return {k: counts.get[k] for k in ("ok", "failed", "unparsed")}


def ingest(spark: SparkSession, source, path: str, case_id: int, fmt: str = "auto",
           rules: RuleSet = DEFAULT_RULES) -> dict[str, int]:
    """Read log files, parse them and append them to a case; the counts are those of ``write_events``."""
    formats = file_formats(spark, source) if fmt == "auto" else None
    events = parse_lines(scan_log_text(spark, source), fmt, keep_unparsed=True, formats=formats)
    return write_events(events, path, case_id, rules)


def read_case(spark: SparkSession, path: str, case_id: int) -> DataFrame:
    return spark.read.parquet(path).filter(
        (F.col("case_id") == case_id) & (F.col("verdict") == "ok")).drop("verdict")


def read_rejected(spark: SparkSession, path: str, case_id: int) -> DataFrame:
    return spark.read.parquet(path).filter(
        (F.col("case_id") == case_id) & (F.col("verdict") != "ok"))


def filter_ip(events: DataFrame, ip: str) -> DataFrame:
    """One address in any spelling, or a CIDR block such as ``203.0.113.0/24``."""
    try:
        lo, hi = cidr_bounds(ip)
    except ValueError:
        if "/" in ip:
            raise
        return events.filter(F.col("ip") == ip)
    key = F.col("ip_key") if "ip_key" in events.columns else ip_key(F.col("ip"))
    return events.filter(key.between(F.lit(lo), F.lit(hi)))


def _instant(value: str | dt.datetime) -> Column:
    return F.lit(value).cast("timestamp")


def filter_time(events: DataFrame, start=None, end=None) -> DataFrame:
    """Both bounds are inclusive and optional. Stored events are also pruned by the folder of their day."""
    for bound, op in ((start, Column.__ge__), (end, Column.__le__)):
        if bound is not None:
            events = events.filter(op(F.col("ts"), _instant(bound)))
            if "day" in events.columns:
                events = events.filter(op(F.col("day"), F.to_date(_instant(bound))))
    return events


def filter_status_in(events: DataFrame, codes) -> DataFrame:
    return events.filter(F.col("status").isin(*codes))


def filter_method_in(events: DataFrame, methods) -> DataFrame:
    return events.filter(F.col("method").isin(*methods))
