"""Results to files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spoor.operators import describe as D
from spoor.schema import MAX_SAMPLE, MAX_SAMPLE_URL, MAX_SESSION_UA


def write_findings(findings: DataFrame, path: str, case_id: int) -> None:
    """Replace the stored findings of one case; other cases stay untouched.

    The case's partition folder is written directly, so that a run without any
    finding also clears what an earlier run left. Samples are stored up to their length limit.
    """
    (findings.filter(F.col("case_id") == case_id).drop("case_id")
     .withColumn("sample", F.left("sample", F.lit(MAX_SAMPLE))).write.mode("overwrite").parquet(f"{path}/case_id={int(case_id)}"))


def timeline_table(sessions: DataFrame) -> DataFrame:
    """The flat layout of an exported timeline."""
    return sessions.select(
        "start", "end", "ip", "phase", F.col("event_count").alias("events"),
        F.col("n404").alias("404s"), "bytes_out", F.array_join("tags", "|").alias("tags"),
        F.left("ua", F.lit(MAX_SESSION_UA)).alias("user_agent"))


def export_timeline(sessions: DataFrame, path: str, fmt: str = "csv") -> None:
    """CSV with a header, or one JSON document per session; only here long clients and URLs are cut."""
    if fmt == "csv":
        (timeline_table(sessions).write.mode("overwrite").option("header", True)
         .option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ssXXX").option("emptyValue", "")
         .option("escape", '"').csv(path))
    elif fmt == "json":
        short = sessions.withColumn("ua", F.left("ua", F.lit(MAX_SESSION_UA)))
        if "sample_events" in sessions.columns:
            short = short.withColumn("sample_events", F.transform("sample_events", lambda e: e.withField(
                "url", F.left(e["url"], F.lit(MAX_SAMPLE_URL)))))
        short.write.mode("overwrite").option("ignoreNullFields", False).json(path)
    else:
        raise ValueError(f"unknown format {fmt}")


def _rows(table: DataFrame, section: str, value=None) -> DataFrame:
    shown = F.col("count").cast("double") if value is None else value
    return table.select(F.lit(section).alias("section"), F.col("label").cast("string").alias("label"),
                        shown.alias("value"), F.col("share"))


def statistics_table(events: DataFrame, n=20) -> DataFrame:
    """All statistics as one tidy table ``section, label, value, share``.

    Each ranking scans only its own column, which reads less than one wide
    pass that expands every row once per ranking.
    """
    s = D.stats_summary(events)
    counts = ["total_events", "unique_ips", "unique_user_agents", "unique_urls",
              "unique_domains", "total_bytes"]
    pairs = [F.struct(F.lit(c).alias("label"), F.col(c).cast("double").alias("value"))
             for c in counts]
    pairs.append(F.struct(F.lit("total_gb").alias("label"),
                          F.bround(F.col("total_bytes") / 1073741824, 3).alias("value")))
    for c in ("first_seen", "last_seen"):
        pairs.append(F.struct(F.concat(F.lit(f"{c}="), F.date_format(c, "yyyy-MM-dd HH:mm:ss"))
                              .alias("label"), F.lit(None).cast("double").alias("value")))
    none = F.lit(None).cast("double")
    summary = s.select(F.inline(F.array(*pairs))).select(
        F.lit("summary").alias("section"), "label", "value", none.alias("share"))
    parts = [_rows(D.status_classes(events), "status_classes")]
    parts += [_rows(D.rank_field(events, f, n), name) for name, f in D.RANKED_FIELDS.items()]
    parts.append(_rows(D.top_ip_bytes(events, n), "top_ip_bytes",
                       F.bround(F.col("count") / 1048576, 2)))
    parts.append(_rows(D.top_status(events, n), "top_status"))
    traffic = D.traffic_histogram(events).select(
        F.lit("traffic").alias("section"), F.col("t").alias("label"),
        F.col("count").cast("double").alias("value"), none.alias("share"))
    result = summary
    for part in [*parts, traffic]:
        result = result.unionByName(part)
    return result


def export_statistics(events: DataFrame, path: str, fmt: str = "csv", n=20) -> None:
    """Write the statistics table as csv, json or parquet."""
    writer = statistics_table(events, n).write.mode("overwrite")
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)
