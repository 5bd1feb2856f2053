"""The windowed detectors on a stream of events.

Rows later than the watermark are dropped by Spark; batch results differ only
by those.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spoor import rules as R
from spoor.functions.text import is_scanner_ua, mask_columns, mask_names, tags_from_masks, url_tags
from spoor.operators.correlate import session_phase


def brute_force_windows(events: DataFrame, threshold: int = R.BRUTE_FORCE_THRESHOLD,
                        lateness: str = "10 minutes") -> DataFrame:
    """Windows of refused logins that reach the threshold, per address."""
    width = f"{R.BRUTE_FORCE_WINDOW_SECONDS} seconds"
    return (events.withWatermark("ts", lateness)
            .filter(F.col("status").isin(*R.AUTH_FAILURES))
            .groupBy("ip", F.window("ts", width)).agg(F.count("*").alias("failures"))
            .filter(F.col("failures") >= threshold)
            .select("ip", F.col("window.start").alias("window_start"), "failures"))


def sessions(events: DataFrame, lateness: str = "10 minutes",
             gap_seconds: int = R.SESSION_GAP_SECONDS) -> DataFrame:
    """Closed sessions per (ip, ua) with their counts."""
    return (events.withWatermark("ts", lateness)
            .groupBy("ip", "ua", F.session_window("ts", f"{gap_seconds} seconds"))
            .agg(F.count("*").alias("event_count"),
                 F.count_if(F.col("status") == 404).alias("n404"),
                 F.sum("bytes").alias("bytes_out"))
            .select("ip", "ua", F.col("session_window.start").alias("start"),
                    "event_count", "n404", "bytes_out"))


def session_phases(events: DataFrame, lateness: str = "10 minutes", rules: R.RuleSet = R.DEFAULT_RULES,
                   gap_seconds: int = R.SESSION_GAP_SECONDS) -> DataFrame:
    """Closed sessions with tags and attack phase, as ``session_phase`` gives them for a batch.

    Tags are bit masks in the state, so a session is a row of sums however long it lasts, and sessions that a late
    event joins are merged by adding their sums. ``session_no`` is left out: a stream cannot know how many came before.
    """
    rows = events.withWatermark("ts", lateness).withColumn("tags", url_tags(events.columns, rules))
    rows = rows.select("ip", "ua", "ts", "status", "bytes", *mask_columns(F.col("tags"), rules))
    sums = rows.groupBy("ip", "ua", F.session_window("ts", f"{gap_seconds} seconds").alias("w")).agg(
        F.min("ts").alias("start"), F.max("ts").alias("end"), F.count("*").alias("event_count"),
        F.count_if(F.col("status") == 404).alias("n404"), F.sum("bytes").alias("bytes_out"),
        *[F.bit_or(m).alias(m) for m in mask_names(rules)])
    return session_phase(sums.select(
        "ip", "ua", "start", "end", "event_count", "n404", "bytes_out", tags_from_masks(rules, ordered=True).alias("tags"),
        is_scanner_ua(F.col("ua")).alias("scanner_ua")), rules)


def write_sessions(events: DataFrame, path: str, checkpoint: str, lateness: str = "10 minutes", rules: R.RuleSet = R.DEFAULT_RULES):
    """Start a stream of closed sessions into Parquet files that takes what has come in and stops.

    Started again with the same ``checkpoint`` it goes on with the open sessions it had; each session is written once.
    """
    return (session_phases(events, lateness, rules).writeStream.format("parquet").outputMode("append")
            .option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
