"""Paths that were missing and then began to answer: a dropped file, seen from the log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spoor.schema import POSITION
from spoor.session import match, stage

MISSING = 404


def _asked(events: DataFrame) -> DataFrame:
    return events.withColumn("path", F.substring_index("url", "?", 1))


def path_openings(events: DataFrame) -> DataFrame:
    """``path, misses, first_miss, last_miss, opened_at, opened_by, opened_with, hits, posts``.

    A path opens with its first answer (200 to 299) after its last miss (404). The state of a path is its last
    miss, then the first hit after it; both are plain maxima and minima, so no path is ever sorted, and
    only answers of paths that were once missing are looked at a second time. ``opened_by`` and ``opened_with``
    are address and method of the first hit, of several at one moment the first in the log. ``hits`` and
    ``posts`` count answers since then. Paths that were never missing, or never answered afterwards, give no row.
    """
    asked = _asked(events)
    missed = stage(asked.filter(F.col("status") == MISSING).groupBy("path").agg(
        F.count("*").alias("misses"), F.min("ts").alias("first_miss"), F.max("ts").alias("last_miss")), "path-misses")
    answers = asked.filter(F.col("status").between(200, 299)).select("path", "ts", "ip", "method", *POSITION)
    after = stage(match(answers, missed, ["path"]).filter("ts > last_miss"), "path-answers")
    opened = stage(after.groupBy("path").agg(
        F.max("misses").alias("misses"), F.min("first_miss").alias("first_miss"), F.max("last_miss").alias("last_miss"),
        F.min("ts").alias("opened_at"), F.count("*").alias("hits"), F.count_if(F.col("method") == "POST").alias("posts")),
        "path-openings")
    first = match(after.select("path", F.col("ts").alias("opened_at"), "ip", "method", *POSITION), opened.select("path", "opened_at"),
                  ["path", "opened_at"], "left_semi")
    who = first.groupBy("path").agg(F.min_by(F.struct("ip", "method"), F.struct(*POSITION)).alias("who"))
    return match(opened, who, ["path"]).select(
        "path", "misses", "first_miss", "last_miss", "opened_at", F.col("who.ip").alias("opened_by"),
        F.col("who.method").alias("opened_with"), "hits", "posts")


def touched_before_opening(events: DataFrame, openings: DataFrame) -> DataFrame:
    """Who asked for a path before it began to answer: ``path, ip, count, first_seen, last_seen``."""
    marks = stage(openings.select("path", "opened_at"), "openings")
    return (match(_asked(events).select("path", "ip", "ts"), marks, ["path"]).filter("ts < opened_at")
            .groupBy("path", "ip").agg(F.count("*").alias("count"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen")))
