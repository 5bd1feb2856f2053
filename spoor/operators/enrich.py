"""Source addresses against a table of reputations."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spoor.functions.ip import ip_key, is_non_global_ip
from spoor.functions.text import reputation_band

CACHE_HOURS = 24


def case_source_ips(events: DataFrame, limit: int | None = None) -> DataFrame:
    """``ip, count`` of all addresses, or of the ``limit`` most frequent, ties in address order."""
    counts = events.groupBy("ip").agg(F.count("*").alias("count"))
    if limit is None:
        return counts
    return counts.orderBy(F.desc("count"), ip_key(F.col("ip")), "ip").limit(limit)


def listed(ips: DataFrame, order: Column, source: int) -> DataFrame:
    """``ip, pos``: a list of addresses with a sortable place in it."""
    return ips.select("ip", F.struct(F.lit(source).alias("source"),
                                     order.cast("bigint").alias("place")).alias("pos"))


def screen_ips(candidates: DataFrame) -> DataFrame:
    """``ip, pos, verdict`` of a list: trimmed, blanks dropped, first of equals kept.

    ``verdict`` is ``queued``, ``private/reserved`` or ``invalid``.
    """
    unique = (candidates.select(F.trim("ip").alias("ip"), "pos").filter("ip <> ''")
              .groupBy("ip").agg(F.min("pos").alias("pos")))
    reserved = is_non_global_ip(F.col("ip"))
    return (unique.withColumn("reserved", reserved)
            .select("ip", "pos", F.when(F.col("reserved").isNull(), "invalid")
                    .when(F.col("reserved"), "private/reserved").otherwise("queued")
                    .alias("verdict")))


def _now(now: dt.datetime | None) -> Column:
    return F.lit(now).cast("timestamp") if now else F.current_timestamp()


def reputation_cached(queued: DataFrame, reputation: DataFrame, now=None,
                      hours: int = CACHE_HOURS, force: bool = False) -> DataFrame:
    """Add the reputation columns and ``fresh`` to queued addresses.

    A row counts as fresh when it was checked less than ``hours`` ago.
    """
    after = _now(now) - F.expr(f"interval {int(hours)} hours")
    fresh = F.coalesce(F.col("checked_at") > after, F.lit(False))
    return queued.join(reputation, "ip", "left").withColumn(
        "fresh", F.lit(False) if force else fresh)


def reputation_to_refresh(cached: DataFrame, budget: int) -> DataFrame:
    """``ip, pos, state``: ``cached``, ``refresh`` or ``unchecked``.

    Addresses are taken in list order. The first one that needs a look-up
    beyond the budget stops the work, and all from there on are unchecked.
    ``budget`` is a daily quota, so the place where it ends is found with a
    bounded sort and not by numbering the whole list.
    """
    stale = cached.filter(~F.col("fresh")).select("pos").orderBy("pos").limit(budget + 1)
    stop = stale.agg(F.when(F.count("*") > budget, F.max("pos")).alias("stop")).scalar()
    return cached.select(
        "ip", "pos", F.when(F.coalesce(F.col("pos") >= stop, F.lit(False)), "unchecked")
        .when(F.col("fresh"), "cached").otherwise("refresh").alias("state"))


def reputation_upsert(reputation: DataFrame, incoming: DataFrame) -> DataFrame:
    """The latest row per address of the old and the new table."""
    latest = Window.partitionBy("ip").orderBy(F.desc("checked_at"), F.desc("is_new"))
    both = (reputation.withColumn("is_new", F.lit(0))
            .unionByName(incoming.withColumn("is_new", F.lit(1))))
    return (both.withColumn("place", F.row_number().over(latest))
            .filter("place = 1").drop("place", "is_new"))


def reputation_report(checked: DataFrame) -> DataFrame:
    """Checked addresses by score, worst first, with their band."""
    return (checked.withColumn("band", reputation_band(F.col("abuse_score")))
            .orderBy(F.desc("abuse_score"), "pos"))


def reputation_counts(screened: DataFrame, states: DataFrame) -> DataFrame:
    """One row: ``checked, cache_hits, api_calls, skipped, unchecked``."""
    skipped = screened.agg(F.count_if(F.col("verdict") != "queued").alias("skipped")).scalar()
    done = states.agg(
        F.count_if(F.col("state") != "unchecked").alias("checked"),
        F.count_if(F.col("state") == "cached").alias("cache_hits"),
        F.count_if(F.col("state") == "refresh").alias("api_calls"),
        F.count_if(F.col("state") == "unchecked").alias("unchecked"))
    return done.withColumn("skipped", skipped)
