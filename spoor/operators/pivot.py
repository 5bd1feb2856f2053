"""Pivots an analyst follows from one lead to related activity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spoor import rules as R
from spoor.functions.ip import is_ipv4_text, subnet24
from spoor.functions.text import is_scanner_ua
from spoor.operators.correlate import SLOT, session_slots, slot_of
from spoor.schema import POSITION
from spoor.session import stage
from spoor.sources.store import filter_ip

MARGIN_SECONDS = 300


def pivot_ip(events: DataFrame, sessions: DataFrame, findings: DataFrame, ip: str) -> DataFrame:
    """How often an address, and the /24 around it, occurs in each table, case by case.

    ``source, ip, count, first_seen, last_seen, same_ip``; rows cover the whole /24. Tables that hold
    several cases give a row for each, with ``case_id`` in front; others belong to case 0.
    """
    net = subnet24(F.lit(ip))
    block = f"{ip}/24" if is_ipv4_text(ip) else None

    def part(rows: DataFrame, source: str, column: str, first: str, last: str) -> DataFrame:
        near = rows
        if block and "ip_key" in rows.columns:
            near = filter_ip(rows, block)          # reaches the Parquet reader
        near = near.filter(subnet24(F.col(column)) == net)
        case = F.col("case_id") if "case_id" in rows.columns else F.lit(0)
        return near.groupBy(case.alias("case_id"), F.lit(source).alias("source"), F.col(column).alias("ip")).agg(
            F.count("*").alias("count"), F.min(first).alias("first_seen"),
            F.max(last).alias("last_seen"))

    return (part(events, "events", "ip", "ts", "ts")
            .unionByName(part(sessions, "sessions", "ip", "start", "end"))
            .unionByName(part(findings, "findings", "source_ip", "first_seen", "last_seen"))
            .withColumn("same_ip", F.col("ip") == ip))


def pivot_ua(events: DataFrame, ua: str | None = None) -> DataFrame:
    """Addresses behind each client: one row per pair, with the client's
    number of addresses beside it. No set of addresses is ever held."""
    rows = events if ua is None else events.filter(F.col("ua") == ua)
    pairs = rows.groupBy("ua", "ip").agg(
        F.count("*").alias("count"), F.min("ts").alias("first_seen"),
        F.max("ts").alias("last_seen"))
    return pairs


def shared_clients(events: DataFrame) -> DataFrame:
    """``ua, n_ips, count`` per client."""
    return (pivot_ua(events).groupBy("ua")
            .agg(F.count("*").alias("n_ips"), F.sum("count").alias("count")))


def pivot_url(events: DataFrame, path: str) -> DataFrame:
    """Who requested a path, with or without a query, in time order."""
    wanted = (F.col("url") == path) | F.col("url").startswith(path + "?")
    return (events.filter(wanted).select("ts", "ip", "method", "status", "url", *POSITION)
            .orderBy("ts", *POSITION))


def _clock_slot(ts: Column, width: int) -> Column:
    seconds = F.unix_seconds(ts)
    return seconds - F.pmod(seconds, F.lit(width))


def finding_windows(findings: DataFrame, margin_seconds: int = MARGIN_SECONDS,
                    severity: str = "critical") -> DataFrame:
    """``lo, hi``: merged spans around findings, none touching another."""
    margin = F.expr(f"interval {int(margin_seconds)} seconds")
    first = F.coalesce("first_seen", "last_seen")
    spans = (findings.filter((F.col("severity") == severity) & first.isNotNull())
             .select((first - margin).alias("lo"),
                     (F.coalesce("last_seen", "first_seen") + margin).alias("hi"))
             # Spans that start in the same slot overlap, as each is a slot long.
             .groupBy(_clock_slot(F.col("lo"), 2 * margin_seconds).alias("slot"))
             .agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("slot"))
    # One row per slot of the calendar is left, however many findings there are.
    order = Window.orderBy("lo", "hi")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    return (spans.withColumn("reach", F.max("hi").over(before))
            .withColumn("group", F.sum(F.when(F.col("lo") <= F.col("reach"), 0).otherwise(1))
                        .over(order.rowsBetween(Window.unboundedPreceding, 0)))
            .groupBy("group").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("group"))


def pivot_time(events: DataFrame, findings: DataFrame, margin_seconds: int = MARGIN_SECONDS,
               severity: str = "critical") -> DataFrame:
    """Everything that happened within the margin of a critical finding.

    The merged spans are disjoint and at least two margins long, so a clock
    slot of that width touches at most two of them. Events meet them by slot
    number, an equality join, and the exact test follows.
    """
    width = 2 * margin_seconds
    windows = finding_windows(findings, margin_seconds, severity)
    slots = stage(windows.withColumn("slot", F.explode(F.sequence(
        _clock_slot(F.col("lo"), width), _clock_slot(F.col("hi"), width), F.lit(width)))),
        "finding-windows")
    return (events.withColumn("slot", _clock_slot(F.col("ts"), width)).join(slots, "slot")
            .filter(F.col("ts").between(F.col("lo"), F.col("hi"))).drop("slot")
            .withColumnsRenamed({"lo": "window_start", "hi": "window_end"}))


def nearest_findings(events: DataFrame, findings: DataFrame, margin_seconds: int = MARGIN_SECONDS,
                     severity: str = "critical") -> DataFrame:
    """Each event with the nearest critical finding before and after it: at most two rows an event.

    Adds ``side`` (``before`` or ``after``), ``moment``, ``seconds`` away, ``rule`` and ``source_ip`` of the finding.
    A finding has two moments, its first and last hit. Time counts in whole seconds; a moment in the event's own
    second is on both sides. Of findings at one moment the least (rule, address) counts.

    Moments are reduced to one a second, and each tells the seconds within the margin about itself; a second keeps
    the nearest on either side. So that table grows with the time around findings, and events meet it by their second.
    """
    second = F.unix_seconds(F.col("moment"))
    moments = (findings.filter(F.col("severity") == severity)
               .select("rule", "source_ip", F.explode(F.array("first_seen", "last_seen")).alias("moment"))
               .filter("moment is not null").groupBy(second.alias("at"))
               .agg(F.min(F.struct("rule", "source_ip")).alias("finding")))
    away = F.explode(F.sequence(F.lit(-margin_seconds), F.lit(margin_seconds)))
    near = moments.withColumn("away", away).withColumn("second", F.col("at") + F.col("away"))
    pick = F.struct(F.abs("away").alias("seconds"), F.timestamp_seconds("at").alias("moment"), "finding.rule", "finding.source_ip")
    sides = near.groupBy("second").agg(F.min(F.when(F.col("away") >= 0, pick)).alias("before"),
                                       F.min(F.when(F.col("away") <= 0, pick)).alias("after"))
    sides = stage(sides, "finding-seconds")
    met = events.withColumn("second", F.unix_seconds("ts")).join(sides, "second").drop("second")
    both = F.filter(F.array(*[F.when(F.col(s).isNotNull(), F.struct(F.lit(s).alias("side"), f"{s}.*")) for s in ("before", "after")]),
                    lambda s: s.isNotNull())
    return met.select(*events.columns, F.inline(both))


def pivot_referrer(events: DataFrame, method: str = "POST") -> DataFrame:
    """Requests of one method by referrer, blank ones included."""
    return (events.filter(F.col("method") == method).groupBy("referrer")
            .agg(F.count("*").alias("count")))


def phase_transition(events: DataFrame, gap_seconds: int = R.SESSION_GAP_SECONDS) -> DataFrame:
    """Sessions that request what an earlier scan from the same /24 had found.

    For each (/24, URL) only the earliest end of a scanner session that got an
    answer below 400 matters, so both sides meet as single rows per URL and no
    pairs of sessions are formed.
    """
    slots = session_slots(events, gap_seconds)
    seen = (events.withColumn("slot", slot_of(gap_seconds))
            .groupBy(*SLOT, "url").agg(F.min("status").alias("best_status")))
    visits = (seen.join(slots, SLOT)
              .groupBy("ip", "ua", "session_no", "session_start", "session_end", "url")
              .agg(F.min("best_status").alias("best_status"))
              .withColumn("net", subnet24(F.col("ip")))
              .withColumn("scanner", is_scanner_ua(F.col("ua"))))
    found = (visits.filter(F.col("scanner") & (F.col("best_status") < 400))
             .groupBy("net", "url").agg(F.min("session_end").alias("scan_end")))
    later = (visits.filter(~F.col("scanner")).join(found, ["net", "url"])
             .filter(F.col("session_start") > F.col("scan_end")))
    return later.groupBy("ip", "ua", "session_no", "session_start").agg(
        F.count("*").alias("shared_urls"), F.min("scan_end").alias("first_scan_end"))
