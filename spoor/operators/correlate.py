"""Sessions, attack phases and per-address attack chains.

A session is a run of requests of one (address, client) with no pause longer
than the gap. Two requests in the same gap-wide slot of the clock are never
further apart than the gap, so requests are first summed per slot. That sum
combines inside each task, which makes a client that sends a third of all
requests as cheap as any other; what remains is at most one row per key and
slot, and only those rows are ordered to find the pauses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spoor import rules as R
from spoor.functions.ip import ip_key
from spoor.functions.text import (classify_phase, is_scanner_ua, mask_columns, mask_names,
                                  phase_rank, tags_from_masks, url_tags)
from spoor.schema import POSITION
from spoor.session import match, stage
from spoor.sources.store import filter_ip, filter_time

SAMPLES = 10
ALWAYS_SAMPLED = 3
SLOT = ["ip", "ua", "slot"]
SESSION = ["ip", "ua", "session_no"]


def event_order(events: DataFrame, ip=None, start=None, end=None) -> DataFrame:
    """Filtered events in time order, ties in log order."""
    if ip:
        events = filter_ip(events, ip)
    return filter_time(events, start, end).orderBy("ts", *POSITION)


def slot_of(gap_seconds: int) -> Column:
    micros = F.unix_micros("ts")
    return (micros - F.pmod(micros, F.lit(gap_seconds * 1_000_000))).alias("slot")


def slot_sums(events: DataFrame, rules: R.RuleSet = R.DEFAULT_RULES,
              gap_seconds: int = R.SESSION_GAP_SECONDS, tagged: bool = True) -> DataFrame:
    """Per (ip, ua, slot): first and last time, and the sums a session needs."""
    keep = ["ip", "ua", slot_of(gap_seconds), "ts"]
    if not tagged:
        return events.select(*keep).groupBy(*SLOT).agg(
            F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    rows = (events.select(*keep, "status", "bytes", url_tags(events.columns, rules).alias("tags"))
            .select("ip", "ua", "slot", "ts", "status", "bytes",
                    *mask_columns(F.col("tags"), rules)))
    return rows.groupBy(*SLOT).agg(
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
        F.count("*").alias("event_count"), F.count_if(F.col("status") == 404).alias("n404"),
        F.sum("bytes").alias("bytes_out"),
        *[F.bit_or(m).alias(m) for m in mask_names(rules)])


def number_sessions(slots: DataFrame, gap_seconds: int = R.SESSION_GAP_SECONDS) -> DataFrame:
    """Add ``session_no``, counting from 1 within each (ip, ua)."""
    order = Window.partitionBy("ip", "ua").orderBy("slot")
    pause = F.unix_micros("first_ts") - F.unix_micros(F.lag("last_ts").over(order))
    opens = F.when(pause <= gap_seconds * 1_000_000, 0).otherwise(1)
    return (slots.withColumn("opens", opens)
            .withColumn("session_no", F.sum("opens").over(order)).drop("opens"))


def session_rollup(events: DataFrame, rules: R.RuleSet = R.DEFAULT_RULES,
                   gap_seconds: int = R.SESSION_GAP_SECONDS) -> DataFrame:
    """One row per session with its sums and sorted tags; ``ua`` is still whole."""
    return roll_up(number_sessions(slot_sums(events, rules, gap_seconds), gap_seconds), rules)


def roll_up(slots: DataFrame, rules: R.RuleSet = R.DEFAULT_RULES) -> DataFrame:
    """Numbered slots to sessions. The numbering already placed all rows of a
    key together, so this adds no shuffle."""
    return slots.groupBy(*SESSION).agg(
        F.min("first_ts").alias("start"), F.max("last_ts").alias("end"),
        F.sum("event_count").alias("event_count"), F.sum("n404").alias("n404"),
        F.sum("bytes_out").alias("bytes_out"),
        *[F.bit_or(m).alias(m) for m in mask_names(rules)]
    ).select(*SESSION, "start", "end", "event_count", "n404", "bytes_out",
             tags_from_masks(rules, ordered=True).alias("tags"),
             is_scanner_ua(F.col("ua")).alias("scanner_ua"))


def session_phase(sessions: DataFrame, rules: R.RuleSet = R.DEFAULT_RULES) -> DataFrame:
    return sessions.withColumn("phase", classify_phase(
        F.col("tags"), F.col("bytes_out"), F.col("event_count"), F.col("n404"),
        F.col("scanner_ua"), rules))


def session_slots(events: DataFrame, gap_seconds: int = R.SESSION_GAP_SECONDS) -> DataFrame:
    """``ip, ua, slot, session_no, session_start, session_end``."""
    numbered = number_sessions(slot_sums(events, gap_seconds=gap_seconds, tagged=False),
                               gap_seconds)
    whole = Window.partitionBy(*SESSION)
    return numbered.select(*SLOT, "session_no",
                           F.min("first_ts").over(whole).alias("session_start"),
                           F.max("last_ts").over(whole).alias("session_end"))


def sessionize(events: DataFrame, gap_seconds: int = R.SESSION_GAP_SECONDS) -> DataFrame:
    """Every event with the number, start and end of its session.

    The session of a slot is looked up by (ip, ua, slot). A very busy slot is
    split over tasks by the adaptive skew join.
    """
    slots = session_slots(events, gap_seconds)
    return match(events.withColumn("slot", slot_of(gap_seconds)), slots, SLOT).drop("slot")


def session_samples(events: DataFrame, rules: R.RuleSet = R.DEFAULT_RULES,
                    gap_seconds: int = R.SESSION_GAP_SECONDS,
                    slots: DataFrame | None = None) -> DataFrame:
    """``ip, ua, session_no, sample_events`` with at most ten events each.

    Kept are the first three events and every tagged one, then the first ten
    of these. So a slot can only contribute its first three events and its
    first ten tagged ones. One scan finds both, and a window group limit cuts
    them inside each task, so a busy slot sends a bounded number of rows.
    """
    if slots is None:
        slots = session_slots(events, gap_seconds)
    kinds = F.array(F.struct(F.lit("first").alias("kind"), F.lit(ALWAYS_SAMPLED).alias("most")),
                    F.struct(F.when(F.size("tags") > 0, F.lit("tagged")).alias("kind"),
                             F.lit(SAMPLES).alias("most")))
    rows = (events.withColumn("tags", url_tags(events.columns, rules))
            .select("ip", "ua", slot_of(gap_seconds), "ts", "method", "url", "status", "tags",
                    *POSITION, F.inline(kinds))
            .filter("kind is not null"))
    in_slot = Window.partitionBy(*SLOT, "kind").orderBy("ts", *POSITION)
    candidates = (rows.withColumn("place", F.row_number().over(in_slot))
                  .filter(F.col("place") <= SAMPLES).filter(F.col("place") <= F.col("most"))
                  .drop("place", "most", "kind").dropDuplicates([*SLOT, "ts", *POSITION]))
    placed = match(candidates, slots.select(*SLOT, "session_no"), SLOT)
    order = Window.partitionBy(*SESSION).orderBy("ts", *POSITION)
    kept = (placed.withColumn("place", F.row_number().over(order))
            .filter((F.col("place") <= ALWAYS_SAMPLED) | (F.size("tags") > 0))
            .withColumn("place", F.row_number().over(order))
            .filter(F.col("place") <= SAMPLES))
    event = F.struct("place", F.struct("ts", "method", "url", "status", "tags").alias("event"))
    return kept.groupBy(*SESSION).agg(
        F.transform(F.sort_array(F.collect_list(event)), lambda e: e["event"])
        .alias("sample_events"))


def timeline(events: DataFrame, ip=None, start=None, end=None, include_benign: bool = False,
             rules: R.RuleSet = R.DEFAULT_RULES, gap_seconds: int = R.SESSION_GAP_SECONDS,
             samples: bool = True) -> DataFrame:
    """Sessions by start time, without the benign ones unless asked for."""
    if ip:
        events = filter_ip(events, ip)
    events = filter_time(events, start, end)
    slots = number_sessions(slot_sums(events, rules, gap_seconds), gap_seconds)
    if samples:
        # Used twice below, and far smaller than the events it sums.
        slots = stage(slots, "session-slots")
    sessions = session_phase(roll_up(slots, rules), rules)
    if not include_benign:
        sessions = sessions.filter(F.col("phase") != "benign")
    if samples and not include_benign and "tags" not in events.columns:
        # Looking up the slots kept costs less than tagging the URLs of all others a second time.
        sessions = stage(sessions, "sessions-kept")
        slots = stage(match(slots, sessions.select(*SESSION), SESSION, "left_semi").select(*SLOT, "session_no"), "slots-kept")
        events = match(events.withColumn("slot", slot_of(gap_seconds)), slots, SLOT, "left_semi").drop("slot")
    if samples:
        sessions = match(sessions, session_samples(events, rules, gap_seconds, slots), SESSION, "left")
    return sessions.orderBy("start", "ip", "ua", "session_no")


def timeline_totals(sessions: DataFrame) -> DataFrame:
    """``total_sessions, suspicious_sessions`` of sessions with benign ones included."""
    return sessions.agg(F.count("*").alias("total_sessions"),
                        F.count_if(F.col("phase") != "benign").alias("suspicious_sessions"))


def attack_chains(sessions: DataFrame) -> DataFrame:
    """Phases of each address in order of first appearance, worst chains first."""
    per_phase = sessions.groupBy("ip", "phase").agg(
        F.min("start").alias("first"), F.count("*").alias("n"))
    step = F.struct("first", phase_rank(F.col("phase")).alias("rank"), "phase")
    chains = per_phase.groupBy("ip").agg(
        F.min("first").alias("first_seen"),
        F.transform(F.array_sort(F.collect_list(step)), lambda s: s["phase"]).alias("phases"),
        F.sum("n").alias("sessions"), F.max(phase_rank(F.col("phase"))).alias("worst"))
    return (chains.orderBy(F.desc("worst"), "first_seen", ip_key(F.col("ip")))
            .select("ip", "first_seen", "phases", "sessions"))
