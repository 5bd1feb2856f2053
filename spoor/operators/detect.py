"""Findings: signatures, behaviour thresholds and traffic anomalies."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spoor import rules as R
from spoor.functions.ip import ip_key
from spoor.functions.text import is_scanner_ua, severity_rank, url_tags
from spoor.schema import FINDING_COLUMNS, POSITION
from spoor.session import match, stage

SCANNER = ("scanner_ua", "medium", "Client is a known scanner or script")
METHOD = ("dangerous_method", "medium", "Uncommon or state-changing HTTP method")
LIST_LIMIT = 100


def _table_case(rows, position: int) -> Column:
    """Rule name to one of its attributes."""
    chain = F.when(F.lit(False), F.lit(None).cast("string"))
    for row in rows:
        chain = chain.when(F.col("rule") == row[0], F.lit(row[position]))
    return chain


def _findings(rows: DataFrame, case_id: int, now: dt.datetime | None) -> DataFrame:
    """Bring rows to the finding layout; absent columns get their defaults."""
    created = F.lit(now).cast("timestamp") if now else F.current_timestamp()
    defaults = {"source_ip": F.lit(None).cast("string"), "sample": F.lit(""),
                "first_seen": F.lit(None).cast("timestamp"),
                "last_seen": F.lit(None).cast("timestamp")}
    rows = rows.withColumns({c: v for c, v in defaults.items() if c not in rows.columns})
    return rows.select(
        F.lit(case_id).alias("case_id"), "rule", "severity", "description", "source_ip",
        F.col("count").cast("bigint").alias("count"),
        F.coalesce("sample", F.lit("")).alias("sample"),
        "first_seen", "last_seen", created.alias("created_at"))


def _with_rule(rows: DataFrame, rule: str, severity: str, description: Column) -> DataFrame:
    return rows.select("*", F.lit(rule).alias("rule"), F.lit(severity).alias("severity"),
                       description.alias("description"))


def _hits_by_ip(hits: DataFrame, max_ips: int | None) -> DataFrame:
    """``rule, source_ip, count, first_seen, last_seen, sample`` of labelled hits.

    The sample is the earliest hit. Counts and times are fixed-width, so they stay in hash aggregation; an
    aggregate that carries texts would sort every hit. Only hits at the first moment are then compared by
    their place in the log. The cut per rule is a window group limit, which trims inside each task.
    """
    hits = stage(hits.withColumnRenamed("ip", "source_ip"), "rule-hits")
    per_ip = stage(hits.groupBy("rule", "source_ip").agg(
        F.count("*").alias("count"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen")), "rule-counts")
    shown = F.when(F.col("url") != "", F.col("url")).otherwise(F.col("ua"))
    first = match(hits.withColumnRenamed("ts", "first_seen"), per_ip, ["rule", "source_ip", "first_seen"], "left_semi")
    samples = first.groupBy("rule", "source_ip").agg(F.min_by(shown, F.struct(*POSITION)).alias("sample"))
    per_ip = match(per_ip, samples, ["rule", "source_ip"], "left")
    if max_ips is None:
        return per_ip
    busiest = Window.partitionBy("rule").orderBy(F.desc("count"), "key", "source_ip")
    return (per_ip.withColumn("key", ip_key(F.col("source_ip")))
            .withColumn("place", F.row_number().over(busiest))
            .filter(F.col("place") <= max_ips).drop("key", "place"))


def _label_hits(events: DataFrame, labels: Column) -> DataFrame:
    """One row per event and label. Labels sit in a generator, so they are
    computed once per event and events without any leave no row."""
    return events.select("ip", "ts", "url", "ua", *POSITION, F.explode(labels).alias("rule"))


def _all_labels(tags: Column) -> Column:
    """Rule tags plus the labels for the client and the method."""
    return F.concat(tags, F.array_compact(F.array(
        F.when(is_scanner_ua(F.col("ua")), F.lit(SCANNER[0])),
        F.when(F.col("method").isin(*R.UNCOMMON_METHODS), F.lit(METHOD[0])))))


def _labelled_findings(events, labels, rules, max_ips, case_id, now) -> DataFrame:
    known = [(r.name, r.severity, r.description) for r in (rules.rules if rules else ())]
    known += [SCANNER, METHOD]
    rows = (_hits_by_ip(_label_hits(events, labels), max_ips)
            .withColumn("severity", _table_case(known, 1))
            .withColumn("description", _table_case(known, 2)))
    return _findings(rows, case_id, now)


def find_signatures(events: DataFrame, rules: R.RuleSet = R.DEFAULT_RULES,
                    max_ips: int | None = None, case_id: int = 0, now=None) -> DataFrame:
    """One finding per rule and address, from a single scan for all rules."""
    tags = url_tags(events.columns, rules)
    return _labelled_findings(events, tags, rules, max_ips, case_id, now)


def find_scanner_ua(events: DataFrame, max_ips: int | None = None, case_id: int = 0,
                    now=None) -> DataFrame:
    hits = events.filter(is_scanner_ua(F.col("ua")))
    return _labelled_findings(hits, F.array(F.lit(SCANNER[0])), None, max_ips, case_id, now)


def find_dangerous_method(events: DataFrame, max_ips: int | None = None, case_id: int = 0,
                          now=None) -> DataFrame:
    hits = events.filter(F.col("method").isin(*R.UNCOMMON_METHODS))
    return _labelled_findings(hits, F.array(F.lit(METHOD[0])), None, max_ips, case_id, now)


def _clock(seconds: int) -> Column:
    """Number of the step of the clock that an event falls into."""
    return F.floor(F.unix_seconds("ts") / seconds)


def _busiest(per_ip: DataFrame, n: int | None, measure: str = "count") -> DataFrame:
    """The n addresses with most rows, ties in address order."""
    if n is None:
        return per_ip
    return per_ip.orderBy(F.desc(measure), ip_key(F.col("source_ip")), "source_ip").limit(n)


def find_brute_force(events: DataFrame, threshold: int = R.BRUTE_FORCE_THRESHOLD,
                     window_seconds: int = R.BRUTE_FORCE_WINDOW_SECONDS,
                     max_ips: int | None = None, case_id: int = 0, now=None) -> DataFrame:
    """Addresses whose worst window of refused logins reaches the threshold."""
    windows = (events.filter(F.col("status").isin(*R.AUTH_FAILURES))
               .groupBy(F.col("ip").alias("source_ip"), _clock(window_seconds).alias("slot"))
               .agg(F.count("*").alias("n")))
    return _brute_force(windows, threshold, window_seconds, max_ips, case_id, now)


def _brute_force(windows, threshold=R.BRUTE_FORCE_THRESHOLD, window_seconds=R.BRUTE_FORCE_WINDOW_SECONDS,
                 max_ips=None, case_id=0, now=None) -> DataFrame:
    """``windows``: source_ip and the number ``n`` of refused logins, one row per window."""
    per_ip = windows.groupBy("source_ip").agg(F.max("n").alias("worst"), F.sum("n").alias("count"))
    rows = _busiest(per_ip.filter(F.col("worst") >= threshold), max_ips)
    text = F.format_string(f"%d refused logins (401/403) within {window_seconds // 60} minutes",
                           F.col("worst"))
    return _findings(_with_rule(rows, "brute_force", "high", text), case_id, now)


def find_enum_404(events: DataFrame, threshold: int = R.ENUM_404_THRESHOLD,
                  max_ips: int | None = None, case_id: int = 0, now=None) -> DataFrame:
    """Addresses that ask for many missing paths."""
    per_ip = events.filter(F.col("status") == 404).groupBy(F.col("ip").alias("source_ip")).agg(
        F.count("*").alias("count"), F.min("ts").alias("first_seen"),
        F.max("ts").alias("last_seen"))
    return _enum_404(per_ip, threshold, max_ips, case_id, now)


def _enum_404(per_ip, threshold=R.ENUM_404_THRESHOLD, max_ips=None, case_id=0, now=None) -> DataFrame:
    """``per_ip``: source_ip, count, first_seen and last_seen of missing paths."""
    rows = _busiest(per_ip.filter(F.col("count") >= threshold), max_ips)
    text = F.format_string("%d responses were 404: path enumeration", F.col("count"))
    return _findings(_with_rule(rows, "enumeration_404", "medium", text), case_id, now)


def find_enum_404_ratio(events: DataFrame, min_requests: int = 30, min_ratio: float = 0.7,
                        case_id: int = 0, now=None) -> DataFrame:
    """Addresses most of whose requests miss, whatever their number."""
    per_ip = events.groupBy(F.col("ip").alias("source_ip")).agg(
        F.count("*").alias("requests"), F.count_if(F.col("status") == 404).alias("count"),
        F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))
    rows = per_ip.filter((F.col("requests") >= min_requests)
                         & (F.col("count") / F.col("requests") > min_ratio))
    text = F.format_string("%d of %d responses were 404", F.col("count"), F.col("requests"))
    return _findings(_with_rule(rows, "enumeration_404_ratio", "medium", text), case_id, now)


def find_exfil_bytes(events: DataFrame, min_bytes: int = R.EXFIL_MIN_BYTES,
                     candidates: int | None = None, min_ips: int = R.EXFIL_MIN_IPS,
                     sigmas: float = 3.0, case_id: int = 0, now=None) -> DataFrame:
    """Addresses that received far more bytes than the average address.

    Mean and deviation are one row, read when the frame is made; no address is left out and no
    task sees all of them. ``candidates`` compares the busiest addresses only.
    """
    per_ip = events.groupBy(F.col("ip").alias("source_ip")).agg(
        F.count("*").alias("count"), F.sum("bytes").alias("total"))
    return _exfil_bytes(per_ip, min_bytes, candidates, min_ips, sigmas, case_id, now)


def _exfil_bytes(per_ip, min_bytes=R.EXFIL_MIN_BYTES, candidates=None, min_ips=R.EXFIL_MIN_IPS,
                 sigmas=3.0, case_id=0, now=None) -> DataFrame:
    """``per_ip``: source_ip, count of requests and total of bytes."""
    per_ip = _busiest(stage(per_ip, "bytes-by-ip"), candidates)
    fleet = per_ip.agg(F.count("total").alias("n"), F.avg("total").alias("mean"),
                       F.stddev_pop("total").alias("sigma")).first()
    usual = fleet.n >= min_ips and (fleet.sigma or 0) > 0
    bound = (fleet.mean or 0.0) + sigmas * (fleet.sigma or 0.0)
    rows = per_ip.withColumn("mean", F.lit(fleet.mean or 0.0)).filter(
        F.lit(usual) & (F.col("total") > min_bytes) & (F.col("total") > bound))
    text = F.format_string("%.1f MB sent to one address against a mean of %.1f MB",
                           F.col("total") / 1048576, F.col("mean") / 1048576)
    return _findings(_with_rule(rows, "exfil_bytes", "high", text), case_id, now)


def find_rare_ua(events: DataFrame, max_count: int = R.RARE_UA_MAX_COUNT,
                 candidates: int | None = None, case_id: int = 0,
                 now=None) -> DataFrame:
    """Clients that were seen only a few times; ``candidates`` looks at the least frequent ones only."""
    rows = events.groupBy(F.col("ua").alias("sample")).agg(F.count("*").alias("count"))
    if candidates is not None:
        rows = rows.orderBy("count", "sample").limit(candidates)
    rows = rows.filter((F.col("count") <= max_count) & ~F.col("sample").isin("", "-"))
    return _findings(_with_rule(rows, "rare_user_agent", "low",
                                F.lit("Client was seen only a few times")), case_id, now)


def hourly_counts(events: DataFrame) -> DataFrame:
    """``hour, count`` of the hours that hold events; ``hour`` counts from 1970."""
    return (events.groupBy(_clock(3600).alias("hour"))
            .agg(F.count("*").alias("count")))


def find_traffic_spike(events: DataFrame, zscore: float = R.SPIKE_ZSCORE,
                       min_hours: int = R.SPIKE_MIN_HOURS, case_id: int = 0,
                       now=None) -> DataFrame:
    """Hours with far more requests than the average hour.

    Hours without requests count as zero between the first and the last hour.
    They change mean and deviation but can never be a spike themselves, so
    they enter as a number and no row is made for them.
    """
    return _traffic_spike(hourly_counts(events), zscore, min_hours, case_id, now)


def _traffic_spike(hourly, zscore=R.SPIKE_ZSCORE, min_hours=R.SPIKE_MIN_HOURS, case_id=0, now=None) -> DataFrame:
    """``hourly``: hour and count."""
    # One row per hour of the calendar that holds events is left, so an
    # unpartitioned window costs less than a second scan for the statistics.
    fleet = Window.partitionBy()
    span = (F.max("hour").over(fleet) - F.min("hour").over(fleet) + 1)
    rows = (hourly
            .withColumns({"hours": span, "mean": F.sum("count").over(fleet) / span,
                          "used": F.count("*").over(fleet)})
            .withColumn("squares", F.sum((F.col("count") - F.col("mean"))
                                         * (F.col("count") - F.col("mean"))).over(fleet))
            .withColumn("sigma", F.sqrt((F.col("squares") + (F.col("hours") - F.col("used"))
                                         * F.col("mean") * F.col("mean")) / F.col("hours")))
            .filter((F.col("hours") >= min_hours) & (F.col("sigma") > 0))
            .withColumn("z", (F.col("count") - F.col("mean")) / F.col("sigma"))
            .filter(F.col("z") > zscore)
            .withColumn("first_seen", F.timestamp_seconds(F.col("hour") * 3600)))
    text = F.format_string("%d requests in one hour (z=%.1f) from %s", F.col("count"), F.col("z"),
                           F.date_format("first_seen", "yyyy-MM-dd HH:mm"))
    return _findings(_with_rule(rows, "traffic_spike", "medium", text), case_id, now)


def activity(events: DataFrame, window_seconds: int = R.BRUTE_FORCE_WINDOW_SECONDS) -> DataFrame:
    """What each address did in each window of each hour: ``source_ip, slot, hour, count, total, refused,
    missing, first_missing, last_missing``. All thresholds follow from these sums."""
    lost = F.col("status") == 404
    return events.groupBy(F.col("ip").alias("source_ip"), _clock(window_seconds).alias("slot"),
                          _clock(3600).alias("hour")).agg(
        F.count("*").alias("count"), F.sum("bytes").alias("total"),
        F.count_if(F.col("status").isin(*R.AUTH_FAILURES)).alias("refused"), F.count_if(lost).alias("missing"),
        F.min(F.when(lost, F.col("ts"))).alias("first_missing"), F.max(F.when(lost, F.col("ts"))).alias("last_missing"))


def all_findings(events: DataFrame, rules: R.RuleSet = R.DEFAULT_RULES,
                 max_ips: int | None = None, case_id: int = 0, now=None,
                 thresholds: dict | None = None) -> DataFrame:
    """Every finding of a case, in three scans: labels, rare clients, and all thresholds together.

    ``thresholds`` maps a detector's name to keyword arguments, for example
    ``{"brute_force": {"threshold": 5}}``.
    """
    given = thresholds or {}
    common = {"case_id": case_id, "now": now}
    brute = given.get("brute_force", {})
    done = stage(activity(events, brute.get("window_seconds", R.BRUTE_FORCE_WINDOW_SECONDS)), "activity")
    windows = done.filter("refused > 0").groupBy("source_ip", "slot").agg(F.sum("refused").alias("n"))
    missing = done.filter("missing > 0").groupBy("source_ip").agg(
        F.sum("missing").alias("count"), F.min("first_missing").alias("first_seen"), F.max("last_missing").alias("last_seen"))
    sent = done.groupBy("source_ip").agg(F.sum("count").alias("count"), F.sum("total").alias("total"))
    hourly = done.groupBy("hour").agg(F.sum("count").alias("count"))
    parts = [
        _labelled_findings(events, _all_labels(url_tags(events.columns, rules)), rules, max_ips,
                           case_id, now),
        _brute_force(windows, **{"max_ips": max_ips, **common, **brute}),
        _enum_404(missing, **{"max_ips": max_ips, **common, **given.get("enum_404", {})}),
        _exfil_bytes(sent, **common, **given.get("exfil_bytes", {})),
        find_rare_ua(events, **common, **given.get("rare_ua", {})),
        _traffic_spike(hourly, **common, **given.get("traffic_spike", {})),
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result.select(*FINDING_COLUMNS)


def findings_by_severity(findings: DataFrame) -> DataFrame:
    return findings.groupBy("severity").agg(F.count("*").alias("count"))


def list_findings(findings: DataFrame, limit: int = LIST_LIMIT) -> DataFrame:
    """The most recent findings, worst severity and largest count first."""
    recent = findings.orderBy(F.desc("created_at"), "rule", "source_ip", "sample",
                              "first_seen").limit(limit)
    return recent.orderBy(severity_rank(F.col("severity")), F.desc("count"), "rule", "source_ip")


def case_rollup(events: DataFrame, findings: DataFrame) -> DataFrame:
    """``case_id, logs, findings`` for every case that has either."""
    logs = events.groupBy("case_id").agg(F.count("*").alias("logs"))
    found = findings.groupBy("case_id").agg(F.count("*").alias("findings"))
    zero = F.lit(0).cast("bigint")
    return logs.join(found, "case_id", "full").select(
        "case_id", F.coalesce("logs", zero).alias("logs"),
        F.coalesce("findings", zero).alias("findings"))
