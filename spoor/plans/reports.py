"""Whole reports of a case, composed of the operators."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spoor import rules as R
from spoor.operators import correlate, describe, detect, enrich, profile
from spoor.session import configure, stage
from spoor.sinks.write import write_findings
from spoor.sources.store import read_case


def run_analysis(spark: SparkSession, events_path: str, findings_path: str, case_id: int,
                 rules: R.RuleSet = R.DEFAULT_RULES, now=None, thresholds=None) -> DataFrame:
    """Find, store and count: returns the number of findings by severity."""
    configure(spark)
    events = read_case(spark, events_path, case_id)
    found = detect.all_findings(events, rules, case_id=case_id, now=now, thresholds=thresholds)
    write_findings(found, findings_path, case_id)
    stored = spark.read.schema(found.schema).parquet(findings_path)
    return detect.findings_by_severity(stored.filter(F.col("case_id") == case_id))


@dataclass
class Timeline:
    sessions: DataFrame
    totals: DataFrame
    chains: DataFrame


def build_timeline(events: DataFrame, ip=None, start=None, end=None, include_benign=False,
                   rules: R.RuleSet = R.DEFAULT_RULES) -> Timeline:
    """Sessions are computed once, stored, and read by all three results."""
    whole = stage(correlate.timeline(events, ip, start, end, True, rules), "sessions")
    kept = whole if include_benign else whole.filter("phase <> 'benign'")
    return Timeline(kept.orderBy("start", "ip", "ua"), correlate.timeline_totals(whole),
                    correlate.attack_chains(kept))


def compute_statistics(events: DataFrame, top_n=20) -> dict[str, DataFrame]:
    histogram = describe.traffic_histogram(events)
    result = {"summary": describe.stats_summary(events)}
    for name, field in describe.RANKED_FIELDS.items():
        result[name] = describe.rank_field(events, field, top_n)
    result.update(top_status=describe.top_status(events, top_n),
                  status_classes=describe.status_classes(events),
                  top_ip_bytes=describe.top_ip_bytes(events, top_n),
                  timeseries=histogram, peak=describe.traffic_peak(histogram))
    return result


@dataclass
class Profile:
    summary: DataFrame
    fields: DataFrame
    discrepancies: DataFrame


def analyze_parameters(lines: DataFrame, server: str, cap: int | None = None) -> Profile:
    """Profile of raw lines. Unknown server types are read as generic."""
    if server not in profile.SERVER_TYPES:
        server = "generic"
    rows = profile.observed(profile.first_lines(lines, cap), server)
    totals = stage(profile.counts(rows, server), "profile")
    return Profile(profile.profile_summary(totals, server),
                   profile.field_presence(totals, server),
                   profile.discrepancies(rows, totals, server))


@dataclass
class BulkCheck:
    screened: DataFrame
    states: DataFrame
    report: DataFrame
    counts: DataFrame


def bulk_check(candidates: DataFrame, reputation: DataFrame, budget: int, now=None) -> BulkCheck:
    """Screen a list of addresses and look up what is known of them."""
    screened = stage(enrich.screen_ips(candidates), "screened")
    cached = enrich.reputation_cached(screened.filter("verdict = 'queued'").drop("verdict"),
                                      reputation, now)
    states = stage(enrich.reputation_to_refresh(cached, budget), "states")
    known = states.filter("state = 'cached'").join(reputation, "ip")
    return BulkCheck(screened, states, enrich.reputation_report(known),
                     enrich.reputation_counts(screened, states))
