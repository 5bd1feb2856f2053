"""Enrichment, sinks, whole reports and streams."""
import datetime as dt
import json

from pyspark.sql import functions as F

from spoor.operators import correlate, describe, detect, enrich
from spoor.plans import reports
from spoor.schema import REPUTATION_SCHEMA
from spoor.session import run_path
from spoor.sinks import write
from spoor.sources import store
from spoor.streaming import windows

NOW = dt.datetime(2024, 2, 1, tzinfo=dt.timezone.utc)


def _reputation(spark, rows):
    full = [(ip, score, 1, "ZZ", "", "", "", False, "", NOW - dt.timedelta(hours=h), "{}") for ip, score, h in rows]
    return spark.createDataFrame(full, REPUTATION_SCHEMA)


def _listed(spark, ips):
    return enrich.listed(spark.createDataFrame(list(zip(ips, range(len(ips)))), "ip string, n long"), F.col("n"), 0)


def test_bulk_check(spark):
    ips = [" 8.8.8.8 ", "", "10.0.0.1", "8.8.8.8", "nope", "1.1.1.1", "9.9.9.9", "4.4.4.4", "5.5.5.5", "6.6.6.6"]
    known = _reputation(spark, [("8.8.8.8", 90, 23), ("1.1.1.1", 10, 24), ("5.5.5.5", 30, 1), ("6.6.6.6", 26, 1)])
    result = reports.bulk_check(_listed(spark, ips), known, budget=2, now=NOW)
    verdicts = {r["ip"]: r["verdict"] for r in result.screened.collect()}
    assert verdicts["10.0.0.1"] == "private/reserved" and verdicts["nope"] == "invalid" and len(verdicts) == 8
    # 1.1.1.1 was checked exactly a day ago: stale. The third look-up ends the work.
    assert {r["ip"]: r["state"] for r in result.states.collect()} == {
        "8.8.8.8": "cached", "1.1.1.1": "refresh", "9.9.9.9": "refresh", "4.4.4.4": "unchecked",
        "5.5.5.5": "unchecked", "6.6.6.6": "unchecked"}
    counts = result.counts.first()
    assert (counts["checked"], counts["cache_hits"], counts["api_calls"], counts["skipped"], counts["unchecked"]) == (
        3, 1, 2, 2, 3)
    assert [(r["ip"], r["band"]) for r in result.report.collect()] == [("8.8.8.8", "bad")]
    whole = reports.bulk_check(_listed(spark, ips), known, budget=5, now=NOW)
    assert [r["band"] for r in whole.report.collect()] == ["bad", "warn", "warn"]


def test_upsert(spark):
    old = _reputation(spark, [("1.1.1.1", 1, 5), ("2.2.2.2", 2, 5)])
    new = _reputation(spark, [("1.1.1.1", 7, 1), ("3.3.3.3", 3, 1)])
    merged = enrich.reputation_upsert(old, new)
    assert {r["ip"]: r["abuse_score"] for r in merged.collect()} == {"1.1.1.1": 7, "2.2.2.2": 2, "3.3.3.3": 3}
    assert merged.schema == REPUTATION_SCHEMA


def _log(events_of):
    return events_of([{"s": i * 60, "ip": f"9.9.9.{i % 3}", "url": "/.git/" if i % 4 == 0 else "/ok",
                       "bytes": 1048576, "status": 404 if i % 5 == 0 else 200} for i in range(60)])


def test_analysis_replaces_only_its_case(spark, events_of):
    events, findings = run_path(spark, "events"), run_path(spark, "findings")
    for case in (1, 2):
        store.write_events(_log(events_of), events, case)
    for case in (1, 2, 1):
        by_severity = reports.run_analysis(spark, events, findings, case, now=NOW)
    assert {r["severity"]: r["count"] for r in by_severity.collect()} == {"high": 3}
    stored = spark.read.parquet(findings).groupBy("case_id").count().collect()
    assert {r["case_id"]: r["count"] for r in stored} == {1: 3, 2: 3}
    store.write_events(_log(events_of).filter("url = '/ok'").limit(1).withColumn("ua", F.lit("-")), events, 3)
    reports.run_analysis(spark, events, findings, 3, now=NOW)
    reports.run_analysis(spark, events, findings, 1, now=NOW)
    assert spark.read.parquet(findings).filter("case_id = 3").count() == 0
    assert spark.read.parquet(findings).count() == 6


def test_timeline_report_and_export(spark, events_of, tmp_path):
    report = reports.build_timeline(_log(events_of))
    assert report.totals.first()["total_sessions"] == 3
    assert report.chains.count() == 3
    write.export_timeline(report.sessions, str(tmp_path / "csv"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "csv").glob("*.csv")))
    header, first = text.splitlines()[:2]
    assert header == "start,end,ip,phase,events,404s,bytes_out,tags,user_agent"
    assert first.startswith("2024-01-01T00:00:00Z,") and "sensitive_file" in first
    write.export_timeline(report.sessions, str(tmp_path / "json"), "json")
    document = json.loads(next(iter(sorted((tmp_path / "json").glob("*.json")))).read_text().splitlines()[0])
    assert document["phase"] == "exfiltration"
    assert [e["url"] for e in document["sample_events"][:4]] == ["/.git/", "/ok", "/ok", "/.git/"]


def test_statistics(spark, events_of, tmp_path):
    events = _log(events_of)
    tables = reports.compute_statistics(events, 2)
    assert tables["summary"].first()["total_events"] == 60
    assert [r["count"] for r in tables["top_ips"].collect()] == [20, 20]
    assert tables["timeseries"].count() <= 60
    approx = describe.stats_summary(events, approximate=True).first()
    assert approx["unique_ips"] == 3
    write.export_statistics(events, str(tmp_path / "stats"))
    rows = spark.read.option("header", True).csv(str(tmp_path / "stats"))
    assert {r["section"] for r in rows.select("section").distinct().collect()} >= {
        "summary", "status_classes", "top_ips", "top_ip_bytes", "traffic"}


def test_histogram_steps(events_of):
    def steps(seconds):
        rows = describe.traffic_histogram(events_of([{"s": s} for s in seconds])).collect()
        return len(rows), rows[0]["t"], sum(r["count"] for r in rows)
    assert steps([0, 59]) == (60, "2024-01-01 00:00", 2)
    assert steps([0, 60]) == (13, "2024-01-01 00:00", 2)
    assert steps([0, 86400 * 400])[0] == 58
    assert steps([0, 86400 * 3000])[1] == "2024-01-01 00:00"
    assert describe.traffic_histogram(events_of([{}]).limit(0)).collect() == []
    peak = describe.traffic_peak(describe.traffic_histogram(events_of([{"s": s} for s in (5, 1, 5, 1, 9)])))
    assert (peak.first()["t"], peak.first()["count"]) == ("2024-01-01 00:00", 2)


def _stream(spark, frame, build, mode="append"):
    path, name = run_path(spark, "stream"), "t" + run_path(spark, "x").rsplit("-", 1)[1]
    frame.write.parquet(path)
    source = spark.readStream.schema(frame.schema).parquet(path)
    query = (build(source).writeStream.format("memory").queryName(name).outputMode(mode)
             .option("checkpointLocation", run_path(spark, "ckpt")).start())
    query.processAllAvailable()
    query.stop()
    return spark.table(name).collect()


def test_streams_agree_with_batch(spark, events_of):
    rows = [{"s": i, "status": 401} for i in range(25)] + [{"s": 90000, "ip": "1.1.1.1"}]
    events = events_of(rows)
    found = _stream(spark, events, windows.brute_force_windows, "update")
    assert [(r["ip"], r["failures"]) for r in found] == [("9.9.9.9", 25)]
    closed = _stream(spark, events, windows.sessions)
    batch = correlate.session_rollup(events).filter("ip = '9.9.9.9'").first()
    assert [(r["ip"], r["event_count"]) for r in closed] == [("9.9.9.9", batch["event_count"])]


def test_rollup_of_cases(events_of):
    events = _log(events_of).withColumn("case_id", F.lit(1))
    found = detect.find_signatures(_log(events_of), case_id=2)
    rows = {r["case_id"]: (r["logs"], r["findings"]) for r in detect.case_rollup(events, found).collect()}
    assert rows == {1: (60, 0), 2: (0, 3)}
