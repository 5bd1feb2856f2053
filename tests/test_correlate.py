import random

from pyspark.sql import functions as F

from spoor.operators import correlate, pivot
from spoor.sources.weblog import weblog

GAP = 1800


def test_gap_boundary(spark):
    rows = [(1, 0), (1, GAP * 10**6), (2, 0), (2, GAP * 10**6 + 1)]
    events = spark.createDataFrame(rows, "k int, us long").select(
        F.concat(F.lit("1.0.0."), F.col("k").cast("string")).alias("ip"), F.lit("u").alias("ua"),
        F.timestamp_micros(F.lit(1704067200000000) + 123456 + F.col("us")).alias("ts"),
        F.lit(200).alias("status"), F.lit(1).cast("long").alias("bytes"), F.lit("/").alias("url"))
    counts = {r["ip"]: r["count"] for r in correlate.session_rollup(events).groupBy("ip").count().collect()}
    assert counts == {"1.0.0.1": 1, "1.0.0.2": 2}


def _plain_sessions(rows):
    """The same fold, one event after another."""
    open_, done = {}, []
    for s, ip, ua in sorted(rows):
        key = (ip, ua)
        if key in open_ and s - open_[key][-1] > GAP:
            done.append((key, tuple(open_.pop(key))))
        open_.setdefault(key, []).append(s)
    return sorted(done + [(k, tuple(v)) for k, v in open_.items()])


def test_sessions_match_a_plain_fold(events_of):
    rng = random.Random(5)
    rows, now = [], 0
    for _ in range(400):
        now += rng.choice([1, 60, 900, 1799, 1800, 1801, 4000])
        rows.append((now, rng.choice(["1.1.1.1", "1.1.1.2"]), rng.choice(["a", "b"])))
    events = events_of([{"s": s, "ip": i, "ua": u} for s, i, u in rows])
    placed = correlate.sessionize(events).groupBy("ip", "ua", "session_no").agg(
        F.sort_array(F.collect_list(F.unix_seconds("ts") - 1704067200)).alias("s")).collect()
    assert sorted(((r["ip"], r["ua"]), tuple(r["s"])) for r in placed) == _plain_sessions(rows)
    rolled = correlate.session_rollup(events)
    assert rolled.agg(F.sum("event_count")).first()[0] == len(rows)
    assert rolled.count() == len(placed)


def test_samples(events_of):
    rows = [{"s": i, "url": "/.git/" if i >= 5 else "/ok"} for i in range(20)]
    sample = correlate.session_samples(events_of(rows)).first()["sample_events"]
    assert [e["ts"].second for e in sample] == [0, 1, 2, 5, 6, 7, 8, 9, 10, 11]
    assert sample[0]["tags"] == [] and sample[3]["tags"] == ["sensitive_file"]


def test_timeline_and_chains(events_of):
    rows = [{"ip": "1.1.1.1", "s": 0, "url": "/wp-login.php"}, {"ip": "1.1.1.1", "s": 9000, "url": "/shell.php"},
            {"ip": "1.1.1.2", "s": 10, "bytes": 11 * 1024 * 1024}, {"ip": "1.1.1.3", "s": 5}]
    events = events_of(rows)
    sessions = correlate.timeline(events).collect()
    assert [s["phase"] for s in sessions] == ["recon", "exfiltration", "post-exploitation"]
    everything = correlate.timeline(events, include_benign=True)
    totals = correlate.timeline_totals(everything).first()
    assert (totals["total_sessions"], totals["suspicious_sessions"]) == (4, 3)
    chains = correlate.attack_chains(correlate.timeline(events)).collect()
    assert [(c["ip"], c["phases"]) for c in chains] == [
        ("1.1.1.2", ["exfiltration"]), ("1.1.1.1", ["recon", "post-exploitation"])]
    assert correlate.timeline(events, ip="1.1.1.1").count() == 2


def test_samples_are_those_of_all_sessions(events_of):
    rows = [{"ip": f"1.1.1.{i % 5}", "s": i * 40, "url": "/.git/x" if i % 5 < 2 and i % 3 == 0 else f"/p{i}"} for i in range(200)]
    events = events_of(rows)
    kept = correlate.timeline(events).collect()
    every = correlate.timeline(events, include_benign=True).filter("phase <> 'benign'").collect()
    assert kept == every and {r["ip"] for r in kept} == {"1.1.1.0", "1.1.1.1"}


def test_events_combine_before_the_shuffle(spark):
    plan = correlate.slot_sums(weblog(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan and "partial_bit_or" in plan


def test_time_pivot_is_exact(spark, events_of):
    rng = random.Random(3)
    rows = [{"s": rng.randrange(40000), "ip": f"1.1.1.{i % 9}"} for i in range(500)]
    events = events_of(rows)
    spans = [(1000, 1200), (1300, 1300), (9000, 20000), (20200, 20250), (33333, 33333)]
    base = 1704067200
    findings = spark.createDataFrame([("critical", base + a, base + b) for a, b in spans]
                                     + [("high", base, base + 40000)], "severity string, a long, b long").select(
        "severity", F.timestamp_seconds("a").alias("first_seen"), F.timestamp_seconds("b").alias("last_seen"))
    found = sorted(r["seq"] for r in pivot.pivot_time(events, findings).collect())
    assert found == [i for i, r in enumerate(rows) if any(a - 300 <= r["s"] <= b + 300 for a, b in spans)]


def test_phase_transition(events_of):
    rows = [{"ip": "1.1.1.1", "ua": "nikto", "s": 0, "url": "/found"},
            {"ip": "1.1.1.1", "ua": "nikto", "s": 1, "url": "/missing", "status": 404},
            {"ip": "1.1.1.9", "ua": "Browser", "s": 5000, "url": "/found"},
            {"ip": "1.1.1.8", "ua": "Browser", "s": 5000, "url": "/missing"},
            {"ip": "1.1.2.9", "ua": "Browser", "s": 5000, "url": "/found"},
            {"ip": "1.1.1.7", "ua": "Browser", "s": 0, "url": "/found"}]
    found = pivot.phase_transition(events_of(rows)).collect()
    assert [(r["ip"], r["shared_urls"]) for r in found] == [("1.1.1.9", 1)]
