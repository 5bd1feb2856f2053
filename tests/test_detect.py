import datetime as dt
import statistics

from pyspark.sql import functions as F

from spoor.operators import detect
from spoor.rules import RuleSet

NOW = dt.datetime(2024, 2, 1)


def test_brute_force_window(events_of):
    rows = [{"ip": "1.0.0.1", "s": 300 + i, "status": 401} for i in range(20)]
    rows += [{"ip": "1.0.0.2", "s": 300 + i, "status": 403} for i in range(19)]
    rows += [{"ip": "1.0.0.3", "s": 590 + i, "status": 401} for i in range(20)]
    rows += [{"ip": "1.0.0.1", "s": 9000, "status": 403}]
    found = detect.find_brute_force(events_of(rows), now=NOW).collect()
    assert [(f["source_ip"], f["count"]) for f in found] == [("1.0.0.1", 21)]
    assert found[0]["severity"] == "high" and found[0]["sample"] == "" and found[0]["first_seen"] is None
    assert found[0]["description"].startswith("20 ")


def test_enumeration_threshold_and_cut(events_of):
    rows = [{"ip": "1.0.0.1", "status": 404, "s": i} for i in range(50)]
    rows += [{"ip": "1.0.0.2", "status": 404} for _ in range(49)]
    rows += [{"ip": "1.0.0.10", "status": 404} for _ in range(50)]
    found = detect.find_enum_404(events_of(rows)).collect()
    assert sorted(f["source_ip"] for f in found) == ["1.0.0.1", "1.0.0.10"]
    # The cut comes before the threshold, ties in address order.
    assert [f["source_ip"] for f in detect.find_enum_404(events_of(rows), max_ips=1).collect()] == ["1.0.0.1"]
    assert detect.find_enum_404(events_of(rows), threshold=49, max_ips=None).count() == 3


def test_bytes_outlier(events_of):
    big = 200 * 1024 * 1024

    def found(n, top=big, rest=1):
        rows = [{"ip": f"1.0.0.{i}", "bytes": rest} for i in range(n)] + [{"ip": "2.0.0.1", "bytes": top}]
        return [f["source_ip"] for f in detect.find_exfil_bytes(events_of(rows)).collect()]

    assert found(10) == ["2.0.0.1"]
    assert found(9) == []
    assert found(20, top=10 * 1024 * 1024) == []
    assert found(20, top=10 * 1024 * 1024 + 1) == ["2.0.0.1"]
    assert found(20, top=big, rest=big) == []


def test_rare_clients(events_of):
    rows = [{"ua": f"u{i:02d}"} for i in range(26)] + [{"ua": "a"}] * 5 + [{"ua": ""}, {"ua": "-"}]
    names = {f["sample"] for f in detect.find_rare_ua(events_of(rows)).collect()}
    assert names == {"a", *(f"u{i:02d}" for i in range(26))}
    # "" and "-" sort first and use two of the 25 places.
    cut = detect.find_rare_ua(events_of(rows), candidates=25).collect()
    assert {f["sample"] for f in cut} == {f"u{i:02d}" for i in range(23)}
    five = detect.find_rare_ua(events_of([{"ua": "a"}] * 5 + [{"ua": "b"}] * 6)).collect()
    assert [(f["sample"], f["count"]) for f in five] == [("a", 5)]


def _spikes(events_of, counts):
    rows = [{"s": h * 3600 + i % 3600} for h, n in enumerate(counts) for i in range(n)]
    return [f["count"] for f in detect.find_traffic_spike(events_of(rows)).collect()]


def test_spike_needs_eleven_hours(events_of):
    assert _spikes(events_of, [1] * 9 + [50]) == []
    assert _spikes(events_of, [1] * 10 + [50]) == [50]
    assert _spikes(events_of, [5] * 12) == []
    # Empty hours count as zero.
    assert _spikes(events_of, [1] + [0] * 9 + [50]) == [50]


def test_spike_matches_plain_statistics(events_of):
    counts = [3, 0, 4, 5, 0, 0, 2, 1, 7, 3, 2, 4, 40, 3, 2, 0, 1, 38, 2, 1, 2, 3, 1, 2]
    mean, sigma = statistics.mean(counts), statistics.pstdev(counts)
    expected = sorted(c for c in counts if (c - mean) / sigma > 3)
    assert sorted(_spikes(events_of, counts)) == expected


def test_signature_sample_is_the_earliest_and_falls_back_to_the_client(events_of):
    rows = [{"s": 9, "url": "/.git/late"}, {"s": 1, "url": "/.git/first"},
            {"s": 3, "url": "", "ua": "sqlmap/1"}]
    found = {f["rule"]: f for f in detect.all_findings(events_of(rows), now=NOW).collect()}
    hit = found["sensitive_file"]
    assert (hit["sample"], hit["count"], hit["severity"]) == ("/.git/first", 2, "high")
    assert found["scanner_ua"]["sample"] == "sqlmap/1"
    assert hit["first_seen"] < hit["last_seen"] and hit["created_at"] == NOW


def test_uncapped_counts_equal_tagged_rows(events_of):
    rows = [{"ip": f"1.0.{i % 7}.1", "url": u, "s": i} for i, u in
            enumerate(["/.git/x", "/?a=../", "/ok", "/shell.php", "/.env"] * 20)]
    events = events_of(rows)
    from spoor.functions.text import tag_url
    per_rule = {r["rule"]: r["n"] for r in events.select(F.explode(tag_url(F.col("url"))).alias("rule"))
                .groupBy("rule").agg(F.count("*").alias("n")).collect()}
    found = {r["rule"]: r["n"] for r in detect.find_signatures(events, max_ips=None)
             .groupBy("rule").agg(F.sum("count").alias("n")).collect()}
    assert found == per_rule and len(found) >= 3


def test_cut_per_rule_trims_before_the_shuffle(events_of):
    plan = detect.find_signatures(events_of([{"url": "/.git/"}]), max_ips=20)._jdf.queryExecution().toString()
    assert plan.count("WindowGroupLimit") >= 2


def test_stored_tags_are_used(events_of):
    events = events_of([{"url": "/ok"}]).withColumn("tags", F.array(F.lit("mine")))
    rules = RuleSet.from_rows([("mine", "low", "never", "d")])
    assert [f["rule"] for f in detect.find_signatures(events, rules).collect()] == ["mine"]


def test_empty_case(events_of):
    assert detect.all_findings(events_of([{}]).limit(0)).collect() == []


def test_all_findings_equal_the_single_detectors(events_of):
    rows = [{"ip": f"1.0.0.{i % 12}", "s": i * 7, "bytes": 10 ** 6 if i % 12 == 3 else 10,
             "status": (200, 401, 404, 403, 200)[i % 5], "ua": "rare/1" if i == 9 else "UA"} for i in range(900)]
    rows += [{"ip": "1.0.0.1", "s": 4 * 3600 + i % 60} for i in range(2000)]
    rows += [{"ip": "1.0.0.2", "s": h * 3600} for h in range(40)]
    events = events_of(rows)
    given = {"brute_force": {"threshold": 3, "window_seconds": 700}, "enum_404": {"threshold": 10},
             "exfil_bytes": {"min_bytes": 1000}, "rare_ua": {}, "traffic_spike": {}}
    whole = [r for r in detect.all_findings(events, now=NOW, thresholds=given).collect()]
    single = []
    for name, kw in given.items():
        single += getattr(detect, f"find_{name}")(events, now=NOW, **kw).select(*whole[0].__fields__).collect()
    assert len({r["rule"] for r in single}) == 5
    assert sorted(map(str, whole)) == sorted(map(str, single))


def test_listing_order(events_of):
    rows = [{"ip": "1.0.0.1", "url": "/.git/"}, {"ip": "1.0.0.2", "url": "/shell.php"},
            {"ip": "1.0.0.1", "url": "/.git/"}, {"ip": "1.0.0.3", "url": "/.env"}]
    found = detect.list_findings(detect.find_signatures(events_of(rows), now=NOW)).collect()
    assert [(f["severity"], f["count"]) for f in found] == [("critical", 1), ("high", 2), ("high", 1)]


def test_defaults_lose_no_address(events_of):
    slow = [{"ip": f"10.{i // 250}.{i % 250}.1", "status": 401, "s": 400 * k} for i in range(210) for k in range(6)]
    quick = [{"ip": "9.9.9.1", "status": 401, "s": k} for k in range(5)]
    found = detect.find_brute_force(events_of(slow + quick), threshold=5).collect()
    assert [f["source_ip"] for f in found] == ["9.9.9.1"]
    cut = detect.find_brute_force(events_of(slow + quick), threshold=5, max_ips=1).collect()
    assert [f["source_ip"] for f in cut] == ["9.9.9.1"]
    busy = [{"ip": f"10.{i // 250}.{i % 250}.1", "bytes": 1} for i in range(510) for _ in range(2)]
    large = [{"ip": "9.9.9.2", "bytes": 50 * 1024 ** 3}]
    assert [f["source_ip"] for f in detect.find_exfil_bytes(events_of(busy + large)).collect()] == ["9.9.9.2"]
