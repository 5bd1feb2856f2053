"""Intervals, hours, parameters, opened paths, networks and nearest findings on small, exact cases."""
import ipaddress
import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from spoor.operators import indicators, networks, openings, pivot, rhythm


# --- intervals ------------------------------------------------------------------------

@pytest.mark.parametrize("slot", [300, 7])
def test_intervals_equal_sorted_gaps(events_of, slot):
    rng = random.Random(4)
    times = {ip: sorted(rng.choice([rng.randint(0, 4000), rng.random() * 900]) for _ in range(n))
             for ip, n in (("1.1.1.1", 60), ("1.1.1.2", 3), ("1.1.1.3", 2))}
    times["1.1.1.4"] = [60 * k for k in range(40)]
    times["1.1.1.5"] = [5] * 30
    rows = [{"ip": ip, "s": round(t, 3)} for ip, of in times.items() for t in of]
    rng.shuffle(rows)
    found = {r.ip: r for r in rhythm.interval_profile(events_of(rows), slot).collect()}
    assert set(found) == {"1.1.1.1", "1.1.1.2", "1.1.1.4", "1.1.1.5"}
    for ip, r in found.items():
        of = [round(t, 3) for t in times[ip]]
        gaps = [b - a for a, b in zip(of, of[1:])]
        assert r.requests == len(of) and math.isclose(r.mean_gap, statistics.mean(gaps), abs_tol=2e-6)
        if sum(gaps):
            assert math.isclose(r.variation, statistics.pstdev(gaps) / statistics.mean(gaps), abs_tol=2e-6)
    assert found["1.1.1.4"].variation == 0 and found["1.1.1.5"].variation is None


def test_beacon_limits(events_of):
    even = [{"ip": "1.1.1.1", "s": 60 * k} for k in range(20)]
    few = [{"ip": "1.1.1.2", "s": 60 * k} for k in range(19)]
    wild = [{"ip": "1.1.1.3", "s": k * k * 7} for k in range(40)]
    found = rhythm.find_beacons(events_of(even + few + wild)).collect()
    assert [(r.source_ip, r["count"], r.rule) for r in found] == [("1.1.1.1", 20, "beacon")]
    assert rhythm.find_beacons(events_of([{"s": 1}])).count() == 0


def test_a_hot_address_is_summed_in_many_tasks(spark, events_of):
    """Nothing but sums of slots is ordered by address."""
    rows = events_of([{"ip": "1.1.1.1" if k % 3 == 0 else f"2.2.{k % 50}.{k % 7}", "s": k * 11} for k in range(6000)])
    sums = rhythm.interval_sums(rows).groupBy("ip").count()
    assert sums.filter("ip = '1.1.1.1'").first()["count"] > 200
    assert rhythm.interval_profile(rows).filter("ip = '1.1.1.1'").first().requests == 2000


def test_hours_of_the_day(events_of):
    day = [{"ip": f"1.1.1.{k % 5}", "s": 3600 * (k % 24)} for k in range(480)]
    night = [{"ip": "9.9.9.1", "s": 3600 * 3 + k} for k in range(96)] + [{"ip": "9.9.9.2", "s": 3600 * 3}]
    found = {r.ip: r for r in rhythm.hour_profile(events_of(day + night)).collect()}
    assert found["9.9.9.1"].busiest_hour == 3 and found["9.9.9.1"].distance > 0.5
    assert found["9.9.9.2"].distance < 0.05 and found["1.1.1.0"].distance < found["9.9.9.1"].distance
    assert [r.source_ip for r in rhythm.find_odd_hours(events_of(day + night)).collect()] == ["9.9.9.1"]


def test_entropy_of_parameters(events_of):
    urls = [f"/p?id={k}&t=abab" for k in range(30)] + ["/p?id=k9X2mQ7zL0vB4nR8sT6w", "/q?empty=&flag", "/plain", "/x?a=b=c"]
    rows = events_of([{"url": u, "s": i} for i, u in enumerate(urls)])
    found = {(r.name, r.value): r for r in rhythm.parameter_entropy(rows).collect()}
    assert found["t", "abab"].entropy == 1.0 and found["t", "abab"].requests == 30 and ("a", "b=c") in found
    assert found["id", "k9X2mQ7zL0vB4nR8sT6w"].entropy == round(math.log2(20), 6)
    assert not any(name in ("empty", "flag") for name, _ in found)
    dense = rhythm.find_dense_parameters(rows, 2.0)
    assert [(r.name, r.value) for r in dense.collect()] == [("id", "k9X2mQ7zL0vB4nR8sT6w")]
    plan = dense._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan
    assert rhythm.find_dense_parameters(events_of([{"url": "/plain"}])).count() == 0


# --- openings --------------------------------------------------------------------------

def test_a_path_opens_with_its_first_answer_after_the_last_miss(events_of):
    rows = events_of([
        {"url": "/u/x.php", "status": 404, "s": 0, "ip": "1.1.1.1"}, {"url": "/u/x.php?a=1", "status": 404, "s": 5, "ip": "2.2.2.2"},
        {"url": "/u/x.php", "status": 200, "s": 3}, {"url": "/u/x.php", "status": 500, "s": 6},
        {"url": "/u/x.php?c=id", "status": 200, "s": 9, "ip": "3.3.3.3", "method": "POST"},
        {"url": "/u/x.php", "status": 200, "s": 9, "ip": "4.4.4.4"}, {"url": "/u/x.php", "status": 201, "s": 20, "method": "POST"},
        {"url": "/gone", "status": 200, "s": 1}, {"url": "/gone", "status": 404, "s": 2}, {"url": "/fine", "status": 200, "s": 1},
        {"url": "/same", "status": 404, "s": 4}, {"url": "/same", "status": 200, "s": 4}])
    found = openings.path_openings(rows)
    r = found.collect()
    assert [(x.path, x.misses, x.opened_by, x.opened_with, x.hits, x.posts) for x in r] == [
        ("/u/x.php", 2, "3.3.3.3", "POST", 3, 2)]
    before = openings.touched_before_opening(rows, found).collect()
    assert sorted((x.ip, x["count"]) for x in before) == [("1.1.1.1", 1), ("2.2.2.2", 1), ("9.9.9.9", 2)]


# --- networks --------------------------------------------------------------------------

def test_longest_of_many_nested_networks(spark):
    rng = random.Random(6)
    nets = {}
    for k in range(100_000):
        if k % 5:
            size, number = rng.randint(6, 32), rng.getrandbits(32)
            number = number if k % 2 else (203 << 24) + rng.getrandbits(20)
            nets[f"{ipaddress.IPv4Address(number)}/{size}"] = f"o{k}"
        else:
            size, number = rng.randint(16, 128), (0x20010DB8 << 96) + rng.getrandbits(24 if k % 2 else 90)
            nets[f"{ipaddress.IPv6Address(number)}/{size}"] = f"o{k}"
    nets["8.8.8.8"], nets["bad/99"], nets["1.2.3.4/40"], nets["::ffff:9.0.0.0/104"] = "one", "x", "y", "mapped"
    table = spark.createDataFrame(list(nets.items()), "network string, owner string")
    ips = [str(ipaddress.IPv4Address((203 << 24) + rng.getrandbits(20))) for _ in range(40)] + ["8.8.8.8", "9.1.2.3", "no address", None]
    ips += [str(ipaddress.IPv6Address((0x20010DB8 << 96) + rng.getrandbits(24))) for _ in range(20)]
    parsed = []
    for text, owner in nets.items():
        try:
            net = ipaddress.ip_network(text, strict=False)
        except ValueError:
            continue
        size = net.prefixlen + (96 if net.version == 4 else 0)
        parsed.append((size, (int(net[0]) + (0xFFFF << 32 if net.version == 4 else 0)) >> (128 - size), text, owner))
    best = {}
    for ip in ips[:-22] + ips[-20:] + ["8.8.8.8", "9.1.2.3"]:
        number = int(ipaddress.ip_address(ip)) + (0xFFFF << 32 if "." in ip else 0)
        inside = [(-size, text, owner) for size, head, text, owner in parsed if number >> (128 - size) == head]
        if inside:
            best[ip] = min(inside)[1:]
    addresses = spark.createDataFrame([(i,) for i in ips], "ip string")
    found = networks.longest_networks(addresses, table)
    assert {r.ip: (r.network, r.owner) for r in found.collect()} == best and len(best) > 30
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "HashJoin" in plan or "SortMergeJoin" in plan


def test_networks_of_nothing(spark, events_of):
    none = spark.createDataFrame([], "network string, owner string")
    events = events_of([{"ip": "8.8.8.8"}])
    assert networks.longest_networks(events, none).count() == 0
    assert networks.tag_networks(events, none).select("ip", "owner").collect()[0].owner is None
    assert networks.events_in_networks(events, none).count() == 0


# --- findings around an event --------------------------------------------------------------

def test_nearest_findings(spark, events_of):
    events = events_of([{"s": s, "url": f"/{s}"} for s in (0, 40, 100, 161, 500)])
    first = events.select(F.min("ts")).first()[0]
    found = spark.createDataFrame([("webshell", "critical", "6.6.6.6", 100, 300), ("rce", "critical", "5.5.5.5", 100, None),
                                   ("xss", "medium", "1.1.1.1", 40, 40)], "rule string, severity string, source_ip string, a int, b int")
    found = found.select("rule", "severity", "source_ip", *[(F.lit(first) + F.make_dt_interval(secs=F.col(c))).alias(n)
                                                            for c, n in (("a", "first_seen"), ("b", "last_seen"))])
    near = pivot.nearest_findings(events, found, 60).collect()
    assert sorted((r.url, r.side, r.seconds, r.rule) for r in near) == [
        ("/100", "after", 0, "rce"), ("/100", "before", 0, "rce"), ("/40", "after", 60, "rce")]
    assert pivot.nearest_findings(events, found.limit(0)).count() == 0


# --- indicators --------------------------------------------------------------------------------

def test_many_indicators_equal_a_plain_search(spark, events_of):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdeXY/%é") for _ in range(rng.randint(1, 12))) for _ in range(200_000)]
    urls = ["/" + "".join(rng.choice("abcdexy/%É") for _ in range(rng.randint(0, 18))) for _ in range(120)] + ["", "/Shell.PHP?x=1"]
    words += ["shell.php", "SHELL.PHP", " ", "", None, "/"]
    events = events_of([{"url": u, "s": i} for i, u in enumerate(urls)])
    table = spark.createDataFrame([(w, 1) for w in words], "indicator string, url int")
    found = indicators.match_indicators(events, table)

    def fold(text):
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    folded = {}
    for w in words:
        if w and w.strip():
            folded[fold(w)] = min(folded.get(fold(w), w), w)
    want = {(u, name) for u in set(urls) for f, name in folded.items() if f in fold(u)}
    assert {(r.url, r.indicator) for r in found.collect()} == want and ("/Shell.PHP?x=1", "SHELL.PHP") in want
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "Python" not in plan
    assert indicators.match_indicators(events, table.limit(0)).count() == 0
