import ipaddress
import random

from pyspark.sql import functions as F

from spoor.functions import rank
from spoor.functions.ip import (GLOBAL_EXCEPTIONS, NON_GLOBAL, cidr_bounds, ip_hex, ip_key,
                                is_non_global_ip, subnet24)
from spoor.functions.logtime import has_tz_offset, parse_ts_kind
from spoor.functions.text import classify_phase
from spoor.operators.describe import classify_status

ODD = ["1.2.3.4", "256.1.1.1", "01.2.3.4", "::", "::1", "1::", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7::",
       "1:2:3:4:5:6:7:8::", ":::", "1:::2", "::ffff:1.2.3.4", "::ffff:100.64.0.1", "1:2:3:4:5:6:1.2.3.4",
       "12345::", "", "-", "abc", "fe80::1%eth0", "192.0.0.9", "192.0.0.8", "100.64.0.1", "224.0.0.1",
       "1.2.3", "1.2.3.4.5", "::1.2.3.4", "dead", "g::1", ":1", "1:"]


def _reference(text):
    try:
        address = ipaddress.ip_address(text)
    except ValueError:
        return None, None
    digits = address.packed.hex()
    return ("0" * 20 + "ffff" + digits if address.version == 4 else digits), not address.is_global


def test_addresses_agree_with_the_standard_library(spark):
    rng = random.Random(1)
    texts = list(ODD)
    for _ in range(400):
        texts.append(str(ipaddress.IPv4Address(rng.getrandbits(32))))
        texts.append(str(ipaddress.IPv6Address(rng.getrandbits(128) & rng.getrandbits(128))))
    for block in NON_GLOBAL + GLOBAL_EXCEPTIONS:
        net = ipaddress.ip_network(block)
        for value in (int(net[0]) - 1, int(net[0]), int(net[-1]), int(net[-1]) + 1):
            if 0 <= value < 2 ** net.max_prefixlen:
                texts.append(str(type(net[0])(value)))
    rows = spark.createDataFrame([(t,) for t in texts], "ip string").select(
        "ip", ip_hex(F.col("ip")).alias("h"), is_non_global_ip(F.col("ip")).alias("n")).collect()
    assert [(r["ip"], r["h"], r["n"]) for r in rows if (r["h"], r["n"]) != _reference(r["ip"])] == []


def test_keys_and_blocks(spark):
    lo, hi = cidr_bounds("10.1.2.0/24")
    row = spark.createDataFrame([("10.1.2.77", "10.1.3.0", "9.255.255.255")], "a string, b string, c string").select(
        ip_key(F.col("a")).between(F.lit(lo), F.lit(hi)).alias("in"),
        ip_key(F.col("b")).between(F.lit(lo), F.lit(hi)).alias("out"),
        (ip_key(F.col("c")) < ip_key(F.col("a"))).alias("numeric"),
        subnet24(F.col("a")).alias("net")).first()
    assert (row["in"], row["out"], row["numeric"], row["net"]) == (True, False, True, "10.1.2.0/24")


def test_top_n_limits():
    assert [rank.clamp_top_n(n) for n in (20, 0, 99999, "bad", None)] == [20, 1, 1000, 20, 20]


def test_shares(spark):
    def rows(*counts):
        return spark.createDataFrame([(str(i), c) for i, c in enumerate(counts)], "label string, count long")
    shown = rank.with_pct(rows(80, 20)).orderBy("label").collect()
    assert [(r["pct"], r["share"]) for r in shown] == [(100.0, 80.0), (25.0, 20.0)]
    assert rank.with_pct(rows(0, 0)).first()["share"] == 0.0
    assert rank.with_pct(rows()).collect() == []
    # 1 of 16 is 6.25: half goes to the even digit.
    assert rank.with_pct(rows(1, 15)).orderBy("label").first()["share"] == 6.2


def test_status_classes_always_four(spark):
    codes = spark.createDataFrame([(200, 70), (301, 10), (404, 15), (500, 4), (0, 1)], "label int, count long")
    found = {r["cls"]: (r["count"], r["share"]) for r in classify_status(codes).collect()}
    assert found == {"success": (70, 70.0), "redirect": (10, 10.0), "client_error": (15, 15.0),
                     "server_error": (4, 4.0)}
    assert [r["count"] for r in classify_status(codes.limit(0)).collect()] == [0, 0, 0, 0]


def test_phase_boundaries(spark):
    mb10 = 10 * 1024 * 1024
    cases = [((["webshell"], mb10, 1, 0, True), "post-exploitation"), (([], mb10, 1, 0, False), "exfiltration"),
             (([], mb10 - 1, 1, 0, False), "benign"), ((["sqli"], 0, 1, 0, True), "exploitation"),
             (([], 0, 1, 0, True), "recon"), (([], 0, 20, 11, False), "recon"),
             (([], 0, 20, 10, False), "benign"), (([], 0, 19, 19, False), "benign"),
             ((["null_byte"], 0, 1, 0, False), "recon")]
    rows = spark.createDataFrame([c for c, _ in cases], "t array<string>, b long, n long, m long, s boolean")
    found = [r[0] for r in rows.select(classify_phase(*[F.col(c) for c in "tbnms"])).collect()]
    assert found == [p for _, p in cases]


def test_times(spark):
    raw = ["10/Jul/2026:13:55:36 +0000", "10/Jul/2026:13:55:36", "10/Jul/2026:13:55:36.123",
           "2026-07-10T13:55:36Z", "1720619736.5", "nan", "junk"]
    frame = spark.createDataFrame([(r,) for r in raw], "r string")
    got = [[v is not None for v in r] for r in frame.select(
        *[parse_ts_kind(k, F.col("r")) for k in ("clf", "iso", "epoch")]).collect()]
    assert got == [[True, False, False], [True, False, False], [True, False, False],
                   [False, True, False], [False, False, True], [False] * 3, [False] * 3]
    assert [r[0] for r in frame.select(has_tz_offset(F.col("r"))).collect()] == [
        True, False, False, True, False, False, False]
