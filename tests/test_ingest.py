import bz2
import datetime as dt
import gzip
import zlib

from pyspark.sql import functions as F

from spoor.operators import sketches
from spoor.sources import batches, parse, store, text, w3c
from spoor.session import run_path

GOOD = '203.0.113.7 - - [10/Jul/2026:13:55:36 +0200] "GET /a?b=1 HTTP/1.1" 200 45 "https://x.example/p" "UA 1"'


def _rows(df):
    return df.orderBy("seq").collect()


def test_combined_fields(lines_of):
    row = _rows(parse.parse_combined(lines_of([GOOD])))[0]
    assert row["ts"] == dt.datetime(2026, 7, 10, 11, 55, 36)
    assert (row["ip"], row["method"], row["url"], row["status"], row["bytes"]) == (
        "203.0.113.7", "GET", "/a?b=1", 200, 45)
    assert (row["referrer"], row["ua"], row["domain"], row["raw"]) == (
        "https://x.example/p", "UA 1", "x.example", GOOD)


def test_combined_variants(lines_of):
    lines = [
        "shop.example.com:8080 " + GOOD, "host:80 " + GOOD,
        '2001:db8::1 - bob [1/jul/2026:3:05:06 -0000] "POST /x" 404 -',
        GOOD.replace("GET", "get"), GOOD.replace(" +0200", ""), GOOD.replace("10/Jul", "31/Feb"),
        GOOD.replace(" 200 ", " 20 "), "", "noise", GOOD + " trailing", GOOD.replace("/a?b=1", "")]
    found = {r["seq"]: r for r in parse.parse_combined(lines_of(lines)).collect()}
    assert sorted(found) == [0, 1, 2, 9]
    assert found[0]["domain"] == "shop.example.com" and found[1]["domain"] == "host"
    bare = found[2]
    assert (bare["ip"], bare["bytes"], bare["referrer"], bare["ua"], bare["domain"]) == (
        "2001:db8::1", 0, "", "", "")
    assert bare["ts"] == dt.datetime(2026, 7, 1, 3, 5, 6)


W3C = [
    "2026-07-10 10:00:00 1.1.1.1 GET /early - 200 1",
    "#Software: server",
    "#Fields: date time c-ip cs-method cs-uri-stem cs-uri-query sc-status sc-bytes cs(User-Agent) cs(Referer)",
    "2026-07-10 10:00:01 1.1.1.1 GET /a q=1 200 10 UA+x https://r.example/+",
    "2026-07-10 10:00:02 1.1.1.1 GET /b - abc - UA",
    "",
    "2026-07-10 25:00:02 1.1.1.1 GET /c - 200 5 UA -",
    "#Fields: date time cs-uri-stem c-ip cs-host c-ip",
    "2026-07-10 10:00:03 /d 2.2.2.2 h.example 3.3.3.3 more columns than named",
]


def _check_w3c(rows):
    assert [(r["seq"], r["ip"], r["url"], r["status"], r["bytes"]) for r in rows] == [
        (3, "1.1.1.1", "/a?q=1", 200, 10), (4, "1.1.1.1", "/b", 0, 0), (8, "3.3.3.3", "/d", 0, 0)]
    assert rows[0]["ua"] == "UA x" and rows[0]["referrer"] == "https://r.example/ "
    assert rows[0]["domain"] == "r.example" and rows[2]["domain"] == "h.example"
    assert rows[2]["method"] == "" and rows[2]["ts"] == dt.datetime(2026, 7, 10, 10, 0, 3)


def test_w3c(lines_of):
    _check_w3c(_rows(parse.parse_iis(lines_of(W3C))))


def test_w3c_headers_cross_splits(lines_of):
    """Splits of two lines: most see no directive of their own."""
    _check_w3c(_rows(parse.parse_iis(lines_of(W3C, split=2))))


def test_w3c_many_headers_take_the_other_route(lines_of):
    lines = []
    for i in range(200):
        lines.append("#Fields: date time c-ip" if i % 2 else "#Fields: date time s-ip c-ip")
        lines.append(f"2026-07-10 10:00:00 1.1.1.{i} 2.2.2.{i}")
    frame = lines_of(lines, split=7)
    few = w3c.attach_slots(frame, ["c-ip", "time"], max_per_file=10**6)
    many = w3c.attach_slots(frame, ["c-ip", "time"], max_per_file=3)
    assert sorted(map(str, few.select("seq", "slots").collect())) == \
        sorted(map(str, many.select("seq", "slots").collect()))
    ips = [r["ip"] for r in _rows(parse.parse_iis(frame))]
    assert ips == [f"1.1.1.{i}" if i % 2 else f"2.2.2.{i}" for i in range(200)]


def test_auto_format_per_file(lines_of):
    mixed = (lines_of(W3C[1:], "w3c.log").unionByName(lines_of([GOOD, "#x", GOOD], "c.log"))
             .unionByName(lines_of(W3C, "late.log")))
    formats = {r["src_file"]: r["fmt"] for r in text.detect_format(mixed).collect()}
    assert formats == {"w3c.log": "iis", "c.log": "combined", "late.log": "combined"}
    per_file = {r["src_file"]: r["count"] for r in
                parse.parse_lines(mixed, "auto").groupBy("src_file").count().collect()}
    assert per_file == {"w3c.log": 3, "c.log": 2}


def _mixed_logs(folder):
    folder.mkdir()
    w3c_text, plain = "\n".join(W3C[1:]).encode(), f"{GOOD}\n#x\n{GOOD}\n".encode()
    files = {"plain.log": plain, "w3c.log": w3c_text, "bom é 100%.log": text.BOM + w3c_text, "late #1.log": b"\n" + w3c_text,
             "two files.log.gz": gzip.compress(w3c_text) + gzip.compress(b"\n" + w3c_text), "plain.log.gz": gzip.compress(plain),
             "w3c.log.bz2": bz2.compress(w3c_text), "hash.gz.log": b"#", "_hidden.log": w3c_text, "two.log": text.BOM * 2 + w3c_text}
    for name, body in files.items():
        (folder / name).write_bytes(body)
    return str(folder)


def test_a_changed_file_with_an_escaped_name_counts_once(spark, tmp_path):
    log, path = tmp_path / "a é 1%.log", run_path(spark, "escaped")
    for lines in (1, 3):
        log.write_text(f"{GOOD}\n" * lines)
        assert batches.ingest_new(spark, str(tmp_path), path, 1, "combined")["ok"] == lines
        assert batches.ingest_new(spark, str(tmp_path), path, 1, "combined")["files"] == 0
    assert batches.read_committed(spark, path, 1).count() == 3


def test_formats_from_first_bytes_equal_those_of_all_lines(spark, tmp_path):
    logs = _mixed_logs(tmp_path / "logs")
    heads = sorted(map(tuple, text.file_formats(spark, logs).collect()))
    assert heads == sorted(map(tuple, text.detect_format(text.scan_log_text(spark, logs)).collect())) and len(heads) == 9
    (tmp_path / "logs" / "empty.log").touch()
    assert text.file_formats(spark, logs).count() == 9           # a file without lines has no format, here as there
    one = text.file_formats(spark, [f"{logs}/w3c.log", f"{logs}/plain.log"])
    assert sorted(r.fmt for r in one.collect()) == ["combined", "iis"]
    assert "binaryFile" in (plan := one._jdf.queryExecution().toString()) and "content" not in plan.split("Physical Plan")[1]


def test_ingest_reads_lines_for_the_format_only_if_it_must(spark, tmp_path, monkeypatch):
    logs, scans = _mixed_logs(tmp_path / "logs"), []

    def counted(lines):
        scans.append(1)
        return text.detect_format(lines)
    monkeypatch.setattr(parse, "detect_format", counted)
    counts = store.ingest(spark, logs, run_path(spark, "auto"), 1)
    assert not scans and counts["ok"] > 4
    assert batches.ingest_new(spark, logs, run_path(spark, "auto-new"), 1) == {**counts, "files": 9} and not scans
    (tmp_path / "logs" / "old.log.deflate").write_bytes(zlib.compress("\n".join(W3C[1:]).encode()))
    more = store.ingest(spark, logs, run_path(spark, "auto-deflate"), 1)
    assert scans == [1] and more["ok"] == counts["ok"] + 3
    whole = parse.parse_lines(text.scan_log_text(spark, logs), keep_unparsed=True)
    assert parse.validate_event(whole).filter("verdict = 'ok'").count() == more["ok"]


def test_files_keep_line_order(spark, tmp_path):
    path = tmp_path / "big.log"
    path.write_bytes(b"".join(b"line %06d \xff\n" % i for i in range(20000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        lines = text.scan_log_text(spark, str(path))
        assert lines.rdd.getNumPartitions() > 1
        ordered = [r["line"] for r in lines.orderBy("src_file", "block_start", "seq").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert ordered == [f"line {i:06d} �" for i in range(20000)]


def test_store_and_filters(spark, lines_of):
    lines = [GOOD, GOOD.replace("203.0.113.7", "999.1.1.1"),
             GOOD.replace("203.0.113.7", "203.0.113.200").replace("/a?b=1", "/.env"),
             GOOD.replace(" 45 ", " 99999999999999999999 ")]
    path = run_path(spark, "store")
    parsed = parse.parse_combined(lines_of(lines))
    counts = parse.ingest_counts(parse.validate_event(parsed)).first()
    assert (counts["ok"], counts["failed"]) == (2, 2)
    store.write_events(parsed, path, 7)
    store.write_events(parsed, path, 8)
    case = store.read_case(spark, path, 7)
    assert case.count() == 2
    assert {r["verdict"] for r in store.read_rejected(spark, path, 7).collect()} == {"bad_ip", "bad_bytes"}
    assert store.filter_ip(case, "203.0.113.0/25").count() == 1
    assert store.filter_ip(case, "203.0.113.200").first()["tags"] == ["sensitive_file"]
    plan = store.filter_ip(case, "203.0.113.0/25")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(case_id" in plan and "GreaterThanOrEqual(ip_key" in plan


def test_nested_view(lines_of):
    nested = parse.nested_view(parse.parse_combined(lines_of([GOOD])))
    assert nested.select("http.response.status_code").first()[0] == 200
    assert nested.select(F.col("source.ip")).first()[0] == "203.0.113.7"


def test_ingest_counts_and_keeps_what_does_not_parse(spark, tmp_path):
    good = '%s - - [01/Jan/2024:00:00:00 +0000] "GET /a HTTP/1.1" 404 5 "-" "ua"'
    long = good.replace("/a", "/" + "b" * 9000 + "?q=union+select+1") % "9.9.9.9"
    text = [good % "2001:DB8::1", good % "2001:db8:0:0::1", "garbage here", "", good % "999.1.1.1",
            (good % "9.9.9.9").replace("[01", "[32"), long]
    (tmp_path / "a.log").write_text("\n".join(text) + "\n")
    (tmp_path / "b.log").write_text("#Fields: date time c-ip cs-uri-stem sc-status\n2024-01-01 00:00:00 8.8.8.8 /x 200\n"
                                    "#Fields:\n2024-01-01 00:00:00 8.8.8.8 /y 200\n")
    path = str(tmp_path / "events")
    counts = store.ingest(spark, str(tmp_path / "*.log"), path, 1)
    assert counts == {"ok": 4, "failed": 1, "unparsed": 3}
    events = store.read_case(spark, path, 1)
    assert sorted(r.ip for r in events.collect()) == ["2001:db8::1", "2001:db8::1", "8.8.8.8", "9.9.9.9"]
    assert store.filter_ip(events, "2001:0DB8:0::1").count() == 2
    assert events.filter("length(url) > 9000 and array_contains(tags, 'sqli')").count() == 1
    lost = store.read_rejected(spark, path, 1).filter("verdict = 'unparsed'")
    assert {"garbage here", text[5]} <= {r.raw for r in lost.collect()}


def test_one_spelling_for_each_address(spark):
    from pyspark.sql import functions as F

    from spoor.functions.ip import canonical_ip
    cases = {"::": "::", "::1": "::1", "1::": "1::", "2001:0db8:0:0:1:0:0:1": "2001:db8::1:0:0:1", "::ffff:1.2.3.4": "1.2.3.4",
             "1:0:2:0:3:0:4:0": "1:0:2:0:3:0:4:0", "0:0:1:0:0:0:0:2": "0:0:1::2", "8.8.8.8": "8.8.8.8", "x:y": "x:y"}
    rows = spark.createDataFrame([(k,) for k in cases], "ip string").select("ip", canonical_ip(F.col("ip")).alias("c")).collect()
    assert {r.ip: r.c for r in rows} == cases


# --- clustered store, batches, sketches ------------------------------------------------------

def _scanned(df):
    """Rows that the file scan handed on, after row groups were left out by their bounds."""
    df._jdf.queryExecution().toRdd().count()
    def find(plan):
        if "Scan parquet" in plan.nodeName():
            return plan.metrics().apply("numOutputRows").value()
        return max((find(plan.children().apply(i)) for i in range(plan.children().size())), default=0)
    return find(df._jdf.queryExecution().executedPlan())


def test_a_block_of_addresses_is_found_by_bounds(spark, events_of, tmp_path):
    rows = [{"ip": f"10.{n % 40}.{n % 7}.{n % 200}", "s": n * 80} for n in range(8000)]
    path = str(tmp_path / "events")
    spark.conf.set("spark.sql.shuffle.partitions", "128")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        store.write_events(events_of(rows), path, 1)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        case = store.read_case(spark, path, 1)
        block = store.filter_ip(case, "10.3.3.0/24")
        files = case.select(F.col("_metadata.file_path")).distinct().count()
        held = block.select(F.col("_metadata.file_path")).distinct().count()
        assert block.count() == sum(r["ip"].startswith("10.3.3.") for r in rows) > 0
        assert held * 10 < files and _scanned(block.select("ip", "ip_key")) * 10 < len(rows)
        day = store.filter_time(case, "2024-01-03 00:00:00", "2024-01-03 11:00:00").select("ts")
        assert 0 < day.count() and _scanned(day) <= 1081
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def _logs(folder, name, n, tail=""):
    (folder / name).write_text("".join(GOOD.replace("203.0.113.7", f"203.0.113.{k % 9}") + tail + "\n" for k in range(n)))


def test_ingest_twice_takes_files_once(spark, tmp_path):
    logs, path = tmp_path / "logs", str(tmp_path / "events")
    logs.mkdir()
    _logs(logs, "a.log", 20)
    _logs(logs, "b.log", 30)
    first = batches.ingest_new(spark, str(logs), path, 1)
    assert first == {"ok": 50, "failed": 0, "unparsed": 0, "files": 2}
    assert batches.ingest_new(spark, str(logs), path, 1)["files"] == 0
    assert batches.read_committed(spark, path, 1).count() == 50
    _logs(logs, "c.log", 5)
    assert batches.ingest_new(spark, str(logs), path, 1)["files"] == 1
    assert batches.ingest_new(spark, str(logs), path, 2)["ok"] == 55
    assert (batches.read_committed(spark, path, 1).count(), batches.read_committed(spark, path).count()) == (55, 110)


def test_a_batch_without_commit_leaves_no_row(spark, tmp_path, monkeypatch):
    logs, path = tmp_path / "logs", str(tmp_path / "events")
    logs.mkdir()
    _logs(logs, "a.log", 20)
    written = store.write_events(parse.parse_lines(text.scan_log_text(spark, str(logs)), "combined", keep_unparsed=True),
                                 f"{path}/batch=died", 1)
    assert written["ok"] == 20
    assert batches.ingest_new(spark, str(logs), path, 1)["ok"] == 20
    assert batches.read_committed(spark, path, 1).count() == 20


def test_a_changed_file_replaces_its_rows(spark, tmp_path):
    logs, path = tmp_path / "logs", str(tmp_path / "events")
    logs.mkdir()
    _logs(logs, "a.log", 20)
    _logs(logs, "b.log", 3)
    batches.ingest_new(spark, str(logs), path, 1)
    _logs(logs, "a.log", 25, " more")
    assert batches.ingest_new(spark, str(logs), path, 1)["ok"] == 25
    assert batches.read_committed(spark, path, 1).count() == 28


def test_a_stream_takes_each_file_once(spark, tmp_path):
    logs, path, mark = tmp_path / "logs", str(tmp_path / "events"), str(tmp_path / "mark")
    logs.mkdir()
    _logs(logs, "a.log", 20)
    batches.stream_batches(spark, str(logs), path, 1, mark).awaitTermination()
    _logs(logs, "b.log", 7)
    batches.stream_batches(spark, str(logs), path, 1, mark).awaitTermination()
    assert batches.read_committed(spark, path, 1).count() == 27
    assert batches.ingest_new(spark, str(logs), path, 1)["files"] == 0


def test_sketches_answer_for_days(spark, events_of, tmp_path):
    rows = [{"ip": f"10.0.{n % 90}.{n % 50}", "url": f"/p{n}", "s": n * 60, "bytes": n} for n in range(6000)]
    path = str(tmp_path / "sketches")
    sketches.write_sketches(events_of(rows), path, 4)
    whole = sketches.sketched_summary(spark, path, 4).first()
    assert whole.total_events == 6000 and whole.total_bytes == sum(range(6000))
    assert abs(whole.unique_urls - 6000) < 120 and abs(whole.unique_ips - 450) < 9
    day = sketches.sketched_summary(spark, path, 4, "2024-01-02", "2024-01-02").first()
    assert day.total_events == 1440 and abs(day.unique_urls - 1440) < 29
    top = sketches.sketched_top(spark, path, 4, "ip", 3, start="2024-01-02").collect()
    assert len(top) == 3 and all(r["count"] in (10, 11) for r in top)
    assert sketches.sketched_summary(spark, path, 5).first().total_events == 0
    assert sketches.sketched_top(spark, path, 4, "ip", 3, start="2025-01-01").count() == 0
