"""Every operator as a query over the test tables."""

from __future__ import annotations

import datetime as dt
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spoor import rules as R
from spoor.functions import rank, text
from spoor.functions.ip import is_non_global_ip
from spoor.functions.logtime import has_tz_offset, parse_ts_kind
from spoor.operators import (catalogue, correlate, describe, detect, enrich, indicators, networks, openings, pivot, profile,
                             rhythm, sketches)
from spoor.operators.tokenize import tokenize
from spoor.schema import REPUTATION_SCHEMA
from spoor.session import configure, match, run_path, stage
from spoor.sinks import write
from spoor.sources import batches, parse, store
from spoor.sources import text as source_text
from spoor.sources.weblog import as_lines, combined_lines, w3c_lines, weblog
from spoor.streaming import windows

NOW = dt.datetime(2024, 1, 3)
QUERIES: dict = {}
# Limits chosen so that each query keeps some rows and drops some.
BRUTE, ENUM, EXFIL, TOP = 5, 20, 1048576, 10
THRESHOLDS = {"brute_force": {"threshold": BRUTE}, "enum_404": {"threshold": ENUM},
              "exfil_bytes": {"min_bytes": EXFIL}}
LEAD_IP = "203.0.113.7"


def plain(df: DataFrame) -> DataFrame:
    """Types both engines share: whole numbers as bigint, times without a zone,
    string arrays as one text."""
    def fix(name, kind):
        column = F.col(f"`{name}`")
        if kind == "timestamp":
            return column.cast("timestamp_ntz").alias(name)
        if kind in ("int", "smallint", "tinyint"):
            return column.cast("bigint").alias(name)
        if kind == "array<string>":
            return F.array_join(column, ",").alias(name)
        return column

    return df.select(*[fix(n, k) for n, k in df.dtypes])


def query(name: str):
    def register(build):
        @wraps(build)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            configure(spark)
            return plain(build(spark, weblog(spark, sf_dir)))
        QUERIES[name] = run
        return build
    return register


def _simple(name: str, build):
    query(name)(lambda spark, log: build(log))


# --- sources and ingest ------------------------------------------------------

@query("scan_log_text")
def _(spark, log):
    path = run_path(spark, "log-text")
    combined_lines(log).select("line").write.text(path)
    return source_text.scan_log_text(spark, path).select("line")


@query("detect_format")
def _(spark, log):
    plain_files = combined_lines(log).withColumn("src_file", F.concat(F.lit("c-"), "src_file"))
    return source_text.detect_format(w3c_lines(log).unionByName(plain_files))


_simple("parse_combined", lambda log: parse.parse_combined(combined_lines(log)).drop("block_start"))
_simple("domain_of", lambda log: parse.parse_combined(combined_lines(log))
        .groupBy("domain").agg(F.count("*").alias("n")))
_simple("parse_iis", lambda log: parse.parse_iis(w3c_lines(log)).drop("block_start"))


@query("normalise_event")
def _(spark, log):
    n = F.col("seq")
    wide = log.select("seq", F.concat("url", F.repeat(F.lit("x"), (n % 100 * 60).cast("int"))).alias("url"),
                      F.concat("domain", F.repeat(F.lit("d"), (n % 30 * 10).cast("int"))).alias("domain"),
                      F.concat("ua", F.repeat(F.lit("u"), (n % 40 * 30).cast("int"))).alias("ua"),
                      F.concat("raw", F.repeat(F.lit("r"), (n % 90 * 100).cast("int"))).alias("raw"))
    cut = parse.normalise_event(wide)
    return cut.select("seq", *[F.length(c).alias(f"{c}_len") for c in ("url", "domain", "ua", "raw")],
                      F.left("url", F.lit(40)).alias("url_head"))


_simple("validate_event", lambda log: parse.validate_event(parse.parse_combined(combined_lines(log)))
        .groupBy("verdict").agg(F.count("*").alias("n")))


def _store_two_cases(spark, log):
    path = run_path(spark, "events")
    parsed = parse.parse_combined(combined_lines(log))
    store.write_events(parsed, path, 1)
    store.write_events(parsed.withColumn("bytes", F.col("bytes") + 1), path, 2)
    return path


@query("write_events")
def _(spark, log):
    stored = spark.read.parquet(_store_two_cases(spark, log))
    return stored.groupBy("case_id", "verdict").agg(
        F.count("*").alias("n"), F.sum("bytes").alias("bytes"),
        F.count_if(F.size("tags") > 0).alias("tagged"))


@query("read_case")
def _(spark, log):
    return (store.read_case(spark, _store_two_cases(spark, log), 2)
            .select("case_id", "seq", "ts", "ip", "url", "status", "bytes", "tags"))


@query("ingest_new")
def _(spark, log):
    """Log files taken twice over, so that only their first turn counts."""
    logs, path = run_path(spark, "log-files"), run_path(spark, "batches")
    combined_lines(log).select("line").write.text(logs)
    for _ in range(2):
        batches.ingest_new(spark, logs, path, 3, "combined")
    return batches.read_committed(spark, path, 3).groupBy("case_id", "method", "status").agg(
        F.count("*").alias("n"), F.sum("bytes").alias("bytes"))


_simple("sample_raw_lines", lambda log: source_text.sample_raw_lines(log, 1000)
        .agg(F.count("*").alias("n")))


# --- filters and scalar projections -------------------------------------------

@query("filter_ip")
def _(spark, log):
    one = store.filter_ip(log, LEAD_IP).withColumn("scope", F.lit("ip"))
    block = store.filter_ip(log, "203.0.113.0/28").withColumn("scope", F.lit("cidr"))
    return one.unionByName(block).select("scope", "seq", "ip")


_simple("filter_time", lambda log: store.filter_time(
    log, "2024-01-01 20:00:00", "2024-01-01 20:59:59").select("seq", "ts"))
_simple("filter_status_in", lambda log: store.filter_status_in(log, R.AUTH_FAILURES)
        .select("seq", "status"))
_simple("filter_method_in", lambda log: store.filter_method_in(log, R.UNCOMMON_METHODS)
        .select("seq", "method"))
_simple("drop_blank_terms", lambda log: rank.drop_blank_terms(rank.top_n(log, F.col("ua"), 5)))
_simple("tag_url", lambda log: log.select("seq", text.tag_url(F.col("url")).alias("tags")))
_simple("is_scanner_ua", lambda log: log.select("seq", "ua", text.is_scanner_ua(F.col("ua"))
                                                .alias("scanner")))
_simple("classify_phase", lambda log: correlate.session_phase(correlate.session_rollup(log))
        .groupBy("phase").agg(F.count("*").alias("n"), F.sum("event_count").alias("events")))
_simple("classify_status", lambda log: describe.classify_status(
    log.groupBy(F.col("status").alias("label")).agg(F.count("*").alias("count"))))
_simple("with_pct", lambda log: rank.with_pct(
    log.groupBy(F.col("status").alias("label")).agg(F.count("*").alias("count"))))
_simple("is_non_global_ip", lambda log: parse.parse_combined(combined_lines(log))
        .groupBy("ip").agg(F.count("*").alias("n"))
        .select("ip", "n", is_non_global_ip(F.col("ip")).alias("non_global")))
_LOGGED = r"\[([^\]]+)\]"
_simple("has_tz_offset", lambda log: combined_lines(log).select(
    "seq", F.regexp_extract("line", _LOGGED, 1).alias("logged")).select(
    "seq", has_tz_offset(F.col("logged")).alias("offset")))


@query("parse_ts_kind")
def _(spark, log):
    logged = combined_lines(log).select("seq", F.regexp_extract("line", _LOGGED, 1).alias("logged"))
    times = logged.join(log.select("seq", "ts"), "seq")
    return times.select(
        "seq", parse_ts_kind("clf", F.col("logged")).alias("clf"),
        parse_ts_kind("epoch", F.unix_seconds("ts").cast("string")).alias("epoch"),
        parse_ts_kind("iso", F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"),
                                      F.lit("Z"))).alias("iso"),
        parse_ts_kind("iis", F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("iis"))


_simple("is_populated", lambda log: log.groupBy(
    text.is_populated(F.col("referrer")).alias("filled")).agg(F.count("*").alias("n")))
_simple("reputation_band", lambda log: log.select("seq", (F.col("seq") * 7 % 101).alias("score"))
        .select("seq", "score", text.reputation_band(F.col("score")).alias("band")))


# --- detection ----------------------------------------------------------------

def _found(df):
    return df.drop("created_at", "description")


_simple("find_signatures", lambda log: _found(detect.find_signatures(log)))
_simple("find_scanner_ua", lambda log: _found(detect.find_scanner_ua(log)))
_simple("find_dangerous_method", lambda log: _found(detect.find_dangerous_method(log)))
_simple("find_brute_force", lambda log: detect.find_brute_force(log, BRUTE, now=NOW))
_simple("find_enum_404", lambda log: detect.find_enum_404(log, ENUM, now=NOW))
_simple("find_enum_404_ratio", lambda log: detect.find_enum_404_ratio(log, 30, 0.05, now=NOW))
_simple("find_exfil_bytes", lambda log: _found(detect.find_exfil_bytes(log, EXFIL)))
_simple("find_rare_ua", lambda log: _found(detect.find_rare_ua(log)))
_simple("find_traffic_spike", lambda log: _found(detect.find_traffic_spike(log)))


def _indicators(log):
    """Paths, ends of paths and names of parameters of the log, one in another case, and many texts that no URL holds."""
    n = F.col("seq")
    return log.select(F.when(n % 5 == 0, F.upper(F.substring_index("url", "?", 1))).when(n % 5 == 1, F.right("url", (n % 9 + 2).cast("int")))
                      .when(n % 5 == 2, F.concat(F.lit("/lab-"), n.cast("string"))).otherwise(F.left("url", (n % 11 + 1).cast("int")))
                      .alias("indicator"))


_simple("match_indicators", lambda log: indicators.match_indicators(log, _indicators(log)))
_simple("find_indicators", lambda log: indicators.find_indicators(log, _indicators(log)))
_simple("interval_profile", rhythm.interval_profile)
_simple("find_beacons", lambda log: _found(rhythm.find_beacons(log, 20, 0.95)))
_simple("hour_profile", rhythm.hour_profile)
_simple("find_odd_hours", lambda log: _found(rhythm.find_odd_hours(log, 0.12)))
_simple("parameter_entropy", rhythm.parameter_entropy)
_simple("find_dense_parameters", lambda log: rhythm.find_dense_parameters(log, 0.5))


def _all(log, case_id=0, now=NOW):
    return detect.all_findings(log, case_id=case_id, now=now, thresholds=THRESHOLDS)


_simple("all_findings", lambda log: _found(_all(log)))
_simple("findings_by_severity", lambda log: detect.findings_by_severity(_all(log)))
_simple("list_findings", lambda log: _found(detect.list_findings(_all(log), 100)))


@query("case_rollup")
def _(spark, log):
    cases = log.withColumn("case_id", (F.col("seq") % 3).cast("int"))
    found = _all(log, 2).unionByName(_all(log, 9))
    return detect.case_rollup(cases, found)


# --- sessions, phases, chains -------------------------------------------------

_simple("event_order", lambda log: correlate.event_order(log).select("ts", "seq", "url"))
_simple("sessionize", lambda log: correlate.sessionize(log)
        .select("seq", "session_no", "session_start", "session_end"))
_simple("session_rollup", lambda log: correlate.session_rollup(log))
_simple("session_phase", lambda log: correlate.session_phase(correlate.session_rollup(log))
        .select("ip", "ua", "session_no", "phase"))


@query("session_samples")
def _(spark, log):
    kept = correlate.session_samples(log)
    return kept.select("ip", "ua", "session_no", F.posexplode("sample_events").alias("place", "e")).select(
        "ip", "ua", "session_no", "place", "e.ts", "e.method", "e.url", "e.status", "e.tags")


@query("timeline")
def _(spark, log):
    shown = correlate.timeline(log)
    return shown.withColumn("samples", F.size("sample_events")).drop("sample_events")


_simple("attack_chains", lambda log: correlate.attack_chains(
    correlate.timeline(log, samples=False)))


@query("pivot_ip")
def _(spark, log):
    cases = log.withColumn("case_id", (F.col("seq") % 3).cast("int"))
    found = _all(log, 2).unionByName(_all(log, 9))
    return pivot.pivot_ip(cases, correlate.timeline(log, include_benign=True, samples=False), found, LEAD_IP)


_simple("pivot_ua", lambda log: pivot.pivot_ua(log))
_simple("shared_clients", lambda log: pivot.shared_clients(log))
_simple("pivot_url", lambda log: pivot.pivot_url(log, "/img/c99.php")
        .drop("src_file", "block_start"))


@query("pivot_time")
def _(spark, log):
    # Short-lived critical findings: the burst hour of the one hot address.
    critical = detect.find_brute_force(log, BRUTE).select("source_ip")
    spans = log.join(critical.withColumnRenamed("source_ip", "ip"), "ip", "left_semi").filter(
        F.col("status").isin(*R.AUTH_FAILURES)).select(
        F.lit("critical").alias("severity"), F.col("ts").alias("first_seen"),
        F.col("ts").alias("last_seen"))
    return pivot.pivot_time(log, spans, 60).select("seq", "window_start", "window_end")




@query("nearest_findings")
def _(spark, log):
    found = pivot.nearest_findings(log, detect.find_signatures(log), 60)
    return found.select("seq", "side", "moment", "seconds", "rule", "source_ip")


_simple("path_openings", openings.path_openings)
_simple("touched_before_opening", lambda log: openings.touched_before_opening(log, openings.path_openings(log)))


def _networks(log):
    """A network a log row, of 8 to 32 bits, many inside each other and some around the log's addresses."""
    n = F.col("seq")
    text = F.col("seq").cast("string")

    def octet(k):
        return (n * k % 256).cast("string")
    address = (F.when(n % 4 == 0, F.concat(F.lit("203.0.113."), octet(1)))
               .when(n % 4 == 1, F.concat_ws(".", F.lit("8.8"), (n % 8).cast("string"), octet(1)))
               .when(n % 4 == 2, F.concat_ws(".", F.lit("198.51"), (n % 128).cast("string"), octet(3)))
               .otherwise(F.concat_ws(".", octet(7), octet(1), octet(3), octet(5))))
    return log.select(F.concat(address, F.lit("/"), (8 + n % 25).cast("string")).alias("network"),
                      F.concat(F.lit("owner-"), text).alias("owner"))


_simple("longest_networks", lambda log: networks.longest_networks(log, _networks(log)))
_simple("tag_networks", lambda log: networks.tag_networks(log, _networks(log)).groupBy("network", "owner").agg(
    F.count("*").alias("requests")))
_simple("events_in_networks", lambda log: networks.events_in_networks(
    log, _networks(log).filter("network like '%/31' or network like '%/30'")).select("seq", "ip"))
_simple("pivot_referrer", lambda log: pivot.pivot_referrer(log))
_simple("phase_transition", lambda log: pivot.phase_transition(log))


# --- streams ------------------------------------------------------------------

@query("stream_session_phase")
def _(spark, log):
    """The log as a stream in two runs of one query: the second goes on from the first one's checkpoint.

    A last event, days later, closes all sessions; its own stays open.
    """
    source, out, mark = (run_path(spark, f"stream-{n}") for n in ("source", "sessions", "mark"))
    rows = log.select("ts", "ip", "ua", "url", "status", "bytes")

    def run():
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 4).parquet(source)
        windows.write_sessions(stream, out, mark, "3 days").awaitTermination()
    rows.filter("ts < '2024-01-01 18:00:00'").write.mode("append").parquet(source)
    run()
    rows.filter("ts >= '2024-01-01 18:00:00'").write.mode("append").parquet(source)
    end = rows.agg(*[F.max(c).alias(c) for c in rows.columns]).withColumn("ts", F.col("ts") + F.expr("interval 9 days"))
    end.write.mode("append").parquet(source)
    run()
    return spark.read.parquet(out).drop("scanner_ua")


# --- statistics ---------------------------------------------------------------

_simple("stats_summary", describe.stats_summary)


def _sketched(spark, log):
    path = run_path(spark, "sketches")
    sketches.write_sketches(log, path, 1)
    return path


@query("sketched_summary")
def _(spark, log):
    """Merged sketches beside the exact figures: counts within 2 %."""
    found = sketches.sketched_summary(spark, _sketched(spark, log), 1)
    exact = describe.stats_summary(log).select(*[F.col(c).alias(f"exact_{c}") for c in sketches.COUNTED])
    close = [(F.abs(F.col(c) - F.col(f"exact_{c}")) <= 0.02 * F.col(f"exact_{c}")).alias(c) for c in sketches.COUNTED]
    both = match(found.withColumn("k", F.lit(1)), exact.withColumn("k", F.lit(1)), ["k"])
    return both.select("total_events", "total_bytes", "first_seen", "last_seen", *close)


@query("sketched_period")
def _(spark, log):
    return sketches.sketched_summary(spark, _sketched(spark, log), 1, "2024-01-01", "2024-01-01").select(
        "total_events", "total_bytes", "first_seen", "last_seen")


@query("sketched_top")
def _(spark, log):
    path = _sketched(spark, log)
    return sketches.sketched_top(spark, path, 1, "url", 1000).withColumn("field", F.lit("url")).unionByName(
        sketches.sketched_top(spark, path, 1, "ip", 1000, end="2024-01-01").withColumn("field", F.lit("ip")))


_simple("top_ips", lambda log: describe.top_ips(log, TOP))
_simple("top_user_agents", lambda log: describe.top_user_agents(log, TOP))
_simple("top_urls", lambda log: describe.top_urls(log, TOP))
_simple("top_domains", lambda log: describe.top_domains(log, TOP))
_simple("top_referrers", lambda log: describe.top_referrers(log, TOP))
_simple("top_methods", lambda log: describe.top_methods(log, TOP))
_simple("top_status", lambda log: describe.top_status(log, 3))
_simple("status_classes", describe.status_classes)
_simple("top_ip_bytes", lambda log: describe.top_ip_bytes(log, TOP))
_simple("traffic_histogram", describe.traffic_histogram)
_simple("traffic_peak", lambda log: describe.traffic_peak(describe.traffic_histogram(log)))


# --- field profile ------------------------------------------------------------

def _alb_lines(log):
    n = F.col("seq")
    line = F.format_string(
        'https %s app/lb/1 %s:%d 10.0.1.20:80 0.001 0.002 0.000 %d %d 512 %d "%s https://shop.example.com:443%s HTTP/1.1" "%s" %s',
        F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.when(n % 19 == 0, "").otherwise("Z")),
        F.col("ip"), (n % 60000).cast("int"), F.col("status"), F.col("status"), F.col("bytes"),
        F.col("method"), F.col("url"), F.col("ua"),
        F.when(n % 13 == 0, "-").otherwise("ECDHE-RSA TLSv1.2 arn:tg"))
    return as_lines(log, F.when(n % 71 == 0, "short line").otherwise(line))


def _haproxy_lines(log):
    n = F.col("seq")
    line = F.format_string(
        'Feb  6 12:14:14 host haproxy[14389]: %s:%d [%s] http-in static/srv1 10/0/30/69/109 %d %d - - ---- 1/1/1/1/0 0/0 "%s %s HTTP/1.1"',
        F.col("ip"), (n % 60000).cast("int"), F.date_format("ts", "dd/MMM/yyyy:HH:mm:ss.SSS"),
        F.col("status"), F.col("bytes"), F.col("method"), F.col("url"))
    return as_lines(log, F.when(n % 67 == 0, "connect error").otherwise(line))


def _squid_lines(log):
    n = F.col("seq")
    line = F.format_string("%d.%03d    250 %s TCP_MISS/%d %d %s http://shop.example.com%s %s HIER_DIRECT/93.184.216.34 text/html",
                           F.unix_seconds("ts"), (n % 1000).cast("int"), F.col("ip"), F.col("status"),
                           F.col("bytes"), F.col("method"), F.col("url"),
                           F.when(n % 5 == 0, "alice").otherwise("-"))
    return as_lines(log, F.when(n % 73 == 0, "too few parts").otherwise(line))


_LINES = {"apache": combined_lines, "iis": w3c_lines, "aws_alb": _alb_lines,
          "haproxy": _haproxy_lines, "squid": _squid_lines}


def _tokens(server):
    def build(log):
        rows = tokenize(_LINES[server](log), server)
        return rows.filter("f is not null").select("src_file", "seq", "f.*")
    return build


for _server, _name in (("apache", "clf"), ("aws_alb", "alb"), ("haproxy", "haproxy"),
                       ("squid", "squid"), ("iis", "iis")):
    _simple(f"tokenize_{_name}", _tokens(_server))


def _profiled(log, server):
    rows = profile.observed(_LINES[server](log), server)
    return rows, profile.counts(rows, server)


def _presence(log, server):
    return profile.field_presence(_profiled(log, server)[1], server).drop("description", "ecs")


def _each(build, servers=("apache", "iis", "aws_alb", "squid", "haproxy")):
    """Union over server types with the type in front."""
    def union(log):
        result = None
        for server in servers:
            part = build(log, server).withColumn("server", F.lit(server))
            result = part if result is None else result.unionByName(part)
        return result
    return union


_simple("field_presence", _each(_presence, ("apache", "iis", "squid")))
_simple("field_notes", _each(lambda log, s: profile.field_notes(_presence(log, s)), ("apache", "iis")))
_simple("profile_summary", _each(lambda log, s: profile.profile_summary(_profiled(log, s)[1], s)
                                 .drop("server_type"), ("apache", "iis")))
_simple("field_catalog", lambda log: catalogue.field_catalog(log.sparkSession)
        .filter("server_type = 'apache'").drop("description", "ecs", "place", "server_type")
        .join(_presence(log, "apache").select("key", "present"), "key"))


def _broken(log, server):
    """Lines with the faults the checks look for."""
    n = F.col("seq")
    lines = _LINES[server](log)
    if server != "apache":
        return lines
    line = (F.when(n % 3 == 0, F.concat(F.lit("noise "), n.cast("string")))
            .when(n % 7 == 0, F.regexp_replace("line", r"\[[0-9]{2}/Jan", "[10/Foo"))
            .otherwise(F.col("line")))
    line = F.regexp_replace(line, r'"(GET|POST|PUT) ', '"- ')
    return as_lines(lines, line)


def _fired(log, server):
    rows = profile.observed(_broken(log, server), server)
    totals = profile.counts(rows, server)
    return profile.discrepancies(rows, totals, server).drop("message")


def _one_check(name, server="apache"):
    _simple(f"chk_{name}", lambda log: _fired(log, server).filter(F.col("check") == name))


for _check in ("missing_timezone", "inconsistent_datetime", "private_client_ip",
               "mixed_ip_versions", "empty_core_field", "low_parse_rate"):
    _one_check(_check)
_one_check("timezone_is_utc", "iis")
_simple("chk_non_chronological", lambda log: profile.backsteps(
    profile.observed(combined_lines(log), "apache")))


@query("chk_query_string_empty")
def _(spark, log):
    bare = log.withColumn("url", F.substring_index("url", "?", 1))
    rows = profile.observed(w3c_lines(bare, layouts=1), "iis")
    return (profile.discrepancies(rows, profile.counts(rows, "iis"), "iis")
            .filter(F.col("check") == "query_string_empty").drop("message"))


_simple("discrepancies", _each(_fired, ("apache", "iis")))


# --- sinks --------------------------------------------------------------------

@query("write_findings")
def _(spark, log):
    path = run_path(spark, "findings")
    for case_id in (1, 2):
        write.write_findings(_all(log, case_id), path, case_id)
    write.write_findings(detect.find_enum_404(log, ENUM, case_id=2, now=NOW), path, 2)
    return spark.read.parquet(path).groupBy("case_id", "rule").agg(
        F.count("*").alias("n"), F.sum("count").alias("hits"))


@query("export_timeline")
def _(spark, log):
    path = run_path(spark, "timeline")
    write.export_timeline(correlate.timeline(log, samples=False), path)
    return (spark.read.option("header", True).option("escape", '"').csv(path)
            .fillna("").withColumnRenamed("404s", "n404"))


_simple("export_statistics", lambda log: write.statistics_table(log, TOP))


# --- enrichment ---------------------------------------------------------------

def reputation(log: DataFrame) -> DataFrame:
    """A reputation table derived from the log: two in three addresses known."""
    known = log.groupBy("ip").agg(F.count("*").alias("n"), F.max("seq").alias("m"))
    rows = known.filter(F.col("n") % 3 != 0).select(
        "ip", (F.col("m") * 7 % 101).cast("int").alias("abuse_score"),
        F.col("n").cast("int").alias("total_reports"), F.lit("ZZ").alias("country"),
        F.lit("").alias("isp"), F.lit("").alias("usage_type"), F.lit("").alias("domain"),
        (F.col("m") % 2 == 0).alias("is_tor"), F.lit("").alias("last_reported_at"),
        (F.lit(NOW).cast("timestamp") - F.make_dt_interval(F.lit(0), (F.col("m") % 48).cast("int")))
        .alias("checked_at"), F.lit("{}").alias("raw"))
    return rows.select(*REPUTATION_SCHEMA.fieldNames())


def _candidates(log):
    """Typed addresses first (blanks, repeats and bad ones among them), then the case's."""
    n = F.col("seq")
    typed = log.select(
        (F.when(n % 11 == 0, "  ").when(n % 11 == 1, F.concat(F.lit(" 8.8.8."), (n % 90).cast("string")))
         .when(n % 11 == 2, F.concat(F.lit("10.1.1."), (n % 7).cast("string")))
         .when(n % 11 == 3, F.concat(F.lit("bad-"), (n % 5).cast("string")))
         .otherwise(F.concat(F.lit("9.9."), (n % 13).cast("string"), F.lit(".1 ")))).alias("ip"), n.alias("n"))
    case = enrich.case_source_ips(log)
    return (enrich.listed(typed, F.col("n"), 0)
            .unionByName(enrich.listed(case, -F.col("count"), 1)))


def _known(log):
    """Reputation of the typed list's public addresses, too."""
    typed = _candidates(log).select(F.trim("ip").alias("ip"), F.col("pos.place").alias("seq"))
    return reputation(typed.filter("seq >= 0 and ip <> ''").unionByName(log.select("ip", "seq")))


_simple("case_source_ips", lambda log: enrich.case_source_ips(log))
_simple("screen_ips", lambda log: enrich.screen_ips(_candidates(log)).select("ip", "verdict"))


def _queued(log):
    return enrich.screen_ips(_candidates(log)).filter("verdict = 'queued'").drop("verdict")


_simple("reputation_cached", lambda log: enrich.reputation_cached(_queued(log), _known(log), NOW)
        .select("ip", "fresh", "abuse_score"))
_simple("reputation_to_refresh", lambda log: enrich.reputation_to_refresh(
    enrich.reputation_cached(_queued(log), _known(log), NOW), 25).select("ip", "state"))
_simple("reputation_upsert", lambda log: enrich.reputation_upsert(
    reputation(log), _known(log).withColumn("abuse_score", F.col("abuse_score") + 1))
    .select("ip", "abuse_score", "checked_at"))


@query("reputation_report")
def _(spark, log):
    cached = enrich.reputation_cached(_queued(log), _known(log), NOW).filter("fresh")
    return enrich.reputation_report(cached).select("ip", "abuse_score", "band")


@query("reputation_counts")
def _(spark, log):
    screened = stage(enrich.screen_ips(_candidates(log)), "screened")
    queued = screened.filter("verdict = 'queued'").drop("verdict")
    states = enrich.reputation_to_refresh(enrich.reputation_cached(queued, _known(log), NOW), 25)
    return enrich.reputation_counts(screened, states)
