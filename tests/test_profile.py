import pytest

from spoor.operators import profile
from spoor.operators.tokenize import tokenize
from spoor.plans.reports import analyze_parameters

CLF = '203.0.113.7 - {u} [10/Jul/2026:13:55:3{s} +0000] "GET /index.html HTTP/1.1" 200 4523'
TAIL = ' "https://example.com/" "Mozilla/5.0"'


def _run(lines_of, server, lines, **kw):
    report = analyze_parameters(lines_of(lines, **kw), server)
    fields = {r["key"]: r for r in report.fields.collect()}
    checks = {r["check"]: r for r in report.discrepancies.collect()}
    return report.summary.first(), fields, checks


def test_clean_combined(lines_of):
    summary, fields, checks = _run(lines_of, "apache", [
        (CLF + TAIL).format(u="-", s=6), (CLF + TAIL).format(u="alice", s=7)])
    assert summary["parse_rate"] == 1.0 and summary["core_present"] == summary["core_total"]
    assert fields["user_agent"]["present"] and fields["referer"]["present"]
    assert fields["remote_user"]["sample"] == "alice" and fields["remote_user"]["populated_ratio"] == 0.5
    assert fields["ident"]["note"] and fields["ident"]["populated_ratio"] == 0.0
    assert "missing_timezone" not in checks and checks["private_client_ip"]["severity"] == "high"


def test_no_offset(lines_of):
    _, _, checks = _run(lines_of, "apache",
                        ['9.9.9.9 - - [10/Jul/2026:13:55:36] "GET / HTTP/1.1" 200 10 "-" "curl/8.0"'])
    assert checks["missing_timezone"]["severity"] == "high"
    assert checks["missing_timezone"]["examples"] == ["10/Jul/2026:13:55:36"]


def test_common_format(lines_of):
    summary, fields, _ = _run(lines_of, "apache", [CLF.format(u="-", s=6)])
    assert not fields["user_agent"]["present"] and not fields["referer"]["present"]
    assert summary["core_missing"] == [] and summary["missing_count"] > 0


def test_forwarded_address_lowers_the_severity(lines_of):
    line = '10.0.0.5 - - [10/Jul/2026:13:55:36 +0000] "GET /api HTTP/1.1" 200 512 "-" "okhttp/4.9"'
    _, fields, checks = _run(lines_of, "nginx", [line + ' "203.0.113.9, 10.0.0.5" 1234'] * 2)
    assert fields["x_forwarded_for"]["sample"] == "203.0.113.9, 10.0.0.5"
    assert fields["response_time"]["sample"] == "1234"
    assert checks["private_client_ip"]["severity"] == "medium"
    _, _, checks = _run(lines_of, "nginx", [line])
    assert checks["private_client_ip"]["severity"] == "high"


def test_private_ratio_boundary(lines_of):
    public = (CLF + TAIL).format(u="-", s=1).replace("203.0.113.7", "9.9.9.9")
    private = public.replace("9.9.9.9", "10.0.0.1")
    assert _run(lines_of, "apache", [public, private])[2]["private_client_ip"]["severity"] == "medium"
    assert _run(lines_of, "apache", [public, private, private])[2]["private_client_ip"]["severity"] == "high"


def test_w3c_without_query(lines_of):
    summary, fields, checks = _run(lines_of, "iis", [
        "#Software: server",
        "#Fields: date time c-ip cs-method cs-uri-stem cs-uri-query sc-status sc-bytes cs(User-Agent)",
        "2026-07-10 13:55:36 203.0.113.7 GET /index.html - 200 4523 Mozilla/5.0",
        "2026-07-10 13:55:40 203.0.113.7 GET /about - 200 900 Mozilla/5.0"])
    assert fields["cs-uri-query"]["present"] and not fields["time-taken"]["present"]
    assert {"query_string_empty", "timezone_is_utc"} <= set(checks)
    assert summary["sampled"] == summary["parsed"] == 2


def test_balancer(lines_of):
    line = ('https 2026-07-10T13:55:36.123456Z app/my-lb/abc123 203.0.113.7:54321 10.0.1.20:80 0.001 0.002 '
            '0.000 200 200 512 4523 "GET https://example.com:443/ HTTP/1.1" "Mozilla/5.0" '
            'ECDHE-RSA-AES128-GCM-SHA256 TLSv1.2 arn:aws:tg "Root=1-abc"')
    summary, fields, checks = _run(lines_of, "aws_alb", [line])
    assert summary["parse_rate"] == 1.0 and "missing_timezone" not in checks
    assert (fields["client_ip"]["sample"], fields["elb_status"]["sample"], fields["ssl_protocol"]["sample"]) == (
        "203.0.113.7", "200", "TLSv1.2")


def test_haproxy(lines_of):
    line = ('Feb  6 12:14:14 host haproxy[14389]: 9.9.9.9:33317 [06/Feb/2026:12:14:14.655] http-in static/srv1 '
            '10/0/30/69/109 200 2750 - - ---- 1/1/1/1/0 0/0 "GET /index.html HTTP/1.1"')
    summary, fields, checks = _run(lines_of, "haproxy", [line, line])
    assert (fields["client_ip"]["sample"], fields["timers"]["sample"], fields["request"]["sample"]) == (
        "9.9.9.9", "10/0/30/69/109", "GET /index.html HTTP/1.1")
    assert set(checks) == {"missing_timezone"} and summary["core_missing"] == []


def test_squid(lines_of):
    line = "1720619736.123 250 203.0.113.7 TCP_MISS/200 4523 GET http://example.com/ - HIER_DIRECT/1.2.3.4 text/html"
    _, fields, _ = _run(lines_of, "squid", [line])
    assert fields["status"]["sample"] == "TCP_MISS/200" and fields["epoch"]["present"]
    assert fields["user"]["populated_ratio"] == 0.0


def test_wrong_type(lines_of):
    junk = ["this is not a log line", "neither=is=this", "garbage garbage garbage", "", "  "]
    summary, _, checks = _run(lines_of, "apache", junk)
    assert (summary["sampled"], summary["parsed"], summary["parse_rate"]) == (3, 0, 0.0)
    assert "low_parse_rate" in checks
    good = (CLF + TAIL).format(u="-", s=1)
    assert "low_parse_rate" not in _run(lines_of, "apache", [good] * 4 + ["junk"])[2]
    assert "low_parse_rate" in _run(lines_of, "apache", [good] * 3 + ["junk"])[2]


@pytest.mark.parametrize("split", [1, 2, 3, 100])
def test_backsteps_do_not_depend_on_splits(lines_of, split):
    hours = [1, 2, 2, 9, 7, 8, 3, 3, 20, 19, 1, 5]
    lines = [f'9.9.9.9 - - [10/Jul/2026:{h:02d}:00:00 +0000] "GET / HTTP/1.1" 200 1' for h in hours]
    lines.insert(5, "unreadable")
    rows = profile.observed(lines_of(lines, split=split), "apache")
    # 9 to 7, 8 to 3 and 19 to 1; 20 to 19 is exactly one hour.
    assert profile.backsteps(rows).first()["backward"] == 3


@pytest.mark.parametrize("piece", [1, 3, 4])
def test_backsteps_do_not_depend_on_pieces(lines_of, monkeypatch, piece):
    hours = [5, 6, 3, 4, 9, 9, 1, 2, 8, 0]
    lines = [f'8.8.8.8 - - [01/Jan/2024:{h:02d}:00:00 +0000] "GET / HTTP/1.1" 200 1 "-" "A"' for h in hours]
    monkeypatch.setattr(profile, "PIECE_LINES", piece)
    assert profile.backsteps(profile.observed(lines_of(lines), "apache")).first()["backward"] == 3


def test_mixed_versions_and_bad_times(lines_of):
    line = '{} - - [{}] "GET / HTTP/1.1" 200 1'
    _, _, checks = _run(lines_of, "generic", [line.format("9.9.9.9", "10/Jul/2026:13:55:36 +0000"),
                                              line.format("2001:4860::1", "2026-07-10 13:55:36")])
    assert checks["inconsistent_datetime"]["examples"] == ["2026-07-10 13:55:36"]
    assert checks["mixed_ip_versions"]["severity"] == "info"
    assert checks["missing_timezone"]["severity"] == "medium"


def test_cap(lines_of):
    summary = analyze_parameters(lines_of([CLF.format(u="-", s=1)] * 9 + [""] * 3), "apache", cap=5).summary.first()
    assert summary["sampled"] == 5


def test_empty_request(lines_of):
    row = tokenize(lines_of(['9.9.9.9 - - [x] "" - -']), "apache").first()["f"]
    assert row["method"] == "-" and row["uri"] is None
