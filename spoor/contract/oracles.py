"""The same questions in plain SQL, for comparison on the same tables."""

from __future__ import annotations

from spoor.contract.queries import BRUTE, ENUM, EXFIL, LEAD_IP, TOP
from spoor.operators.catalogue import CATALOGUES
from spoor.rules import (AUTH_FAILURES, DEFAULT_RULES, SCANNER_UAS, UNCOMMON_METHODS)
from spoor.sources.weblog import PAYLOADS, START


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _list(values) -> str:
    return ", ".join(_q(v) if isinstance(v, str) else str(v) for v in values)


_PAYLOADS = " ".join(f"WHEN event_id % 23 = {k % 7 + 1} AND event_id // 23 % {len(PAYLOADS) // 7} = {k // 7} THEN {_q(v)}"
                     for k, v in enumerate(PAYLOADS))
LOG = f"""
b AS (SELECT event_id AS seq, user_id, event_type, value,
  {START} + CASE WHEN event_id % 20 = 0 THEN 72000 + (event_id * 13) % 3600
            ELSE (event_id * 37) % 129600 END AS epoch_s FROM events),
w0 AS (SELECT seq, make_timestamp(epoch_s * 1000000) AS ts,
  CASE WHEN seq % 10 = 0 THEN '198.51.100.7' WHEN seq % 9 = 0 THEN '8.8.4.' || (user_id % 5)
       ELSE '203.0.113.' || (user_id % 40) END AS ip,
  CASE WHEN event_type = 'signup' THEN 'POST' WHEN event_type = 'purchase' AND seq % 7 = 0 THEN 'PUT'
       WHEN event_type = 'purchase' THEN 'POST' ELSE 'GET' END AS method,
  CASE {_PAYLOADS.replace('event_id', 'seq')} ELSE '/products/' || (seq % 50) END AS url,
  CASE WHEN event_type = 'error' THEN CASE seq % 3 WHEN 0 THEN 401 WHEN 1 THEN 403 ELSE 404 END
       WHEN seq % 97 = 0 THEN 500 WHEN seq % 11 = 0 THEN 301 ELSE 200 END AS status,
  CAST(round(value * 100) AS BIGINT) * CASE WHEN seq % 10 = 0 THEN 50 ELSE 1 END AS bytes,
  CASE WHEN seq % 211 = 0 THEN 'odd/' || seq WHEN user_id % 8 = 0 THEN 'sqlmap/1.7'
       WHEN user_id % 8 = 1 THEN '-' WHEN user_id % 8 = 2 THEN 'python-requests/2.31'
       ELSE 'Mozilla/5.0 (X11) Browser/' || (user_id % 8) END AS ua,
  CASE seq % 5 WHEN 0 THEN '' WHEN 1 THEN '-' ELSE 'https://ref' || (seq % 12) || '.example.org/p' END AS referrer,
  'access-' || (seq % 4) || '.log' AS src_file, seq // 1000 AS block_start FROM b),
w AS (SELECT *, regexp_extract(referrer, '^[A-Za-z]+://([^/:]+)', 1) AS domain,
  ip || ' - - [' || strftime(ts, '%d/%b/%Y:%H:%M:%S') || ' +0000] "' || method || ' ' || url || ' HTTP/1.1" '
  || status || ' ' || bytes || ' "' || referrer || '" "' || ua || '"' AS raw FROM w0)"""

_TAGS = "[x FOR x IN [" + ", ".join(
    f"CASE WHEN regexp_matches(url, {_q(r.pattern)}, 'i') THEN {_q(r.name)} END"
    for r in DEFAULT_RULES.rules) + "] IF x IS NOT NULL]"
TAGGED = f"""{LOG},
u AS (SELECT url, {_TAGS} AS tags FROM (SELECT DISTINCT url FROM w)),
t AS (SELECT w.*, u.tags FROM w JOIN u USING (url))"""


def _scanner(column: str) -> str:
    return "(" + " OR ".join(f"contains(lower({column}), {_q(s)})" for s in SCANNER_UAS) + ")"


def _ipnum(column: str) -> str:
    return " + ".join(f"CAST(split_part({column}, '.', {i + 1}) AS BIGINT) * {256 ** (3 - i)}"
                      for i in range(4))


def _with(ctes: str, body: str) -> str:
    return f"WITH {ctes} {body}"


_SEVERITY = "CASE rule " + " ".join(f"WHEN '{r.name}' THEN '{r.severity}'" for r in DEFAULT_RULES.rules) \
    + " ELSE 'medium' END"
NO_TS = "CAST(NULL AS TIMESTAMP)"


def _hits(source: str) -> str:
    """Findings of (rule, ip) from ``source(rule, ip, ts, seq, url, ua)``."""
    return f"""per AS (SELECT rule, ip, count(*) AS n, min(ts) AS f, max(ts) AS l,
      first(CASE WHEN url <> '' THEN url ELSE ua END ORDER BY ts, src_file, block_start, seq) AS s
      FROM ({source}) GROUP BY rule, ip),
    hits AS (SELECT CAST(0 AS BIGINT) AS case_id, rule, {_SEVERITY} AS severity, ip AS source_ip,
      n AS count, s AS sample, f AS first_seen, l AS last_seen FROM per)"""


_SIGN = "SELECT unnest(tags) AS rule, ip, ts, seq, url, ua, src_file, block_start FROM t"
_SCAN = f"SELECT 'scanner_ua' AS rule, ip, ts, seq, url, ua, src_file, block_start FROM t WHERE {_scanner('ua')}"
_METH = f"""SELECT 'dangerous_method' AS rule, ip, ts, seq, url, ua, src_file, block_start FROM t
  WHERE method IN ({_list(UNCOMMON_METHODS)})"""

_BRUTE = f"""brute AS (SELECT ip, max(n) AS worst, CAST(sum(n) AS BIGINT) AS total FROM (
    SELECT ip, CAST(epoch(ts) AS BIGINT) // 300 AS slot, count(*) AS n FROM w WHERE status IN ({_list(AUTH_FAILURES)})
    GROUP BY ip, slot) GROUP BY ip)"""
_MISS = f"""miss AS (SELECT ip, count(*) AS n, min(ts) AS f, max(ts) AS l FROM w WHERE status = 404 GROUP BY ip)"""
_FLEET = """fleet AS (SELECT ip, count(*) AS n, sum(bytes) AS total FROM w GROUP BY ip),
  stat AS (SELECT count(*) AS k, avg(total) AS mean, stddev_pop(total) AS sigma FROM fleet)"""
_RARE = """rare AS (SELECT ua, count(*) AS n FROM w GROUP BY ua)"""
_HOURS = """hrs AS (SELECT CAST(epoch(ts) AS BIGINT) // 3600 AS h, count(*) AS n FROM w GROUP BY h),
  every AS (SELECT unnest(generate_series(min(h)::BIGINT, max(h)::BIGINT)) AS h FROM hrs),
  filled AS (SELECT every.h, coalesce(n, 0) AS n FROM every LEFT JOIN hrs USING (h)),
  hstat AS (SELECT count(*) AS k, avg(n) AS mean, stddev_pop(n) AS sigma FROM filled)"""


def _finding(rule, severity, ip, count, sample, first, last, source, where) -> str:
    return f"""SELECT CAST(0 AS BIGINT) AS case_id, '{rule}' AS rule, '{severity}' AS severity,
      {ip} AS source_ip, CAST({count} AS BIGINT) AS count, {sample} AS sample, {first} AS first_seen,
      {last} AS last_seen FROM {source} WHERE {where}"""


_NOIP = "CAST(NULL AS VARCHAR)"
F_BRUTE = _finding("brute_force", "high", "ip", "total", "''", NO_TS, NO_TS, "brute", f"worst >= {BRUTE}")
F_MISS = _finding("enumeration_404", "medium", "ip", "n", "''", "f", "l", "miss", f"n >= {ENUM}")
F_EXFIL = _finding("exfil_bytes", "high", "ip", "n", "''", NO_TS, NO_TS, "fleet, stat",
                   f"k >= 5 AND sigma > 0 AND total > {EXFIL} AND total > mean + 3 * sigma")
F_RARE = _finding("rare_user_agent", "low", _NOIP, "n", "ua", NO_TS, NO_TS, "rare",
                  "n <= 5 AND ua NOT IN ('', '-')")
F_SPIKE = _finding("traffic_spike", "medium", _NOIP, "n", "''",
                   "make_timestamp(CAST(h AS BIGINT) * 3600000000)", NO_TS, "filled, hstat",
                   "k >= 6 AND sigma > 0 AND (n - mean) / sigma > 3")
ALL = f"""{TAGGED}, {_hits(' UNION ALL '.join((_SIGN, _SCAN, _METH)))},
  {_BRUTE}, {_MISS}, {_FLEET}, {_RARE}, {_HOURS},
  found AS (SELECT * FROM hits UNION ALL {F_BRUTE} UNION ALL {F_MISS} UNION ALL {F_EXFIL}
            UNION ALL {F_RARE} UNION ALL {F_SPIKE})"""


def _sessions(source: str = "t") -> str:
    return f"""g AS (SELECT *, CASE WHEN ts - lag(ts) OVER k <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS opens
      FROM {source} WINDOW k AS (PARTITION BY ip, ua ORDER BY ts, src_file, block_start, seq)),
    e AS (SELECT * EXCLUDE (opens), CAST(sum(opens) OVER (PARTITION BY ip, ua
      ORDER BY ts, src_file, block_start, seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session_no FROM g),
    s0 AS (SELECT ip, ua, session_no, min(ts) AS "start", max(ts) AS "end", count(*) AS event_count,
      count(*) FILTER (status = 404) AS n404, CAST(sum(bytes) AS BIGINT) AS bytes_out,
      list_sort(list_distinct(flatten(list(tags)))) AS tags, {_scanner('ua')} AS scanner_ua
      FROM e GROUP BY ip, ua, session_no),
    s AS (SELECT * REPLACE (array_to_string(tags, ',') AS tags), {_PHASE} AS phase FROM s0)"""


def _overlap(names) -> str:
    return f"list_has_any(tags, [{_list(sorted(names))}])"


_PHASE = f"""CASE WHEN {_overlap(DEFAULT_RULES.postexploit_tags)} THEN 'post-exploitation'
  WHEN bytes_out >= 10485760 THEN 'exfiltration' WHEN {_overlap(DEFAULT_RULES.exploit_tags)} THEN 'exploitation'
  WHEN scanner_ua OR (event_count >= 20 AND n404 / event_count > 0.5) OR {_overlap(DEFAULT_RULES.recon_tags)}
  THEN 'recon' ELSE 'benign' END"""
SESS = f"{TAGGED}, {_sessions()}"
_RANKS = "CASE phase WHEN 'benign' THEN 0 WHEN 'recon' THEN 1 WHEN 'exploitation' THEN 2 WHEN 'post-exploitation' THEN 3 ELSE 4 END"


def _ranking(field: str, n: int, where: str = "true", measure: str = "count(*)",
             tie: str | None = None, blanks: str = "label NOT IN ('', '-')") -> str:
    return f"""r AS (SELECT {field} AS label, CAST({measure} AS BIGINT) AS count FROM w WHERE {where}
      GROUP BY {field} ORDER BY count DESC, {tie or 'label'} LIMIT {n}),
    shown AS (SELECT label, count, round_even(100 * count / max(count) OVER (), 1) AS pct,
      round_even(100 * count / sum(count) OVER (), 1) AS share FROM r WHERE {blanks})"""


# --- raw lines ------------------------------------------------------------------
LINES = f"""{LOG},
lines AS (SELECT src_file, block_start, seq, CASE WHEN seq % 37 = 0 THEN 'garbage ' || seq
  WHEN seq % 41 = 0 THEN regexp_replace(raw, '\\[[0-9]{{2}}/', '[32/')
  WHEN seq % 43 = 0 THEN regexp_replace(raw, ' \\+0000\\]', ']')
  WHEN seq % 29 = 0 THEN 'shop.example.com:443 ' || raw
  WHEN seq % 31 = 0 THEN regexp_replace(raw, ' "[^"]*" "[^"]*"$', '')
  WHEN seq % 47 = 0 THEN raw || ' "203.0.113.9, 10.0.0.5" 1234'
  WHEN seq % 53 = 0 THEN regexp_replace(raw, '^\\S+', '10.0.0.8')
  WHEN seq % 59 = 0 THEN regexp_replace(raw, '^\\S+', '999.1.1.1')
  WHEN seq % 61 = 0 THEN regexp_replace(raw, '^\\S+', '2001:4860:4860::8888') ELSE raw END AS line FROM w)"""
# The parser seen from outside: what each defect leaves of the log row.
PARSED = f"""{LINES},
p AS (SELECT w.ts, CASE WHEN l.line LIKE '10.0.0.8 %' THEN '10.0.0.8' WHEN l.line LIKE '999.%' THEN '999.1.1.1'
    WHEN l.line LIKE '2001:%' THEN '2001:4860:4860::8888' ELSE w.ip END AS ip, method,
  CASE WHEN bare THEN '' ELSE referrer END AS referrer, CAST(status AS BIGINT) AS status, bytes, url,
  CASE WHEN l.line LIKE 'shop.example.com:443 %' THEN 'shop.example.com' WHEN bare THEN '' ELSE domain END AS domain,
  CASE WHEN bare THEN '' ELSE ua END AS ua, l.line AS raw, w.src_file, w.block_start, w.seq
  FROM w JOIN (SELECT *, NOT ends_with(line, '"') AND NOT ends_with(line, ' 1234') AS bare FROM lines) l USING (seq)
  WHERE l.line NOT LIKE 'garbage%' AND l.line NOT LIKE '%[32/%' AND l.line LIKE '%+0000]%')"""
_BAD_IP = "ip = '999.1.1.1'"

# --- W3C lines --------------------------------------------------------------------
_DIR = "(seq % 500 BETWEEN 4 AND 7 OR seq < 2)"
W3C = f"""{LOG},
d AS (SELECT *, seq // 500 % 2 AS own, strftime(ts, '%Y-%m-%d %H:%M:%S') AS stamp, replace(ua, ' ', '+') AS ua_,
  split_part(url, '?', 1) AS stem, regexp_extract(url, '\\?(.*)$', 1) AS query,
  max(CASE WHEN {_DIR} THEN seq END) OVER (PARTITION BY src_file ORDER BY seq) // 500 % 2 AS layout FROM w),
x AS (SELECT src_file, block_start, seq * 2 + 1 AS seq, layout, CASE WHEN own = 0 THEN
    concat_ws(' ', stamp, ip, method, stem, CASE WHEN query = '' THEN '-' ELSE query END,
      CASE WHEN seq % 17 = 0 THEN '-' ELSE CAST(status AS VARCHAR) END, bytes, ua_,
      CASE WHEN referrer = '' THEN '-' ELSE referrer END)
  ELSE concat_ws(' ', stamp, method, stem, ip, status, ua_) END AS line FROM d WHERE layout IS NOT NULL),
v AS (SELECT *, split(line, ' ') AS f FROM x)"""
_WIDE = ["date", "time", "c-ip", "cs-method", "cs-uri-stem", "cs-uri-query", "sc-status", "sc-bytes",
         "cs(User-Agent)", "cs(Referer)"]
_SLIM = ["date", "time", "cs-method", "cs-uri-stem", "c-ip", "sc-status", "cs(User-Agent)"]


def _w3c(key: str, absent: str) -> str:
    """Value of a field under the layout in force."""
    def under(fields):
        if key not in fields:
            return absent
        return f"coalesce(f[{fields.index(key) + 1}], {absent})"
    return f"CASE WHEN layout = 0 THEN {under(_WIDE)} ELSE {under(_SLIM)} END"


def _w3c_number(key: str) -> str:
    return f"CASE WHEN regexp_full_match({_w3c(key, _q('0'))}, '[+-]?[0-9]+') THEN CAST({_w3c(key, _q('0'))} AS BIGINT) ELSE 0 END"


def _w3c_token(key: str) -> str:
    def under(fields):
        return f"coalesce(f[{fields.index(key) + 1}], '-')" if key in fields else "NULL"
    return f"CASE WHEN layout = 0 THEN {under(_WIDE)} ELSE {under(_SLIM)} END"


def _clf(lines: str) -> str:
    """Fields of the generated lines, taken apart at quotes, brackets and blanks."""
    return f"""m AS (SELECT *, split(line, '"') AS q, contains(line, '[') AND contains(line, '"') AS fits FROM {lines}),
    h AS (SELECT *, split(split_part(q[1], ' [', 1), ' ') AS head, split(trim(q[3]), ' ') AS tail, split(q[2], ' ') AS req FROM m WHERE fits),
    c AS (SELECT src_file, block_start, seq, fits, head[-3] AS remote_ip, head[-2] AS ident, head[-1] AS remote_user,
      split_part(split_part(q[1], '[', 2), ']', 1) AS "timestamp", CASE WHEN req[1] = '' THEN '-' ELSE req[1] END AS method,
      req[2] AS uri, req[3] AS protocol, tail[1] AS status, tail[2] AS bytes, q[4] AS referer, q[6] AS user_agent,
      CASE WHEN len(head) = 4 THEN head[1] END AS vhost, CASE WHEN contains(q[8], ',') THEN q[8] END AS x_forwarded_for,
      nullif(trim(q[9]), '') AS response_time FROM h)"""


_BROKEN = f"""{LINES},
bad AS (SELECT src_file, block_start, seq, regexp_replace(CASE WHEN seq % 3 = 0 THEN 'noise ' || seq
  WHEN seq % 7 = 0 THEN regexp_replace(line, '\\[[0-9]{{2}}/Jan', '[10/Foo')
  ELSE line END, '"(GET|POST|PUT) ', '"- ') AS line FROM lines), {_clf('bad')},
k AS (SELECT *, nullif("timestamp", '-') AS logged, remote_ip AS client,
  CASE WHEN seq % 3 <> 0 AND try_strptime(split_part("timestamp", ' ', 1), '%d/%b/%Y:%H:%M:%S') IS NULL
       THEN true ELSE false END AS unparsed,
  NOT regexp_matches("timestamp", '[+-][0-9]{{4}}\\b|Z$') AS naive,
  (remote_ip LIKE '203.0.113.%' OR remote_ip LIKE '198.51.100.%' OR remote_ip LIKE '10.%') AS private FROM c)"""
_ORDER = "ORDER BY src_file, block_start, seq"


def _example(value: str, where: str, n: int) -> str:
    return f"(SELECT coalesce(string_agg({value}, ',' {_ORDER}), '') FROM (SELECT * FROM k WHERE {where} {_ORDER} LIMIT {n}))"


def _fires(check: str, severity: str, examples: str, where: str) -> str:
    return f"SELECT '{check}' AS \"check\", {severity} AS severity, {examples} AS examples FROM (SELECT 1) WHERE {where}"


_CHECKS = {
    "low_parse_rate": _fires("low_parse_rate", "'high'", "''",
                             "(SELECT count(*) FROM k) / (SELECT count(*) FROM bad) < 0.8"),
    "missing_timezone": _fires("missing_timezone", "CASE WHEN (SELECT bool_and(naive) FROM k) THEN 'high' ELSE 'medium' END",
                               _example("logged", "naive", 3), "(SELECT bool_or(naive) FROM k)"),
    "inconsistent_datetime": _fires("inconsistent_datetime", "'high'", _example("logged", "unparsed", 3),
                                    "(SELECT bool_or(unparsed) FROM k)"),
    "private_client_ip": _fires("private_client_ip",
                                "CASE WHEN (SELECT avg(private::INT) FROM k) > 0.5 AND (SELECT count(x_forwarded_for) FROM k) = 0 THEN 'high' ELSE 'medium' END",
                                _example("client", "private", 5), "(SELECT bool_or(private) FROM k)"),
    "mixed_ip_versions": _fires("mixed_ip_versions", "'info'", "''",
                                "(SELECT bool_or(client LIKE '%:%') AND bool_or(client NOT LIKE '%:%') FROM k)"),
    "empty_core_field": _fires("empty_core_field", "'high'", "''", "(SELECT bool_and(method = '-') FROM k)"),
}
_BACK = """times AS (SELECT *, try_strptime(split_part("timestamp", ' ', 1), '%d/%b/%Y:%H:%M:%S') AS moment FROM c),
  steps AS (SELECT lag(moment) OVER (PARTITION BY src_file ORDER BY block_start, seq) - moment AS fall
            FROM times WHERE moment IS NOT NULL)"""


def _present(server: str, source: str, parsed: str, value) -> str:
    """Field rows of one server type from token columns."""
    parts = []
    for i, row in enumerate(CATALOGUES[server]):
        v = value(row[0])
        filled = f"{v} IS NOT NULL AND {v} NOT IN ('', '-')"
        parts.append(f"""SELECT CAST({i} AS BIGINT) AS place, {_q(row[0])} AS key, {_q(row[1])} AS label, '{row[2]}' AS category,
          count({v}) AS s, count(*) FILTER ({filled}) AS p, (SELECT count(*) FROM {parsed}) AS n,
          first({v} {_ORDER}) FILTER ({filled}) AS sample, '{server}' AS server FROM {source}""")
    return " UNION ALL ".join(parts)


_SQUID = f"""sq AS (SELECT src_file, block_start, seq, CASE WHEN seq % 73 = 0 THEN NULL ELSE true END AS fits,
  CAST(epoch(ts) AS BIGINT) || '.' || lpad(CAST(seq % 1000 AS VARCHAR), 3, '0') AS epoch, '250' AS elapsed, ip AS client_ip,
  'TCP_MISS/' || status AS status, CAST(bytes AS VARCHAR) AS bytes, method, 'http://shop.example.com' || url AS uri,
  CASE WHEN seq % 5 = 0 THEN 'alice' ELSE '-' END AS "user", 'HIER_DIRECT/93.184.216.34' AS hierarchy,
  'text/html' AS content_type FROM w WHERE seq % 73 <> 0)"""


def _quoted(key: str) -> str:
    return f'"{key}"'


_IIS_KEYS = [r[0] for r in CATALOGUES["iis"]]
_IIS_TOK = "it AS (SELECT src_file, block_start, seq, " + ", ".join(
    f"CAST({_w3c_token(k)} AS VARCHAR) AS {_quoted(k)}" for k in _IIS_KEYS) + " FROM v)"
_SHOW = """SELECT place, key, label, category, s > 0 AS present, round_even(s / greatest(n, 1), 2) AS presence_ratio,
  round_even(p / greatest(n, 1), 2) AS populated_ratio, coalesce(sample, '') AS sample,
  CASE WHEN s > 0 AND p = 0 THEN 'present but never filled'
       WHEN s > 0 AND round_even(s / greatest(n, 1), 2) > 0 AND round_even(s / greatest(n, 1), 2) < 0.9 THEN 'only in some lines'
       ELSE '' END AS note, server"""
_TWO = (f"{LINES}, {_clf('lines')}, " + W3C[len(LOG) + 1:] + f", {_IIS_TOK}")
_FIELDS = (f"fld AS ({_present('apache', 'c', 'c', _quoted)} UNION ALL {_present('iis', 'it', 'it', _quoted)})")

# --- enrichment --------------------------------------------------------------------
_NOW = "TIMESTAMP '2024-01-03 00:00:00'"


def _reputation(source: str) -> str:
    return f"""SELECT ip, CAST(m * 7 % 101 AS BIGINT) AS abuse_score, {_NOW} - to_hours(CAST(m % 48 AS INTEGER)) AS checked_at
      FROM (SELECT ip, count(*) AS n, max(seq) AS m FROM ({source}) GROUP BY ip) WHERE n % 3 <> 0"""


CAND = f"""{LOG},
typed AS (SELECT CASE seq % 11 WHEN 0 THEN '  ' WHEN 1 THEN ' 8.8.8.' || (seq % 90) WHEN 2 THEN '10.1.1.' || (seq % 7)
  WHEN 3 THEN 'bad-' || (seq % 5) ELSE '9.9.' || (seq % 13) || '.1 ' END AS ip, seq FROM w),
cand AS (SELECT trim(ip) AS ip, 0 AS src, seq AS place FROM typed UNION ALL
  SELECT ip, 1, -count(*) FROM w GROUP BY ip),
screen AS (SELECT ip, min(src * 100000000000 + place) AS pos, CASE WHEN ip LIKE 'bad-%' THEN 'invalid'
  WHEN ip LIKE '10.%' OR ip LIKE '203.0.113.%' OR ip LIKE '198.51.100.%' THEN 'private/reserved' ELSE 'queued' END AS verdict
  FROM cand WHERE ip <> '' GROUP BY ip),
known AS ({_reputation("SELECT trim(ip) AS ip, seq FROM typed WHERE trim(ip) <> '' UNION ALL SELECT ip, seq FROM w")}),
cached AS (SELECT s.ip, s.pos, k.abuse_score, coalesce(k.checked_at > {_NOW} - INTERVAL 24 HOUR, false) AS fresh
  FROM screen s LEFT JOIN known k USING (ip) WHERE verdict = 'queued'),
stop AS (SELECT pos FROM cached WHERE NOT fresh ORDER BY pos OFFSET 25 LIMIT 1),
states AS (SELECT ip, CASE WHEN pos >= (SELECT pos FROM stop) THEN 'unchecked' WHEN fresh THEN 'cached'
  ELSE 'refresh' END AS state FROM cached)"""

# 36 hours: 72 half hours are too many for 60 buckets, 36 hours fit.
_HIST = """span AS (SELECT CAST(epoch(min(ts)) AS BIGINT) AS lo, CAST(epoch(max(ts)) AS BIGINT) AS hi FROM w),
  step AS (SELECT min(s) AS s, any_value(lo) AS lo, any_value(hi) AS hi FROM span,
    (SELECT unnest([1, 5, 10, 30, 60, 300, 600, 1800, 3600, 10800, 43200, 86400, 604800]) AS s)
    WHERE hi // s - lo // s < 60),
  slots AS (SELECT unnest(generate_series(lo // s, hi // s)) AS i, s FROM step),
  hist AS (SELECT strftime(make_timestamp(slots.i * s * 1000000), '%Y-%m-%d %H:%M') AS t, count(w.ts) AS count
    FROM slots LEFT JOIN w ON CAST(epoch(w.ts) AS BIGINT) // s = slots.i GROUP BY slots.i, s)"""


def _stats_sections() -> str:
    def rank(name, field, extra="true", measure="count(*)", value="count", tie=None,
             blanks="label NOT IN ('', '-')", n=TOP):
        return f"""SELECT '{name}' AS section, CAST(label AS VARCHAR) AS label, CAST({value} AS DOUBLE) AS value, share FROM (
          WITH {_ranking(field, n, extra, measure, tie, blanks)} SELECT * FROM shown)"""
    num = ["total_events", "unique_ips", "unique_user_agents", "unique_urls", "unique_domains", "total_bytes"]
    none = "CAST(NULL AS DOUBLE)"
    parts = [f"SELECT 'summary' AS section, '{c}' AS label, CAST({c} AS DOUBLE) AS value, {none} AS share FROM summ" for c in num]
    parts.append(f"SELECT 'summary', 'total_gb', round_even(total_bytes / 1073741824, 3), {none} FROM summ")
    parts += [f"SELECT 'summary', '{c}=' || strftime({c}, '%Y-%m-%d %H:%M:%S'), {none}, {none} FROM summ"
              for c in ("first_seen", "last_seen")]
    parts.append("SELECT 'status_classes', label, CAST(count AS DOUBLE), share FROM classes")
    parts += [rank("top_ips", "ip", tie=_ipnum("label")), rank("top_user_agents", "ua"), rank("top_urls", "url"),
              rank("top_domains", "domain"), rank("top_referrers", "referrer", "length(referrer) <= 2048"),
              rank("top_methods", "method"),
              rank("top_ip_bytes", "ip", measure="sum(bytes)", value="round_even(count / 1048576, 2)", tie=_ipnum("label")),
              rank("top_status", "status", blanks="true")]
    parts.append(f"SELECT 'traffic', t, CAST(count AS DOUBLE), {none} FROM hist")
    return " UNION ALL ".join(parts)


_SUMM = """summ AS (SELECT count(*) AS total_events, count(DISTINCT ip) AS unique_ips, count(DISTINCT ua) AS unique_user_agents,
  count(DISTINCT url) AS unique_urls, count(DISTINCT domain) AS unique_domains, CAST(sum(bytes) AS BIGINT) AS total_bytes,
  min(ts) AS first_seen, max(ts) AS last_seen FROM w)"""
_CLASSES = """classes AS (SELECT label, cls, count(*) FILTER (status BETWEEN lo AND hi) AS count,
  round_even(100 * count(*) FILTER (status BETWEEN lo AND hi) / count(*), 1) AS share
  FROM w, (VALUES ('2xx Success', 'success', 200, 299), ('3xx Redirect', 'redirect', 300, 399),
    ('4xx Client error', 'client_error', 400, 499), ('5xx Server error', 'server_error', 500, 599)) v(label, cls, lo, hi)
  GROUP BY label, cls)"""
_NET = "'203.0.113.'"


def oracle_sql() -> dict[str, str]:
    o: dict[str, str] = {}
    o["scan_log_text"] = _with(LINES, "SELECT line FROM lines")
    o["detect_format"] = _with(LOG, """SELECT DISTINCT src_file, CASE WHEN src_file IN ('access-0.log', 'access-1.log')
      THEN 'iis' ELSE 'combined' END AS fmt FROM w UNION ALL SELECT DISTINCT 'c-' || src_file, 'combined' FROM w""")
    o["parse_combined"] = _with(PARSED, "SELECT * EXCLUDE (block_start) FROM p")
    o["domain_of"] = _with(PARSED, "SELECT domain, count(*) AS n FROM p GROUP BY domain")
    url = f"""CASE WHEN {_w3c('cs-uri-query', _q('-'))} IN ('', '-') THEN {_w3c('cs-uri-stem', _q('-'))}
      ELSE ({_w3c('cs-uri-stem', _q('-'))}) || '?' || ({_w3c('cs-uri-query', _q('-'))}) END"""
    ref = f"replace({_w3c('cs(Referer)', _q(''))}, '+', ' ')"
    o["parse_iis"] = _with(W3C, f"""SELECT try_strptime(f[1] || ' ' || f[2], '%Y-%m-%d %H:%M:%S') AS ts,
      {_w3c('c-ip', _q(''))} AS ip, {_w3c('cs-method', _q(''))} AS method, {ref} AS referrer,
      {_w3c_number('sc-status')} AS status, {_w3c_number('sc-bytes')} AS bytes, {url} AS url,
      regexp_extract({ref}, '^[A-Za-z]+://([^/:]+)', 1) AS domain,
      replace({_w3c('cs(User-Agent)', _q(''))}, '+', ' ') AS ua, line AS raw, src_file, seq FROM v
      WHERE try_strptime(f[1] || ' ' || f[2], '%Y-%m-%d %H:%M:%S') IS NOT NULL""")
    o["normalise_event"] = _with(LOG, """SELECT seq, least(4096, length(url) + seq % 100 * 60) AS url_len,
      least(255, length(domain) + seq % 30 * 10) AS domain_len, least(1024, length(ua) + seq % 40 * 30) AS ua_len,
      least(8192, length(raw) + seq % 90 * 100) AS raw_len,
      left(url || repeat('x', CAST(seq % 100 * 60 AS INTEGER)), 40) AS url_head FROM w""")
    o["validate_event"] = _with(PARSED, f"""SELECT CASE WHEN {_BAD_IP} THEN 'bad_ip' ELSE 'ok' END AS verdict,
      count(*) AS n FROM p GROUP BY 1""")
    two = f"""{PARSED}, u AS (SELECT url, {_TAGS} AS tags FROM (SELECT DISTINCT url FROM p)),
      two AS (SELECT CAST(c AS BIGINT) AS case_id, p.* REPLACE (bytes + c - 1 AS bytes), u.tags
              FROM p JOIN u USING (url), (VALUES (1), (2)) v(c))"""
    o["write_events"] = _with(two, f"""SELECT case_id, CASE WHEN {_BAD_IP} THEN 'bad_ip' ELSE 'ok' END AS verdict,
      count(*) AS n, CAST(sum(bytes) AS BIGINT) AS bytes, count(*) FILTER (len(tags) > 0) AS tagged FROM two GROUP BY 1, 2""")
    o["read_case"] = _with(two, f"""SELECT case_id, seq, ts, ip, url, status, bytes, array_to_string(tags, ',') AS tags
      FROM two WHERE case_id = 2 AND NOT {_BAD_IP}""")
    o["ingest_new"] = _with(PARSED, f"""SELECT CAST(3 AS BIGINT) AS case_id, method, status, count(*) AS n, CAST(sum(bytes) AS BIGINT) AS bytes
      FROM p WHERE NOT {_BAD_IP} GROUP BY method, status""")
    o["sample_raw_lines"] = _with(LOG, "SELECT least(1000, count(*)) AS n FROM w WHERE raw <> ''")

    o["filter_ip"] = _with(LOG, f"""SELECT 'ip' AS scope, seq, ip FROM w WHERE ip = '{LEAD_IP}' UNION ALL
      SELECT 'cidr', seq, ip FROM w WHERE ip LIKE '203.0.113.%' AND CAST(split_part(ip, '.', 4) AS INT) < 16""")
    o["filter_time"] = _with(LOG, """SELECT seq, ts FROM w WHERE ts >= TIMESTAMP '2024-01-01 20:00:00'
      AND ts <= TIMESTAMP '2024-01-01 20:59:59'""")
    o["filter_status_in"] = _with(LOG, "SELECT seq, CAST(status AS BIGINT) AS status FROM w WHERE status IN (401, 403)")
    o["filter_method_in"] = _with(LOG, f"SELECT seq, method FROM w WHERE method IN ({_list(UNCOMMON_METHODS)})")
    o["drop_blank_terms"] = _with(f"{LOG}, {_ranking('ua', 5)}", "SELECT label, count FROM shown")
    o["tag_url"] = _with(TAGGED, "SELECT seq, array_to_string(tags, ',') AS tags FROM t")
    o["is_scanner_ua"] = _with(LOG, f"SELECT seq, ua, {_scanner('ua')} AS scanner FROM w")
    o["classify_phase"] = _with(SESS, """SELECT phase, count(*) AS n, CAST(sum(event_count) AS BIGINT) AS events
      FROM s GROUP BY phase""")
    o["classify_status"] = _with(f"{LOG}, {_CLASSES}", "SELECT * FROM classes")
    o["with_pct"] = _with(f"{LOG}, {_ranking('status', 1000, blanks='true')}",
                          "SELECT CAST(label AS BIGINT) AS label, count, pct, share FROM shown")
    o["is_non_global_ip"] = _with(PARSED, f"""SELECT ip, count(*) AS n, CASE WHEN {_BAD_IP} THEN NULL ELSE
      ip LIKE '203.0.113.%' OR ip LIKE '198.51.100.%' OR ip LIKE '10.%' END AS non_global FROM p GROUP BY ip""")
    logged = "regexp_extract(line, '\\[([^\\]]+)\\]', 1)"
    o["has_tz_offset"] = _with(LINES, f"SELECT seq, {logged} LIKE '%+0000' AS \"offset\" FROM lines")
    o["parse_ts_kind"] = _with(LINES, f"""SELECT seq, try_strptime(split_part({logged}, ' ', 1), '%d/%b/%Y:%H:%M:%S') AS clf,
      ts AS epoch, ts AS iso, ts AS iis FROM lines JOIN (SELECT seq, ts FROM w) USING (seq)""")
    o["is_populated"] = _with(LOG, "SELECT referrer NOT IN ('', '-') AS filled, count(*) AS n FROM w GROUP BY 1")
    o["reputation_band"] = _with(LOG, """SELECT seq, seq * 7 % 101 AS score, CASE WHEN seq * 7 % 101 >= 80 THEN 'bad'
      WHEN seq * 7 % 101 >= 25 THEN 'warn' ELSE 'ok' END AS band FROM w""")

    o["find_signatures"] = _with(f"{TAGGED}, {_hits(_SIGN)}", "SELECT * FROM hits")
    o["find_scanner_ua"] = _with(f"{TAGGED}, {_hits(_SCAN)}", "SELECT * FROM hits")
    o["find_dangerous_method"] = _with(f"{TAGGED}, {_hits(_METH)}", "SELECT * FROM hits")
    created = ", TIMESTAMP '2024-01-03 00:00:00' AS created_at"
    o["find_brute_force"] = _with(f"{LOG}, {_BRUTE}", F_BRUTE.replace(
        " FROM brute", f", worst || ' refused logins (401/403) within 5 minutes' AS description{created} FROM brute"))
    o["find_enum_404"] = _with(f"{LOG}, {_MISS}", F_MISS.replace(
        " FROM miss", f", n || ' responses were 404: path enumeration' AS description{created} FROM miss"))
    o["find_enum_404_ratio"] = _with(LOG, f"""SELECT CAST(0 AS BIGINT) AS case_id, 'enumeration_404_ratio' AS rule,
      'medium' AS severity, k || ' of ' || n || ' responses were 404' AS description, ip AS source_ip, k AS count,
      '' AS sample, f AS first_seen, l AS last_seen{created} FROM (SELECT ip, count(*) AS n,
      count(*) FILTER (status = 404) AS k, min(ts) AS f, max(ts) AS l FROM w GROUP BY ip) WHERE n >= 30 AND k / n > 0.05""")
    o["find_exfil_bytes"] = _with(f"{LOG}, {_FLEET}", F_EXFIL)
    o["find_rare_ua"] = _with(f"{LOG}, {_RARE}", F_RARE)
    o["find_traffic_spike"] = _with(f"{LOG}, {_HOURS}", F_SPIKE)
    o["all_findings"] = _with(ALL, "SELECT * FROM found")
    o["findings_by_severity"] = _with(ALL, "SELECT severity, count(*) AS count FROM found GROUP BY severity")
    o["list_findings"] = _with(ALL, """SELECT * FROM found ORDER BY rule, source_ip NULLS FIRST, sample,
      first_seen NULLS FIRST LIMIT 100""")
    o["case_rollup"] = _with(ALL, """SELECT coalesce(a.case_id, b.case_id) AS case_id, coalesce(logs, 0) AS logs,
      coalesce(findings, 0) AS findings FROM (SELECT seq % 3 AS case_id, count(*) AS logs FROM w GROUP BY 1) a
      FULL JOIN (SELECT CAST(c AS BIGINT) AS case_id, count(*) AS findings FROM found, (VALUES (2), (9)) v(c) GROUP BY 1) b
      ON a.case_id = b.case_id""")

    marks = f"""{LOG}, i0 AS (SELECT CASE seq % 5 WHEN 0 THEN upper(split_part(url, '?', 1)) WHEN 1 THEN right(url, seq % 9 + 2)
        WHEN 2 THEN '/lab-' || seq ELSE left(url, seq % 11 + 1) END AS t FROM w),
      ind AS (SELECT lower(t) AS folded, min(t) AS indicator FROM i0 WHERE trim(t) <> '' GROUP BY lower(t)),
      us AS (SELECT url, count(*) AS requests FROM w GROUP BY url),
      im AS (SELECT url, indicator, requests FROM us JOIN ind ON contains(lower(url), folded))"""
    o["match_indicators"] = _with(marks, "SELECT * FROM im")
    o["find_indicators"] = _with(marks, """SELECT indicator, ip AS source_ip, count(*) AS count, min(ts) AS first_seen, max(ts) AS last_seen
      FROM w JOIN im USING (url) GROUP BY indicator, ip""")
    rhythm = f"""{LOG}, step AS (SELECT ip, ts, CAST(epoch_ms(ts) - lag(epoch_ms(ts)) OVER (PARTITION BY ip ORDER BY ts, seq) AS HUGEINT) AS gap FROM w),
      tempo AS (SELECT ip, count(*) AS requests, min(ts) AS first_seen, max(ts) AS last_seen, round(sum(gap) / 1000 / (count(*) - 1), 6) AS mean_gap,
        round(sqrt(CAST((count(*) - 1) * sum(gap * gap) - sum(gap) * sum(gap) AS DOUBLE)) / nullif(sum(gap), 0), 6) AS variation
        FROM step GROUP BY ip HAVING count(*) >= 3)"""
    o["interval_profile"] = _with(rhythm, "SELECT * FROM tempo")
    o["find_beacons"] = _with(rhythm, f"""SELECT CAST(0 AS BIGINT) AS case_id, 'beacon' AS rule, 'medium' AS severity, ip AS source_ip, requests AS count,
      '' AS sample, first_seen, last_seen FROM tempo WHERE requests >= 20 AND variation <= 0.95 AND mean_gap >= 1""")
    hours = f"""{LOG}, ih AS (SELECT ip, extract(hour FROM ts) AS h, count(*) AS n FROM w GROUP BY 1, 2),
      fh AS (SELECT h, CAST(sum(n) AS BIGINT) AS f, sum(sum(n)) OVER () AS total FROM ih GROUP BY h),
      grid AS (SELECT i.ip, fh.h, coalesce(ih.n, 0) AS n, f / total AS share, i.requests FROM
        (SELECT ip, CAST(sum(n) AS BIGINT) AS requests FROM ih GROUP BY ip) i CROSS JOIN fh LEFT JOIN ih ON ih.ip = i.ip AND ih.h = fh.h),
      odd AS (SELECT ip, any_value(requests) AS requests, first(h ORDER BY n DESC, h) AS busiest_hour,
        round(any_value(requests) / (any_value(requests) + 24.0::DOUBLE) * sum(abs(n / requests - share)) / 2, 6) AS distance FROM grid GROUP BY ip)"""
    o["hour_profile"] = _with(hours, "SELECT * FROM odd")
    o["find_odd_hours"] = _with(hours, f"""SELECT CAST(0 AS BIGINT) AS case_id, 'odd_hours' AS rule, 'low' AS severity, ip AS source_ip,
      requests AS count, '' AS sample, {NO_TS} AS first_seen, {NO_TS} AS last_seen FROM odd WHERE distance >= 0.12""")
    dense = f"""{LOG}, pr AS (SELECT unnest(string_split(regexp_extract(url, '\\?([^?]*)$', 1), '&')) AS p FROM w WHERE contains(url, '?')),
      pv AS (SELECT split_part(p, '=', 1) AS name, substr(p, strpos(p, '=') + 1) AS value, count(*) AS requests FROM pr WHERE contains(p, '=')
        GROUP BY 1, 2 HAVING value <> ''),
      ch AS (SELECT name, value, c, count(*) AS k FROM (SELECT name, value, unnest(string_split(value, '')) AS c FROM pv) GROUP BY 1, 2, 3),
      en AS (SELECT name, value, round(log2(sum(k)) - sum(k * log2(k)) / sum(k), 6) AS entropy FROM ch GROUP BY 1, 2),
      ev AS (SELECT name, value, requests, entropy FROM pv JOIN en USING (name, value))"""
    o["parameter_entropy"] = _with(dense, "SELECT * FROM ev")
    quarts = "quantile_disc(entropy, 0.5) + 0.5 * (quantile_disc(entropy, 0.75) - quantile_disc(entropy, 0.25))"
    o["find_dense_parameters"] = _with(f"""{dense}, own AS (SELECT name, {quarts} AS b FROM ev GROUP BY name HAVING count(*) >= 20)""",
      f"""SELECT name, value, requests, entropy, round(coalesce(b, (SELECT {quarts} FROM ev)), 6) AS bound FROM ev LEFT JOIN own USING (name)
      WHERE entropy > coalesce(b, (SELECT {quarts} FROM ev))""")
    o["event_order"] = _with(LOG, "SELECT ts, seq, url FROM w")
    o["sessionize"] = _with(SESS, """SELECT e.seq, e.session_no, s."start" AS session_start, s."end" AS session_end
      FROM e JOIN s USING (ip, ua, session_no)""")
    o["session_rollup"] = _with(SESS, "SELECT * EXCLUDE (phase) FROM s")
    o["session_phase"] = _with(SESS, "SELECT ip, ua, session_no, phase FROM s")
    o["session_samples"] = _with(f"""{SESS}, n1 AS (SELECT *, row_number() OVER (PARTITION BY ip, ua, session_no
        ORDER BY ts, src_file, block_start, seq) AS rn FROM e),
      n2 AS (SELECT *, row_number() OVER (PARTITION BY ip, ua, session_no ORDER BY rn) AS k FROM n1
        WHERE rn <= 3 OR len(tags) > 0)""", """SELECT ip, ua, session_no, k - 1 AS place, ts, method, url,
      CAST(status AS BIGINT) AS status, array_to_string(tags, ',') AS tags FROM n2 WHERE k <= 10""")
    o["timeline"] = _with(f"""{SESS}, n1 AS (SELECT ip, ua, session_no, len(tags) > 0 AS hit, row_number() OVER (
        PARTITION BY ip, ua, session_no ORDER BY ts, src_file, block_start, seq) AS rn FROM e),
      n2 AS (SELECT ip, ua, session_no, least(10, count(*)) AS samples FROM n1 WHERE rn <= 3 OR hit GROUP BY 1, 2, 3)""",
      "SELECT * FROM s JOIN n2 USING (ip, ua, session_no) WHERE phase <> 'benign'")
    o["attack_chains"] = _with(f"""{SESS}, f AS (SELECT ip, phase, min("start") AS first, count(*) AS n FROM s
      WHERE phase <> 'benign' GROUP BY ip, phase)""", f"""SELECT ip, min(first) AS first_seen,
      string_agg(phase, ',' ORDER BY first, {_RANKS}) AS phases, CAST(sum(n) AS BIGINT) AS sessions FROM f GROUP BY ip""")
    near = f"starts_with(ip, {_NET})"
    o["pivot_ip"] = _with(f"""{ALL}, {_sessions()}""", f"""SELECT *, ip = '{LEAD_IP}' AS same_ip FROM (
      SELECT seq % 3 AS case_id, 'events' AS source, ip, count(*) AS count, min(ts) AS first_seen, max(ts) AS last_seen
        FROM w WHERE {near} GROUP BY ip, seq % 3
      UNION ALL SELECT 0, 'sessions', ip, count(*), min("start"), max("end") FROM s WHERE {near} GROUP BY ip
      UNION ALL SELECT c, 'findings', source_ip, count(*), min(first_seen), max(last_seen) FROM found, (VALUES (2), (9)) v(c)
        WHERE starts_with(source_ip, {_NET}) GROUP BY source_ip, c)""")
    o["nearest_findings"] = _with(f"""{TAGGED}, {_hits(_SIGN)},
      m0 AS (SELECT rule, source_ip, unnest([first_seen, last_seen]) AS moment FROM hits WHERE severity = 'critical'),
      m1 AS (SELECT CAST(epoch(moment) AS BIGINT) AS sec, rule, source_ip FROM m0 WHERE moment IS NOT NULL),
      m AS (SELECT * FROM m1 QUALIFY row_number() OVER (PARTITION BY sec ORDER BY rule, source_ip) = 1),
      e AS (SELECT seq, CAST(epoch(ts) AS BIGINT) AS s FROM w)""", """
      SELECT seq, 'before' AS side, make_timestamp(sec * 1000000) AS moment, s - sec AS seconds, rule, source_ip FROM e JOIN m
        ON sec BETWEEN s - 60 AND s QUALIFY row_number() OVER (PARTITION BY seq ORDER BY sec DESC) = 1
      UNION ALL SELECT seq, 'after', make_timestamp(sec * 1000000), sec - s, rule, source_ip FROM e JOIN m
        ON sec BETWEEN s AND s + 60 QUALIFY row_number() OVER (PARTITION BY seq ORDER BY sec) = 1""")
    opens = f"""{LOG}, a AS (SELECT *, split_part(url, '?', 1) AS path FROM w),
      lost AS (SELECT path, count(*) AS misses, min(ts) AS first_miss, max(ts) AS last_miss FROM a WHERE status = 404 GROUP BY path),
      hit AS (SELECT a.*, misses, first_miss, last_miss FROM a JOIN lost USING (path) WHERE status BETWEEN 200 AND 299 AND ts > last_miss),
      opened AS (SELECT path, any_value(misses) AS misses, any_value(first_miss) AS first_miss, any_value(last_miss) AS last_miss,
        min(ts) AS opened_at, first(ip ORDER BY ts, src_file, block_start, seq) AS opened_by,
        first(method ORDER BY ts, src_file, block_start, seq) AS opened_with, count(*) AS hits,
        count(*) FILTER (method = 'POST') AS posts FROM hit GROUP BY path)"""
    o["path_openings"] = _with(opens, "SELECT * FROM opened")
    o["touched_before_opening"] = _with(opens, """SELECT path, ip, count(*) AS count, min(ts) AS first_seen, max(ts) AS last_seen
      FROM a JOIN opened USING (path) WHERE ts < opened_at GROUP BY path, ip""")
    nets = f"""{LOG}, net0 AS (SELECT CASE seq % 4 WHEN 0 THEN '203.0.113.' || (seq % 256) WHEN 1 THEN '8.8.' || (seq % 8) || '.' || (seq % 256)
        WHEN 2 THEN '198.51.' || (seq % 128) || '.' || (seq * 3 % 256)
        ELSE (seq * 7 % 256) || '.' || (seq % 256) || '.' || (seq * 3 % 256) || '.' || (seq * 5 % 256) END AS a,
        8 + seq % 25 AS len, 'owner-' || seq AS owner FROM w),
      net AS (SELECT a || '/' || len AS network, owner, len, ({_ipnum('a')}) >> (32 - len)::INT AS head FROM net0),
      ips AS (SELECT DISTINCT ip, {_ipnum('ip')} AS v FROM w),
      best AS (SELECT ip, network, owner FROM ips JOIN net ON v >> (32 - len)::INT = head
        QUALIFY row_number() OVER (PARTITION BY ip ORDER BY len DESC, network, owner) = 1)"""
    o["longest_networks"] = _with(nets, "SELECT * FROM best")
    o["tag_networks"] = _with(nets, "SELECT network, owner, count(*) AS requests FROM w LEFT JOIN best USING (ip) GROUP BY network, owner")
    o["events_in_networks"] = _with(nets, """SELECT seq, ip FROM w WHERE ip IN (SELECT ip FROM ips JOIN net ON v >> (32 - len)::INT = head
      WHERE len IN (30, 31))""")
    o["pivot_ua"] = _with(LOG, """SELECT ua, ip, count(*) AS count, min(ts) AS first_seen, max(ts) AS last_seen
      FROM w GROUP BY ua, ip""")
    o["shared_clients"] = _with(LOG, "SELECT ua, count(DISTINCT ip) AS n_ips, count(*) AS count FROM w GROUP BY ua")
    o["pivot_url"] = _with(LOG, """SELECT ts, ip, method, CAST(status AS BIGINT) AS status, url, seq FROM w
      WHERE url = '/img/c99.php' OR starts_with(url, '/img/c99.php?')""")
    o["pivot_time"] = _with(f"""{LOG}, {_BRUTE}, moments AS (SELECT DISTINCT ts FROM w WHERE status IN (401, 403)
        AND ip IN (SELECT ip FROM brute WHERE worst >= {BRUTE})),
      gap AS (SELECT ts, CASE WHEN ts - lag(ts) OVER (ORDER BY ts) <= INTERVAL 120 SECOND THEN 0 ELSE 1 END AS o FROM moments),
      grp AS (SELECT ts, sum(o) OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM gap),
      win AS (SELECT min(ts) - INTERVAL 60 SECOND AS lo, max(ts) + INTERVAL 60 SECOND AS hi FROM grp GROUP BY g)""",
      "SELECT seq, lo AS window_start, hi AS window_end FROM w JOIN win ON ts BETWEEN lo AND hi")
    o["pivot_referrer"] = _with(LOG, "SELECT referrer, count(*) AS count FROM w WHERE method = 'POST' GROUP BY referrer")
    o["phase_transition"] = _with(f"""{SESS}, net AS (SELECT e.ip, e.ua, e.session_no, e.url, min(e.status) AS best,
        any_value(s."start") AS s_start, any_value(s."end") AS s_end, any_value(s.scanner_ua) AS scanner,
        regexp_extract(e.ip, '^(.*)\\.[0-9]+$', 1) AS net
        FROM e JOIN s USING (ip, ua, session_no) GROUP BY e.ip, e.ua, e.session_no, e.url),
      hit AS (SELECT net, url, min(s_end) AS scan_end FROM net WHERE scanner AND best < 400 GROUP BY net, url)""",
      """SELECT ip, ua, session_no, any_value(s_start) AS session_start, count(*) AS shared_urls,
      min(scan_end) AS first_scan_end FROM net JOIN hit USING (net, url) WHERE NOT scanner AND s_start > scan_end
      GROUP BY ip, ua, session_no""")

    o["stream_session_phase"] = _with(SESS, "SELECT * EXCLUDE (session_no, scanner_ua) FROM s")
    totals = "count(*) AS total_events, CAST(sum(bytes) AS BIGINT) AS total_bytes, min(ts) AS first_seen, max(ts) AS last_seen"
    o["sketched_summary"] = _with(LOG, f"""SELECT {totals}, true AS unique_ips, true AS unique_user_agents, true AS unique_urls,
      true AS unique_domains FROM w""")
    o["sketched_period"] = _with(LOG, f"SELECT {totals} FROM w WHERE CAST(ts AS DATE) = DATE '2024-01-01'")
    o["sketched_top"] = _with(LOG, """SELECT url AS label, count(*) AS count, 'url' AS field FROM w GROUP BY url UNION ALL
      SELECT ip, count(*), 'ip' FROM w WHERE ts < TIMESTAMP '2024-01-02' GROUP BY ip""")
    o["stats_summary"] = _with(f"{LOG}, {_SUMM}", "SELECT * FROM summ")
    for name, field, tie in (("top_ips", "ip", _ipnum("label")), ("top_user_agents", "ua", None),
                             ("top_urls", "url", None), ("top_domains", "domain", None),
                             ("top_referrers", "referrer", None), ("top_methods", "method", None)):
        o[name] = _with(f"{LOG}, {_ranking(field, TOP, tie=tie)}", "SELECT * FROM shown")
    o["top_status"] = _with(f"{LOG}, {_ranking('status', 3, blanks='true')}",
                            "SELECT CAST(label AS BIGINT) AS label, count, pct, share FROM shown")
    o["status_classes"] = o["classify_status"]
    o["top_ip_bytes"] = _with(f"{LOG}, {_ranking('ip', TOP, measure='sum(bytes)', tie=_ipnum('label'))}",
                              "SELECT * FROM shown")
    o["traffic_histogram"] = _with(f"{LOG}, {_HIST}", "SELECT t, count FROM hist")
    o["traffic_peak"] = _with(f"{LOG}, {_HIST}", "SELECT t, count FROM hist ORDER BY count DESC, t LIMIT 1")

    names = [r[0] for r in CATALOGUES["apache"]]
    o["tokenize_clf"] = _with(f"{LINES}, {_clf('lines')}",
                              f"SELECT src_file, seq, {', '.join(_quoted(n) for n in names)} FROM c")
    o["tokenize_alb"] = _with(LOG, """SELECT src_file, seq, 'https' AS type, strftime(ts, '%Y-%m-%dT%H:%M:%S')
        || CASE WHEN seq % 19 = 0 THEN '' ELSE 'Z' END AS "timestamp", 'app/lb/1' AS elb, ip AS client_ip,
      '10.0.1.20:80' AS target_ip, '0.001' AS request_time, '0.002' AS target_time, CAST(status AS VARCHAR) AS elb_status,
      CAST(status AS VARCHAR) AS target_status, '512' AS received_bytes, CAST(bytes AS VARCHAR) AS sent_bytes,
      method || ' https://shop.example.com:443' || url || ' HTTP/1.1' AS request, ua AS user_agent,
      CASE WHEN seq % 13 <> 0 THEN 'ECDHE-RSA' END AS ssl_cipher, CASE WHEN seq % 13 <> 0 THEN 'TLSv1.2' END AS ssl_protocol
      FROM w WHERE seq % 71 <> 0""")
    o["tokenize_haproxy"] = _with(LOG, """SELECT src_file, seq, ip AS client_ip,
      strftime(ts, '%d/%b/%Y:%H:%M:%S') || '.000' AS accept_date, 'http-in' AS frontend, 'static/srv1' AS backend,
      '10/0/30/69/109' AS timers, CAST(status AS VARCHAR) AS status, CAST(bytes AS VARCHAR) AS bytes,
      method || ' ' || url || ' HTTP/1.1' AS request FROM w WHERE seq % 67 <> 0""")
    o["tokenize_squid"] = _with(f"{LOG}, {_SQUID}", "SELECT * EXCLUDE (block_start, fits) FROM sq")
    o["tokenize_iis"] = _with(f"{W3C}, {_IIS_TOK}", "SELECT * EXCLUDE (block_start) FROM it")
    three = f"{_TWO}, {_SQUID}, fld AS ({_FIELDS[8:-1]} UNION ALL {_present('squid', 'sq', 'sq', _quoted)})"
    o["field_presence"] = _with(three, f"{_SHOW} FROM fld")
    o["field_notes"] = _with(f"{_TWO}, {_FIELDS}", f"SELECT key, note, server FROM ({_SHOW} FROM fld) WHERE note <> ''")
    o["field_catalog"] = _with(f"{_TWO}, {_FIELDS}", "SELECT key, label, category, s > 0 AS present FROM fld WHERE server = 'apache'")
    o["profile_summary"] = _with(f"{_TWO}, {_FIELDS}", """SELECT CASE server WHEN 'apache' THEN 'Apache httpd'
        ELSE 'Microsoft IIS (W3C)' END AS server_label,
      CASE server WHEN 'apache' THEN (SELECT count(*) FROM lines) ELSE any_value(n) END AS sampled, any_value(n) AS parsed,
      round_even(any_value(n) / CASE server WHEN 'apache' THEN (SELECT count(*) FROM lines) ELSE any_value(n) END, 3) AS parse_rate,
      count(*) FILTER (s > 0) AS present_count, count(*) FILTER (s = 0) AS missing_count,
      count(*) FILTER (s > 0 AND category = 'core') AS core_present, count(*) FILTER (category = 'core') AS core_total,
      count(*) FILTER (s > 0 AND category = 'recommended') AS recommended_present,
      count(*) FILTER (category = 'recommended') AS recommended_total,
      coalesce(string_agg(label, ',' ORDER BY place) FILTER (s = 0 AND category = 'core'), '') AS core_missing, server
      FROM fld GROUP BY server""")
    for check, body in _CHECKS.items():
        o[f"chk_{check}"] = _with(_BROKEN, body)
    utc = "SELECT 'timezone_is_utc' AS \"check\", 'info' AS severity, '' AS examples"
    private = f"""SELECT 'private_client_ip' AS "check", CASE WHEN avg(private::INT) > 0.5 THEN 'high' ELSE 'medium' END AS severity,
      (SELECT string_agg(ip, ',' {_ORDER}) FROM (SELECT * FROM pr WHERE private {_ORDER} LIMIT 5)) AS examples FROM pr"""
    cip = _w3c("c-ip", _q("-"))
    pr = f"""pr AS (SELECT *, {cip} AS ip, ({cip} LIKE '203.0.113.%' OR {cip} LIKE '198.51.100.%') AS private FROM v
      WHERE {cip} NOT IN ('', '-'))"""
    o["chk_timezone_is_utc"] = _with(W3C, f"{utc} FROM v LIMIT 1")
    o["chk_non_chronological"] = _with(f"{LINES}, {_clf('lines')}, {_BACK}",
                                       "SELECT count(*) FILTER (fall > INTERVAL 1 HOUR) AS backward FROM steps")
    o["chk_query_string_empty"] = _with(LOG, """SELECT 'query_string_empty' AS "check", 'medium' AS severity, '' AS examples FROM (
      SELECT count(*) AS n, count(*) FILTER (contains(split_part(url, '?', 1), '?')) AS filled FROM w) WHERE n > 0 AND filled = 0""")
    late = "SELECT 'non_chronological', 'medium', '' WHERE (SELECT count(*) FROM {} WHERE fall > INTERVAL 1 HOUR) > 0"
    iis_steps = """istep AS (SELECT lag(m) OVER (PARTITION BY src_file ORDER BY block_start, seq) - m AS fall FROM (
      SELECT *, try_strptime(f[1] || ' ' || f[2], '%Y-%m-%d %H:%M:%S') AS m FROM v) WHERE m IS NOT NULL)"""
    apache = " UNION ALL ".join(_CHECKS.values())
    o["discrepancies"] = _with(f"{_BROKEN}, {_BACK}, " + W3C[len(LOG) + 1:] + f", {pr}, {iis_steps}", f"""
      SELECT *, 'apache' AS server FROM ({apache} UNION ALL {late.format('steps')})
      UNION ALL SELECT *, 'iis' FROM ({utc} FROM (SELECT count(*) AS n FROM v) WHERE n > 0 UNION ALL {late.format('istep')} UNION ALL {private})""")

    o["write_findings"] = _with(ALL, f"""SELECT CAST(1 AS BIGINT) AS case_id, rule, count(*) AS n,
      CAST(sum(count) AS BIGINT) AS hits FROM found GROUP BY rule UNION ALL
      SELECT 2, rule, count(*), CAST(sum(count) AS BIGINT) FROM found WHERE rule = 'enumeration_404' GROUP BY rule""")
    o["export_timeline"] = _with(SESS, """SELECT strftime("start", '%Y-%m-%dT%H:%M:%SZ') AS "start",
      strftime("end", '%Y-%m-%dT%H:%M:%SZ') AS "end", ip, phase, CAST(event_count AS VARCHAR) AS events,
      CAST(n404 AS VARCHAR) AS n404, CAST(bytes_out AS VARCHAR) AS bytes_out, replace(tags, ',', '|') AS tags,
      ua AS user_agent FROM s WHERE phase <> 'benign'""")
    o["export_statistics"] = _with(f"{LOG}, {_SUMM}, {_CLASSES}, {_HIST}", _stats_sections())

    o["case_source_ips"] = _with(LOG, f"SELECT ip, count(*) AS count FROM w GROUP BY ip")
    o["screen_ips"] = _with(CAND, "SELECT ip, verdict FROM screen")
    o["reputation_cached"] = _with(CAND, "SELECT ip, fresh, abuse_score FROM cached")
    o["reputation_to_refresh"] = _with(CAND, "SELECT ip, state FROM states")
    o["reputation_upsert"] = _with(CAND, f"""SELECT ip, abuse_score, checked_at FROM (SELECT *, row_number() OVER (
        PARTITION BY ip ORDER BY checked_at DESC, fresh_row DESC) AS rn FROM (
        SELECT ip, abuse_score, checked_at, 0 AS fresh_row FROM ({_reputation('SELECT ip, seq FROM w')}) UNION ALL
        SELECT ip, abuse_score + 1, checked_at, 1 FROM known)) WHERE rn = 1""")
    o["reputation_report"] = _with(CAND, """SELECT ip, abuse_score, CASE WHEN abuse_score >= 80 THEN 'bad'
      WHEN abuse_score >= 25 THEN 'warn' ELSE 'ok' END AS band FROM cached WHERE fresh""")
    o["reputation_counts"] = _with(CAND, """SELECT count(*) FILTER (state <> 'unchecked') AS checked,
      count(*) FILTER (state = 'cached') AS cache_hits, count(*) FILTER (state = 'refresh') AS api_calls,
      count(*) FILTER (state = 'unchecked') AS unchecked,
      (SELECT count(*) FROM screen WHERE verdict <> 'queued') AS skipped FROM states""")
    return o
