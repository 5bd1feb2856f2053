"""Rule table: dialect, positives, negatives, and the guard in front of it."""
import random
import re
import re._parser as regex_parser

import duckdb
import pytest
from pyspark.sql import functions as F

from spoor.functions.text import is_scanner_ua, is_suspect, tag_url
from spoor.rules import DEFAULT_RULES, SEVERITIES, RuleSet

POSITIVES = [
    ("/items?cat=7'+and+3=3--", "sqli"),
    ("/shop?sku=9+UNION+ALL+SELECT+null,version()", "sqli"),
    ("/wait?n=pg_sleep(9)", "sqli"),
    ("/find?age[$gt]=0", "nosqli"),
    ("/find?name[$regex]=.*", "nosqli"),
    ("/tools/trace?target=a|cat+/etc/hosts", "command_injection"),
    ("/run?c=`id`", "command_injection"),
    ("/run?c=$(mkfifo+q)", "command_injection"),
    ("/run?c=1;uname", "command_injection"),
    ("/up/a.php?cmd=whoami", "webshell"),
    ("/list?id=4+or+1=1", "sqli"),
    ("/cgi-bin/t?h=()%20{%20_;}", "shellshock"),
    ("/card?to={{9*9}}", "ssti"),
    ("/mail?subject=${T(java.lang.Runtime)}", "ssti"),
    ("/people?cn=*)(objectClass=*", "ldap_injection"),
    ("/people?cn=*)(|(mail=*", "ldap_injection"),
    ("/tree?n=' or name()='x", "xpath_injection"),
    ("/note?body=<img+src=q+onerror=print()>", "xss"),
    ("/note?u=javascript:alert(2)", "xss"),
    ("/get?doc=..%2f..%2f..%2fetc%2fshadow", "lfi_traversal"),
    ("/get?doc=....//....//boot.ini", "lfi_traversal"),
    ("/view?tpl=https://files.example/a.txt?", "rfi"),
    ("/view?inc=php://input", "rfi"),
    ("/proxy?target=http://127.0.0.1:8500/v1/kv", "ssrf"),
    ("/proxy?target=gopher://10.0.0.9:70/", "ssrf"),
    ("/xml?b=<!DOCTYPE+a+[<!ENTITY+b+SYSTEM+'file:///etc/hosts'>]>", "xxe"),
    ("/state?v=rO0ABXNy", "deserialization"),
    ("/state?v=a:2:{s:4:%22user%22", "deserialization"),
    ("/img/c99.php", "webshell"),
    ("/q?ua=${jndi:rmi://lab.example/o}", "log4shell"),
    ("/q?ua=${${lower:j}ndi:dns://lab.example}", "log4shell"),
    ("/save?class.module.classLoader.URLs=1", "spring4shell"),
    ("/go.action?method:%23_memberAccess", "struts_ognl"),
    ("/go?lang=en%0d%0aX-Note:1", "crlf_injection"),
    ("/out?return=//lab.example", "open_redirect"),
    ("/open/..;/admin", "access_bypass"),
    ("/%2e/admin/", "access_bypass"),
    ("/.env", "sensitive_file"),
    ("/backup.sql", "sensitive_file"),
    ("/get?f=a.txt%00", "null_byte"),
    ("/cgi-bin/.%2e/.%2e/bin/sh", "cve_probe"),
    ("/elmah.axd", "iis_aspnet"),
    ("/?rest_route=/wp/v2/posts", "recon_probe"),
]
NEGATIVES = ["", "/about", "/cart?items=3&coupon=SPRING", "/img/a%20b.png", "/js/app.4f2c.js", "/map?lat=51.5&lon=-0.1",
             "/news/2025/12/union-members-select-new-chair", "/help?topic=sleep+well", "/u/anne-marie",
             "/img?w=1&&id=3", "/search?q=for+2=b", "/shop?color+5=1", "/list?langs=java|python|ruby", "/go?next=/basket",
             "/a?tags=cat|dog", "/b?name=O'Brien&city=Cork", "/c?order=by+date"]


def test_sample_log_fires_every_rule(spark):
    from spoor.sources.weblog import PAYLOADS
    rows = spark.createDataFrame([(u,) for u in PAYLOADS], "url string").select(
        tag_url(F.col("url")).alias("tags")).collect()
    assert {t for r in rows[:25] for t in r["tags"]} == set(DEFAULT_RULES.names)
    assert [r["tags"] for r in rows[25:]] == [[], [], []]


def test_table():
    assert len(DEFAULT_RULES.rules) == 25
    assert all(r.severity in SEVERITIES for r in DEFAULT_RULES.rules)
    tagged = DEFAULT_RULES.exploit_tags | DEFAULT_RULES.postexploit_tags | DEFAULT_RULES.recon_tags
    assert tagged == set(DEFAULT_RULES.names)
    with pytest.raises(ValueError):
        RuleSet.from_rows([("a", "high", "x", ""), ("a", "high", "y", "")])
    with pytest.raises(ValueError):
        RuleSet.from_rows([("a", "severe", "x", "")])


def test_patterns_run_in_re2():
    for rule in DEFAULT_RULES.rules:
        duckdb.execute("SELECT regexp_matches('/x', ?, 'i')", [rule.pattern])


def test_tags(spark):
    urls = [u for u, _ in POSITIVES] + NEGATIVES
    rows = spark.createDataFrame([(u,) for u in urls], "url string").select(
        "url", tag_url(F.col("url")).alias("tags")).collect()
    tags = {r["url"]: r["tags"] for r in rows}
    for url, rule in POSITIVES:
        assert rule in tags[url], (url, tags[url])
    for url in NEGATIVES:
        assert tags[url] == [], (url, tags[url])


def test_own_rule_table(spark):
    table = spark.createDataFrame([("beta", "low", "bbb", "b"), ("alpha", "high", "aaa", "a")],
                                  "name string, severity string, pattern string, description string")
    rules = RuleSet.from_table(table)
    assert rules.suspect is None
    row = spark.createDataFrame([("/xAAAbbb",)], "url string").select(
        tag_url(F.col("url"), rules).alias("t")).first()
    assert row["t"] == rules.names


def test_scanner_clients(spark):
    uas = {"sqlmap/1.7#stable": True, "Mozilla/5.0 (compatible; Nuclei)": True,
           "Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36": False, "": False}
    rows = spark.createDataFrame([(u,) for u in uas], "ua string").select(
        "ua", is_scanner_ua(F.col("ua")).alias("s")).collect()
    assert {r["ua"]: r["s"] for r in rows} == uas


def _sample(tree, rng):
    text = ""
    for op, arg in tree:
        op = str(op)
        if op == "LITERAL":
            text += chr(arg)
        elif op in ("NOT_LITERAL", "ANY"):
            text += "a"
        elif op == "IN":
            kind, value = rng.choice(arg)
            if str(arg[0][0]) == "NEGATE":
                text += "a"
            else:
                text += chr(value) if str(kind) == "LITERAL" else chr(rng.randint(*value))
        elif op == "BRANCH":
            text += _sample(rng.choice(arg[1]), rng)
        elif op == "SUBPATTERN":
            text += _sample(arg[3], rng)
        elif op == "MAX_REPEAT":
            low, high, sub = arg
            for _ in range(rng.randint(low, min(high, low + 2))):
                text += _sample(sub, rng)
    return text


def test_guard_passes_whatever_a_rule_matches(spark):
    """Random strings of every rule: none that matches is held back."""
    rng = random.Random(7)
    urls = set()
    for rule in DEFAULT_RULES.rules:
        tree = regex_parser.parse(rule.pattern)
        for _ in range(400):
            text = _sample(tree, rng)
            urls |= {text, f"/a?b={text}c"}
    urls = [u for u in urls if any(re.search(r.pattern, u, re.I | re.A) for r in DEFAULT_RULES.rules)]
    held = spark.createDataFrame([(u,) for u in urls], "url string").filter(
        ~is_suspect(F.col("url"))).collect()
    assert held == []


def test_hostile_urls_and_lines_cost_time_in_proportion(spark):
    from pyspark.sql import functions as F

    from spoor.functions.text import tag_url
    from spoor.operators.tokenize import tokenize
    from spoor.sources.parse import parse_combined
    leads = ["/?q=union", "/?q='", "/?a=;", "/?x={{", "/?y=${", "/?z=<", "/?w=on", "/?v==", "/?u=system"]
    fill = ["+", "%20", "/**/", " ", ".", "'", "(", "{"]
    rows = [(lead + unit * (200_000 // len(unit)),) for lead in leads[:3] for unit in fill]
    rows += [(lead + unit * 5000,) for lead in leads for unit in fill] + [("/?q=union" + "+" * 5000 + "select",)]
    found = spark.createDataFrame(rows, "url string").select("url", F.array_join(tag_url(F.col("url")), ",").alias("t")).collect()
    assert len(found) == len(rows)
    assert "sqli" in [r.t for r in found if r.url.endswith("select")][0].split(",")
    line = '%s9.9.9.9 - - [01/Jan/2024:00:00:00 +0000] "GET /a HTTP/1.1" 200 5 "-" "ua" x\x85y z'
    lines = [line % "", line % "host.example:80 ", "." * 300_000, "a." * 100_000 + " b", ":" * 200_000, line % ("." * 1000 + "a ")]
    df = spark.createDataFrame([("f", 0, i, x) for i, x in enumerate(lines)], "src_file string, block_start long, seq long, line string")
    assert parse_combined(df).count() >= 2
    assert tokenize(df, "apache").filter("f is not null").count() >= 2
