"""Which expected fields a log holds, and whether it is fit as evidence.

One aggregation over the lines yields every count; field rows, the summary and
the checks are projections of that single row. Only the chronology needs the
order of lines, and examples need the first few hits; each is a step of its
own whose work is split by file split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spoor.functions.ip import is_non_global_ip, is_valid_ip
from spoor.functions.logtime import has_tz_offset, parse_ts_kind
from spoor.functions.text import is_populated
from spoor.operators.catalogue import (CATALOGUES, CLIENT_KEY, SERVER_TYPES, TIME_KEY, TIME_KIND,
                                       field_catalog, keys_of)
from spoor.operators.tokenize import tokenize
from spoor.schema import POSITION

BACKSTEP_SECONDS = 3600
PIECE_LINES = 1 << 20      # consecutive lines that one task puts in order
CHECKS = ("low_parse_rate", "missing_timezone", "timezone_is_utc", "inconsistent_datetime",
          "non_chronological", "private_client_ip", "mixed_ip_versions", "query_string_empty",
          "empty_core_field")
_SEVERITY = ("high", "medium", "info")
_EXAMPLES = {"missing_timezone": 3, "inconsistent_datetime": 3, "private_client_ip": 5}


def first_lines(lines: DataFrame, cap: int | None) -> DataFrame:
    """The first ``cap`` non-blank lines in file order, or all of them."""
    if cap is None:
        return lines
    return lines.filter(F.col("line").rlike(r"\S")).orderBy(*POSITION).limit(cap)


def observed(lines: DataFrame, server: str) -> DataFrame:
    """Tokenized lines with client, logged time and parsed time beside them."""
    rows = tokenize(lines, server)
    if server == "iis":
        both = is_populated(F.col("f.date")) & is_populated(F.col("f.time"))
        time = F.when(both, F.concat_ws(" ", "f.date", "f.time"))
    else:
        time = F.col(f"f.{TIME_KEY[server]}")
    client = F.col("f")[CLIENT_KEY[server]]
    return (rows.withColumn("client", F.when(is_populated(client), client))
            .withColumn("logged", F.when(is_populated(time), time))
            .withColumn("moment", parse_ts_kind(TIME_KIND[server], F.col("logged"))))


def _lacks_offset(server: str) -> Column:
    if TIME_KIND[server] == "iis":
        return F.lit(False)
    return F.col("logged").isNotNull() & ~has_tz_offset(F.col("logged"))


def _unparsable() -> Column:
    return F.col("logged").isNotNull() & F.col("moment").isNull()


def _how_many(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def counts(rows: DataFrame, server: str) -> DataFrame:
    """One row with every number the profile needs.

    ``seen``, ``filled`` and ``samples`` hold one entry per catalogue field.
    """
    place = F.struct(*POSITION)
    keys = keys_of(server)
    fields = []
    for i, key in enumerate(keys):
        value = F.col("f")[key]
        filled = is_populated(value)
        fields += [F.count(value).alias(f"s{i}"), _how_many(filled).alias(f"p{i}"),
                   F.min_by(F.when(filled, value), F.when(filled, place)).alias(f"v{i}")]
    parsed = F.count("f")
    sampled = parsed if server == "iis" else F.count("*")
    has_xff = "x_forwarded_for" in keys_of(server)
    forwarded = (F.coalesce(F.bool_or(is_populated(F.col("f.x_forwarded_for"))), F.lit(False))
                 if has_xff else F.lit(False))
    client = F.col("client")
    totals = rows.agg(
        sampled.alias("sampled"), parsed.alias("parsed"), *fields,
        F.count("logged").alias("n_times"), _how_many(_lacks_offset(server)).alias("no_offset"),
        _how_many(_unparsable()).alias("unparsable"), F.count("client").alias("n_clients"),
        _how_many(is_non_global_ip(client)).alias("n_private"), forwarded.alias("forwarded"),
        F.coalesce(F.bool_or(~client.contains(":") & is_valid_ip(client)), F.lit(False)).alias("any_v4"),
        F.coalesce(F.bool_or(client.contains(":")), F.lit(False)).alias("any_v6"))
    lists = [F.array(*[F.col(f"{p}{i}") for i in range(len(keys))]).alias(name)
             for p, name in (("s", "seen"), ("p", "filled"), ("v", "samples"))]
    return totals.select("sampled", "parsed", *lists, "n_times", "no_offset", "unparsable",
                         "n_clients", "n_private", "forwarded", "any_v4", "any_v6")


def _of(numbers: str, place: int) -> Column:
    return F.get(F.col(numbers), F.lit(place))


def _ratio(part: Column, digits: int) -> Column:
    return F.bround(part / F.greatest(F.col("parsed"), F.lit(1)), digits)


def field_presence(totals: DataFrame, server: str) -> DataFrame:
    """One row per catalogue field with its presence, a sample and a note."""
    numbers = totals.select("parsed", F.posexplode(F.arrays_zip("seen", "filled", "samples"))
                            .alias("place", "n"))
    fields = field_catalog(totals.sparkSession).filter(F.col("server_type") == server)
    ratio = _ratio(F.col("n.seen"), 2)
    rows = fields.join(numbers, "place").withColumn("presence_ratio", ratio)
    present, share = F.col("n.seen") > 0, F.col("presence_ratio")
    note = (F.when(present & (F.col("n.filled") == 0), "present but never filled")
            .when((share > 0) & (share < 0.9), "only in some lines").otherwise(""))
    return rows.select("place", "key", "label", "category", "description", "ecs",
                       present.alias("present"), "presence_ratio",
                       _ratio(F.col("n.filled"), 2).alias("populated_ratio"),
                       F.coalesce("n.samples", F.lit("")).alias("sample"), note.alias("note"))


def field_notes(presence: DataFrame) -> DataFrame:
    return presence.filter(F.col("note") != "").select("key", "note")


def profile_summary(totals: DataFrame, server: str) -> DataFrame:
    """Parse rate and how many expected fields are there."""
    rows = list(enumerate(CATALOGUES[server]))

    def present(category=None) -> Column:
        hits = [F.when(_of("seen", i) > 0, 1).otherwise(0) for i, r in rows
                if category in (None, r[2])]
        return sum(hits, F.lit(0)).cast("bigint")

    def total(category) -> Column:
        return F.lit(sum(r[2] == category for _, r in rows)).cast("bigint")

    missing = F.array_compact(F.array(*[F.when(_of("seen", i) == 0, F.lit(r[1]))
                                        for i, r in rows if r[2] == "core"]))
    return totals.select(
        F.lit(server).alias("server_type"), F.lit(SERVER_TYPES[server]).alias("server_label"),
        "sampled", "parsed",
        F.bround(F.col("parsed") / F.greatest(F.col("sampled"), F.lit(1)), 3).alias("parse_rate"),
        present().alias("present_count"),
        (F.lit(len(rows)).cast("bigint") - present()).alias("missing_count"),
        present("core").alias("core_present"), total("core").alias("core_total"),
        present("recommended").alias("recommended_present"),
        total("recommended").alias("recommended_total"), missing.alias("core_missing"))


def backsteps(rows: DataFrame, limit_seconds: int = BACKSTEP_SECONDS) -> DataFrame:
    """One row ``backward``: how often time falls by more than the limit between
    consecutive readable lines of a file.

    Lines are compared inside pieces of a file split, so a file that cannot be
    split is no single task either; of a piece only its first and last time go
    on, and those few rows are compared across borders.
    """
    piece = ["src_file", "block_start", "piece"]
    times = rows.filter("moment is not null").select(
        *POSITION, F.floor(F.col("seq") / PIECE_LINES).alias("piece"), "moment")
    in_block = Window.partitionBy(*piece).orderBy("seq")
    previous = F.lag("moment").over(in_block)
    fall = F.unix_micros("before") - F.unix_micros("moment") > limit_seconds * 1_000_000
    blocks = (times.withColumn("before", previous)
              .groupBy(*piece).agg(
                  F.count_if(fall).alias("inside"),
                  F.min(F.struct("seq", "moment")).alias("first"),
                  F.max(F.struct("seq", "moment")).alias("last")))
    in_file = Window.partitionBy("src_file").orderBy("block_start", "piece")
    drop = (F.unix_micros(F.lag("last.moment").over(in_file))
            - F.unix_micros("first.moment")) > limit_seconds * 1_000_000
    return (blocks.withColumn("border", F.when(drop, 1).otherwise(0))
            .agg(F.coalesce(F.sum(F.col("inside") + F.col("border")), F.lit(0)).alias("backward")))


def examples(rows: DataFrame, server: str) -> DataFrame:
    """``check, examples``: the first values that made a check fire."""
    pairs = F.array(
        F.struct(F.when(_lacks_offset(server), "missing_timezone").alias("check"),
                 F.col("logged").alias("value")),
        F.struct(F.when(_unparsable(), "inconsistent_datetime").alias("check"),
                 F.col("logged").alias("value")),
        F.struct(F.when(is_non_global_ip(F.col("client")), "private_client_ip").alias("check"),
                 F.col("client").alias("value")))
    hits = rows.select(*POSITION, F.inline(pairs)).filter("check is not null")
    first = Window.partitionBy("check").orderBy(*POSITION)
    most = F.lit(max(_EXAMPLES.values()))
    kept = (hits.withColumn("place", F.row_number().over(first)).filter(F.col("place") <= most))
    for check, n in _EXAMPLES.items():
        kept = kept.filter((F.col("check") != check) | (F.col("place") <= n))
    return kept.groupBy("check").agg(F.transform(
        F.sort_array(F.collect_list(F.struct("place", "value"))), lambda e: e["value"])
        .alias("examples"))


def _check(name: str, fires: Column, severity: Column | str, message: Column) -> Column:
    level = F.lit(severity) if isinstance(severity, str) else severity
    return F.when(fires, F.struct(F.lit(CHECKS.index(name)).alias("place"),
                                  F.lit(name).alias("check"), level.alias("severity"),
                                  message.alias("message")))


def _checks(server: str) -> list[Column]:
    c = F.col
    kind = TIME_KIND[server]
    result = []
    if server != "iis":
        rate = c("parsed") / F.greatest(c("sampled"), F.lit(1))
        result.append(_check(
            "low_parse_rate", (c("sampled") > 0) & (rate < 0.8), "high",
            F.format_string(f"Only %d of %d lines fit the format of {SERVER_TYPES[server]}",
                            "parsed", "sampled")))
    if kind in ("clf", "clf_ms"):
        result.append(_check(
            "missing_timezone", c("no_offset") > 0,
            F.when(c("no_offset") == c("n_times"), "high").otherwise("medium"),
            F.format_string("%d of %d times carry no offset", "no_offset", "n_times")))
    elif kind == "iso":
        result.append(_check("missing_timezone", c("no_offset") > 0, "medium",
                             F.format_string("%d times carry neither Z nor an offset", "no_offset")))
    else:
        result.append(_check("timezone_is_utc", F.lit(server == "iis"), "info",
                             F.lit("W3C times are UTC and carry no offset")))
    result.append(_check(
        "inconsistent_datetime", c("unparsable") > 0, "high",
        F.format_string("%d of %d times do not parse", "unparsable", "n_times")))
    result.append(_check(
        "non_chronological", c("backward") > 0, "medium",
        F.format_string("Time steps back by more than an hour %d time(s)", "backward")))
    share = c("n_private") / F.greatest(c("n_clients"), F.lit(1))
    result.append(_check(
        "private_client_ip", c("n_private") > 0,
        F.when((share > 0.5) & ~c("forwarded"), "high").otherwise("medium"),
        F.concat(F.format_string("%d of %d client addresses are not public. ", "n_private",
                                 "n_clients"),
                 F.when(c("forwarded"), "Use the forwarded address as the client.")
                 .otherwise("No forwarded address is logged: this may be the proxy."))))
    result.append(_check("mixed_ip_versions", c("any_v4") & c("any_v6"), "info",
                         F.lit("Both IPv4 and IPv6 clients occur")))
    if server == "iis":
        i = keys_of("iis").index("cs-uri-query")
        result.append(_check("query_string_empty", (_of("seen", i) > 0) & (_of("filled", i) == 0), "medium",
                             F.lit("The query column is logged but never filled")))
    for i, row in enumerate(CATALOGUES[server]):
        if row[2] == "core":
            result.append(_check("empty_core_field", (_of("seen", i) > 0) & (_ratio(_of("filled", i), 2) == 0),
                                 "high", F.lit(f"Core field {row[1]} is present but never filled")))
    return result


def checks_of(totals: DataFrame, backward: DataFrame, server: str) -> DataFrame:
    """``place, check, severity, message`` of the checks that fire."""
    row = totals.withColumn("backward", backward.scalar())
    return row.select(F.explode(F.array_compact(F.array(*_checks(server)))).alias("c")).select("c.*")


def discrepancies(rows: DataFrame, totals: DataFrame, server: str) -> DataFrame:
    """All checks that fire with examples, by severity, then in check order."""
    found = checks_of(totals, backsteps(rows), server)
    rank = F.array_position(F.array(*[F.lit(s) for s in _SEVERITY]), F.col("severity"))
    return (found.join(examples(rows, server), "check", "left").orderBy(rank, "place", "message")
            .select("check", "severity", "message",
                    F.coalesce("examples", F.array().cast("array<string>")).alias("examples")))
