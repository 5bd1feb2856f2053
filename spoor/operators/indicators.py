"""Long lists of literal indicators looked for in URLs by an index of short pieces.

A URL can only hold an indicator if it holds all its pieces of four characters. Each indicator is filed under the
one of its pieces that fewest URLs have, so a look-up by equality finds the few pairs that are worth a comparison.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spoor.session import match, stage

PIECE = 4


def _folded(text: Column) -> Column:
    """Letters A to Z in lower case; others are compared as they are."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _pieces(text: Column, size: int) -> Column:
    last = F.length(text) - size + 1
    return F.when(last >= 1, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))),
                                                          lambda i: F.substr(text, i, F.lit(size))))).otherwise(F.array())


def _piece_rows(rows: DataFrame, column: str, sizes: list[int]) -> DataFrame:
    """One row for each different piece of the given sizes."""
    return rows.withColumn("piece", F.explode(F.concat(*[_pieces(F.col(column), s) for s in sizes])))


def match_indicators(events: DataFrame, indicators: DataFrame, indicator: str = "indicator") -> DataFrame:
    """``url, indicator, requests`` for every indicator (a literal text) that occurs in a URL, ASCII case ignored.

    Lists may hold hundreds of thousands of rows; no pattern is built from them and nothing is broadcast but
    what Spark finds to be small. Distinct URLs are read once. How often a piece occurs is counted over them, and a
    piece that is in no URL settles its indicator at once. Indicators of fewer than four characters are their own
    piece. Blank or null indicators are left out; of indicators that differ only in case the least is named.
    """
    urls = stage(events.filter("url is not null").groupBy("url").agg(F.count("*").alias("requests")), "indicator-urls")
    wanted = (indicators.select(F.col(indicator).alias("indicator")).filter("trim(indicator) <> ''")
              .groupBy(_folded(F.col("indicator")).alias("folded")).agg(F.min("indicator").alias("indicator")))
    wanted = stage(wanted.withColumn("size", F.least(F.length("folded"), F.lit(PIECE))), "indicators")
    sizes = sorted(r["size"] for r in wanted.select("size").distinct().collect())       # four numbers at most
    if not sizes:
        return urls.limit(0).select("url", F.lit("").alias("indicator"), "requests")
    held = _piece_rows(urls.select("url", _folded(F.col("url")).alias("text")), "text", sizes)
    held = stage(held.select("url", "piece"), "url-pieces")
    common = held.groupBy("piece").agg(F.count("*").alias("n"))
    own = F.explode(F.when(F.col("size") < PIECE, F.array("folded")).otherwise(_pieces(F.col("folded"), PIECE)))
    filed = wanted.select("indicator", "folded", own.alias("piece"))
    # A piece that no URL has comes first and then meets nothing.
    rarest = filed.join(common, "piece", "left").groupBy("folded", "indicator").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "piece")).alias("best")).filter("best.n > 0")
    index = stage(rarest.select("folded", "indicator", F.col("best.piece").alias("piece")), "indicator-index")
    pairs = held.join(index, "piece").filter(_folded(F.col("url")).contains(F.col("folded")))
    return match(pairs.select("url", "indicator"), urls, ["url"]).select("url", "indicator", "requests")


def find_indicators(events: DataFrame, indicators: DataFrame, indicator: str = "indicator") -> DataFrame:
    """``indicator, source_ip, count, first_seen, last_seen``: who asked for URLs that hold an indicator."""
    found = stage(match_indicators(events, indicators, indicator).select("url", "indicator"), "indicator-matches")
    return (match(events.select("ip", "url", "ts"), found, ["url"]).groupBy("indicator", F.col("ip").alias("source_ip"))
            .agg(F.count("*").alias("count"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen")))
