"""When addresses ask: regular intervals, and hours of the day.

Both are sums of fixed width per address, so an address with a third of all requests costs each task one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spoor.operators.detect import _findings, _with_rule
from spoor.session import match, stage

SLOT_SECONDS = 300
HOURS = range(24)


def interval_sums(events: DataFrame, slot_seconds: int = SLOT_SECONDS) -> DataFrame:
    """``ip, slot, first, last, n, squares`` in milliseconds: the gaps between requests inside a slot of the clock.

    Requests of one moment are counted first, so what is put in order inside a slot are its distinct moments;
    the sum of gaps is the time from the first to the last.
    """
    moment = F.unix_millis("ts")
    moments = (events.filter("ip is not null and ts is not null")
               .groupBy("ip", F.floor(moment / (slot_seconds * 1000)).alias("slot"), moment.alias("at"))
               .agg(F.count("*").alias("n")))
    gap = F.col("at") - F.lag("at").over(Window.partitionBy("ip", "slot").orderBy("at"))
    return (moments.withColumn("gap", F.coalesce(gap, F.lit(0)).cast("decimal(19,0)")).groupBy("ip", "slot")
            .agg(F.min("at").alias("first"), F.max("at").alias("last"), F.sum("n").alias("n"),
                 F.sum(F.col("gap") * F.col("gap")).cast("decimal(38,0)").alias("squares")))


def interval_profile(events: DataFrame, slot_seconds: int = SLOT_SECONDS) -> DataFrame:
    """``ip, requests, first_seen, last_seen, mean_gap, variation`` of addresses with three requests or more.

    ``mean_gap`` is in seconds; ``variation`` is the deviation of the gaps by their mean: 0 for a clock, 1 for
    chance. The slots of an address are stitched in order, one row for each slot it was active in. Sums are whole
    numbers, so nothing is lost where gaps hardly differ. Requests that all came at one moment have no variation.
    """
    line = Window.partitionBy("ip").orderBy("slot")
    border = F.coalesce(F.col("first") - F.lag("last").over(line), F.lit(0)).cast("decimal(19,0)")
    whole = (interval_sums(events, slot_seconds).withColumn("border", border).groupBy("ip").agg(
        F.sum("n").alias("requests"), F.min("first").alias("first"), F.max("last").alias("last"),
        (F.sum("squares") + F.sum(F.col("border") * F.col("border"))).cast("decimal(38,0)").alias("squares"))
        .filter("requests >= 3"))
    gaps, total = (F.col("requests") - 1).cast("decimal(19,0)"), (F.col("last") - F.col("first")).cast("decimal(19,0)")
    spread = (gaps * F.col("squares") - total * total).cast("double")
    return whole.select(
        "ip", "requests", F.timestamp_millis("first").alias("first_seen"), F.timestamp_millis("last").alias("last_seen"),
        F.round((F.col("last") - F.col("first")) / 1000 / (F.col("requests") - 1), 6).alias("mean_gap"),
        F.round(F.sqrt(F.greatest(spread, F.lit(0.0))) / F.nullif(total, F.lit(0)).cast("double"), 6).alias("variation"))


def find_beacons(events: DataFrame, min_requests: int = 20, max_variation: float = 0.2, min_gap: float = 1.0,
                 case_id: int = 0, now=None) -> DataFrame:
    """Addresses that ask at even intervals, as programs do that report home."""
    rows = interval_profile(events).filter((F.col("requests") >= min_requests) & (F.col("variation") <= max_variation)
                                           & (F.col("mean_gap") >= min_gap))
    text = F.format_string("A request every %.1f seconds, give or take %.0f %%", F.col("mean_gap"), F.col("variation") * 100)
    rows = rows.withColumnsRenamed({"ip": "source_ip", "requests": "count"})
    return _findings(_with_rule(rows, "beacon", "medium", text), case_id, now)


def hour_profile(events: DataFrame, shrink: float = 24.0) -> DataFrame:
    """``ip, requests, busiest_hour, distance``: how far an address's day is from that of all requests.

    ``distance`` is the share of its requests that would have to move to another hour, from 0 to 1, less for
    addresses with few requests: n of them count as n / (n + ``shrink``). The driver sees 24 sums.
    """
    hour = F.hour("ts")
    bins = [F.count_if(hour == h).alias(f"h{h}") for h in HOURS]
    per_ip = stage(events.filter("ip is not null and ts is not null").groupBy("ip").agg(F.count("*").alias("requests"), *bins), "hours-by-ip")
    fleet = per_ip.agg(*[F.sum(f"h{h}").alias(f"h{h}") for h in HOURS], F.sum("requests").alias("all")).first()
    total = fleet["all"] or 1
    moved = sum((F.abs(F.col(f"h{h}") / F.col("requests") - F.lit((fleet[f"h{h}"] or 0) / total)) for h in HOURS), F.lit(0.0))
    best = F.greatest(*[F.struct(F.col(f"h{h}").alias("n"), F.lit(-h).alias("late")) for h in HOURS])
    weight = F.col("requests") / (F.col("requests") + shrink)
    return per_ip.select("ip", "requests", (-best["late"]).alias("busiest_hour"), F.round(weight * moved / 2, 6).alias("distance"))


def find_odd_hours(events: DataFrame, min_distance: float = 0.5, case_id: int = 0, now=None) -> DataFrame:
    """Addresses whose requests come at other hours than everyone's."""
    rows = hour_profile(events).filter(F.col("distance") >= min_distance)
    text = F.format_string("%.0f %% of requests at unusual hours, most at %02d h", F.col("distance") * 100, F.col("busiest_hour"))
    rows = rows.withColumnsRenamed({"ip": "source_ip", "requests": "count"})
    return _findings(_with_rule(rows, "odd_hours", "low", text), case_id, now)


# --- parameters -------------------------------------------------------------------------

def _entropy(value: Column) -> Column:
    """Bits a character, from how often each character occurs."""
    letters = F.filter(F.split(value, ""), lambda c: c != "")
    counts = F.transform(F.array_sort(F.array_distinct(letters)), lambda c: F.size(F.filter(letters, lambda x: x == c)).cast("double"))
    n = F.size(letters).cast("double")
    return F.log2(n) - F.aggregate(counts, F.lit(0.0), lambda total, k: total + k * F.log2(k)) / n


def parameter_entropy(events: DataFrame) -> DataFrame:
    """``name, value, requests, entropy`` of every value that a URL parameter took; empty values are left out."""
    query = F.substring_index(F.col("url"), "?", -1)
    pair = F.explode(F.split(query, "&"))
    # Equal URLs are counted first: the histogram is made once a value.
    urls = events.filter(F.col("url").contains("?")).groupBy("url").agg(F.count("*").alias("n"))
    pairs = urls.select("n", pair.alias("pair")).filter(F.col("pair").contains("="))
    name = F.substring_index("pair", "=", 1)
    values = pairs.select("n", name.alias("name"), F.substr("pair", F.length(name) + 2).alias("value")).filter("value <> ''")
    return (values.groupBy("name", "value").agg(F.sum("n").alias("requests"))
            .withColumn("entropy", F.round(_entropy(F.col("value")), 6)))


def find_dense_parameters(events: DataFrame, spread: float = 3.0, min_values: int = 20) -> DataFrame:
    """Values far more random than others: ``name, value, requests, entropy, bound``.

    The bound of a name is its median entropy plus ``spread`` times the range of the middle half of its
    values, from mergeable quantile sketches; names with fewer than ``min_values`` values take the bound of all names.
    """
    values = stage(parameter_entropy(events), "parameter-values")
    marks = F.percentile_approx("entropy", [0.25, 0.5, 0.75], 10000)

    def bound(q: Column) -> Column:
        return q[1] + F.lit(spread) * (q[2] - q[0])
    fleet = values.agg(marks.alias("q")).select(bound(F.col("q")).alias("b")).first().b
    names = values.groupBy("name").agg(F.count("*").alias("n"), marks.alias("q")).filter(F.col("n") >= min_values)
    names = stage(names.select("name", bound(F.col("q")).alias("own")), "parameter-bounds")
    limit = F.round(F.coalesce("own", F.lit(fleet)), 6).alias("bound")
    return (match(values, names, ["name"], "left").select("name", "value", "requests", "entropy", limit)
            .filter("entropy > bound"))
