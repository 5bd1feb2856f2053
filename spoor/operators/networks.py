"""Addresses looked up in a table of networks of any size, the longest prefix first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spoor.functions.ip import ip_hex
from spoor.session import match, stage


def _bits(digits: Column) -> Column:
    """128 binary digits of 32 hex digits."""
    return F.concat(*[F.lpad(F.conv(F.substring(digits, 1 + 8 * k, 8), 16, 2), 32, "0") for k in range(4)])


def network_prefix(cidr: Column) -> Column:
    """The bits that a network fixes, as text; an address alone is a network of one. Null where it is none.

    IPv4 counts as mapped into IPv6, so its prefix lengths begin at 96.
    """
    address, size = F.substring_index(F.trim(cidr), "/", 1), F.get(F.split(F.trim(cidr), "/"), F.lit(1))
    narrow = F.when(address.contains(":"), 0).otherwise(96)
    length = F.when(size.isNull(), 128).otherwise(size.try_cast("int") + narrow)
    return F.when(length.between(narrow, 128), F.left(_bits(ip_hex(address)), length))


def longest_networks(addresses: DataFrame, networks: DataFrame, address: str = "ip", network: str = "network") -> DataFrame:
    """``ip, network`` and the other columns of ``networks``: the smallest network around each distinct address.

    An address can only lie in networks whose fixed bits begin it, so for each prefix length that the table has
    its first bits are looked up by equality: hash joins, however many networks there are and however they nest.
    At most 129 lengths are gathered, never networks. Host bits that are set in a network are ignored; of
    networks with the same bits the least in text counts. Addresses in no network, or that are none, give no row.
    """
    rest = [c for c in networks.columns if c != network]
    table = networks.withColumn("_bits", network_prefix(F.col(network))).filter("_bits is not null")
    table = stage(table.groupBy("_bits").agg(F.min(F.struct(network, *rest)).alias("_net")), "networks")
    sizes = [r.n for r in table.select(F.length("_bits").alias("n")).distinct().collect()]
    known = addresses.select(F.col(address).alias("ip")).filter("ip is not null").distinct()
    known = known.withColumn("_all", _bits(ip_hex(F.col("ip")))).filter("_all is not null")
    lengths = F.array(*[F.lit(n) for n in sorted(sizes)]).cast("array<int>")
    tries = known.select("ip", F.explode(F.transform(lengths, lambda n: F.left(F.col("_all"), n))).alias("_bits"))
    found = tries.join(table, "_bits").groupBy("ip").agg(F.max_by("_net", F.length("_bits")).alias("_net"))
    return found.select("ip", "_net.*")


def tag_networks(events: DataFrame, networks: DataFrame, network: str = "network") -> DataFrame:
    """Every event with the columns of its address's smallest network, null where there is none.

    Addresses are looked up once each; the result is joined back, staged so that a busy address can be split.
    """
    return match(events, stage(longest_networks(events, networks, network=network), "address-networks"), ["ip"], "left")


def events_in_networks(events: DataFrame, networks: DataFrame, network: str = "network") -> DataFrame:
    """The events whose address lies in one of the networks."""
    found = longest_networks(events, networks, network=network).select("ip")
    return match(events, stage(found, "addresses-inside"), ["ip"], "left_semi")
