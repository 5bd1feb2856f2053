"""IP addresses as built-in column expressions: validity, sort key, ranges."""

from __future__ import annotations

import ipaddress
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_IPV4 = rf"{_OCTET}(?:\.{_OCTET}){{3}}"
_HEXTETS = r"^(?:[0-9a-f]{1,4}(?::[0-9a-f]{1,4})*)?$"
_MAPPED_PREFIX = "0" * 20 + "ffff"

# Address blocks that are not globally reachable, the single
# addresses and blocks inside them that are, and the shared carrier block.
NON_GLOBAL = (
    "0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12",
    "192.0.0.0/24", "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24",
    "203.0.113.0/24", "240.0.0.0/4",
    "::1/128", "::/128", "64:ff9b:1::/48", "100::/64", "2001::/23", "2001:db8::/32",
    "2002::/16", "fc00::/7", "fe80::/10",
)
GLOBAL_EXCEPTIONS = (
    "192.0.0.9/32", "192.0.0.10/32",
    "2001:1::1/128", "2001:1::2/128", "2001:3::/32", "2001:4:112::/48", "2001:20::/28",
    "2001:30::/28",
)
CARRIER_SHARED = "100.64.0.0/10"


def _v4_hex(ip: Column) -> Column:
    octets = F.split(ip, r"\.")
    number = sum((F.try_element_at(octets, F.lit(i + 1)).try_cast("bigint")
                  * (256 ** (3 - i)) for i in range(4)), F.lit(0))
    return F.lpad(F.lower(F.hex(number)), 8, "0")


def _let(value: Column, body) -> Column:
    """Bind a value to a lambda variable so a long expression holds it once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _groups(part: Column) -> Column:
    return F.filter(F.split(part, ":"), lambda g: g != "")


def _expand(plain: Column) -> Column:
    """Hex digits of an IPv6 text; one ``::`` stands for the missing groups."""
    def of_sides(side: Column) -> Column:
        left, right = _groups(side["left"]), _groups(side["right"])
        missing = 8 - F.size(left) - F.size(right)
        shape = (side["left"].rlike(_HEXTETS) & side["right"].rlike(_HEXTETS)
                 & F.when(side["parts"] == 1, missing == 0)
                 .otherwise((side["parts"] == 2) & (missing >= 1)))
        groups = F.concat(left, F.array_repeat(F.lit("0"), missing), right)
        return F.when(shape, F.array_join(F.transform(groups, lambda g: F.lpad(g, 4, "0")), ""))

    halves = F.split(plain, "::")
    return _let(F.struct(F.get(halves, F.lit(0)).alias("left"),
                         F.coalesce(F.get(halves, F.lit(1)), F.lit("")).alias("right"),
                         F.size(halves).alias("parts")), of_sides)


def _v6_hex(ip: Column) -> Column:
    """As ``_expand``, with a dotted IPv4 tail rewritten as two groups first."""
    def with_tail(text: Column) -> Column:
        tail = _v4_hex(F.regexp_extract(text, rf"({_IPV4})$", 1))
        return F.when(~text.contains("."), text).otherwise(F.concat(
            F.regexp_replace(text, rf"{_IPV4}$", ""),
            F.substring(tail, 1, 4), F.lit(":"), F.substring(tail, 5, 4)))

    return _let(_let(ip, with_tail), _expand)


def ip_hex(ip: Column) -> Column:
    """32 hex digits of the address (IPv4 mapped into IPv6); null when invalid."""
    text = F.lower(ip)
    return (F.when(text.rlike(rf"^{_IPV4}$"), F.concat(F.lit(_MAPPED_PREFIX), _v4_hex(text)))
            .when(text.contains(":"), _v6_hex(F.regexp_replace(text, "%[^%/]+$", ""))))


def ip_key(ip: Column) -> Column:
    """16-byte key: numeric order of addresses, and CIDR tests as one range."""
    return F.unhex(ip_hex(ip))


def _shorten(digits: Column) -> Column:
    """Text of 32 hex digits by RFC 5952: no leading zeros, the first longest run of zero groups as ``::``."""
    groups = F.transform(F.sequence(F.lit(0), F.lit(7)),
                         lambda i: F.regexp_replace(F.substr(digits, i * 4 + 1, F.lit(4)), "^0{1,3}", ""))

    def of_text(text: Column) -> Column:
        out = text
        for n in range(2, 9):
            run = rf"(?:^|:)0(?::0){{{n - 1}}}(?:$|:)"
            out = F.when(text.rlike(run), F.regexp_replace(text, f"^(.*?){run}(.*)$", "$1::$2")).otherwise(out)
        return out

    return _let(F.array_join(groups, ":"), of_text)


def canonical_ip(ip: Column) -> Column:
    """One spelling for each address: IPv4 as it is, also when written inside IPv6; other IPv6 by
    RFC 5952. Text that is no address stays."""
    def spell(digits: Column) -> Column:
        octets = F.transform(F.sequence(F.lit(0), F.lit(3)),
                             lambda i: F.conv(F.substr(digits, i * 2 + 25, F.lit(2)), 16, 10))
        return (F.when(digits.startswith(_MAPPED_PREFIX), F.array_join(octets, "."))
                .when(digits.isNotNull(), _shorten(digits)))

    return F.when(ip.contains(":"), F.coalesce(_let(ip_hex(ip), spell), ip)).otherwise(ip)


def is_valid_ip(ip: Column) -> Column:
    return ip_hex(ip).isNotNull()


def _bounds(cidr: str) -> tuple[str, str]:
    net = ipaddress.ip_network(cidr, strict=False)
    prefix = _MAPPED_PREFIX if net.version == 4 else ""
    return prefix + net[0].packed.hex(), prefix + net[-1].packed.hex()


def cidr_bounds(cidr: str) -> tuple[bytes, bytes]:
    """First and last key of a CIDR block."""
    lo, hi = _bounds(cidr)
    return bytes.fromhex(lo), bytes.fromhex(hi)


def _blocks(cidrs) -> Column:
    return F.array(*[F.struct(F.lit(lo).alias("lo"), F.lit(hi).alias("hi"))
                     for lo, hi in map(_bounds, cidrs)])


def _in_any(key: Column, cidrs) -> Column:
    return F.exists(_blocks(cidrs), lambda b: key.between(b["lo"], b["hi"]))


def is_non_global_ip(ip: Column) -> Column:
    """True for addresses that are not globally routable, null when invalid."""
    carrier_lo, carrier_hi = _bounds(CARRIER_SHARED)
    written_v4 = ~ip.contains(":")

    def reserved(key: Column) -> Column:
        return F.when(key.isNotNull(), (
            (_in_any(key, NON_GLOBAL) & ~_in_any(key, GLOBAL_EXCEPTIONS))
            | (written_v4 & key.between(carrier_lo, carrier_hi))))

    return _let(ip_hex(F.trim(ip)), reserved)


def is_ipv4_text(ip: str) -> bool:
    return re.fullmatch(_IPV4, ip) is not None


def subnet24(ip: Column) -> Column:
    """First three octets of an IPv4 address as ``a.b.c.0/24``; other text as is."""
    return F.when(ip.rlike(rf"^{_IPV4}$"),
                  F.concat(F.substring_index(ip, ".", 3), F.lit(".0/24"))).otherwise(ip)
