"""Scalar tests and projections over request fields."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from spoor import rules as R

_BITS = 63


def is_populated(value: Column) -> Column:
    """Neither null nor one of the two placeholders for "nothing logged"."""
    return value.isNotNull() & ~value.isin("", "-")


def referrer_host(referrer: Column) -> Column:
    return F.regexp_extract(referrer, r"^[A-Za-z]+://([^/:]+)", 1)


def domain_of(vhost: Column, referrer: Column, strip_port: bool = True) -> Column:
    """Logged virtual host without its port, else the host of the referrer."""
    host = F.substring_index(vhost, ":", 1) if strip_port else vhost
    return (F.when(F.coalesce(vhost, F.lit("")) != "", host)
            .otherwise(referrer_host(F.coalesce(referrer, F.lit("")))))


def _matches(url: Column, rule: R.Rule) -> Column:
    return _search(url, rule.pattern)


def _search(url: Column, pattern: str) -> Column:
    """Repeated blanks are searched as single characters: repeating a group with
    alternatives takes a stack as deep as the URL is long."""
    if R.BLANK not in pattern:
        return url.rlike(f"(?i){pattern}")
    plain = F.replace(F.replace(url, F.lit("%20"), F.lit(" ")), F.lit("/**/"), F.lit(" "))
    return plain.rlike(f"(?i){pattern.replace(R.BLANK, '[ +]')}")


def is_suspect(url: Column, rules: R.RuleSet = R.DEFAULT_RULES) -> Column:
    """False only for URLs no rule can match: one cheap pattern spares most
    URLs the rule table."""
    if rules.suspect is None:
        return F.lit(True)
    return _search(url, rules.suspect)


def tag_url(url: Column, rules: R.RuleSet = R.DEFAULT_RULES) -> Column:
    """Names of all rules found anywhere in the URL, in rule order."""
    found = F.array_compact(F.array(*[F.when(_matches(url, r), F.lit(r.name))
                                      for r in rules.rules]))
    return F.when(is_suspect(url, rules), found).otherwise(F.array().cast("array<string>"))


def url_tags(columns: list[str], rules: R.RuleSet = R.DEFAULT_RULES) -> Column:
    """Stored ``tags`` where the events carry them, else found in ``url``."""
    return F.col("tags") if "tags" in columns else tag_url(F.col("url"), rules)


def mask_columns(tags: Column, rules: R.RuleSet = R.DEFAULT_RULES) -> list[Column]:
    """Tags as bit masks, 63 rules to a word.

    Masks are fixed-width, so sessions can be summarised with ``bit_or`` in a
    hash aggregation with map-side combine, which sets of strings cannot.
    """
    words = []
    for start in range(0, max(1, len(rules.rules)), _BITS):
        word = F.lit(0).cast("bigint")
        for i, name in enumerate(rules.names[start:start + _BITS]):
            word = word.bitwiseOR(F.when(F.array_contains(tags, name),
                                         F.lit(1 << i).cast("bigint")).otherwise(0))
        words.append(F.when(F.size(tags) == 0, F.lit(0).cast("bigint")).otherwise(word)
                     .alias(f"sig_{start // _BITS}"))
    return words


def mask_names(rules: R.RuleSet) -> list[str]:
    return [f"sig_{i}" for i in range(max(1, -(-len(rules.rules) // _BITS)))]


def _bit(rules: R.RuleSet, index: int) -> Column:
    word = F.col(f"sig_{index // _BITS}")
    return word.bitwiseAND(F.lit(1 << (index % _BITS)).cast("bigint")) != 0


def tags_from_masks(rules: R.RuleSet, ordered: bool = False) -> Column:
    """Rule names of the mask columns; alphabetical when ``ordered``."""
    pairs = list(enumerate(rules.names))
    if ordered:
        pairs.sort(key=lambda p: p[1])
    return F.array_compact(F.array(*[F.when(_bit(rules, i), F.lit(n)) for i, n in pairs]))


def is_scanner_ua(ua: Column) -> Column:
    """The client names a known scanner or script library."""
    pattern = R.by_first_class(re.escape(s) for s in R.SCANNER_UAS)
    return ua.rlike(f"(?i){pattern}")


def classify_phase(tags: Column, bytes_out: Column, event_count: Column, n404: Column,
                   scanner_ua: Column, rules: R.RuleSet = R.DEFAULT_RULES) -> Column:
    """Attack phase of a session; the first matching test decides."""
    def hit(names):
        return F.arrays_overlap(tags, F.array(*[F.lit(n) for n in sorted(names)]))

    mostly_missing = (event_count >= 20) & (n404 * 2 > event_count)
    return (F.when(hit(rules.postexploit_tags), "post-exploitation")
            .when(bytes_out >= R.EXFIL_MIN_BYTES, "exfiltration")
            .when(hit(rules.exploit_tags), "exploitation")
            .when(scanner_ua | mostly_missing | hit(rules.recon_tags), "recon")
            .otherwise("benign"))


def _rank(value: Column, order, unknown: int) -> Column:
    chain = F.when(F.lit(False), 0)
    for rank, name in enumerate(order):
        chain = chain.when(value == name, rank)
    return chain.otherwise(unknown)


def phase_rank(phase: Column) -> Column:
    return _rank(phase, R.PHASES, -1)


def severity_rank(severity: Column) -> Column:
    return _rank(severity, R.SEVERITIES, 9)


def reputation_band(score: Column) -> Column:
    return F.when(score >= 80, "bad").when(score >= 25, "warn").otherwise("ok")
