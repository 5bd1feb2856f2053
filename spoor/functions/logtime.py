"""Timestamps as they appear in access logs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_CLF = "d/MMM/yyyy:H:m:s"
_ISO = (r"^[0-9]{4}-[0-9]{2}-[0-9]{2}(?:[T ][0-9]{2}:[0-9]{2}(?::[0-9]{2}(?:[.,][0-9]+)?)?"
        r"(?:Z|[+-][0-9]{2}(?::?[0-9]{2})?)?)?$")
_EPOCH_MIN, _EPOCH_MAX = -62135596800, 253402300799


def has_tz_offset(raw: Column) -> Column:
    """A ``+hhmm`` style offset at a word end, or a trailing ``Z``."""
    return F.coalesce(raw.rlike(r"[+-][0-9]{4}\b|Z$"), F.lit(False))


def request_time(raw: Column) -> Column:
    """Instant of a combined-log time; an offset is required, else null."""
    return F.coalesce(F.try_to_timestamp(raw, F.lit(f"{_CLF} Z")),
                      F.try_to_timestamp(raw, F.lit(f"{_CLF} XXX")))


def w3c_time(raw: Column) -> Column:
    return F.try_to_timestamp(raw, F.lit("yyyy-M-d H:m:s"))


def _epoch(raw: Column) -> Column:
    seconds = raw.try_cast("double")
    return F.when(seconds.between(_EPOCH_MIN, _EPOCH_MAX), F.timestamp_seconds(seconds))


def parse_ts_kind(kind: str, raw: Column) -> Column:
    """Read a logged time by kind; null when it does not parse.

    ``clf`` and ``clf_ms`` take the wall-clock part and ignore offset and
    fraction, so chronology is judged on what the log shows.
    """
    if kind in ("clf", "clf_ms"):
        base = F.substring_index(F.regexp_extract(raw, r"^\s*(\S+)", 1), ".", 1)
        return F.try_to_timestamp(base, F.lit(_CLF))
    if kind == "iso":
        return F.when(raw.rlike(_ISO), raw.try_cast("timestamp"))
    if kind == "epoch":
        return _epoch(raw)
    if kind == "iis":
        return w3c_time(raw)
    raise ValueError(f"unknown timestamp kind {kind}")
