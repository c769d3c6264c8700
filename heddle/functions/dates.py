"""Dates of postings and their display. Nothing reads the clock: ``as_of`` is an argument."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from heddle.functions.names import text


def iso_from_millis(ms: Column) -> Column:
    """Milliseconds since the epoch as UTC text; "" where they are no number."""
    return F.coalesce(F.date_format(F.timestamp_millis(ms.try_cast("bigint")), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'"), F.lit(""))


def iso_from_dotted(value: Column) -> Column:
    """dd.mm.yyyy as yyyy-mm-dd; anything else unchanged."""
    return F.regexp_replace(F.trim(text(value)), r"^(\d{2})\.(\d{2})\.(\d{4})$", "$3-$2-$1")


def posted_ts(value: Column) -> Column:
    """A posting's date: ISO text, else its first ten characters, else null. Needs ``yyyy-`` in front."""
    v = text(value)
    return F.when(v.rlike(r"^\d{4}-"), F.coalesce(v.try_cast("timestamp"), F.substring(v, 1, 10).try_cast("timestamp")))


def utc_date(epoch_seconds: Column) -> Column:
    return F.to_date(F.timestamp_seconds(epoch_seconds))


def age_text(then: Column, as_of: Column) -> Column:
    """How long ago in whole seconds, minutes, hours or days; "now" for what lies ahead, "" for null."""
    s = F.unix_timestamp(as_of) - F.unix_timestamp(then)
    part = lambda n, unit: F.concat(F.floor(s / n).cast("string"), F.lit(unit))
    return F.when(then.isNull(), F.lit("")).when(s < 0, F.lit("now")).when(s < 60, part(1, "s ago")).when(s < 3600, part(60, "m ago")).when(s < 86400, part(3600, "h ago")).otherwise(part(86400, "d ago"))


def day_text(ts: Column) -> Column:
    return F.coalesce(F.date_format(ts, "yyyy-MM-dd"), F.lit("—"))


def parse_recent(value: str | None) -> int | None:
    """A window such as 24h, 7d, 30m (minutes) or a bare number of days in seconds; none for "", all or nonsense."""
    found = re.fullmatch(r"\s*(\d+)\s*([hdm]?)\s*", (value or "").lower())
    return int(found[1]) * {"h": 3600, "d": 86400, "m": 60, "": 86400}[found[2]] if found and int(found[1]) else None


def parse_tri(value: str | None) -> bool | None:
    """Yes, no or don't care."""
    v = (value or "").strip().lower()
    return True if v in ("1", "true", "yes", "on") else False if v in ("0", "false", "no", "off") else None
