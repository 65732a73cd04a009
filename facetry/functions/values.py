"""Maps, JSON, parsing with defaults, identifiers and relative times."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

UNITS = {"s": "SECOND", "m": "MINUTE", "h": "HOUR", "d": "DAY", "w": "WEEK"}


def map_merge(a: Column, b: Column) -> Column:
    """Entries of both maps; b's where both have a key."""
    return F.map_concat(F.map_filter(a, lambda k, _: ~F.array_contains(F.map_keys(b), k)), b)


def map_put(m: Column, key: str, value: Column) -> Column:
    return map_merge(m, F.create_map(F.lit(key), value))


def json_path(text: Column, *keys: str) -> Column:
    """The value at nested keys, as text; null where a key is missing or the text is no JSON."""
    return F.get_json_object(text, "$" + "".join(f"['{k}']" for k in keys))


def parse_or(text: Column, default: float = 0.0) -> Column:
    """The number a text holds, else the default."""
    return F.coalesce(text.try_cast("double"), F.lit(default))


def is_uuid(text: Column) -> Column:
    return F.coalesce(text.rlike("(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"), F.lit(False))


def ago(now: Column, duration: str) -> Column:
    """A time before now, by a relative duration such as -24h, -30d or -15m."""
    if not (m := re.fullmatch(r"-(\d+)([smhdw])", duration)):
        raise ValueError(f"not a relative duration: {duration}")
    return now - F.expr(f"INTERVAL {m[1]} {UNITS[m[2]]}")
