"""Media time: milliseconds since the start of a title."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _two(c: Column) -> Column:
    s = c.cast("string")
    return F.when(F.length(s) < 2, F.lpad(s, 2, "0")).otherwise(s)


def seconds_to_ms(s: Column) -> Column:
    """Rounds half up."""
    return F.floor(s * 1000 + 0.5).cast("long")


def format_timecode(ms: Column, millis: bool = False) -> Column:
    """m:ss, h:mm:ss from an hour on; the sign is kept."""
    a = F.abs(ms).cast("long")
    h, m, s = F.floor(a / 3600000), F.floor(a % 3600000 / 60000), F.floor(a % 60000 / 1000)
    body = F.when(h > 0, F.concat(h.cast("string"), F.lit(":"), _two(m), F.lit(":"), _two(s))).otherwise(F.concat(m.cast("string"), F.lit(":"), _two(s)))
    if millis:
        body = F.concat(body, F.lit("."), F.lpad((a % 1000).cast("string"), 3, "0"))
    return F.concat(F.when(ms < 0, "-").otherwise(""), body)


def format_srt_timestamp(ms: Column) -> Column:
    a = F.greatest(F.lit(0), ms).cast("long")
    return F.concat(_two(F.floor(a / 3600000)), F.lit(":"), _two(F.floor(a % 3600000 / 60000)), F.lit(":"), _two(F.floor(a % 60000 / 1000)), F.lit(","), F.lpad((a % 1000).cast("string"), 3, "0"))


def overlap_ms(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return F.greatest(F.lit(0), F.least(e1, e2) - F.greatest(s1, s2))


def overlaps(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Strict, half-open."""
    return (s1 < e2) & (s2 < e1)


def iou(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    both = overlap_ms(s1, e1, s2, e2)
    return F.when(both <= 0, 0.0).otherwise(both / (F.greatest(e1, e2) - F.least(s1, s2)))


def clamp(x: Column, low: float | Column, high: float | Column) -> Column:
    low, high = (v if isinstance(v, Column) else F.lit(v) for v in (low, high))
    return F.least(high, F.greatest(low, x))


def parse_timestamp(c: Column) -> Column:
    """(h:)m:s,ms or .ms in milliseconds; null without a match."""
    p = r"(?:([0-9]{1,3}):)?([0-9]{1,2}):([0-9]{1,2})[,.]([0-9]{1,3})"
    g = [F.regexp_extract(c, p, i) for i in range(1, 5)]
    n = lambda x: F.when(x == "", 0).otherwise(x).cast("long")
    return F.when(c.rlike(p), n(g[0]) * 3600000 + n(g[1]) * 60000 + n(g[2]) * 1000 + n(F.rpad(g[3], 3, "0")))
