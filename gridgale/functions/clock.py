"""Time arithmetic as Column expressions, in epoch microseconds."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

MINUTE = 60_000_000
HOUR = 60 * MINUTE
DAY = 24 * HOUR
NEVER = -(2**62)  # stands for an unknown time: inside no window


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def floor_micros(t: Column, step: int) -> Column:
    """Largest multiple of ``step`` not above ``t`` (also right before 1970)."""
    return t - F.pmod(t, F.lit(step).cast("bigint"))


def slice_mark(t: Column, step: int) -> Column:
    """A representative instant for the slice of time that ``t`` falls in.

    Time is cut into the exact multiples of ``step`` and the open intervals between them.
    Every closed window whose ends are multiples of ``step`` is a union of such slices, so
    testing the representative against the window gives the same answer as testing ``t``.
    An interval is represented by its middle, a multiple by itself, an unknown time by ``NEVER``
    (a mark that cannot be null keeps null checks out of the plans that share the marked rows).
    """
    base = floor_micros(t, step)
    mark = F.when(t == base, t).otherwise(base + F.lit(step // 2).cast("bigint"))
    return F.coalesce(mark, F.lit(NEVER).cast("bigint"))


def common_step(*spans: int) -> int:
    """Widest slice that fits all the given spans (microseconds)."""
    return math.gcd(*spans)


def cyclical(ts: Column) -> dict[str, Column]:
    """Hour, weekday (Monday = 0) and month (January = 0) as sine/cosine pairs."""
    hour = F.hour(ts) + F.minute(ts) / F.lit(60.0)
    weekday = F.weekday(ts)
    month = F.month(ts) - 1
    out = {}
    for name, value, period in (("hour", hour, 24.0), ("dow", weekday, 7.0), ("month", month, 12.0)):
        angle = value * F.lit(2 * math.pi / period)
        out[f"{name}_sin"] = F.sin(angle)
        out[f"{name}_cos"] = F.cos(angle)
    out["is_weekend"] = (weekday >= 5).cast("double")
    return out


def parse_mixed(text: Column) -> Column:
    """Parse a timestamp written in any of the usual feed formats; null when none fits."""
    formats = [
        "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd",
        "dd-MMM-yy HH:mm:ss", "MM/dd/yyyy HH:mm:ss", "MM/dd/yyyy HH:mm", "MM/dd/yyyy",
    ]
    clean = F.trim(text)
    tries = [F.try_to_timestamp(clean)]
    # Storm feeds write months in capitals (03-JAN-22); the parser wants "Jan".
    spelled = F.regexp_replace(F.initcap(F.regexp_replace(clean, "-", " ")), " ", "-")
    for fmt in formats:
        source = spelled if "MMM" in fmt else clean
        # initcap also touches the time part's first digit only, which it leaves alone.
        wanted = fmt.replace(" ", "-") if "MMM" in fmt else fmt
        tries.append(F.try_to_timestamp(source, F.lit(wanted)))
    return F.coalesce(*tries)


def in_dates(ts: Column, start: str | None, end: str | None) -> Column:
    """Inclusive calendar-date range, written as a timestamp range so it can be pushed down."""
    test = F.lit(True)
    if start is not None:
        test = test & (ts >= F.lit(start).cast("date").cast("timestamp"))
    if end is not None:
        test = test & (ts < F.date_add(F.lit(end).cast("date"), 1).cast("timestamp"))
    return test
