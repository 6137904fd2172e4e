"""Storm vocabulary and damage values as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridgale.constants import (
    BASE_OUTAGE_RISK,
    CATEGORIES,
    CATEGORY_TYPES,
    DEFAULT_OUTAGE_RISK,
)


def category(event_type: Column) -> Column:
    """One of six hazard categories, or null."""
    out = F.lit(None).cast("string")
    for name in CATEGORIES:
        out = F.when(event_type.isin(CATEGORY_TYPES[name]), F.lit(name)).otherwise(out)
    return out


def dollars(text: Column) -> Column:
    """Damage such as ``25K`` or ``1.5M`` in dollars; anything unreadable is 0."""
    s = F.upper(F.trim(text.cast("string")))
    number = F.regexp_extract(s, r"^([\d.]+)([KMB])?$", 1).try_cast("double")
    unit = F.regexp_extract(s, r"^([\d.]+)([KMB])?$", 2)
    scale = (
        F.when(unit == "K", 1e3).when(unit == "M", 1e6).when(unit == "B", 1e9).otherwise(1.0)
    )
    value = F.coalesce(number * scale, s.try_cast("double"))
    return F.when(s.isNull() | s.isin("", "0", "NAN"), 0.0).otherwise(F.coalesce(value, F.lit(0.0)))


def base_risk(event_type: Column) -> Column:
    lookup = F.create_map(*[F.lit(x) for pair in BASE_OUTAGE_RISK.items() for x in pair])
    return F.coalesce(F.try_element_at(lookup, event_type), F.lit(DEFAULT_OUTAGE_RISK))


def magnitude_factor(magnitude: Column) -> Column:
    return F.when(magnitude > 0, F.least(F.lit(1.0), magnitude / 100.0)).otherwise(F.lit(0.3))


def outage_probability(event_type: Column, magnitude: Column, damage: Column) -> Column:
    """Expected chance that an event causes an outage."""
    damage_factor = F.least(F.lit(1.0), F.log1p(F.coalesce(damage, F.lit(0.0))) / 15.0)
    score = base_risk(event_type) * 0.5 + magnitude_factor(magnitude) * 0.25 + damage_factor * 0.25
    return clip(score, 0.0, 0.95)


def outage_severity(event_type: Column, magnitude: Column, hour: Column) -> Column:
    """Expected outage fraction ``hour`` hours after an event."""
    score = base_risk(event_type) * magnitude_factor(magnitude) * (F.lit(1.0) - hour * 0.15)
    return clip(score, 0.005, 0.95)


def clip(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))
