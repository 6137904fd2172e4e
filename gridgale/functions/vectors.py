"""Statistics over array columns, without leaving the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def mean(values: Column) -> Column:
    total = F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x.cast("double"))
    return total / F.size(values)


def population_std(values: Column) -> Column:
    """Two-pass standard deviation with divisor n."""
    centre = mean(values)
    spread = F.aggregate(
        values, F.lit(0.0),
        lambda acc, x: acc + (x.cast("double") - centre) * (x.cast("double") - centre),
    )
    return F.sqrt(spread / F.size(values))
