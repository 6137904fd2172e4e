"""Prediction points: which (cell, time) pairs to describe."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridgale.functions.clock import HOUR, floor_micros, micros
from gridgale.operators.ordering import numbered

TICK = 6 * HOUR


def point_grid(
    cells: DataFrame,
    times: list[datetime] | None = None,
    start: str | None = None,
    end: str | None = None,
    step: str = "6 hours",
) -> DataFrame:
    """Every cell at every time: a list, or the regular ticks from ``start`` to ``end``.

    The times become an array literal that each cell row explodes, so the grid is a narrow
    transformation: no join and no shuffle.
    """
    if times is not None:
        ticks = F.array(*[F.lit(t).cast("timestamp") for t in times])
    else:
        ticks = F.sequence(
            F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp"), F.expr(f"INTERVAL {step}")
        )
    return cells.withColumn("ts", F.explode(ticks))


def time_span(events: DataFrame, column: str = "event_time") -> tuple[int, int]:
    """(min, max) of a time column in microseconds: one row to the driver."""
    row = events.agg(
        F.min(micros(F.col(column))).alias("lo"), F.max(micros(F.col(column))).alias("hi")
    ).first()
    return row["lo"], row["hi"]


def positive_points(weather: DataFrame, outages: DataFrame) -> DataFrame:
    """Distinct (cell, tick) of outages that leave 72 h of history and 24 h of future."""
    lo, hi = time_span(weather)
    tick = floor_micros(micros(F.col("observed_at")), TICK)
    return (
        outages.withColumn("_t", tick)
        .filter((F.col("_t") > lo + 72 * HOUR) & (F.col("_t") < hi - 24 * HOUR))
        .select("cell", "q", "r", F.timestamp_micros("_t").alias("ts"))
        .distinct()
    )


def cells_without_outage(weather: DataFrame, outages: DataFrame) -> DataFrame:
    return weather.select("cell").subtract(outages.select("cell"))


def balanced_points(
    weather: DataFrame, outages: DataFrame, n: int, seed: int = 42
) -> DataFrame:
    """Up to n/3 positives, the rest random (cell, tick) draws with replacement.

    Positives are picked by a hash order. Each of the draws is a row id whose hash gives the
    rank of a cell and the number of a tick, so the same seed gives the same points on any
    cluster. Both ranks come from a range sort (``numbered``), which no single task holds.
    """
    spark = weather.sparkSession
    lo, hi = time_span(weather)
    first = -(-lo // TICK) * TICK + 72 * HOUR
    last = hi // TICK * TICK - 24 * HOUR
    n_ticks = (last - first) // TICK + 1

    shuffled = positive_points(weather, outages).withColumn("_h", F.xxhash64(F.lit(seed), "cell", "ts"))
    positives = (
        numbered(shuffled, ["_h", "cell", "ts"])
        .filter(F.col("position") < n // 3)
        .drop("_h", "position")
        .withColumn("kind", F.lit("positive"))
    )
    seen = weather.select("cell", "q", "r").union(outages.select("cell", "q", "r")).distinct()
    cells = numbered(seen, ["cell"])
    n_cells = cells.count()
    n_pos = positives.count()
    draws = spark.range(n - n_pos).select(
        F.pmod(F.xxhash64(F.lit(seed), F.lit("cell"), "id"), F.lit(n_cells)).alias("position"),
        F.pmod(F.xxhash64(F.lit(seed), F.lit("tick"), "id"), F.lit(n_ticks)).alias("_k"),
    )
    negatives = draws.join(cells, "position").select(
        "cell", "q", "r",
        F.timestamp_micros(F.lit(first) + F.col("_k") * F.lit(TICK)).alias("ts"),
        F.lit("random").alias("kind"),
    )
    return positives.unionByName(negatives)
