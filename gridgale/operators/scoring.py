"""Scores, risk levels and alerts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridgale.constants import (
    ALERT_ACTIONS,
    ALERT_TEXT,
    ALERT_TTL_HOURS,
    DEFAULT_ALERT_TEXT,
    DEFAULT_ALERT_TTL_HOURS,
    DEFAULT_THRESHOLDS,
    FEATURE_DEFAULTS,
    LEVELS,
    REGION_THRESHOLDS,
    REGIONS,
)
from gridgale.functions.clock import cyclical
from gridgale.functions.weather import clip


def checked_thresholds(bounds: tuple[float, float, float]) -> tuple[float, float, float]:
    """Lower bounds of YELLOW, ORANGE and RED: within [0, 1] and strictly rising."""
    yellow, orange, red = bounds
    if not 0 <= yellow < orange < red <= 1:
        raise ValueError(f"thresholds must rise strictly within [0, 1]: {bounds}")
    return bounds


def region_table(spark) -> DataFrame:
    """The region settings: states, level bounds, dominant event types, seasonal weights."""
    rows = [
        (
            code, r["name"], r["states"],
            dict(zip(LEVELS, (0.0, *checked_thresholds(REGION_THRESHOLDS[code])), strict=True)),
            r["dominant"], r["seasons"],
        )
        for code, r in REGIONS.items()
    ]
    return spark.createDataFrame(
        rows, "region_code string, name string, states array<string>, risk_thresholds map<string, double>,"
              " dominant_types array<string>, seasonal_weights map<string, map<string, double>>"
    )


def level_for(probability: Column, bounds: tuple[float, float, float]) -> Column:
    yellow, orange, red = checked_thresholds(bounds)
    return (
        F.when(probability >= red, "RED").when(probability >= orange, "ORANGE")
        .when(probability >= yellow, "YELLOW").otherwise("GREEN")
    )


def risk_level(
    probability: Column,
    region: Column,
    rules: dict[str, tuple[float, float, float]] | None = None,
) -> Column:
    """Level by the region's own thresholds. There are as many rules as regions, so they are part
    of the expression rather than a join."""
    rules = REGION_THRESHOLDS if rules is None else rules
    out = level_for(probability, DEFAULT_THRESHOLDS)
    for name, bounds in rules.items():
        out = F.when(region == name, level_for(probability, bounds)).otherwise(out)
    return out


def with_defaults(df: DataFrame, overrides: dict[str, float] | None = None, time: str = "ts") -> DataFrame:
    """Scoring inputs: known defaults, the calendar of the row's time, columns the row already
    has, then what-if overrides. Unknown override names are ignored."""
    calendar = {k: v for k, v in cyclical(F.col(time)).items() if k in FEATURE_DEFAULTS}
    out = {}
    for name, default in FEATURE_DEFAULTS.items():
        if overrides and name in overrides:
            value = F.lit(float(overrides[name]))
        elif name in df.columns:
            value = F.coalesce(F.col(name).cast("double"), F.lit(float(default)))
        elif name in calendar:
            value = calendar[name]
        else:
            value = F.lit(float(default))
        out[name] = value
    return df.withColumns(out)


def heuristic_score(df: DataFrame) -> DataFrame:
    """Risk without a model, with its fixed uncertainty band."""
    weather = F.least(F.lit(1.0), F.col("weather_count_24h") / 10.0)
    load = F.greatest(F.lit(0.0), F.col("load_capacity_ratio") - 0.7) / 0.3
    age = F.col("avg_line_age_years") / 50.0
    p = clip(weather * 0.3 + F.col("lag_outage_24h") * 0.25 + load * 0.25 + age * 0.2, 0.0, 1.0)
    return df.withColumn("risk_probability", p).withColumns({
        "uncertainty_lower": F.greatest(F.lit(0.0), F.col("risk_probability") - 0.15),
        "uncertainty_upper": F.least(F.lit(1.0), F.col("risk_probability") + 0.15),
        "aleatoric": F.lit(0.09),
        "epistemic": F.lit(0.06),
        "confidence_level": F.lit(0.90),
    })


def snapshot_map(names: list[str]) -> Column:
    return F.map_from_arrays(
        F.array(*[F.lit(n) for n in names]),
        F.array(*[F.col(n).cast("double") for n in names]),
    )


def top_deviations(n: int = 10) -> Column:
    """The ``n`` inputs furthest from their default, as an array of (name, deviation): largest
    first, ties by name. Sorted inside the row: no shuffle."""
    entries = []
    for name in sorted(FEATURE_DEFAULTS):
        default = FEATURE_DEFAULTS[name]
        gap = F.abs(F.col(name) - default) if default != 0 else F.abs(F.col(name))
        entries.append(F.struct((-F.round(gap, 6)).alias("order"), F.lit(name).alias("name")))
    return F.transform(
        F.slice(F.array_sort(F.array(*entries)), 1, n),
        lambda e: F.struct(e["name"].alias("feature"), (-e["order"]).alias("deviation")),
    )


def prediction_records(df: DataFrame, model_version: str, time: str = "ts") -> DataFrame:
    names = list(FEATURE_DEFAULTS)
    return df.select(
        F.col(time).alias("predicted_at"), "cell", "region_code",
        F.lit(model_version).alias("model_version"), "risk_probability",
        "uncertainty_lower", "uncertainty_upper",
        risk_level(F.col("risk_probability"), F.col("region_code")).alias("risk_level"),
        snapshot_map(names).alias("features_snapshot"),
        top_deviations().alias("top_features"),
    )


def _by_level(level: Column, values: dict, default: Column) -> Column:
    return reduce(
        lambda acc, item: F.when(level == item[0], item[1]).otherwise(acc), values.items(), default
    )


def alerts_from(predictions: DataFrame, created: Column) -> DataFrame:
    """One alert per prediction above GREEN."""
    level = F.col("risk_level")
    hours = _by_level(
        level, {k: F.lit(v) for k, v in ALERT_TTL_HOURS.items()}, F.lit(DEFAULT_ALERT_TTL_HOURS)
    )
    actions = _by_level(
        level, {k: F.array(*[F.lit(a) for a in v]) for k, v in ALERT_ACTIONS.items()},
        F.array().cast("array<string>"),
    )
    kept = [c for c in ("id",) if c in predictions.columns]
    return predictions.filter(level != "GREEN").select(
        *kept,
        created.alias("created_at"),
        (created + F.make_dt_interval(hours=hours)).alias("expires_at"),
        "region_code", "cell",
        level.alias("severity"), "risk_probability",
        F.round(F.col("uncertainty_upper") - F.col("uncertainty_lower"), 4).alias("uncertainty_range"),
        _by_level(level, {k: F.lit(v) for k, v in ALERT_TEXT.items()}, F.lit(DEFAULT_ALERT_TEXT))
        .alias("description"),
        actions.alias("recommended_actions"),
        F.lit(False).alias("acknowledged"),
    )
