"""Reads and row changes of the service tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridgale.constants import LEVELS


def _between(column: str, start, end) -> Column:
    return F.col(column).between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp"))


def _newest(df: DataFrame, time: str, limit: int | None, tie: str) -> DataFrame:
    out = df.orderBy(F.col(time).desc(), F.col(tie).desc())
    return out.limit(limit) if limit is not None else out


def weather_by_state(df, state_fips, start, end, event_type=None, limit=10_000, tie="event_id"):
    out = df.filter((F.col("state_fips") == state_fips) & _between("event_time", start, end))
    if event_type is not None:
        out = out.filter(F.col("event_type") == event_type)
    return _newest(out, "event_time", limit, tie)


def weather_by_cell(df, cell, start, end, column="cell", tie="event_id"):
    out = df.filter((F.col(column) == cell) & _between("event_time", start, end))
    return _newest(out, "event_time", None, tie)


def outages_by(df, column, value, start, end, limit=10_000, tie="event_id"):
    """By county or by state, newest first."""
    out = df.filter((F.col(column) == value) & _between("observed_at", start, end))
    return _newest(out, "observed_at", limit, tie)


def mean_outage_fraction(df, county, start, end):
    """One row; null when the county has no observation in the range."""
    out = df.filter((F.col("county_fips") == county) & _between("observed_at", start, end))
    return out.agg(F.avg("outage_fraction").alias("mean_outage_fraction"))


def prediction_history(df, cell, start, end, model_version=None, limit=1_000):
    out = df.filter((F.col("cell") == cell) & _between("predicted_at", start, end))
    if model_version is not None:
        out = out.filter(F.col("model_version") == model_version)
    return _newest(out, "predicted_at", limit, "id")


def latest_predictions(df, region, limit=500):
    """Every prediction at its cell's newest time, riskiest first.

    The newest time per cell comes from an aggregate (combined map-side) joined back, so a cell
    with very many rows is never sorted in one task.
    """
    rows = df.filter(F.col("region_code") == region)
    newest = rows.groupBy("cell").agg(F.max("predicted_at").alias("predicted_at"))
    out = rows.join(newest, ["cell", "predicted_at"], "left_semi")
    out = out.orderBy(F.col("risk_probability").desc(), F.col("id"))
    return out.limit(limit) if limit is not None else out


def model_metrics(registry, region=None, model_name=None, limit=100):
    out = registry
    if region is not None:
        out = out.filter(F.col("region_code") == region)
    if model_name is not None:
        out = out.filter(F.col("model_name") == model_name)
    return out.orderBy(F.col("created_at").desc(), F.col("id")).limit(limit)


def is_open(now) -> Column:
    expiry = F.col("expires_at")
    return ~F.col("acknowledged") & (expiry.isNull() | (expiry > F.lit(now).cast("timestamp")))


def active_alerts(df, now, region=None, severity=None):
    out = df.filter(is_open(now))
    if region is not None:
        out = out.filter(F.col("region_code") == region)
    if severity is not None:
        out = out.filter(F.col("severity") == severity)
    return out.orderBy(F.col("created_at").desc(), F.col("id"))


def acknowledge(df: DataFrame, alert_id: int, by: str, now) -> DataFrame:
    hit = F.col("id") == alert_id
    previous_by = F.col("acknowledged_by") if "acknowledged_by" in df.columns else F.lit(None).cast("string")
    previous_at = F.col("acknowledged_at") if "acknowledged_at" in df.columns else F.lit(None).cast("timestamp")
    return df.withColumns({
        "acknowledged": F.when(hit, True).otherwise(F.col("acknowledged")),
        "acknowledged_by": F.when(hit, F.lit(by)).otherwise(previous_by),
        "acknowledged_at": F.when(hit, F.lit(now).cast("timestamp")).otherwise(previous_at),
    })


def without_settled(df: DataFrame, now) -> DataFrame:
    """What stays after deleting alerts that are both expired and acknowledged."""
    gone = F.col("acknowledged") & (F.col("expires_at") < F.lit(now).cast("timestamp"))
    return df.filter(~F.coalesce(gone, F.lit(False)))


def severity_rank(level: Column) -> Column:
    """RED first."""
    out = F.lit(len(LEVELS))
    for rank, name in enumerate(reversed(LEVELS)):
        out = F.when(level == name, F.lit(rank)).otherwise(out)
    return out


def alert_feed(df: DataFrame, severity: str | None = None) -> DataFrame:
    out = df if severity is None else df.filter(F.col("severity") == severity)
    return out.orderBy(severity_rank(F.col("severity")), F.col("created_at").desc(), F.col("id"))


def page(df: DataFrame, number: int, size: int) -> DataFrame:
    """Page ``number`` (from 1) of an ordered result."""
    return df.offset((number - 1) * size).limit(size)


def history_rows(df: DataFrame) -> DataFrame:
    """Service shape of stored predictions; a zero or missing upper bound reads as 1."""
    lower = F.coalesce("uncertainty_lower", F.lit(0.0))
    stored = F.coalesce("uncertainty_upper", F.lit(0.0))
    upper = F.when(stored == 0, 1.0).otherwise(stored)
    level = F.col("risk_level") if "risk_level" in df.columns else F.lit(None).cast("string")
    return df.select(
        F.col("id").cast("string").alias("prediction_id"), "cell",
        F.coalesce("region_code", F.lit("")).alias("region"),
        F.coalesce("risk_probability", F.lit(0.0)).alias("risk_probability"),
        lower.alias("lower"), upper.alias("upper"),
        F.lit(0.0).alias("aleatoric"),
        F.greatest(F.lit(0.0), (upper - lower) / 2).alias("epistemic"),
        F.lit(0.90).alias("confidence_level"),
        F.coalesce(level, F.lit("GREEN")).alias("risk_level"),
        F.coalesce("model_version", F.lit("unknown")).alias("model_version"),
        F.col("predicted_at").alias("computed_at"),
    )


# --- model registry --------------------------------------------------------------------------

def promote(registry: DataFrame, name: str, version: str, region: str, now) -> DataFrame:
    """Make one version the only active one among its name and region."""
    family = (F.col("model_name") == name) & (F.col("region_code") == region)
    chosen = family & (F.col("version") == version)
    promoted = F.col("promoted_at") if "promoted_at" in registry.columns else F.lit(None).cast("timestamp")
    return registry.withColumns({
        "is_active": F.when(family, chosen).otherwise(F.col("is_active")),
        "promoted_at": F.when(chosen, F.lit(now).cast("timestamp")).otherwise(promoted),
    })


def active_model(registry: DataFrame, name: str, region: str) -> DataFrame:
    return registry.filter(
        (F.col("model_name") == name) & (F.col("region_code") == region) & F.col("is_active")
    )
