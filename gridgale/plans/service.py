"""Service table reads and writes (Q*), scoring and alerts (R*), the model registry (M20)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridgale.constants import (
    ALERT_ACTIONS,
    ALERT_TEXT,
    DEFAULT_THRESHOLDS,
    DEMO_THRESHOLDS,
    FEATURE_DEFAULTS,
    LEGACY_THRESHOLDS,
)
from gridgale.operators import scoring as sc
from gridgale.operators import tables as tb
from gridgale.operators.ordering import numbered
from gridgale.plans.base import Source, query, rounded, tidy
from gridgale.plans.features import (
    _NEAR_OUTAGES,
    _NEAR_WEATHER,
    _outage_sql,
    _per_point,
    _rolling_sql,
    full_features,
)

NOW = "2024-01-20 00:00:00"
FROM, TO = "2024-01-05 00:00:00", "2024-01-25 00:00:00"
_RANGE = f"BETWEEN TIMESTAMP '{FROM}' AND TIMESTAMP '{TO}'"


@query("q1_weather_by_state", rounded(["weather"], f"""
    SELECT event_id, event_time, event_type, magnitude FROM weather WHERE state_fips = '48'
    AND event_time {_RANGE} AND event_type = 'Tornado'
    ORDER BY event_time DESC, event_id DESC LIMIT 10000""", []))
def q1_weather_by_state(s: Source) -> DataFrame:
    out = tb.weather_by_state(s.weather, "48", FROM, TO, "Tornado")
    return out.select("event_id", "event_time", "event_type", "magnitude")


@query("q2_weather_by_cell", rounded(["weather"], f"""
    SELECT event_id, event_time, event_type, magnitude FROM weather WHERE cell = 8
    AND event_time {_RANGE}""", []))
def q2_weather_by_cell(s: Source) -> DataFrame:
    out = tb.weather_by_cell(s.weather, 8, FROM, TO)
    return out.select("event_id", "event_time", "event_type", "magnitude")


_COUNTIES = "SELECT event_id, timestamp_raw AS observed_at, lpad(county_fips, 5, '0') AS county_fips," \
    " customers_out / 1000.0E0 AS outage_fraction FROM raw_outages"


def _county_outages(s: Source) -> DataFrame:
    return s.raw_outages.select(
        "event_id", F.col("timestamp_raw").alias("observed_at"),
        F.lpad("county_fips", 5, "0").alias("county_fips"),
        (F.col("customers_out") / 1000.0).alias("outage_fraction"),
    )


@query("q3_outages_by_county", rounded(["raw_outages"], f"""
    SELECT * FROM ({_COUNTIES}) WHERE county_fips = '06012' AND observed_at {_RANGE}""",
    ["outage_fraction"]))
def q3_outages_by_county(s: Source) -> DataFrame:
    return tidy(tb.outages_by(_county_outages(s), "county_fips", "06012", FROM, TO))


@query("q4_mean_outage_fraction", rounded(["raw_outages"], f"""
    SELECT avg(outage_fraction) AS mean_outage_fraction FROM ({_COUNTIES})
    WHERE county_fips = '06012' AND observed_at {_RANGE}""", ["mean_outage_fraction"]))
def q4_mean_outage_fraction(s: Source) -> DataFrame:
    return tidy(tb.mean_outage_fraction(_county_outages(s), "06012", FROM, TO))


@query("q5_prediction_history", rounded(["predictions"], f"""
    SELECT id, predicted_at, risk_probability FROM predictions WHERE cell = 8
    AND predicted_at {_RANGE} AND model_version = 'v1'
    ORDER BY predicted_at DESC, id DESC LIMIT 1000""", ["risk_probability"]))
def q5_prediction_history(s: Source) -> DataFrame:
    out = tb.prediction_history(s.predictions, 8, FROM, TO, "v1")
    return tidy(out.select("id", "predicted_at", "risk_probability"))


@query("q6_latest_predictions", rounded(["predictions"], """
    SELECT p.id, p.cell, p.predicted_at, p.risk_probability FROM predictions p
    JOIN (SELECT cell, max(predicted_at) AS m FROM predictions WHERE region_code = 'TX' GROUP BY cell) l
      ON p.cell = l.cell AND p.predicted_at = l.m WHERE p.region_code = 'TX'
    ORDER BY p.risk_probability DESC, p.id LIMIT 500""", ["risk_probability"]))
def q6_latest_predictions(s: Source) -> DataFrame:
    out = tb.latest_predictions(s.predictions, "TX")
    return tidy(out.select("id", "cell", "predicted_at", "risk_probability"))


@query("q7_model_metrics", rounded(["model_registry"], """
    SELECT id, model_name, version, auc, created_at FROM model_registry WHERE region_code = 'TX'
    AND model_name = 'gbt_a' ORDER BY created_at DESC, id LIMIT 100""", ["auc"]))
def q7_model_metrics(s: Source) -> DataFrame:
    out = tb.model_metrics(s.model_registry, "TX", "gbt_a")
    return tidy(out.select("id", "model_name", "version", "auc", "created_at"))


_OPEN = f"NOT acknowledged AND (expires_at IS NULL OR expires_at > TIMESTAMP '{NOW}')"


@query("q8_active_alerts", rounded(["alerts"], f"""
    SELECT id, created_at, severity, cell FROM alerts WHERE {_OPEN} AND region_code = 'CA'
    AND severity = 'ORANGE'""", []))
def q8_active_alerts(s: Source) -> DataFrame:
    out = tb.active_alerts(s.alerts, NOW, "CA", "ORANGE")
    return out.select("id", "created_at", "severity", "cell")


_FIRST_ALERT = "(SELECT min(id) FROM alerts)"


@query("q9_acknowledge", rounded(["alerts"], f"""
    SELECT id, acknowledged OR id = {_FIRST_ALERT} AS acknowledged,
      CASE WHEN id = {_FIRST_ALERT} THEN 'ops' END AS acknowledged_by,
      CASE WHEN id = {_FIRST_ALERT} THEN TIMESTAMP '{NOW}' END AS acknowledged_at FROM alerts""", []))
def q9_acknowledge(s: Source) -> DataFrame:
    first = s.alerts.agg(F.min("id")).first()[0]
    return tb.acknowledge(s.alerts, first, "ops", NOW).select(
        "id", "acknowledged", "acknowledged_by", "acknowledged_at"
    )


@query("q10_delete_settled", rounded(["alerts"], f"""
    SELECT id, severity FROM alerts WHERE NOT (acknowledged AND coalesce(
      expires_at < TIMESTAMP '{NOW}', false))""", []))
def q10_delete_settled(s: Source) -> DataFrame:
    return tb.without_settled(s.alerts, NOW).select("id", "severity")


_RANK = "CASE severity WHEN 'RED' THEN 0 WHEN 'ORANGE' THEN 1 WHEN 'YELLOW' THEN 2 ELSE 3 END"


@query("q11_alert_feed", rounded(["alerts"], f"""
    SELECT id, severity, created_at, row_number() OVER (ORDER BY {_RANK}, created_at DESC, id) AS place
    FROM alerts""", []))
def q11_alert_feed(s: Source) -> DataFrame:
    """The whole feed; its order is shown as a place, numbered without a single-task window."""
    feed = tb.alert_feed(s.alerts).select(
        "id", "severity", "created_at", tb.severity_rank(F.col("severity")).alias("_rank"),
        (-F.unix_micros(F.col("created_at").cast("timestamp"))).alias("_age"),
    )
    return numbered(feed, ["_rank", "_age", "id"]).select(
        "id", "severity", "created_at", (F.col("position") + 1).alias("place")
    )


@query("q12_page", rounded(["predictions"], """
    SELECT id, predicted_at FROM predictions ORDER BY predicted_at DESC, id DESC LIMIT 20 OFFSET 40""", []))
def q12_page(s: Source) -> DataFrame:
    ordered = s.predictions.orderBy(F.col("predicted_at").desc(), F.col("id").desc())
    return tb.page(ordered, 3, 20).select("id", "predicted_at")


@query("q13_history_rows", rounded(["predictions"], """
    SELECT CAST(id AS VARCHAR) AS prediction_id, cell, region_code AS region, risk_probability,
      coalesce(lo, 0.0) AS lower,
      CASE WHEN coalesce(hi, 0) = 0 THEN 1.0E0 ELSE hi END AS upper, 0.0E0 AS aleatoric,
      greatest(0.0, (CASE WHEN coalesce(hi, 0) = 0 THEN 1.0E0 ELSE hi END - coalesce(lo, 0.0)) / 2)
        AS epistemic, 0.9E0 AS confidence_level, 'GREEN' AS risk_level, model_version,
      predicted_at AS computed_at
    FROM (SELECT *, CASE WHEN id % 5 = 0 THEN NULL ELSE uncertainty_lower END AS lo,
      CASE WHEN id % 7 = 0 THEN NULL ELSE uncertainty_upper END AS hi FROM predictions)""",
    ["risk_probability", "lower", "upper", "epistemic"]))
def q13_history_rows(s: Source) -> DataFrame:
    rows = s.predictions.withColumns({
        "uncertainty_lower": F.when(F.col("id") % 5 != 0, F.col("uncertainty_lower")),
        "uncertainty_upper": F.when(F.col("id") % 7 != 0, F.col("uncertainty_upper")),
    })
    return tidy(tb.history_rows(rows))


# --- scoring -------------------------------------------------------------------------------

_REGION_SQL = "CASE cell % 3 WHEN 0 THEN 'TX' WHEN 1 THEN 'CA' ELSE 'FL' END"


def region() -> Column:
    return F.expr(_REGION_SQL)


def scored_points(s: Source) -> DataFrame:
    """Full features of every point, scored without a model."""
    rows = full_features(s).withColumn("region_code", region())
    return sc.heuristic_score(rows)


_SCORE_SQL = """least(1.0, greatest(0.0, 0.3 * least(1.0, weather_count_24h / 10.0)
    + 0.25 * lag_outage_24h + 0.25 * (greatest(0.0, load_capacity_ratio - 0.7) / 0.3)
    + 0.2 * (avg_line_age_years / 50.0)))"""
_SCORED_ROLES = ["weather", "points", "outages", "grid_load", "infra"]
_SCORED_SQL = f"""
    SELECT cell, ts, {_REGION_SQL} AS region_code, {_SCORE_SQL} AS risk_probability FROM (
      SELECT p.cell, p.ts, coalesce(w.weather_count_24h, 0.0) AS weather_count_24h,
        coalesce(o.lag_outage_24h, 0.0) AS lag_outage_24h,
        coalesce(l.load_capacity_ratio, 0.0) AS load_capacity_ratio,
        coalesce(i.avg_line_age_years, 0.0) AS avg_line_age_years
      FROM points p
      LEFT JOIN ({_per_point(_rolling_sql(), _NEAR_WEATHER)}) w USING (cell, ts)
      LEFT JOIN ({_per_point(_outage_sql(), _NEAR_OUTAGES)}) o USING (cell, ts)
      LEFT JOIN (SELECT q.ts, max_by(g.load_mw / g.capacity_mw, g.recorded_at) AS load_capacity_ratio
        FROM (SELECT DISTINCT ts FROM points) q JOIN grid_load g ON g.recorded_at
        BETWEEN q.ts - INTERVAL 1 HOUR AND q.ts + INTERVAL 1 HOUR GROUP BY q.ts) l ON l.ts = p.ts
      LEFT JOIN infra i ON i.cell = p.cell)"""


def _level_sql(p: str, region: str) -> str:
    return f"""CASE WHEN {p} >= CASE WHEN {region} = 'TX' THEN 0.80E0 ELSE 0.75E0 END THEN 'RED'
      WHEN {p} >= CASE WHEN {region} = 'TX' THEN 0.55E0 ELSE 0.50E0 END THEN 'ORANGE'
      WHEN {p} >= CASE WHEN {region} = 'TX' THEN 0.25E0 ELSE 0.20E0 END THEN 'YELLOW' ELSE 'GREEN' END"""


@query("r1_batch_scores", rounded(_SCORED_ROLES, f"""
    SELECT cell, ts, region_code, risk_probability, greatest(0.0, risk_probability - 0.15)
      AS uncertainty_lower, least(1.0, risk_probability + 0.15) AS uncertainty_upper
    FROM ({_SCORED_SQL})""", ["risk_probability", "uncertainty_lower", "uncertainty_upper"]))
def r1_batch_scores(s: Source) -> DataFrame:
    return tidy(scored_points(s).select(
        "cell", "ts", "region_code", "risk_probability", "uncertainty_lower", "uncertainty_upper"
    ))


@query("r2_defaults_and_overrides", rounded(["weather"], """
    SELECT event_id, 20.0E0 AS weather_count_24h, 0.15E0 AS reserve_margin_pct,
      magnitude AS avg_line_age_years, 100.0E0 AS population_density,
      sin(2 * pi() * (hour(event_time) + minute(event_time) / 60.0) / 24) AS hour_sin,
      CASE WHEN isodow(event_time) >= 6 THEN 1.0E0 ELSE 0.0E0 END AS is_weekend FROM weather""",
    ["hour_sin"]))
def r2_defaults_and_overrides(s: Source) -> DataFrame:
    rows = s.weather.withColumn("avg_line_age_years", F.col("magnitude"))
    out = sc.with_defaults(rows, {"weather_count_24h": 20.0, "unknown_name": 9.0}, "event_time")
    return tidy(out.select(
        "event_id", "weather_count_24h", "reserve_margin_pct", "avg_line_age_years",
        "population_density", "hour_sin", "is_weekend",
    ))


def _what_if(s: Source) -> DataFrame:
    """A scoring input per event: four columns from data, the rest defaults."""
    rows = s.weather.select(
        "event_id", "event_time", "cell", region().alias("region_code"),
        (F.col("magnitude") / 10).alias("weather_count_24h"),
        (F.col("event_id") % 100 / 100.0).alias("lag_outage_24h"),
        (F.lit(0.5) + F.col("event_id") % 50 / 100.0).alias("load_capacity_ratio"),
        (F.col("cell") % 60).cast("double").alias("avg_line_age_years"),
    )
    return sc.with_defaults(rows, time="event_time")


_WHAT_IF_SQL = f"""
    SELECT event_id, event_time, cell, {_REGION_SQL} AS region_code,
      magnitude / 10 AS weather_count_24h, event_id % 100 / 100.0E0 AS lag_outage_24h,
      0.5E0 + event_id % 50 / 100.0E0 AS load_capacity_ratio,
      CAST(cell % 60 AS DOUBLE) AS avg_line_age_years FROM weather"""


@query("r3_heuristic_score", rounded(["weather"], f"""
    SELECT event_id, risk_probability, greatest(0.0, risk_probability - 0.15) AS uncertainty_lower,
      least(1.0, risk_probability + 0.15) AS uncertainty_upper, 0.09E0 AS aleatoric, 0.06E0 AS epistemic
    FROM (SELECT event_id, {_SCORE_SQL} AS risk_probability FROM ({_WHAT_IF_SQL}))""",
    ["risk_probability", "uncertainty_lower", "uncertainty_upper"]))
def r3_heuristic_score(s: Source) -> DataFrame:
    return tidy(sc.heuristic_score(_what_if(s)).select(
        "event_id", "risk_probability", "uncertainty_lower", "uncertainty_upper", "aleatoric",
        "epistemic",
    ))


@query("r4_risk_level", rounded(["predictions"], f"""
    SELECT id, region_code, {_level_sql('risk_probability', 'region_code')} AS risk_level
    FROM predictions""", []))
def r4_risk_level(s: Source) -> DataFrame:
    level = sc.risk_level(F.col("risk_probability"), F.col("region_code"))
    return s.predictions.select("id", "region_code", level.alias("risk_level"))


@query("r4_region_table_join", rounded(["predictions"], """
    SELECT region_code, name, count(*) FILTER (risk_probability >= red) AS n_red,
      count(*) FILTER (risk_probability >= yellow) AS n_alerting
    FROM predictions JOIN (VALUES ('TX', 'Texas', 0.25E0, 0.80E0), ('CA', 'California', 0.20E0, 0.75E0),
      ('FL', 'Florida', 0.20E0, 0.75E0)) t(region_code, name, yellow, red) USING (region_code)
    GROUP BY 1, 2""", []))
def r4_region_table_join(s: Source) -> DataFrame:
    """Predictions against the region table: three rows, joined by Spark's own choice."""
    p, bound = F.col("risk_probability"), F.col("risk_thresholds")
    rows = s.predictions.join(sc.region_table(s.spark), "region_code")
    return rows.groupBy("region_code", "name").agg(
        F.count_if(p >= bound["RED"]).alias("n_red"), F.count_if(p >= bound["YELLOW"]).alias("n_alerting")
    )


def _simple_level(p: str, bounds: tuple[float, float, float]) -> str:
    y, o, r = bounds
    return f"CASE WHEN {p} >= {r}E0 THEN 'RED' WHEN {p} >= {o}E0 THEN 'ORANGE' WHEN {p} >= {y}E0 THEN 'YELLOW' ELSE 'GREEN' END"


@query("r4b_other_level_rules", rounded(["predictions"], f"""
    SELECT id, {_simple_level('risk_probability', LEGACY_THRESHOLDS)} AS legacy_level,
      {_simple_level('risk_probability', DEMO_THRESHOLDS)} AS demo_level,
      {_simple_level('risk_probability', DEFAULT_THRESHOLDS)} AS default_level FROM predictions""", []))
def r4b_other_level_rules(s: Source) -> DataFrame:
    p = F.col("risk_probability")
    return s.predictions.select(
        "id", sc.level_for(p, LEGACY_THRESHOLDS).alias("legacy_level"),
        sc.level_for(p, DEMO_THRESHOLDS).alias("demo_level"),
        sc.level_for(p, DEFAULT_THRESHOLDS).alias("default_level"),
    )


def _deviation_sql() -> str:
    """All 27 inputs as (event_id, feature, deviation) rows."""
    made = {"weather_count_24h", "lag_outage_24h", "load_capacity_ratio", "avg_line_age_years"}
    angle = "2 * pi() * (hour(event_time) + minute(event_time) / 60.0) / 24"
    dow, month = "2 * pi() * (isodow(event_time) - 1) / 7", "2 * pi() * (month(event_time) - 1) / 12"
    calendar = {
        "hour_sin": f"sin({angle})", "hour_cos": f"cos({angle})", "dow_sin": f"sin({dow})",
        "dow_cos": f"cos({dow})", "month_sin": f"sin({month})", "month_cos": f"cos({month})",
        "is_weekend": "CASE WHEN isodow(event_time) >= 6 THEN 1.0E0 ELSE 0.0E0 END",
    }
    rows = []
    for name, default in FEATURE_DEFAULTS.items():
        value = name if name in made else calendar.get(name, f"{default}E0")
        gap = f"abs({value} - {default}E0)" if default else f"abs({value})"
        rows.append(f"SELECT event_id, '{name}' AS feature, round({gap}, 6) AS deviation FROM x")
    return " UNION ALL ".join(rows)


@query("r5_top_deviations", rounded(["weather"], f"""
    SELECT event_id, rank, feature, deviation FROM (SELECT *, row_number() OVER (
      PARTITION BY event_id ORDER BY round(deviation, 6) DESC, feature) AS rank
      FROM (WITH x AS ({_WHAT_IF_SQL}) {_deviation_sql()})) WHERE rank <= 10""", ["deviation"], 5))
def r5_top_deviations(s: Source) -> DataFrame:
    rows = _what_if(s).select("event_id", F.posexplode(sc.top_deviations()).alias("i", "d"))
    return tidy(rows.select(
        "event_id", (F.col("i") + 1).alias("rank"), "d.feature", "d.deviation"
    ), 5)


_TTL = "CASE severity WHEN 'RED' THEN 12 WHEN 'ORANGE' THEN 24 ELSE 48 END"
_TEXTS = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ALERT_TEXT.items())
_COUNTS = " ".join(f"WHEN '{k}' THEN {len(v)}" for k, v in ALERT_ACTIONS.items())
_FIRSTS = " ".join(f"WHEN '{k}' THEN '{v[0]}'" for k, v in ALERT_ACTIONS.items())


@query("r6_alerts", rounded(["predictions"], f"""
    SELECT id, predicted_at AS created_at, predicted_at + INTERVAL 1 HOUR * {_TTL} AS expires_at,
      region_code, cell, severity, risk_probability,
      round(least(1.0E0, floor(risk_probability * 1000) / 1000 + 0.1E0)
        - greatest(0.0E0, floor(risk_probability * 1000) / 1000 - 0.1E0), 4) AS uncertainty_range,
      CASE severity {_TEXTS} END AS description, CASE severity {_COUNTS} END AS n_actions,
      CASE severity {_FIRSTS} END AS first_action FROM (
      SELECT *, {_level_sql('risk_probability', 'region_code')} AS severity FROM predictions)
    WHERE severity <> 'GREEN'""", ["risk_probability", "uncertainty_range"]))
def r6_alerts(s: Source) -> DataFrame:
    # Bounds on a grid of thousandths: a difference with a 5 in the fifth place has no agreed
    # rounding to four places between engines.
    grid = F.floor(F.col("risk_probability") * 1000) / 1000
    p = s.predictions.withColumns({
        "risk_level": sc.risk_level(F.col("risk_probability"), F.col("region_code")),
        "uncertainty_upper": F.least(F.lit(1.0), grid + 0.1),
        "uncertainty_lower": F.greatest(F.lit(0.0), grid - 0.1),
    })
    return tidy(sc.alerts_from(p, F.col("predicted_at")).select(
        "id", "created_at", "expires_at", "region_code", "cell", "severity", "risk_probability",
        "uncertainty_range", "description", F.size("recommended_actions").alias("n_actions"),
        F.get("recommended_actions", 0).alias("first_action"),
    ))


@query("r7_prediction_records", rounded(["weather"], f"""
    SELECT event_time AS predicted_at, cell, region_code, 'ensemble-v1.0' AS model_version,
      risk_probability, {_level_sql('risk_probability', 'region_code')} AS risk_level,
      27 AS n_features, load_capacity_ratio AS snapshot_ratio, 30.0E0 AS snapshot_housing
    FROM (SELECT *, {_SCORE_SQL} AS risk_probability FROM ({_WHAT_IF_SQL}))""",
    ["risk_probability", "snapshot_ratio"]))
def r7_prediction_records(s: Source) -> DataFrame:
    rows = sc.prediction_records(sc.heuristic_score(_what_if(s)), "ensemble-v1.0", "event_time")
    snapshot = F.col("features_snapshot")
    return tidy(rows.select(
        "predicted_at", "cell", "region_code", "model_version", "risk_probability", "risk_level",
        F.size(snapshot).alias("n_features"), snapshot["load_capacity_ratio"].alias("snapshot_ratio"),
        snapshot["housing_age_median"].alias("snapshot_housing"),
    ))


# --- registry --------------------------------------------------------------------------------

_PICK = "(SELECT min(version) FROM model_registry WHERE model_name = 'gbt_a' AND region_code = 'CA')"


@query("m20_promote", rounded(["model_registry"], f"""
    SELECT id, CASE WHEN model_name = 'gbt_a' AND region_code = 'CA' THEN version = {_PICK}
      ELSE is_active END AS is_active FROM model_registry""", []))
def m20_promote(s: Source) -> DataFrame:
    family = s.model_registry.filter("model_name = 'gbt_a' AND region_code = 'CA'")
    version = family.agg(F.min("version")).first()[0]
    out = tb.promote(s.model_registry, "gbt_a", version, "CA", NOW)
    return out.select("id", "is_active")


@query("m20_active_model", rounded(["model_registry"], f"""
    SELECT id, model_name, version, region_code FROM model_registry
    WHERE model_name = 'gbt_a' AND region_code = 'CA' AND version = {_PICK}""", []))
def m20_active_model(s: Source) -> DataFrame:
    family = s.model_registry.filter("model_name = 'gbt_a' AND region_code = 'CA'")
    version = family.agg(F.min("version")).first()[0]
    promoted = tb.promote(s.model_registry, "gbt_a", version, "CA", NOW)
    return tb.active_model(promoted, "gbt_a", "CA").select("id", "model_name", "version", "region_code")


