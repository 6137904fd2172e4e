"""Exploration, case-study and dashboard queries (A*)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridgale.constants import CATEGORIES, SEVERE_TYPES
from gridgale.operators import analysis as an
from gridgale.operators import features as feat
from gridgale.operators import scoring as sc
from gridgale.plans.base import Source, query, rounded, tidy
from gridgale.plans.features import (
    _CATEGORY_POINTS,
    _FULL_ROLES,
    _FULL_SQL,
    _LABEL_SQL,
    CATEGORY_SQL,
    full_features,
)
from gridgale.plans.service import _level_sql

_CATS = f"SELECT *, {CATEGORY_SQL} AS cat FROM weather"


@query("a1_top_types", rounded(["weather"], """
    SELECT event_type, count(*) AS n FROM weather GROUP BY 1 ORDER BY n DESC, event_type LIMIT 10""", []))
def a1_top_types(s: Source) -> DataFrame:
    return an.top_types(s.weather, 10)


@query("a2_events_per_month", rounded(["scores"], """
    SELECT month(ts) AS month, count(*) AS n FROM scores GROUP BY 1""", []))
def a2_events_per_month(s: Source) -> DataFrame:
    return an.events_per_month(s.scores.withColumnRenamed("ts", "event_time"))


@query("a3_category_cooccurrence", rounded(["weather"], f"""
    WITH d AS (SELECT DISTINCT CAST(event_time AS DATE) AS day, cat FROM ({_CATS}) WHERE cat IS NOT NULL),
    c AS (SELECT DISTINCT unnest([{', '.join(repr(c) for c in CATEGORIES)}]) AS cat)
    SELECT a.cat AS category_a, b.cat AS category_b, (SELECT count(*) FROM d x JOIN d y
      ON x.day = y.day WHERE x.cat = a.cat AND y.cat = b.cat) * 100.0E0
      / (SELECT count(DISTINCT day) FROM d) AS pct_of_days FROM c a, c b""", ["pct_of_days"]))
def a3_category_cooccurrence(s: Source) -> DataFrame:
    return tidy(an.category_cooccurrence(s.weather))


@query("a4_damage_by_category_count", rounded(["weather"], f"""
    SELECT n AS n_categories, avg(damage) AS mean_daily_damage, count(*) AS days FROM (
      SELECT CAST(event_time AS DATE) AS day, count(DISTINCT cat) AS n, sum(damage_property) AS damage
      FROM ({_CATS}) WHERE cat IS NOT NULL GROUP BY 1) GROUP BY 1""", ["mean_daily_damage"], 2))
def a4_damage_by_category_count(s: Source) -> DataFrame:
    return tidy(an.damage_by_category_count(s.weather), 2)


_WINDOWS_SQL = f"""
    WITH b AS (SELECT min(event_time) AS lo, max(event_time) AS hi FROM weather),
    w AS (SELECT lo + INTERVAL 6 HOUR * i AS start FROM b, (SELECT unnest(range(0, 400)) AS i)
      WHERE lo + INTERVAL 6 HOUR * i + INTERVAL 48 HOUR <= hi),
    e AS (SELECT start, count(*) AS n_events, count(DISTINCT cat) AS n_categories,
        count(DISTINCT cell) AS n_cells, sum(damage_property) AS total_damage,
        max(magnitude) AS max_magnitude
      FROM w JOIN ({_CATS}) x ON x.event_time >= start AND x.event_time < start + INTERVAL 48 HOUR
      GROUP BY start HAVING count(*) >= 3),
    o AS (SELECT start, count(*) AS n_outage_records, count(DISTINCT cell) AS n_outage_cells,
        avg(outage_fraction) AS mean_of, max(outage_fraction) AS max_of
      FROM w JOIN outages x ON x.observed_at >= start AND x.observed_at < start + INTERVAL 72 HOUR
      GROUP BY start)
    SELECT e.start, e.start + INTERVAL 48 HOUR AS "end", n_categories, n_cells, n_events,
      total_damage, max_magnitude, coalesce(mean_of, 0) AS mean_outage_fraction,
      coalesce(max_of, 0) AS max_outage_fraction, coalesce(n_outage_cells, 0) AS n_outage_cells,
      coalesce(n_outage_records, 0) AS n_outage_records,
      n_categories * 10 + n_cells * 2 + n_events + ln(1 + total_damage)
        + coalesce(mean_of, 0) * 50 + coalesce(max_of, 0) * 20 AS score
    FROM e LEFT JOIN o USING (start)"""
_WINDOW_DOUBLES = ["total_damage", "mean_outage_fraction", "max_outage_fraction", "score"]


@query("a5_compound_windows", rounded(["weather", "outages"], _WINDOWS_SQL, _WINDOW_DOUBLES, 4))
def a5_compound_windows(s: Source) -> DataFrame:
    return tidy(an.compound_windows(s.weather, s.outages), 4)


@query("a5_densest_window", rounded(
    ["weather", "outages"],
    f"SELECT * FROM ({_WINDOWS_SQL}) ORDER BY round(score, 9) DESC, start LIMIT 1", _WINDOW_DOUBLES, 4,
))
def a5_densest_window(s: Source) -> DataFrame:
    return tidy(an.densest_window(s.weather, s.outages), 4)


_STORM = "event_time >= TIMESTAMP '2024-01-10 00:00:00' AND event_time < TIMESTAMP '2024-01-12 00:00:00'"


def _storm(s: Source) -> DataFrame:
    return an.within(s.weather, "event_time", "2024-01-10 00:00:00", "2024-01-12 00:00:00")


@query("a6_type_breakdown", rounded(["weather"], f"""
    SELECT event_type, count(*) AS n, max(magnitude) AS max_magnitude,
      sum(damage_property) AS total_damage FROM weather WHERE {_STORM} GROUP BY 1""",
    ["max_magnitude", "total_damage"], 3))
def a6_type_breakdown(s: Source) -> DataFrame:
    return tidy(an.type_breakdown(_storm(s)), 3)


@query("a7_category_breakdown", rounded(["weather"], f"""
    SELECT cat AS category, count(*) AS n, count(DISTINCT cell) AS cells FROM ({_CATS})
    WHERE cat IS NOT NULL AND {_STORM} GROUP BY 1""", []))
def a7_category_breakdown(s: Source) -> DataFrame:
    return an.category_breakdown(_storm(s))


@query("a7_active_pairs", rounded(["weather"], f"""
    SELECT DISTINCT a.cat || '+' || b.cat AS pair FROM (SELECT DISTINCT cat FROM ({_CATS}) WHERE {_STORM}) a
    JOIN (SELECT DISTINCT cat FROM ({_CATS}) WHERE {_STORM}) b ON a.cat < b.cat""", []))
def a7_active_pairs(s: Source) -> DataFrame:
    return an.active_pairs(_storm(s))


@query("a8_outage_bins", rounded(["outages"], """
    SELECT time_bucket(INTERVAL 3 HOUR, observed_at) AS bin_start, avg(outage_fraction) AS mean_fraction,
      max(outage_fraction) AS max_fraction, count(*) AS n FROM outages GROUP BY 1""",
    ["mean_fraction", "max_fraction"]))
def a8_outage_bins(s: Source) -> DataFrame:
    return tidy(an.outage_bins(s.outages))


def _compound_points(s: Source) -> DataFrame:
    return feat.with_cooccurrence(feat.per_category(s.points, s.weather))



_COUNT_SQL = "(" + " + ".join(f"(CASE WHEN cat_{c}_event_count > 0 THEN 1 ELSE 0 END)" for c in CATEGORIES) + ")"


@query("a9_anchors", rounded(["weather", "points"], f"""
    SELECT cell, ts FROM ({_CATEGORY_POINTS}) WHERE {_COUNT_SQL} >= 2""", []))
def a9_anchors(s: Source) -> DataFrame:
    return an.anchors(_compound_points(s)).select("cell", "ts")


@query("a9_context_rows", rounded(["weather", "outages"], """
    SELECT event_id, event_time FROM weather w WHERE EXISTS (SELECT 1 FROM outages o
      WHERE o.outage_fraction >= 0.5 AND w.event_time BETWEEN o.observed_at - INTERVAL 5 HOUR
      AND o.observed_at + INTERVAL 5 HOUR)""", []))
def a9_context_rows(s: Source) -> DataFrame:
    rows = s.weather.select("event_id", "event_time", F.col("event_time").alias("ts"))
    marks = s.outages.filter("outage_fraction >= 0.5").select(F.col("observed_at").alias("ts"))
    return an.context_rows(rows, marks, hours=5).select("event_id", "event_time")


# Every compound column: pairs, interactions, categories, sequence, counts and the index.
_PROFILED = feat.COMPOUND_GROUP
_PROFILE_SQL = f"""(UNPIVOT (SELECT {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in _PROFILED)} FROM ({_FULL_SQL}))
    ON {', '.join(_PROFILED)} INTO NAME feature VALUE v)"""


def _compound_columns(s: Source) -> DataFrame:
    return full_features(s).select(*_PROFILED)


@query("a10_column_profile", rounded(_FULL_ROLES, f"""
    SELECT feature, avg(v) AS mean, max(v) AS max, avg(CASE WHEN v > 0 THEN 1.0E0 ELSE 0.0E0 END) AS nonzero_pct
    FROM {_PROFILE_SQL} GROUP BY 1 HAVING max(v) > 0""", ["mean", "max", "nonzero_pct"], 4))
def a10_column_profile(s: Source) -> DataFrame:
    return tidy(an.column_profile(_compound_columns(s), _PROFILED), 4)


def _weights_frame(s: Source) -> DataFrame:
    """An importance per column, made from the part table: price shares of as many groups."""
    names = F.array(*[F.lit(c) for c in _PROFILED])
    return s.part.groupBy((F.col("p_partkey") % len(_PROFILED)).alias("i")).agg(
        (F.sum("p_retailprice") / 1e6).alias("importance")
    ).select(F.get(names, F.col("i").cast("int")).alias("feature"), "importance")


_IMPORTANCE_SQL = f"""(SELECT [{', '.join(repr(c) for c in _PROFILED)}][CAST(p_partkey % {len(_PROFILED)} + 1 AS INT)]
    AS feature, sum(p_retailprice) / 1e6 AS importance FROM part GROUP BY 1)"""


@query("a11_contributions", rounded(_FULL_ROLES, f"""
    SELECT feature, importance, mean_value, importance * size AS contribution FROM (
      SELECT feature, avg(abs(v)) AS size, avg(v) AS mean_value FROM {_PROFILE_SQL} GROUP BY 1
    ) JOIN {_IMPORTANCE_SQL} USING (feature) ORDER BY round(contribution, 9) DESC, feature LIMIT 15""",
    ["importance", "mean_value", "contribution"], 3))
def a11_contributions(s: Source) -> DataFrame:
    return tidy(an.contribution_scores(_compound_columns(s), _weights_frame(s), _PROFILED, 15), 3)


_PEAK = "greatest(" + ", ".join(f"cat_{c}_max_magnitude" for c in CATEGORIES) + ")"
_DOMINANT = f"CASE WHEN {_PEAK} = 0 THEN 'None' " + " ".join(
    f"WHEN cat_{c}_max_magnitude = {_PEAK} THEN '{c}'" for c in CATEGORIES) + " END"


@query("a12_dominant_by_label", rounded(["weather", "points", "outages"], f"""
    SELECT {_DOMINANT} AS event_type, count(*) FILTER (target_outage = 0) AS no_outage,
      count(*) FILTER (target_outage = 1) AS outage
    FROM ({_CATEGORY_POINTS}) JOIN ({_LABEL_SQL}) USING (cell, ts) GROUP BY 1""", []))
def a12_dominant_by_label(s: Source) -> DataFrame:
    rows = feat.labels(feat.per_category(s.points, s.weather), s.outages)
    return an.dominant_by_label(rows)


_CORR = ["magnitude", "damage_property", "outage_risk"]
_CORR_SQL = f"""SELECT magnitude, damage_property, CASE WHEN event_type IN
    ({', '.join(repr(t) for t in SEVERE_TYPES)}) THEN 1 ELSE 0 END AS outage_risk FROM weather"""


@query("a13_correlations", rounded(["weather"], " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM ({_CORR_SQL})" for a in _CORR for b in _CORR
), ["r"]))
def a13_correlations(s: Source) -> DataFrame:
    rows = s.weather.withColumn("outage_risk", F.col("event_type").isin(SEVERE_TYPES).cast("int"))
    return tidy(an.correlations(rows, _CORR))


@query("a14_fraction_histogram", rounded(["outages"], """
    SELECT CAST(least(floor(outage_fraction / 0.02E0), 49) AS INT) AS bin, count(*) AS n
    FROM outages GROUP BY 1""", []))
def a14_fraction_histogram(s: Source) -> DataFrame:
    return an.value_histogram(s.outages, "outage_fraction", 0.0, 1.0, 50)


@query("a14_label_counts", rounded(["weather", "points", "outages"], f"""
    SELECT target_outage, count(*) AS n FROM ({_LABEL_SQL}) GROUP BY 1""", []))
def a14_label_counts(s: Source) -> DataFrame:
    return feat.labels(s.points, s.outages).groupBy("target_outage").agg(F.count("*").alias("n"))


def _describe_sql(c: str) -> str:
    return f"""SELECT '{c}' AS column_name, count({c}) AS "count", avg({c}) AS mean,
      stddev_samp({c}) AS std, min({c}) AS min, quantile_cont({c}, 0.25) AS p25,
      quantile_cont({c}, 0.5) AS p50, quantile_cont({c}, 0.75) AS p75, max({c}) AS max FROM weather"""


@query("a15_describe", rounded(
    ["weather"], " UNION ALL ".join(_describe_sql(c) for c in ("magnitude", "damage_property")),
    ["mean", "std", "min", "p25", "p50", "p75", "max"], 3,
))
def a15_describe(s: Source) -> DataFrame:
    return tidy(an.describe(s.weather, ["magnitude", "damage_property"]), 3)


@query("a16_group_shares", f"""
    WITH i AS (SELECT [{', '.join(repr(c) for c in feat.FEATURES)}][CAST(p_partkey % 138 + 1 AS INT)]
        AS feature, sum(p_retailprice) / 1e6 AS importance FROM part GROUP BY 1),
    g AS (SELECT *, CASE WHEN feature IN ({', '.join(repr(c) for c in feat.TEMPORAL_GROUP)}) THEN 'temporal'
      WHEN feature IN ({', '.join(repr(c) for c in feat.SPATIAL_GROUP)}) THEN 'spatial'
      WHEN feature IN ({', '.join(repr(c) for c in feat.COMPOUND_GROUP)}) THEN 'compound'
      ELSE 'socioeconomic' END AS feature_group FROM i)
    SELECT feature_group, round(sum(importance) + 1e-9, 6) AS importance, count(*) AS n,
      round(sum(importance) / (SELECT sum(importance) FROM g) + 1e-9, 6) AS share FROM g GROUP BY 1""")
def a16_group_shares(s: Source) -> DataFrame:
    names = F.array(*[F.lit(c) for c in feat.FEATURES])
    importance = s.part.groupBy((F.col("p_partkey") % 138).alias("i")).agg(
        (F.sum("p_retailprice") / 1e6).alias("importance")
    ).select(F.get(names, F.col("i").cast("int")).alias("feature"), "importance")
    return tidy(an.importance_by_group(importance)[1])


@query("a17_dashboard", rounded(["predictions", "alerts"], f"""
    WITH p AS (SELECT *, {_level_sql('risk_probability', 'region_code')} AS lvl FROM predictions)
    SELECT 'cells_at_risk' AS kpi, CAST(count(*) FILTER (lvl <> 'GREEN') AS DOUBLE) AS value FROM p
    UNION ALL SELECT 'mean_confidence', avg(1 - (uncertainty_upper - uncertainty_lower)) FROM p
    {''.join(f" UNION ALL SELECT 'level_{lv}', count(*) FILTER (lvl = '{lv}') FROM p" for lv in ('GREEN', 'YELLOW', 'ORANGE', 'RED'))}
    UNION ALL SELECT 'open_alerts', count(*) FILTER (NOT acknowledged) FROM alerts""", ["value"]))
def a17_dashboard(s: Source) -> DataFrame:
    p = s.predictions.withColumn(
        "risk_level", sc.risk_level(F.col("risk_probability"), F.col("region_code"))
    )
    confidence = F.lit(1.0) - (F.col("uncertainty_upper") - F.col("uncertainty_lower"))
    return tidy(an.dashboard(p, s.alerts, confidence))


@query("a18_history_kpis", rounded(["outages"], """
    SELECT count(*) AS total_outages, sum(CAST(floor(outage_fraction * 1000) AS BIGINT))::BIGINT
      AS total_customers,
      avg(CASE WHEN event_id % 6 = 0 THEN 0 ELSE event_id % 240 END) AS mean_duration,
      avg(CASE WHEN event_id % 4 = 0 THEN 1.0E0 ELSE 0.0E0 END) AS predicted_share FROM outages""",
    ["mean_duration", "predicted_share"]))
def a18_history_kpis(s: Source) -> DataFrame:
    rows = s.outages.select(
        F.floor(F.col("outage_fraction") * 1000).alias("customers_affected"),
        F.when(F.col("event_id") % 6 != 0, (F.col("event_id") % 240).cast("double")).alias("duration_minutes"),
        (F.col("event_id") % 4 == 0).alias("was_predicted"),
    )
    return tidy(an.history_kpis(rows))


@query("a10_full_profile", rounded(_FULL_ROLES, f"""
    SELECT avg(compound_severity_index) AS mean_severity, max(compound_severity_index) AS max_severity,
      avg(seq_max_gap_hours) AS mean_gap, sum(has_compound_event) AS compound_points FROM ({_FULL_SQL})""",
    ["mean_severity", "max_severity", "mean_gap"]))
def a10_full_profile(s: Source) -> DataFrame:
    return tidy(full_features(s).agg(
        F.avg("compound_severity_index").alias("mean_severity"),
        F.max("compound_severity_index").alias("max_severity"),
        F.avg("seq_max_gap_hours").alias("mean_gap"),
        F.sum("has_compound_event").alias("compound_points"),
    ))


