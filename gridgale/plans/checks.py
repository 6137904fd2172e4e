"""Data-quality jobs (V*)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridgale.constants import ALERT_TYPES, STATION_RANGES
from gridgale.operators import normalize as norm
from gridgale.operators import quality as q
from gridgale.plans.base import Source, query, rounded, tidy
from gridgale.session import staging_path
from gridgale.sources import tables as store


def _report_sql(source: str, rules: dict[str, str], warnings: dict[str, str] | None = None) -> str:
    """Report over ``source``; every rule is an SQL condition that must be true."""
    ok = " AND ".join(f"coalesce({c}, false)" for c in rules.values())
    cols = [f"count(*) FILTER (NOT coalesce({c}, false)) AS bad_{n}" for n, c in rules.items()]
    cols += [
        f"count(*) FILTER (({ok}) AND coalesce({c}, false)) AS warn_{n}"
        for n, c in (warnings or {}).items()
    ]
    return f"""SELECT count(*) AS total_records, count(*) FILTER ({ok}) AS valid_records,
        count(*) - count(*) FILTER ({ok}) AS invalid_records,
        CASE WHEN count(*) > 0 THEN (count(*) - count(*) FILTER ({ok})) * 1.0E0 / count(*)
          ELSE 0.0E0 END AS drop_rate{''.join(', ' + c for c in cols)} FROM {source}"""


def _upper(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.upper() for c in df.columns])


@query("v1_storm_report", rounded(["raw_storms"], _report_sql("raw_storms", {
    "time": "begin_date_time IS NOT NULL", "type": "event_type IS NOT NULL",
    "coordinates": "begin_lat BETWEEN -90 AND 90 AND begin_lon BETWEEN -180 AND 180"
                   " AND NOT (begin_lat = 0 AND begin_lon = 0)",
}), ["drop_rate"]))
def v1_storm_report(s: Source) -> DataFrame:
    return tidy(q.storm_rules().report(_upper(s.raw_storms)))


@query("v2_alert_report", rounded(["raw_alerts"], _report_sql(
    "raw_alerts",
    {"type": "length(event_type) > 0", "severity": "severity IS NOT NULL"},
    {"unknown_type": f"event_type NOT IN ({', '.join(repr(t) for t in ALERT_TYPES)})",
     "no_geometry": "lat IS NULL OR lon IS NULL"},
), ["drop_rate"]))
def v2_alert_report(s: Source) -> DataFrame:
    return tidy(q.alert_rules().report(s.raw_alerts))


def _reading(c: str) -> str:
    return f"CASE WHEN {c} IN ('M', '') THEN NULL WHEN {c} = 'T' THEN 0.001E0 ELSE CAST({c} AS DOUBLE) END"


_MEASURED = ["tmpf", "sknt", "gust", "p01i", "relh"]


@query("v3_station_report", rounded(["raw_station"], _report_sql(
    "(SELECT valid, station, " + ", ".join(f"{_reading(c)} AS {c}" for c in _MEASURED)
    + " FROM raw_station)",
    {"time": "valid IS NOT NULL"}
    | {c: f"{c} IS NULL OR {c} BETWEEN {STATION_RANGES[c][0]} AND {STATION_RANGES[c][1]}"
       for c in STATION_RANGES if c in _MEASURED}
    | {"station": "station IS NOT NULL"},
), ["drop_rate"]))
def v3_station_report(s: Source) -> DataFrame:
    rows = norm.clean_station_rows(s.raw_station)
    return tidy(q.station_rules(rows).report(rows))


_OUTAGE_RULES = {
    "county": "regexp_matches(lpad(county_fips, 5, '0'), '^[0-9]{5}$')",
    "customers_out": "customers_out >= 0", "total_customers": "total_customers > 0",
    "time": "timestamp_raw IS NOT NULL",
}


@query("v4_outage_report", rounded(["raw_outages"], _report_sql(
    "raw_outages", _OUTAGE_RULES, {"over_total": "customers_out > total_customers"},
), ["drop_rate"]))
def v4_outage_report(s: Source) -> DataFrame:
    rows = s.raw_outages.withColumnRenamed("timestamp_raw", "observed_at")
    return tidy(q.outage_rules(rows).report(rows))


@query("v5_grid_report", rounded(["raw_grid"], _report_sql(
    "raw_grid",
    {"load": "load_mw > 0", "frequency": "frequency_hz BETWEEN 59.5E0 AND 60.5E0",
     "capacity": "capacity_mw > 0"},
    {"frequency": "frequency_hz < 59.9E0 OR frequency_hz > 60.1E0",
     "overload": "load_mw > capacity_mw"},
), ["drop_rate"]))
def v5_grid_report(s: Source) -> DataFrame:
    return tidy(q.grid_rules(s.raw_grid).report(s.raw_grid))


_UTILITY_COLS = ["transmission_line_miles", "substations_count", "generation"]


@query("v6_utility_report", rounded(["raw_utilities"], _report_sql(
    "raw_utilities",
    {f"negative_{c}": f"TRY_CAST({c} AS DOUBLE) IS NULL OR TRY_CAST({c} AS DOUBLE) >= 0"
     for c in _UTILITY_COLS}
    | {"any_measure": " OR ".join(f"TRY_CAST({c} AS DOUBLE) IS NOT NULL" for c in _UTILITY_COLS)},
), ["drop_rate"]))
def v6_utility_report(s: Source) -> DataFrame:
    return tidy(q.utility_rules(s.raw_utilities).report(s.raw_utilities))


@query("v7_demographic_report", rounded(["raw_census"], _report_sql(
    "raw_census",
    {"population": "CAST(total_population AS DOUBLE) > 0",
     "county": "regexp_matches(county_fips, '^[0-9]{5}$')"},
    {"income": "NOT coalesce(CAST(median_household_income AS DOUBLE) > 0, false)",
     "poverty": "coalesce(CAST(population_below_poverty AS DOUBLE), 0) > CAST(total_population AS DOUBLE)"},
), ["drop_rate"]))
def v7_demographic_report(s: Source) -> DataFrame:
    return tidy(q.demographic_rules(s.raw_census).report(s.raw_census))


_V8_SQL = """
    SELECT event_id, column_name, check_name FROM (
      SELECT event_id, 'county_fips' AS column_name, 'matches' AS check_name FROM raw_outages
        WHERE NOT regexp_matches(county_fips, '^[0-9]{5}$')
      UNION ALL SELECT event_id, 'customers_out', 'ge(0)' FROM raw_outages WHERE customers_out < 0
      UNION ALL SELECT event_id, 'total_customers', 'gt(0)' FROM raw_outages WHERE total_customers <= 0
      UNION ALL SELECT event_id, 'outage_fraction', 'not_null' FROM raw_outages
        WHERE total_customers = 0
      UNION ALL SELECT event_id, 'outage_fraction', 'ge(0)' FROM raw_outages
        WHERE total_customers > 0 AND customers_out < 0
      UNION ALL SELECT event_id, 'outage_fraction', 'le(1)' FROM raw_outages
        WHERE total_customers > 0 AND customers_out > total_customers
      UNION ALL SELECT event_id, 'state_fips', 'matches' FROM raw_outages
        WHERE NOT regexp_matches(left(county_fips, 2), '^[0-9]{2}$'))"""


@query("v8_constraint_failures", rounded(["raw_outages"], _V8_SQL, []))
def v8_constraint_failures(s: Source) -> DataFrame:
    rows = s.raw_outages.select(
        "event_id", F.col("timestamp_raw").alias("observed_at"), "county_fips",
        F.left("county_fips", F.lit(2)).alias("state_fips"), "customers_out", "total_customers",
        F.try_divide(F.col("customers_out").cast("double"), F.col("total_customers").cast("double"))
        .alias("outage_fraction"),
        F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lon"),
        F.lit("eagle_i").alias("source"),
    )
    return q.constraint_failures(rows, "outage_observations", "event_id")


@query("v8_weather_constraints", rounded(
    ["weather"],
    """SELECT event_id, 'source' AS column_name, 'isin' AS check_name FROM weather
        WHERE event_id % 10 = 0
        UNION ALL SELECT event_id, 'event_type', 'length' FROM weather WHERE event_id % 15 = 0
        UNION ALL SELECT event_id, 'magnitude', 'ge(0)' FROM weather WHERE magnitude - 5 < 0""",
    [],
))
def v8_weather_constraints(s: Source) -> DataFrame:
    rows = s.weather.select(
        "event_id", "event_time", (F.col("magnitude") - 5).alias("magnitude"),
        F.when(F.col("event_id") % 15 == 0, "").otherwise(F.col("event_type")).alias("event_type"),
        F.when(F.col("event_id") % 10 == 0, "radio").otherwise("nws").alias("source"),
        "state_fips", "damage_property",
    )
    missing = {
        name: F.lit(None).cast(spec.kind)
        for name, spec in q.TABLE_SCHEMAS["weather_events"].items() if name not in rows.columns
    }
    return q.constraint_failures(rows.withColumns(missing), "weather_events", "event_id")


@query("v8_grid_constraints", rounded(["raw_grid"], """
    SELECT event_id, column_name, check_name FROM (
      SELECT event_id, 'frequency_hz' AS column_name, 'ge(59.0)' AS check_name FROM raw_grid WHERE event_id % 50 = 0
        AND frequency_hz - 1 < 59.0
      UNION ALL SELECT event_id, 'load_mw', 'gt(0)' FROM raw_grid WHERE load_mw - 30000 <= 0
      UNION ALL SELECT event_id, 'source', 'isin' FROM raw_grid WHERE event_id % 10 = 0
      UNION ALL SELECT event_id, 'grid_stress_flag', 'coerce' FROM raw_grid WHERE event_id % 11 = 0
      UNION ALL SELECT event_id, 'grid_stress_flag', 'isin' FROM raw_grid WHERE event_id % 11 <> 0 AND event_id % 3 = 2
      UNION ALL SELECT event_id, 'region_code', 'column_present' FROM raw_grid
      UNION ALL SELECT event_id, 'reserve_margin_pct', 'ge(-50)' FROM raw_grid
        WHERE (capacity_mw - load_mw) / capacity_mw * 100 < -50)""", []))
def v8_grid_constraints(s: Source) -> DataFrame:
    """A feed without the region column, with flags that are no numbers."""
    flag = F.when(F.col("event_id") % 11 == 0, "x").otherwise((F.col("event_id") % 3).cast("string"))
    rows = s.raw_grid.select(
        "event_id", "recorded_at", (F.col("load_mw") - 30000).alias("load_mw"), "capacity_mw",
        F.when(F.col("event_id") % 50 == 0, F.col("frequency_hz") - 1).otherwise(F.col("frequency_hz")).alias("frequency_hz"),
        ((F.col("capacity_mw") - F.col("load_mw")) / F.col("capacity_mw") * 100).alias("reserve_margin_pct"),
        F.when(F.col("event_id") % 10 == 0, "other").otherwise("ercot").alias("source"), flag.alias("grid_stress_flag"),
    )
    return q.constraint_failures(rows, "grid_load", "event_id")


@query("v8_infrastructure_constraints", rounded(["raw_utilities"], """
    SELECT id, column_name, check_name FROM (
      SELECT id, 'county_fips' AS column_name, 'matches' AS check_name FROM raw_utilities
        WHERE NOT regexp_matches(county_fips, '^[0-9]{5}$')
      UNION ALL SELECT id, 'transmission_line_km', 'ge(0)' FROM raw_utilities
        WHERE CAST(transmission_line_miles AS DOUBLE) < 0
      UNION ALL SELECT id, 'data_year', 'coerce' FROM raw_utilities WHERE period = 'n/a'
      UNION ALL SELECT id, 'utility_name', 'length' FROM raw_utilities WHERE id % 6 = 0
      UNION ALL SELECT id, 'source', 'not_null' FROM raw_utilities WHERE id % 4 = 0)""", []))
def v8_infrastructure_constraints(s: Source) -> DataFrame:
    rows = s.raw_utilities.select(
        "id", "county_fips", F.lit("48").alias("state_fips"), "utility_id",
        F.when(F.col("id") % 6 == 0, F.repeat("utility_name", F.lit(60))).otherwise(F.col("utility_name")).alias("utility_name"),
        F.col("transmission_line_miles").alias("transmission_line_km"), "substations_count",
        F.col("generation").alias("generation_capacity_mw"), F.col("period").alias("data_year"),
        F.when(F.col("id") % 4 != 0, "eia").alias("source"),
        F.lit(None).cast("double").alias("total_customers"), F.lit(None).cast("double").alias("peak_demand_mw"),
    )
    return q.constraint_failures(rows, "infrastructure", "id")


@query("v8_socioeconomic_constraints", rounded(["raw_census"], """
    SELECT id, column_name, check_name FROM (
      SELECT id, 'county_fips' AS column_name, 'matches' AS check_name FROM raw_census
        WHERE NOT regexp_matches(county_fips, '^[0-9]{5}$')
      UNION ALL SELECT id, 'state_fips', 'matches' FROM raw_census WHERE county_fips = 'bad'
      UNION ALL SELECT id, 'total_population', 'gt(0)' FROM raw_census WHERE CAST(total_population AS BIGINT) <= 0
      UNION ALL SELECT id, 'median_household_income', 'le(500000)' FROM raw_census
        WHERE CAST(median_household_income AS BIGINT) * 12 > 500000
      UNION ALL SELECT id, 'median_year_structure_built', 'le(2025)' FROM raw_census
        WHERE CAST(median_year_structure_built AS BIGINT) > 2025
      UNION ALL SELECT id, 'poverty_rate', 'le(1)' FROM raw_census WHERE id % 700 > 500
      UNION ALL SELECT id, 'data_year', 'ge(2000)' FROM raw_census WHERE id % 40 < 10)""", []))
def v8_socioeconomic_constraints(s: Source) -> DataFrame:
    rows = s.raw_census.select(
        "id", "county_fips", F.left("county_fips", F.lit(2)).alias("state_fips"), F.col("NAME").alias("county_name"),
        "total_population", (F.col("median_household_income").cast("bigint") * 12).alias("median_household_income"),
        "median_year_structure_built", (F.col("id") % 700 / 500).alias("poverty_rate"),
        (F.col("id") % 40 + 1990).alias("data_year"), F.lit("census_acs5").alias("source"),
        *[F.lit(None).cast("double").alias(c) for c in (
            "population_density", "avg_housing_age_years", "vacancy_rate", "median_age")],
    )
    return q.constraint_failures(rows, "socioeconomic", "id")


@query("v9_report", rounded(["raw_outages"], f"""
    SELECT total_records, valid_records, invalid_records, drop_rate FROM ({_report_sql(
        'raw_outages', _OUTAGE_RULES)})""", ["drop_rate"]))
def v9_report(s: Source) -> DataFrame:
    rows = s.raw_outages.withColumnRenamed("timestamp_raw", "observed_at")
    return tidy(q.outage_rules(rows).report(rows).select(
        "total_records", "valid_records", "invalid_records", "drop_rate"
    ))


@query("v10_ingest_run", rounded(["raw_outages"], f"""
    SELECT 'outages' AS source, 'success' AS status, total_records AS fetched,
      valid_records AS valid, valid_records AS loaded, valid_records AS stored
    FROM ({_report_sql('raw_outages', _OUTAGE_RULES)})""", []))
def v10_ingest_run(s: Source) -> DataFrame:
    path = staging_path(s.spark, "outages")
    run = q.ingest(
        s.raw_outages,
        lambda df: df.withColumnRenamed("timestamp_raw", "observed_at"),
        q.outage_rules, norm.outages,
        lambda df: store.append(df, path, "observed_at"),
        "outages",
    )
    record = s.spark.createDataFrame(
        [(run["source"], run["status"], run["fetched"], run["valid"], run["loaded"])],
        "source string, status string, fetched long, valid long, loaded long",
    )
    stored = s.spark.read.parquet(path).agg(F.count("*").alias("stored"), F.lit("outages").alias("source"))
    return record.join(stored, "source")
