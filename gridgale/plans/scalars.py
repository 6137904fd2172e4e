"""Normalisers and scalar functions (P*)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridgale.constants import (
    ALERT_MAGNITUDE,
    BASE_OUTAGE_RISK,
    CELL_AREA_KM2,
    COUNTY_AREA_SQ_MI,
    COUNTY_CENTROID,
    SEVERE_TYPES,
    STATIONS,
)
from gridgale.functions import hexgrid
from gridgale.functions.clock import in_dates
from gridgale.functions.weather import category, dollars, outage_probability, outage_severity
from gridgale.operators import normalize as norm
from gridgale.plans.base import Source, query, rounded, tidy
from gridgale.plans.features import CATEGORY_SQL


def _lit(x: float) -> str:
    return f"{x!r}E0" if "e" not in repr(x) else repr(x)


def _case(column: str, table: dict, index: int | None = None, default: str = "NULL") -> str:
    def show(v):
        v = v if index is None else v[index]
        return _lit(float(v)) if isinstance(v, (int, float)) else f"'{v}'"

    whens = " ".join(
        f"WHEN {column} = {k if isinstance(k, int) else repr(k)} THEN {show(v)}" for k, v in table.items()
    )
    return f"CASE {whens} ELSE {default} END"


def _cells_sql(lat: str, lon: str, res: int) -> tuple[str, str]:
    """q and r of a point, by the textbook cube rounding."""
    edge = hexgrid.edge_km(res) / hexgrid.KM_PER_DEGREE
    x, y = f"({lon} / {_lit(edge)})", f"({lat} / {_lit(edge)})"
    fq = f"({x} * {_lit(math.sqrt(3) / 3)} - {y} / 3.0E0)"
    fr = f"({y} * {_lit(2 / 3)})"
    fs = f"(-{fq} - {fr})"
    r = {n: f"floor({v} + 0.5E0)" for n, v in (("q", fq), ("r", fr), ("s", fs))}
    d = {n: f"abs({r[n]} - {v})" for n, v in (("q", fq), ("r", fr), ("s", fs))}
    q_moved = f"({d['q']} > {d['r']} AND {d['q']} > {d['s']})"
    q = f"CAST(CASE WHEN {q_moved} THEN -{r['r']} - {r['s']} ELSE {r['q']} END AS BIGINT)"
    rr = (
        f"CAST(CASE WHEN {q_moved} THEN {r['r']} WHEN {d['r']} > {d['s']} "
        f"THEN -{r['q']} - {r['s']} ELSE {r['r']} END AS BIGINT)"
    )
    return q, rr


def _damage_sql(c: str) -> str:
    s = f"upper(trim({c}))"
    return f"""coalesce(CASE WHEN {c} IS NULL OR {s} IN ('', '0', 'NAN') THEN 0.0E0
      WHEN regexp_matches({s}, '^[0-9.]+[KMB]?$') THEN
        TRY_CAST(regexp_extract({s}, '^([0-9.]+)([KMB])?$', 1) AS DOUBLE)
        * CASE regexp_extract({s}, '^([0-9.]+)([KMB])?$', 2) WHEN 'K' THEN 1e3 WHEN 'M' THEN 1e6
          WHEN 'B' THEN 1e9 ELSE 1.0E0 END
      ELSE TRY_CAST({s} AS DOUBLE) END, 0.0E0)"""


@query("p1_damage_dollars", rounded(
    ["damage_strings"], f"SELECT id, damage, {_damage_sql('damage')} AS dollars FROM damage_strings",
    ["dollars"],
))
def p1_damage_dollars(s: Source) -> DataFrame:
    return tidy(s.damage_strings.select("id", "damage", dollars(F.col("damage")).alias("dollars")))


_Q7, _R7 = _cells_sql("begin_lat", "begin_lon", 7)
_Q9, _R9 = _cells_sql("begin_lat", "begin_lon", 9)


@query("p2_storms", rounded(
    ["raw_storms"],
    f"""SELECT event_id, begin_date_time AS event_time, 'noaa_storms' AS source,
        trim(event_type) AS event_type, coalesce(TRY_CAST(magnitude AS DOUBLE), 0.0) AS magnitude,
        begin_lat AS lat, begin_lon AS lon, lpad(state_fips, 2, '0') AS state_fips,
        lpad(cz_fips, 3, '0') AS county_fips, {_damage_sql('damage_property')} AS damage_property,
        {_damage_sql('damage_crops')} AS damage_crops,
        CAST(injuries_direct AS BIGINT) + CAST(injuries_indirect AS BIGINT) AS injuries,
        CAST(deaths_direct AS BIGINT) AS deaths,
        '7:' || {_Q7} || ':' || {_R7} AS cell_res7, '9:' || {_Q9} || ':' || {_R9} AS cell_res9
        FROM raw_storms""",
    ["magnitude", "damage_property", "lat", "lon"],
))
def p2_storms(s: Source) -> DataFrame:
    raw = s.raw_storms.withColumn("EPISODE_ID", F.col("event_id"))
    out = norm.storms(raw.toDF(*[c.upper() for c in raw.columns]))
    return tidy(out.select(
        F.col("episode_id").alias("event_id"), "event_time", "source", "event_type", "magnitude",
        "lat", "lon", "state_fips", "county_fips", "damage_property", "damage_crops", "injuries",
        "deaths", "cell_res7", "cell_res9",
    ))


@query("p3_alerts", rounded(
    ["raw_alerts"],
    f"""SELECT alert_id, coalesce(onset, effective) AS event_time, event_type,
        {_case('severity', ALERT_MAGNITUDE, default='10.0E0')} AS magnitude,
        'nws_severity' AS magnitude_type, left(description, 2000) AS narrative, area_desc, expires
        FROM raw_alerts""",
    [],
))
def p3_alerts(s: Source) -> DataFrame:
    return norm.alerts(s.raw_alerts).select(
        "alert_id", "event_time", "event_type", "magnitude", "magnitude_type", "narrative",
        "area_desc", "expires",
    )


_GEOMETRY = """
    SELECT event_id, user_id % 90 AS a, event_id % 60 AS b, CASE event_id % 4
      WHEN 0 THEN concat('{{"type":"Point","coordinates":[', CAST(user_id % 90 AS STRING), ',',
        CAST(event_id % 60 AS STRING), ']}}')
      WHEN 1 THEN concat('{{"type":"Polygon","coordinates":[[[', CAST(user_id % 90 AS STRING), ',',
        CAST(event_id % 60 AS STRING), '],[', CAST(user_id % 90 + 2 AS STRING), ',',
        CAST(event_id % 60 AS STRING), '],[', CAST(user_id % 90 AS STRING), ',',
        CAST(event_id % 60 + 4 AS STRING), '],[', CAST(user_id % 90 AS STRING), ',',
        CAST(event_id % 60 AS STRING), ']]]}}')
      WHEN 2 THEN concat('{{"type":"MultiPolygon","coordinates":[[[[', CAST(user_id % 90 AS STRING),
        ',', CAST(event_id % 60 AS STRING), '],[0,0]]],[[[', CAST(event_id % 60 AS STRING),
        ',1],[2,3],[4,5]]]]}}')
      ELSE NULL END AS geometry FROM {events}"""


@query("p4_centroid", f"""
    WITH g AS ({_GEOMETRY.replace('{events}', 'events').replace('{{', '{').replace('}}', '}')}),
    result AS (SELECT event_id,
      CASE event_id % 4 WHEN 0 THEN b * 1.0E0 WHEN 1 THEN (4 * b + 4) / 4.0E0
        WHEN 2 THEN (b + 9) / 5.0E0 END AS lat,
      CASE event_id % 4 WHEN 0 THEN a * 1.0E0 WHEN 1 THEN (4 * a + 2) / 4.0E0
        WHEN 2 THEN (a + b + 6) / 5.0E0 END AS lon FROM g)
    SELECT * REPLACE (round(lat + 1e-9, 6) AS lat, round(lon + 1e-9, 6) AS lon) FROM result""")
def p4_centroid(s: Source) -> DataFrame:
    g = s.spark.sql(_GEOMETRY, events=s.events)
    lat, lon = norm.ring_centroid(F.col("geometry"))
    return tidy(g.select("event_id", lat.alias("lat"), lon.alias("lon")))


def _reading(c: str) -> str:
    return f"CASE WHEN {c} IN ('M', '') THEN NULL WHEN {c} = 'T' THEN 0.001E0 ELSE CAST({c} AS DOUBLE) END"


@query("p5_station_observations", rounded(
    ["raw_station"],
    f"""SELECT event_time, station_id, temperature_f,
        round((temperature_f - 32) * 5 / 9 + 1e-9, 2) AS temperature_c,
        round(wind_speed_kt * 1.15078E0 + 1e-9, 2) AS wind_speed_mph,
        round(gust_kt * 1.15078E0 + 1e-9, 2) AS gust_speed_mph, precip_in,
        coalesce(greatest(round(wind_speed_kt * 1.15078E0 + 1e-9, 2),
          round(gust_kt * 1.15078E0 + 1e-9, 2)), 0.0E0) AS magnitude,
        {_case('station_id', STATIONS, 0)} AS lat, {_case('station_id', STATIONS, 1)} AS lon
        FROM (SELECT valid AS event_time, station AS station_id, {_reading('tmpf')} AS temperature_f,
          {_reading('sknt')} AS wind_speed_kt, {_reading('gust')} AS gust_kt,
          {_reading('p01i')} AS precip_in FROM raw_station)""",
    ["temperature_f", "precip_in"],
))
def p5_station_observations(s: Source) -> DataFrame:
    out = norm.station_observations(norm.clean_station_rows(s.raw_station))
    return tidy(out.select(
        "event_time", "station_id", "temperature_f", "temperature_c", "wind_speed_mph",
        "gust_speed_mph", "precip_in", "magnitude", "lat", "lon",
    ))


_LATS = {k: v[0] for k, v in COUNTY_CENTROID.items()}


@query("p6_outages", rounded(
    ["raw_outages"],
    f"""SELECT event_id, timestamp_raw AS observed_at, lpad(county_fips, 5, '0') AS county_fips,
        left(lpad(county_fips, 5, '0'), 2) AS state_fips,
        least(customers_out, total_customers) AS customers_out,
        CAST(total_customers AS BIGINT) AS total_customers,
        least(customers_out, total_customers) / total_customers AS outage_fraction,
        {_case("lpad(county_fips, 5, '0')", _LATS)} AS lat FROM raw_outages
        WHERE regexp_matches(lpad(county_fips, 5, '0'), '^[0-9]{{5}}$') AND customers_out >= 0
          AND total_customers > 0""",
    ["outage_fraction"],
))
def p6_outages(s: Source) -> DataFrame:
    from gridgale.operators.quality import outage_rules

    raw = s.raw_outages.withColumnRenamed("timestamp_raw", "observed_at")
    out = norm.outages(outage_rules(raw).valid(raw))
    return tidy(out.select(
        "event_id", "observed_at", "county_fips", "state_fips", "customers_out", "total_customers",
        "outage_fraction", "lat",
    ))


@query("p7_grid_load", rounded(
    ["raw_grid"],
    """SELECT event_id, recorded_at, load_mw, frequency_hz, capacity_mw,
        round((capacity_mw - load_mw) / capacity_mw * 100, 4) AS reserve_margin_pct,
        'ERCOT_SYSTEM' AS region_code, CASE WHEN capacity_mw IS NOT NULL AND
          round((capacity_mw - load_mw) / capacity_mw * 100, 4) < 6 THEN 1 ELSE 0 END
          AS grid_stress_flag FROM raw_grid""",
    ["load_mw", "frequency_hz", "reserve_margin_pct"], 3,
))
def p7_grid_load(s: Source) -> DataFrame:
    return tidy(norm.grid_load(s.raw_grid).drop("source"), 3)


@query("p8_utilities", rounded(
    ["raw_utilities"],
    """SELECT lpad(county_fips, 5, '0') AS county_fips, utility_id, utility_name,
        TRY_CAST(transmission_line_miles AS DOUBLE) * 1.60934E0 AS transmission_line_km,
        TRY_CAST(substations_count AS DOUBLE) AS substations_count,
        TRY_CAST(generation AS DOUBLE) AS generation_capacity_mw,
        TRY_CAST(period AS DOUBLE) AS data_year FROM raw_utilities""",
    ["transmission_line_km"],
))
def p8_utilities(s: Source) -> DataFrame:
    return tidy(norm.utilities(s.raw_utilities).select(
        "county_fips", "utility_id", "utility_name", "transmission_line_km", "substations_count",
        "generation_capacity_mw", "data_year",
    ))


@query("p9_demographics", rounded(
    ["raw_census"],
    f"""SELECT county_fips, NAME AS county_name, left(county_fips, 2) AS state_fips,
        CAST(total_population AS BIGINT) AS total_population,
        CAST(total_population AS DOUBLE) / {_case('county_fips', COUNTY_AREA_SQ_MI)}
          AS population_density,
        CASE WHEN CAST(total_population AS DOUBLE) <> 0 THEN
          round(CAST(population_below_poverty AS DOUBLE) / CAST(total_population AS DOUBLE), 6) END
          AS poverty_rate,
        greatest(0.0E0, 2020 - CAST(median_year_structure_built AS DOUBLE)) AS avg_housing_age_years,
        CASE WHEN CAST(total_housing_units AS DOUBLE) <> 0 THEN
          round(CAST(vacant_housing_units AS DOUBLE) / CAST(total_housing_units AS DOUBLE), 6) END
          AS vacancy_rate, 2020 AS data_year FROM raw_census""",
    ["population_density", "poverty_rate", "vacancy_rate"], 4,
))
def p9_demographics(s: Source) -> DataFrame:
    return tidy(norm.demographics(s.raw_census).select(
        "county_fips", "county_name", "state_fips", "total_population", "population_density",
        "poverty_rate", "avg_housing_age_years", "vacancy_rate", "data_year",
    ), 4)


@query("p10_geo_valid", rounded(
    ["geo"],
    """SELECT * FROM geo WHERE lat IS NOT NULL AND lon IS NOT NULL AND lat BETWEEN -90 AND 90
        AND lon BETWEEN -180 AND 180 AND NOT (lat = 0 AND lon = 0)""",
    ["lat", "lon"],
))
def p10_geo_valid(s: Source) -> DataFrame:
    return tidy(s.geo.filter(norm.geo_valid(F.col("lat"), F.col("lon"))))


@query("p11_date_region_filter", rounded(
    ["raw_storms"],
    """SELECT event_id, begin_date_time FROM raw_storms WHERE lpad(state_fips, 2, '0') = '06'
        AND CAST(begin_date_time AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'""",
    [],
))
def p11_date_region_filter(s: Source) -> DataFrame:
    keep = norm.in_state(F.col("state_fips"), "CA") & in_dates(
        F.col("begin_date_time"), "2024-01-05", "2024-01-20"
    )
    return s.raw_storms.filter(keep).select("event_id", "begin_date_time")


_GQ, _GR = _cells_sql("lat", "lon", 7)


@query("p12_locate", rounded(
    ["geo"],
    f"""SELECT event_id, CAST(q AS DOUBLE) AS q, CAST(r AS DOUBLE) AS r,
        '7:' || q || ':' || r AS cell FROM (SELECT event_id, {_GQ} AS q, {_GR} AS r FROM geo)""",
    [],
))
def p12_locate(s: Source) -> DataFrame:
    q, r = hexgrid.locate(F.col("lat"), F.col("lon"), 7)
    return s.geo.select(
        "event_id", q.cast("double").alias("q"), r.cast("double").alias("r"),
        hexgrid.cell_id(q, r).alias("cell"),
    )


@query("p13_disk", rounded(
    ["weather"],
    """SELECT c.cell, k.k, c.q + a.d AS nq, c.r + b.d AS nr
        FROM (SELECT DISTINCT cell, q, r FROM weather) c, (VALUES (1), (2)) k(k),
          (SELECT unnest(range(-2, 3)) AS d) a, (SELECT unnest(range(-2, 3)) AS d) b
        WHERE abs(a.d) <= k.k AND abs(b.d) <= k.k AND abs(a.d + b.d) <= k.k""",
    [],
))
def p13_disk(s: Source) -> DataFrame:
    cells = s.weather.select("cell", "q", "r").distinct()
    rings = [hexgrid.with_disk(cells, k).withColumn("k", F.lit(k)) for k in (1, 2)]
    return rings[0].unionByName(rings[1]).select("cell", "k", "nq", "nr")


_EDGE7 = hexgrid.edge_km(7) / hexgrid.KM_PER_DEGREE


@query("p14_centroid_and_area", rounded(
    ["weather"],
    f"""SELECT cell, r * {_lit(1.5 * _EDGE7)} AS lat,
        (q + r / 2.0E0) * {_lit(math.sqrt(3.0) * _EDGE7)} AS lon, 5.161E0 AS area_km2,
        {_case('CAST(cell % 15 AS INT)', CELL_AREA_KM2, default='5.161E0')} AS area_at_res
        FROM (SELECT DISTINCT cell, q, r FROM weather)""",
    ["lat", "lon"],
))
def p14_centroid_and_area(s: Source) -> DataFrame:
    lat, lon = hexgrid.centroid(F.col("q"), F.col("r"), 7)
    return tidy(s.weather.select("cell", "q", "r").distinct().select(
        "cell", lat.alias("lat"), lon.alias("lon"), F.lit(hexgrid.area_km2(7)).alias("area_km2"),
        hexgrid.area_column((F.col("cell") % 15).cast("int")).alias("area_at_res"),
    ))


@query("p15_category", rounded(
    ["weather"], f"SELECT event_id, event_type, {CATEGORY_SQL} AS category FROM weather", [],
))
def p15_category(s: Source) -> DataFrame:
    return s.weather.select("event_id", "event_type", category(F.col("event_type")).alias("category"))


@query("p16_cyclical", rounded(
    ["weather"],
    """SELECT event_id, sin(2 * pi() * (hour(event_time) + minute(event_time) / 60.0) / 24) AS hour_sin,
        cos(2 * pi() * (hour(event_time) + minute(event_time) / 60.0) / 24) AS hour_cos,
        sin(2 * pi() * (isodow(event_time) - 1) / 7) AS dow_sin,
        cos(2 * pi() * (isodow(event_time) - 1) / 7) AS dow_cos,
        sin(2 * pi() * (month(event_time) - 1) / 12) AS month_sin,
        cos(2 * pi() * (month(event_time) - 1) / 12) AS month_cos,
        CASE WHEN isodow(event_time) >= 6 THEN 1.0E0 ELSE 0.0E0 END AS is_weekend FROM weather""",
    ["hour_sin", "hour_cos", "dow_sin", "dow_cos", "month_sin", "month_cos"],
))
def p16_cyclical(s: Source) -> DataFrame:
    from gridgale.functions.clock import cyclical

    cols = cyclical(F.col("event_time"))
    return tidy(s.weather.select("event_id", *[c.alias(n) for n, c in cols.items()]))


@query("p17_early_labelled_set", rounded(
    ["raw_storms"],
    f"""SELECT begin_date_time AS "TIMESTAMP", TRY_CAST(magnitude AS DOUBLE) AS "MAGNITUDE",
        TRY_CAST(replace(replace(replace(damage_property, 'K', 'e3'), 'M', 'e6'), 'B', 'e9')
          AS DOUBLE) AS "DAMAGE_PROPERTY",
        CASE WHEN event_type IN ({', '.join(repr(t) for t in SEVERE_TYPES)}) THEN 1 ELSE 0 END
          AS "OUTAGE_RISK" FROM raw_storms
        WHERE begin_date_time IS NOT NULL AND TRY_CAST(magnitude AS DOUBLE) IS NOT NULL
          AND damage_property IS NOT NULL""",
    ['"MAGNITUDE"', '"DAMAGE_PROPERTY"'],
))
def p17_early_labelled_set(s: Source) -> DataFrame:
    raw = s.raw_storms
    return tidy(norm.early_labelled_set(raw.toDF(*[c.upper() for c in raw.columns])))


@query("p19_expected_outage", rounded(
    ["weather"],
    f"""SELECT event_id, h AS hour, least(0.95, greatest(0.0, 0.5 * base + 0.25 * mf
          + 0.25 * least(1.0, ln(1 + damage_property) / 15))) AS probability,
        least(0.95, greatest(0.005, base * mf * (1 - 0.15 * h))) AS severity
        FROM (SELECT event_id, damage_property,
          {_case('event_type', BASE_OUTAGE_RISK, default='0.15E0')} AS base,
          CASE WHEN magnitude > 0 THEN least(1.0, magnitude / 100.0) ELSE 0.3 END AS mf
          FROM weather), (SELECT unnest(range(0, 6)) AS h)""",
    ["probability", "severity"],
))
def p19_expected_outage(s: Source) -> DataFrame:
    hours = F.explode(F.sequence(F.lit(0), F.lit(5))).alias("hour")
    out = s.weather.select("*", hours)
    return tidy(out.select(
        "event_id", "hour",
        outage_probability(F.col("event_type"), F.col("magnitude"), F.col("damage_property"))
        .alias("probability"),
        outage_severity(F.col("event_type"), F.col("magnitude"), F.col("hour")).alias("severity"),
    ))
