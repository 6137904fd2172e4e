"""Sources and sinks (S*). Files are first written by Spark from the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridgale.operators.merge import (
    UPSERT_RULES,
    infrastructure_rule,
    insert_ignore,
    last_per_key,
    upsert,
)
from gridgale.plans.base import Source, query, rounded, tidy, with_roles
from gridgale.session import staging_path
from gridgale.sources import readers, tables


def _csv(df: DataFrame, name: str) -> str:
    path = staging_path(df.sparkSession, name)
    df.write.option("header", True).csv(path)
    return path


def _text_time(column: str, fmt: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    return F.date_format(column, fmt)


@query("s1_storm_files", rounded(
    ["raw_storms"],
    """SELECT event_id, date_trunc('second', begin_date_time) AS begin_date_time,
        trim(event_type) AS event_type, lpad(state_fips, 2, '0') AS state_fips FROM raw_storms
        WHERE CAST(begin_date_time AS DATE) BETWEEN DATE '2024-01-03' AND DATE '2024-01-25'
          AND lpad(state_fips, 2, '0') = '48'""",
    [],
))
def s1_storm_files(s: Source) -> DataFrame:
    """Two file sets with different headers, column order and time format."""
    raw = s.raw_storms
    early = raw.filter(F.col("begin_date_time") < "2024-01-15").select(
        F.col("event_id").alias("Episode_Id"),
        F.upper(_text_time("begin_date_time", "dd-MMM-yy HH:mm:ss")).alias("Begin_Date_Time"),
        F.col("event_type").alias("Event_Type"), F.col("state_fips").alias("State_Fips"),
    )
    late = raw.filter(~(F.col("begin_date_time") < "2024-01-15") | F.col("begin_date_time").isNull()).select(
        F.col("state_fips").alias("STATE_FIPS"),
        F.coalesce(_text_time("begin_date_time"), F.lit("unknown")).alias("BEGIN_DATE_TIME"),
        F.col("event_type").alias("EVENT_TYPE"), F.col("magnitude").alias("MAGNITUDE"),
        F.col("event_id").alias("EPISODE_ID"),
    )
    paths = [_csv(early, "storms-early"), _csv(late, "storms-late")]
    out = readers.read_storms(s.spark, paths, "2024-01-03", "2024-01-25", "TX")
    return out.select(
        F.col("EPISODE_ID").cast("bigint").alias("event_id"),
        F.col("BEGIN_DATE_TIME").alias("begin_date_time"),
        F.trim("EVENT_TYPE").alias("event_type"), F.col("STATE_FIPS").alias("state_fips"),
    )


@query("s2_alert_files", rounded(
    ["raw_alerts"],
    """SELECT CAST(alert_id AS VARCHAR) AS alert_id, event_type, coalesce(severity, 'Unknown') AS severity,
        onset, area_desc, 'Z1,Z2' AS affected_zones,
        CASE WHEN lat IS NULL THEN NULL ELSE 'Point' END AS geometry_type FROM raw_alerts
        WHERE onset IS NULL OR CAST(onset AS DATE) BETWEEN DATE '2024-01-01' AND DATE '2024-01-20'""",
    [],
))
def s2_alert_files(s: Source) -> DataFrame:
    """An archive of GeoJSON collections, one per line."""
    iso = "yyyy-MM-dd'T'HH:mm:ssXXX"
    feature = F.struct(
        F.struct(
            F.col("alert_id").cast("string").alias("id"), F.col("event_type").alias("event"),
            "severity", "certainty", "urgency", "headline", F.col("area_desc").alias("areaDesc"),
            F.date_format("onset", iso).alias("onset"),
            F.date_format("effective", iso).alias("effective"),
            F.array(F.lit("Z1"), F.lit("Z2")).alias("affectedZones"),
        ).alias("properties"),
        F.when(F.col("lat").isNotNull(), F.struct(
            F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates"),
        )).alias("geometry"),
    )
    path = staging_path(s.spark, "alerts")
    s.raw_alerts.select(F.array(feature).alias("features")).write.json(path)
    out = readers.read_alerts_geojson(s.spark, path, "2024-01-01", "2024-01-20", per_line=True)
    return out.select(
        "alert_id", "event_type", "severity", "onset", "area_desc", "affected_zones", "geometry_type"
    )


@query("s3_station_files", rounded(
    ["raw_station"],
    """SELECT event_id, date_trunc('minute', valid) AS valid, station AS station_id, tmpf,
        CASE station WHEN 'KIAH' THEN 29.9844E0 WHEN 'KLAX' THEN 33.9425E0 WHEN 'KMIA' THEN 25.7959E0
          END AS station_lat FROM raw_station
        WHERE CAST(valid AS DATE) BETWEEN DATE '2024-01-02' AND DATE '2024-01-09'""",
    [],
))
def s3_station_files(s: Source) -> DataFrame:
    rows = s.raw_station.select(
        "event_id", F.col("station").alias(" Station"),
        _text_time("valid", "yyyy-MM-dd HH:mm").alias("valid(UTC)"), F.col("tmpf").alias("TMPF "),
    )
    path = _csv(rows, "stations")
    out = readers.read_station_obs(s.spark, path, "2024-01-02", "2024-01-09")
    return out.select(
        F.col("event_id").cast("bigint").alias("event_id"), "valid", "station_id", "tmpf",
        "station_lat",
    )


@query("s4_outage_files", rounded(
    ["raw_outages"],
    """SELECT event_id, date_trunc('second', timestamp_raw) AS observed_at,
        lpad(CAST(event_id % 60 AS VARCHAR), 2, '0') AS state_fips,
        CAST(customers_out AS DOUBLE) AS customers_out FROM raw_outages
        WHERE event_id % 60 = 6 AND CAST(timestamp_raw AS DATE) >= DATE '2024-01-04'""",
    [],
))
def s4_outage_files(s: Source) -> DataFrame:
    rows = s.raw_outages.select(
        F.col("event_id").alias("Event Id"), _text_time("timestamp_raw").alias("Date Time"),
        (F.col("event_id") % 60).alias("State FIPS"), F.col("county_fips").alias("County FIPS"),
        F.col("customers_out").alias("Customers Out"), F.col("total_customers").alias("Total Customers"),
    )
    path = _csv(rows, "outages")
    out = readers.read_outages(s.spark, path, "2024-01-04", None, "CA")
    return out.select(
        F.col("event_id").cast("bigint").alias("event_id"), "observed_at", "state_fips",
        "customers_out",
    )


@query("s5_grid_files", rounded(
    ["raw_grid"],
    """SELECT event_id, date_trunc('second', recorded_at) AS recorded_at, load_mw, capacity_mw
        FROM raw_grid WHERE CAST(recorded_at AS DATE) BETWEEN DATE '2024-01-04' AND DATE '2024-01-10'""",
    ["load_mw"],
))
def s5_grid_files(s: Source) -> DataFrame:
    rows = s.raw_grid.select(
        "event_id", _text_time("recorded_at", "yyyy-MM-dd'T'HH:mm:ss").alias("Interval Start"),
        F.col("load_mw").alias("Load MW"), F.col("capacity_mw").alias("Capacity MW"),
    )
    path = _csv(rows, "grid")
    out = readers.read_grid_load(s.spark, path, "2024-01-04", "2024-01-10")
    return tidy(out.select(
        F.col("event_id").cast("bigint").alias("event_id"), "recorded_at", "load_mw", "capacity_mw"
    ))


@query("s6_utility_files", """
    SELECT 'csv' AS origin, CAST(s_suppkey AS VARCHAR) AS id, s_name AS utility_name FROM supplier
      WHERE s_nationkey % 3 = 0
    UNION ALL SELECT 'page', CAST(s_suppkey AS VARCHAR), s_name FROM supplier""")
def s6_utility_files(s: Source) -> DataFrame:
    code = F.expr("CASE s_nationkey % 3 WHEN 0 THEN 'tx' WHEN 1 THEN 'CA' ELSE 'FL' END")
    rows = s.supplier.select(
        F.col("s_suppkey").alias("Utility ID"), F.col("s_name").alias("Utility Name"),
        code.alias("State Code"),
    )
    from_csv = readers.read_utilities(s.spark, _csv(rows, "utilities"), "TX")
    path = staging_path(s.spark, "utility-pages")
    row = F.struct(
        F.col("s_suppkey").cast("string").alias("plantid"), F.col("s_name").alias("plantName")
    )
    page = F.struct(F.array(row).alias("data"))
    s.supplier.select(page.alias("response")).write.json(path)
    from_page = readers.read_utility_pages(s.spark, path, ["plantid", "plantName"], per_line=True)
    return from_csv.select(
        F.lit("csv").alias("origin"), F.col("utility_id").alias("id"), "utility_name"
    ).union(from_page.select(F.lit("page"), "plantid", "plantName"))


@query("s7_census_files", """
    SELECT c_name AS "NAME", CAST(c_custkey AS VARCHAR) AS total_population,
      lpad(CAST(c_nationkey AS VARCHAR), 2, '0') AS state_fips,
      lpad(CAST(c_nationkey AS VARCHAR), 2, '0') || lpad(CAST(c_custkey % 1000 AS VARCHAR), 3, '0')
        AS county_fips FROM customer""")
def s7_census_files(s: Source) -> DataFrame:
    """An archive of array-of-arrays documents, each starting with its header row."""
    header = F.array(F.lit("NAME"), F.lit("B01003_001E"), F.lit("state"), F.lit("county"))
    row = F.array(
        "c_name", F.col("c_custkey").cast("string"), F.col("c_nationkey").cast("string"),
        (F.col("c_custkey") % 1000).cast("string"),
    )
    path = staging_path(s.spark, "census")
    s.customer.select(F.to_json(F.array(header, row))).write.text(path)
    return readers.read_census(s.spark, path, per_line=True).select(
        "NAME", "total_population", "state_fips", "county_fips"
    )


@query("s8_round_trip", rounded(
    ["weather"], "SELECT event_id, event_time, event_type, magnitude, 'parquet' AS kind FROM weather"
    " UNION ALL SELECT event_id, event_time, event_type, magnitude, 'json' FROM weather"
    " UNION ALL SELECT event_id, event_time, event_type, magnitude, 'csv' FROM weather", [],
))
def s8_round_trip(s: Source) -> DataFrame:
    rows = s.weather.select("event_id", "event_time", "event_type", "magnitude")
    out = None
    for kind in ("parquet", "json", "csv"):
        path = staging_path(s.spark, f"weather-{kind}")
        fmt = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"} if kind != "parquet" else {}
        rows.write.format(kind).options(**fmt).save(path)
        back = s.spark.read.format(kind).schema(rows.schema).options(**fmt).load(path)
        back = back.withColumn("kind", F.lit(kind))
        out = back if out is None else out.unionByName(back)
    return out


@query("s9_append", rounded(["weather"], "SELECT event_id, event_time, magnitude FROM weather", []))
def s9_append(s: Source) -> DataFrame:
    path = staging_path(s.spark, "weather-table")
    rows = s.weather.select("event_id", "event_time", "magnitude")
    early = F.col("event_time") < "2024-01-16"
    for part in (rows.filter(early), rows.filter(~early)):
        tables.append(part, path, "event_time")
    return s.spark.read.parquet(path).drop("month")


_S10_SQL = """
    SELECT id, cell, risk_probability FROM (SELECT id % 3000 AS id, cell, risk_probability,
      row_number() OVER (PARTITION BY id % 3000 ORDER BY id) AS rn FROM predictions)
    WHERE rn = 1 AND id % 2 = 1"""


@query("s10_insert_ignore", rounded(["predictions"], _S10_SQL, ["risk_probability"]))
def s10_insert_ignore(s: Source) -> DataFrame:
    rows = s.predictions.select(
        (F.col("id") % 3000).alias("id"), F.col("id").alias("seq"), "cell", "risk_probability"
    )
    target = s.predictions.select(((F.col("id") % 1500) * 2).alias("id")).distinct()
    return tidy(insert_ignore(target, rows, ["id"], [F.col("seq")]).drop("seq"))


@query("s10_insert_ignore_table", rounded(
    ["predictions"], "SELECT id, cell FROM predictions WHERE id % 2 = 0 OR id % 3 = 0", [],
))
def s10_insert_ignore_table(s: Source) -> DataFrame:
    path = staging_path(s.spark, "predictions")
    rows = s.predictions.select("id", "cell", "predicted_at")
    for part in (rows.filter("id % 2 = 0"), rows.filter("id % 3 = 0")):
        tables.append_new(part, path, "predicted_at", ["id"], [F.col("id")])
    return s.spark.read.parquet(path).select("id", "cell")


_S11_ROLE = """
    b AS (SELECT event_id, 'c' || CAST(event_id % 400 AS VARCHAR) AS county_fips,
      date_trunc('day', timestamp_raw) AS observed_at, customers_out,
      CAST(total_customers AS BIGINT) AS total_customers, customers_out / 1000.0E0 AS outage_fraction
      FROM raw_outages),
    t AS (SELECT county_fips, observed_at, max_by(customers_out, event_id) AS customers_out,
        max_by(total_customers, event_id) AS total_customers,
        max_by(outage_fraction, event_id) AS outage_fraction FROM b WHERE event_id % 3 <> 0
      GROUP BY 1, 2),
    u AS (SELECT county_fips, observed_at, max_by(customers_out, event_id) AS customers_out,
        max_by(total_customers, event_id) AS total_customers,
        max_by(outage_fraction, event_id) AS outage_fraction FROM b WHERE event_id % 3 = 0
      GROUP BY 1, 2)"""
_S11_BODY = """SELECT coalesce(t.county_fips, u.county_fips) AS county_fips,
    coalesce(t.observed_at, u.observed_at) AS observed_at,
    CASE WHEN u.county_fips IS NOT NULL THEN u.customers_out ELSE t.customers_out END AS customers_out,
    CASE WHEN u.county_fips IS NOT NULL THEN u.total_customers ELSE t.total_customers END
      AS total_customers,
    CASE WHEN u.county_fips IS NOT NULL THEN u.outage_fraction ELSE t.outage_fraction END
      AS outage_fraction,
    CASE WHEN t.county_fips IS NOT NULL THEN 'first' ELSE 'second' END AS source
    FROM t FULL JOIN u ON t.county_fips = u.county_fips AND t.observed_at = u.observed_at"""


def _s11_sql() -> str:
    return (
        with_roles("raw_outages") + "," + _S11_ROLE + f", result AS ({_S11_BODY}) "
        "SELECT * REPLACE (round(outage_fraction + 1e-9, 6) AS outage_fraction) FROM result"
    )


def _s11_inputs(s: Source) -> tuple[DataFrame, DataFrame]:
    """A stored table, and updates that hit some of its keys, add others, and repeat a few."""
    rows = s.raw_outages.select(
        "event_id", F.concat(F.lit("c"), (F.col("event_id") % 400).cast("string")).alias("county_fips"),
        F.date_trunc("day", "timestamp_raw").alias("observed_at"), "customers_out",
        F.col("total_customers").cast("bigint").alias("total_customers"),
        (F.col("customers_out") / 1000.0).alias("outage_fraction"),
        F.when(F.col("event_id") % 3 == 0, "second").otherwise("first").alias("source"),
    )
    stored = rows.filter("source = 'first'")
    stored = last_per_key(stored, ["county_fips", "observed_at"], [F.col("event_id")])
    return stored, rows.filter("source = 'second'")


@query("s11_upsert", _s11_sql())
def s11_upsert(s: Source) -> DataFrame:
    stored, updates = _s11_inputs(s)
    keys, changing = UPSERT_RULES["outage_observations"]
    return tidy(upsert(stored, updates, keys, changing, [F.col("event_id")]).drop("event_id"))


@query("s11_upsert_table", _s11_sql())
def s11_upsert_table(s: Source) -> DataFrame:
    stored, updates = _s11_inputs(s)
    keys, changing = UPSERT_RULES["outage_observations"]
    path = staging_path(s.spark, "outage-table")
    for part in (stored, updates):
        tables.upsert_into(part, path, "observed_at", keys, changing, [F.col("event_id")])
    return tidy(s.spark.read.parquet(path).drop("event_id", "month"))


@query("s11_upsert_utilities", """
    SELECT CAST(s_suppkey AS VARCHAR) AS utility_id, 2021 AS data_year, s_name AS utility_name,
      CASE WHEN s_suppkey % 3 = 0 THEN s_acctbal * 2 ELSE s_acctbal END AS peak_demand_mw,
      CASE WHEN s_suppkey % 2 = 0 THEN 'first' ELSE 'second' END AS source
    FROM supplier WHERE s_suppkey % 2 = 0 OR s_suppkey % 3 = 0""")
def s11_upsert_utilities(s: Source) -> DataFrame:
    """Keyed by utility and year; everything but the source may change."""
    def version(peak: Column, source: str) -> DataFrame:
        return s.supplier.select(
            F.col("s_suppkey").cast("string").alias("utility_id"), F.lit(2021).alias("data_year"),
            F.col("s_name").alias("utility_name"), peak.alias("peak_demand_mw"),
            F.lit(source).alias("source"), "s_suppkey",
        )

    stored = version(F.col("s_acctbal"), "first").filter("s_suppkey % 2 = 0").drop("s_suppkey")
    updates = version(F.col("s_acctbal") * 2, "second").filter("s_suppkey % 3 = 0")
    keys, changing = infrastructure_rule(stored)
    return upsert(stored, updates, keys, changing, [F.col("s_suppkey")])


@query("s12_month_partitions", rounded(
    ["scores"],
    """SELECT strftime(ts, '%Y-%m') AS month, count(*) AS n, sum(y) AS positives FROM scores
        WHERE ts >= TIMESTAMP '1996-03-01' AND ts < TIMESTAMP '1996-09-11' GROUP BY 1""",
    [],
))
def s12_month_partitions(s: Source) -> DataFrame:
    path = staging_path(s.spark, "scores")
    rows = s.scores.select("ts", "y", "p_a")
    tables.append(rows, path, "ts", files_per_month=8)
    back = tables.read_range(s.spark, path, "ts", "1996-03-01", "1996-09-10")
    return back.groupBy(F.date_format("ts", "yyyy-MM").alias("month")).agg(
        F.count("*").alias("n"), F.sum("y").alias("positives")
    )
