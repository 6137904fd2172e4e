"""Readers for the raw feeds, as files of the shape each provider publishes.

CSV columns are read as text (no inference pass over the data) and typed by the normalisers.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridgale.constants import STATE_FIPS, STATIONS, SURVEY_CODES
from gridgale.functions.clock import in_dates, parse_mixed
from gridgale.operators.normalize import in_state, lookup, pad, ring_centroid

OUTAGE_TIMES = ["timestamp", "datetime", "date_time", "recorded_at", "time"]
GRID_TIMES = ["timestamp", "datetime", "interval_start", "time"]
STATION_TIMES = ["valid", "valid(utc)", "timestamp", "datetime"]


def files_by_header(spark: SparkSession, paths: list[str]) -> dict[str, list[str]]:
    """Data files under the paths (files, folders or globs), by their first line. Only that line
    of each file is read; a feed has a file per day or year, so the list is short."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    codecs = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf)
    out: dict[str, list[str]] = {}
    for entry in paths:
        at = jvm.org.apache.hadoop.fs.Path(entry)
        fs = at.getFileSystem(conf)
        waiting = list(fs.globStatus(at) or [])
        if not waiting:
            raise FileNotFoundError(entry)
        while waiting:
            status = waiting.pop()
            path = status.getPath()
            if path.getName()[0] in "._":
                continue
            if status.isDirectory():
                waiting += list(fs.listStatus(path))
                continue
            codec, raw = codecs.getCodec(path), fs.open(path)
            lines = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(
                codec.createInputStream(raw) if codec else raw, "UTF-8"
            ))
            try:
                header = lines.readLine()
            finally:
                lines.close()
            if header:
                out.setdefault(header.lstrip("\ufeff").rstrip("\r"), []).append(path.toString())
    return out


def read_csvs(spark: SparkSession, paths: list[str] | str, rename, free_text: bool = False) -> DataFrame:
    """Union by column name of CSV files, whatever their columns and order: one scan per distinct
    header. ``free_text`` feeds may break lines inside quotes; their files are read whole by one
    task each."""
    entries = [paths] if isinstance(paths, str) else list(paths)
    frames = []
    for _, files in sorted(files_by_header(spark, entries).items()):
        df = spark.read.option("header", True).option("multiLine", free_text).option(
            "escape", '"'
        ).option("enforceSchema", False).csv(sorted(files))
        frames.append(df.toDF(*[rename(c) for c in df.columns]))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def snake(name: str) -> str:
    return name.strip().lower().replace(" ", "_")


def _timed(df: DataFrame, candidates: list[str], to: str, start: str | None, end: str | None) -> DataFrame:
    """Parse the first time column the feed has, keep its dates, and give it its table name."""
    found = next((c for c in candidates if c in df.columns), None)
    if found is None:
        return df.withColumn(to, F.lit(None).cast("timestamp"))
    out = df.withColumn("_time", parse_mixed(F.col(f"`{found}`"))).drop(found)
    if start is not None or end is not None:
        out = out.filter(in_dates(F.col("_time"), start, end))
    return out.withColumnRenamed("_time", to)


def read_storms(
    spark: SparkSession, paths, start: str | None = None, end: str | None = None,
    region: str | None = None,
) -> DataFrame:
    df = read_csvs(spark, paths, lambda c: c.strip().upper(), free_text=True)
    df = _timed(df, ["BEGIN_DATE_TIME"], "BEGIN_DATE_TIME", start, end)
    if region and "STATE_FIPS" in df.columns:
        df = df.withColumn("STATE_FIPS", pad(F.col("STATE_FIPS"), 2)).filter(
            in_state(F.col("STATE_FIPS"), region)
        )
    return df


_ALERT_SCHEMA = """
    features array<struct<
      properties: struct<id: string, event: string, severity: string, certainty: string,
        urgency: string, headline: string, description: string, instruction: string,
        onset: string, expires: string, effective: string, senderName: string,
        areaDesc: string, affectedZones: array<string>>,
      geometry: string>>
"""


def read_alerts_geojson(
    spark: SparkSession, paths, start: str | None = None, end: str | None = None,
    per_line: bool = False,
) -> DataFrame:
    """One row per GeoJSON feature. Rows without an onset always pass the date range.

    A saved response is one document per file; ``per_line`` reads archives with one document per
    line, which split over tasks.
    """
    features = spark.read.schema(_ALERT_SCHEMA).option("multiLine", not per_line).json(paths)
    f = features.select(F.explode("features").alias("f")).select("f.properties.*", "f.geometry")
    lat, lon = ring_centroid(F.col("geometry"))

    def text(name: str, default: str = "") -> Column:
        return F.coalesce(F.col(name), F.lit(default))

    out = f.select(
        text("id").alias("alert_id"), text("event").alias("event_type"),
        text("severity", "Unknown").alias("severity"),
        text("certainty", "Unknown").alias("certainty"),
        text("urgency", "Unknown").alias("urgency"),
        text("headline").alias("headline"), text("description").alias("description"),
        text("instruction").alias("instruction"),
        F.try_to_timestamp("onset").alias("onset"),
        F.try_to_timestamp("expires").alias("expires"),
        F.try_to_timestamp("effective").alias("effective"),
        text("senderName").alias("sender_name"), text("areaDesc").alias("area_desc"),
        F.coalesce(F.array_join("affectedZones", ","), F.lit("")).alias("affected_zones"),
        lat.alias("lat"), lon.alias("lon"),
        F.get_json_object("geometry", "$.type").alias("geometry_type"),
    )
    if start is not None or end is not None:
        out = out.filter(in_dates(F.col("onset"), start, end) | F.col("onset").isNull())
    return out


def read_station_obs(
    spark: SparkSession, paths, start: str | None = None, end: str | None = None
) -> DataFrame:
    """Station files, with the coordinates of known stations looked up."""
    df = _timed(
        read_csvs(spark, paths, lambda c: c.strip().lower()), STATION_TIMES, "valid", start, end
    )
    station = F.col("station") if "station" in df.columns else F.col("station_id")
    return df.withColumns({
        "station_id": station,
        "station_lat": lookup({k: v[0] for k, v in STATIONS.items()}, station),
        "station_lon": lookup({k: v[1] for k, v in STATIONS.items()}, station),
    })


def read_outages(
    spark: SparkSession, paths, start: str | None = None, end: str | None = None,
    region: str | None = None,
) -> DataFrame:
    df = _timed(read_csvs(spark, paths, snake), OUTAGE_TIMES, "observed_at", start, end)
    if region and "state_fips" in df.columns:
        df = df.withColumn("state_fips", pad(F.col("state_fips"), 2)).filter(
            in_state(F.col("state_fips"), region)
        )
    for name in ("customers_out", "total_customers"):
        if name in df.columns:
            df = df.withColumn(name, F.col(name).try_cast("double"))
    return df


def read_grid_load(
    spark: SparkSession, paths, start: str | None = None, end: str | None = None
) -> DataFrame:
    df = _timed(read_csvs(spark, paths, snake), GRID_TIMES, "recorded_at", start, end)
    for name in ("load_mw", "capacity_mw", "frequency_hz"):
        if name in df.columns:
            df = df.withColumn(name, F.col(name).try_cast("double"))
    return df


def in_region(df: DataFrame, region: str | None) -> DataFrame:
    """Filter by the first state column the feed has."""
    if not region:
        return df
    if "state_fips" in df.columns:
        if region not in STATE_FIPS:
            return df
        return df.withColumn("state_fips", pad(F.col("state_fips"), 2)).filter(
            F.col("state_fips") == STATE_FIPS[region]
        )
    for name in ("state", "state_code"):
        if name in df.columns:
            return df.filter(F.upper(name) == region)
    return df


def read_utilities(spark: SparkSession, paths, region: str | None = None) -> DataFrame:
    return in_region(read_csvs(spark, paths, snake), region)


def read_utility_pages(
    spark: SparkSession, paths, fields: list[str], per_line: bool = False
) -> DataFrame:
    """Saved API pages: rows under ``response.data``, every field as text."""
    row = ", ".join(f"`{f}`: string" for f in fields)
    pages = spark.read.schema(f"response struct<data: array<struct<{row}>>>").option(
        "multiLine", not per_line
    ).json(paths)
    return pages.select(F.explode("response.data").alias("d")).select("d.*")


def read_census(spark: SparkSession, paths, per_line: bool = False) -> DataFrame:
    """Survey files: one JSON array of rows per file, the first row naming the columns.

    The files are per state (a few hundred rows), so each is one record that Spark explodes;
    ``per_line`` reads archives with one such array per line.
    """
    raw = spark.read.option("wholetext", not per_line).text(paths)
    rows = raw.select(F.from_json("value", "array<array<string>>").alias("rows")).select(
        F.get("rows", 0).alias("header"), F.posexplode("rows").alias("i", "row")
    )
    m = rows.filter("i > 0").select(F.map_from_arrays("header", "row").alias("m"))
    state = pad(F.try_element_at("m", F.lit("state")), 2)
    county = pad(F.try_element_at("m", F.lit("county")), 3)
    return m.select(
        F.try_element_at("m", F.lit("NAME")).alias("NAME"),
        *[F.try_element_at("m", F.lit(code)).alias(name) for code, name in SURVEY_CODES.items()],
        state.alias("state_fips"), F.concat(state, county).alias("county_fips"),
    )
