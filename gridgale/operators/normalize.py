"""Raw feed rows -> canonical tables. Each function is one projection (at most a lookup)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridgale.constants import (
    ALERT_MAGNITUDE,
    CENSUS_CENTROID,
    COUNTY_AREA_SQ_MI,
    COUNTY_CENTROID,
    KM_PER_MILE,
    MPH_PER_KNOT,
    SEVERE_TYPES,
    STATE_FIPS,
    STATION_RANGES,
    STATIONS,
)
from gridgale.functions import hexgrid
from gridgale.functions.weather import dollars


def pad(code: Column, width: int) -> Column:
    """Left-pad with zeros, never cutting a longer code short."""
    text = code.cast("string")
    return F.lpad(text, F.greatest(F.length(text), F.lit(width)), F.lit("0"))


def number(value: Column) -> Column:
    return F.trim(value.cast("string")).try_cast("double")


def lookup(table: dict, key: Column) -> Column:
    """A fixed dictionary as a map literal; null when the key is absent."""
    entries = [F.lit(x) for pair in table.items() for x in pair]
    return F.try_element_at(F.create_map(*entries), key)


def first_of(df: DataFrame, names: list[str], default: Column | None = None) -> Column:
    """The first column of ``names`` that the feed has."""
    for n in names:
        if n in df.columns:
            return F.col(n)
    return default if default is not None else F.lit(None).cast("string")


def with_cells(df: DataFrame, lat: str = "lat", lon: str = "lon", resolutions=(7, 9)) -> DataFrame:
    """Cell ids (and, for the first resolution, q and r) of a point; null if it has none."""
    out = {}
    for i, res in enumerate(resolutions):
        q, r = hexgrid.locate(F.col(lat), F.col(lon), res)
        if i == 0:
            out["q"], out["r"] = q, r
        out[f"cell_res{res}"] = hexgrid.cell_id(q, r, res)
    return df.withColumns(out)


def geo_valid(lat: Column, lon: Column) -> Column:
    """Known coordinates on Earth, and not the (0, 0) placeholder."""
    return F.coalesce(
        lat.between(-90, 90) & lon.between(-180, 180) & ~((lat == 0) & (lon == 0)), F.lit(False)
    )


def in_state(fips: Column, region: str | None) -> Column:
    code = STATE_FIPS.get(region) if region else None
    return F.lit(True) if code is None else pad(fips, 2) == code


def storms(df: DataFrame) -> DataFrame:
    """Storm-detail rows (upper-case headers, parsed BEGIN_DATE_TIME)."""
    def total(*names: str) -> Column:
        out = F.lit(0).cast("bigint")
        for n in names:
            if n in df.columns:
                out = out + F.coalesce(number(F.col(n)).cast("bigint"), F.lit(0).cast("bigint"))
        return out

    zero = F.lit(0.0)
    out = df.select(
        F.col("BEGIN_DATE_TIME").alias("event_time"),
        F.lit("noaa_storms").alias("source"),
        F.trim("EVENT_TYPE").alias("event_type"),
        F.coalesce(number(first_of(df, ["MAGNITUDE"])), zero).alias("magnitude"),
        first_of(df, ["MAGNITUDE_TYPE"]).alias("magnitude_type"),
        number(F.col("BEGIN_LAT")).alias("lat"),
        number(F.col("BEGIN_LON")).alias("lon"),
        pad(first_of(df, ["STATE_FIPS"]), 2).alias("state_fips"),
        pad(first_of(df, ["CZ_FIPS"]), 3).alias("county_fips"),
        dollars(first_of(df, ["DAMAGE_PROPERTY"])).alias("damage_property"),
        dollars(first_of(df, ["DAMAGE_CROPS"])).alias("damage_crops"),
        total("INJURIES_DIRECT", "INJURIES_INDIRECT").alias("injuries"),
        total("DEATHS_DIRECT", "DEATHS_INDIRECT").alias("deaths"),
        first_of(df, ["EVENT_NARRATIVE"], F.lit("")).alias("narrative"),
        number(first_of(df, ["EPISODE_ID"])).cast("bigint").alias("episode_id"),
    )
    return with_cells(out)


def alerts(df: DataFrame) -> DataFrame:
    """Alert rows -> weather events. A row without an onset takes its own effective time (the
    feed's original rule looks at the whole batch, which would make a row depend on others)."""
    out = df.select(
        F.coalesce("onset", "effective").alias("event_time"),
        F.lit("nws").alias("source"),
        "event_type",
        F.coalesce(lookup(ALERT_MAGNITUDE, F.col("severity")), F.lit(10.0)).alias("magnitude"),
        F.lit("nws_severity").alias("magnitude_type"),
        "severity", "certainty", "urgency", "headline",
        F.left(F.coalesce("description", F.lit("")), F.lit(2000)).alias("narrative"),
        "area_desc", "lat", "lon", "expires", "alert_id",
    )
    return with_cells(out)


def clean_reading(value: Column) -> Column:
    """A station reading: ``M`` and blanks are missing, ``T`` is a trace."""
    text = F.trim(value.cast("string"))
    return F.when(text.isin("M", ""), None).when(text == "T", 0.001).otherwise(text.try_cast("double"))


def clean_station_rows(df: DataFrame) -> DataFrame:
    have = [c for c in STATION_RANGES if c in df.columns]
    return df.withColumns({c: clean_reading(F.col(c)) for c in have})


def station_observations(df: DataFrame) -> DataFrame:
    """Cleaned station rows -> weather events with both unit systems."""
    def measure(name: str) -> Column:
        return F.col(name) if name in df.columns else F.lit(None).cast("double")

    def celsius(c: Column) -> Column:
        return F.round((c - 32) * 5 / 9, 2)

    def mph(c: Column) -> Column:
        return F.round(c * MPH_PER_KNOT, 2)

    station = first_of(df, ["station", "station_id"])
    lat = number(first_of(df, ["station_lat", "lat"]))
    lon = number(first_of(df, ["station_lon", "lon"]))
    known_lat = lookup({k: v[0] for k, v in STATIONS.items()}, station)
    known_lon = lookup({k: v[1] for k, v in STATIONS.items()}, station)
    out = df.select(
        first_of(df, ["valid", "timestamp"]).alias("event_time"),
        F.lit("metar").alias("source"),
        F.lit("surface_observation").alias("event_type"),
        station.alias("station_id"),
        measure("tmpf").alias("temperature_f"), celsius(measure("tmpf")).alias("temperature_c"),
        measure("dwpf").alias("dewpoint_f"), celsius(measure("dwpf")).alias("dewpoint_c"),
        measure("sknt").alias("wind_speed_kt"), mph(measure("sknt")).alias("wind_speed_mph"),
        measure("gust").alias("gust_speed_kt"), mph(measure("gust")).alias("gust_speed_mph"),
        measure("p01i").alias("precip_in"), measure("vsby").alias("visibility_mi"),
        measure("alti").alias("altimeter_inhg"), measure("relh").alias("relative_humidity"),
        number(first_of(df, ["drct"])).alias("wind_direction_deg"),
        # greatest() skips nulls, as the larger of two optional readings should.
        F.coalesce(F.greatest(mph(measure("sknt")), mph(measure("gust"))), F.lit(0.0))
        .alias("magnitude"),
        F.lit("wind_mph").alias("magnitude_type"),
        F.coalesce(lat, known_lat).alias("lat"), F.coalesce(lon, known_lon).alias("lon"),
    )
    return with_cells(out)


def outages(df: DataFrame) -> DataFrame:
    """Validated county rows: cap, fraction, state from county, centroid cell."""
    county = pad(F.col("county_fips"), 5)
    out_now = F.least("customers_out", "total_customers")
    state = pad(F.col("state_fips"), 2) if "state_fips" in df.columns else F.left(county, F.lit(2))
    passed = [c for c in ("event_id",) if c in df.columns]
    out = df.select(
        *passed,
        F.col("observed_at"),
        county.alias("county_fips"),
        state.alias("state_fips"),
        out_now.cast("bigint").alias("customers_out"),
        F.col("total_customers").cast("bigint").alias("total_customers"),
        (out_now / F.col("total_customers")).alias("outage_fraction"),
        lookup({k: v[0] for k, v in COUNTY_CENTROID.items()}, county).alias("lat"),
        lookup({k: v[1] for k, v in COUNTY_CENTROID.items()}, county).alias("lon"),
        F.lit("eagle_i").alias("source"),
    )
    return with_cells(out)


def grid_load(df: DataFrame) -> DataFrame:
    capacity = F.col("capacity_mw") if "capacity_mw" in df.columns else F.lit(None).cast("double")
    reserve = F.round((capacity - F.col("load_mw")) / capacity * 100, 4)
    region = F.col("region") if "region" in df.columns else F.lit("ERCOT_SYSTEM")
    passed = [c for c in ("event_id",) if c in df.columns]
    return df.select(
        *passed, "recorded_at", "load_mw", "frequency_hz", capacity.alias("capacity_mw"),
        reserve.alias("reserve_margin_pct"), region.alias("region_code"),
        F.lit("ercot").alias("source"),
        F.coalesce((reserve < 6).cast("int"), F.lit(0)).alias("grid_stress_flag"),
    )


def utilities(df: DataFrame) -> DataFrame:
    have = set(df.columns)
    none = F.lit(None)
    if "county_fips" in have:
        county, state = pad(F.col("county_fips"), 5), none.cast("string")
    elif "state_fips" in have:
        county, state = none.cast("string"), pad(F.col("state_fips"), 2)
    elif "stateid" in have:
        county, state = none.cast("string"), lookup(STATE_FIPS, F.col("stateid"))
    else:
        county, state = none.cast("string"), none.cast("string")
    if "transmission_line_km" in have:
        line_km = number(F.col("transmission_line_km"))
    else:
        line_km = number(first_of(df, ["transmission_line_miles"])) * KM_PER_MILE
    return df.select(
        county.alias("county_fips"), state.alias("state_fips"),
        first_of(df, ["utility_id", "plantid"]).cast("string").alias("utility_id"),
        first_of(df, ["utility_name", "plantName", "plantname"]).alias("utility_name"),
        line_km.alias("transmission_line_km"),
        number(first_of(df, ["substations_count"])).alias("substations_count"),
        number(first_of(df, ["generation_capacity_mw", "generation"])).alias("generation_capacity_mw"),
        number(first_of(df, ["total_customers"])).alias("total_customers"),
        number(first_of(df, ["peak_demand_mw"])).alias("peak_demand_mw"),
        number(first_of(df, ["period"])).alias("data_year"),
        F.lit("eia").alias("source"),
    )


def demographics(df: DataFrame) -> DataFrame:
    """Survey rows -> county socio-economics."""
    def num(name: str) -> Column:
        return number(F.col(name)) if name in df.columns else F.lit(None).cast("double")

    county = F.col("county_fips")
    state = F.col("state_fips") if "state_fips" in df.columns else F.left(county, F.lit(2))
    people = num("total_population")
    # A ratio over zero is undefined here; ANSI division would stop the job instead.
    units = F.when(num("total_housing_units") != 0, num("total_housing_units"))
    counted = F.when(people != 0, people)
    out = df.select(
        county, state.alias("state_fips"),
        first_of(df, ["NAME"], F.lit("")).alias("county_name"),
        people.cast("bigint").alias("total_population"),
        (people / lookup(COUNTY_AREA_SQ_MI, county)).alias("population_density"),
        num("median_household_income").alias("median_household_income"),
        num("median_year_structure_built").alias("median_year_structure_built"),
        num("total_housing_units").alias("total_housing_units"),
        num("vacant_housing_units").alias("vacant_housing_units"),
        num("median_gross_rent").alias("median_gross_rent"),
        num("median_age").alias("median_age"),
        num("population_below_poverty").alias("population_below_poverty"),
        F.round(num("population_below_poverty") / counted, 6).alias("poverty_rate"),
        F.when(
            num("median_year_structure_built").isNotNull(),
            F.greatest(F.lit(0.0), 2020 - num("median_year_structure_built")),
        ).alias("avg_housing_age_years"),
        F.round(num("vacant_housing_units") / units, 6).alias("vacancy_rate"),
        lookup({k: v[0] for k, v in CENSUS_CENTROID.items()}, county).alias("lat"),
        lookup({k: v[1] for k, v in CENSUS_CENTROID.items()}, county).alias("lon"),
        F.lit("census_acs5").alias("source"), F.lit(2020).alias("data_year"),
    )
    return with_cells(out, resolutions=(7,)).drop("lat", "lon", "q", "r")


def early_labelled_set(df: DataFrame) -> DataFrame:
    """The first-generation table: four columns, no nulls, damage suffixes read as exponents."""
    # Letters become exponents one after the other, so "1KM" reads as nothing, as it did.
    damage = F.col("DAMAGE_PROPERTY").cast("string")
    for letter, exponent in (("K", "e3"), ("M", "e6"), ("B", "e9")):
        damage = F.replace(damage, F.lit(letter), F.lit(exponent))
    return df.select(
        F.col("BEGIN_DATE_TIME").cast("timestamp").alias("TIMESTAMP"),
        number(F.col("MAGNITUDE")).alias("MAGNITUDE"),
        number(damage).alias("DAMAGE_PROPERTY"),
        F.coalesce(F.col("EVENT_TYPE").isin(SEVERE_TYPES).cast("int"), F.lit(0)).alias("OUTAGE_RISK"),
    ).dropna()


def ring_centroid(geometry: Column) -> tuple[Column, Column]:
    """(lat, lon): plain mean of the vertices of a Point, Polygon outer ring, or the outer rings
    of a MultiPolygon. ``geometry`` is GeoJSON text."""
    kind = F.get_json_object(geometry, "$.type")
    coords = F.get_json_object(geometry, "$.coordinates")
    point = F.from_json(coords, "array<double>")
    polygon = F.from_json(coords, "array<array<array<double>>>")
    multi = F.from_json(coords, "array<array<array<array<double>>>>")
    rings = F.when(kind == "Polygon", F.get(polygon, 0)).when(
        kind == "MultiPolygon", F.flatten(F.transform(multi, lambda p: F.get(p, 0)))
    )

    def mean(axis: int) -> Column:
        total = F.aggregate(rings, F.lit(0.0), lambda acc, v: acc + F.get(v, axis))
        return F.when(kind == "Point", F.get(point, axis)).otherwise(
            F.when(F.size(rings) > 0, total / F.size(rings))
        )

    return mean(1), mean(0)
