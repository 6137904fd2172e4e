"""The full point-in-time feature vector, assembled from four aggregates and two dimensions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridgale.constants import (
    CATEGORIES,
    CATEGORY_PAIRS,
    OUTAGE_LAGS_H,
    OUTAGE_TRENDS_H,
    WEATHER_WINDOWS_H,
)
from gridgale.functions.clock import HOUR, cyclical, micros
from gridgale.functions.hexgrid import area_km2
from gridgale.functions.weather import clip
from gridgale.operators.disk import (
    DISK_K,
    GRAINS,
    PLACE,
    PLACED_POINT,
    distinct_points,
    grain_from,
    off_grain,
    outage_aggregates,
    outage_labels,
    placed,
    weather_aggregates,
    weather_width,
)
from gridgale.operators.range_join import range_join
from gridgale.operators.sequence import sequence_features

DEFAULT_TICK = 6 * HOUR

# --- feature names, by group ---------------------------------------------------------------
ROLLING = [
    f"weather_{stat}_{w}h"
    for w in WEATHER_WINDOWS_H
    for stat in ("count", "max_mag", "mean_mag", "distinct_types")
]
LAGS = [f"lag_outage_{lag}h" for lag in OUTAGE_LAGS_H]
CYCLES = ["hour_sin", "hour_cos", "dow_sin", "dow_cos", "month_sin", "month_cos", "is_weekend"]
TRENDS = [f"trend_outage_{w}h" for w in OUTAGE_TRENDS_H]
LOAD = ["current_load_mw", "reserve_margin_pct", "load_capacity_ratio"]
NEIGHBOUR_WEATHER = [
    "neighbor_weather_count", "neighbor_weather_max_mag", "neighbor_weather_mean_mag",
]
NEIGHBOUR_OUTAGE = ["neighbor_outage_mean", "neighbor_outage_max", "neighbor_outage_spread"]
INFRA = [
    "transmission_line_km", "distribution_line_km", "substations_count", "avg_line_age_years",
    "vegetation_density", "line_density_per_km2", "infrastructure_age_risk",
]
COOCCUR = [f"cooccur_{a}_{b}" for a, b in CATEGORY_PAIRS]
MAG_PRODUCTS = [f"interact_{a}_mag_x_{b}_mag" for a, b in CATEGORY_PAIRS]
DMG_PRODUCTS = [f"interact_{a}_dmg_x_{b}_dmg" for a, b in CATEGORY_PAIRS]
PER_CATEGORY = [
    f"cat_{c}_{stat}" for c in CATEGORIES for stat in ("max_magnitude", "total_damage", "event_count")
]
SEQUENCE = [
    "seq_storm_count_72h", "seq_escalation_score", "seq_infrastructure_fatigue",
    "seq_max_gap_hours", "seq_distinct_types", "seq_damage_acceleration",
]
SOCIO = [
    "population_density", "median_income_normalized", "critical_facility_density",
    "housing_age_median",
]
TEMPORAL_GROUP = ROLLING + LAGS + CYCLES + TRENDS + LOAD
SPATIAL_GROUP = NEIGHBOUR_WEATHER + NEIGHBOUR_OUTAGE + ["neighbor_ring_k"] + INFRA
COMPOUND_GROUP = (
    COOCCUR + ["compound_event_count", "has_compound_event"] + MAG_PRODUCTS + DMG_PRODUCTS
    + PER_CATEGORY + SEQUENCE + ["compound_severity_index"]
)
FEATURES = TEMPORAL_GROUP + SPATIAL_GROUP + COMPOUND_GROUP + SOCIO


WEATHER_REACH_H = max(WEATHER_WINDOWS_H)
OUTAGE_REACH_H = max(OUTAGE_LAGS_H) + 0.5


def keyed(points: DataFrame) -> DataFrame:
    return points.withColumn("t", micros(F.col("ts")))


Span = tuple[int, int, int, int]


def span_of(points: DataFrame) -> Span:
    """First and last time of the points in microseconds, about how many disks they have, and the grain of
    their times: one row to the driver."""
    row = points.agg(
        F.min(micros(F.col("ts"))).alias("lo"), F.max(micros(F.col("ts"))).alias("hi"),
        F.approx_count_distinct(F.struct("q", "r")).alias("disks"), off_grain(micros(F.col("ts"))).alias("off"),
    ).first()
    return (row["lo"], row["hi"], row["disks"], grain_from(row["off"])) if row["lo"] is not None else (1, 0, 0, GRAINS[0])


def reached(events: DataFrame, time: str, span: Span, before_h: float, after_h: float = 0.0) -> DataFrame:
    """Events that some point can see. The bounds are literals, so folders and row groups outside are
    never read, however long the history is."""
    low, high = span[0] - int(before_h * HOUR), span[1] + int(after_h * HOUR)
    if span[0] > span[1]:
        return events.filter(F.lit(False))
    at = F.col(time)
    return events.filter((at >= F.timestamp_micros(F.lit(low))) & (at <= F.timestamp_micros(F.lit(high))))


def attach(points: DataFrame, found: DataFrame, names: list[str]) -> DataFrame:
    """Left-join per-(q, r, t) results; a point with nothing found gets zeros. As many rows as points are never
    broadcast, however few Spark takes them for."""
    out = keyed(points).join(found.hint("merge"), ["q", "r", "t"], "left").drop("t")
    return out.withColumns({n: F.coalesce(F.col(n), F.lit(0.0)) for n in names})


# --- single groups -------------------------------------------------------------------------

def rolling_weather(points: DataFrame, weather: DataFrame, tick: int = DEFAULT_TICK, k: int = DISK_K) -> DataFrame:
    span = span_of(points)
    weather = reached(weather, "event_time", span, WEATHER_REACH_H)
    found = weather_aggregates(distinct_points(points), weather, tick, k, grain=span[3])
    return attach(points, found, ROLLING).select(*points.columns, *ROLLING)


def neighbour_weather(points: DataFrame, weather: DataFrame, tick: int = DEFAULT_TICK, k: int = DISK_K) -> DataFrame:
    span = span_of(points)
    weather = reached(weather, "event_time", span, WEATHER_REACH_H)
    found = weather_aggregates(distinct_points(points), weather, tick, k, grain=span[3])
    out = attach(points, found, NEIGHBOUR_WEATHER).withColumn("neighbor_ring_k", F.lit(float(k)))
    return out.select(*points.columns, *NEIGHBOUR_WEATHER, "neighbor_ring_k")


def per_category(points: DataFrame, weather: DataFrame, tick: int = DEFAULT_TICK, k: int = DISK_K) -> DataFrame:
    span = span_of(points)
    weather = reached(weather, "event_time", span, WEATHER_REACH_H)
    found = weather_aggregates(distinct_points(points), weather, tick, k, grain=span[3])
    return attach(points, found, PER_CATEGORY).select(*points.columns, *PER_CATEGORY)


def outage_history(points: DataFrame, outages: DataFrame, tick: int = DEFAULT_TICK, k: int = DISK_K) -> DataFrame:
    names = LAGS + TRENDS + NEIGHBOUR_OUTAGE
    span = span_of(points)
    outages = reached(outages, "observed_at", span, OUTAGE_REACH_H)
    found = outage_aggregates(distinct_points(points), outages, tick, k, span[3])
    return attach(points, found, names).select(*points.columns, *names)


def event_sequence(points: DataFrame, weather: DataFrame, tick: int = DEFAULT_TICK, k: int = DISK_K) -> DataFrame:
    keys = distinct_points(points)
    span = span_of(points)
    weather = reached(weather, "event_time", span, WEATHER_REACH_H)
    found = sequence_features(keys, weather, tick, k, n_disks=span[2], grain=span[3]).join(
        weather_aggregates(keys, weather, tick, k, grain=span[3]).select(
            "q", "r", "t", F.col("weather_distinct_types_72h").alias("seq_distinct_types")
        ).hint("merge"),
        ["q", "r", "t"],
    )
    return attach(points, found, SEQUENCE).select(*points.columns, *SEQUENCE)


def severity_index(points: DataFrame, weather: DataFrame, tick: int = DEFAULT_TICK, k: int = DISK_K) -> DataFrame:
    """The compound severity index alone: one pass for the categories, one for the sequence."""
    keys = distinct_points(points)
    span = span_of(points)
    weather = reached(weather, "event_time", span, WEATHER_REACH_H)
    found = weather_aggregates(keys, weather, tick, k, grain=span[3]).join(
        sequence_features(keys, weather, tick, k, n_disks=span[2], grain=span[3]).hint("merge"), ["q", "r", "t"], "left"
    ).withColumn("seq_distinct_types", F.col("weather_distinct_types_72h"))
    out = attach(points, found, PER_CATEGORY + SEQUENCE)
    return with_severity(with_interactions(with_cooccurrence(out))).select(*points.columns, "compound_severity_index")


def grid_load_as_of(points: DataFrame, load: DataFrame, leak_safe: bool = False) -> DataFrame:
    """Latest load within an hour of each point's time, on either side unless ``leak_safe``.

    Worked out once per distinct time, whatever the number of cells.
    """
    times = points.select(micros(F.col("ts")).alias("t"), F.lit(1).alias("one")).distinct()
    rows = load.select(
        F.lit(1).alias("one"),
        micros(F.col("recorded_at")).alias("at"),
        F.struct(
            F.coalesce("load_mw", F.lit(0.0)).alias("load"),
            F.coalesce("capacity_mw", F.lit(0.0)).alias("cap"),
            F.coalesce("reserve_margin_pct", F.lit(0.0)).alias("reserve"),
        ).alias("row"),
    )
    # One row per instant first, so that repeats of an instant cannot multiply the join.
    rows = rows.groupBy("one", "at").agg(F.max("row").alias("row"))
    ahead = 0 if leak_safe else HOUR
    near = range_join(
        times, rows, ["one"], "at", F.col("t") - HOUR, F.col("t") + ahead, HOUR + max(ahead, 1)
    )
    last = near.groupBy("t").agg(F.max_by("row", "at").alias("row")).select(
        "t",
        F.col("row.load").alias("current_load_mw"),
        F.col("row.reserve").alias("reserve_margin_pct"),
        F.when(F.col("row.cap") > 0, F.col("row.load") / F.col("row.cap")).otherwise(0.0)
        .alias("load_capacity_ratio"),
    )
    out = keyed(points).join(last, "t", "left").drop("t")
    return out.withColumns({n: F.coalesce(F.col(n), F.lit(0.0)) for n in LOAD})


def calendar(points: DataFrame) -> DataFrame:
    return points.withColumns(cyclical(F.col("ts")))


def infrastructure(points: DataFrame, infra: DataFrame, res: int = 7) -> DataFrame:
    raw = INFRA[:5]
    dim = infra.select("cell", *[F.col(c).cast("double").alias(c) for c in raw])
    out = points.join(dim, "cell", "left")
    out = out.withColumns({c: F.coalesce(F.col(c), F.lit(0.0)) for c in raw})
    return out.withColumns({
        "line_density_per_km2":
            (F.col("transmission_line_km") + F.col("distribution_line_km")) / F.lit(area_km2(res)),
        "infrastructure_age_risk": F.least(F.lit(1.0), F.col("avg_line_age_years") / 50.0),
    })


def socioeconomic(points: DataFrame, socio: DataFrame) -> DataFrame:
    dim = socio.select(
        "cell",
        F.col("population_density").cast("double").alias("population_density"),
        (F.col("median_income") / 100000.0).alias("median_income_normalized"),
        F.col("critical_facilities_count").cast("double").alias("critical_facility_density"),
        F.col("housing_age_median").cast("double").alias("housing_age_median"),
    )
    out = points.join(dim, "cell", "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(0.0)) for c in SOCIO})


def vulnerability(socio: DataFrame) -> DataFrame:
    """Composite vulnerability of a place, with a null reading counted as zero."""
    def num(name: str) -> Column:
        return F.coalesce(F.col(name).cast("double"), F.lit(0.0))

    housing = F.least(F.lit(1.0), num("housing_age_median") / 60.0)
    score = (
        F.least(F.lit(1.0), num("population_density") / 5000.0) * 0.30
        + (F.lit(1.0) - F.least(F.lit(1.0), num("median_income") / 100000.0)) * 0.20
        + housing * 0.15
        + F.least(F.lit(1.0), num("critical_facilities_count") / 10.0) * 0.35
    )
    return socio.withColumns({
        "median_income_normalized":
            F.when(num("median_income") > 0, num("median_income") / 100000.0).otherwise(0.0),
        "housing_vulnerability": housing,
        "critical_facility_density": num("critical_facilities_count"),
        "composite_vulnerability_index": clip(score, 0.0, 1.0),
    })


# --- derived compound columns --------------------------------------------------------------

def with_cooccurrence(df: DataFrame) -> DataFrame:
    """Pair flags and counts of active categories, from the per-category counts."""
    active = {c: (F.col(f"cat_{c}_event_count") > 0).cast("double") for c in CATEGORIES}
    count = reduce(lambda a, b: a + b, active.values())
    out = {f"cooccur_{a}_{b}": active[a] * active[b] for a, b in CATEGORY_PAIRS}
    out["compound_event_count"] = count
    out["has_compound_event"] = (count >= 2).cast("double")
    return df.withColumns(out)


def with_interactions(df: DataFrame) -> DataFrame:
    """Products of peak magnitudes and of log damages for every pair of categories."""
    out = {}
    for a, b in CATEGORY_PAIRS:
        out[f"interact_{a}_mag_x_{b}_mag"] = (
            F.col(f"cat_{a}_max_magnitude") * F.col(f"cat_{b}_max_magnitude")
        )
        out[f"interact_{a}_dmg_x_{b}_dmg"] = (
            F.log1p(f"cat_{a}_total_damage") * F.log1p(f"cat_{b}_total_damage")
        )
    return df.withColumns(out)


def with_severity(df: DataFrame) -> DataFrame:
    """One score in [0, 1] from co-occurrence, interactions and sequence."""
    products = reduce(lambda a, b: a + b, [F.col(c) for c in MAG_PRODUCTS])
    together = F.col("compound_event_count") / float(len(CATEGORIES))
    interact = F.least(F.lit(1.0), products / float(len(MAG_PRODUCTS)) / 100.0)
    chain = F.least(
        F.lit(1.0),
        (
            F.col("seq_infrastructure_fatigue") / 50.0
            + F.col("seq_escalation_score")
            + F.col("seq_storm_count_72h") / 20.0
        ) / 3.0,
    )
    return df.withColumn(
        "compound_severity_index", clip(together * 0.3 + interact * 0.4 + chain * 0.3, 0.0, 1.0)
    )


# --- the whole vector ----------------------------------------------------------------------

def feature_table(
    points: DataFrame,
    weather: DataFrame,
    outages: DataFrame,
    load: DataFrame,
    infra: DataFrame,
    socio: DataFrame,
    tick: int = DEFAULT_TICK,
    k: int = DISK_K,
    res: int = 7,
    vocabulary: list[str] | None = None,
    leak_safe: bool = False,
) -> DataFrame:
    """All features for each point: one row per input row, never null."""
    keys, span = distinct_points(points), span_of(points)
    weather = reached(weather, "event_time", span, WEATHER_REACH_H)
    outages = reached(outages, "observed_at", span, OUTAGE_REACH_H)
    load = reached(load, "recorded_at", span, 1, 1)
    rolling = weather_aggregates(keys, weather, tick, k, vocabulary, span[3], stay=True)
    chains = sequence_features(keys, weather, tick, k, n_disks=span[2], grain=span[3])
    lags = outage_aggregates(keys, outages, tick, k, span[3])
    names = ROLLING + NEIGHBOUR_WEATHER + PER_CATEGORY + SEQUENCE + LAGS + TRENDS + NEIGHBOUR_OUTAGE
    # Load and dimensions meet the bare points: after the first wide join no row is shuffled again.
    out = socioeconomic(infrastructure(grid_load_as_of(points, load, leak_safe), infra, res), socio)
    width = weather_width(span[3], tick)
    out = placed(keyed(out), width).repartition(*PLACE)
    # The widest aggregates lie in the points' places; the others are sent there.
    for found in (rolling, placed(chains, width), placed(lags, width)):
        out = out.join(found.hint("merge"), PLACED_POINT, "left")
    out = out.drop(*PLACE, "t").withColumn("seq_distinct_types", F.col("weather_distinct_types_72h"))
    out = out.withColumns({n: F.coalesce(F.col(n), F.lit(0.0)) for n in names})
    out = calendar(with_severity(with_interactions(with_cooccurrence(out))))
    out = out.withColumn("neighbor_ring_k", F.lit(float(k)))
    return out.select(*points.columns, *FEATURES)


def global_rolling(points: DataFrame, weather: DataFrame, tick: int = DEFAULT_TICK) -> DataFrame:
    """Rolling statistics over all events, whatever their cell: the scope of a caller that
    passes an unfiltered table. Slices of time are the only key, so work per time is bounded."""
    from gridgale.operators.disk import event_vocabulary

    plane = weather.withColumns({"q": F.lit(0).cast("bigint"), "r": F.lit(0).cast("bigint")})
    times = points.select("ts").distinct().withColumns(
        {"q": F.lit(0).cast("bigint"), "r": F.lit(0).cast("bigint")}
    )
    vocabulary = event_vocabulary(weather)
    found = weather_aggregates(distinct_points(times), plane, tick, 0, vocabulary)
    found = found.select(F.timestamp_micros("t").alias("ts"), *ROLLING)
    out = points.join(found, "ts", "left")
    return out.withColumns({n: F.coalesce(F.col(n), F.lit(0.0)) for n in ROLLING}).select(
        *points.columns, *ROLLING
    )


def labels(
    points: DataFrame, outages: DataFrame, tick: int = DEFAULT_TICK, horizon_h: int = 24,
    leak_safe: bool = False,
) -> DataFrame:
    """Add ``target_outage`` and ``target_max_outage_fraction``."""
    span = span_of(points)
    outages = reached(outages, "observed_at", span, 0, horizon_h)
    found = outage_labels(distinct_points(points), outages, tick, horizon_h, leak_safe, span[3])
    out = keyed(points).join(found.hint("merge"), ["q", "r", "t"], "left")
    return out.select(
        *points.columns,
        F.col("worst").isNotNull().cast("int").alias("target_outage"),
        F.coalesce("worst", F.lit(0.0)).alias("target_max_outage_fraction"),
    )


def feature_groups(include_uncatalogued: bool = False) -> dict[str, list[str]]:
    """Groups as used by the ablation. By default the two columns that the group patterns
    miss (``neighbor_ring_k``, ``has_compound_event``) stay out, as in the published runs."""
    groups = {
        "temporal": TEMPORAL_GROUP, "spatial": SPATIAL_GROUP,
        "compound": COMPOUND_GROUP, "socioeconomic": SOCIO,
    }
    if include_uncatalogued:
        return groups
    missed = {"neighbor_ring_k", "has_compound_event"}
    return {g: [c for c in cols if c not in missed] for g, cols in groups.items()}


def feature_catalog(features: DataFrame, nonzero: Callable[[Column], Column] = lambda c: c != 0) -> DataFrame:
    """One row per feature: group, type, and its range and share of non-zeros in the data; ``nonzero`` tells which
    values are taken for such."""
    of_group = {c: g for g, cols in feature_groups(True).items() for c in cols}
    names = [c for c in features.columns if c in of_group]
    lookup = F.create_map(*[F.lit(x) for c in names for x in (c, of_group[c])])
    # Aggregate wide (one row) and only then turn columns into rows.
    wide = features.agg(*[
        F.struct(
            F.min(c).alias("lo"), F.max(c).alias("hi"),
            F.avg(nonzero(F.col(c)).cast("double")).alias("share"),
        ).alias(c)
        for c in names
    ])
    long = wide.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature_name"), F.col(c).alias("s")) for c in names
    ])).alias("e"))
    return long.select(
        "e.feature_name",
        F.element_at(lookup, F.col("e.feature_name")).alias("feature_group"),
        F.lit("double").alias("dtype"),
        F.col("e.s.lo").alias("min_value"), F.col("e.s.hi").alias("max_value"),
        F.col("e.s.share").alias("nonzero_share"),
    )


def to_store(features: DataFrame, version: str = "v1.0") -> DataFrame:
    """Rows of the feature store: key columns, version, and a name -> value map."""
    names = [c for c in features.columns if c in set(FEATURES)]
    targets = [c for c in ("target_outage", "target_max_outage_fraction") if c in features.columns]
    values = F.map_from_arrays(
        F.array(*[F.lit(n) for n in names]), F.array(*[F.col(n) for n in names])
    )
    return features.select(
        F.col("ts").alias("computed_at"), "cell", F.lit(version).alias("feature_version"),
        values.alias("features"), *targets,
    )


FEW_CELLS = 2_000_000


def latest_per_cell(store: DataFrame) -> DataFrame:
    """Newest store row of each cell. Times alone are compared first: rows that are not of their cell's newest time go
    where they are made, and an aggregate does not sort all rows with their maps. Newest times are broadcast, unless
    cells are very many; then the aggregate takes all rows."""
    rest = [c for c in store.columns if c != "cell"]
    last = store.groupBy(F.col("cell").alias("_cell")).agg(F.max("computed_at").alias("_last"))
    newest = store
    if last.select("_cell").count() <= FEW_CELLS:
        is_last = F.col("cell").eqNullSafe(F.col("_cell")) & F.col("computed_at").eqNullSafe(F.col("_last"))
        newest = store.join(F.broadcast(last), is_last, "left_semi")
    newest = newest.groupBy("cell").agg(F.max_by(F.struct(*rest), "computed_at").alias("row"))
    return newest.select("cell", *[F.col(f"row.{c}").alias(c) for c in rest])
