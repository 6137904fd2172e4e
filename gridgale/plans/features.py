"""Feature queries: one per group, and the full vector."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridgale.constants import (
    CATEGORIES,
    CATEGORY_PAIRS,
    CATEGORY_TYPES,
    OUTAGE_LAGS_H,
    OUTAGE_TRENDS_H,
    WEATHER_WINDOWS_H,
)
from gridgale.operators import features as feat
from gridgale.operators import points as pts
from gridgale.plans.base import Source, query, rounded, tidied, tidied_nonzero, tidy

# --- oracle pieces -------------------------------------------------------------------------
# The oracle joins every point with every event of its disk, the plain reading of the
# definitions; the Spark side never forms those pairs.

# An equality join through the list of disk offsets, so that it ends in good time.
_OFFSETS = "(VALUES " + ", ".join(
    f"({dq}, {dr})" for dq in range(-2, 3) for dr in range(-2, 3) if abs(dq + dr) <= 2
) + ") AS o(dq, dr)"
_DISK = "{e}.q = p.q + o.dq AND {e}.r = p.r + o.dr"


def _case_category() -> str:
    whens = " ".join(
        "WHEN event_type IN (" + ", ".join(f"'{t}'" for t in types) + f") THEN '{name}'"
        for name, types in CATEGORY_TYPES.items()
    )
    return f"CASE {whens} END"


CATEGORY_SQL = _case_category()

_NEAR_WEATHER = f"""
    SELECT p.cell, p.q, p.r, p.ts, w.event_id, w.event_time, w.event_type, w.magnitude AS m,
      w.damage_property AS d, {CATEGORY_SQL.replace('event_type', 'w.event_type')} AS cat,
      (p.q = w.q AND p.r = w.r) AS is_self,
      epoch_us(p.ts) - epoch_us(w.event_time) AS age
    FROM points p CROSS JOIN {_OFFSETS} JOIN weather w ON {_DISK.format(e='w')}
      AND w.event_time >= p.ts - INTERVAL 72 HOUR AND w.event_time <= p.ts"""

_NEAR_OUTAGES = f"""
    SELECT p.cell, p.q, p.r, p.ts, e.cell AS ocell, e.outage_fraction AS f,
      (p.q = e.q AND p.r = e.r) AS is_self,
      (epoch_us(p.ts) - epoch_us(e.observed_at)) / 3600000000.0 AS age
    FROM points p CROSS JOIN {_OFFSETS} JOIN outages e ON {_DISK.format(e='e')}
      AND e.observed_at >= p.ts - INTERVAL 169 HOUR AND e.observed_at <= p.ts"""

_H = 3_600_000_000


def _rolling_sql() -> list[str]:
    out = []
    for w in WEATHER_WINDOWS_H:
        inside = f"age <= {w * _H}"
        out += [
            f"CAST(count(*) FILTER ({inside}) AS DOUBLE) AS weather_count_{w}h",
            f"coalesce(max(m) FILTER ({inside}), 0.0) AS weather_max_mag_{w}h",
            f"coalesce(avg(m) FILTER ({inside}), 0.0) AS weather_mean_mag_{w}h",
            f"CAST(count(DISTINCT event_type) FILTER ({inside}) AS DOUBLE) AS weather_distinct_types_{w}h",
        ]
    return out


def _neighbour_sql() -> list[str]:
    inside = f"age <= {24 * _H} AND NOT is_self"
    return [
        f"CAST(count(*) FILTER ({inside}) AS DOUBLE) AS neighbor_weather_count",
        f"coalesce(max(m) FILTER ({inside}), 0.0) AS neighbor_weather_max_mag",
        f"coalesce(avg(m) FILTER ({inside}), 0.0) AS neighbor_weather_mean_mag",
    ]


def _category_sql() -> list[str]:
    out = []
    for c in CATEGORIES:
        inside = f"age <= {24 * _H} AND cat = '{c}'"
        out += [
            f"coalesce(max(m) FILTER ({inside}), 0.0) AS cat_{c}_max_magnitude",
            f"coalesce(sum(d) FILTER ({inside}), 0.0) AS cat_{c}_total_damage",
            f"CAST(count(*) FILTER ({inside}) AS DOUBLE) AS cat_{c}_event_count",
        ]
    return out


def _outage_sql() -> list[str]:
    out = []
    for lag in OUTAGE_LAGS_H:
        out.append(
            f"coalesce(avg(f) FILTER (age >= {lag} - 0.5 AND age <= {lag} + 0.5), 0.0) AS lag_outage_{lag}h"
        )
    for w in OUTAGE_TRENDS_H:
        out.append(
            f"coalesce(avg(f) FILTER (age <= {w / 2}), 0.0)"
            f" - coalesce(avg(f) FILTER (age > {w / 2} AND age <= {w}), 0.0) AS trend_outage_{w}h"
        )
    inside = "age <= 24 AND NOT is_self"
    out += [
        f"coalesce(avg(f) FILTER ({inside}), 0.0) AS neighbor_outage_mean",
        f"coalesce(max(f) FILTER ({inside}), 0.0) AS neighbor_outage_max",
        f"count(DISTINCT ocell) FILTER ({inside} AND f > 0.01) / 18.0 AS neighbor_outage_spread",
    ]
    return out


_SEQ_RANKED = f"""
    SELECT cell, ts, m, d, event_type, event_time,
      row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY cell, ts) AS n,
      m - lag(m) OVER w AS dm, epoch_us(event_time) - lag(epoch_us(event_time)) OVER w AS gap
    FROM ({_NEAR_WEATHER}) WINDOW w AS (PARTITION BY cell, ts ORDER BY event_time, event_id)"""

_SEQ_SQL = f"""
    SELECT cell, ts, CAST(count(*) AS DOUBLE) AS seq_storm_count_72h,
      CASE WHEN count(*) >= 2 THEN count(*) FILTER (dm > 0) / (count(*) - 1.0) ELSE 0.0 END
        AS seq_escalation_score,
      CASE WHEN count(*) >= 2 THEN sum(m * (0.5 + 0.5 * i / (n - 1.0)))
        / sum(0.5 + 0.5 * i / (n - 1.0)) ELSE 0.0 END AS seq_infrastructure_fatigue,
      CASE WHEN count(*) >= 2 THEN max(gap) / 3600000000.0 ELSE 72.0 END AS seq_max_gap_hours,
      CAST(count(DISTINCT event_type) AS DOUBLE) AS seq_distinct_types,
      CASE WHEN count(*) >= 3 THEN ln(1 + avg(d) FILTER (i >= n // 2))
        - ln(1 + avg(d) FILTER (i < n // 2)) ELSE 0.0 END AS seq_damage_acceleration
    FROM ({_SEQ_RANKED}) GROUP BY cell, ts"""


def _zero(names: list[str], alias: str) -> str:
    return ", ".join(f"coalesce({alias}.{n}, 0.0) AS {n}" for n in names)


def _point_oracle(inner: str, names: list[str]) -> str:
    return f"SELECT p.cell, p.ts, {_zero(names, 'a')} FROM points p LEFT JOIN ({inner}) a USING (cell, ts)"


def _per_point(select: list[str], pairs: str) -> str:
    return f"SELECT cell, ts, {', '.join(select)} FROM ({pairs}) GROUP BY cell, ts"


def _calendar_sql(prefix: str = "") -> str:
    two_pi = "2 * pi()"
    hour = f"(hour({prefix}ts) + minute({prefix}ts) / 60.0)"
    dow, month = f"(isodow({prefix}ts) - 1)", f"(month({prefix}ts) - 1)"
    out = []
    for name, value, period in (("hour", hour, 24), ("dow", dow, 7), ("month", month, 12)):
        out += [f"{fn}({two_pi} * {value} / {period}) AS {name}_{fn}" for fn in ("sin", "cos")]
    out.append(f"CASE WHEN isodow({prefix}ts) >= 6 THEN 1.0E0 ELSE 0.0E0 END AS is_weekend")
    return ", ".join(out)


_LOAD_SQL = """
    SELECT p.ts, max_by(l.load_mw, l.recorded_at) AS current_load_mw,
      max_by(l.reserve_margin_pct, l.recorded_at) AS reserve_margin_pct,
      max_by(l.load_mw / l.capacity_mw, l.recorded_at) AS load_capacity_ratio
    FROM (SELECT DISTINCT ts FROM points) p JOIN grid_load l
      ON l.recorded_at BETWEEN p.ts - INTERVAL 1 HOUR AND p.ts + INTERVAL 1 HOUR GROUP BY p.ts"""

_INFRA_SQL = """coalesce(transmission_line_km, 0.0) AS transmission_line_km,
    coalesce(distribution_line_km, 0.0) AS distribution_line_km,
    CAST(coalesce(substations_count, 0) AS DOUBLE) AS substations_count,
    coalesce(avg_line_age_years, 0.0) AS avg_line_age_years,
    coalesce(vegetation_density, 0.0) AS vegetation_density,
    (coalesce(transmission_line_km, 0.0) + coalesce(distribution_line_km, 0.0)) / 5.161
      AS line_density_per_km2,
    least(1.0, coalesce(avg_line_age_years, 0.0) / 50.0) AS infrastructure_age_risk"""

_SOCIO_SQL = """coalesce(population_density, 0.0) AS population_density,
    coalesce(median_income / 100000.0, 0.0) AS median_income_normalized,
    CAST(coalesce(critical_facilities_count, 0) AS DOUBLE) AS critical_facility_density,
    coalesce(housing_age_median, 0.0) AS housing_age_median"""


def _compound_sql() -> list[str]:
    def act(c: str) -> str:
        return f"(CASE WHEN cat_{c}_event_count > 0 THEN 1.0E0 ELSE 0.0E0 END)"

    total = " + ".join(act(c) for c in CATEGORIES)
    out = [f"{act(a)} * {act(b)} AS cooccur_{a}_{b}" for a, b in CATEGORY_PAIRS]
    out += [
        f"({total}) AS compound_event_count",
        f"(CASE WHEN ({total}) >= 2 THEN 1.0E0 ELSE 0.0E0 END) AS has_compound_event",
    ]
    out += [
        f"cat_{a}_max_magnitude * cat_{b}_max_magnitude AS interact_{a}_mag_x_{b}_mag"
        for a, b in CATEGORY_PAIRS
    ]
    out += [
        f"ln(1 + cat_{a}_total_damage) * ln(1 + cat_{b}_total_damage) AS interact_{a}_dmg_x_{b}_dmg"
        for a, b in CATEGORY_PAIRS
    ]
    return out


_SEVERITY_SQL = (
    "least(1.0, greatest(0.0, 0.3 * compound_event_count / 6.0 + 0.4 * least(1.0, ("
    + " + ".join(feat.MAG_PRODUCTS)
    + ") / 15.0 / 100.0) + 0.3 * least(1.0, (seq_infrastructure_fatigue / 50.0"
    " + seq_escalation_score + seq_storm_count_72h / 20.0) / 3.0))) AS compound_severity_index"
)
_WEATHER_AGG = _per_point(_rolling_sql() + _neighbour_sql() + _category_sql(), _NEAR_WEATHER)
_WEATHER_NAMES = feat.ROLLING + feat.NEIGHBOUR_WEATHER + feat.PER_CATEGORY
_OUTAGE_NAMES = feat.LAGS + feat.TRENDS + feat.NEIGHBOUR_OUTAGE

_FULL_SQL = f"""
    SELECT s.*, {_SEVERITY_SQL}, {_calendar_sql('s.')}, 2.0E0 AS neighbor_ring_k,
      coalesce(l.current_load_mw, 0.0) AS current_load_mw,
      coalesce(l.reserve_margin_pct, 0.0) AS reserve_margin_pct,
      coalesce(l.load_capacity_ratio, 0.0) AS load_capacity_ratio,
      {_INFRA_SQL}, {_SOCIO_SQL}
    FROM (SELECT b.*, {', '.join(_compound_sql())} FROM (
      SELECT p.cell, p.ts, {_zero(_WEATHER_NAMES, 'w')}, {_zero(_OUTAGE_NAMES, 'o')},
        {_zero(feat.SEQUENCE, 'q')}
      FROM points p LEFT JOIN ({_WEATHER_AGG}) w USING (cell, ts)
        LEFT JOIN ({_per_point(_outage_sql(), _NEAR_OUTAGES)}) o USING (cell, ts)
        LEFT JOIN ({_SEQ_SQL}) q USING (cell, ts)) b) s
    LEFT JOIN ({_LOAD_SQL}) l USING (ts)
    LEFT JOIN infra i ON s.cell = i.cell LEFT JOIN socio c ON s.cell = c.cell"""

_LABEL_SQL = """
    SELECT p.cell, p.ts, CASE WHEN max(o.outage_fraction) IS NULL THEN 0 ELSE 1 END AS target_outage,
      coalesce(max(o.outage_fraction), 0.0) AS target_max_outage_fraction
    FROM points p LEFT JOIN outages o ON o.cell = p.cell AND o.outage_fraction > 0.01
      AND o.observed_at >= p.ts AND o.observed_at <= p.ts + INTERVAL 24 HOUR
    GROUP BY p.cell, p.ts"""


# --- queries -------------------------------------------------------------------------------

@query("f0_global_scope", rounded(
    ["weather", "points"],
    f"""SELECT p.cell, p.ts, {_zero(feat.ROLLING, 'a')} FROM points p LEFT JOIN (
        SELECT ts, {', '.join(_rolling_sql())} FROM (SELECT t.ts, w.magnitude AS m, w.event_type,
          epoch_us(t.ts) - epoch_us(w.event_time) AS age FROM (SELECT DISTINCT ts FROM points) t
          JOIN weather w ON w.event_time >= t.ts - INTERVAL 72 HOUR AND w.event_time <= t.ts)
        GROUP BY ts) a USING (ts)""",
    feat.ROLLING,
))
def f0_global_scope(s: Source) -> DataFrame:
    return tidy(feat.global_rolling(s.points, s.weather).drop("q", "r"))


@query("f1_rolling_weather", rounded(
    ["weather", "points"],
    _point_oracle(_per_point(_rolling_sql(), _NEAR_WEATHER), feat.ROLLING), feat.ROLLING,
))
def f1_rolling_weather(s: Source) -> DataFrame:
    return tidy(feat.rolling_weather(s.points, s.weather).drop("q", "r"))


_DISTINCT = [c for c in feat.ROLLING if "distinct" in c]


@query("f1_distinct_types_any_vocabulary", rounded(
    ["weather", "points"],
    _point_oracle(_per_point([x for x in _rolling_sql() if "distinct" in x], _NEAR_WEATHER), _DISTINCT), [],
))
def f1_distinct_types(s: Source) -> DataFrame:
    from gridgale.operators.disk import distinct_points, distinct_type_counts

    keys = distinct_points(s.points)
    found = distinct_type_counts(keys, s.weather, feat.DEFAULT_TICK)
    out = feat.keyed(s.points).join(found.hint("merge"), ["q", "r", "t"], "left")
    return out.select("cell", "ts", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in _DISTINCT])


@query("f2_outage_lags", rounded(
    ["weather", "points", "outages"],
    _point_oracle(_per_point(_outage_sql(), _NEAR_OUTAGES), feat.LAGS), feat.LAGS,
))
def f2_outage_lags(s: Source) -> DataFrame:
    return tidy(feat.outage_history(s.points, s.outages).select("cell", "ts", *feat.LAGS))


@query("f3_calendar", rounded(
    ["weather", "points"], f"SELECT cell, ts, {_calendar_sql()} FROM points", feat.CYCLES,
))
def f3_calendar(s: Source) -> DataFrame:
    return tidy(feat.calendar(s.points).drop("q", "r"))


@query("f4_outage_trends", rounded(
    ["weather", "points", "outages"],
    _point_oracle(_per_point(_outage_sql(), _NEAR_OUTAGES), feat.TRENDS), feat.TRENDS,
))
def f4_outage_trends(s: Source) -> DataFrame:
    return tidy(feat.outage_history(s.points, s.outages).select("cell", "ts", *feat.TRENDS))


@query("f5_grid_load_as_of", rounded(
    ["weather", "points", "grid_load"],
    f"SELECT p.cell, p.ts, {_zero(feat.LOAD, 'l')} FROM points p LEFT JOIN ({_LOAD_SQL}) l USING (ts)",
    feat.LOAD,
))
def f5_grid_load_as_of(s: Source) -> DataFrame:
    return tidy(feat.grid_load_as_of(s.points, s.grid_load).drop("q", "r"))


@query("f6_neighbour_weather", rounded(
    ["weather", "points"],
    "SELECT *, 2.0E0 AS neighbor_ring_k FROM ("
    + _point_oracle(_per_point(_neighbour_sql(), _NEAR_WEATHER), feat.NEIGHBOUR_WEATHER) + ")",
    feat.NEIGHBOUR_WEATHER,
))
def f6_neighbour_weather(s: Source) -> DataFrame:
    return tidy(feat.neighbour_weather(s.points, s.weather).drop("q", "r"))


@query("f7_neighbour_outages", rounded(
    ["weather", "points", "outages"],
    _point_oracle(_per_point(_outage_sql(), _NEAR_OUTAGES), feat.NEIGHBOUR_OUTAGE),
    feat.NEIGHBOUR_OUTAGE,
))
def f7_neighbour_outages(s: Source) -> DataFrame:
    return tidy(feat.outage_history(s.points, s.outages).select("cell", "ts", *feat.NEIGHBOUR_OUTAGE))


@query("f8_infrastructure", rounded(
    ["weather", "points", "infra"],
    f"SELECT p.cell, p.ts, {_INFRA_SQL} FROM points p LEFT JOIN infra i ON p.cell = i.cell",
    feat.INFRA,
))
def f8_infrastructure(s: Source) -> DataFrame:
    return tidy(feat.infrastructure(s.points, s.infra).drop("q", "r"))


_CATEGORY_POINTS = _point_oracle(_per_point(_category_sql(), _NEAR_WEATHER), feat.PER_CATEGORY)


@query("f9_cooccurrence", rounded(
    ["weather", "points"],
    f"""SELECT cell, ts, {', '.join(_compound_sql()[:len(CATEGORY_PAIRS) + 2])}
        FROM ({_CATEGORY_POINTS})""",
    [],
))
def f9_cooccurrence(s: Source) -> DataFrame:
    out = feat.with_cooccurrence(feat.per_category(s.points, s.weather))
    return out.select("cell", "ts", *feat.COOCCUR, "compound_event_count", "has_compound_event")


@query("f10_interactions", rounded(
    ["weather", "points"],
    f"SELECT cell, ts, {', '.join(_compound_sql()[len(CATEGORY_PAIRS) + 2:])} FROM ({_CATEGORY_POINTS})",
    feat.MAG_PRODUCTS + feat.DMG_PRODUCTS,
))
def f10_interactions(s: Source) -> DataFrame:
    out = feat.with_interactions(feat.per_category(s.points, s.weather))
    return tidy(out.select("cell", "ts", *feat.MAG_PRODUCTS, *feat.DMG_PRODUCTS))


@query("f11_per_category", rounded(["weather", "points"], _CATEGORY_POINTS, feat.PER_CATEGORY, 3))
def f11_per_category(s: Source) -> DataFrame:
    return tidy(feat.per_category(s.points, s.weather).drop("q", "r"), 3)


@query("f12_event_sequence", rounded(
    ["weather", "points"], _point_oracle(_SEQ_SQL, feat.SEQUENCE), feat.SEQUENCE,
))
def f12_event_sequence(s: Source) -> DataFrame:
    return tidy(feat.event_sequence(s.points, s.weather).drop("q", "r"))


@query("f13_severity_index", rounded(
    ["weather", "points"],
    f"""SELECT cell, ts, {_SEVERITY_SQL} FROM (SELECT cell, ts, {', '.join(_compound_sql())},
        seq_infrastructure_fatigue, seq_escalation_score, seq_storm_count_72h
        FROM (SELECT * FROM ({_CATEGORY_POINTS}) JOIN ({_point_oracle(_SEQ_SQL, feat.SEQUENCE)})
        USING (cell, ts)))""",
    ["compound_severity_index"],
))
def f13_severity_index(s: Source) -> DataFrame:
    return tidy(feat.severity_index(s.points, s.weather).select("cell", "ts", "compound_severity_index"))


@query("f14_vulnerability", rounded(
    ["socio"],
    """SELECT cell, population_density, median_income / 100000.0 AS median_income_normalized,
        least(1.0, housing_age_median / 60.0) AS housing_vulnerability,
        CAST(critical_facilities_count AS DOUBLE) AS critical_facility_density,
        least(1.0, greatest(0.0, 0.30 * least(1.0, population_density / 5000.0)
          + 0.20 * (1.0 - least(1.0, median_income / 100000.0))
          + 0.15 * least(1.0, housing_age_median / 60.0)
          + 0.35 * least(1.0, critical_facilities_count / 10.0))) AS composite_vulnerability_index
        FROM socio""",
    ["population_density", "median_income_normalized", "housing_vulnerability",
     "composite_vulnerability_index"],
))
def f14_vulnerability(s: Source) -> DataFrame:
    return tidy(feat.vulnerability(s.socio).select(
        "cell", "population_density", "median_income_normalized", "housing_vulnerability",
        "critical_facility_density", "composite_vulnerability_index",
    ))


@query("f15_socioeconomic", rounded(
    ["weather", "points", "socio"],
    f"SELECT p.cell, p.ts, {_SOCIO_SQL} FROM points p LEFT JOIN socio c ON p.cell = c.cell",
    feat.SOCIO,
))
def f15_socioeconomic(s: Source) -> DataFrame:
    return tidy(feat.socioeconomic(s.points, s.socio).drop("q", "r"))


def full_features(s: Source, points: DataFrame | None = None) -> DataFrame:
    points = s.points if points is None else points
    return feat.feature_table(points, s.weather, s.outages, s.grid_load, s.infra, s.socio)


def labelled_features(s: Source) -> DataFrame:
    """Features and label of every point. Labels meet the bare points: rows of 138 columns are not shuffled for them."""
    points = s.points
    found = feat.labels(points, s.outages)
    return full_features(s, found).select(
        *points.columns, *feat.FEATURES, *[c for c in found.columns if c not in points.columns])


_DAMAGE = [f"cat_{c}_total_damage" for c in CATEGORIES]
_FULL_ROLES = ["weather", "points", "outages", "grid_load", "infra", "socio"]


@query("f16_feature_vector", rounded(
    _FULL_ROLES,
    f"SELECT * REPLACE ({', '.join(f'round({c}, 3) AS {c}' for c in _DAMAGE)}) FROM ({_FULL_SQL})",
    feat.FEATURES,
))
def f16_feature_vector(s: Source) -> DataFrame:
    out = full_features(s).drop("q", "r")
    return tidy(out.withColumns({c: F.round(c, 3) for c in _DAMAGE}))


@query("f17_outage_label", rounded(
    ["weather", "points", "outages"], _LABEL_SQL, ["target_max_outage_fraction"],
))
def f17_outage_label(s: Source) -> DataFrame:
    return tidy(feat.labels(s.points, s.outages).drop("q", "r"))


# Points at times that are multiples of nothing: each grid point moved by up to six hours, to a microsecond.
_MOVED_US = "(q * 7919 + r * 104729 + 20000003) * 1000003 % 21600000000"
_MOVED_SQL = f"FROM (SELECT cell, q, r, ts + to_microseconds(CAST({_MOVED_US} AS BIGINT)) AS ts FROM points)"


def _moved(sql: str) -> str:
    return sql.replace("FROM points", _MOVED_SQL)


def moved_points(s: Source) -> DataFrame:
    ts = F.timestamp_micros(F.unix_micros(F.col("ts")) + F.expr(_MOVED_US))
    return s.points.withColumn("ts", ts)


@query("f16_any_time", rounded(
    _FULL_ROLES,
    f"SELECT * REPLACE ({', '.join(f'round({c}, 3) AS {c}' for c in _DAMAGE)}) FROM ({_moved(_FULL_SQL)})",
    feat.FEATURES,
))
def f16_any_time(s: Source) -> DataFrame:
    """The full vector of points whose window edges cut slices everywhere."""
    out = feat.feature_table(moved_points(s), s.weather, s.outages, s.grid_load, s.infra, s.socio).drop("q", "r")
    return tidy(out.withColumns({c: F.round(c, 3) for c in _DAMAGE}))


@query("f17_any_time", rounded(
    ["weather", "points", "outages"], _moved(_LABEL_SQL), ["target_max_outage_fraction"],
))
def f17_any_time(s: Source) -> DataFrame:
    return tidy(feat.labels(moved_points(s), s.outages).drop("q", "r"))


@query("f18_point_grid", rounded(["weather", "points"], "SELECT cell, q, r, ts FROM points", []))
def f18_point_grid(s: Source) -> DataFrame:
    return s.points


@query("f19_positive_points", rounded(
    ["weather", "outages"],
    """SELECT DISTINCT cell, q, r, ts FROM (SELECT cell, q, r, date_trunc('day', observed_at)
        + INTERVAL 6 HOUR * CAST(floor(hour(observed_at) / 6) AS INT) AS ts FROM outages) o,
        (SELECT min(event_time) AS lo, max(event_time) AS hi FROM weather) b
        WHERE ts > lo + INTERVAL 72 HOUR AND ts < hi - INTERVAL 24 HOUR""",
    [],
))
def f19_positive_points(s: Source) -> DataFrame:
    return pts.positive_points(s.weather, s.outages)


@query("f19_balanced_points")
def f19_balanced_points(s: Source) -> DataFrame:
    n = s.outages.count()
    return pts.balanced_points(s.weather, s.outages, n)


@query("f19_cells_without_outage", rounded(
    ["weather", "outages"], "SELECT cell FROM weather EXCEPT SELECT cell FROM outages", [],
))
def f19_cells_without_outage(s: Source) -> DataFrame:
    return pts.cells_without_outage(s.weather, s.outages)


def _group_case() -> str:
    whens = " ".join(
        f"WHEN feature_name IN ({', '.join(repr(c) for c in cols)}) THEN '{g}'"
        for g, cols in feat.feature_groups(True).items()
    )
    return f"CASE {whens} END"


def tidy_catalog(rows: DataFrame) -> DataFrame:
    """The catalog as if values were rounded first: a sum that is zero in one engine may be a hair off zero in the
    other. Rounding keeps the order, so only the ends of the range are rounded."""
    found = feat.feature_catalog(rows, tidied_nonzero)
    return tidy(found.withColumns({c: tidied(F.col(c)) for c in ("min_value", "max_value")}), 4)


@query("f20_feature_catalog", rounded(
    _FULL_ROLES,
    f"""SELECT feature_name, {_group_case()} AS feature_group, 'double' AS dtype,
        min(v) AS min_value, max(v) AS max_value,
        avg(CASE WHEN v <> 0 THEN 1.0E0 ELSE 0.0E0 END) AS nonzero_share
        FROM (UNPIVOT (SELECT {', '.join(f'CAST(round({c} + 1e-9, 6) AS DOUBLE) AS {c}' for c in feat.FEATURES)}
          FROM ({_FULL_SQL})) ON {', '.join(feat.FEATURES)} INTO NAME feature_name VALUE v)
        GROUP BY 1""",
    ["min_value", "max_value", "nonzero_share"], 4,
))
def f20_feature_catalog(s: Source) -> DataFrame:
    return tidy_catalog(full_features(s))


@query("f22_store_latest", rounded(
    ["weather", "points", "outages"],
    f"""SELECT cell, ts AS computed_at, 'v1.0' AS feature_version, weather_count_72h,
        lag_outage_24h, target_outage FROM (
        SELECT a.cell, a.ts, a.weather_count_72h, b.lag_outage_24h, c.target_outage,
          row_number() OVER (PARTITION BY a.cell ORDER BY a.ts DESC) AS rn
        FROM ({_point_oracle(_per_point(_rolling_sql(), _NEAR_WEATHER), feat.ROLLING)}) a
        JOIN ({_point_oracle(_per_point(_outage_sql(), _NEAR_OUTAGES), feat.LAGS)}) b USING (cell, ts)
        JOIN ({_LABEL_SQL}) c USING (cell, ts)) WHERE rn = 1""",
    ["lag_outage_24h"],
))
def f22_store_latest(s: Source) -> DataFrame:
    table = labelled_features(s)
    latest = feat.latest_per_cell(feat.to_store(table))
    return tidy(latest.select(
        "cell", "computed_at", "feature_version",
        F.col("features")["weather_count_72h"].alias("weather_count_72h"),
        F.col("features")["lag_outage_24h"].alias("lag_outage_24h"),
        "target_outage",
    ))
