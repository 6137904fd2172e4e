"""Data-quality rules as Column predicates, checked in one pass over the data.

A rule set gives each row its list of failed rules. From that one column come the valid rows, the
long list of failures and the report; nothing is evaluated twice.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridgale.constants import ALERT_TYPES, STATION_RANGES
from gridgale.operators.normalize import geo_valid, number, pad


def held(test: Column) -> Column:
    """A test that is unknown counts as failed."""
    return F.coalesce(test, F.lit(False))


@dataclass(frozen=True)
class RuleSet:
    """``rules`` reject a row when false; ``warnings`` only count valid rows where true."""

    rules: dict[str, Column]
    warnings: dict[str, Column] = field(default_factory=dict)

    def failed(self) -> Column:
        return F.array_compact(F.array(*[
            F.when(~held(test), F.lit(name)) for name, test in self.rules.items()
        ]))

    def check(self, df: DataFrame) -> DataFrame:
        return df.withColumn("failed_rules", self.failed())

    def valid(self, df: DataFrame) -> DataFrame:
        return df.filter(reduce(lambda a, b: a & b, [held(t) for t in self.rules.values()]))

    def failures(self, df: DataFrame, key: str) -> DataFrame:
        """One row per (row key, failed rule)."""
        return self.check(df).select(key, F.explode("failed_rules").alias("rule"))

    def report(self, df: DataFrame) -> DataFrame:
        """One row: totals, drop rate and a count per rule and warning."""
        ok = F.size("failed_rules") == 0
        total, valid = F.count("*"), F.count_if(ok)
        columns = [
            total.alias("total_records"),
            valid.alias("valid_records"),
            (total - valid).alias("invalid_records"),
            F.when(total > 0, (total - valid) / total).otherwise(0.0).alias("drop_rate"),
        ]
        columns += [
            F.count_if(F.array_contains("failed_rules", name)).alias(f"bad_{name}")
            for name in self.rules
        ]
        columns += [
            F.count_if(ok & held(test)).alias(f"warn_{name}") for name, test in self.warnings.items()
        ]
        return self.check(df).agg(*columns)


# --- rules per feed ------------------------------------------------------------------------

def storm_rules() -> RuleSet:
    lat, lon = number(F.col("BEGIN_LAT")), number(F.col("BEGIN_LON"))
    return RuleSet({
        "time": F.col("BEGIN_DATE_TIME").isNotNull(),
        "type": F.col("EVENT_TYPE").isNotNull(),
        "coordinates": geo_valid(lat, lon),
    })


def alert_rules() -> RuleSet:
    return RuleSet(
        {"type": F.length("event_type") > 0, "severity": F.col("severity").isNotNull()},
        {
            "unknown_type": ~F.col("event_type").isin(ALERT_TYPES),
            "no_geometry": F.col("lat").isNull() | F.col("lon").isNull(),
        },
    )


def station_rules(df: DataFrame) -> RuleSet:
    """Rules for the measures the feed has; a missing reading passes."""
    time = "valid" if "valid" in df.columns else "timestamp"
    rules = {"time": F.col(time).isNotNull()}
    for name, (low, high) in STATION_RANGES.items():
        if name in df.columns:
            rules[name] = F.col(name).isNull() | F.col(name).between(low, high)
    station = next((c for c in ("station", "station_id") if c in df.columns), None)
    if station:
        rules["station"] = F.col(station).isNotNull()
    return RuleSet(rules)


def outage_rules(df: DataFrame, time: str = "observed_at") -> RuleSet:
    out, total = F.col("customers_out"), F.col("total_customers")
    rules = {
        "county": pad(F.col("county_fips"), 5).rlike(r"^\d{5}$"),
        "customers_out": out >= 0,
        "total_customers": total > 0,
    }
    if "state_fips" in df.columns:
        rules["state"] = pad(F.col("state_fips"), 2).rlike(r"^\d{2}$")
    if time in df.columns:
        rules["time"] = F.col(time).isNotNull()
    return RuleSet(rules, {"over_total": out > total})


def grid_rules(df: DataFrame) -> RuleSet:
    load, hz = F.col("load_mw"), F.col("frequency_hz")
    rules = {"load": load > 0, "frequency": hz.between(59.5, 60.5)}
    warnings = {"frequency": (hz < 59.9) | (hz > 60.1)}
    if "capacity_mw" in df.columns:
        rules["capacity"] = F.col("capacity_mw") > 0
        warnings["overload"] = load > F.col("capacity_mw")
    return RuleSet(rules, warnings)


UTILITY_MEASURES = [
    "transmission_line_km", "transmission_line_miles", "substations_count",
    "generation_capacity_mw", "total_customers", "peak_demand_mw", "generation",
    "total-consumption-btu",
]


def utility_rules(df: DataFrame) -> RuleSet:
    """No negative measure, and at least one measure known."""
    have = [c for c in UTILITY_MEASURES if c in df.columns]
    values = {c: number(F.col(f"`{c}`")) for c in have}
    rules = {f"negative_{c}": v.isNull() | (v >= 0) for c, v in values.items()}
    known = reduce(lambda a, b: a | b, [v.isNotNull() for v in values.values()], F.lit(False))
    rules["any_measure"] = known
    return RuleSet(rules)


def demographic_rules(df: DataFrame) -> RuleSet:
    people = number(F.col("total_population"))
    rules = {"population": people > 0}
    warnings = {}
    if "county_fips" in df.columns:
        rules["county"] = F.col("county_fips").cast("string").rlike(r"^\d{5}$")
    if "median_household_income" in df.columns:
        warnings["income"] = ~held(number(F.col("median_household_income")) > 0)
    if "population_below_poverty" in df.columns:
        warnings["poverty"] = F.coalesce(number(F.col("population_below_poverty")), F.lit(0.0)) > people
    return RuleSet(rules, warnings)


# --- declarative table constraints ---------------------------------------------------------

Check = tuple[str, Callable[[Column], Column]]


def ge(x) -> Check:
    return f"ge({x})", lambda c: c >= x


def gt(x) -> Check:
    return f"gt({x})", lambda c: c > x


def le(x) -> Check:
    return f"le({x})", lambda c: c <= x


def one_of(*values) -> Check:
    return "isin", lambda c: c.isin(*values)


def matches(pattern: str) -> Check:
    return "matches", lambda c: c.rlike(pattern)


def length(low: int | None = None, high: int | None = None) -> Check:
    def test(c: Column) -> Column:
        out = F.lit(True)
        if low is not None:
            out = out & (F.length(c) >= low)
        if high is not None:
            out = out & (F.length(c) <= high)
        return out

    return "length", test


@dataclass(frozen=True)
class Field:
    kind: str
    nullable: bool = True
    checks: tuple[Check, ...] = ()


def _f(kind: str, nullable: bool = True, *checks: Check) -> Field:
    return Field(kind, nullable, checks)


_LAT = _f("double", True, ge(-90), le(90))
_LON = _f("double", True, ge(-180), le(180))
_POSITIVE = _f("double", True, ge(0))

# Column constraints of the canonical tables. Cell ids are ours, so only their presence as text
# is constrained, not a fixed width.
TABLE_SCHEMAS: dict[str, dict[str, Field]] = {
    "weather_events": {
        "event_time": _f("timestamp", False),
        "source": _f("string", False, one_of("noaa_storms", "nws", "metar")),
        "event_type": _f("string", False, length(1, 200)),
        "magnitude": _POSITIVE,
        "magnitude_type": _f("string"),
        "lat": _LAT, "lon": _LON,
        "state_fips": _f("string", True, matches(r"^\d{2}$")),
        "county_fips": _f("string", True, matches(r"^\d{3,5}$")),
        "damage_property": _POSITIVE, "damage_crops": _POSITIVE,
        "injuries": _f("bigint", True, ge(0)), "deaths": _f("bigint", True, ge(0)),
        "narrative": _f("string", True, length(None, 5000)),
    },
    "outage_observations": {
        "observed_at": _f("timestamp"),
        "county_fips": _f("string", False, matches(r"^\d{5}$")),
        "state_fips": _f("string", False, matches(r"^\d{2}$")),
        "customers_out": _f("bigint", False, ge(0)),
        "total_customers": _f("bigint", False, gt(0)),
        "outage_fraction": _f("double", False, ge(0), le(1)),
        "lat": _LAT, "lon": _LON,
        "source": _f("string", False, one_of("eagle_i")),
    },
    "grid_load": {
        "recorded_at": _f("timestamp"),
        "load_mw": _f("double", False, gt(0)),
        "capacity_mw": _f("double", True, gt(0)),
        "frequency_hz": _f("double", False, ge(59.0), le(61.0)),
        "reserve_margin_pct": _f("double", True, ge(-50), le(100)),
        "region_code": _f("string"),
        "source": _f("string", False, one_of("ercot")),
        "grid_stress_flag": _f("int", True, one_of(0, 1)),
    },
    "infrastructure": {
        "state_fips": _f("string", True, matches(r"^\d{2}$")),
        "county_fips": _f("string", True, matches(r"^\d{5}$")),
        "utility_id": _f("string"),
        "utility_name": _f("string", True, length(None, 500)),
        "transmission_line_km": _POSITIVE, "substations_count": _POSITIVE,
        "generation_capacity_mw": _POSITIVE, "total_customers": _POSITIVE,
        "peak_demand_mw": _POSITIVE,
        "data_year": _f("double", True, ge(1990), le(2030)),
        "source": _f("string", False, one_of("eia")),
    },
    "socioeconomic": {
        "county_fips": _f("string", False, matches(r"^\d{5}$")),
        "state_fips": _f("string", False, matches(r"^\d{2}$")),
        "county_name": _f("string"),
        "total_population": _f("bigint", False, gt(0)),
        "population_density": _POSITIVE,
        "median_household_income": _f("double", True, ge(0), le(500000)),
        "median_year_structure_built": _f("double", True, ge(1800), le(2025)),
        "avg_housing_age_years": _f("double", True, ge(0), le(250)),
        "poverty_rate": _f("double", True, ge(0), le(1)),
        "vacancy_rate": _f("double", True, ge(0), le(1)),
        "median_age": _f("double", True, ge(0), le(100)),
        "source": _f("string", False, one_of("census_acs5")),
        "data_year": _f("int", True, ge(2000), le(2030)),
    },
}


def constraint_rules(df: DataFrame, schema: dict[str, Field]) -> RuleSet:
    """Every constraint as a rule named ``column|check``; columns the schema does not name pass."""
    rules = {}
    for name, spec in schema.items():
        if name not in df.columns:
            rules[f"{name}|column_present"] = F.lit(False)
            continue
        value = F.col(name).try_cast(spec.kind)
        rules[f"{name}|coerce"] = F.col(name).isNull() | value.isNotNull()
        if not spec.nullable:
            rules[f"{name}|not_null"] = F.col(name).isNotNull()
        for check, test in spec.checks:
            rules[f"{name}|{check}"] = value.isNull() | test(value)
    return RuleSet(rules)


def constraint_failures(df: DataFrame, table: str, key: str) -> DataFrame:
    """All failures at once, as (key, column, check)."""
    found = constraint_rules(df, TABLE_SCHEMAS[table]).failures(df, key)
    parts = F.split("rule", r"\|")
    return found.select(key, parts[0].alias("column_name"), parts[1].alias("check_name"))


# --- a whole ingest run ----------------------------------------------------------------------

def ingest(
    raw: DataFrame,
    clean: Callable[[DataFrame], DataFrame],
    rules: Callable[[DataFrame], RuleSet],
    shape: Callable[[DataFrame], DataFrame],
    write: Callable[[DataFrame], None],
    source: str,
) -> dict:
    """Validate, shape and write a feed; the run record holds its counts and status.

    The counts are one aggregate over the columns the rules read. (Observing them during the
    write would save that pass, but a session that has used an observation can no longer ship
    some fitted models to its executors in this Spark version.)
    """
    rows = clean(raw)
    checks = rules(rows)
    started = raw.sparkSession.sql("SELECT current_timestamp() AS t").first()["t"]
    record = {
        "source": source, "status": "failed", "started_at": started, "fetched": None,
        "valid": None, "loaded": 0, "error": None,
    }
    try:
        counts = checks.report(rows).first()
        record["fetched"], record["valid"] = counts["total_records"], counts["valid_records"]
        if not record["valid"]:
            record["status"] = "no_data"
            return record
        write(shape(checks.valid(rows)))
    except Exception as failure:  # the run record reports it; the caller decides
        record["error"] = str(failure)[:500]
        return record
    record["status"], record["loaded"] = "success", record["valid"]
    return record
