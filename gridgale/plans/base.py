"""Registry of named queries, and the role tables they share.

A role table (weather events, outages, points, ...) is a view over the given parquet tables. Its
SQL text runs unchanged in Spark and in the checking engine, so both sides start from equal rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridgale.functions.clock import HOUR
from gridgale.operators.points import TICK, point_grid, time_span
from gridgale.session import prepare

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]

# Role tables as SQL; {name} stands for a base table or another role.
ROLES: dict[str, str] = {
    "weather": """
        SELECT event_id, CAST(ts AS TIMESTAMP) AS event_time,
          CASE event_id % 12 WHEN 0 THEN 'Thunderstorm Wind' WHEN 1 THEN 'High Wind'
            WHEN 2 THEN 'Heavy Snow' WHEN 3 THEN 'Ice Storm' WHEN 4 THEN 'Winter Storm'
            WHEN 5 THEN 'Tornado' WHEN 6 THEN 'Hail' WHEN 7 THEN 'Flash Flood' WHEN 8 THEN 'Heat'
            WHEN 9 THEN 'Excessive Heat' WHEN 10 THEN 'Drought' ELSE 'Wildfire' END AS event_type,
          value AS magnitude, value * 1000 * (event_id % 7) AS damage_property,
          user_id AS cell, user_id % 32 AS q, CAST(floor(user_id / 32) AS BIGINT) AS r,
          CASE user_id % 3 WHEN 0 THEN '48' WHEN 1 THEN '06' ELSE '12' END AS state_fips
        FROM {events} WHERE event_type <> 'error'""",
    "outages": """
        SELECT event_id, CAST(ts AS TIMESTAMP) AS observed_at, user_id AS cell, user_id % 32 AS q,
          CAST(floor(user_id / 32) AS BIGINT) AS r, least(1.0, value / 500.0) AS outage_fraction
        FROM {events} WHERE event_type = 'error'""",
    "grid_load": """
        SELECT date_trunc('hour', CAST(ts AS TIMESTAMP)) AS recorded_at, 'ALL' AS region_code,
          40000 + 10 * sum(value) AS load_mw, CAST(85000 AS DOUBLE) AS capacity_mw,
          (45000 - 10 * sum(value)) / 85000 * 100 AS reserve_margin_pct
        FROM {events} GROUP BY date_trunc('hour', CAST(ts AS TIMESTAMP))""",
    "infra": """
        SELECT s_suppkey AS cell, CAST(s_suppkey % 50 AS DOUBLE) AS transmission_line_km,
          CAST(s_suppkey % 90 AS DOUBLE) AS distribution_line_km,
          s_suppkey % 6 AS substations_count,
          CASE WHEN s_suppkey % 9 = 0 THEN NULL ELSE CAST(s_suppkey % 80 AS DOUBLE) END
            AS avg_line_age_years,
          CAST(s_nationkey AS DOUBLE) / 25 AS vegetation_density FROM {supplier}""",
    "socio": """
        SELECT c_custkey AS cell, abs(c_acctbal) AS population_density,
          20000 + abs(c_acctbal) * 12 AS median_income,
          c_custkey % 14 AS critical_facilities_count,
          CAST(c_custkey % 75 AS DOUBLE) AS housing_age_median
        FROM {customer} WHERE c_custkey % 10 <> 3""",
    "scores": """
        SELECT l_orderkey, l_linenumber, CAST(l_shipdate AS TIMESTAMP) AS ts,
          CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y,
          l_discount * 10 AS p_a, l_quantity / 50 AS p_b FROM {lineitem}""",
    "member_scores": "SELECT vec_id AS id, label, embedding AS mc FROM {embeddings}",
    "predictions": """
        SELECT event_id AS id, CAST(ts AS TIMESTAMP) AS predicted_at, user_id AS cell,
          CASE user_id % 3 WHEN 0 THEN 'TX' WHEN 1 THEN 'CA' ELSE 'FL' END AS region_code,
          CASE event_id % 2 WHEN 0 THEN 'v0' ELSE 'v1' END AS model_version,
          least(1.0, value / 200.0) AS risk_probability,
          greatest(0.0, least(1.0, value / 200.0) - 0.1) AS uncertainty_lower,
          least(1.0, value / 200.0 + 0.1) AS uncertainty_upper FROM {events}""",
    "alerts": """
        SELECT id, predicted_at AS created_at,
          CASE WHEN id % 4 = 0 THEN NULL ELSE predicted_at + INTERVAL '24' HOUR END AS expires_at,
          region_code, cell, risk_probability,
          CASE WHEN risk_probability >= 0.8 THEN 'RED' WHEN risk_probability >= 0.55 THEN 'ORANGE'
            ELSE 'YELLOW' END AS severity,
          id % 5 = 0 AS acknowledged FROM {predictions} WHERE risk_probability >= 0.25""",
    "raw_outages": """
        SELECT event_id, CAST(ts AS TIMESTAMP) AS timestamp_raw,
          CASE WHEN event_id % 13 = 0 THEN 'X' ELSE CAST(6000 + user_id AS STRING) END AS county_fips,
          CASE WHEN event_id % 7 = 0 THEN -1 ELSE CAST(floor(value * 10) AS BIGINT) END
            AS customers_out,
          CASE WHEN event_id % 11 = 0 THEN 0 ELSE 1000 END AS total_customers
        FROM {events} WHERE event_type = 'error'""",
    "raw_grid": """
        SELECT event_id, CAST(ts AS TIMESTAMP) AS recorded_at, 20000 + value * 300 AS load_mw,
          CASE WHEN event_id % 17 = 0 THEN NULL ELSE CAST(85000 AS DOUBLE) END AS capacity_mw,
          59.4 + CAST(event_id % 13 AS DOUBLE) / 10 AS frequency_hz FROM {events}""",
    "geo": """
        SELECT event_id, CASE WHEN event_id % 29 = 0 THEN NULL WHEN event_id % 31 = 0 THEN 0.0E0
            WHEN event_id % 37 = 0 THEN 95.0E0 ELSE 25 + (event_id % 997) * 0.01E0 END AS lat,
          CASE WHEN event_id % 31 = 0 THEN 0.0E0 WHEN event_id % 41 = 0 THEN -181.0E0
            ELSE -125 + (event_id % 5003) * 0.011E0 END AS lon FROM {events}""",
    "raw_storms": """
        SELECT e.event_id, CASE WHEN e.event_id % 19 = 0 THEN NULL ELSE CAST(e.ts AS TIMESTAMP) END
            AS begin_date_time,
          CASE WHEN e.event_id % 23 = 0 THEN NULL WHEN e.event_id % 3 = 0 THEN ' Tornado '
            WHEN e.event_id % 3 = 1 THEN 'Hail' ELSE 'High Wind' END AS event_type,
          CASE WHEN e.event_id % 17 = 0 THEN 'n/a' ELSE CAST(e.value AS STRING) END AS magnitude,
          CASE e.event_id % 6 WHEN 0 THEN '25K' WHEN 1 THEN '1.5M' WHEN 2 THEN '0' WHEN 3 THEN '2B'
            WHEN 4 THEN '300' ELSE NULL END AS damage_property,
          '1K' AS damage_crops,
          CAST(e.event_id % 4 AS STRING) AS injuries_direct,
          CAST(e.event_id % 3 AS STRING) AS injuries_indirect,
          CAST(e.event_id % 2 AS STRING) AS deaths_direct, CAST(NULL AS STRING) AS deaths_indirect,
          CASE e.user_id % 3 WHEN 0 THEN '48' WHEN 1 THEN '6' ELSE '12' END AS state_fips,
          CAST(e.user_id % 400 AS STRING) AS cz_fips, g.lat AS begin_lat, g.lon AS begin_lon
        FROM {events} e JOIN {geo} g ON e.event_id = g.event_id""",
    "raw_alerts": """
        SELECT doc_id AS alert_id,
          CASE WHEN doc_id % 11 = 0 THEN '' WHEN doc_id % 3 = 0 THEN 'Tornado Warning'
            WHEN doc_id % 3 = 1 THEN 'Flood Watch' ELSE 'Volcano Statement' END AS event_type,
          CASE doc_id % 7 WHEN 0 THEN 'Extreme' WHEN 1 THEN 'Severe' WHEN 2 THEN 'Moderate'
            WHEN 3 THEN 'Minor' WHEN 4 THEN 'Unknown' WHEN 5 THEN 'Other' ELSE NULL END AS severity,
          'Likely' AS certainty, 'Expected' AS urgency, lang AS headline, text AS description,
          source AS area_desc,
          CASE WHEN doc_id % 5 = 0 THEN NULL ELSE TIMESTAMP '2024-01-01 00:00:00'
            + INTERVAL '1' HOUR * CAST(doc_id AS INT) END AS onset,
          TIMESTAMP '2024-01-02 00:00:00' + INTERVAL '1' HOUR * CAST(doc_id AS INT) AS effective,
          TIMESTAMP '2024-01-03 00:00:00' + INTERVAL '1' HOUR * CAST(doc_id AS INT) AS expires,
          CASE WHEN doc_id % 4 = 0 THEN NULL ELSE 25 + (doc_id % 97) * 0.1E0 END AS lat,
          -100 + (doc_id % 89) * 0.1E0 AS lon FROM {documents}""",
    "raw_station": """
        SELECT event_id, CAST(ts AS TIMESTAMP) AS valid,
          CASE event_id % 4 WHEN 0 THEN 'KIAH' WHEN 1 THEN 'KLAX' WHEN 2 THEN 'KMIA' ELSE 'KXXX' END
            AS station,
          CASE WHEN event_id % 9 = 0 THEN 'M' ELSE CAST(value - 20 AS STRING) END AS tmpf,
          CASE WHEN event_id % 8 = 0 THEN '' ELSE CAST(value / 4 AS STRING) END AS sknt,
          CASE WHEN event_id % 3 = 0 THEN 'M' ELSE CAST(value / 2 AS STRING) END AS gust,
          CASE WHEN event_id % 5 = 0 THEN 'T' ELSE CAST(value / 20 AS STRING) END AS p01i,
          CAST(event_id % 110 AS STRING) AS relh FROM {events}""",
    "raw_utilities": """
        SELECT s_suppkey AS id, CAST(s_suppkey % 900 AS STRING) AS county_fips,
          CASE WHEN s_suppkey % 2 = 0 THEN CAST(s_suppkey AS STRING) ELSE NULL END AS utility_id,
          s_name AS utility_name,
          CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE CAST(s_acctbal AS STRING) END
            AS transmission_line_miles,
          CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE CAST(s_suppkey % 6 AS STRING) END
            AS substations_count,
          CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE '10.5' END AS generation,
          CASE WHEN s_suppkey % 5 = 0 THEN '2021' ELSE 'n/a' END AS period FROM {supplier}""",
    "raw_census": """
        SELECT c_custkey AS id, c_name AS NAME,
          CASE c_custkey % 8 WHEN 0 THEN '48201' WHEN 1 THEN '06037' WHEN 2 THEN '12086'
            WHEN 3 THEN '48113' WHEN 4 THEN 'bad' ELSE CAST(10000 + c_custkey AS STRING) END
            AS county_fips,
          CAST(CAST(floor(c_acctbal) AS BIGINT) AS STRING) AS total_population,
          CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE CAST(40000 + c_custkey AS STRING) END
            AS median_household_income,
          CAST(1940 + c_custkey % 100 AS STRING) AS median_year_structure_built,
          CAST(c_custkey % 50 * 10 AS STRING) AS total_housing_units,
          CAST(c_custkey % 50 AS STRING) AS vacant_housing_units,
          CAST(c_custkey % 700 AS STRING) AS population_below_poverty FROM {customer}""",
    "damage_strings": """
        SELECT p_partkey AS id, CASE p_partkey % 8 WHEN 0 THEN '25K' WHEN 1 THEN '1.5M'
          WHEN 2 THEN '0' WHEN 3 THEN ' 2b ' WHEN 4 THEN '' WHEN 5 THEN 'n/a' WHEN 6 THEN '100'
          ELSE NULL END AS damage FROM {part}""",
    "model_registry": """
        SELECT p_partkey AS id,
          CASE p_partkey % 3 WHEN 0 THEN 'gbt_a' WHEN 1 THEN 'gbt_b' ELSE 'logit' END AS model_name,
          concat('v', CAST(p_partkey AS STRING)) AS version,
          CASE p_partkey % 2 WHEN 0 THEN 'TX' ELSE 'CA' END AS region_code,
          p_retailprice / 10000 AS auc, p_partkey % 10 = 0 AS is_active,
          TIMESTAMP '2024-01-01 00:00:00' + INTERVAL '1' HOUR * CAST(p_partkey AS INT) AS created_at
        FROM {part}""",
}

GRID_STEP = "6 hours"

# The grid of points is exploded natively in Spark; this is its text for the checking engine.
ORACLE_ONLY = {
    "points": """
        SELECT c.cell, c.q, c.r, t.ts FROM (SELECT DISTINCT cell, q, r FROM weather) c
        CROSS JOIN (SELECT unnest(generate_series(
          time_bucket(INTERVAL 6 HOUR, min(event_time) + INTERVAL 72 HOUR - INTERVAL 1 MICROSECOND, TIMESTAMP '1970-01-01')
            + INTERVAL 6 HOUR,
          time_bucket(INTERVAL 6 HOUR, max(event_time) - INTERVAL 24 HOUR, TIMESTAMP '1970-01-01'),
          INTERVAL 6 HOUR)) AS ts FROM weather) t""",
}
DEPENDS = {"alerts": ["predictions"], "points": ["weather"], "raw_storms": ["geo"]}


class Source:
    """Base and role tables of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = prepare(spark)
        self.dir = sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def _grid(self) -> tuple[str, str]:
        """First and last tick with 72 h of history and 24 h of future in the data: one row to the driver."""
        if "_ticks" not in self.__dict__:
            lo, hi = time_span(self.weather)
            first, last = -((lo + 72 * HOUR) // -TICK) * TICK, (hi - 24 * HOUR) // TICK * TICK
            self._ticks = tuple(
                datetime.fromtimestamp(t // 1_000_000, timezone.utc).strftime("%Y-%m-%d %H:%M:%S") for t in (first, last)
            )
        return self._ticks

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.table(name)
        if name == "points":
            cells = self.weather.select("cell", "q", "r").distinct()
            start, end = self._grid()
            return point_grid(cells, start=start, end=end, step=GRID_STEP)
        if name in ROLES:
            text = ROLES[name]
            used = {n: getattr(self, n) for n in [*TABLES, *ROLES] if "{%s}" % n in text}
            return self.spark.sql(text, **used)
        raise AttributeError(name)


def with_roles(*names: str) -> str:
    """``WITH`` clause that defines role tables (and what they need) for the checking engine."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for needed in DEPENDS.get(name, []):
            add(needed)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        add(name)
    parts = []
    for name in ordered:
        text = ORACLE_ONLY.get(name) or ROLES[name]
        for used in [*TABLES, *ROLES]:
            text = text.replace("{%s}" % used, used)
        parts.append(f"{name} AS ({text})")
    return "WITH " + ",\n".join(parts)


NUDGE = 1e-9


def tidied(c: Column, digits: int = 6) -> Column:
    """A double as ``tidy`` rounds it."""
    return F.round(c + F.lit(NUDGE), digits)


def tidied_nonzero(c: Column) -> Column:
    """Whether a double is other than zero once tidied to 6 digits, by a comparison: rounding half up keeps what
    reaches half of the last digit. Null stays null."""
    return F.abs(c + F.lit(NUDGE)) >= 5e-7


def tidy(df: DataFrame, digits: int = 6, **special: int) -> DataFrame:
    """Round doubles so that two engines' summation orders cannot show. The nudge keeps exact
    decimal ties from falling either way."""
    out = []
    for name, kind in df.dtypes:
        if kind in ("double", "float"):
            out.append(tidied(F.col(name), special.get(name, digits)).alias(name))
        else:
            out.append(F.col(name))
    return df.select(*out)


def tidy_sql(names: list[str], digits: int = 6) -> str:
    """The same rounding as a ``REPLACE`` list."""
    return ", ".join(f"round({n} + 1e-9, {digits}) AS {n}" for n in names)


def rounded(roles: list[str], body: str, doubles: list[str], digits: int = 6) -> str:
    """Oracle text: role tables, then ``body`` with the given columns rounded."""
    head = with_roles(*roles) + ",\n" if roles else "WITH "
    replace = f" REPLACE ({tidy_sql(doubles, digits)})" if doubles else ""
    return f"{head}result AS ({body})\nSELECT *{replace} FROM result"


@dataclass(frozen=True)
class Query:
    name: str
    run: Callable[[Source], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None) -> Callable:
    def register(fn: Callable[[Source], DataFrame]) -> Callable[[Source], DataFrame]:
        if name in REGISTRY:
            raise ValueError(f"query {name} registered twice")
        REGISTRY[name] = Query(name, fn, sql)
        return fn

    return register
