"""Insert-ignore and upsert as DataFrame results, and their write to a partitioned table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def last_per_key(updates: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row per key. An aggregate, so repeats of a hot key combine before the shuffle."""
    rest = [c for c in updates.columns if c not in keys]
    newest = updates.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("row"))
    return newest.select(*keys, *[F.col(f"row.{c}").alias(c) for c in rest])


def first_per_key(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    rest = [c for c in rows.columns if c not in keys]
    oldest = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("row"))
    return oldest.select(*keys, *[F.col(f"row.{c}").alias(c) for c in rest])


def insert_ignore(
    target: DataFrame, rows: DataFrame, keys: list[str], order: list[Column]
) -> DataFrame:
    """Rows whose key the target lacks, the first of each key: what an insert would add."""
    return first_per_key(rows, keys, order).join(target.select(*keys), keys, "left_anti")


def upsert(
    target: DataFrame,
    updates: DataFrame,
    keys: list[str],
    update_columns: list[str],
    order: list[Column],
) -> DataFrame:
    """Target after the updates: new keys are added whole; for known keys only
    ``update_columns`` change (to the update's value, null included)."""
    new = last_per_key(updates, keys, order)
    columns = target.columns
    t = target.select(*keys, F.struct(*columns).alias("t"))
    u = new.select(*keys, F.struct(*[F.col(c) for c in columns]).alias("u"))
    both = t.join(u, keys, "full_outer")
    out = []
    for c in columns:
        if c in keys:
            out.append(F.col(c))
        elif c in update_columns:
            out.append(F.when(F.col("u").isNotNull(), F.col(f"u.{c}")).otherwise(F.col(f"t.{c}")).alias(c))
        else:
            out.append(F.when(F.col("t").isNotNull(), F.col(f"t.{c}")).otherwise(F.col(f"u.{c}")).alias(c))
    return both.select(*out)


# Keys and the columns an update may change, per table.
UPSERT_RULES = {
    "outage_observations": (
        ["county_fips", "observed_at"], ["customers_out", "total_customers", "outage_fraction"],
    ),
    "grid_load": (
        ["recorded_at", "region_code"],
        ["load_mw", "capacity_mw", "frequency_hz", "reserve_margin_pct"],
    ),
    "socioeconomic": (
        ["county_fips", "data_year"],
        ["total_population", "population_density", "median_household_income", "poverty_rate",
         "vacancy_rate"],
    ),
}


def infrastructure_rule(df: DataFrame) -> tuple[list[str], list[str]]:
    """Keyed by utility when the feed names it, else by county; all but the source may change."""
    key = ["utility_id" if "utility_id" in df.columns else "county_fips", "data_year"]
    return key, [c for c in df.columns if c not in (*key, "source")]


