"""Exploration, case-study and dashboard queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridgale.constants import CATEGORIES, CATEGORY_PAIRS
from gridgale.functions.clock import HOUR, micros
from gridgale.functions.weather import category
from gridgale.operators.features import COMPOUND_GROUP, feature_groups
from gridgale.operators.ordering import quantiles
from gridgale.operators.points import time_span
from gridgale.operators.range_join import range_join


def top_types(weather: DataFrame, k: int = 10) -> DataFrame:
    return weather.groupBy("event_type").agg(F.count("*").alias("n")).orderBy(
        F.col("n").desc(), "event_type"
    ).limit(k)


def events_per_month(weather: DataFrame) -> DataFrame:
    return weather.groupBy(F.month("event_time").alias("month")).agg(F.count("*").alias("n"))


def daily_categories(weather: DataFrame) -> DataFrame:
    """One row per day with a flag and the damage of each category: bounded by the calendar."""
    cat = category(F.col("event_type"))
    rows = weather.withColumn("cat", cat).filter(F.col("cat").isNotNull())
    return rows.groupBy(F.to_date("event_time").alias("day")).agg(
        *[F.max((F.col("cat") == c).cast("int")).alias(f"has_{c}") for c in CATEGORIES],
        F.sum("damage_property").alias("damage"),
    )


def category_cooccurrence(weather: DataFrame) -> DataFrame:
    """Share of days (in %) on which both categories occur, for all 36 ordered pairs."""
    days = daily_categories(weather)
    wide = days.agg(
        F.count("*").alias("days"),
        *[
            F.sum(F.col(f"has_{a}") * F.col(f"has_{b}")).alias(f"{a}+{b}")
            for a in CATEGORIES for b in CATEGORIES
        ],
    )
    cells = [
        F.struct(
            F.lit(a).alias("category_a"), F.lit(b).alias("category_b"),
            (F.col(f"`{a}+{b}`") * 100.0 / F.col("days")).alias("pct_of_days"),
        )
        for a in CATEGORIES for b in CATEGORIES
    ]
    return wide.select(F.explode(F.array(*cells)).alias("c")).select("c.*")


def damage_by_category_count(weather: DataFrame) -> DataFrame:
    n = reduce(lambda a, b: a + b, [F.col(f"has_{c}") for c in CATEGORIES])
    return daily_categories(weather).groupBy(n.alias("n_categories")).agg(
        F.avg("damage").alias("mean_daily_damage"), F.count("*").alias("days")
    )


def compound_windows(weather: DataFrame, outages: DataFrame) -> DataFrame:
    """Every 48-hour window, 6 hours apart from the first event, with its compound score.

    Windows are unions of 6-hour slots, so events are summed per (slot, cell) before they are
    copied to the eight windows that hold their slot; outages likewise to twelve.
    """
    first, last = time_span(weather)
    slot, wide = 6 * HOUR, 48 * HOUR
    n_windows = max((last - first - wide) // slot + 1, 0)

    def slot_of(t: Column) -> Column:
        return F.floor((micros(t) - F.lit(first)) / F.lit(slot)).cast("bigint")

    def spread(df: DataFrame, slots: int) -> DataFrame:
        lo = F.greatest(F.col("slot") - (slots - 1), F.lit(0).cast("bigint"))
        hi = F.least(F.col("slot"), F.lit(n_windows - 1).cast("bigint"))
        starts = F.when(lo <= hi, F.sequence(lo, hi))
        return df.withColumn("w", F.explode(starts))

    cat = category(F.col("event_type"))
    per_slot = weather.groupBy(slot_of(F.col("event_time")).alias("slot"), "cell").agg(
        F.count("*").alias("n"), F.sum("damage_property").alias("damage"),
        F.max("magnitude").alias("magnitude"),
        *[F.max((cat == c).cast("int")).alias(f"has_{c}") for c in CATEGORIES],
    )
    sums = [
        F.sum("n").alias("n"), F.sum("damage").alias("damage"), F.max("magnitude").alias("magnitude"),
        *[F.max(F.coalesce(f"has_{c}", F.lit(0))).alias(f"has_{c}") for c in CATEGORIES],
    ]
    per_cell = spread(per_slot, 8).groupBy("w", "cell").agg(*sums)
    events = per_cell.groupBy("w").agg(*sums, F.count("*").alias("n_cells")).filter("n >= 3")

    outage_slots = outages.groupBy(slot_of(F.col("observed_at")).alias("slot"), "cell").agg(
        F.count("*").alias("n"), F.sum("outage_fraction").alias("f"), F.max("outage_fraction").alias("x"),
    ).filter("slot >= 0")
    outage_cells = spread(outage_slots, 12).groupBy("w", "cell").agg(
        F.sum("n").alias("n"), F.sum("f").alias("f"), F.max("x").alias("x")
    )
    outage = outage_cells.groupBy("w").agg(
        F.sum("n").alias("n_outage_records"), F.count("*").alias("n_outage_cells"),
        (F.sum("f") / F.sum("n")).alias("mean_outage_fraction"),
        F.max("x").alias("max_outage_fraction"),
    )
    zero = {"n_outage_records": 0, "n_outage_cells": 0, "mean_outage_fraction": 0.0, "max_outage_fraction": 0.0}
    both = events.join(outage, "w", "left").fillna(zero)
    n_cats = reduce(lambda a, b: a + b, [F.col(f"has_{c}") for c in CATEGORIES])
    score = (
        n_cats * 10 + F.col("n_cells") * 2 + F.col("n") + F.log1p("damage")
        + F.col("mean_outage_fraction") * 50 + F.col("max_outage_fraction") * 20
    )
    start = F.timestamp_micros(F.lit(first) + F.col("w") * F.lit(slot))
    return both.select(
        start.alias("start"), (start + F.expr("INTERVAL 48 HOURS")).alias("end"),
        n_cats.cast("bigint").alias("n_categories"), "n_cells", F.col("n").alias("n_events"),
        F.col("damage").alias("total_damage"), F.col("magnitude").alias("max_magnitude"),
        "mean_outage_fraction", "max_outage_fraction", "n_outage_cells", "n_outage_records",
        score.alias("score"),
    )


def densest_window(weather: DataFrame, outages: DataFrame) -> DataFrame:
    """The best window; the earliest of equals."""
    return compound_windows(weather, outages).orderBy(F.round("score", 9).desc(), "start").limit(1)


def within(df: DataFrame, time: str, start, end) -> DataFrame:
    """Rows in the half-open [start, end)."""
    low, high = (F.lit(v).cast("timestamp") for v in (start, end))
    return df.filter((F.col(time) >= low) & (F.col(time) < high))


def type_breakdown(weather: DataFrame) -> DataFrame:
    return weather.groupBy("event_type").agg(
        F.count("*").alias("n"), F.max("magnitude").alias("max_magnitude"),
        F.sum("damage_property").alias("total_damage"),
    )


def category_breakdown(weather: DataFrame) -> DataFrame:
    """Events and distinct cells per category. Cells are de-duplicated map-side first, so a
    category with most of the rows is not counted in one task."""
    rows = weather.withColumn("category", category(F.col("event_type"))).filter("category IS NOT NULL")
    per_cell = rows.groupBy("category", "cell").agg(F.count("*").alias("n"))
    return per_cell.groupBy("category").agg(F.sum("n").alias("n"), F.count("*").alias("cells"))


def active_pairs(weather: DataFrame) -> DataFrame:
    """Pairs ``a+b`` of categories that both occur: from six flags, not a join."""
    cat = category(F.col("event_type"))
    flags = weather.agg(*[F.coalesce(F.max((cat == c).cast("int")), F.lit(0)).alias(c) for c in CATEGORIES])
    pairs = F.array_compact(F.array(*[
        F.when(F.col(a) * F.col(b) == 1, F.lit(f"{a}+{b}")) for a, b in CATEGORY_PAIRS
    ]))
    return flags.select(F.explode(pairs).alias("pair"))


def outage_bins(outages: DataFrame, width: str = "3 hours") -> DataFrame:
    return outages.groupBy(F.window("observed_at", width).alias("w")).agg(
        F.avg("outage_fraction").alias("mean_fraction"),
        F.max("outage_fraction").alias("max_fraction"), F.count("*").alias("n"),
    ).select(F.col("w.start").alias("bin_start"), "mean_fraction", "max_fraction", "n")


def anchors(features: DataFrame) -> DataFrame:
    return features.filter(F.col("has_compound_event") > 0)


def context_rows(features: DataFrame, anchor_times: DataFrame, hours: int = 48) -> DataFrame:
    """Rows within ``hours`` of any anchor time.

    Overlapping anchor ranges are merged into disjoint ones first, so a row meets at most one
    range and the join needs no de-duplication.
    """
    span = hours * HOUR
    ranges = merged_ranges(anchor_times, span)
    rows = features.withColumns({"t": micros(F.col("ts")), "_one": F.lit(1)})
    # A range may be long: it is registered in every bucket it touches.
    found = range_join(
        ranges.withColumn("_one", F.lit(1)), rows, ["_one"], "t", F.col("lo"), F.col("hi"), 2 * span
    )
    return found.select(*features.columns)


def merged_ranges(times: DataFrame, span: int) -> DataFrame:
    """Union of [t - span, t + span] over distinct times, as disjoint (lo, hi)."""
    t = times.select(micros(F.col("ts")).alias("t")).distinct()
    # Blocks of time are chained separately; a chain cut at a block edge only means two adjacent
    # ranges, made disjoint by starting the second after the first ends.
    block = F.floor(F.col("t") / F.lit(64 * span)).cast("bigint")
    w = Window.partitionBy("block").orderBy("t")
    marked = t.withColumn("block", block).withColumn(
        "fresh", (F.col("t") - F.lag("t").over(w) > 2 * span).cast("int")
    )
    chained = marked.withColumn(
        "chain", F.sum(F.coalesce("fresh", F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    )
    ranges = chained.groupBy("block", "chain").agg(
        (F.min("t") - span).alias("lo"), (F.max("t") + span).alias("hi")
    )
    # One row per chain from here: a chain can reach into the next block's first one only.
    edge = ranges.groupBy("block").agg(F.max("hi").alias("prev_hi")).withColumn("block", F.col("block") + 1)
    out = ranges.join(edge, "block", "left")
    return out.select(
        F.greatest(F.col("lo"), F.coalesce(F.col("prev_hi") + 1, F.col("lo"))).alias("lo"), "hi"
    ).filter("lo <= hi")


def column_profile(features: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Mean, max and share of positives per column, for columns that are ever above zero."""
    names = names or [c for c in features.columns if c in set(COMPOUND_GROUP)]
    wide = features.agg(*[
        F.struct(
            F.avg(c).alias("mean"), F.max(c).alias("max"),
            F.avg((F.col(c) > 0).cast("double")).alias("nonzero_pct"),
        ).alias(c) for c in names
    ])
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("s")) for c in names])
    return wide.select(F.explode(rows).alias("e")).select("e.feature", "e.s.*").filter("max > 0")


def contribution_scores(features: DataFrame, importance: DataFrame, names: list[str], k: int = 15) -> DataFrame:
    """Importance times mean magnitude, the k largest."""
    wide = features.agg(*[
        F.struct(
            F.avg(F.abs(F.coalesce(F.col(c), F.lit(0.0)))).alias("size"),
            F.avg(F.coalesce(F.col(c), F.lit(0.0))).alias("mean_value"),
        ).alias(c) for c in names
    ])
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("s")) for c in names])
    long = wide.select(F.explode(rows).alias("e")).select("e.feature", "e.s.*")
    out = long.join(importance, "feature").select(
        "feature", "importance", "mean_value", (F.col("importance") * F.col("size")).alias("contribution")
    )
    return out.orderBy(F.round("contribution", 9).desc(), "feature").limit(k)


def dominant_category(df: DataFrame) -> Column:
    """Category with the largest peak magnitude; the first by name on ties, 'None' when all 0."""
    peak = F.greatest(*[F.col(f"cat_{c}_max_magnitude") for c in CATEGORIES])
    out = F.lit("None")
    for c in reversed(CATEGORIES):
        out = F.when(F.col(f"cat_{c}_max_magnitude") == peak, F.lit(c)).otherwise(out)
    return F.when(peak == 0, "None").otherwise(out)


def dominant_by_label(df: DataFrame, label: str = "target_outage") -> DataFrame:
    kinds = df.select(dominant_category(df).alias("event_type"), F.col(label).alias("label"))
    return kinds.groupBy("event_type").agg(
        F.count_if(F.col("label") == 0).alias("no_outage"), F.count_if(F.col("label") == 1).alias("outage")
    )


def correlations(df: DataFrame, names: list[str]) -> DataFrame:
    """Pearson matrix as (a, b, r) rows: one aggregate row, then columns to rows."""
    wide = df.agg(*[
        F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"{a}|{b}")
        for i, a in enumerate(names) for b in names[i:]
    ])

    def cell(a: str, b: str) -> Column:
        first, second = sorted((a, b), key=names.index)
        return F.col(f"`{first}|{second}`")

    rows = F.array(*[
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), cell(a, b).alias("r"))
        for a in names for b in names
    ])
    return wide.select(F.explode(rows).alias("c")).select("c.*")


def value_histogram(df: DataFrame, column: str, low: float, high: float, bins: int = 50) -> DataFrame:
    """Counts per equal-width bin; the top edge belongs to the last bin."""
    index = F.least(F.floor((F.col(column) - low) / ((high - low) / bins)), F.lit(bins - 1))
    return df.groupBy(index.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def describe(df: DataFrame, names: list[str]) -> DataFrame:
    """count, mean, std, min, exact quartiles and max: one row per column."""
    quartiles = {c: quantiles(df, c, [0.25, 0.5, 0.75]) for c in names}
    wide = df.agg(*[
        F.struct(
            F.count(c).alias("count"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"),
            F.min(c).cast("double").alias("min"), F.max(c).cast("double").alias("max"),
        ).alias(c) for c in names
    ])
    rows = F.array(*[
        F.struct(
            F.lit(c).alias("column_name"), F.col(c).alias("s"),
            *[F.lit(v).cast("double").alias(q) for q, v in zip(("p25", "p50", "p75"), quartiles[c], strict=True)],
        ) for c in names
    ])
    return wide.select(F.explode(rows).alias("e")).select(
        "e.column_name", "e.s.count", "e.s.mean", "e.s.std", "e.s.min", "e.p25", "e.p50", "e.p75",
        "e.s.max",
    )


def importance_by_group(importance: DataFrame, top: int = 20) -> tuple[DataFrame, DataFrame]:
    """Top features with their group, and each group's share of the total importance."""
    of = {c: g for g, cols in feature_groups(True).items() for c in cols}
    lookup = F.create_map(*[F.lit(x) for pair in of.items() for x in pair])
    rows = importance.withColumn(
        "feature_group", F.coalesce(F.try_element_at(lookup, F.col("feature")), F.lit("other"))
    )
    best = rows.orderBy(F.col("importance").desc(), "feature").limit(top)
    per = rows.groupBy("feature_group").agg(F.sum("importance").alias("importance"), F.count("*").alias("n"))
    total = F.sum("importance").over(Window.partitionBy(F.lit(1)))
    return best, per.withColumn("share", F.col("importance") / total)


def dashboard(predictions: DataFrame, alerts: DataFrame, confidence: Column) -> DataFrame:
    """Headline numbers as (kpi, value) rows."""
    p = predictions.agg(
        F.count_if(F.col("risk_level") != "GREEN").cast("double").alias("cells_at_risk"),
        F.avg(confidence).alias("mean_confidence"),
        *[
            F.count_if(F.col("risk_level") == level).cast("double").alias(f"level_{level}")
            for level in ("GREEN", "YELLOW", "ORANGE", "RED")
        ],
    ).unpivot([], None, "kpi", "value")
    a = alerts.agg(F.count_if(~F.col("acknowledged")).cast("double").alias("open_alerts"))
    return p.unionByName(a.unpivot([], None, "kpi", "value"))


def history_kpis(outages: DataFrame) -> DataFrame:
    return outages.agg(
        F.count("*").alias("total_outages"), F.sum("customers_affected").alias("total_customers"),
        F.avg(F.coalesce("duration_minutes", F.lit(0.0))).alias("mean_duration"),
        F.avg(F.col("was_predicted").cast("double")).alias("predicted_share"),
    )
