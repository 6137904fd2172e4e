"""Exact feature values, and a brute-force check on events that sit on window edges."""

from __future__ import annotations

import itertools
import math
import random
from datetime import datetime, timedelta
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from gridgale.constants import CATEGORIES, CATEGORY_TYPES, OUTAGE_LAGS_H, WEATHER_WINDOWS_H
from gridgale.functions.clock import HOUR, MINUTE
from gridgale.functions.hexgrid import disk_offsets
from gridgale.operators import features as feat

TS = datetime(2023, 6, 15, 12)
POINT = "cell long, q long, r long, ts timestamp"
WEATHER = (
    "event_id long, event_time timestamp, event_type string, magnitude double,"
    " damage_property double, cell long, q long, r long"
)
OUTAGE = "event_id long, observed_at timestamp, cell long, q long, r long, outage_fraction double"
LOAD = "recorded_at timestamp, load_mw double, capacity_mw double, reserve_margin_pct double"


def ago(hours: float) -> datetime:
    return TS - timedelta(hours=hours)


def weather(spark, events):
    rows = [
        (i, ago(h), kind, mag, dmg, 0, 0, 0) for i, (h, kind, mag, dmg) in enumerate(events)
    ]
    return spark.createDataFrame(rows, WEATHER)


def outages(spark, rows):
    return spark.createDataFrame([(i, ago(h), 0, 0, 0, f) for i, (h, f) in enumerate(rows)], OUTAGE)


def build(spark, events=(), outs=(), load=(), infra=(), socio=(), ts=TS):
    points = spark.createDataFrame([(0, 0, 0, ts)], POINT)
    row = feat.feature_table(
        points, weather(spark, events), outages(spark, outs), spark.createDataFrame(list(load), LOAD),
        spark.createDataFrame(
            list(infra), "cell long, transmission_line_km double, distribution_line_km double,"
                         " substations_count int, avg_line_age_years double, vegetation_density double"),
        spark.createDataFrame(
            list(socio), "cell long, population_density double, median_income double,"
                         " critical_facilities_count long, housing_age_median double"),
        tick=HOUR,
    ).first()
    return row.asDict()


def test_no_rows_give_zeros(spark):
    row = build(spark)
    constant = {*feat.CYCLES, "neighbor_ring_k"}
    assert all(row[c] == 0.0 for c in feat.FEATURES if c not in constant)
    assert row["neighbor_ring_k"] == 2.0


def test_wind_and_ice(spark):
    row = build(spark, [(1, "High Wind", 50.0, 0.0), (2, "Ice Storm", 30.0, 0.0)])
    assert row["compound_event_count"] == 2 and row["has_compound_event"] == 1
    assert row["cooccur_ice_wind"] == 1 and row["interact_ice_mag_x_wind_mag"] == 1500
    assert 0 <= row["compound_severity_index"] <= 1


def test_event_outside_the_day(spark):
    row = build(spark, [(1, "High Wind", 50.0, 0.0), (30, "Ice Storm", 30.0, 0.0)])
    assert row["compound_event_count"] == 1 and row["has_compound_event"] == 0
    assert row["weather_count_6h"] == 1 and row["weather_count_48h"] == 2


def test_rising_sequence(spark):
    row = build(spark, [(10, "Hail", 20.0, 0.0), (5, "Hail", 50.0, 0.0), (1, "Hail", 80.0, 0.0)])
    assert row["seq_storm_count_72h"] == 3 and row["seq_escalation_score"] == 1.0
    assert row["seq_max_gap_hours"] == 5.0 and row["seq_distinct_types"] == 1.0
    assert row["seq_infrastructure_fatigue"] == pytest.approx((20 * 0.5 + 50 * 0.75 + 80) / 2.25)


def test_single_event(spark):
    row = build(spark, [(1, "High Wind", 50.0, 10000.0)])
    assert row["cat_wind_max_magnitude"] == 50 and row["cat_ice_max_magnitude"] == 0
    assert row["cat_wind_total_damage"] == 10000 and row["seq_max_gap_hours"] == 72
    assert row["seq_infrastructure_fatigue"] == 0


def test_counts_per_window(spark):
    row = build(spark, [(2, "Hail", 1.0, 0.0), (5, "Hail", 1.0, 0.0), (30, "Hail", 1.0, 0.0)])
    assert row["weather_count_6h"] == 2 and row["weather_count_24h"] == 2


def test_outage_lags_and_trend(spark):
    row = build(spark, outs=[(1, 0.05), (24, 0.02)])
    assert row["lag_outage_1h"] == pytest.approx(0.05)
    assert row["lag_outage_24h"] == pytest.approx(0.02)
    assert row["lag_outage_3h"] == row["lag_outage_168h"] == 0.0
    rising = [(6 - i, f) for i, f in enumerate([0.01, 0.02, 0.03, 0.05, 0.08, 0.12])]
    assert build(spark, outs=rising)["trend_outage_6h"] > 0


def test_load_infrastructure_and_people(spark):
    row = build(
        spark, load=[(TS, 60000.0, 80000.0, 25.0)], infra=[(0, 10.0, 5.161, 3, 50.0, 0.4)],
        socio=[(0, 1200.0, 45000.0, 3, 30.0)],
    )
    assert row["load_capacity_ratio"] == 0.75 and row["current_load_mw"] == 60000
    assert row["infrastructure_age_risk"] == 1.0
    assert row["line_density_per_km2"] == pytest.approx(15.161 / 5.161)
    assert row["median_income_normalized"] == 0.45 and row["critical_facility_density"] == 3
    assert build(spark, infra=[(0, 0.0, 0.0, 0, 5.0, 0.0)])["infrastructure_age_risk"] == 0.1


def test_load_looks_an_hour_ahead_unless_told_not_to(spark):
    points = spark.createDataFrame([(0, 0, 0, TS)], POINT)
    load = spark.createDataFrame([(ago(0.5), 1.0, 2.0, 3.0), (ago(-1), 7.0, 0.0, 3.0)], LOAD)
    ahead = feat.grid_load_as_of(points, load).first()
    assert ahead["current_load_mw"] == 7.0 and ahead["load_capacity_ratio"] == 0.0
    assert feat.grid_load_as_of(points, load, leak_safe=True).first()["current_load_mw"] == 1.0


def test_weekend_and_cycles(spark):
    row = build(spark, ts=datetime(2023, 6, 17, 6))  # a Saturday
    assert row["is_weekend"] == 1.0
    assert row["hour_sin"] == pytest.approx(1.0) and row["hour_cos"] == pytest.approx(0.0, abs=1e-12)
    assert row["month_sin"] == pytest.approx(math.sin(2 * math.pi * 5 / 12))


def test_label_edges(spark):
    points = spark.createDataFrame([(0, 0, 0, TS)], POINT)
    for hours_ahead, fraction, expected in ((0, 0.5, 1), (24, 0.5, 1), (24.01, 0.5, 0), (1, 0.01, 0)):
        row = feat.labels(points, outages(spark, [(-hours_ahead, fraction)]), tick=HOUR).first()
        assert row["target_outage"] == expected, (hours_ahead, fraction)
    safe = feat.labels(points, outages(spark, [(0, 0.5)]), tick=HOUR, leak_safe=True).first()
    assert safe["target_outage"] == 0


def test_points_may_have_any_time(spark):
    ts = TS + timedelta(minutes=1, seconds=1)
    points = spark.createDataFrame([(0, 0, 0, ts)], POINT)
    # At both edges of the last hour, a microsecond outside either, and two hours before.
    tiny = 1e-6 / 3600
    late = -61 / 3600
    rows = [(late, "Hail", 1.0, 0.0), (late + 1, "Hail", 2.0, 0.0), (late - tiny, "Hail", 9.0, 0.0), (late + 1 + tiny, "Hail", 4.0, 0.0)]
    for tick in (6 * HOUR, HOUR, MINUTE):
        row = feat.rolling_weather(points, weather(spark, rows), tick=tick).first()
        assert (row["weather_count_1h"], row["weather_max_mag_1h"], row["weather_count_3h"]) == (2, 2.0, 3)


# --- brute force ---------------------------------------------------------------------------

KINDS = ["High Wind", "Ice Storm", "Heat", "Flood", "Drought", "Wildfire", "Hail", "Sleet"]
OF = {t: c for c, ts in CATEGORY_TYPES.items() for t in ts}


def random_world(seed):
    """Events on half-hour marks, so that many fall exactly on window and slice edges."""
    rng = random.Random(seed)
    cells = [(q, r) for q in range(5) for r in range(4)]
    start = TS - timedelta(hours=200)

    def when():
        return start + timedelta(minutes=30 * rng.randrange(0, 480))

    events, seen = [], []
    for i in range(500):
        c = rng.randrange(len(cells))
        # One cell holds a third of everything.
        c = 7 if rng.random() < 0.33 else c
        events.append((i, when(), rng.choice(KINDS), float(rng.randrange(0, 60)),
                       float(rng.randrange(0, 5) * 1000), c, *cells[c]))
    for i in range(300):
        c = 7 if rng.random() < 0.33 else rng.randrange(len(cells))
        seen.append((i, when(), c, *cells[c], rng.randrange(0, 8) / 100.0))
    points = [(c, *cells[c], TS - timedelta(hours=6 * k)) for c in range(len(cells)) for k in range(6)]
    return events, seen, points


def brute(point, events, seen):
    _, q, r, ts = point
    near = {(q + dq, r + dr) for dq, dr in disk_offsets(2)}

    def age(t):
        return Fraction((ts - t) // timedelta(microseconds=1), HOUR)  # exact at the edges

    out = {}
    disk = [(age(e[1]), e) for e in events if (e[6], e[7]) in near]
    for w in WEATHER_WINDOWS_H:
        rows = [e for a, e in disk if 0 <= a <= w]
        mags = [e[3] for e in rows]
        out[f"weather_count_{w}h"] = len(rows)
        out[f"weather_max_mag_{w}h"] = max(mags, default=0)
        out[f"weather_mean_mag_{w}h"] = sum(mags) / len(mags) if mags else 0
        out[f"weather_distinct_types_{w}h"] = len({e[2] for e in rows})
    day = [e for a, e in disk if 0 <= a <= 24]
    for c in CATEGORIES:
        rows = [e for e in day if OF.get(e[2]) == c]
        out[f"cat_{c}_max_magnitude"] = max((e[3] for e in rows), default=0)
        out[f"cat_{c}_total_damage"] = sum(e[4] for e in rows)
        out[f"cat_{c}_event_count"] = len(rows)
    others = [e for e in day if (e[6], e[7]) != (q, r)]
    out["neighbor_weather_count"] = len(others)
    out["neighbor_weather_max_mag"] = max((e[3] for e in others), default=0)

    obs = [(age(o[1]), o) for o in seen if (o[3], o[4]) in near]
    for lag in OUTAGE_LAGS_H:
        f = [o[5] for a, o in obs if abs(a - lag) <= 0.5]
        out[f"lag_outage_{lag}h"] = sum(f) / len(f) if f else 0
    for w in (3, 6, 12):
        late = [o[5] for a, o in obs if 0 <= a <= w / 2]
        early = [o[5] for a, o in obs if w / 2 < a <= w]
        out[f"trend_outage_{w}h"] = (sum(late) / len(late) if late else 0) - (
            sum(early) / len(early) if early else 0)
    around = [o for a, o in obs if 0 <= a <= 24 and (o[3], o[4]) != (q, r)]
    out["neighbor_outage_max"] = max((o[5] for o in around), default=0)
    out["neighbor_outage_spread"] = len({o[2] for o in around if o[5] > 0.01}) / 18

    chain = [e for _, e in sorted((( -a, e[0]), e) for a, e in disk if 0 <= a <= 72)]
    n = len(chain)
    out["seq_storm_count_72h"] = n
    pairs = list(itertools.pairwise(chain))
    out["seq_escalation_score"] = sum(b[3] > a[3] for a, b in pairs) / len(pairs) if pairs else 0
    out["seq_max_gap_hours"] = (
        0 if n == 0 else 72 if n == 1 else max((b[1] - a[1]).total_seconds() / 3600 for a, b in pairs))
    if n > 1:
        weights = [0.5 + 0.5 * i / (n - 1) for i in range(n)]
        out["seq_infrastructure_fatigue"] = sum(w * e[3] for w, e in zip(weights, chain)) / sum(weights)
    else:
        out["seq_infrastructure_fatigue"] = 0
    half = n // 2
    out["seq_damage_acceleration"] = 0 if n < 3 else (
        math.log1p(sum(e[4] for e in chain[half:]) / (n - half))
        - math.log1p(sum(e[4] for e in chain[:half]) / half))
    return out


def ragged(world):
    """The same world with points at any microsecond, and some events exactly on their edges or just beside."""
    events, seen, points = world
    rng = random.Random(9)
    points = [(c, q, r, t + timedelta(microseconds=rng.randrange(6 * HOUR))) for c, q, r, t in points]

    def at_an_edge(hours):
        return rng.choice(points)[3] - timedelta(hours=rng.choice(hours), microseconds=rng.choice([-1, 0, 0, 1]))

    events = [(*e[:1], at_an_edge((0, *WEATHER_WINDOWS_H)) if e[0] % 3 == 0 else e[1], *e[2:]) for e in events]
    seen = [(*o[:1], at_an_edge((0, 0.5, 1.5, 3, 6, 12, 24, 23.5, 167.5, 168.5)) if o[0] % 3 == 0 else o[1], *o[2:]) for o in seen]
    return events, seen, points


@pytest.mark.parametrize("tick,any_time", [(6 * HOUR, False), (HOUR, False), (30 * MINUTE, False), (6 * HOUR, True), (30 * MINUTE, True)])
def test_against_brute_force(spark, tick, any_time):
    events, seen, points = random_world(tick)
    if any_time:
        events, seen, points = ragged((events, seen, points))
    found = feat.feature_table(
        spark.createDataFrame(points, POINT), spark.createDataFrame(events, WEATHER),
        spark.createDataFrame(seen, OUTAGE), spark.createDataFrame([], LOAD),
        spark.createDataFrame([], "cell long, transmission_line_km double, distribution_line_km double,"
                                  " substations_count int, avg_line_age_years double, vegetation_density double"),
        spark.createDataFrame([], "cell long, population_density double, median_income double,"
                                  " critical_facilities_count long, housing_age_median double"),
        tick=tick,
    )
    rows = {(r["cell"], r["ts"]): r for r in found.collect()}
    assert len(rows) == len(points)
    for point in points:
        row = rows[(point[0], point[3])]
        for name, value in brute(point, events, seen).items():
            assert row[name] == pytest.approx(value, abs=1e-9), (point, name)


def test_narrow_slices_and_big_vocabulary_agree(spark):
    from gridgale.operators import disk
    from gridgale.operators.sequence import sequence_features

    events, _, points = random_world(3)
    w, p = spark.createDataFrame(events, WEATHER), spark.createDataFrame(points, POINT)
    keys = disk.distinct_points(p)
    wide = sequence_features(keys, w, 6 * HOUR)
    narrow = sequence_features(keys, w, 6 * HOUR, slice_width=HOUR)
    as_rows = lambda df: sorted(tuple(round(v, 9) for v in r) for r in df.collect())
    assert as_rows(wide) == as_rows(narrow)

    names = [f"weather_distinct_types_{h}h" for h in WEATHER_WINDOWS_H]
    masks = disk.weather_aggregates(keys, w, 6 * HOUR).select("q", "r", "t", *names)
    any_size = disk.distinct_type_counts(keys, w, 6 * HOUR).select("q", "r", "t", *names)
    assert as_rows(masks) == as_rows(any_size)
    # More types than one mask holds.
    many = w.withColumn("event_type", F.concat("event_type", F.col("event_id").cast("string")))
    masks = disk.weather_aggregates(keys, many, 6 * HOUR).select("q", "r", "t", *names)
    any_size = disk.distinct_type_counts(keys, many, 6 * HOUR).select("q", "r", "t", *names)
    assert as_rows(masks) == as_rows(any_size)


def test_full_plan_has_no_nested_loops(spark):
    events, seen, points = random_world(1)
    df = feat.rolling_weather(spark.createDataFrame(points, POINT), spark.createDataFrame(events, WEATHER))
    df = feat.attach(df.select("cell", "q", "r", "ts"), df.select(
        "q", "r", F.unix_micros("ts").alias("t"), "weather_count_24h"), ["weather_count_24h"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_balanced_points(spark):
    from gridgale.operators.points import balanced_points

    events, seen, _ = random_world(5)
    w, o = spark.createDataFrame(events, WEATHER), spark.createDataFrame(seen, OUTAGE)
    first = sorted(map(tuple, balanced_points(w, o, 90).collect()))
    again = sorted(map(tuple, balanced_points(w.repartition(3), o.repartition(2), 90).collect()))
    assert first == again and len(first) == 90
    assert 0 < sum(r[4] == "positive" for r in first) <= 30
    assert all(r[3].hour % 6 == 0 and r[3].minute == 0 for r in first)


def test_history_outside_the_reach_is_not_read(spark, tmp_path):
    at = "TIMESTAMP '2024-01-01' + make_interval(0, 0, 0, CAST(id AS INT))"
    spark.range(400).selectExpr(
        "id AS event_id", f"{at} AS event_time", "0L AS q", "0L AS r", "'Hail' AS event_type", "1.0D AS magnitude",
        "0.0D AS damage_property",
    ).write.parquet(str(tmp_path / "w"))
    points = spark.sql("SELECT 0L AS cell, 0L AS q, 0L AS r, TIMESTAMP '2024-06-01 06:00:00' AS ts")
    weather = spark.read.parquet(str(tmp_path / "w"))
    for out in (feat.rolling_weather(points, weather), feat.event_sequence(points, weather)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        scans = [line for line in plan.split("\n") if "FileScan" in line]
        assert scans and all("GreaterThanOrEqual(event_time,2024-05-29" in line for line in scans)
        assert out.count() == 1
