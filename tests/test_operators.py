"""Joins, ordering, evaluation, merging, quality and scoring against plain Python."""

from __future__ import annotations

import math
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridgale.functions import hexgrid
from gridgale.functions.clock import HOUR, parse_mixed
from gridgale.functions.weather import category, dollars
from gridgale.operators import analysis as an
from gridgale.operators import dataset as ds
from gridgale.operators import ensemble as en
from gridgale.operators import evaluation as ev
from gridgale.operators import merge, ordering
from gridgale.operators import scoring as sc
from gridgale.operators.range_join import range_join

DAY0 = datetime(2024, 1, 1)


# --- joins and order -----------------------------------------------------------------------

def test_range_join_matches_every_pair_once(spark):
    rng = random.Random(1)
    left = [(i, rng.randrange(3), rng.randrange(1000)) for i in range(60)]
    right = [(i, rng.randrange(3), rng.randrange(1000)) for i in range(200)]
    got = range_join(
        spark.createDataFrame(left, "a long, k long, t long"),
        spark.createDataFrame(right, "b long, k long, at long"),
        ["k"], "at", F.col("t") - 50, F.col("t") + 20, 70,
    ).select("a", "b").collect()
    want = sorted((x[0], y[0]) for x in left for y in right
                  if x[1] == y[1] and x[2] - 50 <= y[2] <= x[2] + 20)
    assert sorted(map(tuple, got)) == want


def test_positions_split_a_hot_value(spark):
    rng = random.Random(2)
    rows = [(0 if rng.random() < 0.4 else rng.randrange(50), i) for i in range(500)]
    df = spark.createDataFrame(rows, "k long, i long")
    got = {r["i"]: r["position"] for r in ordering.numbered(df, ["k", "i"], partitions=5).collect()}
    assert got == {i: p for p, (_, i) in enumerate(sorted(rows))}


def test_running_totals(spark):
    rows = [(i, i % 7) for i in range(300)]
    out, totals = ordering.running_totals(spark.createDataFrame(rows, "k long, v long"), ["k"], ["v"], 6)
    assert totals == {"v": sum(v for _, v in rows)}
    for r in out.collect():
        assert r["v_before"] == sum(v for k, v in rows if k < r["k"])


def test_quantiles(spark):
    values = [random.Random(3).gauss(0, 1) for _ in range(501)] + [0.5] * 200
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    assert ordering.quantiles(df, "v", [0.0, 0.25, 0.5, 0.9, 1.0]) == pytest.approx(
        np.percentile(values, [0, 25, 50, 90, 100])
    )


def test_split_with_one_hot_tick(spark):
    rows = [(DAY0, i) for i in range(60)] + [(DAY0 + timedelta(hours=i), i) for i in range(1, 41)]
    df = spark.createDataFrame(rows, "ts timestamp, cell long")
    got = {(r["ts"], r["cell"]): r["split"] for r in ds.temporal_split(df).collect()}
    for i, key in enumerate(sorted(rows)):
        assert got[key] == ("train" if i < 70 else "val" if i < 85 else "test")


def test_split_puts_unknown_times_last(spark):
    rows = [(DAY0 + timedelta(hours=i), i) for i in range(8)] + [(None, 8), (None, 9)]
    df = spark.createDataFrame(rows, "ts timestamp, cell long")
    got = {r["cell"]: r["split"] for r in ds.temporal_split(df).collect()}
    assert [got[i] for i in range(10)] == ["train"] * 7 + ["val"] + ["test"] * 2
    got = {r["cell"]: r["split"] for r in ds.temporal_split(df, train=0.9, val=0.05).collect()}
    assert got[8] == "train" and got[9] == "test"  # both cuts are int(9.x), on a row without a time


def test_sequences_cross_block_edges(spark, monkeypatch):
    monkeypatch.setattr(ds, "SEQUENCE_BLOCK", 30)
    rows = [(i, float(i), i % 2) for i in range(100)]
    out = ds.sequences(spark.createDataFrame(rows, "i long, x double, y int"), ["x"], "y", ["i"]).collect()
    assert sorted(r["position"] for r in out) == list(range(76))
    for r in out:
        p = r["position"]
        assert [v[0] for v in r["x"]] == [float(j) for j in range(p, p + 24)]
        assert r["target"] == (p + 23) % 2


# --- evaluation ----------------------------------------------------------------------------

def scored(n=400, seed=4):
    rng = np.random.default_rng(seed)
    y = (rng.random(n) < 0.35).astype(int)
    p = np.clip(np.round(0.3 * y + 0.7 * rng.random(n), 2), 0, 1)
    return [(int(a), float(b)) for a, b in zip(y, p, strict=True)]


def plain_auc(rows):
    pos = [p for y, p in rows if y == 1]
    neg = [p for y, p in rows if y == 0]
    return sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))


def plain_ap(rows):
    total, out, before = sum(y for y, _ in rows), 0.0, 0
    for t in sorted({p for _, p in rows}, reverse=True):
        kept = [y for y, p in rows if p >= t]
        out += (sum(kept) - before) / total * sum(kept) / len(kept)
        before = sum(kept)
    return out


def test_ranking_metrics(spark):
    rows = scored()
    got = ev.ranking(spark.createDataFrame(rows, "y int, p double"), "p", "y").first()
    assert got["auc_roc"] == pytest.approx(plain_auc(rows))
    assert got["auc_pr"] == pytest.approx(plain_ap(rows))


def test_metrics_bounds_and_one_class(spark):
    df = spark.createDataFrame(scored(), "y int, p double")
    assert all(0 <= v for v in ev.evaluate(df, "p", "y").values())
    only = ev.ranking(spark.createDataFrame([(0, 0.1), (0, 0.4)], "y int, p double"), "p", "y").first()
    assert only["auc_roc"] is None


def test_calibration_bins(spark):
    edges = [i * (1 / 15) for i in range(16)]
    rows = [(i % 2, min(max(e + d, 0.0), 1.0)) for i, e in enumerate(edges) for d in (-1e-12, 0.0, 1e-12)]
    df = spark.createDataFrame(rows, "y int, p double")
    want = 0.0
    for i in range(15):
        hi = 1.0 if i == 14 else edges[i + 1]
        inside = [(y, p) for y, p in rows if edges[i] <= p < hi or (i == 14 and p == hi)]
        if inside:
            want += abs(sum(y for y, _ in inside) - sum(p for _, p in inside)) / len(rows)
    assert ev.calibration_error(df, "p", "y").first()["ece"] == pytest.approx(want)
    perfect = spark.createDataFrame([(1, 1.0), (0, 0.0)], "y int, p double")
    assert ev.calibration_error(perfect, "p", "y").first()["ece"] == 0


def test_threshold_sweep_first_best(spark):
    rows = scored()
    best = ev.best_threshold(ev.threshold_sweep(spark.createDataFrame(rows, "y int, p double"), "p", "y")).first()
    def f1(t):
        tp = sum(y for y, p in rows if p >= t)
        wrong = sum(1 - y for y, p in rows if p >= t) + sum(y for y, p in rows if p < t)
        return 2 * tp / (2 * tp + wrong) if tp else 0.0
    grid = list(np.arange(0.05, 0.95, 0.01))
    want = max(grid, key=lambda t: (round(f1(t), 12), -t))
    assert best["threshold"] == pytest.approx(want) and best["f1"] == pytest.approx(f1(want))


def test_bootstrap_brackets_the_estimate(spark):
    rows = scored(600)
    df = spark.createDataFrame(rows, "y int, p double")
    got = {r["metric"]: r for r in ev.bootstrap(df, "p", "y", replicates=200, rows_per_task=10).collect()}
    point = ev.evaluate(df, "p", "y")
    assert set(got) == set(ev.METRICS)
    for m in ("auc_roc", "auc_pr", "f1", "brier_score", "log_loss", "precision", "recall"):
        assert got[m]["lower"] <= point[m] <= got[m]["upper"], m
        assert got[m]["lower"] <= got[m]["mean"] <= got[m]["upper"] and got[m]["std"] > 0
    # Draws depend on the rows only, not on how they are dealt to tasks.
    again = {r["metric"]: r for r in ev.bootstrap(df.repartition(5), "p", "y", 200, rows_per_task=37).collect()}
    assert all(got[m]["mean"] == pytest.approx(again[m]["mean"]) for m in got)


def test_mcnemar(spark):
    df = spark.createDataFrame([(1, 0.9, 0.9), (0, 0.1, 0.1)], "y int, a double, b double")
    assert ev.mcnemar(df, "a", "b", "y")["p_value"] == 1.0
    rows = [(1, 0.9, 0.1)] * 30 + [(1, 0.1, 0.9)] * 5
    r = ev.mcnemar(spark.createDataFrame(rows, "y int, a double, b double"), "a", "b", "y")
    assert r["chi2"] == pytest.approx((25 - 1) ** 2 / 35) and r["significant"]


def test_uncertainty(spark):
    rng = np.random.default_rng(7)
    members, mc = rng.random((5, 3)), rng.random((5, 50))
    rows = [(m.tolist(), c.tolist()) for m, c in zip(members, mc, strict=True)]
    df = spark.createDataFrame(rows, "m array<double>, c array<double>")
    for r in en.with_uncertainty(df, F.col("m"), F.col("c"), 0.95).collect():
        e, a = np.std(r["m"]), np.std(r["c"])
        assert r["epistemic"] == pytest.approx(e) and r["aleatoric"] == pytest.approx(a)
        assert r["total_std"] == pytest.approx(math.hypot(e, a))
        raw = 0.6 * np.mean(r["m"]) + 0.4 * np.mean(r["c"])
        assert r["mean"] == pytest.approx(raw)
        assert 0 <= r["ci_lower"] <= r["mean"] <= r["ci_upper"] <= 1
    flat = en.with_uncertainty(df, F.col("m")).first()
    assert flat["aleatoric"] == 0 and flat["confidence_level"] == 0.90


# --- analysis ------------------------------------------------------------------------------

def test_context_rows(spark):
    rng = random.Random(8)
    t0 = datetime(2024, 1, 1)
    rows = [(i, t0 + timedelta(minutes=rng.randrange(0, 60 * 24 * 40))) for i in range(400)]
    marks = [(t0 + timedelta(minutes=rng.randrange(0, 60 * 24 * 40)),) for _ in range(25)]
    got = an.context_rows(
        spark.createDataFrame(rows, "i long, ts timestamp"), spark.createDataFrame(marks, "ts timestamp"), 6
    ).collect()
    span = timedelta(hours=6)
    want = sorted(i for i, t in rows if any(abs(t - m[0]) <= span for m in marks))
    assert sorted(r["i"] for r in got) == want


def test_merged_ranges_are_disjoint(spark):
    marks = [(DAY0 + timedelta(hours=h),) for h in range(0, 2000, 3)]
    ranges = sorted(map(tuple, an.merged_ranges(spark.createDataFrame(marks, "ts timestamp"), 2 * HOUR).collect()))
    assert all(a[1] < b[0] for a, b in zip(ranges, ranges[1:]))


# --- merging -------------------------------------------------------------------------------

def test_upsert_changes_listed_columns_only(spark):
    target = spark.createDataFrame([(1, "a", "x"), (2, "b", "x")], "k int, v string, s string")
    updates = spark.createDataFrame(
        [(2, "c", "y", 1), (2, "d", "y", 2), (3, "e", "y", 1), (1, None, "y", 1)],
        "k int, v string, s string, seq int",
    )
    got = merge.upsert(target, updates, ["k"], ["v"], [F.col("seq")])
    assert sorted(map(tuple, got.collect())) == [(1, None, "x"), (2, "d", "x"), (3, "e", "y")]


def test_insert_ignore_keeps_first(spark):
    target = spark.createDataFrame([(1,)], "k int")
    rows = spark.createDataFrame([(1, 1), (2, 2), (2, 1)], "k int, seq int")
    assert [tuple(r) for r in merge.insert_ignore(target, rows, ["k"], [F.col("seq")]).collect()] == [(2, 1)]


# --- scalars -------------------------------------------------------------------------------

def test_damage(spark):
    cases = {"25K": 25e3, "1.5M": 1.5e6, " 2b ": 2e9, "0": 0, "": 0, "n/a": 0, "100": 100, "1e3": 1000,
             "0.00K": 0, "-5": -5, "1.2.3K": 0, None: 0}
    df = spark.createDataFrame([(k,) for k in cases], "d string")
    for r in df.select("d", dollars(F.col("d")).alias("v")).collect():
        assert r["v"] == cases[r["d"]], r["d"]


def test_categories(spark):
    cases = {"Tornado": "wind", "Sleet": "ice", "Heat": "heat", "Coastal Flood": "flood",
             "Drought": "drought", "Wildfire": "fire", "Hail": None}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r["t"]: r["c"] for r in df.select("t", category(F.col("t")).alias("c")).collect()} == cases


def test_mixed_timestamps(spark):
    want = datetime(2022, 1, 3, 14, 30)
    texts = ["2022-01-03 14:30:00", "2022-01-03T14:30:00", "03-JAN-22 14:30:00", "01/03/2022 14:30"]
    df = spark.createDataFrame([(t,) for t in [*texts, "soon", None]], "t string")
    got = [r["v"] for r in df.select(parse_mixed(F.col("t")).alias("v")).collect()]
    assert got == [want] * len(texts) + [None, None]


def test_hexagons(spark):
    assert [len(hexgrid.disk_offsets(k)) for k in (1, 2)] == [7, 19]
    assert hexgrid.area_km2(7) == 5.161 and hexgrid.area_km2(99) == 5.161
    places = [(30.2672, -97.7431), (0.001, 0.001), (-33.9, 151.2), (64.1, -21.9)]
    df = spark.createDataFrame(places, "lat double, lon double")
    for res, tolerance in ((7, 0.1), (9, 0.01)):
        q, r = hexgrid.locate(F.col("lat"), F.col("lon"), res)
        lat, lon = hexgrid.centroid(q, r, res)
        for row in df.select("lat", "lon", lat.alias("clat"), lon.alias("clon")).collect():
            assert abs(row["lat"] - row["clat"]) < tolerance and abs(row["lon"] - row["clon"]) < tolerance


def test_locate_picks_the_nearest_centre(spark):
    rng = random.Random(9)
    df = spark.createDataFrame([(30 + rng.random(), -97 + rng.random()) for _ in range(200)], "lat double, lon double")
    q, r = hexgrid.locate(F.col("lat"), F.col("lon"), 7)
    near = hexgrid.with_disk(df.select("lat", "lon", q.alias("q"), r.alias("r")), 1)
    lat, lon = hexgrid.centroid(F.col("nq"), F.col("nr"), 7)
    gap = (F.col("lat") - lat) ** 2 + (F.col("lon") - lon) ** 2
    is_self = (F.col("q") == F.col("nq")) & (F.col("r") == F.col("nr"))
    rows = near.select("lat", "lon", is_self.alias("me"), gap.alias("gap")).groupBy("lat", "lon").agg(
        F.min("gap").alias("best"), F.max(F.when(F.col("me"), F.col("gap"))).alias("mine")
    )
    assert rows.filter("mine > best + 1e-12").count() == 0


# --- scoring -------------------------------------------------------------------------------

def test_levels_at_their_bounds(spark):
    df = spark.createDataFrame([(0.25, "TX"), (0.2, "CA"), (0.8, "TX"), (0.75, "FL"), (0.8, "NY"), (0.1, "TX")],
                               "p double, r string")
    got = [x["l"] for x in df.select(sc.risk_level(F.col("p"), F.col("r")).alias("l")).collect()]
    assert got == ["YELLOW", "YELLOW", "RED", "RED", "RED", "GREEN"]
    with pytest.raises(ValueError):
        sc.checked_thresholds((0.5, 0.5, 0.8))


def test_unknown_overrides_are_ignored(spark):
    df = spark.createDataFrame([(1, DAY0)], "id int, ts timestamp")
    row = sc.with_defaults(df, {"weather_count_24h": 5.0, "nonsense": 1.0}).first()
    assert row["weather_count_24h"] == 5.0 and "nonsense" not in row.asDict()
    assert row["avg_line_age_years"] == 20.0


def test_alert_lifetimes(spark):
    df = spark.createDataFrame(
        [(1, "RED"), (2, "ORANGE"), (3, "YELLOW"), (4, "GREEN")], "id int, risk_level string"
    ).withColumns({
        "predicted_at": F.lit(DAY0), "region_code": F.lit("TX"), "cell": F.lit(1),
        "risk_probability": F.lit(0.5), "uncertainty_lower": F.lit(0.4), "uncertainty_upper": F.lit(0.6),
    })
    rows = {r["id"]: r for r in sc.alerts_from(df, F.col("predicted_at")).collect()}
    assert set(rows) == {1, 2, 3}
    assert [(rows[i]["expires_at"] - DAY0).total_seconds() / 3600 for i in (1, 2, 3)] == [12, 24, 48]
    assert [len(rows[i]["recommended_actions"]) for i in (1, 2, 3)] == [6, 5, 4]
