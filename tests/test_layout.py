"""Pairs and copies are summed up where they are made: the plans hold no shuffle of them."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from gridgale.functions.hexgrid import disk_offsets
from gridgale.operators import disk
from gridgale.operators.range_join import serving_join


def exchanges(df) -> int:
    plan = df._jdf.queryExecution().executedPlan().toString()
    return sum("Exchange hashpartitioning" in line for line in plan.splitlines())


def unbroadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")


def test_pairs_of_a_serving_join_are_grouped_in_place(spark):
    rng = random.Random(3)
    asked = [(rng.randrange(3), rng.randrange(-400, 400)) for _ in range(60)]
    seen = [(rng.randrange(3), rng.randrange(-500, 500), i) for i in range(80)]
    left = spark.createDataFrame(sorted(set(asked)), "k long, t long")
    right = spark.createDataFrame(seen, "k long, at long, i long")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    unbroadcast(spark)
    try:
        for back, ahead, width in ((50, 0, None), (0, 70, None), (30, 20, 400)):
            found = serving_join(left, right, ["k"], F.col("t"), "at", back, ahead, width)
            per = found.groupBy("k", "bucket", "t").agg(F.sort_array(F.collect_list("i")).alias("i"))
            assert exchanges(per) == 2  # the two sides of the join, not its pairs
            got = {(r.k, r.t): r.i for r in per.collect()}
            want = {}
            for k, t in set(asked):
                near = [i for kk, at, i in seen if kk == k and t - back <= at <= t + ahead]
                if near:
                    want[k, t] = sorted(near)
            assert got == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_copies_for_points_are_made_and_grouped_on_their_tile(spark):
    rng = random.Random(4)
    rows = [(rng.randrange(-20, 20), rng.randrange(-20, 20), rng.randrange(2), rng.randrange(1, 2**19)) for _ in range(120)]
    rows = list({r[:3]: r for r in rows}.values())
    cells = spark.createDataFrame(rows, "nq long, nr long, t long, ring long").withColumn("n", F.lit(1))
    got = disk.to_points(cells, 2).groupBy(*disk.POINT).agg(F.sum("n").alias("n"), F.max("is_self").alias("own"))
    assert exchanges(got) == 1  # cells to tiles; the copies stay there
    want: dict = {}
    for q, r, t, ring in rows:
        for i, (dq, dr) in enumerate(disk_offsets(2)):
            if ring >> i & 1:
                n, own = want.get((q - dq, r - dr, t), (0, False))
                want[q - dq, r - dr, t] = (n + 1, own or (dq, dr) == (0, 0))
    assert {(x.q, x.r, x.t): (x.n, x.own) for x in got.collect()} == want


def test_dimensions_meet_the_bare_points(spark):
    """The last join of the vector brings in the features: rows of 138 columns are not shuffled for a cell's data."""
    from datetime import datetime

    from gridgale.operators import features as feat

    at = datetime(2024, 1, 8)
    points = spark.createDataFrame([(0, 0, 0, at)], "cell long, q long, r long, ts timestamp")
    weather = spark.createDataFrame([(1, at, "Hail", 1.0, 2.0, 0, 0, 0)],
        "event_id long, event_time timestamp, event_type string, magnitude double, damage_property double, cell long, q long, r long")
    outages = spark.createDataFrame([(at, 0, 0, 0, 0.5)], "observed_at timestamp, cell long, q long, r long, outage_fraction double")
    load = spark.createDataFrame([(at, 1.0, 2.0, 3.0)], "recorded_at timestamp, load_mw double, capacity_mw double, reserve_margin_pct double")
    infra = spark.createDataFrame([(0, 1.0, 2.0, 3, 4.0, 5.0)], "cell long, transmission_line_km double, distribution_line_km double, substations_count int, avg_line_age_years double, vegetation_density double")
    socio = spark.createDataFrame([(0, 1.0, 2.0, 3, 4.0)], "cell long, population_density double, median_income double, critical_facilities_count int, housing_age_median double")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    unbroadcast(spark)
    try:
        out = feat.feature_table(points, weather, outages, load, infra, socio)
        joins = [x for x in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join " in x]
        assert "q#" in joins[0] and "cell#" not in joins[0]
        row = out.first()
        assert (row.vegetation_density, row.population_density, row.load_capacity_ratio, row.weather_count_1h) == (5.0, 1.0, 0.5, 1.0)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_exploded_points_are_never_broadcast(spark):
    """Spark takes the rows of an explode for as few as it was made from, here a handful."""
    points = spark.createDataFrame([(0, 0)], "q long, r long").withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(10**9), F.lit(10**7))))
    states = spark.createDataFrame([(0, 0, 5)], "q long, r long, at long")
    found = serving_join(points.withColumn("t", F.col("t").cast("bigint")), states, ["q", "r"], F.col("t"), "at", 10**8)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString() and found.count() == 10


def test_distinct_types_are_copied_as_words(spark):
    """A cell's types go to the points as one mask per 62 types, however many types it saw."""
    from datetime import datetime, timedelta

    at = datetime(2024, 1, 8)
    rng = random.Random(6)
    rows = [(i, at - timedelta(hours=rng.randrange(80)), f"type {i % 130}", i % 3, i % 2) for i in range(400)]
    weather = spark.createDataFrame([*rows, (400, at, None, 0, 0)], "event_id long, event_time timestamp, event_type string, q long, r long")
    points = spark.createDataFrame([(0, 0, at), (40, 40, at)], "q long, r long, ts timestamp")
    found = disk.distinct_type_counts(disk.distinct_points(points), weather, 6 * 3_600_000_000)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    copies = plan[:plan.index("Generate")]  # what happens to the copies made for the points
    assert "word#" in copies and "event_type#" not in copies
    got = [r.asDict() for r in found.collect()]
    assert len(got) == 1 and (got[0]["q"], got[0]["r"]) == (0, 0)
    near = [x for x in rows if (x[3], x[4]) in set(disk_offsets(2))]
    for w in (1, 3, 6, 12, 24, 48, 72):
        want = len({x[2] for x in near if at - x[1] <= timedelta(hours=w)})
        assert got[0][f"weather_distinct_types_{w}h"] == want


def test_catalog_rounds_ends_and_not_rows(spark):
    from gridgale.operators import features as feat
    from gridgale.plans.base import tidy
    from gridgale.plans.features import tidy_catalog

    names = feat.FEATURES[:4]
    rng = random.Random(7)
    edges = [0.0, -0.0, None, 5e-7, 4.99e-7, 4.989999999e-7, -5.01e-7, -5.0101e-7, 4e-7, -1e-9, 1.0000005, 2.4999995, -3.0000015]
    rows = [tuple(rng.choice(edges) for _ in names[:3]) + (None,) for _ in range(60)]
    df = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names))
    for part in (df, df.limit(0), df.filter(f"{names[0]} = 5e-7"), spark.createDataFrame([(5e-7, float("nan"), -5.01e-7, 0.0)], df.schema)):
        got = tidy_catalog(part)
        want = tidy(feat.feature_catalog(tidy(part)), 4)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    plan = tidy_catalog(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "round(" in plan and "round(" not in plan[plan.index("Aggregate"):]


def test_points_of_any_time_are_met_in_place(spark):
    """Only states and points are shuffled: requests, the slices that edges cut, pairs and copies stay where they are."""
    from datetime import datetime, timedelta

    at = datetime(2024, 1, 8, 3, 7, 11, 13)
    rng = random.Random(9)
    weather = spark.createDataFrame(
        [(i, at - timedelta(seconds=rng.randrange(4 * 86400)), "Hail", 1.0, 2.0, rng.randrange(20), rng.randrange(20)) for i in range(200)],
        "event_id long, event_time timestamp, event_type string, magnitude double, damage_property double, q long, r long")
    outages = weather.selectExpr("event_time AS observed_at", "q", "r", "0.1D AS outage_fraction")
    points = disk.distinct_points(spark.createDataFrame([(q, r, at) for q in range(20) for r in range(20)], "q long, r long, ts timestamp"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    unbroadcast(spark)
    try:
        for found in (disk.weather_aggregates(points, weather, 6 * 3_600_000_000, grain=1),
                      disk.outage_aggregates(points, outages, 6 * 3_600_000_000, grain=1)):
            plan = found._jdf.queryExecution().executedPlan().toString()
            assert plan.count("Join") >= 3 and "Exchange" not in plan[:plan.index("Join")]
            # Each join reads what a repartition by tile and bucket has laid out.
            assert "_r_tq" in plan and plan.count("ENSURE_REQUIREMENTS") < plan.count("Exchange")
            assert found.count() > 300
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_wide_rows_are_shuffled_by_no_join(spark):
    from gridgale.plans.base import Source
    from gridgale.plans.features import labelled_features

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    unbroadcast(spark)
    try:
        plan = labelled_features(Source(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().executedPlan().toString()
        third = [i for i in range(len(plan)) if plan.startswith("LeftOuter", i)][2]  # weather, sequence, outages; labels come before
        assert "Exchange" not in plan[:third]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_latest_rows_are_found_before_they_are_grouped(spark, monkeypatch):
    from datetime import datetime, timedelta

    from gridgale.operators import features as feat

    at = datetime(2024, 1, 8)
    rng = random.Random(12)
    rows = [(rng.choice([1, 2, 3, None]), at + timedelta(hours=i) if i % 5 else None, {"a": float(i)}) for i in range(40)]
    rows += [(4, None, {"a": -1.0}), (5, at, {"a": 7.0}), (5, at, {"a": 7.0})]
    store = spark.createDataFrame(rows, "cell long, computed_at timestamp, features map<string, double>")
    found = feat.latest_per_cell(store)
    assert "LeftSemi" in found._jdf.queryExecution().optimizedPlan().toString()
    want = {}
    for cell, time, features in rows:
        if time is not None and (cell not in want or want[cell][0] < time):
            want[cell] = (time, features["a"])
    want[4] = (None, None)
    monkeypatch.setattr(feat, "FEW_CELLS", 0)
    for got in (found, feat.latest_per_cell(store)):
        got = got.collect()
        assert len(got) == 6 and {r.cell: (r.computed_at, r.features and r.features["a"]) for r in got} == want
