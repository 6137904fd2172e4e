"""Readers on small hand-written files, quality rules, and tables on files."""

from __future__ import annotations

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from gridgale.operators import normalize as norm
from gridgale.operators import quality as q
from gridgale.sources import readers, tables


def test_storm_files_with_different_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text(
        "Begin_Date_Time,Event_Type,Magnitude,Begin_Lat,Begin_Lon,State_Fips,Cz_Fips,Damage_Property,"
        "Injuries_Direct,Injuries_Indirect\n"
        "03-JAN-22 14:30:00, Tornado ,60,30.1,-97.7,48,5,25K,1,2\n"
        "bad,Hail,,0,0,48,5,,,\n"
    )
    (tmp_path / "b.csv").write_text(
        "EVENT_TYPE,BEGIN_DATE_TIME,STATE_FIPS,BEGIN_LAT,BEGIN_LON\n"
        "Hail,2022-01-05 10:00:00,6,37.1,-121.9\nHail,2023-01-05 10:00:00,48,30.0,-97.0\n"
    )
    paths = [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")]
    raw = readers.read_storms(spark, paths)
    assert raw.count() == 4 and raw.filter("BEGIN_DATE_TIME IS NULL").count() == 1
    texas = readers.read_storms(spark, paths, "2022-01-01", "2022-12-31", "TX").collect()
    assert len(texas) == 1 and texas[0]["EVENT_TYPE"] == " Tornado "
    report = q.storm_rules().report(raw).first()
    assert (report["total_records"], report["valid_records"]) == (4, 3)
    row = norm.storms(q.storm_rules().valid(raw)).filter("event_type = 'Tornado'").first()
    assert row["event_time"] == datetime(2022, 1, 3, 14, 30)
    assert (row["damage_property"], row["injuries"], row["deaths"]) == (25000.0, 3, 0)
    assert (row["state_fips"], row["county_fips"]) == ("48", "005")
    assert row["cell_res7"].startswith("7:") and row["cell_res9"].startswith("9:")


def test_one_folder_with_two_headers_and_a_broken_line(spark, tmp_path):
    (tmp_path / "a.csv").write_text(
        'BEGIN_DATE_TIME,EVENT_TYPE,STATE_FIPS,EVENT_NARRATIVE\n2022-01-05 10:00:00,Hail,48,"one\ntwo ""quoted"", three"\n'
    )
    (tmp_path / "b.csv").write_text("STATE_FIPS,EVENT_TYPE,BEGIN_DATE_TIME\n6,Tornado,2022-02-05 10:00:00\n")
    (tmp_path / "c.csv").write_text("STATE_FIPS,EVENT_TYPE,BEGIN_DATE_TIME\n12,Flood,2022-03-05 10:00:00\n")
    (tmp_path / "_SUCCESS").write_text("")
    rows = {r["EVENT_TYPE"]: r for r in readers.read_storms(spark, str(tmp_path)).collect()}
    assert set(rows) == {"Hail", "Tornado", "Flood"}
    assert rows["Hail"]["EVENT_NARRATIVE"] == 'one\ntwo "quoted", three' and rows["Hail"]["STATE_FIPS"] == "48"
    assert rows["Tornado"]["STATE_FIPS"] == "6" and rows["Tornado"]["BEGIN_DATE_TIME"] == datetime(2022, 2, 5, 10)
    assert rows["Flood"]["EVENT_NARRATIVE"] is None
    assert len(readers.files_by_header(spark, [str(tmp_path)])) == 2


def test_upsert_reads_only_touched_months(spark):
    rows = spark.createDataFrame([("2024-01", 1), ("2024-02", 2), (None, 3)], "month string, v int")
    assert sorted(tables.touched_months(rows), key=str) == ["2024-01", "2024-02", None]
    kept = tables.in_months(rows, ["2024-01"]).collect()
    assert [r["v"] for r in kept] == [1]
    assert sorted(r["v"] for r in tables.in_months(rows, ["2024-02", None]).collect()) == [2, 3]


def test_the_plan_lists_touched_months(spark, tmp_path):
    path = str(tmp_path / "t")
    base = spark.range(90).selectExpr("id", "timestampadd(DAY, CAST(id AS INT), TIMESTAMP '2024-01-01') AS at")
    tables.append(base, path, "at")
    found = tables.in_months(spark.read.parquet(path), ["2024-02"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "2024-02" in plan.split("PartitionFilters")[1].split("]")[0]
    assert found.count() == 29


def alert(ident, onset, geometry, **more):
    props = {"id": ident, "event": "Flood Watch", "severity": "Severe", "onset": onset,
             "effective": "2024-01-02T00:00:00+00:00", "affectedZones": ["a", "b"], **more}
    return {"type": "Feature", "properties": props, "geometry": geometry}


def test_alert_geojson(spark, tmp_path):
    square = [[[0, 0], [4, 0], [4, 4], [0, 0]]]
    features = [
        alert("1", "2024-01-03T06:00:00-06:00", {"type": "Point", "coordinates": [-97.5, 30.5]}),
        alert("2", None, {"type": "Polygon", "coordinates": square}),
        alert("3", "2024-03-01T00:00:00+00:00", {"type": "MultiPolygon", "coordinates": [square, square]}),
        alert("4", "2024-01-04T00:00:00+00:00", None, severity=None, event="Tornado Warning"),
    ]
    (tmp_path / "alerts.json").write_text(json.dumps({"type": "FeatureCollection", "features": features}, indent=1))
    rows = {r["alert_id"]: r for r in readers.read_alerts_geojson(spark, str(tmp_path / "alerts.json")).collect()}
    assert rows["1"]["onset"] == datetime(2024, 1, 3, 12) and rows["1"]["affected_zones"] == "a,b"
    assert (rows["1"]["lat"], rows["1"]["lon"]) == (30.5, -97.5)
    assert (rows["2"]["lat"], rows["2"]["lon"]) == (1.0, 2.0)  # closing vertex counted twice
    assert (rows["3"]["lat"], rows["3"]["geometry_type"]) == (1.0, "MultiPolygon")
    assert rows["4"]["lat"] is None and rows["4"]["severity"] == "Unknown"
    kept = readers.read_alerts_geojson(spark, str(tmp_path / "alerts.json"), "2024-01-01", "2024-01-31")
    assert sorted(r["alert_id"] for r in kept.collect()) == ["1", "2", "4"]
    shaped = {r["alert_id"]: r for r in norm.alerts(kept).collect()}
    assert shaped["2"]["event_time"] == datetime(2024, 1, 2) and shaped["1"]["magnitude"] == 75.0
    assert shaped["4"]["magnitude"] == 10.0


def test_station_files(spark, tmp_path):
    (tmp_path / "s.csv").write_text(
        "station,valid(UTC),tmpf,sknt,gust,p01i,drct\nKIAH,2024-01-02 03:00,50.0,10,M,T,180\n"
        "KXXX,2024-01-03 03:00,M,,30,0.1,\nKIAH,2024-02-01 00:00,1,1,1,1,1\nKIAH,2024-01-02 04:00,500,10,M,T,1\n"
    )
    raw = norm.clean_station_rows(readers.read_station_obs(spark, str(tmp_path), "2024-01-01", "2024-01-31"))
    rules = q.station_rules(raw)
    assert rules.report(raw).first()["bad_tmpf"] == 1
    rows = {r["station_id"]: r for r in norm.station_observations(rules.valid(raw)).collect()}
    assert rows["KIAH"]["temperature_c"] == 10.0 and rows["KIAH"]["wind_speed_mph"] == 11.51
    assert rows["KIAH"]["precip_in"] == 0.001 and rows["KIAH"]["lat"] == 29.9844
    assert rows["KXXX"]["magnitude"] == 34.52 and rows["KXXX"]["lat"] is None


def test_outage_and_grid_files(spark, tmp_path):
    (tmp_path / "o.csv").write_text(
        "DateTime,County FIPS,State FIPS,Customers Out,Total Customers\n"
        "2024-01-02 03:00:00,6037,6,50,40\n2024-01-02 04:00:00,48201,48,x,40\n"
    )
    raw = readers.read_outages(spark, str(tmp_path / "o.csv"), region="CA")
    row = norm.outages(q.outage_rules(raw).valid(raw)).first()
    assert (row["county_fips"], row["state_fips"], row["customers_out"], row["outage_fraction"]) == ("06037", "06", 40, 1.0)
    assert row["lat"] == 34.0522 and row["cell_res7"] is not None
    (tmp_path / "g.csv").write_text("Time,Load MW,Frequency Hz\n2024-01-02T03:00:00,50000,60.0\n")
    grid = norm.grid_load(readers.read_grid_load(spark, str(tmp_path / "g.csv"))).first()
    assert grid["reserve_margin_pct"] is None and grid["grid_stress_flag"] == 0
    assert grid["region_code"] == "ERCOT_SYSTEM"


def test_utilities_and_census(spark, tmp_path):
    (tmp_path / "u.csv").write_text("State,utility_id,transmission_line_miles\ntx,7,100\nCA,8,-5\n")
    raw = readers.read_utilities(spark, str(tmp_path / "u.csv"), "TX")
    assert norm.utilities(raw).first()["transmission_line_km"] == pytest.approx(160.934)
    everything = readers.read_utilities(spark, str(tmp_path / "u.csv"))
    assert q.utility_rules(everything).valid(everything).count() == 1
    (tmp_path / "page.json").write_text(json.dumps({"response": {"data": [{"stateid": "TX", "plantid": 3, "period": "2021"}]}}))
    page = readers.read_utility_pages(spark, str(tmp_path / "page.json"), ["stateid", "plantid", "period"])
    row = norm.utilities(page).first()
    assert (row["state_fips"], row["utility_id"], row["data_year"]) == ("48", "3", 2021.0)
    (tmp_path / "census.json").write_text(json.dumps([
        ["NAME", "B01003_001E", "B17001_002E", "B25035_001E", "state", "county"],
        ["Harris", "1777000", "177700", "1990", "48", "201"], ["Nowhere", "10", "1", "2030", "48", "1"],
    ]))
    rows = {r["county_fips"]: r for r in norm.demographics(readers.read_census(spark, str(tmp_path / "census.json"))).collect()}
    assert rows["48201"]["population_density"] == 1000.0 and rows["48201"]["poverty_rate"] == 0.1
    assert rows["48201"]["avg_housing_age_years"] == 30.0 and rows["48001"]["avg_housing_age_years"] == 0.0
    assert rows["48001"]["population_density"] is None


def test_constraints_collect_every_failure(spark):
    df = spark.createDataFrame(
        [(1, "2024-01-01 00:00:00", "nope", "", -1.0), (2, "when", "nws", "Hail", 2.0)],
        "id int, event_time string, source string, event_type string, magnitude double",
    )
    schema = {k: v for k, v in q.TABLE_SCHEMAS["weather_events"].items() if k in df.columns}
    got = q.constraint_rules(df, schema).failures(df, "id").collect()
    assert {(r["id"], r["rule"]) for r in got} == {
        (1, "source|isin"), (1, "event_type|length"), (1, "magnitude|ge(0)"), (2, "event_time|coerce"),
    }


def test_month_tables(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = [(i, datetime(2024, 1 + i % 3, 1 + i % 20, i % 24)) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, at timestamp")
    tables.append(df, path, "at", files_per_month=2)
    got = tables.read_range(spark, path, "at", "2024-02-01", "2024-02-10")
    assert sorted(r["id"] for r in got.collect()) == sorted(
        i for i, t in rows if t.month == 2 and t.day <= 10)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month" in plan
    tables.append_new(df.unionByName(spark.createDataFrame([(99, datetime(2024, 1, 9))], "id int, at timestamp")),
                      path, "at", ["id"], [F.col("at")])
    assert spark.read.parquet(path).count() == 61


def test_ingest_reports_failure_and_success(spark, tmp_path):
    raw = spark.createDataFrame([("06037", 5, 10), ("x", 5, 10)], "county_fips string, customers_out int, total_customers int") \
        .withColumn("observed_at", F.lit(datetime(2024, 1, 1)))
    path = str(tmp_path / "out")
    args = (raw, lambda d: d, q.outage_rules, norm.outages)
    good = q.ingest(*args, lambda d: tables.append(d, path, "observed_at"), "outages")
    assert (good["status"], good["fetched"], good["valid"]) == ("success", 2, 1)
    assert spark.read.parquet(path).count() == 1
    def broken(_):
        raise OSError("disk")
    assert q.ingest(*args, broken, "outages")["status"] == "failed"


def test_staged_files_can_be_removed(spark):
    from gridgale.session import clear_staging, staging_path

    path = staging_path(spark, "gone")
    spark.range(3).write.parquet(path)
    assert tables.exists(spark, path)
    clear_staging(spark)
    assert not tables.exists(spark, path)
