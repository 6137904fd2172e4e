"""Stateful streaming against a plain replay."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pandas as pd

from gridgale.constants import ALERT_TTL_HOURS
from gridgale.streaming import jobs, lifecycle
from gridgale.streaming.lifecycle import alert_lifecycle

SCHEMA = "region_code string, cell long, event_time timestamp, kind string, severity string, alert_id long"
T0 = datetime(2024, 1, 1)


def replay(rows):
    """The lifecycle of every (region, cell), event by event."""
    out, last = [], max(r[2] for r in rows)
    acks = {(r[0], r[1], r[5]): r[2] for r in rows if r[3] == "ack"}
    for r in rows:
        if r[3] == "ack":
            continue
        key = (r[0], r[1], r[5])
        out.append((*key, r[2], "created", r[4]))
        expiry = r[2] + timedelta(hours=ALERT_TTL_HOURS[r[4]])
        if key in acks and acks[key] < expiry:
            out.append((*key, acks[key], "acknowledged", r[4]))
        # The watermark trails the newest event by an hour; an expiry before it has fired.
        elif expiry < last - timedelta(hours=1):
            out.append((*key, expiry, "expired", r[4]))
    return sorted(out)


def test_alert_lifecycle(spark, tmp_path):
    rng = random.Random(6)
    rows = []
    for i in range(400):
        cell = 1 if rng.random() < 0.33 else rng.randrange(2, 12)
        at, level = T0 + timedelta(minutes=30 * i), rng.choice(list(ALERT_TTL_HOURS))
        rows.append(("TX", cell, at, "raise", level, i))
        if rng.random() < 0.4:  # some acknowledge too late
            rows.append(("TX", cell, at + timedelta(hours=rng.randrange(1, 60)), "ack", None, i))
    rows.append(("TX", 3, T0, "ack", None, 10_000))  # names no alert
    rows.sort(key=lambda r: r[2])
    path = str(tmp_path / "in")
    for k in range(0, len(rows), 120):
        spark.createDataFrame(rows[k:k + 120], SCHEMA).coalesce(1).write.mode("append").parquet(path)
    stream = jobs.file_stream(spark, path, spark.createDataFrame([], SCHEMA).schema, files_per_batch=1)
    jobs.drain(jobs.to_files(alert_lifecycle(stream), str(tmp_path / "out"), str(tmp_path / "cp")))
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()))
    assert got == replay(rows)


class HeldState:
    """A group's state as the lifecycle uses it."""

    def __init__(self, now, held=None, timed_out=False):
        self.now, self.get, self.exists, self.hasTimedOut, self.timer = now, held, held is not None, timed_out, None

    def getCurrentWatermarkMs(self):
        return self.now

    def update(self, held):
        self.get = held

    def setTimeoutTimestamp(self, at):
        self.timer = at


def test_group_without_changes_writes_nothing_and_unsorted_rows_are_played_in_order():
    hour = 3_600_000
    held = ([7, 8], ["RED", "RED"], [50 * hour, 40 * hour])
    state = HeldState(10 * hour, held, timed_out=True)
    assert list(lifecycle._play(("TX", 1), iter(()), state)) == []
    assert state.get == held and state.timer == 40 * hour

    rows = pd.DataFrame({
        "at_ms": [2 * hour, hour, hour, hour], "is_ack": [True, True, None, False], "alert_id": [2, 1, 3, 2],
        "severity": [None, None, "RED", "RED"],
    }).astype({"is_ack": object})
    fresh = HeldState(0)
    got = list(lifecycle._play(("TX", None), iter([rows[:2], rows[2:]]), fresh))
    # The acknowledgement of 1 names no alert; a row of unknown kind raises one.
    assert [tuple(r) for r in pd.concat(got).itertuples(index=False)] == [
        ("TX", None, 2, pd.Timestamp(hour, unit="ms"), "created", "RED"),
        ("TX", None, 3, pd.Timestamp(hour, unit="ms"), "created", "RED"),
        ("TX", None, 2, pd.Timestamp(2 * hour, unit="ms"), "acknowledged", "RED"),
    ]
    assert list(fresh.get[0]) == [3]


def test_second_run_reads_only_new_files(spark, tmp_path):
    path, out, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))
    schema = spark.range(1).schema
    for lo in (0, 100):
        spark.range(lo, lo + 100).write.mode("append").parquet(path)
        jobs.drain(jobs.to_files(jobs.file_stream(spark, path, schema), out, cp))
    assert spark.read.parquet(out).count() == 200


def test_malformed_messages_are_counted(spark):
    df = spark.createDataFrame([("1", '{"id": 1}'), ("2", '{"id": '), ("3", "hello"), ("4", None)], "key string, value string")
    decoded = jobs.decode(df, "id long")
    assert [r["id"] for r in jobs.well_formed(decoded).collect()] == [1]
    report = jobs.channel_report(decoded).first()
    assert (report["received"], report["malformed"]) == (4, 3)


def test_late_rows_go_to_the_side_table(spark, tmp_path):
    path = str(tmp_path / "in")
    batches = [[T0 + timedelta(hours=h) for h in hours] for hours in ([0, 10], [5, 20], [1, 19, 30])]
    for b in batches:
        spark.createDataFrame([(t,) for t in b], "at timestamp").coalesce(1).write.mode("append").parquet(path)
    stream = jobs.file_stream(spark, path, spark.createDataFrame([], "at timestamp").schema, files_per_batch=1)
    jobs.drain(jobs.split_late(
        stream, "at", "6 HOURS", *(str(tmp_path / n) for n in ("ok", "late", "marks", "cp"))))
    late = [r["at"] for r in spark.read.parquet(str(tmp_path / "late")).select("at").collect()]
    assert late == [T0 + timedelta(hours=1)]
    assert spark.read.parquet(str(tmp_path / "ok")).count() == 6


def test_stream_plans_keep_watermarks(spark, tmp_path):
    schema = spark.createDataFrame([], "observed_at timestamp, outage_fraction double").schema
    (tmp_path / "in").mkdir()
    binned = jobs.tumbling_outages(jobs.file_stream(spark, str(tmp_path / "in"), schema), "3 hours", "1 hour")
    assert binned.isStreaming and "EventTimeWatermark" in binned._jdf.queryExecution().logical().toString()
