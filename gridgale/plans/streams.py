"""Streaming queries (T*). The given tables are first laid out as a series of files, as a feed
would deliver them; each job then runs over that series in micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridgale.constants import ALERT_TTL_HOURS, DEFAULT_ALERT_TTL_HOURS
from gridgale.operators import normalize as norm
from gridgale.operators import quality as q
from gridgale.operators import scoring as sc
from gridgale.operators.merge import UPSERT_RULES
from gridgale.plans.base import Source, query, rounded, tidy
from gridgale.plans.checks import _OUTAGE_RULES
from gridgale.plans.service import _REGION_SQL, _SCORE_SQL, _level_sql, region
from gridgale.plans.stores import _s11_inputs, _s11_sql
from gridgale.session import staging_path
from gridgale.streaming import jobs
from gridgale.streaming.lifecycle import alert_lifecycle


def _paths(s: Source, name: str) -> tuple[str, str, str]:
    """Folders for the incoming files, the result and the progress of one job."""
    root = staging_path(s.spark, name)
    return f"{root}/in", f"{root}/out", f"{root}/progress"


def _deliver(parts: list[DataFrame], path: str) -> None:
    """Write the parts one after another, so a file stream sees them in this order."""
    for part in parts:
        part.write.mode("append").parquet(path)


def _halves(df: DataFrame, time: str, cut: str = "2024-01-16") -> list[DataFrame]:
    """An early and a late delivery; rows without a time come with the late one."""
    early = F.coalesce(F.col(time) < cut, F.lit(False))
    return [df.filter(early), df.filter(~early)]


@query("t1_incremental_ingest", rounded(["raw_outages"], """
    SELECT event_id, timestamp_raw AS observed_at, lpad(county_fips, 5, '0') AS county_fips,
      least(customers_out, total_customers) / total_customers AS outage_fraction FROM raw_outages
    WHERE regexp_matches(lpad(county_fips, 5, '0'), '^[0-9]{5}$') AND customers_out >= 0
      AND total_customers > 0""", ["outage_fraction"]))
def t1_incremental_ingest(s: Source) -> DataFrame:
    """Two deliveries and two runs: the second run reads only the second delivery."""
    incoming, out, progress = _paths(s, "t1")
    raw = s.raw_outages
    for part in _halves(raw, "timestamp_raw"):
        _deliver([part], incoming)
        stream = jobs.file_stream(s.spark, incoming, raw.schema)
        jobs.drain(jobs.ingest_stream(
            stream, lambda df: df.withColumnRenamed("timestamp_raw", "observed_at"),
            q.outage_rules, norm.outages, "observed_at", out, progress,
        ))
    return tidy(s.spark.read.parquet(out).select(
        "event_id", "observed_at", "county_fips", "outage_fraction"
    ))


_OK = " AND ".join(f"coalesce({c}, false)" for c in _OUTAGE_RULES.values())


@query("t2_backfill_report", rounded(["raw_outages"], f"""
    SELECT CAST(floor((epoch_us(timestamp_raw) - epoch_us(TIMESTAMP '2024-01-01')) / 604800000000) AS BIGINT)
      AS chunk, count(*) AS fetched, count(*) FILTER ({_OK}) AS loaded,
      min(timestamp_raw) AS first, max(timestamp_raw) AS last FROM raw_outages GROUP BY 1""", []))
def t2_backfill_report(s: Source) -> DataFrame:
    raw = s.raw_outages.withColumnRenamed("timestamp_raw", "observed_at")
    return jobs.backfill_report(raw, q.outage_rules(raw), "observed_at", "2024-01-01", days=7)


@query("t3_unique_alerts", rounded(["alerts"], "SELECT DISTINCT id, severity, cell FROM alerts", []))
def t3_unique_alerts(s: Source) -> DataFrame:
    incoming, out, progress = _paths(s, "t3")
    rows = s.alerts.select("id", "created_at", "severity", "cell")
    again = rows.filter("id % 3 = 0")
    _deliver([rows.unionByName(again), again], incoming)
    stream = jobs.file_stream(s.spark, incoming, rows.schema, files_per_batch=2)
    jobs.drain(jobs.to_files(jobs.unique_alerts(stream, "id", "created_at", "60 days"), out, progress))
    return s.spark.read.parquet(out).select("id", "severity", "cell")


@query("t4_streaming_upsert", _s11_sql())
def t4_streaming_upsert(s: Source) -> DataFrame:
    incoming, out, progress = _paths(s, "t4")
    stored, updates = _s11_inputs(s)
    _deliver([stored.select(updates.columns)], incoming)
    keys, changing = UPSERT_RULES["outage_observations"]

    def run() -> None:
        stream = jobs.file_stream(s.spark, incoming, updates.schema)
        jobs.drain(jobs.upsert_stream(
            stream, out, progress, "observed_at", keys, changing, [F.col("event_id")]
        ))

    run()
    _deliver([updates], incoming)
    run()
    return tidy(s.spark.read.parquet(out).drop("event_id", "month"))


_CLOSED = "(SELECT max({t}) - INTERVAL 6 HOUR FROM {r})"


@query("t5_tumbling_bins", rounded(["outages"], f"""
    SELECT * FROM (SELECT time_bucket(INTERVAL 3 HOUR, observed_at) AS bin_start,
      avg(outage_fraction) AS mean_fraction, max(outage_fraction) AS max_fraction, count(*) AS n
      FROM outages GROUP BY 1)
    WHERE bin_start + INTERVAL 3 HOUR <= {_CLOSED.format(t='observed_at', r='outages')}""",
    ["mean_fraction", "max_fraction"]))
def t5_tumbling_bins(s: Source) -> DataFrame:
    """Bins that the watermark (newest time less 6 h) has closed."""
    incoming, out, progress = _paths(s, "t5")
    rows = s.outages.select("observed_at", "outage_fraction")
    for part in _halves(rows, "observed_at"):
        _deliver([part], incoming)
        stream = jobs.file_stream(s.spark, incoming, rows.schema)
        jobs.drain(jobs.to_files(jobs.tumbling_outages(stream, "3 hours", "6 hours"), out, progress))
    return tidy(s.spark.read.parquet(out))


@query("t5_rolling_counts", rounded(["weather"], f"""
    SELECT * FROM (SELECT we AS window_end, cell, count(*) AS n, max(magnitude) AS max_magnitude
      FROM (SELECT cell, magnitude, time_bucket(INTERVAL 6 HOUR, event_time) + INTERVAL 6 HOUR * k AS we
        FROM weather, (SELECT unnest(range(1, 5)) AS k)) GROUP BY 1, 2)
    WHERE window_end <= {_CLOSED.format(t='event_time', r='weather')}""", ["max_magnitude"]))
def t5_rolling_counts(s: Source) -> DataFrame:
    incoming, out, progress = _paths(s, "t5r")
    rows = s.weather.select("event_time", "cell", "magnitude")
    for part in _halves(rows, "event_time"):
        _deliver([part], incoming)
        stream = jobs.file_stream(s.spark, incoming, rows.schema)
        found = jobs.rolling_counts(stream, "24 hours", "6 hours", "6 hours")
        jobs.drain(jobs.to_files(found, out, progress))
    return tidy(s.spark.read.parquet(out))


_STREAM_SCORE = f"""
    SELECT w.event_id, w.event_time, w.cell, {_REGION_SQL.replace('cell', 'w.cell')} AS region_code,
      magnitude / 10 AS weather_count_24h, w.event_id % 100 / 100.0E0 AS lag_outage_24h,
      0.5E0 + w.event_id % 50 / 100.0E0 AS load_capacity_ratio,
      coalesce(i.avg_line_age_years, 20.0) AS avg_line_age_years
    FROM weather w LEFT JOIN infra i ON w.cell = i.cell"""


def score_stream(rows: DataFrame, infra: DataFrame) -> DataFrame:
    """Score rows as they come, with the static table joined in; keep what is above GREEN."""
    joined = rows.join(infra.select("cell", "avg_line_age_years"), "cell", "left")
    scored = sc.heuristic_score(sc.with_defaults(joined, time="event_time"))
    level = sc.risk_level(F.col("risk_probability"), F.col("region_code"))
    return scored.withColumn("risk_level", level).filter(F.col("risk_level") != "GREEN")


@query("t6_score_stream", rounded(["weather", "infra"], f"""
    SELECT * FROM (SELECT event_id, cell, region_code, risk_probability,
      {_level_sql('risk_probability', 'region_code')} AS risk_level
      FROM (SELECT *, {_SCORE_SQL} AS risk_probability FROM ({_STREAM_SCORE})))
    WHERE risk_level <> 'GREEN'""", ["risk_probability"]))
def t6_score_stream(s: Source) -> DataFrame:
    incoming, out, progress = _paths(s, "t6")
    rows = s.weather.select(
        "event_id", "event_time", "cell", region().alias("region_code"),
        (F.col("magnitude") / 10).alias("weather_count_24h"),
        (F.col("event_id") % 100 / 100.0).alias("lag_outage_24h"),
        (F.lit(0.5) + F.col("event_id") % 50 / 100.0).alias("load_capacity_ratio"),
    )
    _deliver(_halves(rows, "event_time"), incoming)
    stream = jobs.file_stream(s.spark, incoming, rows.schema, files_per_batch=1)
    published = score_stream(stream, s.infra).select(
        "event_id", "cell", "region_code", "risk_probability", "risk_level"
    )
    jobs.drain(jobs.to_files(published, out, progress))
    return tidy(s.spark.read.parquet(out))


_TTL_SQL = "CASE severity " + " ".join(f"WHEN '{k}' THEN {h}" for k, h in ALERT_TTL_HOURS.items()) + (
    f" ELSE {DEFAULT_ALERT_TTL_HOURS} END"
)


@query("t7_alert_lifecycle", rounded(["predictions"], f"""
    SELECT region_code, cell, alert_id, make_timestamp(at_ms * 1000) AS at, change, severity FROM (
      SELECT *, epoch_us(predicted_at) // 1000 AS at_ms, 'created' AS change FROM raised
      UNION ALL SELECT *, epoch_us(predicted_at) // 1000 + 6 * 3600000, 'acknowledged' FROM raised WHERE alert_id % 7 = 0
      UNION ALL SELECT * FROM (SELECT *, epoch_us(predicted_at) // 1000 + {_TTL_SQL} * 3600000 AS at_ms, 'expired' FROM raised
        WHERE alert_id % 7 <> 0) WHERE at_ms < (SELECT max(epoch_us(predicted_at) // 1000
          + CASE WHEN alert_id % 7 = 0 THEN 6 * 3600000 ELSE 0 END) - 3600000 FROM raised))""", []).replace(
    "result AS (", f"""raised AS (SELECT * FROM (SELECT region_code, cell, id AS alert_id, predicted_at,
      {_level_sql('risk_probability', 'region_code')} AS severity FROM predictions) WHERE severity <> 'GREEN'),
    result AS (""", 1))
def t7_alert_lifecycle(s: Source) -> DataFrame:
    """Raised from predictions above GREEN; every seventh is acknowledged after six hours. Two deliveries
    and two runs, so that open alerts are carried over."""
    incoming, out, progress = _paths(s, "t7")
    raised = s.predictions.select(
        "region_code", "cell", F.col("predicted_at").alias("event_time"), F.lit("raise").alias("kind"),
        sc.risk_level(F.col("risk_probability"), F.col("region_code")).alias("severity"),
        F.col("id").alias("alert_id"),
    ).filter("severity <> 'GREEN'")
    acks = raised.filter("alert_id % 7 = 0").withColumns({
        "event_time": F.col("event_time") + F.expr("INTERVAL 6 HOURS"), "kind": F.lit("ack"),
    })
    rows = raised.unionByName(acks)
    for part in _halves(rows, "event_time"):
        _deliver([part], incoming)
        stream = jobs.file_stream(s.spark, incoming, rows.schema)
        jobs.drain(jobs.to_files(alert_lifecycle(stream), out, progress))
    return s.spark.read.parquet(out)


_BROKEN = "id % 10 = 0"


def _messages(s: Source) -> DataFrame:
    sent = jobs.encode(s.predictions, F.col("id"), ["id", "cell", "region_code", "model_version"])
    # Every tenth message arrives cut short.
    return sent.withColumn("value", F.when(
        F.col("key").cast("bigint") % 10 == 0, F.expr("left(value, length(value) - 5)")
    ).otherwise(F.col("value")))


_MESSAGE = "id long, cell long, region_code string, model_version string"


@query("t8_codec", rounded(["predictions"], f"""
    SELECT id, cell, region_code, model_version FROM predictions WHERE NOT ({_BROKEN})""", []))
def t8_codec(s: Source) -> DataFrame:
    incoming, out, progress = _paths(s, "t8")
    rows = _messages(s)
    _deliver([rows], incoming)
    stream = jobs.file_stream(s.spark, incoming, rows.schema)
    jobs.drain(jobs.to_files(jobs.well_formed(jobs.decode(stream, _MESSAGE)), out, progress))
    return s.spark.read.parquet(out)


@query("t8_channel_report", rounded(["predictions"], f"""
    SELECT count(*) AS received, count(*) FILTER ({_BROKEN}) AS malformed FROM predictions""", []))
def t8_channel_report(s: Source) -> DataFrame:
    return jobs.channel_report(jobs.decode(_messages(s), _MESSAGE))


@query("t9_retained_log", rounded(["predictions"], """
    SELECT id, predicted_at FROM predictions ORDER BY predicted_at DESC, id DESC LIMIT 100000""", []))
def t9_retained_log(s: Source) -> DataFrame:
    return jobs.retained(s.predictions).select("id", "predicted_at")


@query("t10_late_rows", rounded(["weather"], """
    SELECT event_id, event_id % 50 = 0 AND event_time < TIMESTAMP '2024-01-10 00:00:00' AS late FROM weather
    """, []))
def t10_late_rows(s: Source) -> DataFrame:
    """Every fiftieth early event is delivered at the very end."""
    incoming, out, progress = _paths(s, "t10")
    rows = s.weather.select("event_id", "event_time")
    held = (F.col("event_id") % 50 == 0) & (F.col("event_time") < "2024-01-10")
    prompt = rows.filter(~held)
    parts = [*_halves(prompt, "event_time"), rows.filter(held)]
    for part in parts:
        _deliver([part], incoming)
        stream = jobs.file_stream(s.spark, incoming, rows.schema)
        jobs.drain(jobs.split_late(
            stream, "event_time", "3 DAYS", f"{out}/on_time", f"{out}/late", f"{out}/marks", progress
        ))
    late = s.spark.read.parquet(f"{out}/late").select("event_id", F.lit(True).alias("late"))
    prompt = s.spark.read.parquet(f"{out}/on_time").select("event_id", F.lit(False).alias("late"))
    return late.unionByName(prompt)
