"""Streaming twins of the batch operators. Every job takes a streaming DataFrame or a folder of
files, shares its transform with the batch side, and keeps its progress under the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gridgale.functions.clock import DAY, micros
from gridgale.operators.quality import RuleSet
from gridgale.sources import tables


def file_stream(
    spark: SparkSession, path: str, schema, fmt: str = "parquet", files_per_batch: int | None = None
) -> DataFrame:
    """New files of a folder, oldest first."""
    reader = spark.readStream.schema(schema).format(fmt)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def drain(query: StreamingQuery) -> StreamingQuery:
    """Wait for a run that stops by itself (``availableNow``), raising what it raised."""
    query.awaitTermination()
    return query


def to_files(
    stream: DataFrame, path: str, checkpoint: str, partition_by: list[str] | None = None,
    every: str | None = None,
) -> StreamingQuery:
    """Append to parquet files exactly once: what is there now, or continuously ``every`` so often."""
    writer = stream.writeStream.format("parquet").outputMode("append") \
        .option("path", path).option("checkpointLocation", checkpoint)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return writer.start()


# --- ingest --------------------------------------------------------------------------------

def ingest_stream(
    stream: DataFrame,
    clean: Callable[[DataFrame], DataFrame],
    rules: Callable[[DataFrame], RuleSet],
    shape: Callable[[DataFrame], DataFrame],
    time: str, path: str, checkpoint: str, every: str | None = None,
) -> StreamingQuery:
    """Validate, normalise and append a feed as it arrives. The checkpoint remembers which files
    were read, so each run takes only what is new."""
    rows = clean(stream)
    shaped = tables.with_month(shape(rules(rows).valid(rows)), time)
    return to_files(shaped, path, checkpoint, ["month"], every)


def backfill_report(
    raw: DataFrame, rules: RuleSet, time: str, start: str, days: int = 30
) -> DataFrame:
    """Counts per chunk of a historical load; the load itself is one partitioned job."""
    first = micros(F.lit(start).cast("timestamp"))
    chunk = F.floor((micros(F.col(time)) - first) / F.lit(days * DAY))
    checked = rules.check(raw.withColumn("chunk", chunk))
    return checked.filter("chunk >= 0").groupBy("chunk").agg(
        F.count("*").alias("fetched"), F.count_if(F.size("failed_rules") == 0).alias("loaded"),
        F.min(time).alias("first"), F.max(time).alias("last"),
    )


def unique_alerts(stream: DataFrame, key: str, time: str, delay: str) -> DataFrame:
    """First arrival of each key, as long as repeats come within ``delay`` of event time."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def upsert_stream(
    stream: DataFrame, path: str, checkpoint: str, time: str, keys: list[str],
    update_columns: list[str], order: list[Column],
) -> StreamingQuery:
    """Merge every micro-batch into the table. Replaying a batch writes the same rows again."""
    def merge(batch: DataFrame, _: int) -> None:
        tables.upsert_into(batch, path, time, keys, update_columns, order)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint) \
        .trigger(availableNow=True).start()


# --- windows -------------------------------------------------------------------------------

def tumbling_outages(stream: DataFrame, width: str, delay: str) -> DataFrame:
    """The 3-hour bins of the case study, emitted once each bin is closed."""
    return stream.withWatermark("observed_at", delay).groupBy(
        F.window("observed_at", width).alias("w")
    ).agg(
        F.avg("outage_fraction").alias("mean_fraction"),
        F.max("outage_fraction").alias("max_fraction"), F.count("*").alias("n"),
    ).select(F.col("w.start").alias("bin_start"), "mean_fraction", "max_fraction", "n")


def rolling_counts(stream: DataFrame, width: str, slide: str, delay: str) -> DataFrame:
    """Events and peak magnitude per cell over a sliding window."""
    return stream.withWatermark("event_time", delay).groupBy(
        F.window("event_time", width, slide).alias("w"), "cell"
    ).agg(F.count("*").alias("n"), F.max("magnitude").alias("max_magnitude")).select(
        F.col("w.end").alias("window_end"), "cell", "n", "max_magnitude"
    )


# --- messages ------------------------------------------------------------------------------

def encode(df: DataFrame, key: Column, columns: list[str]) -> DataFrame:
    """Rows as (key, value) messages with a JSON value."""
    return df.select(key.cast("string").alias("key"), F.to_json(F.struct(*columns)).alias("value"))


def decode(messages: DataFrame, schema: str) -> DataFrame:
    """Parsed messages with ``malformed`` set on those that are not JSON of the schema."""
    parsed = F.from_json(
        "value", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    )
    out = messages.withColumn("m", parsed)
    return out.withColumn("malformed", F.col("m").isNull() | F.col("m._bad").isNotNull())


def well_formed(decoded: DataFrame) -> DataFrame:
    return decoded.filter(~F.col("malformed")).select("m.*").drop("_bad")


def channel_report(decoded: DataFrame) -> DataFrame:
    return decoded.agg(F.count("*").alias("received"), F.count_if("malformed").alias("malformed"))


def retained(log: DataFrame, n: int = 100_000, time: str = "predicted_at", tie: str = "id") -> DataFrame:
    """The newest ``n`` rows of a log."""
    return log.orderBy(F.col(time).desc(), F.col(tie).desc()).limit(n)


# --- late data -----------------------------------------------------------------------------

def split_late(
    stream: DataFrame, time: str, delay: str, on_time: str, late: str, marks: str, checkpoint: str
) -> StreamingQuery:
    """Route rows older than (newest time seen before the batch - delay) to a side table.

    Each batch writes its own folder, and as its mark the newest time so far, so a replay overwrites
    what it wrote and only the last mark is read. Rows without a time are on time.
    """
    def route(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()
        try:
            cutoff, before = None, f"{marks}/batch={batch_id - 1}"
            if batch_id and tables.exists(spark, before):
                newest = spark.read.parquet(before)
                cutoff = newest.select(
                    F.unix_micros(F.col("newest") - F.expr(f"INTERVAL {delay}")).alias("cutoff")
                ).first()["cutoff"]
            is_late = F.lit(False) if cutoff is None else F.coalesce(
                F.col(time) < F.timestamp_micros(F.lit(cutoff)), F.lit(False)
            )
            batch.filter(is_late).write.mode("overwrite").parquet(f"{late}/batch={batch_id}")
            batch.filter(~is_late).write.mode("overwrite").parquet(f"{on_time}/batch={batch_id}")
            so_far = batch.agg(F.max(time).alias("newest"))
            if cutoff is not None:
                so_far = so_far.union(newest.select("newest")).agg(F.max("newest").alias("newest"))
            so_far.write.mode("overwrite").parquet(f"{marks}/batch={batch_id}")
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(route).option("checkpointLocation", checkpoint) \
        .trigger(availableNow=True).start()

