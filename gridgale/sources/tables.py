"""Month-partitioned tables on files: append, insert-ignore and upsert of the touched months."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridgale.functions.clock import in_dates
from gridgale.operators.merge import insert_ignore, upsert
from gridgale.session import settle


def with_month(df: DataFrame, time: str) -> DataFrame:
    return df.withColumn("month", F.date_format(F.col(time), "yyyy-MM"))


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a table folder is there yet."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def append(df: DataFrame, path: str, time: str, files_per_month: int | None = None) -> None:
    """Append rows; each month is a folder.

    Without ``files_per_month`` there is no shuffle and each task writes to the months it holds.
    With it, rows are first dealt by (month, salt): a folder gets that many files however many
    tasks read the source, and one month that holds most rows is still written by many tasks.
    """
    rows = with_month(df, time)
    if files_per_month:
        salt = F.pmod(F.xxhash64(F.col(time)), F.lit(files_per_month))
        rows = rows.repartition(F.col("month"), salt)
    rows.write.mode("append").partitionBy("month").parquet(path)


def read_range(
    spark: SparkSession, path: str, time: str, start: str | None = None, end: str | None = None
) -> DataFrame:
    """Rows of a date range. The month bound prunes folders; the time bound prunes row groups."""
    df = spark.read.parquet(path)
    if start is not None:
        df = df.filter(F.col("month") >= start[:7])
    if end is not None:
        df = df.filter(F.col("month") <= end[:7])
    return df.filter(in_dates(F.col(time), start, end)).drop("month")


def touched_months(rows: DataFrame) -> list[str | None]:
    """Months that the rows fall in, None for unknown times: a list bounded by the calendar, so it may
    stand in a filter."""
    return [r["month"] for r in rows.select("month").distinct().collect()]


def in_months(target: DataFrame, months: list[str | None]) -> DataFrame:
    """Rows of these months. Literal months prune folders."""
    wanted = F.col("month").isin(sorted(m for m in months if m is not None))
    return target.filter(wanted | F.col("month").isNull() if None in months else wanted)


def append_new(df: DataFrame, path: str, time: str, keys: list[str], order: list) -> None:
    """Append the rows whose key the table lacks. When the time is part of the key, only the months
    of the new rows are read from the table."""
    spark = df.sparkSession
    if exists(spark, path):
        target = spark.read.parquet(path)
        if time in keys:
            target = in_months(target, touched_months(with_month(df, time)))
        # The target is read and appended to in one job, so the rows to add are fixed first.
        df = settle(insert_ignore(target, df, keys, order))
    else:
        from gridgale.operators.merge import first_per_key

        df = first_per_key(df, keys, order)
    append(df, path, time)


def upsert_into(
    df: DataFrame, path: str, time: str, keys: list[str], update_columns: list[str], order: list
) -> None:
    """Merge updates into the table, rewriting only the months they touch.

    ``time`` must be one of the keys, so a key never moves between months. The merged months are
    written to the shared folder first and then replace the old ones by dynamic overwrite.
    """
    if time not in keys:
        raise ValueError("the partition time must be part of the key")
    spark = df.sparkSession
    updates = with_month(df, time)
    if not exists(spark, path):
        from gridgale.operators.merge import last_per_key

        last_per_key(updates, [*keys, "month"], order).write.partitionBy("month").parquet(path)
        return
    target = spark.read.parquet(path)
    current = in_months(target, touched_months(updates))
    extra = [c for c in target.columns if c not in updates.columns]
    updates = updates.withColumns({c: F.lit(None).cast(dict(target.dtypes)[c]) for c in extra})
    merged = settle(upsert(current, updates, [*keys, "month"], update_columns, order))
    (
        merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("month").parquet(path)
    )
