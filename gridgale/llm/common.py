"""Small helpers that the text operators share."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridgale.session import staging_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: later jobs read the same rows
    with column pruning and size statistics, and a lost executor costs a re-read, not a recompute."""
    path = staging_path(df.sparkSession, name)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Smaller Arrow batches for the jobs that run inside, where rows are long: both the JVM and the Python
    worker hold a whole batch."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Two columns under the usual names; other columns, whatever they are called, stay out of the way."""
    # An alias to the same name would hide from Spark that two reads of a table are the same.
    names = {"doc_id": id_col, "text": text_col}
    return docs.select(*[F.col(c) if c == n else F.col(c).alias(n) for n, c in names.items()])


def hash_sample(docs: DataFrame, rows: int, seed: int, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """At most ``rows`` distinct keys with the smallest hash: bounded, and the same on every run."""
    return docs.select(*keys).where(F.col(keys[0]).isNotNull()).distinct().orderBy(
        F.xxhash64(F.lit(seed), *keys), *keys
    ).limit(rows)




def salted_lookup(rows: DataFrame, found: DataFrame, key: str, by: str, salts: int = 256) -> DataFrame:
    """``rows`` with the columns of ``found`` (one row a key) beside theirs, null where there is none. A key that
    holds a large share of ``rows`` is dealt to ``salts`` tasks by the hash of ``by``; only the (key, salt) pairs
    that occur are copied."""
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(salts)))
    keys = salted.where(F.col(key).isNotNull()).select(key, "_salt").distinct().join(found, key)
    return salted.join(keys, [key, "_salt"], "left").drop("_salt")
