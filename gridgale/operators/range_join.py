"""Equi-join plus a time range, planned as an ordinary hash or sort-merge join.

Spark has no strategy for ``a.t BETWEEN b.lo AND b.hi``: without an equality it nests loops.
Both sides therefore carry a time bucket as wide as the range. Each row of the left side probes
the buckets its range touches (two at most when the bucket is as wide as the range); each row
of the right side sits in exactly one, so no match is found twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bucket_of(t: Column, width: int) -> Column:
    """Bucket number; 0 for an unknown time, which the range test then rejects."""
    return F.coalesce(F.floor(t / F.lit(width)).cast("bigint"), F.lit(0).cast("bigint"))


def range_join(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    t: str,
    low: Column,
    high: Column,
    width: int,
    how: str = "inner",
    condition: Column | None = None,
) -> DataFrame:
    """Join rows equal on ``keys`` whose right-side ``t`` lies in the closed [low, high].

    ``low``/``high`` are expressions over the left side and ``width`` should be about
    high - low (all in microseconds). ``how`` is ``inner`` or ``left_semi``; a semi join probes
    with several buckets and may repeat a left row, so it is de-duplicated by its caller.
    """
    width = max(int(width), 1)
    probe = left.withColumns({"_lo": low, "_hi": high}).withColumn(
        "_bucket",
        F.explode(F.sequence(bucket_of(F.col("_lo"), width), bucket_of(F.col("_hi"), width))),
    )
    build = right.withColumn("_bucket", bucket_of(F.col(t), width))
    for k in [*keys, "_bucket"]:
        build = build.withColumnRenamed(k, f"_r_{k}")
    on = F.col(t).between(F.col("_lo"), F.col("_hi"))
    for k in [*keys, "_bucket"]:
        on = on & (F.col(k) == F.col(f"_r_{k}"))
    if condition is not None:
        on = on & condition
    joined = probe.join(build, on, how)
    return joined.drop("_lo", "_hi", "_bucket", *[f"_r_{k}" for k in [*keys, "_bucket"]])


def served(right: DataFrame, t: str, before: int, after: int, width: int) -> DataFrame:
    """Each row once in every ``bucket`` of times that it can serve: those from ``after`` before its ``t`` to
    ``before`` after it."""
    at = F.col(t)
    first = bucket_of(at - F.lit(after).cast("bigint") if after else at, width)
    last = bucket_of(at + F.lit(before).cast("bigint") if before else at, width)
    return right.withColumn("bucket", F.explode(F.sequence(first, last)))


def serving_join(
    left: DataFrame, right: DataFrame, keys: list[str], time: Column, t: str, before: int, after: int = 0,
    width: int | None = None, dealt: bool = False,
) -> DataFrame:
    """Join rows equal on ``keys`` whose right-side ``t`` lies from ``before`` earlier to ``after`` later than the left
    row's ``time``.

    Here each left row sits in one ``bucket`` and the right rows are copied (``served``; ``dealt`` when the caller has
    done it, with this width). ``bucket`` stays in the result: what is then grouped by the keys, ``bucket`` and more of
    the left row is in place already, so the pairs are never shuffled. Never by broadcast: Spark takes rows that
    an explode has made for as few as it was made from, and the driver would hold them all.
    """
    width = width or max(before + after, 1)
    probe = left if "bucket" in left.columns else left.withColumn("bucket", bucket_of(time, width))
    build = right if dealt else served(right, t, before, after, width)
    both = [*keys, "bucket"]
    build = build.withColumnsRenamed({k: f"_r_{k}" for k in both})
    low = time - F.lit(before).cast("bigint") if before else time
    high = time + F.lit(after).cast("bigint") if after else time
    on = F.col(t).between(low, high)
    for k in both:
        on = on & (F.col(k) == F.col(f"_r_{k}"))
    return probe.join(build.hint("merge"), on).drop(*[f"_r_{k}" for k in both])
