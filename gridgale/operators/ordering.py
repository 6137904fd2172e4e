"""Global order without a single-task window: positions and running totals.

Rows are range-partitioned and sorted on all order columns, so a value that repeats a lot is
still split by the next column. The result is written once (``settle``) because the range bounds
come from a sample: later steps must see the same split. One number per partition goes through
the driver; rows never do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridgale.session import settle

_LOCAL_BITS = 33  # monotonically_increasing_id: partition number above, row number below


def _ranged(df: DataFrame, order: list[str], partitions: int | None) -> DataFrame:
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return settle(
        df.repartitionByRange(n, *order)
        .sortWithinPartitions(*order)
        .withColumn("_m", F.monotonically_increasing_id())
        .withColumn("_pid", F.shiftright("_m", _LOCAL_BITS).cast("int"))
    )


def _with_offsets(ranged: DataFrame, rows: list[tuple], schema: str) -> DataFrame:
    """Join one row of offsets per partition. Broadcast is safe: the table has as many rows as
    the data has partitions."""
    offsets = ranged.sparkSession.createDataFrame(rows, schema)
    return ranged.join(F.broadcast(offsets), "_pid")


def numbered(df: DataFrame, order: list[str], partitions: int | None = None) -> DataFrame:
    """Add ``position``: 0-based place of each row in the global order."""
    ranged = _ranged(df, order, partitions)
    counts = {r["_pid"]: r["n"] for r in ranged.groupBy("_pid").agg(F.count("*").alias("n")).collect()}
    rows, seen = [], 0
    for pid in sorted(counts):
        rows.append((pid, seen))
        seen += counts[pid]
    local = F.col("_m").bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1))
    placed = _with_offsets(ranged, rows, "_pid int, _offset long")
    return placed.withColumn("position", F.col("_offset") + local).drop("_m", "_pid", "_offset")


def running_totals(
    df: DataFrame, order: list[str], sums: list[str], partitions: int | None = None
) -> tuple[DataFrame, dict[str, float]]:
    """Add ``<s>_before`` (everything strictly earlier) for each column; also the grand totals.

    ``order`` must identify rows, or equal rows are taken in any order.
    """
    ranged = _ranged(df, order, partitions)
    parts = {
        r["_pid"]: r
        for r in ranged.groupBy("_pid").agg(*[F.sum(s).alias(s) for s in sums]).collect()
    }
    kinds = dict(ranged.dtypes)
    rows, totals = [], dict.fromkeys(sums, 0)
    for pid in sorted(parts):
        rows.append((pid, *[totals[s] for s in sums]))
        for s in sums:
            totals[s] += parts[pid][s] or 0
    schema = ", ".join(["_pid int", *[f"_before_{s} {kinds[s]}" for s in sums]])
    w = Window.partitionBy("_pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = _with_offsets(ranged, rows, schema)
    out = placed.withColumns({
        f"{s}_before": F.col(f"_before_{s}") + F.coalesce(F.sum(s).over(w), F.lit(0).cast(kinds[s]))
        for s in sums
    })
    return out.drop("_m", "_pid", *[f"_before_{s}" for s in sums]), totals


def quantiles(df: DataFrame, column: str, probabilities: list[float]) -> list[float | None]:
    """Exact quantiles with linear interpolation, nulls left out.

    Values are counted, the counts accumulated, and only the values at the wanted ranks are
    fetched: the built-in exact percentile would hold every distinct value in one task.
    """
    counted = df.filter(F.col(column).isNotNull()).groupBy(
        F.col(column).cast("double").alias("v")
    ).agg(F.count("*").alias("n"))
    placed, totals = running_totals(counted, ["v"], ["n"])
    n = int(totals["n"] or 0)
    if n == 0:
        return [None] * len(probabilities)
    ranks = {p: (n - 1) * p for p in probabilities}
    wanted = sorted({k for r in ranks.values() for k in (int(r), min(int(r) + 1, n - 1))})
    hits = placed.select("v", "n", "n_before", F.explode(F.array(*[F.lit(k) for k in wanted])).alias("k"))
    at = {
        row["k"]: row["v"]
        for row in hits.filter("k >= n_before AND k < n_before + n").select("k", "v").collect()
    }
    out = []
    for p in probabilities:
        low = int(ranks[p])
        high = min(low + 1, n - 1)
        out.append(at[low] + (at[high] - at[low]) * (ranks[p] - low))
    return out
