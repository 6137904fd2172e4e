"""Model-ready data: time-ordered splits, scaling, weights, folds and sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridgale.operators.ordering import numbered, running_totals

SEQUENCE_BLOCK = 4096


_NEVER = (1 << 63) - 1


def _placed(df: DataFrame, time: str) -> Column:
    """The time as a number that sorts alike, unknown times last."""
    kind = dict(df.dtypes)[time]
    if kind.startswith("timestamp"):
        return F.coalesce(F.unix_micros(F.col(time).cast("timestamp")), F.lit(_NEVER))
    if kind == "date":
        return F.coalesce(F.unix_date(time).cast("bigint"), F.lit(_NEVER))
    return F.coalesce(F.col(time).cast("double"), F.lit(float("inf")))


def rows_at(df: DataFrame, positions: list[int], time: str, tie: str) -> list[tuple]:
    """The (time, tie) key of the row at each 0-based position of the (time, tie) order.

    Selection instead of a full sort: rows are counted per time (combined map-side), the counts
    are accumulated, and only the times that hold a wanted position are looked into. (time, tie)
    must identify a row. Times travel through the driver as numbers, so the driver's own time zone
    plays no part; rows without a time come after all others.
    """
    per_time = df.groupBy(_placed(df, time).alias("k")).agg(F.count("*").alias("n"))
    totals, _ = running_totals(per_time, ["k"], ["n"])
    wanted = F.explode(F.array(*[F.lit(p).cast("bigint") for p in sorted(set(positions))]))
    hits = (
        totals.select("k", "n", "n_before", wanted.alias("p"))
        .filter((F.col("p") >= F.col("n_before")) & (F.col("p") < F.col("n_before") + F.col("n")))
        .select("k", "n_before", "p")
        .collect()
    )
    found = {}
    for hit in hits:
        at_time = df.filter(_placed(df, time) == F.lit(hit["k"])).select(F.col(tie).alias("k"))
        place = hit["p"] - hit["n_before"]
        row = numbered(at_time, ["k"]).filter(F.col("position") == place).first()
        found[hit["p"]] = (hit["k"], row["k"])
    return [found.get(p) for p in positions]


def _before(df: DataFrame, time: str, tie: str, key: tuple | None) -> Column:
    """Whether a row comes before the key; a null tie comes first among equal times."""
    if key is None:  # past the last row
        return F.lit(True)
    place, at = _placed(df, time), F.lit(key[0])
    earlier = F.lit(False) if key[1] is None else F.coalesce(F.col(tie) < F.lit(key[1]), F.lit(True))
    return (place < at) | ((place == at) & earlier)


def temporal_split(
    df: DataFrame, time: str = "ts", tie: str = "cell", train: float = 0.7, val: float = 0.15
) -> DataFrame:
    """Add ``split``: by row position in time order, with no shuffling and no leakage."""
    n = df.count()
    cuts = rows_at(df, [int(n * train), int(n * (train + val))], time, tie)
    return df.withColumn(
        "split",
        F.when(_before(df, time, tie, cuts[0]), "train")
        .when(_before(df, time, tie, cuts[1]), "val").otherwise("test"),
    )


def expanding_folds(
    df: DataFrame, time: str = "ts", tie: str = "cell", k: int = 5
) -> list[tuple[Column, Column]]:
    """(train, test) filters: each fold tests the next n // (k+1) rows and trains on all before."""
    n = df.count()
    size = n // (k + 1)
    starts = [n - (k - i) * size for i in range(k)]
    keys = rows_at(df, [*starts, n], time, tie)
    return [
        (_before(df, time, tie, keys[i]), ~_before(df, time, tie, keys[i]) & _before(df, time, tie, keys[i + 1]))
        for i in range(k)
    ]


def fold_summary(df: DataFrame, time: str = "ts", tie: str = "cell", k: int = 5, target: str = "y") -> DataFrame:
    """Sizes and positives of every fold, in one pass over the rows."""
    parts = []
    for i, (train, test) in enumerate(expanding_folds(df, time, tie, k)):
        for name, rows in (("train", train), ("test", test)):
            parts.append(F.struct(
                F.lit(i).alias("fold"), F.lit(name).alias("part"),
                F.count_if(rows).alias("n"),
                F.coalesce(F.sum(F.when(rows, F.col(target))), F.lit(0)).cast("bigint").alias("positives"),
                F.min(F.when(rows, F.col(time))).alias("first"),
                F.max(F.when(rows, F.col(time))).alias("last"),
            ))
    return df.agg(F.explode(F.array(*parts)).alias("f")).select("f.*")


def scaling(train: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation per column over the training rows: one row to the driver."""
    values = {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns}
    row = train.agg(*[
        f.alias(f"{kind}_{i}")
        for i, v in enumerate(values.values())
        for kind, f in (("m", F.avg(v)), ("s", F.stddev_pop(v)))
    ]).first()
    return {c: (row[f"m_{i}"] or 0.0, row[f"s_{i}"] or 1.0) for i, c in enumerate(columns)}


def standardise(df: DataFrame, stats: dict[str, tuple[float, float]]) -> DataFrame:
    """Nulls to zero, then centre and scale; a constant column is only centred."""
    return df.withColumns({
        c: (F.coalesce(F.col(c).cast("double"), F.lit(0.0)) - F.lit(m)) / F.lit(s or 1.0)
        for c, (m, s) in stats.items()
    })


def class_weights(df: DataFrame, target: str = "y") -> DataFrame:
    """One row: balanced weights, or ones when a class is missing."""
    pos, neg = F.count_if(F.col(target) == 1), F.count_if(F.col(target) == 0)
    both = (pos > 0) & (neg > 0)
    n = F.count("*")
    return df.agg(
        F.when(both, n / (2 * neg)).otherwise(1.0).alias("weight_0"),
        F.when(both, n / (2 * pos)).otherwise(1.0).alias("weight_1"),
    )


def sequences(
    df: DataFrame,
    columns: list[str],
    target: str,
    order: list[str],
    length: int = 24,
    partition_by: list[str] | None = None,
) -> DataFrame:
    """Sliding windows of ``length`` rows, with the last row's target.

    By default windows run over the whole order, whatever the cell. Rows are numbered, dealt to
    blocks of consecutive positions, and the first rows of a block are copied to the one before,
    so each block is complete on its own. ``partition_by`` keeps windows inside a group instead.
    The final possible window of each sequence is left out, as in the original training code.
    """
    row = F.array(*[F.col(c).cast("double") for c in columns])
    if partition_by:
        w = Window.partitionBy(*partition_by).orderBy(*order)
        ahead = w.rowsBetween(0, length - 1)
        out = df.select(
            *partition_by, *[c for c in order if c not in partition_by],
            (F.row_number().over(w) - 1).cast("bigint").alias("position"),
            F.collect_list(row).over(ahead).alias("x"),
            F.last(target).over(ahead).alias("target"),
            F.count("*").over(Window.partitionBy(*partition_by)).alias("n"),
        )
        return out.filter(F.col("position") < F.col("n") - length).drop("n")
    placed = numbered(df, order)
    n = placed.count()
    home = F.floor(F.col("position") / SEQUENCE_BLOCK)
    early = (F.col("position") % SEQUENCE_BLOCK < length - 1) & (home > 0)
    dealt = placed.withColumn(
        "block", F.explode(F.when(early, F.array(home, home - 1)).otherwise(F.array(home)))
    )
    ahead = Window.partitionBy("block").orderBy("position").rowsBetween(0, length - 1)
    out = dealt.select(
        "position", "block",
        F.collect_list(row).over(ahead).alias("x"),
        F.last(target).over(ahead).alias("target"),
    )
    return out.filter((F.col("block") == home) & (F.col("position") < n - length)).drop("block")


def summary(df: DataFrame, features: list[str], target: str = "y", time: str = "ts") -> DataFrame:
    return df.agg(
        F.count("*").alias("total_samples"),
        F.lit(len(features)).alias("n_features"),
        F.avg(F.col(target).cast("double")).alias("positive_rate"),
        F.min(time).alias("start"), F.max(time).alias("end"),
    )


def stratified_split(
    df: DataFrame, target: str, key: list[str], test: float = 0.2, seed: int = 42
) -> DataFrame:
    """Add ``split``: the test share of each class, picked by a hash of the row key, so it stays
    the same however the data is laid out."""
    scale = 1_000_000
    draw = F.pmod(F.xxhash64(F.lit(seed), F.col(target), *key), F.lit(scale))
    return df.withColumn("split", F.when(draw < int(test * scale), "test").otherwise("train"))


