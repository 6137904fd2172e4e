"""Exact evaluation metrics, from a histogram of (score, label).

Scores are counted per distinct value first (combined map-side). Ranking metrics need cumulative
counts over those values; they come from ``running_totals``, so no task ever sorts all scores.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridgale.operators.ordering import numbered, running_totals
from gridgale.session import settle

EPS = 1e-15


def histogram(df: DataFrame, score: str, y: str) -> DataFrame:
    return df.groupBy(F.col(score).cast("double").alias("p")).agg(
        F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) != 1).alias("neg")
    )


def curve(df: DataFrame, score: str, y: str) -> tuple[DataFrame, int, int]:
    """One row per distinct score with counts at or above it (tp, fp); and the class totals."""
    counted, totals = running_totals(histogram(df, score, y), ["p"], ["pos", "neg"])
    P, N = int(totals["pos"] or 0), int(totals["neg"] or 0)
    return counted.withColumns({
        "tp": F.lit(P) - F.col("pos_before"), "fp": F.lit(N) - F.col("neg_before"),
    }), P, N


def _share(value: Column, total: int) -> Column:
    return value / F.lit(float(total)) if total else F.lit(0.0)


def ranking(df: DataFrame, score: str, y: str) -> DataFrame:
    """AUC-ROC and average precision of one score column, as one row."""
    points, P, N = curve(df, score, y)
    return points.agg(*_ranking_columns(P, N))


def _ranking_columns(P: int, N: int) -> list[Column]:
    """Area under ROC in its Mann-Whitney form (ties count half; null without both classes), and
    precision at each distinct threshold weighted by the recall it adds."""
    wins = F.sum(F.col("pos").cast("double") * (F.col("neg_before") + F.col("neg") / 2.0))
    auc = wins / F.lit(float(P) * N) if P and N else F.lit(None).cast("double")
    step = F.col("pos") / F.lit(float(P)) if P else F.lit(0.0)
    ap = F.sum(step * F.col("tp") / (F.col("tp") + F.col("fp")))
    return [auc.alias("auc_roc"), ap.alias("auc_pr")]


def roc_points(points: DataFrame, P: int, N: int) -> DataFrame:
    return points.select(
        F.col("p").alias("threshold"),
        _share(F.col("tp"), P).alias("tpr"), _share(F.col("fp"), N).alias("fpr"),
    )


def best_youden(roc: DataFrame) -> DataFrame:
    """Threshold with the largest tpr - fpr; the highest threshold wins a tie."""
    j = F.col("tpr") - F.col("fpr")
    best = F.max_by(F.struct("threshold", "tpr", "fpr"), F.struct(F.round(j, 12), F.col("threshold")))
    return roc.agg(best.alias("b")).select(
        F.col("b.threshold").alias("threshold"),
        (F.col("b.tpr") - F.col("b.fpr")).alias("youden_j"),
    )


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def confusion_counts(score: Column, y: Column, threshold: float | Column, weight: Column | None = None) -> dict[str, Column]:
    hit = score >= threshold
    one = F.lit(1) if weight is None else weight

    def total(test: Column) -> Column:
        return F.coalesce(F.sum(F.when(test, one)), F.lit(0))

    return {
        "tp": total(hit & (y == 1)), "fp": total(hit & (y != 1)),
        "fn": total(~hit & (y == 1)), "tn": total(~hit & (y != 1)),
    }


def threshold_metrics(df: DataFrame, score: str, y: str, threshold: float = 0.5) -> DataFrame:
    """F1, precision, recall and accuracy; a ratio over nothing is 0."""
    c = confusion_counts(F.col(score), F.col(y), threshold)
    tp, fp, fn, tn = (c[k] for k in ("tp", "fp", "fn", "tn"))
    return df.agg(
        _ratio(2.0 * tp, 2 * tp + fp + fn).alias("f1"),
        _ratio(1.0 * tp, tp + fp).alias("precision"),
        _ratio(1.0 * tp, tp + fn).alias("recall"),
        _ratio(1.0 * (tp + tn), tp + fp + fn + tn).alias("accuracy"),
    )


def brier(score: Column, y: Column) -> Column:
    return F.avg((score - y) * (score - y))


def log_loss(score: Column, y: Column) -> Column:
    p = F.least(F.greatest(score, F.lit(EPS)), F.lit(1 - EPS))
    return F.avg(-F.when(y == 1, F.ln(p)).otherwise(F.ln(1 - p)))


def equal_bin(score: Column, bins: int = 15) -> Column:
    """Left-closed bins of equal width, the last one closed; edges are i * (1 / bins) doubles."""
    guess = F.floor(score * bins).cast("int")
    width = F.lit(1.0 / bins)
    # The product can land a hair off an edge: settle it against the edges themselves.
    up = F.when((guess + 1) * width <= score, guess + 1).otherwise(guess)
    down = F.when(up * width > score, up - 1).otherwise(up)
    return F.least(F.greatest(down, F.lit(0)), F.lit(bins - 1))


def calibration_error(df: DataFrame, score: str, y: str, bins: int = 15) -> DataFrame:
    per_bin = df.groupBy(equal_bin(F.col(score), bins).alias("bin")).agg(
        F.count("*").alias("n"),
        F.sum(F.col(y).cast("double")).alias("hits"), F.sum(score).alias("mass"),
    )
    gap = F.abs(F.col("hits") - F.col("mass"))
    return per_bin.agg((F.sum(gap) / F.sum("n")).alias("ece"))


def reliability(df: DataFrame, score: str, y: str, bins: int = 15) -> DataFrame:
    """Per right-closed bin: share of positives, mean score and count; empty bins are dropped."""
    width = F.lit(1.0 / bins)
    guess = F.ceil(F.col(score) * bins).cast("int") - 1
    up = F.when(F.col(score) > (guess + 1) * width, guess + 1).otherwise(guess)
    settled = F.when((up > 0) & (F.col(score) <= up * width), up - 1).otherwise(up)
    index = F.least(F.greatest(settled, F.lit(0)), F.lit(bins - 1))
    return df.groupBy(index.alias("bin")).agg(
        F.avg(F.col(y).cast("double")).alias("fraction_of_positives"),
        F.avg(score).alias("mean_predicted_value"), F.count("*").alias("n"),
    )


def confusion_matrix(df: DataFrame, score: str, y: str, threshold: float) -> DataFrame:
    return df.groupBy(
        F.col(y).alias("actual"), (F.col(score) >= threshold).cast("int").alias("predicted")
    ).agg(F.count("*").alias("n"))


def prediction_summary(df: DataFrame, score: str, y: str, threshold: float = 0.5, high: float = 0.7) -> DataFrame:
    c = confusion_counts(F.col(score), F.col(y), threshold)
    return df.agg(
        F.count("*").alias("n_samples"),
        F.avg(score).alias("mean_probability"), F.max(score).alias("max_probability"),
        F.min(score).alias("min_probability"),
        F.avg((F.col(score) >= threshold).cast("double")).alias("predicted_positive_rate"),
        F.avg(F.col(y).cast("double")).alias("actual_positive_rate"),
        c["tp"].alias("true_positives"), c["fn"].alias("false_negatives"),
        c["fp"].alias("false_positives"), c["tn"].alias("true_negatives"),
        F.count_if(F.col(score) >= high).alias("high_risk"),
    )


def threshold_sweep(df: DataFrame, score: str, y: str, low: float = 0.05, high: float = 0.95, step: float = 0.01) -> DataFrame:
    """F1 at every threshold low, low+step, ... below high.

    Each row is counted once, at the last threshold it reaches; counts at or above a threshold
    are then sums over at most ninety rows.
    """
    grid = [float(t) for t in np.arange(low, high, step)]
    thresholds = F.array(*[F.lit(t) for t in grid])
    # Binary search is not needed: the position is arithmetic, settled against the two edges.
    guess = F.floor((F.col(score) - low) / step).cast("int")
    last = len(grid) - 1
    guess = F.least(F.greatest(guess, F.lit(0)), F.lit(last))
    nxt = F.least(guess + 1, F.lit(last))
    reach = (
        F.when(F.col(score) >= F.get(thresholds, nxt), nxt)
        .when(F.col(score) >= F.get(thresholds, guess), guess)
        .otherwise(guess - 1)
    )
    counted = df.groupBy(reach.alias("i")).agg(
        F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) != 1).alias("neg")
    )
    # Thresholds no row stops at still get a row.
    scale = df.sparkSession.range(-1, len(grid)).select(F.col("id").cast("int").alias("i"))
    full = scale.join(counted, "i", "left").fillna(0)
    above = Window.partitionBy(F.lit(0)).orderBy(F.col("i").desc()).rowsBetween(
        Window.unboundedPreceding, 0
    )
    everything = Window.partitionBy(F.lit(0))
    out = full.select(
        "i", F.sum("pos").over(above).alias("tp"), F.sum("neg").over(above).alias("fp"),
        F.sum("pos").over(everything).alias("P"),
    )
    return out.filter("i >= 0").select(
        F.get(thresholds, F.col("i")).alias("threshold"),
        _ratio(2.0 * F.col("tp"), F.col("tp") + F.col("fp") + F.col("P")).alias("f1"),
    )


def best_threshold(sweep: DataFrame) -> DataFrame:
    """The first threshold with the best F1, or 0.5 when none is above zero."""
    best = F.max_by(F.struct("threshold", "f1"), F.struct(F.round("f1", 12), -F.col("threshold")))
    return sweep.agg(best.alias("b")).select(
        F.when(F.col("b.f1") > 0, F.col("b.threshold")).otherwise(0.5).alias("threshold"),
        F.col("b.f1").alias("f1"),
    )


def evaluate(df: DataFrame, score: str, y: str, threshold: float = 0.5) -> dict[str, float]:
    """The eight headline metrics as plain numbers: two passes over the scores."""
    c = confusion_counts(F.col(score), F.col(y), threshold)
    tp, fp, fn, tn = (c[k] for k in ("tp", "fp", "fn", "tn"))
    row = df.agg(
        _ratio(2.0 * tp, 2 * tp + fp + fn).alias("f1"),
        _ratio(1.0 * tp, tp + fp).alias("precision"),
        _ratio(1.0 * tp, tp + fn).alias("recall"),
        brier(F.col(score), F.col(y)).alias("brier_score"),
        log_loss(F.col(score), F.col(y)).alias("log_loss"),
    ).first().asDict()
    ranks = ranking(df, score, y).first().asDict()
    ece = calibration_error(df, score, y).first().asDict()
    return {**ranks, **row, **ece}


METRICS = ["auc_roc", "auc_pr", "f1", "precision", "recall", "brier_score", "ece", "log_loss"]


# --- bootstrap -------------------------------------------------------------------------------

def _weights(p: np.ndarray, label: np.ndarray, n: np.ndarray, b: int, seed: int) -> np.ndarray:
    """Resampled counts, one row per histogram row and one column per replicate. Each row has its
    own generator keyed by its content, so the draw does not depend on how rows are laid out."""
    out = np.empty((len(p), b))
    bits = np.ascontiguousarray(p, dtype=np.float64).view(np.uint64)
    for i in range(len(p)):
        key = [int(bits[i]), (seed << 1) | int(label[i])]
        out[i] = np.random.Generator(np.random.Philox(key=key)).poisson(n[i], b)
    return out


def bootstrap(
    df: DataFrame, score: str, y: str, replicates: int = 1000, threshold: float = 0.5,
    confidence: float = 0.95, seed: int = 42, rows_per_task: int = 4000,
) -> DataFrame:
    """Mean, percentile interval and deviation of each metric over resamples of the rows.

    A resample gives every histogram row a Poisson count (the usual large-sample stand-in for
    drawing with replacement). The histogram is cut into ordered blocks; a first pass totals the
    counts of each block per replicate, a second adds every block's part of the metrics given
    the totals below it. Work per task is ``rows_per_task`` x ``replicates`` numbers.
    """
    rows = df.groupBy(F.col(score).cast("double").alias("p"), (F.col(y) == 1).cast("int").alias("label")).agg(
        F.count("*").alias("n")
    )
    # Blocks hold whole score values: both labels of a value stay together.
    values = numbered(rows.select("p").distinct(), ["p"]).select(
        "p", F.floor(F.col("position") / rows_per_task).alias("block")
    )
    blocks = settle(rows.join(values, "p").select("block", "p", "label", "n"))

    def totals(pdf: pd.DataFrame) -> pd.DataFrame:
        w = _weights(pdf["p"].to_numpy(), pdf["label"].to_numpy(), pdf["n"].to_numpy(), replicates, seed)
        hit = pdf["label"].to_numpy()[:, None] == 1
        return pd.DataFrame({
            "block": int(pdf["block"].iloc[0]), "b": np.arange(replicates),
            "pos": (w * hit).sum(0), "neg": (w * ~hit).sum(0),
        })

    sums = blocks.groupBy("block").applyInPandas(totals, "block long, b int, pos double, neg double")
    sums = settle(sums)
    lower = Window.partitionBy("b").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("b")
    context = sums.select(
        "block", "b",
        F.coalesce(F.sum("pos").over(lower), F.lit(0.0)).alias("pos_before"),
        F.coalesce(F.sum("neg").over(lower), F.lit(0.0)).alias("neg_before"),
        F.sum("pos").over(whole).alias("P"), F.sum("neg").over(whole).alias("N"),
    )
    bins = 15
    schema = "b int, wins double, ap double, tp double, fp double, sq double, ll double, " + ", ".join(
        f"g{i} double" for i in range(bins)
    )

    def parts(pdf: pd.DataFrame, ctx: pd.DataFrame) -> pd.DataFrame:
        ctx = ctx.sort_values("b")
        pdf = pdf.sort_values(["p", "label"])
        p, label = pdf["p"].to_numpy(), pdf["label"].to_numpy()
        w = _weights(p, label, pdf["n"].to_numpy(), replicates, seed)
        starts = np.flatnonzero(np.r_[True, p[1:] != p[:-1]])
        value = p[starts]
        pos = np.add.reduceat(w * (label == 1)[:, None], starts, axis=0)
        neg = np.add.reduceat(w * (label != 1)[:, None], starts, axis=0)
        pos_before = ctx["pos_before"].to_numpy() + np.cumsum(pos, 0) - pos
        neg_before = ctx["neg_before"].to_numpy() + np.cumsum(neg, 0) - neg
        tp, fp = ctx["P"].to_numpy() - pos_before, ctx["N"].to_numpy() - neg_before
        seen = np.maximum(tp + fp, 1e-300)
        hit = (value >= threshold)[:, None]
        safe = np.clip(value, EPS, 1 - EPS)[:, None]
        v = value[:, None]
        out = {
            "b": ctx["b"].to_numpy(), "wins": (pos * (neg_before + neg / 2)).sum(0),
            "ap": (pos * tp / seen).sum(0), "tp": (pos * hit).sum(0), "fp": (neg * hit).sum(0),
            "sq": (pos * (1 - v) ** 2 + neg * v**2).sum(0),
            "ll": -(pos * np.log(safe) + neg * np.log(1 - safe)).sum(0),
        }
        edges = np.arange(bins + 1) * (1.0 / bins)
        index = np.clip(np.searchsorted(edges, value, side="right") - 1, 0, bins - 1)
        for i in range(bins):
            m = (index == i)[:, None]
            out[f"g{i}"] = ((pos - (pos + neg) * v) * m).sum(0)
        return pd.DataFrame(out)

    pieces = blocks.groupBy("block").cogroup(context.groupBy("block")).applyInPandas(parts, schema)
    classes = sums.groupBy("b").agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    names = [c.split()[0] for c in schema.split(", ")[1:]]
    per = pieces.groupBy("b").agg(*[F.sum(c).alias(c) for c in names]).join(classes, "b")
    per = per.filter((F.col("P") > 0) & (F.col("N") > 0))
    n = F.col("P") + F.col("N")
    gaps = sum((F.abs(f"g{i}") for i in range(bins)), F.lit(0.0))
    metrics = per.select(
        "b",
        (F.col("wins") / (F.col("P") * F.col("N"))).alias("auc_roc"),
        (F.col("ap") / F.col("P")).alias("auc_pr"),
        _ratio(2 * F.col("tp"), F.col("tp") + F.col("fp") + F.col("P")).alias("f1"),
        _ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        (F.col("tp") / F.col("P")).alias("recall"),
        (F.col("sq") / n).alias("brier_score"), (gaps / n).alias("ece"),
        (F.col("ll") / n).alias("log_loss"),
    )
    alpha = (1 - confidence) / 2
    long = metrics.unpivot(["b"], METRICS, "metric", "value")
    return long.groupBy("metric").agg(
        F.avg("value").alias("mean"),
        F.percentile("value", alpha).alias("lower"),
        F.percentile("value", 1 - alpha).alias("upper"),
        F.stddev_pop("value").alias("std"),
    )


def mcnemar(df: DataFrame, a: str, b: str, y: str, threshold: float = 0.5) -> dict:
    """Continuity-corrected test of two scores' disagreements, from one aggregate row."""
    right_a = (F.col(a) >= threshold).cast("int") == F.col(y)
    right_b = (F.col(b) >= threshold).cast("int") == F.col(y)
    row = df.agg(
        F.count_if(right_a & ~right_b).alias("b"), F.count_if(~right_a & right_b).alias("c")
    ).first()
    only_a, only_b = row["b"], row["c"]
    if only_a + only_b == 0:
        return {"only_a": 0, "only_b": 0, "chi2": 0.0, "p_value": 1.0, "significant": False}
    chi2 = (abs(only_a - only_b) - 1) ** 2 / (only_a + only_b)
    p = math.erfc(math.sqrt(chi2 / 2))
    return {"only_a": only_a, "only_b": only_b, "chi2": chi2, "p_value": p, "significant": p < 0.05}
