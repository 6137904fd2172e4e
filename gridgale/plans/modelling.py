"""Dataset preparation, ensembling and evaluation (M1-M6, M10-M14, M19, E*)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridgale.operators import dataset as ds
from gridgale.operators import ensemble as en
from gridgale.operators import evaluation as ev
from gridgale.operators import features as feat
from gridgale.operators.ordering import numbered
from gridgale.plans.base import Source, query, rounded, tidy
from gridgale.plans.features import _LABEL_SQL

# Labelled points: (cell, ts) is unique, as the split needs.
_LABELLED = f"SELECT cell, ts, target_outage AS y, target_max_outage_fraction AS x FROM ({_LABEL_SQL})"
_ROLES = ["weather", "points", "outages"]


def _labelled(s: Source) -> DataFrame:
    return feat.labels(s.points, s.outages).select(
        "cell", "ts", F.col("target_outage").alias("y"),
        F.col("target_max_outage_fraction").alias("x"),
    )


_SPLIT_SQL = f"""SELECT cell, ts, y, x, CASE WHEN rn < CAST(floor(n * 0.7) AS BIGINT) THEN 'train'
    WHEN rn < CAST(floor(n * 0.85) AS BIGINT) THEN 'val' ELSE 'test' END AS split
    FROM (SELECT *, row_number() OVER (ORDER BY ts, cell) - 1 AS rn, count(*) OVER () AS n
      FROM ({_LABELLED}))"""


@query("m1_temporal_split", rounded(_ROLES, f"SELECT cell, ts, split FROM ({_SPLIT_SQL})", []))
def m1_temporal_split(s: Source) -> DataFrame:
    return ds.temporal_split(_labelled(s)).select("cell", "ts", "split")


@query("m1_numbered", rounded(["weather"], """
    SELECT event_id, row_number() OVER (ORDER BY event_type, event_id) - 1 AS position FROM weather""", []))
def m1_numbered(s: Source) -> DataFrame:
    return numbered(s.weather.select("event_type", "event_id"), ["event_type", "event_id"]).drop("event_type")


@query("m2_standardise", rounded(_ROLES, f"""
    WITH r AS ({_SPLIT_SQL}), t AS (SELECT avg(x) AS mx, stddev_pop(x) AS sx, avg(y) AS my,
      stddev_pop(y) AS sy FROM r WHERE split = 'train')
    SELECT cell, ts, (x - mx) / sx AS x, (y - my) / sy AS y FROM r, t""", ["x", "y"]))
def m2_standardise(s: Source) -> DataFrame:
    rows = ds.temporal_split(_labelled(s))
    stats = ds.scaling(rows.filter("split = 'train'"), ["x", "y"])
    return tidy(ds.standardise(rows, stats).select("cell", "ts", "x", "y"))


@query("m3_class_weights", rounded(["scores"], """
    SELECT count(*) / (2.0E0 * count(*) FILTER (y = 0)) AS weight_0,
      count(*) / (2.0E0 * count(*) FILTER (y = 1)) AS weight_1 FROM scores""", ["weight_0", "weight_1"]))
def m3_class_weights(s: Source) -> DataFrame:
    return tidy(ds.class_weights(s.scores))


def _sequence_sql(part: str, order: str, key: str, source: str) -> str:
    p = f"PARTITION BY {part} " if part else ""
    return f"""SELECT {key} position, first_x, total_x, target FROM (
      SELECT *, row_number() OVER ({p}ORDER BY {order}) - 1 AS position,
        count(*) OVER ({p.strip()}) AS n, x AS first_x,
        sum(x) OVER ({p}ORDER BY {order} ROWS BETWEEN CURRENT ROW AND 23 FOLLOWING) AS total_x,
        last_value(y) OVER ({p}ORDER BY {order} ROWS BETWEEN CURRENT ROW AND 23 FOLLOWING) AS target
      FROM ({source})) WHERE position < n - 24"""


_SEQ_COLS = ["first_x", "total_x"]


def _flat(rows: DataFrame, *keys: str) -> DataFrame:
    total = F.aggregate("x", F.lit(0.0), lambda acc, v: acc + F.get(v, 0))
    return tidy(rows.select(
        *keys, "position", F.get(F.get("x", 0), 0).alias("first_x"), total.alias("total_x"), "target"
    ))


@query("m4_sequences", rounded(_ROLES, _sequence_sql("", "ts, cell", "", _LABELLED), _SEQ_COLS))
def m4_sequences(s: Source) -> DataFrame:
    return _flat(ds.sequences(_labelled(s), ["x", "y"], "y", ["ts", "cell"]))


@query("m4_sequences_per_cell", rounded(_ROLES, _sequence_sql("cell", "ts", "cell,", _LABELLED), _SEQ_COLS))
def m4_sequences_per_cell(s: Source) -> DataFrame:
    return _flat(ds.sequences(_labelled(s), ["x"], "y", ["ts"], partition_by=["cell"]), "cell")


@query("m5_summary", rounded(_ROLES, f"""
    SELECT count(*) AS total_samples, 138 AS n_features, avg(y) AS positive_rate,
      min(ts) AS start, max(ts) AS "end" FROM ({_LABELLED})""", ["positive_rate"]))
def m5_summary(s: Source) -> DataFrame:
    return tidy(ds.summary(_labelled(s), feat.FEATURES))


@query("m6_expanding_folds", rounded(_ROLES, " UNION ALL ".join(f"""
    SELECT {i} AS fold, '{part}' AS part, count(*) AS n, CAST(sum(y) AS BIGINT) AS positives,
      min(ts) AS first, max(ts) AS last FROM (SELECT *, row_number() OVER (ORDER BY ts, cell) - 1 AS rn,
      count(*) OVER () AS n FROM ({_LABELLED})) WHERE {cond}"""
    for i in range(5) for part, cond in (
        ("train", f"rn < n - {5 - i} * (n // 6)"),
        ("test", f"rn >= n - {5 - i} * (n // 6) AND rn < n - {4 - i} * (n // 6)"),
    )), []))
def m6_expanding_folds(s: Source) -> DataFrame:
    return ds.fold_summary(_labelled(s))


@query("m10_ensemble", rounded(["scores"], """
    SELECT l_orderkey, l_linenumber, (p_a + p_b) / 2 AS mean_score,
      p_a * 0.75 + p_b * 0.25 AS weighted_score FROM scores""", ["mean_score", "weighted_score"]))
def m10_ensemble(s: Source) -> DataFrame:
    return tidy(s.scores.select(
        "l_orderkey", "l_linenumber", en.mean_score(["p_a", "p_b"]).alias("mean_score"),
        en.weighted_score({"p_a": 3.0}, ["p_a", "p_b"]).alias("weighted_score"),
    ))


@query("m11_disagreement", rounded(["scores"], """
    SELECT l_orderkey, l_linenumber, abs(p_a - p_b) / 2 AS disagreement FROM scores""", ["disagreement"]))
def m11_disagreement(s: Source) -> DataFrame:
    return tidy(s.scores.select(
        "l_orderkey", "l_linenumber", en.disagreement(["p_a", "p_b"]).alias("disagreement")
    ))


@query("m12_uncertainty", rounded(["member_scores"], """
    WITH v AS (SELECT id, list_avg(mc) AS m, list_stddev_pop(mc) AS a, label / 10.0E0 AS x,
        0.5E0 AS y FROM (SELECT id, label, CAST(mc AS DOUBLE[]) AS mc FROM member_scores)),
      u AS (SELECT id, a AS aleatoric, abs(x - y) / 2 AS epistemic,
        sqrt(a * a + (x - y) * (x - y) / 4) AS total_std, 0.6 * (x + y) / 2 + 0.4 * m AS raw FROM v)
    SELECT id, aleatoric, epistemic, total_std, least(1.0, greatest(0.0, raw)) AS mean,
      least(1.0, greatest(0.0, raw - 1.96 * total_std)) AS ci_lower,
      least(1.0, greatest(0.0, raw + 1.96 * total_std)) AS ci_upper, 0.95E0 AS confidence_level FROM u""",
    ["aleatoric", "epistemic", "total_std", "mean", "ci_lower", "ci_upper"], 5))
def m12_uncertainty(s: Source) -> DataFrame:
    members = F.array(F.col("label") / 10.0, F.lit(0.5))
    out = en.with_uncertainty(s.member_scores, members, F.col("mc"), 0.95)
    return tidy(out.select(
        "id", "aleatoric", "epistemic", "total_std", "mean", "ci_lower", "ci_upper",
        "confidence_level",
    ), 5)


# The grid steps by the difference of its first two floats, as a float range does.
_SWEEP_SQL = """
    SELECT t AS threshold, CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0E0 * tp / (2 * tp + fp + fn) ELSE 0.0E0 END AS f1
    FROM (SELECT t, count(*) FILTER (p_b >= t AND y = 1) AS tp, count(*) FILTER (p_b >= t AND y = 0) AS fp,
      count(*) FILTER (p_b < t AND y = 1) AS fn FROM (SELECT p_b, y FROM scores),
      (SELECT 0.05E0 + i * ((0.05E0 + 0.01E0) - 0.05E0) AS t FROM (SELECT unnest(range(0, 90)) AS i)) GROUP BY t)"""


@query("m14_threshold_sweep", rounded(["scores"], _SWEEP_SQL, ["threshold", "f1"]))
def m14_threshold_sweep(s: Source) -> DataFrame:
    return tidy(ev.threshold_sweep(s.scores, "p_b", "y"))


@query("m14_best_threshold", rounded(["scores"], f"""
    SELECT threshold, f1 FROM ({_SWEEP_SQL}) ORDER BY round(f1, 12) DESC, threshold LIMIT 1""",
    ["threshold", "f1"]))
def m14_best_threshold(s: Source) -> DataFrame:
    return tidy(ev.best_threshold(ev.threshold_sweep(s.scores, "p_b", "y")))


# --- evaluation ----------------------------------------------------------------------------

_HIST = "SELECT {p} AS p, count(*) FILTER (y = 1) AS pos, count(*) FILTER (y = 0) AS neg FROM scores GROUP BY 1"
_CUM = """SELECT p, pos, neg, sum(pos) OVER (ORDER BY p DESC) AS tp, sum(neg) OVER (ORDER BY p DESC) AS fp,
    coalesce(sum(neg) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below,
    sum(pos) OVER () AS np, sum(neg) OVER () AS nn FROM ({h})"""


def _cum(p: str) -> str:
    return _CUM.format(h=_HIST.format(p=p))


@query("e1_auc_roc", rounded(["scores"], " UNION ALL ".join(f"""
    SELECT '{p}' AS score, sum(pos * (below + neg / 2.0E0)) / (max(np) * 1.0E0 * max(nn)) AS auc_roc
    FROM ({_cum(p)})""" for p in ("p_a", "p_b")), ["auc_roc"]))
def e1_auc_roc(s: Source) -> DataFrame:
    parts = [ev.ranking(s.scores, p, "y").select(F.lit(p).alias("score"), "auc_roc") for p in ("p_a", "p_b")]
    return tidy(parts[0].union(parts[1]))


@query("e2_average_precision", rounded(["scores"], " UNION ALL ".join(f"""
    SELECT '{p}' AS score, sum(pos * 1.0E0 / np * tp / (tp + fp)) AS auc_pr
    FROM ({_cum(p)})""" for p in ("p_a", "p_b")), ["auc_pr"]))
def e2_average_precision(s: Source) -> DataFrame:
    parts = [ev.ranking(s.scores, p, "y").select(F.lit(p).alias("score"), "auc_pr") for p in ("p_a", "p_b")]
    return tidy(parts[0].union(parts[1]))


@query("e3_threshold_metrics", rounded(["scores"], """
    SELECT 2.0E0 * tp / (2 * tp + fp + fn) AS f1, tp * 1.0E0 / (tp + fp) AS precision,
      tp * 1.0E0 / (tp + fn) AS recall, (tp + tn) * 1.0E0 / (tp + fp + fn + tn) AS accuracy FROM (
      SELECT count(*) FILTER (p_a >= 0.5 AND y = 1) AS tp, count(*) FILTER (p_a >= 0.5 AND y = 0) AS fp,
        count(*) FILTER (p_a < 0.5 AND y = 1) AS fn, count(*) FILTER (p_a < 0.5 AND y = 0) AS tn
      FROM scores)""", ["f1", "precision", "recall", "accuracy"]))
def e3_threshold_metrics(s: Source) -> DataFrame:
    return tidy(ev.threshold_metrics(s.scores, "p_a", "y", 0.5))


@query("e4_brier", rounded(["scores"], """
    SELECT avg((p_a - y) * (p_a - y)) AS brier_a, avg((p_b - y) * (p_b - y)) AS brier_b FROM scores""",
    ["brier_a", "brier_b"]))
def e4_brier(s: Source) -> DataFrame:
    y = F.col("y")
    return tidy(s.scores.agg(
        ev.brier(F.col("p_a"), y).alias("brier_a"), ev.brier(F.col("p_b"), y).alias("brier_b")
    ))


_CLIP = "least(greatest({p}, 1e-15), 1 - 1e-15)"


@query("e5_log_loss", rounded(["scores"], "SELECT " + ", ".join(
    f"avg(-CASE WHEN y = 1 THEN ln({_CLIP.format(p=p)}) ELSE ln(1 - {_CLIP.format(p=p)}) END) AS log_loss_{p[-1]}"
    for p in ("p_a", "p_b")) + " FROM scores", ["log_loss_a", "log_loss_b"], 5))
def e5_log_loss(s: Source) -> DataFrame:
    y = F.col("y")
    return tidy(s.scores.agg(
        ev.log_loss(F.col("p_a"), y).alias("log_loss_a"), ev.log_loss(F.col("p_b"), y).alias("log_loss_b")
    ), 5)


_EDGES = "(SELECT i, i * (1.0E0 / 15) AS lo, CASE WHEN i = 14 THEN 1.0E0 ELSE (i + 1) * (1.0E0 / 15) END AS hi" \
    " FROM (SELECT unnest(range(0, 15)) AS i))"


@query("e6_calibration_error", rounded(["scores"], " UNION ALL ".join(f"""
    SELECT '{p}' AS score, sum(n * abs(acc - conf)) / sum(n) AS ece FROM (
      SELECT e.i, count(*) AS n, avg(y) AS acc, avg({p}) AS conf FROM scores JOIN {_EDGES} e
      ON {p} >= e.lo AND ({p} < e.hi OR (e.i = 14 AND {p} <= e.hi)) GROUP BY e.i)"""
    for p in ("p_a", "p_b")), ["ece"]))
def e6_calibration_error(s: Source) -> DataFrame:
    parts = [
        ev.calibration_error(s.scores, p, "y").select(F.lit(p).alias("score"), "ece")
        for p in ("p_a", "p_b")
    ]
    return tidy(parts[0].union(parts[1]))


@query("e7_reliability", rounded(["scores"], f"""
    SELECT CAST(e.i AS INT) AS bin, avg(y) AS fraction_of_positives, avg(p_b) AS mean_predicted_value,
      count(*) AS n FROM scores JOIN {_EDGES} e ON (p_b > e.lo OR e.i = 0) AND p_b <= e.hi GROUP BY 1""",
    ["fraction_of_positives", "mean_predicted_value"]))
def e7_reliability(s: Source) -> DataFrame:
    return tidy(ev.reliability(s.scores, "p_b", "y"))


_ROC = f"SELECT p AS threshold, tp * 1.0E0 / np AS tpr, fp * 1.0E0 / nn AS fpr FROM ({_cum('p_b')})"


@query("e8_roc_points", rounded(["scores"], _ROC, ["threshold", "tpr", "fpr"]))
def e8_roc_points(s: Source) -> DataFrame:
    return tidy(ev.roc_points(*ev.curve(s.scores, "p_b", "y")))


@query("e8_youden", rounded(["scores"], f"""
    SELECT threshold, tpr - fpr AS youden_j FROM ({_ROC})
    ORDER BY round(tpr - fpr, 12) DESC, threshold DESC LIMIT 1""", ["threshold", "youden_j"]))
def e8_youden(s: Source) -> DataFrame:
    return tidy(ev.best_youden(ev.roc_points(*ev.curve(s.scores, "p_b", "y"))))


@query("e9_confusion_matrix", rounded(["scores"], """
    SELECT y AS actual, CASE WHEN p_a >= 0.39 THEN 1 ELSE 0 END AS predicted, count(*) AS n
    FROM scores GROUP BY 1, 2""", []))
def e9_confusion_matrix(s: Source) -> DataFrame:
    return ev.confusion_matrix(s.scores, "p_a", "y", 0.39)


@query("e9_prediction_summary", rounded(["scores"], """
    SELECT count(*) AS n_samples, avg(p_a) AS mean_probability, max(p_a) AS max_probability,
      min(p_a) AS min_probability, avg(CASE WHEN p_a >= 0.5 THEN 1.0E0 ELSE 0.0E0 END)
        AS predicted_positive_rate, avg(y) AS actual_positive_rate,
      count(*) FILTER (p_a >= 0.5 AND y = 1) AS true_positives,
      count(*) FILTER (p_a < 0.5 AND y = 1) AS false_negatives,
      count(*) FILTER (p_a >= 0.5 AND y = 0) AS false_positives,
      count(*) FILTER (p_a < 0.5 AND y = 0) AS true_negatives,
      count(*) FILTER (p_a >= 0.7E0) AS high_risk FROM scores""",
    ["mean_probability", "max_probability", "min_probability", "predicted_positive_rate",
     "actual_positive_rate"]))
def e9_prediction_summary(s: Source) -> DataFrame:
    return tidy(ev.prediction_summary(s.scores, "p_a", "y"))


@query("e10_bootstrap")
def e10_bootstrap(s: Source) -> DataFrame:
    return ev.bootstrap(s.scores, "p_b", "y")


@query("e11_mcnemar", rounded(["scores"], """
    SELECT b AS only_a, c AS only_b, (abs(b - c) - 1) * (abs(b - c) - 1) * 1.0E0 / (b + c) AS chi2 FROM (
      SELECT count(*) FILTER (a = 1 AND bb = 0) AS b, count(*) FILTER (a = 0 AND bb = 1) AS c FROM (
        SELECT CASE WHEN (p_a >= 0.5) = (y = 1) THEN 1 ELSE 0 END AS a,
          CASE WHEN (p_b >= 0.5) = (y = 1) THEN 1 ELSE 0 END AS bb FROM scores))""", ["chi2"]))
def e11_mcnemar(s: Source) -> DataFrame:
    r = ev.mcnemar(s.scores, "p_a", "p_b", "y")
    return tidy(s.spark.createDataFrame(
        [(r["only_a"], r["only_b"], float(r["chi2"]))], "only_a long, only_b long, chi2 double"
    ))
