"""Document quality: a text classifier's evidence combined with host and path posteriors.

1. ``learn`` fits a logistic regression on a bounded hash sample of labelled documents (``SAMPLE``):
   words that at least ``MIN_DOCS`` sampled texts hold (up to ``VOCABULARY``), and shares of capitals,
   signs and repeated words. A document is good when its quality label is 1 and it isn't toxic.
2. Over all documents, grouped sums give each host (``source``) and each path (``lang`` within the host)
   its number of documents and its sum of probabilities.
3. Hosts are shrunk to the global mean and paths to their host: a beta prior whose strength comes from
   the spread between sites (method of moments), so a sparse site says little beyond what is above it.
4. A document's posterior odds are its own evidence times the odds of its path without itself.

The sums are pre-aggregated, so a host with a third of all rows costs one row per task; sites are joined
by key, and Spark broadcasts them only when they are small. Texts are never shuffled. ``scores`` writes the
evidence once, without texts; ``accepted`` computes it once for the sums and once for the answer, which costs
less than to write the rows.

Defined cases: a null text counts as empty; null host or path are sites of their own; documents without
labels are scored like others; repeated rows each get a row; without both classes among the labels there
is no evidence and everything is kept; extra columns are kept by ``accepted`` and ignored by ``scores``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridgale.llm.common import hash_sample, staged, table

SAMPLE, VOCABULARY, MIN_DOCS = 12_000, 20_000, 4
REGULAR, ROUNDS = 0.002, 60
WEAKEST, STRONGEST = 2.0, 10_000.0
KEEP = 0.5
_EDGE = 1e-6
_SHARES = ["_capitals", "_signs", "_repeats", "_length"]


@dataclass(frozen=True)
class Model:
    pipeline: PipelineModel | None
    prior: float  # share of good documents in the sample


def _featured(docs: DataFrame) -> DataFrame:
    """``docs`` needs ``_text``; adds the words and the shares."""
    text = F.col("_text")
    size = F.length(text) + 1
    cased = docs.withColumns({
        "_plain": F.regexp_replace(text, r"[^\p{L}\s]+", ""),
        "_capitals": F.length(F.regexp_replace(text, r"[^\p{Lu}]+", "")) / size,
    })
    worded = cased.withColumn("_words", F.array_remove(F.split(F.lower("_plain"), r"\s+"), ""))
    return worded.withColumns({
        "_signs": F.length(F.regexp_replace(text, r"[\p{L}\p{N}\s]+", "")) / size,
        "_repeats": 1 - F.size(F.array_distinct("_words")) / (F.size("_words") + 1),
        "_length": F.log1p(F.length(text).cast("double")) / 10,
    })


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(_EDGE)), F.lit(1 - _EDGE))
    return F.log(p / (1 - p))


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, seed: int = 5) -> Model:
    good = (F.coalesce(F.min("quality"), F.lit(1)) >= 1) & (F.coalesce(F.max("toxic"), F.lit(0)) < 1)
    known = labels.where("doc_id IS NOT NULL AND (quality IS NOT NULL OR toxic IS NOT NULL)").groupBy("doc_id").agg(
        good.cast("double").alias("_good")
    )
    ids = hash_sample(known, sample, seed)
    rows = staged(
        docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_text"))
        .join(F.broadcast(ids), "doc_id").dropDuplicates(["doc_id"]).join(known, "doc_id"), "labelled",
    )  # at most ``sample`` rows
    n, s = rows.agg(F.count("*"), F.sum("_good")).first()
    if not n or s in (0, n):
        return Model(None, 1.0)
    words = CountVectorizer(inputCol="_words", outputCol="_bag", vocabSize=VOCABULARY, minDF=MIN_DOCS, binary=True)
    featured = _featured(rows)
    try:
        counted = words.fit(featured)
    except Exception as e:  # too few texts for a shared word
        if "vocabulary size should be > 0" not in str(e):
            raise
        counted = None
    gather = VectorAssembler(inputCols=[*_SHARES, *(["_bag"] if counted else [])], outputCol="_features")
    stages = [*([counted] if counted else []), gather]
    ready = PipelineModel(stages).transform(featured)
    fitted = LogisticRegression(
        featuresCol="_features", labelCol="_good", probabilityCol="_probability", rawPredictionCol="_raw",
        predictionCol="_prediction", regParam=REGULAR, maxIter=ROUNDS, standardization=False,
    ).fit(ready)
    return Model(PipelineModel([*stages, fitted]), s / n)


def evidence(docs: DataFrame, model: Model) -> DataFrame:
    """Add ``_p`` to ``docs`` (which has ``_text``): the probability, from the text alone, that it is good."""
    if model.pipeline is None:
        return docs.withColumn("_p", F.lit(model.prior))
    scored = model.pipeline.transform(_featured(docs))
    return scored.select(*docs.columns, vector_to_array("_probability")[1].alias("_p"))


def _strength(mean: float, spread: float | None) -> float:
    """Pseudo-documents of a beta prior with this mean and this variance between sites."""
    if not spread or spread <= 0:
        return STRONGEST
    return min(max(mean * (1 - mean) / spread - 1, WEAKEST), STRONGEST)


def _between(sites: DataFrame, mean: Column) -> float | None:
    """Variance of the sites' means around ``mean`` beyond what their sizes explain."""
    off = (F.col("s") / F.col("n") - mean) ** 2 - mean * (1 - mean) / F.col("n")
    row = sites.agg((F.sum(F.col("n") * off) / F.sum("n")).alias("v")).first()
    return row["v"]


def posteriors(sums: DataFrame) -> tuple[DataFrame, float]:
    """From (host, path, n, s): each path's n, s, its host's posterior mean and the prior's strength."""
    row = sums.agg(F.sum("s"), F.sum("n")).first()
    mean = row[0] / row[1] if row[1] else 1.0
    hosts = sums.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    k = _strength(mean, _between(hosts, F.lit(mean)))
    hosts = hosts.select(
        "host", ((F.col("s") + F.lit(k * mean)) / (F.col("n") + F.lit(k))).alias("host_quality")
    )
    paths = sums.join(hosts.withColumnRenamed("host", "_host"), F.col("host").eqNullSafe(F.col("_host"))).drop("_host")
    k = _strength(mean, _between(paths, F.col("host_quality")))
    # Written out, so that the size check that decides on broadcasting sees how small it is.
    return staged(paths.withColumn("strength", F.lit(k)), "sites"), mean


def _judged(with_p: DataFrame) -> DataFrame:
    """``with_p`` (with _host, _path and the evidence _p) and host_quality, _site, _quality, _kept."""
    sums = staged(
        with_p.groupBy(F.col("_host").alias("host"), F.col("_path").alias("path")).agg(
            F.count("*").alias("n"), F.sum(F.round("_p", 9).cast("decimal(20,9)")).cast("double").alias("s")
        ), "sites",
    )
    paths, mean = posteriors(sums)
    met = with_p.join(
        paths, F.col("_host").eqNullSafe(F.col("host")) & F.col("_path").eqNullSafe(F.col("path"))
    )
    rest = (F.col("s") - F.col("_p") + F.col("strength") * F.col("host_quality")) / (F.col("n") - 1 + F.col("strength"))
    met = met.withColumn("_site", rest)
    quality = 1 / (1 + F.exp(-(_logit(F.col("_p")) + _logit(F.col("_site")) - _logit(F.lit(mean)))))
    return met.withColumn("_quality", quality).withColumn("_kept", F.col("_quality") >= KEEP)


def _prepared(docs: DataFrame, host: str, path: str) -> DataFrame:
    """The row as one column, out of the way of its names."""
    return docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.coalesce("text", F.lit("")).alias("_text"),
        F.col(host).alias("_host"), F.col(path).alias("_path"),
    )


def scores(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang") -> DataFrame:
    """(doc_id, p_text, host_quality, path_quality, quality, kept), one row per document."""
    rows = docs.select(
        F.col("doc_id").alias("_doc_id"), F.coalesce("text", F.lit("")).alias("_text"),
        F.col(host).alias("_host"), F.col(path).alias("_path"),
    )
    return _judged(staged(evidence(rows, learn(docs, labels)).drop("_text"), "evidence")).select(
        F.col("_doc_id").alias("doc_id"), F.col("_p").alias("p_text"), "host_quality", F.col("_site").alias("path_quality"),
        F.col("_quality").alias("quality"), F.col("_kept").alias("kept"),
    )


def accepted(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang") -> DataFrame:
    """The rows of ``docs`` that are kept."""
    return _judged(evidence(_prepared(docs, host, path), learn(docs, labels))).where("_kept").select("_row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
