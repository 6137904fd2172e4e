"""Near-duplicate documents: bottom-k sketches of one hash function, verified on full shingle sets.

A document's set holds the 64-bit hashes of its distinct five-word shingles; the ``K`` smallest are its
sketch. Two documents are linked when 100 * intersection >= ``PERCENT`` * union of the full sets.

1. Documents with equal sets become one class, stood for by its smallest id; only these go on.
2. Inverted lists of the retained values: a value in up to ``FREQUENT`` sketches pairs its documents. A link
   needs ``_needed`` shared retained values, so each document is listed only under its rarest ones, as many as
   one of which must be shared; how far down the lists two documents first meet ends most pairs that cannot
   share enough before their sketches are fetched.
3. Longer lists are not paired out. A link needs ``_needed`` shared retained values, so a document with
   fewer frequent ones meets each partner in a short list. The rest (large groups of near copies, texts
   made of common passages) is linked to one pivot per long list, the document that shares most; then
   only pairs that the links so far leave in different components are formed, by prefix filtering of
   their full sets, rarest shingles first. So no pair is lost and no large group is paired with itself.
4. Pairs whose union sketch estimates less than ``LEAST`` are dropped: at a true 0.75 the estimate of
   64 values is 0.75 +- 0.054, so that one link in a few hundred thousand at the very edge could be
   missed, and practically none above 0.8. Sets of up to ``K`` shingles are estimated exactly.
5. The others are verified on their full sets, and components follow from the links.

Everything is DataFrame work. Shuffled per document: at most ``K`` hashes, and the full set of those
only that are in a surviving pair.

Defined cases: null and empty texts and those without words have no shingles and no links; rows with one
``doc_id`` are one node, so repeated rows share their result; a row without ``doc_id`` is linked only to
equal texts (its component is theirs, else null, and then it is kept); extra columns are ignored.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridgale.llm.common import id_and_text, staged, table
from gridgale.llm.components import components, extended

WORDS, K, PERCENT = 5, 64, 75
FREQUENT, LEAST, STEP, HOT_VALUES = 64, 0.5, 1.1, 10_000
SENT_IDS = 4_000_000


def with_words(docs: DataFrame, name: str = "_words") -> DataFrame:
    """Add the words of ``text``: A-Z lower-cased, split at ASCII white space only."""
    lowered = F.translate(F.coalesce("text", F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return docs.withColumn(name, F.array_remove(F.split(lowered, r"[\x20\x09-\x0D]+"), ""))


def _shingle_hashes(words: str) -> Column:
    """One hash per place; a sequence shorter than a shingle has one place (nulls past its end don't count)."""
    at = F.transform(
        words, lambda w, i: F.xxhash64(w, *[F.get(F.col(words), i + d) for d in range(1, WORDS)])
    )
    return F.slice(at, 1, F.greatest(F.size(words) - (WORDS - 1), F.least(F.size(words), F.lit(1))))


def shingle_sets(docs: DataFrame) -> DataFrame:
    """(doc_id, items): sorted distinct shingle hashes."""
    hashed = with_words(docs).select("doc_id", _shingle_hashes("_words").alias("_at"))
    return hashed.select("doc_id", F.sort_array(F.array_distinct("_at")).alias("items"))


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, two hashes of the whole set, sketch)."""
    return shingle_sets(docs).select(
        "doc_id", F.size("items").cast("long").alias("n_shingles"),
        F.xxhash64("items").alias("h1"), F.xxhash64(F.lit(1), "items").alias("h2"),
        F.slice("items", 1, K).alias("sketch"),
    )


def _needed(n: Column) -> Column:
    """Retained values that a document of ``n`` shingles shares with any partner: exact for whole sets
    (the partner may be cut), else what the estimate asks for."""
    return F.when(n <= K, F.ceil(F.least(n * PERCENT / 100, K - n / 3) - 1e-9)).otherwise(F.lit(int(LEAST * K)))


def _fits(n: str, other: str) -> Column:
    return F.least(n, other) * 100 >= F.greatest(n, other) * PERCENT


def _retained(entries: DataFrame, documents: int) -> DataFrame:
    """Per document with retained values that others have too: those values with their document counts, rarest
    first. Values of very many documents, at most ``HOT_VALUES`` whatever the corpus (all documents together have
    ``documents`` * ``K`` entries), are broadcast, so that no task gets all entries of one."""
    counts = staged(entries.groupBy("value").agg(F.count("*").alias("df")).where("df > 1"), "value-counts")
    hot = F.col("df") >= max(FREQUENT + 1, math.ceil(documents * K / HOT_VALUES))
    met = entries.join(F.broadcast(counts.where(hot)), "value", "left")
    known = met.where("df IS NOT NULL").unionByName(met.where("df IS NULL").drop("df").join(counts.where(~hot), "value"))
    return known.groupBy("doc_id", "n_shingles").agg(F.sort_array(F.collect_list(F.struct("df", "value"))).alias("items"))


def _pairs_of_short_lists(retained: DataFrame) -> DataFrame:
    """Pairs that can share enough retained values. In the common order, rarest first, a document shares one of
    its first (values - needed + 1) with each partner, so only those are listed; and after the first value that
    two documents share, enough must be left in both."""
    size, needed = F.size("items"), F.col("needed")
    first = F.slice("items", 1, F.greatest(size - needed + 1, F.lit(0)).cast("int"))
    listed = retained.withColumn("_size", size).select(
        "doc_id", "n_shingles", "needed", "_size", F.posexplode(first).alias("at", "item")
    ).where(F.col("item.df") <= FREQUENT)
    lists = listed.groupBy(F.col("item.value").alias("value")).agg(F.collect_list(F.struct(
        "doc_id", F.col("n_shingles").alias("n"), "needed", (F.col("_size") - F.col("at")).alias("left")
    )).alias("members")).where(F.size("members") > 1)
    met = lists.select("members", F.explode("members").alias("a")).select("a", F.explode("members").alias("b"))
    met = met.where((F.col("a.doc_id") < F.col("b.doc_id")) & _fits("a.n", "b.n"))
    pairs = met.groupBy(F.col("a.doc_id").alias("u"), F.col("b.doc_id").alias("v")).agg(
        F.max(F.least("a.left", "b.left")).alias("left"), F.max(F.greatest("a.needed", "b.needed")).alias("needed"),
    )
    return pairs.where("left >= needed").select("u", "v")


def _stars_of_long_lists(lists: DataFrame) -> DataFrame:
    """Each document of a long list with the list's pivot."""
    pivots = lists.groupBy("value").agg(
        F.max(F.struct("weight", (-F.col("doc_id")).alias("minus"), F.col("n_shingles").alias("nv"))).alias("p")
    ).select("value", (-F.col("p.minus")).alias("v"), "p.nv")
    met = lists.join(pivots, "value").where((F.col("doc_id") != F.col("v")) & _fits("n_shingles", "nv"))
    return met.select(F.least("doc_id", "v").alias("u"), F.greatest("doc_id", "v").alias("v")).distinct()


def _bucket(n: Column) -> Column:
    return F.floor(F.log(n.cast("double")) / math.log(STEP)).cast("int")


def _prefixes(sets: DataFrame) -> DataFrame:
    """(key, doc_id, n, met, rank): the rarest shingles of each set, as many as a link needs one of to be shared;
    ``met`` counts those that any other set has.

    A link with a set of size m shares t/(1+t) * (n + m) shingles, so two sets must meet within their
    first n + 1 - that in a common order; partners of similar size (one bucket) share a key.
    """
    sized = sets.withColumn("n", F.size("items").cast("long"))
    items = sized.select("doc_id", "n", F.explode("items").alias("value"))
    counts = items.groupBy("value").agg(F.count("*").alias("df"))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy("df", "value"))
    ranked = items.join(counts, "value").withColumns({
        "_rank": rank, "met": F.count_if(F.col("df") > 1).over(Window.partitionBy("doc_id")),
    }).where("df > 1")
    own, share = _bucket(F.col("n")), PERCENT / 100
    for_sizes = ranked.withColumns({"own": own, "other": F.explode(
        F.sequence(_bucket(F.greatest(F.floor(F.col("n") * share), F.lit(1))), _bucket(F.ceil(F.col("n") / share)))
    )})
    least = F.greatest(F.floor(F.pow(F.lit(STEP), F.col("other"))) - 1, F.ceil(F.col("n") * share - 1e-9))
    needed = F.ceil((F.col("n") + least) * (share / (1 + share)) - 1e-9)
    kept = for_sizes.where(F.col("_rank") <= F.col("n") - needed + 1)
    return kept.select(
        F.struct("value", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b")).alias("key"),
        "doc_id", "n", "met", F.col("_rank").alias("rank"),
    )


def _can_meet(u: dict[str, str], v: dict[str, str]) -> Column:
    """Whether sets (or the best of two groups) can share enough for a link, the shingle at hand first:
    it must stand early enough in both, and enough shingles must be in other sets too."""
    needed = F.ceil((F.col(u["least"]) + F.col(v["least"])) * (PERCENT / (100 + PERCENT)) - 1e-9)
    ok = F.least(u["met"], v["met"]) >= needed
    for side in (u, v):
        ok &= F.col(side["rank"]) <= F.col(side["most"]) - needed + 1
    return ok


def _sided(df: DataFrame, side: str) -> DataFrame:
    return df.select("key", *[F.col(c).alias(c + side) for c in df.columns if c != "key"])


def _pairs_across(sets: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs that may be links and whose documents are in different components so far."""
    placed = _prefixes(sets).join(
        roots.select(F.col("node").alias("doc_id"), "root"), "doc_id", "left"
    ).withColumn("root", F.coalesce("root", "doc_id"))
    placed = staged(placed, "prefixes")
    open_ = placed.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a != b")
    placed = staged(placed.join(open_.select("key"), "key"), "across")
    groups = placed.groupBy("key", "root").agg(
        F.count("*").alias("size"), F.min("n").alias("least"), F.max("n").alias("most"),
        F.max("met").alias("met"), F.min("rank").alias("rank"),
    )
    # Components first, then documents: the smaller side of two components is spread out before the larger.
    names = ("least", "most", "met", "rank")
    met = _sided(groups, "_u").join(_sided(groups, "_v"), "key").where(
        (F.col("root_u") < F.col("root_v")) & _can_meet({c: c + "_u" for c in names}, {c: c + "_v" for c in names})
    )
    first = F.col("size_u") <= F.col("size_v")
    met = met.select(
        "key", F.when(first, F.col("root_u")).otherwise(F.col("root_v")).alias("root_s"),
        F.when(first, F.col("root_v")).otherwise(F.col("root_u")).alias("root_l"),
    )
    small, large = _sided(placed, "_s"), _sided(placed, "_l")
    sides = [{"least": "n" + x, "most": "n" + x, "met": "met" + x, "rank": "rank" + x} for x in ("_s", "_l")]
    pairs = met.join(small, ["key", "root_s"]).join(large, ["key", "root_l"]).where(
        _fits("n_s", "n_l") & _can_meet(*sides)
    )
    return pairs.select(
        F.least("doc_id_s", "doc_id_l").alias("u"), F.greatest("doc_id_s", "doc_id_l").alias("v")
    ).distinct()


def _only(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows with one of ``ids`` (column doc_id). Up to ``SENT_IDS`` ids are counted and broadcast, so that the
    wide rows don't move; more of them meet the rows in a shuffle."""
    ids = staged(ids.distinct(), "ids")
    few = ids.count() <= SENT_IDS
    return rows.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")


def _in_pairs(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("u", "v")).alias("doc_id"))


def _likely(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """Pairs whose union sketch estimates at least LEAST."""
    own = staged(_only(reps, _in_pairs(pairs)).dropDuplicates(["doc_id"]), "pair-sketches")
    a = own.select(F.col("doc_id").alias("u"), F.col("sketch").alias("su"))
    b = own.select(F.col("doc_id").alias("v"), F.col("sketch").alias("sv"))
    met = pairs.join(a, "u").join(b, "v").withColumn(
        "_union", F.slice(F.sort_array(F.array_union("su", "sv")), 1, K)
    )
    both = F.size(F.array_intersect(F.array_intersect("su", "sv"), F.col("_union")))
    return met.where(both >= F.size("_union") * LEAST).select("u", "v")


def verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Pairs (u, v) that are links on their full sets; only documents in a pair are shingled again."""
    sets = staged(shingle_sets(_only(docs, _in_pairs(pairs))), "sets")
    met = pairs.join(sets.select(F.col("doc_id").alias("u"), F.col("items").alias("iu")), "u").join(
        sets.select(F.col("doc_id").alias("v"), F.col("items").alias("iv")), "v"
    ).withColumn("_both", F.size(F.array_intersect("iu", "iv")))
    return met.where(
        F.col("_both") * 100 >= (F.size("iu") + F.size("iv") - F.col("_both")) * PERCENT
    ).select("u", "v").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row per row of ``docs``."""
    texts = id_and_text(docs)
    made = staged(sketches(texts), "sketches")
    classes = made.where("n_shingles > 0").groupBy("n_shingles", "h1", "h2").agg(F.min("doc_id").alias("rep"))
    members = staged(
        made.join(classes, ["n_shingles", "h1", "h2"], "left").select(
            "doc_id", "n_shingles", F.coalesce("rep", "doc_id").alias("rep"),
            F.when(F.col("doc_id") == F.col("rep"), F.col("sketch")).alias("sketch"),
        ), "members",
    )
    reps = members.where("sketch IS NOT NULL").select("doc_id", "sketch")

    entries = members.where("sketch IS NOT NULL").select(
        "doc_id", "n_shingles", F.explode("sketch").alias("value")
    )
    retained = staged(_retained(entries, members.count()).withColumn("needed", _needed(F.col("n_shingles"))), "retained")
    frequent = F.filter("items", lambda x: x["df"] > FREQUENT)
    hard = retained.select(
        "doc_id", "n_shingles", frequent.alias("_long"), "needed",
    ).where(F.size("_long") >= F.col("needed")).select(
        "doc_id", "n_shingles", F.aggregate("_long", F.lit(0).cast("long"), lambda n, x: n + x["df"]).alias("weight"),
        F.explode("_long.value").alias("value"),
    )
    pairs = _pairs_of_short_lists(retained).union(_stars_of_long_lists(hard)).distinct()
    links = verified(staged(_likely(staged(pairs, "candidates"), reps), "pairs"), texts)
    links = staged(links, "links")
    roots = components(links)
    sets = staged(shingle_sets(_only(texts, hard.select("doc_id")).distinct()), "sets")
    more = staged(_likely(staged(_pairs_across(sets, roots), "candidates-across"), reps), "pairs-across")
    if not more.isEmpty():
        roots = extended(roots, verified(more, texts))
    out = members.select("doc_id", "n_shingles", "rep").join(
        roots.withColumnRenamed("node", "rep"), "rep", "left"
    ).select("doc_id", "n_shingles", F.coalesce("root", "rep").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))


def deduplicated(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each group; of rows with one ``doc_id``, one stays."""
    gone = near_duplicates(docs).where("NOT kept").select("doc_id").distinct()
    without_id = docs.where("doc_id IS NULL")
    left = docs.where("doc_id IS NOT NULL").join(gone, "doc_id", "left_anti")
    return left.dropDuplicates(["doc_id"]).unionByName(without_id.dropDuplicates(["text"])).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
sets AS (
  SELECT doc_id, list_distinct(CASE
    WHEN len(ws) = 0 THEN []
    WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS items
  FROM w),
items AS (SELECT doc_id, len(items) AS n, unnest(items) AS item FROM sets),
pairs AS (
  SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS inter, any_value(a.n) AS nu, any_value(b.n) AS nv
  FROM items a JOIN items b ON a.item = b.item AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT u, v FROM pairs WHERE 100 * inter >= 75 * (nu + nv - inter)),
ways AS (SELECT u, v FROM links UNION ALL SELECT v, u FROM links),
reach(node, other) AS (
  SELECT u, v FROM ways
  UNION
  SELECT r.node, e.v FROM reach r JOIN ways e ON r.other = e.u),
roots AS (SELECT node, least(node, min(other)) AS root FROM reach GROUP BY node)
SELECT s.doc_id, CAST(len(s.items) AS BIGINT) AS n_shingles,
  coalesce(r.root, s.doc_id) AS component_id, s.doc_id = coalesce(r.root, s.doc_id) AS kept
FROM sets s LEFT JOIN roots r ON r.node = s.doc_id
"""
