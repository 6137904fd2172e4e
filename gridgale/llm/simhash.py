"""Document fingerprints: 64-bit SimHash over word pairs, and a complete search within a Hamming radius.

Each word pair (a single word where there is no pair) votes with its 64 hash bits, weighted by how often
it occurs. Votes are counted by grouped sums: a long holds the counts of two bits, so 32 sums count all
64, and a whole document meets in one row before anything is shuffled. Everything is DataFrame work.

The edited text of a document needs the start of the next one by ``doc_id``. The order comes from a range
partition of the ids alone; each text is shuffled once, and of the next text only as much as is wanted.

``within_radius`` splits fingerprints into ``RADIUS`` + 3 blocks and keeps a table for every choice of
three of them, ordered by these blocks: two fingerprints within the radius leave at least three blocks
untouched, so they share a key in some table and none is missed.

Defined cases: a null text counts as empty, and an empty text has the fingerprint of the empty word; rows
that agree in ``doc_id`` and text are returned once; of rows with one ``doc_id`` and different texts each
is returned, and to the document before them they lend the smallest prefix and fingerprint; a row without
``doc_id`` has no next document: its edited text loses its end, and near_next is null; the only document
is its own next; extra columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridgale.llm.common import id_and_text, staged, table

BITS, RADIUS, SHARED = 64, 3, 3
_LANES = BITS // 2
_LANE_MASK = (1 << 32) + 1


def _pair_hashes(words: str) -> Column:
    at = F.transform(words, lambda w, i: F.xxhash64(w, F.get(F.col(words), i + 1)))
    return F.slice(at, 1, F.greatest(F.size(words) - 1, F.lit(1)))


def fingerprints(texts: DataFrame, keys: list[str]) -> DataFrame:
    """``keys`` and ``fingerprint`` (a long) of each row's ``text``; rows with equal keys must be equal."""
    words = texts.select(*keys, F.split(F.lower("text"), r"\s+").alias("_words"))
    terms = words.select(*keys, F.explode(_pair_hashes("_words")).alias("_hash"))
    lanes = [
        F.sum(F.shiftrightunsigned("_hash", i).bitwiseAND(F.lit(_LANE_MASK))).alias(f"_lane{i}") for i in range(_LANES)
    ]
    votes = terms.groupBy(*keys).agg(F.count("*").alias("_all"), *lanes)
    bits = []
    for i in range(_LANES):
        low = F.col(f"_lane{i}").bitwiseAND(F.lit((1 << 32) - 1))
        high = F.shiftrightunsigned(f"_lane{i}", 32)
        bits += [F.shiftleft((2 * low > F.col("_all")).cast("long"), i),
                 F.shiftleft((2 * high > F.col("_all")).cast("long"), i + 32)]
    value = bits[0]
    for b in bits[1:]:
        value = value.bitwiseOR(b)
    return votes.select(*keys, value.alias("fingerprint"))


def following(ids: DataFrame) -> DataFrame:
    """(doc_id, next_id, ...) for distinct ids in ascending order, the first after the last.

    Ids are range-partitioned; the last of a part takes the first of the next part, found over one row
    per part.
    """
    ranged = staged(
        ids.repartitionByRange("doc_id").withColumn("_part", F.spark_partition_id()), "ranged"
    )
    parts = ranged.groupBy("_part").agg(F.min("doc_id").alias("_first"))
    after = parts.select("_part", F.coalesce(
        F.lead("_first").over(Window.orderBy("_part")), F.min("_first").over(Window.partitionBy())
    ).alias("_after"))
    inside = ranged.withColumn("_next", F.lead("doc_id").over(Window.partitionBy("_part").orderBy("doc_id")))
    return inside.join(after, "_part").withColumn("next_id", F.coalesce("_next", "_after")).drop(
        "_part", "_next", "_after"
    )


def _quarter(n: Column) -> Column:
    return F.floor(n / 4).cast("int")


def with_edited(docs: DataFrame) -> DataFrame:
    """(doc_id, text, next_id, edited) of each row."""
    texts = id_and_text(docs).withColumn("text", F.coalesce("text", F.lit("")))
    known, cut = texts.where("doc_id IS NOT NULL"), _quarter(F.length("text"))
    ids = known.groupBy("doc_id").agg(F.max(cut).alias("_need"))
    order = staged(following(ids), "order")
    wanted = order.select(F.col("next_id").alias("doc_id"), F.col("doc_id").alias("_to"), F.col("_need").alias("_lend"))
    # Both joins deal the texts by doc_id alike, so the texts are shuffled once for the two of them.
    lent = known.join(wanted, "doc_id").groupBy(F.col("_to").alias("doc_id")).agg(
        F.min(F.substring(F.col("text"), F.lit(1), F.col("_lend"))).alias("_start")
    )
    kept = F.substring(F.col("text"), F.lit(1), F.length("text") - cut)
    start = F.coalesce(F.substring(F.col("_start"), F.lit(1), cut), F.lit(""))
    edited = known.join(order.select("doc_id", "next_id"), "doc_id").join(lent, "doc_id", "left").select(
        "doc_id", "text", "next_id", F.concat(kept, start).alias("edited")
    )
    alone = texts.where("doc_id IS NULL").select(
        "doc_id", "text", F.lit(None).cast("long").alias("next_id"), kept.alias("edited")
    )
    return edited.unionByName(alone)


def likeness(a: str, b: str) -> Column:
    return 1 - F.bit_count(F.col(a).bitwiseXOR(F.col(b))) / BITS


def _hex(name: str) -> Column:
    return F.lower(F.lpad(F.hex(name), BITS // 4, "0"))


def compared(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint, its edited text's, and how alike they and the next document's are."""
    keys = ["doc_id", "next_id", "_text", "n_chars", "edited_sha256"]
    both = with_edited(docs).select(
        "doc_id", "next_id", F.xxhash64("text").alias("_text"), F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        F.explode(F.array(
            F.struct(F.lit(0).alias("which"), F.col("text").alias("text")),
            F.struct(F.lit(1).alias("which"), F.col("edited").alias("text")),
        )).alias("_of"),
    ).select(*keys, "_of.which", "_of.text")
    made = fingerprints(both, [*keys, "which"]).groupBy(*keys).agg(
        F.max(F.when(F.col("which") == 0, F.col("fingerprint"))).alias("own"),
        F.max(F.when(F.col("which") == 1, F.col("fingerprint"))).alias("changed"),
    )
    made = staged(made, "fingerprints")
    nexts = made.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("next_id")).agg(F.min("own").alias("after"))
    return made.join(nexts, "next_id", "left").select(
        "doc_id", "n_chars", "edited_sha256", _hex("own").alias("fingerprint"),
        _hex("changed").alias("edited_fingerprint"), likeness("own", "changed").alias("near_edited"),
        likeness("own", "after").alias("near_next"),
    )


def _tables(prints: DataFrame, radius: int) -> DataFrame:
    """Every fingerprint under its key in each permuted block table."""
    blocks = radius + SHARED
    ends = [round(BITS * i / blocks) for i in range(blocks + 1)]
    masks = [(1 << ends[i + 1]) - (1 << ends[i]) for i in range(blocks)]
    signed = [sum(masks[i] for i in c) for c in combinations(range(blocks), SHARED)]
    signed = [m - (1 << BITS) if m >= 1 << (BITS - 1) else m for m in signed]
    return prints.select("fingerprint", F.posexplode(F.array(*[
        F.col("fingerprint").bitwiseAND(F.lit(m).cast("long")) for m in signed
    ])).alias("_table", "_key"))


def within_radius(prints: DataFrame, queries: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(query, fingerprint, distance) for each distinct fingerprint of ``queries`` and all distinct ones of
    ``prints`` at most ``radius`` bits away. Copies share a fingerprint and are searched once."""
    stored = _tables(prints.select("fingerprint").distinct(), radius)
    asked = _tables(queries.select("fingerprint").distinct(), radius).withColumnRenamed("fingerprint", "query")
    met = asked.join(stored, ["_table", "_key"]).withColumn(
        "distance", F.bit_count(F.col("query").bitwiseXOR(F.col("fingerprint")))
    )
    return met.where(F.col("distance") <= radius).select("query", "fingerprint", "distance").distinct()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compared(table(spark, sf_dir, "documents"))
