"""Ranked lexical search over a length-stratified index.

The score of a document for a term depends on the document only through its term frequency tf and its length
normaliser m, so documents of equal m form a stratum in which a posting list needs no more than the documents of
each tf, and an impact is computed once per (stratum, tf).

1. ``counted`` cuts every whole text into terms once: its length, and tf of the terms that are asked for.
   Numbers of documents and terms, and document frequencies, are counted over all rows.
2. ``indexed`` orders documents by m, and cuts each stratum into blocks of at most ``BLOCK`` documents (a hot
   stratum is many blocks in many tasks). A block is one row: its documents, and per (term, tf) its members.
3. ``searched`` bounds each query in each stratum by the highest tf that each term has there. Each query first
   visits its strata of highest bound, until they hold ``FIRST`` documents: the last of its best is a floor.
   Then every other block is visited by those queries only whose bound there reaches the floor, which the
   visits of a task keep raising. Blocks below it cannot hold a result, so the ranking is exact.

Queries are taken in portions of ``ITEMS`` items or ``TERMS`` terms, the bound of what is broadcast; each portion
reads the documents once.

Defined cases: null texts and those without terms count nowhere; an item without terms has no results. Repeated
rows, of documents and of items, are each of their own. A document without ``doc_id`` is ranked after others of
its score. Extra columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

import math
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridgale.llm.common import id_and_text, staged, table

TOP, BLOCK, FIRST = 50, 1_000, 1_000
ITEMS, TERMS = 2_000, 100_000
# Fixed values of the score.
WEIGHT, SCALE, TF_UNIT, LENGTH_UNIT, SLOPE = 1_000, 1_000_000_000, 1_000, 20, 50

# One byte to one byte: A-Z lower-cased, ASCII signs and controls to spaces, all other bytes as they are.
_FOLDED = bytes(
    ord(chr(b).lower()) if chr(b) in string.ascii_letters else b if b > 127 or chr(b) in string.digits else 32 for b in range(256)
)
_NO_ID = 2**63 - 1

_COUNTED = "doc_id long, n long, terms array<int>, tfs array<int>"
_BLOCK = "m long, ids array<long>, term array<int>, tf array<int>, size array<int>, member array<int>"
_BOUND = "m long, docs long, item array<int>, bound array<long>"
_FOUND = "item int, doc_id long, score long"


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLDED).split()


def _lists(flat: np.ndarray, sizes: list[int] | np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, kind))


def counted(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, tfs) of each document with a term: its length, and the terms of ``vocabulary`` it has."""
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = known.value
        for batch in batches:
            lengths, sizes, found, tfs = [], [], [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
            for text in batch.column("text"):
                own = terms_of(text.as_buffer().to_pybytes()) if text.is_valid else []
                lengths.append(len(own))
                ids, times = np.unique(np.array([i for t in own if (i := number.get(t)) is not None], np.int32), return_counts=True)
                sizes.append(len(ids))
                found.append(ids)
                tfs.append(times)
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array(lengths, pa.int64()), _lists(np.concatenate(found), sizes, pa.int32()),
                _lists(np.concatenate(tfs), sizes, pa.int32()),
            ], names=_names(_COUNTED)).filter(pa.array(np.array(lengths) > 0))

    rows = id_and_text(docs).select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(count, _COUNTED)


def _block(part: pa.Table) -> tuple[np.ndarray, ...]:
    """Documents and postings of one block: lists by (term, tf), members by place among the block's ids."""
    ids = pc.fill_null(part["doc_id"], _NO_ID).to_numpy()
    terms, tfs = (part[c].combine_chunks().flatten().to_numpy() for c in ("terms", "tfs"))
    order = np.argsort(ids, kind="stable")
    place = np.empty(len(ids), np.int32)
    place[order] = np.arange(len(ids))
    member = np.repeat(place, pc.list_value_length(part["terms"]).to_numpy())
    by = np.lexsort((member, tfs, terms))
    terms, tfs, member = terms[by], tfs[by], member[by]
    starts = np.flatnonzero(np.concatenate([[True], (terms[1:] != terms[:-1]) | (tfs[1:] != tfs[:-1])]))
    return ids[order], terms[starts], tfs[starts], np.diff([*starts, len(terms)]), member


def indexed(rows: DataFrame, documents: int, length: int, block: int = BLOCK) -> DataFrame:
    """Blocks of the strata of ``counted`` rows; ``documents`` and ``length`` are the corpus-wide N and L."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        made: list[tuple] = []

        def flush() -> None:
            if held:
                made.append((held[0].column("m")[0].as_py(), *_block(pa.Table.from_batches(held))))
                held.clear()

        def out() -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32())
            lists = [
                _lists(np.concatenate([b[k] for b in made]), [len(b[k]) for b in made], kind) for k, kind in enumerate(kinds, 1)
            ]
            done = pa.RecordBatch.from_arrays([pa.array([b[0] for b in made], pa.int64()), *lists], names=_names(_BLOCK))
            made.clear()
            return done

        for batch in batches:
            m = batch.column("m").to_numpy()
            edges = [0, *(np.flatnonzero(m[1:] != m[:-1]) + 1).tolist(), len(m)]
            for lo, hi in zip(edges, edges[1:], strict=False):
                if held and held[0].column("m")[0].as_py() != m[lo]:
                    flush()
                while lo < hi:
                    take = min(hi - lo, block - sum(b.num_rows for b in held))
                    held.append(batch.slice(lo, take))
                    lo += take
                    if sum(b.num_rows for b in held) >= block:
                        flush()
            if len(made) >= 100:
                yield out()
        flush()
        if made:
            yield out()

    m = F.lit(2 * SLOPE - SLOPE) + F.expr(f"({SLOPE} * n * {documents}L) div {max(length, 1)}L")
    placed = rows.where(F.size("terms") > 0).select(
        m.cast("long").alias("m"), F.monotonically_increasing_id().alias("row"), "doc_id", "terms", "tfs"
    )
    return placed.repartitionByRange("m", "row").sortWithinPartitions("m", "row").drop("row").mapInArrow(cut, _BLOCK)


class Queries:
    """Weights of terms, and for each term the items that hold it."""

    def __init__(self, items: list[set[int]], weights: np.ndarray):
        self.weights, self.count = weights, len(items)
        pairs = sorted((t, i) for i, own in enumerate(items) for t in own)
        self.items = np.array([i for _, i in pairs], np.int64)
        self.starts = np.searchsorted(np.array([t for t, _ in pairs], np.int64), np.arange(len(weights) + 1))

    def holders(self, term: int) -> np.ndarray:
        return self.items[self.starts[term]:self.starts[term + 1]]

    def bounds(self, term: np.ndarray, value: np.ndarray) -> np.ndarray:
        """What a document can score at most for each item, from the block's lists; the last list of a term has
        its highest tf."""
        last = np.flatnonzero(np.concatenate([term[1:] != term[:-1], [True]]))
        sizes = self.starts[term[last] + 1] - self.starts[term[last]]
        first = np.repeat(self.starts[term[last]] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)
        out = np.zeros(self.count, np.int64)
        np.add.at(out, self.items[first + np.arange(len(first))], np.repeat(value[last], sizes))
        return out


def _blocks(batches: Iterator[pa.RecordBatch], queries: Queries) -> Iterator[tuple[pa.RecordBatch, int, int, list, np.ndarray]]:
    """Each block with its lists and what they add to a score: an impact for each tf, times the term's weight."""
    for batch in batches:
        columns = [c for c in batch.schema.names if c != "m"]
        flat = {c: (batch.column(c).values.to_numpy(), batch.column(c).offsets.to_numpy()) for c in columns}
        for k, m in enumerate(batch.column("m").to_pylist()):
            own = {c: v[o[k]:o[k + 1]] for c, (v, o) in flat.items()}
            tfs, which = np.unique(own["tf"].astype(np.int64), return_inverse=True)
            impact = (SCALE * tfs) // (TF_UNIT * tfs + LENGTH_UNIT * m)
            yield m, own, queries.weights[own["term"]] * impact[which]


class _Best:
    """The best results of each item so far; ``floor`` is what a score must reach."""

    def __init__(self, floors: np.ndarray, top: int):
        self.floor, self.top = floors.copy(), top
        self.held: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def add(self, item: int, ids: np.ndarray, scores: np.ndarray) -> None:
        good = scores >= self.floor[item]
        if not good.any():
            return
        ids, scores = ids[good], scores[good]
        if item in self.held:
            ids, scores = (np.concatenate(x) for x in zip(self.held[item], (ids, scores), strict=True))
        if len(ids) > self.top:
            best = np.lexsort((ids, -scores))[:self.top]
            ids, scores = ids[best], scores[best]
        if len(ids) == self.top:
            self.floor[item] = max(self.floor[item], scores.min())
        self.held[item] = ids, scores


def _visited(index: DataFrame, queries, floors: np.ndarray, first: dict[int, set[int]], only_first: bool, top: int) -> DataFrame:
    """Best results of each task: of the strata that ``first`` names for an item, or of all others."""

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: Queries = queries.value
        best = _Best(floors, top)
        for m, own, value in _blocks(batches, asked):
            due = asked.bounds(own["term"], value) >= best.floor
            named = np.zeros(asked.count, bool)
            named[list(first.get(m, ()))] = True
            rows = np.flatnonzero(due & (named == only_first))
            if not len(rows):
                continue
            place = np.full(asked.count, -1)
            place[rows] = np.arange(len(rows))
            scores = np.zeros((len(rows), len(own["ids"])), np.int64)
            ends = np.cumsum(own["size"])
            for term, size, end, worth in zip(own["term"].tolist(), own["size"].tolist(), ends.tolist(), value.tolist(), strict=True):
                to = place[asked.holders(term)]
                to = to[to >= 0]
                if len(to):
                    scores[to[:, None], own["member"][end - size:end]] += worth
            for row, item in enumerate(rows.tolist()):
                best.add(item, own["ids"], scores[row])
        found = sorted(best.held.items())
        if found:
            yield pa.RecordBatch.from_arrays([
                pa.array(np.repeat([i for i, _ in found], [len(x[0]) for _, x in found]), pa.int32()),
                pa.array(np.concatenate([x[0] for _, x in found])), pa.array(np.concatenate([x[1] for _, x in found])),
            ], names=_names(_FOUND))

    return index.mapInArrow(visit, _FOUND)


def _ranked(found: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def searched(index: DataFrame, queries: Queries, top: int = TOP, first: int = FIRST) -> DataFrame:
    """(item, rank, doc_id, score): the ``top`` documents of each item of ``queries``, by its number."""
    asked = index.sparkSession.sparkContext.broadcast(queries)

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Bounds of the strata of this task; neighbouring blocks of one stratum are joined here."""
        at, docs, high = None, 0, np.zeros(0, np.int64)

        def out() -> pa.RecordBatch:
            items = np.flatnonzero(high > 0)
            return pa.RecordBatch.from_arrays([
                pa.array([at], pa.int64()), pa.array([docs], pa.int64()), _lists(items, [len(items)], pa.int32()),
                _lists(high[items], [len(items)], pa.int64()),
            ], names=_names(_BOUND))

        for m, own, value in _blocks(batches, asked.value):
            if at is not None and at != m:
                yield out()
                docs = 0
            own_high = asked.value.bounds(own["term"], value)
            high = np.maximum(high, own_high) if docs else own_high
            at, docs = m, docs + int(own["member"].max()) + 1
        if at is not None:
            yield out()

    strata = index.select("m", "term", "tf", "size", "member").mapInArrow(bound, _BOUND)
    bounds = strata.select("m", "docs", F.explode(F.arrays_zip("item", "bound")).alias("x")).groupBy("m", "x.item").agg(
        F.max("x.bound").alias("bound"), F.sum("docs").alias("docs")
    )
    before = Window.partitionBy("item").orderBy(F.desc("bound"), "m")
    earliest = bounds.withColumn("before", F.sum("docs").over(before) - F.col("docs")).where(F.col("before") < first)
    visits: dict[int, set[int]] = {}
    for r in earliest.select("m", "item").toLocalIterator():
        visits.setdefault(r.m, set()).add(r.item)

    floors = np.ones(queries.count, np.int64)
    begun = index.where(F.col("m").isin(list(visits))) if visits else index.limit(0)
    seen = staged(_ranked(_visited(begun, asked, floors, visits, True, top), top), "first-visits")
    for r in seen.where(F.col("rank") == top).select("item", "score").toLocalIterator():
        floors[r.item] = r.score
    return _ranked(seen.drop("rank").unionByName(_visited(index, asked, floors, visits, False, top)), top)


def _portions(items: DataFrame, most_items: int, most_terms: int) -> Iterator[tuple[list[int | None], list[set[int]], dict[bytes, int]]]:
    """Items in portions: their ids, their terms by number, and the numbers."""
    ids, own, number = [], [], {}
    for r in id_and_text(items, "item_id").orderBy("doc_id", "text").toLocalIterator():
        ids.append(r.doc_id)
        own.append({number.setdefault(t, len(number)) for t in terms_of((r.text or "").encode())})
        if len(ids) >= most_items or len(number) >= most_terms:
            yield ids, own, number
            ids, own, number = [], [], {}
    if ids:
        yield ids, own, number


def search(docs: DataFrame, items: DataFrame, top: int = TOP, most_items: int = ITEMS, most_terms: int = TERMS,
           block: int = BLOCK, first: int = FIRST) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` documents of each item, scores above 0 only."""
    spark = docs.sparkSession
    schema = "item_id long, rank int, doc_id long, score long"
    results = []
    for ids, own, number in _portions(items, most_items, most_terms):
        rows = staged(counted(docs, number), "counted")
        total = rows.agg(F.count("*").alias("documents"), F.sum("n").alias("length")).first()
        having = dict(rows.select(F.explode("terms").alias("t")).groupBy("t").count().collect())
        weights = np.array([
            math.floor(WEIGHT * math.log((2 * total.documents + 2) / (2 * having.get(t, 0) + 1))) for t in range(len(number))
        ], np.int64)
        index = staged(indexed(rows, total.documents, total.length or 0, block), "index")
        names = spark.createDataFrame(list(enumerate(ids)), "item int, item_id long")
        found = searched(index, Queries(own, weights), top, first).join(names, "item")
        results.append(found.select(
            "item_id", F.col("rank").cast("int"), F.when(F.col("doc_id") != _NO_ID, F.col("doc_id")).alias("doc_id"), "score"
        ))
    if not results:
        return spark.createDataFrame([], schema)
    whole = results[0]
    for more in results[1:]:
        whole = whole.unionByName(more)
    return whole


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL = r"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts
  FROM documents),
lengths AS (SELECT doc_id, CAST(len(ts) AS BIGINT) AS n FROM docs WHERE len(ts) > 0),
totals AS (SELECT count(*) AS big_n, CAST(sum(n) AS BIGINT) AS big_l FROM lengths),
words AS (SELECT doc_id, unnest(ts) AS term FROM docs),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark),
tfs AS (
  SELECT doc_id, term, count(*) AS tf FROM words WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * any_value(big_n) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM tfs, totals GROUP BY term),
scores AS (
  SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * big_n) // big_l)))) AS BIGINT) AS score
  FROM asked JOIN tfs USING (term) JOIN weights USING (term) JOIN lengths USING (doc_id), totals
  GROUP BY ALL),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank
  FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50
"""
