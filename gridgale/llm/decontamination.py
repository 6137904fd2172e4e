"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact check.

A benchmark item of m words is looked for in every window of m words of every text (words are runs of
letters and digits, lower-cased). A window leaks an item when their bags of five-word shingles have
``sum of smaller counts / sum of larger counts >= SIMILARITY``.

1. Such a window shares about 2s/(1+s) of its shingles with the item. Running counts of shingles that
   items of that size have give, without loss, the windows that can leak at all; clean texts have none.
2. Each of them gets a 64-bit SimHash of its words. The index keeps every item under all values of its
   eight 8-bit blocks with up to two bits changed: any item within ``RADIUS`` = 23 bits differs in at
   most two bits in some block, so the look-up returns all of them. (Windows at the threshold differ
   from their item in about 7 bits, unrelated ones in about 32.)
3. Items of that window size within the radius are verified on the exact weighted shingles.

One narrow pass over whole texts, no shuffle. The index is broadcast; it is built from at most
``CHUNK`` items (some 200 KB per hundred items), and a larger benchmark takes a pass per chunk.

Defined cases: null or empty texts and items match nothing; an item of fewer than five words is only
compared with whole texts; a text shorter than an item is one window; repeated rows give repeated
results, equal items all are reported; extra columns are ignored; an empty benchmark leaves all clean.
"""

from __future__ import annotations

import functools
import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridgale.llm.common import id_and_text, table

WORDS, SIMILARITY = 5, 0.75
BITS, BLOCKS, CHANGED = 64, 8, 2
RADIUS = BLOCKS * (CHANGED + 1) - 1
CHUNK = 5000

_WORD = re.compile(r"[^\W_]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


@functools.lru_cache(maxsize=20_000)
def _word_hash(word: str) -> bytes:
    return hashlib.blake2b(word.encode(), digest_size=BITS // 8).digest()


def fingerprint(words: list[str]) -> int:
    """SimHash: each occurrence of a word votes with its 64 hash bits."""
    counts = Counter(words)
    raw = b"".join(map(_word_hash, counts))
    bits = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(len(counts), BITS // 8), axis=1)
    weight = np.fromiter(counts.values(), np.int64, len(counts))
    votes = 2 * (weight @ bits.astype(np.int64)) > weight.sum()
    return int.from_bytes(np.packbits(votes).tobytes(), "big")


def shingle_bag(words: list[str]) -> Counter:
    return Counter(tuple(words[i:i + WORDS]) for i in range(max(len(words) - WORDS + 1, min(1, len(words)))))


def likeness(a: Counter, b: Counter) -> float:
    both = sum((a & b).values())
    return both / (sum(a.values()) + sum(b.values()) - both) if both else 0.0


def _blocks(value: int) -> list[int]:
    width = BITS // BLOCKS
    return [(value >> (width * i)) & ((1 << width) - 1) for i in range(BLOCKS)]


_CHANGES = [sum(1 << i for i in c) for k in range(CHANGED + 1) for c in combinations(range(BITS // BLOCKS), k)]


@dataclass
class Index:
    """Items by window size and by block value; the vocabulary and the shingles that can start a match."""

    ids: list[int] = field(default_factory=list)
    prints: list[int] = field(default_factory=list)
    bags: list[Counter] = field(default_factory=list)
    blocks: dict[tuple[int, int, int], list[int]] = field(default_factory=dict)
    vocabulary: dict[str, int] = field(default_factory=dict)
    sizes: list[set[int]] = field(default_factory=list)  # of the items with each shingle
    whole: dict[tuple[str, ...], list[int]] = field(default_factory=dict)
    shingles: np.ndarray = field(default_factory=lambda: np.empty(0, np.uint64))

    @classmethod
    def of(cls, items: list[tuple[int, str | None]]) -> Index:
        index, seen = cls(), {}
        for item, text in items:
            words = words_of(text)
            if not words:
                continue
            if len(words) < WORDS:
                index.whole.setdefault(tuple(words), []).append(item)
                continue
            row = len(index.ids)
            index.ids.append(item)
            index.prints.append(fingerprint(words))
            index.bags.append(shingle_bag(words))
            for b, value in enumerate(_blocks(index.prints[row])):
                for change in _CHANGES:
                    index.blocks.setdefault((len(words), b, value ^ change), []).append(row)
            places = np.array([index.vocabulary.setdefault(w, len(index.vocabulary) + 1) for w in words], np.uint64)
            for shingle in _rolled(places).tolist():
                seen.setdefault(shingle, set()).add(len(words))
        index.sizes = [seen[s] for s in sorted(seen)]
        index.shingles = np.array(sorted(seen), np.uint64)
        return index

    def within(self, size: int, value: int) -> list[int]:
        """Items of ``size`` words whose fingerprints are within RADIUS of ``value``: all of them."""
        rows = {r for b, v in enumerate(_blocks(value)) for r in self.blocks.get((size, b, v), ())}
        return [r for r in sorted(rows) if (self.prints[r] ^ value).bit_count() <= RADIUS]

    def leaks(self, text: str | None) -> list[tuple[int, int, int, float]]:
        """(item, first word, words, similarity): the best window of each item that the text leaks."""
        words = words_of(text)
        if not words:
            return []
        out = [(item, 0, len(words), 1.0) for item in self.whole.get(tuple(words), ())] if len(words) < WORDS else []
        if len(words) < WORDS or not len(self.shingles):
            return out
        known = self.vocabulary.get
        rolled = _rolled(np.array([known(w, 0) for w in words], np.uint64))
        hit = self.shingles[np.minimum(np.searchsorted(self.shingles, rolled), len(self.shingles) - 1)] == rolled
        if not hit.any():
            return out
        places, shingles = np.flatnonzero(hit), np.searchsorted(self.shingles, rolled[hit])
        best: dict[int, tuple[float, int, int]] = {}
        for size in sorted({s for i in set(shingles.tolist()) for s in self.sizes[i]}):
            # Only windows with enough shingles of items of their own size can leak one.
            own = np.zeros(len(rolled), bool)
            own[places[[size in self.sizes[i] for i in shingles.tolist()]]] = True
            total = np.concatenate([[0], np.cumsum(own)])
            width = min(size, len(words))
            inside = total[width - WORDS + 1:] - total[:len(total) - (width - WORDS + 1)]
            # Of two bags of a and b shingles that are alike, this many at least are shared.
            need = SIMILARITY * ((size - WORDS + 1) + (width - WORDS + 1)) / (1 + SIMILARITY)
            for start in np.flatnonzero(inside >= need - 1e-9).tolist():
                window = words[start:start + width]
                for row in self.within(size, fingerprint(window)):
                    s = likeness(shingle_bag(window), self.bags[row])
                    if s >= SIMILARITY and s > best.get(row, (0.0, 0, 0))[0]:
                        best[row] = (s, start, width)
        return out + [(self.ids[r], at, width, s) for r, (s, at, width) in sorted(best.items())]


def _rolled(places: np.ndarray) -> np.ndarray:
    """One number per five-word shingle, equal for equal shingles; unknown words (0) end in no item's."""
    out = np.zeros(max(len(places) - WORDS + 1, 0), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(WORDS):
            out = (out ^ places[i:i + len(out)]) * _MIX
            out ^= out >> np.uint64(29)
    return out


def indexes(benchmark: DataFrame, chunk: int = CHUNK) -> list[Index]:
    """One index per chunk of at most about ``chunk`` items; one chunk in all but huge benchmarks."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text IS NOT NULL")
    chunks = max(1, math.ceil(items.count() / chunk))
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(chunks))
    return [
        Index.of(sorted(
            ((r["item_id"], r["text"]) for r in items.where(part == k).toLocalIterator()),
            key=lambda r: (r[0] is None, r[0] or 0, r[1]),
        )) for k in range(chunks)
    ]


def _finder(docs: DataFrame, index: Index):
    """A text's leaks as a column function; the index is broadcast."""
    held = docs.sparkSession.sparkContext.broadcast(index)

    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([held.value.leaks(t) for t in batch], dtype=object)

    return F.pandas_udf(find, "array<struct<item_id: long, start_word: int, n_words: int, similarity: double>>")


def leaks(docs: DataFrame, benchmark: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, item_id, start_word, n_words, similarity) for every document and item that it leaks."""
    texts = id_and_text(docs).where("text IS NOT NULL")
    found = [
        texts.select("doc_id", F.explode(_finder(docs, index)("text")).alias("leak")).select("doc_id", "leak.*")
        for index in indexes(benchmark, chunk)
    ]
    return reduce(DataFrame.unionByName, found)


def decontaminated(docs: DataFrame, benchmark: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``docs`` without those that leak an item; all columns stay."""
    for index in indexes(benchmark, chunk):
        docs = docs.where(F.size(_finder(docs, index)(F.coalesce("text", F.lit("")))) == 0)
    return docs


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
