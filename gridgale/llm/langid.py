"""Language by cross-parsing: the language whose sample parses a text into the fewest phrases.

A suffix automaton of each language's sample accepts exactly the substrings of that sample, so walking it
gives the longest match from every phrase start. A text is cut greedily into such longest matches; the
number of phrases times log2 of the sample's length, per character, estimates the bits a character costs
in that language. The smallest wins (the first by name on a tie).

Only the samples are bounded: of each language at most ``DOCS`` documents with the smallest hash, and
``CHARS`` characters of them. Every text is parsed whole. To parse thousands of texts at once, texts are
laid out in blocks of ``BLOCK`` characters that step through the automata together; a phrase ends at the
end of its block, alike for all languages. The automata are dense tables of at most 2 * ``CHARS`` states
by ``SYMBOLS`` symbols (8 MB per language, broadcast); letters beyond the commonest share symbols.

Defined cases: a null text or one without a letter is ``und`` with score 0, as is every text when there is
no labelled one; a null ``doc_id`` is never learned from and not held out; repeated rows each get a row;
extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridgale.llm.common import staged, table

DOCS, CHARS = 80, 30_000
SYMBOLS, COMMON, SPACE = 64, 47, 1  # symbol 0 is unused; 2.. are the commonest letters; the rest shares the others
BLOCK, SHARPEST = 512, 100
_PLANE = 1 << 16


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def automaton(codes: np.ndarray) -> np.ndarray:
    """Suffix automaton as a table (state, symbol) -> state; state 0 is the start, and 0 means no way."""
    ways: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in codes.tolist():
        new = len(ways)
        ways.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in ways[p]:
            ways[p][c] = new
            p = link[p]
        if p >= 0:
            q = ways[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                twin = len(ways)
                ways.append(dict(ways[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and ways[p].get(c) == q:
                    ways[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    out = np.zeros((len(ways), SYMBOLS), np.uint16 if len(ways) <= _PLANE else np.uint32)
    for state, way in enumerate(ways):
        for c, to in way.items():
            out[state, c] = to
    return out


def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(_PLANE)), bool, _PLANE)


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    symbols: np.ndarray  # of each code point below _PLANE
    tables: tuple[np.ndarray, ...]  # flattened automata
    bits: np.ndarray  # of one phrase, per language

    def codes(self, text: str) -> np.ndarray:
        """Symbols of the lower-cased text; what is no letter is space, and spaces in a row are one."""
        points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
        codes = self.symbols[np.minimum(points, _PLANE - 1)]
        if len(points) and points.max() >= _PLANE:
            far = points >= _PLANE
            codes[far] = 2 + COMMON + points[far] % (SYMBOLS - 2 - COMMON)
        blank = codes == SPACE
        return codes[~(blank & np.concatenate([[True], blank[:-1]]))]

    def costs(self, texts: list[np.ndarray]) -> np.ndarray:
        """Bits a character, per text and language."""
        sizes = np.array([len(t) for t in texts])
        owner = np.repeat(np.arange(len(texts)), -(-sizes // BLOCK))
        lanes = [t[i:i + BLOCK] for t in texts for i in range(0, len(t), BLOCK)]
        width = np.array([len(b) for b in lanes], np.int64)
        order = np.argsort(-width, kind="stable")
        grid = np.zeros((BLOCK, len(lanes)), np.uint8)
        for lane, i in enumerate(order):
            grid[:width[i], lane] = lanes[i]
        active = np.searchsorted(-width[order], -np.arange(1, BLOCK + 1), side="right")
        out = np.empty((len(texts), len(self.tables)))
        for k, flat in enumerate(self.tables):
            state, phrases = np.zeros(len(lanes), np.int64), np.ones(len(lanes), np.int64)
            for step in range(int(width.max(initial=0))):
                n = active[step]
                code = grid[step, :n]
                to = flat[state[:n] * SYMBOLS + code]
                ended = np.flatnonzero(to == 0)
                phrases[ended] += 1
                to[ended] = flat[code[ended]]
                state[:n] = to
            total = np.bincount(owner[order], phrases, len(texts))
            out[:, k] = total * self.bits[k] / np.maximum(sizes, 1)
        return out

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        known = [t is not None and bool(self.languages) and any(map(str.isalpha, t)) for t in texts]
        codes = [self.codes(t) for t, k in zip(texts, known, strict=True) if k]
        cost = self.costs(codes) if codes else np.empty((0, max(len(self.languages), 1)))
        best = cost.argmin(1)
        sharp = np.minimum([len(c) for c in codes], SHARPEST).reshape(-1, 1)
        score = 1 / np.exp2(-(cost - cost.min(1, keepdims=True)) * sharp).sum(1)
        answers = iter(zip(best.tolist(), score.tolist(), strict=True))
        return [(self.languages[(a := next(answers))[0]], a[1]) if k else ("und", 0.0) for k in known]


def learn(docs: DataFrame, per_language: int = DOCS, chars: int = CHARS, seed: int = 3) -> Model:
    """Automata of a bounded hash sample of each language's documents that are not held out."""
    rows = docs.where("text IS NOT NULL AND lang IS NOT NULL AND doc_id IS NOT NULL").where(
        ~held_out(F.col("doc_id"))
    ).select("doc_id", "lang", F.xxhash64(F.lit(seed), "doc_id").alias("_hash"))
    # A hash range with some four times the wanted documents, so that ranking never sees a whole language.
    share = rows.groupBy("lang").agg(F.least(F.lit(1.0), 4.0 * per_language / F.count("*")).alias("_share"))
    near = rows.join(share, "lang").where(F.pmod("_hash", F.lit(1_000_000)) < F.col("_share") * 1_000_000)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("_hash", "doc_id"))
    picked = near.dropDuplicates(["doc_id"]).withColumn("_rank", rank).where(F.col("_rank") <= per_language)
    # Written out, so that the size check that decides on broadcasting sees how small it is.
    picked = staged(picked.select("doc_id", "lang", "_rank"), "picked")
    found = docs.select("doc_id", "text").where("text IS NOT NULL").join(picked, "doc_id").dropDuplicates(["doc_id"]).orderBy("lang", "_rank").collect()  # at most per_language of each language
    texts: dict[str, str] = {}
    for r in found:
        if len(texts.setdefault(r["lang"], "")) < chars:
            texts[r["lang"]] = (texts[r["lang"]] + " " + r["text"])[:chars + 1]
    texts = {k: v.lower() for k, v in sorted(texts.items()) if any(map(str.isalpha, v))}
    common = [c for c, _ in Counter(c for v in texts.values() for c in v if c.isalpha()).most_common(COMMON)]
    letters = _letters()
    symbols = np.where(letters, 2 + COMMON + np.arange(_PLANE) % (SYMBOLS - 2 - COMMON), SPACE).astype(np.uint8)
    for i, c in enumerate(sorted(common)):
        if ord(c) < _PLANE:
            symbols[ord(c)] = 2 + i
    blank = Model((), symbols, (), np.empty(0))
    codes = [blank.codes(v) for v in texts.values()]
    return Model(
        tuple(texts), symbols, tuple(automaton(c).ravel() for c in codes),
        np.array([math.log2(len(c) + 1) for c in codes]),
    )


def predicted(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, lang_pred, score), one row per document; only the text is looked at."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def guess(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts, out = batch.tolist(), []
            for at in range(0, len(texts), 2000):  # bounds the grid
                out += held.value.predict(texts[at:at + 2000])
            yield pd.DataFrame(out, columns=["lang_pred", "score"])

    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), guess("text").alias("_found")).select(
        "doc_id", "held_out", "_found.*"
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return predicted(docs, learn(docs))
