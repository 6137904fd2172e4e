"""Alignment of two tokenizers over one text: common token ends, groups, and overlapping token pairs.

A is a byte-level vocabulary read over a space and the text, B one of sentence pieces read over the text (it
puts the space itself). Both give byte ends that rise strictly to the same total.

1. ``pieces`` encodes every whole text once. Where the vocabularies allow it (B has no piece with a space
   inside), texts are cut at single spaces and each distinct word is encoded once per worker.
2. Merging the ends of A and B is cut into pieces of ``WORK`` ends: on each diagonal a binary search finds how
   many of those ends are A's, so pieces are of equal work and know nothing of each other. Equal ends are kept
   in one piece, and each piece carries the one token of either side that is open at its end. A short document
   is one piece, a long one many rows that Spark deals to many tasks.
3. Each piece emits its overlaps: each distinct end closes one stretch, which one A token and one B token
   cover. Pairs are counted within tasks, then by Spark over all pieces.
4. A second pass over the pieces adds up the counts. The most frequent pairs, at most ``FREQUENT`` however
   large the corpus, are broadcast; links of all other pairs, each a small share, meet their counts in a join.
5. Groups that reach over a piece's end are stitched from the open tokens of neighbouring pieces; only
   documents of more than one piece are shuffled for that, with their group strings.

Defined cases: a null or empty text, and one whose joined token bytes of A or B differ from a space and the
text, has no tokens (zeros and an empty digest). Repeated rows, and rows without ``doc_id``, are documents of
their own. Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import os
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridgale.llm.common import arrow_rows, id_and_text, staged, table

VOCABULARY_A, VOCABULARY_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
WORK, FREQUENT = 16_384, 500_000
CACHED_TOKENS, JOINED, TEXTS, AT_ONCE, ENDS_AT_ONCE, KEYS_HELD = 1_000_000, 200, 50, 500_000, 100_000, 500_000
BATCH_ROWS = 1_000
# A pair of ids as one number; both vocabularies must stay below this.
_IDS = 1 << 20

_SLOW = re.compile(r"^ | $| \s")
_SINGLE_SPACE = re.compile(r"(?<=[^ ]) (?=\S)")
_BYTE_PIECE = re.compile(r"<0x([0-9A-F]{2})>")

_PIECES = ("doc_row long, doc_id long, piece int, pieces int, own_a int, own_b int, from_a long, from_b long, "
           "a array<int>, b array<int>")
_SCORED = ("doc_row long, doc_id long, piece int, pieces int, n_a long, n_b long, n_groups long, n_links long, "
           "n_best long, count_sum long, groups_sha256 string, closed string, open_a string, open_b string, "
           "rare array<long>")


def _byte_level() -> dict[str, int]:
    """The published byte-to-character table of byte-level vocabularies: printable bytes stand for
    themselves, the others follow from code point 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


class Vocabularies:
    """Both tokenizers with the bytes of every token, and the tokens of the words met so far."""

    def __init__(self, a: str, b: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(public_tokenizers.path(a))
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(b))
        code = _byte_level()
        tokens = {i: t for t, i in self.a.get_vocab().items()}
        self.bytes_a = [self._level(tokens.get(i, ""), code) for i in range(max(tokens) + 1)]
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [self._piece(p) for p in names]
        self.length_a = np.array([len(x) for x in self.bytes_a], np.int64)
        self.length_b = np.array([len(x) for x in self.bytes_b], np.int64)
        self.length = {"a": self.length_a, "b": self.length_b}
        self.joined = {s: np.frombuffer(b"".join(x), np.uint8) for s, x in (("a", self.bytes_a), ("b", self.bytes_b))}
        self.first = {s: np.cumsum(x) - x for s, x in self.length.items()}
        self.cuts = not any(re.search("[^▁]▁", p) for p in names)
        self.clear()

    @staticmethod
    def _level(token: str, code: dict[str, int]) -> bytes:
        return bytes(code[c] for c in token) if all(c in code for c in token) else token.encode()

    @staticmethod
    def _piece(piece: str) -> bytes:
        byte = _BYTE_PIECE.fullmatch(piece)
        return bytes([int(byte[1], 16)]) if byte else piece.replace("▁", " ").encode()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.exact = np.zeros(0, bool)
        self.added: dict[object, list[np.ndarray]] = defaultdict(list)
        self.total = {"a": 0, "b": 0}
        self.ids = {s: np.zeros(0, np.int32) for s in "ab"}
        self.starts = {s: np.zeros(1, np.int64) for s in "ab"}

    def words(self, text: str) -> list[str]:
        """Cut at single spaces before something visible: no token of either vocabulary reaches over one."""
        if not self.cuts:
            return [text]
        return _SINGLE_SPACE.split(text) if _SLOW.search(text) else text.split(" ")

    def learn(self, words: Iterable[str]) -> None:
        """Encode new words, ``JOINED`` at a time as one text: tokens that end where a word ends are that word's.
        Words with spaces inside or white space around, and texts whose token bytes come out different, go word by word."""
        new = [w for w in words if w not in self.number]
        apart = [w for w in new if not w or " " in w or w.strip() != w] if self.cuts else new
        whole = list(set(new).difference(apart))
        for at in range(0, len(whole), JOINED * TEXTS):
            apart += self._learn_joined(whole[at:at + JOINED * TEXTS])
        if apart:
            exact, sides = [], []
            ids = self._ids(apart)
            for w, a, b in zip(apart, *ids, strict=True):
                exact.append(all(
                    b"".join(parts := [names[i] for i in own]) == (" " + w).encode() and b"" not in parts
                    for names, own in ((self.bytes_a, a), (self.bytes_b, b))
                ))
            sides = [(np.array([i for w in own for i in w], np.int32), np.cumsum([len(w) for w in own])) for own in ids]
            self._add(apart, np.array(exact, bool), *sides)
        for s in "ab":
            self.ids[s] = np.concatenate([self.ids[s], *self.added[s, "ids"]])
            self.starts[s] = np.concatenate([self.starts[s], *self.added[s, "ends"]])
        self.exact = np.concatenate([self.exact, *self.added["exact"]])
        self.added.clear()

    def _learn_joined(self, words: list[str]) -> list[str]:
        """Learn words from joined texts; the words of texts that come out different are returned."""
        texts = [" ".join(words[k:k + JOINED]) for k in range(0, len(words), JOINED)]
        raw = np.frombuffer((" " + " ".join(words)).encode(), np.uint8)
        # Each word begins at its space.
        begins = np.append(np.flatnonzero(raw == 32), len(raw))
        text = np.arange(len(words)) // JOINED
        byte_text = np.repeat(text, np.diff(begins))
        size = np.bincount(byte_text, minlength=len(texts))
        good, sides = np.ones(len(texts), bool), {}
        for s, own in zip("ab", self._ids(texts), strict=True):
            counts = [len(x) for x in own]
            flat = np.fromiter(itertools.chain.from_iterable(own), np.int32, sum(counts))
            sides[s] = flat, np.repeat(np.arange(len(texts)), counts)
            good &= np.bincount(sides[s][1], self.length[s][flat], len(texts)) == size
        # Texts of another length are out; the others' bytes are compared all at once.
        for s in "ab":
            flat, of = sides[s]
            flat, of = flat[good[of]], of[good[of]]
            length = self.length[s][flat]
            ends = np.cumsum(length)
            first = np.repeat(self.first[s][flat] - (ends - length), length)
            same = self.joined[s][first + np.arange(len(first))] == raw[good[byte_text]]
            own = good[text]
            word_ends = np.cumsum(np.diff(begins)[own])
            cut = np.searchsorted(ends, word_ends)
            bad = [np.repeat(of, length)[~same], of[length == 0], text[own][ends[cut] != word_ends]]
            sides[s] = flat, of, cut, text[own], np.concatenate(bad)
        for s in "ab":
            good[sides[s][4]] = False
        kept = []
        for s in "ab":
            flat, of, cut, word_text, _ = sides[s]
            stays = good[of]
            until = np.cumsum(stays)
            kept.append((flat[stays], until[cut[good[word_text]]]))
        if good.all():
            self._add(words, np.ones(len(words), bool), *kept)
            return []
        own = good[text].tolist()
        self._add(list(itertools.compress(words, own)), np.ones(sum(own), bool), *kept)
        return [w for w, yes in zip(words, own, strict=True) if not yes]

    def _ids(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        a = self.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)
        return [e.ids for e in a], self.b.encode(texts, num_threads=1)

    def _add(self, words: list[str], exact: np.ndarray, *sides: tuple[np.ndarray, np.ndarray]) -> None:
        self.number.update(zip(words, range(len(self.number), len(self.number) + len(words)), strict=True))
        self.added["exact"].append(exact)
        for s, (flat, ends) in zip("ab", sides, strict=True):
            self.added[s, "ids"].append(flat)
            self.added[s, "ends"].append(self.total[s] + ends)
            self.total[s] += len(flat)

    def _numbered(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Words of all texts in a row as their numbers, each distinct word looked up once, and the text of each."""
        plain = [self.cuts and bool(t) and not _SLOW.search(t) for t in texts]
        apart = [t for t, yes in enumerate(plain) if texts[t] and not yes]
        split = pc.split_pattern(pa.array([t if yes else None for t, yes in zip(texts, plain, strict=True)], pa.string()), " ")
        others = [self.words(texts[t]) for t in apart]
        words = pa.chunked_array([split.flatten(), pa.array(list(itertools.chain.from_iterable(others)), pa.string())])
        coded = words.combine_chunks().dictionary_encode()
        own = coded.dictionary.to_pylist()
        numbers = np.fromiter(map(self.number.get, own, itertools.repeat(-1)), np.int64, len(own))
        new = np.flatnonzero(numbers < 0)
        fresh = [own[k] for k in new.tolist()]
        self.learn(fresh)
        numbers[new] = np.fromiter(map(self.number.__getitem__, fresh), np.int64, len(fresh))
        found = numbers[coded.indices.to_numpy()]
        text = np.repeat(np.arange(len(texts)), pc.fill_null(pc.list_value_length(split), 0).to_numpy())
        if apart:
            text = np.concatenate([text, np.repeat(apart, [len(w) for w in others])])
            order = np.argsort(text, kind="stable")
            found, text = found[order], text[order]
        return found, text

    def encode(self, texts: list[str | None]) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
        """Ids of all texts in a row, and how many each text has, by side."""
        if len(self.ids["a"]) > CACHED_TOKENS:
            self.clear()
        found, text = self._numbered(texts)
        # A word of another form after encoding takes its whole text out, unless the text comes out right.
        for t in np.unique(text[~self.exact[found]]).tolist():
            whole, numbers = (" " + texts[t]).encode(), found[text == t]
            if any(
                b"".join(parts := [names[i] for n in numbers for i in self.ids[s][self.starts[s][n]:self.starts[s][n + 1]]])
                != whole or b"" in parts for s, names in (("a", self.bytes_a), ("b", self.bytes_b))
            ):
                found, text = found[text != t], text[text != t]
        ids, counts = {}, {}
        for s in "ab":
            size = np.diff(self.starts[s])[found]
            first = np.repeat(self.starts[s][found] - np.concatenate([[0], np.cumsum(size)[:-1]]), size)
            ids[s] = self.ids[s][first + np.arange(len(first))]
            counts[s] = np.bincount(text, size, minlength=len(texts)).astype(np.int64)
        return ids, counts


@functools.lru_cache(maxsize=1)
def vocabularies(a: str, b: str) -> Vocabularies:
    return Vocabularies(a, b)


def cut_points(ends_a: np.ndarray, ends_b: np.ndarray, work: int) -> list[tuple[int, int]]:
    """Where pieces of ``work`` ends begin: (ends of A, ends of B) passed. One binary search per diagonal, all
    at once; A comes first among equal ends, and both stay on one side of a cut."""
    n, m = len(ends_a), len(ends_b)
    diagonal = np.arange(work, n + m, work)
    low, high = np.maximum(0, diagonal - m), np.minimum(diagonal, n)
    while (open_ := low < high).any():
        middle = (low + high) // 2
        before = np.zeros(len(diagonal), bool)
        before[open_] = ends_a[middle[open_]] <= ends_b[diagonal[open_] - middle[open_] - 1]
        low, high = np.where(open_ & before, middle + 1, low), np.where(open_ & ~before, middle, high)
    i, j = low, diagonal - low
    split = (i > 0) & (j < m)
    split[split] = ends_a[i[split] - 1] == ends_b[j[split]]
    j = j + split
    return sorted({(0, 0), *zip(i.tolist(), j.tolist(), strict=True)} - {(n, m)} | {(0, 0)})


def _lists(flat: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))


def pieces(docs: DataFrame, a: str = VOCABULARY_A, b: str = VOCABULARY_B, work: int = WORK) -> DataFrame:
    """Encoded texts as pieces of equal merging work, one row each; every document has one at least."""

    def rows_of(batch: pa.RecordBatch, lo: int, hi: int, texts: list[str | None]) -> pa.RecordBatch:
        both = vocabularies(a, b)
        ids, counts = both.encode(texts)
        starts = {s: np.concatenate([[0], np.cumsum(counts[s])]) for s in "ab"}
        long_ = np.flatnonzero(counts["a"] + counts["b"] > work).tolist()
        cuts: dict[int, list[tuple[int, int]]] = {}
        ends = {}
        for t in long_:
            for s, length in (("a", both.length_a), ("b", both.length_b)):
                ends[t, s] = np.cumsum(length[ids[s][starts[s][t]:starts[s][t + 1]]])
            cuts[t] = cut_points(ends[t, "a"], ends[t, "b"], work)
        row = np.repeat(np.arange(hi - lo), [len(cuts.get(t, [0])) for t in range(hi - lo)])
        piece, own, first, flat, offsets = np.zeros(len(row), np.int32), {}, {}, {}, {}
        for s in "ab":
            own[s] = counts[s][row].astype(np.int32)
            first[s] = np.zeros(len(row), np.int64)
            flat[s], offsets[s] = ids[s], np.concatenate([[0], np.cumsum(own[s])])
        if long_:
            takes: dict[str, list[np.ndarray]] = {s: [] for s in "ab"}
            at = 0
            for t in range(hi - lo):
                points = [*cuts.get(t, [(0, 0)]), (int(counts["a"][t]), int(counts["b"][t]))]
                for k, (p, q) in enumerate(zip(points, points[1:], strict=False)):
                    piece[at] = k
                    for x, s in enumerate("ab"):
                        own[s][at] = q[x] - p[x]
                        if k:
                            first[s][at] = ends[t, s][p[x] - 1] if p[x] else 0
                        base = starts[s][t]
                        takes[s].append(ids[s][base + p[x]:min(base + q[x] + 1, starts[s][t + 1])])
                    at += 1
            for s in "ab":
                flat[s] = np.concatenate(takes[s])
                offsets[s] = np.concatenate([[0], np.cumsum([len(x) for x in takes[s]])])
        index = pa.array(row + lo)
        return pa.RecordBatch.from_arrays([
            batch.column("doc_row").take(index), batch.column("doc_id").take(index), pa.array(piece),
            pa.array(np.bincount(row, minlength=hi - lo)[row].astype(np.int32)), pa.array(own["a"]), pa.array(own["b"]),
            pa.array(first["a"]), pa.array(first["b"]), _lists(flat["a"], offsets["a"]), _lists(flat["b"], offsets["b"]),
        ], names=[c.split()[0] for c in _PIECES.split(", ")])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            chars = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < len(texts):
                to = int(np.searchsorted(chars, (chars[at - 1] if at else 0) + AT_ONCE))
                to = min(max(to, at + 1), len(texts))
                yield rows_of(batch, at, to, texts.slice(at, to - at).to_pylist())
                at = to

    rows = id_and_text(docs).select(F.monotonically_increasing_id().alias("doc_row"), F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(encode, _PIECES)


def _portions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of some ``ENDS_AT_ONCE`` ends at a time, so that memory does not follow a batch's row count."""
    for batch in batches:
        ends = np.cumsum(batch.column("own_a").to_numpy().astype(np.int64) + batch.column("own_b").to_numpy())
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + ENDS_AT_ONCE))
            to = min(max(to, at + 1), batch.num_rows)
            yield batch.slice(at, to - at)
            at = to


class Overlaps:
    """Overlaps and groups of a batch of pieces, all pieces at once."""

    def __init__(self, batch: pa.RecordBatch, both: Vocabularies):
        self.rows = batch.num_rows
        self.ids, self.own, ends, span = {}, {}, {}, np.zeros(self.rows, np.int64)
        for s, length in (("a", both.length_a), ("b", both.length_b)):
            column = batch.column(s)
            offsets = column.offsets.to_numpy()
            flat = column.values.to_numpy()[offsets[0]:offsets[-1]]
            offsets = offsets.astype(np.int64) - offsets[0]
            count = batch.column(f"own_{s}").to_numpy().astype(np.int64)
            held = np.diff(offsets)
            piece = np.repeat(np.arange(self.rows), held)
            so_far = np.concatenate([[0], np.cumsum(length[flat])])
            end = so_far[1:] + np.repeat(batch.column(f"from_{s}").to_numpy() - so_far[offsets[:-1]], held)
            # Whole documents hold own tokens only; other pieces one more.
            mine = slice(None) if (held == count).all() else np.arange(len(flat)) - offsets[piece] < count[piece]
            some = count > 0
            span[some] = np.maximum(span[some], end[(offsets[:-1] + count - 1)[some]])
            self.ids[s], self.own[s] = flat, mine
            ends[s] = end[mine], piece[mine], count, offsets
        # Pieces one after another, so that ends rise strictly over the whole batch.
        base = np.concatenate([[0], np.cumsum(span)[:-1]])
        at = {s: ends[s][0] + base[ends[s][1]] for s in "ab"}
        self.piece = {s: ends[s][1] for s in "ab"}
        self.common, cover = {}, {}
        for s, o in (("a", "b"), ("b", "a")):
            found = np.searchsorted(at[o], at[s])
            self.common[s] = np.zeros(len(found), bool)
            inside = found < len(at[o])
            self.common[s][inside] = at[o][found[inside]] == at[s][inside]
            piece, offsets = self.piece[s], ends[o][3]
            before = np.concatenate([[0], np.cumsum(ends[o][2])[:-1]])
            cover[s] = found + (offsets[:-1] - before)[piece]
        # Each end of A closes a stretch, and each end of B that A does not share.
        rest = ~self.common["b"]
        self.link_a = np.concatenate([self.ids["a"][self.own["a"]], self.ids["a"][cover["b"][rest]]])
        self.link_b = np.concatenate([self.ids["b"][cover["a"]], self.ids["b"][self.own["b"]][rest]])
        self.link_piece = np.concatenate([self.piece["a"], self.piece["b"][rest]])

    def keys(self) -> np.ndarray:
        return self.link_a.astype(np.int64) * _IDS + self.link_b

    def per_piece(self, piece: np.ndarray, weight: np.ndarray | None = None) -> np.ndarray:
        if weight is None:
            return np.bincount(piece, minlength=self.rows).astype(np.int64)
        out = np.zeros(self.rows, np.int64)
        np.add.at(out, piece, weight)
        return out

    def groups(self, names: Names) -> Iterator[tuple[bytes, bytes, bytes]]:
        """For each piece its closed groups, and the ids that its end leaves open on either side."""
        ids = {s: self.ids[s][self.own[s]] for s in "ab"}
        group = {s: np.cumsum(self.common[s]) - self.common[s] + self.piece[s] for s in "ab"}
        size = {s: np.bincount(group[s], minlength=1) for s in "ab"}
        width = max(len(size["a"]), len(size["b"]))
        until = {s: np.concatenate([[0], np.cumsum(np.pad(size[s], (0, width - len(size[s]))))]) for s in "ab"}
        text = np.empty(len(ids["a"]) + len(ids["b"]), np.int64)
        for s, o in (("a", "b"), ("b", "a")):
            last = np.ones(len(ids[s]), bool)
            last[:-1] = group[s][1:] != group[s][:-1]
            place = np.arange(len(last)) + until[o][group[s] + (s == "b")]
            text[place] = ids[s] + np.where(last, names.block[s, True], names.block[s, False])
        length = names.length[text]
        written = np.concatenate([[0], np.cumsum(length)])
        all_ = names.joined[np.repeat(names.first[text] - written[:-1], length) + np.arange(written[-1])].tobytes()
        sizes = {s: np.concatenate([[0], np.cumsum(self.per_piece(self.piece[s]))]) for s in "ab"}
        # Own tokens after the last common end are open; they stand at the end of the piece's tokens.
        tail = {}
        for s in "ab":
            closed = np.zeros(self.rows, np.int64)
            where = np.flatnonzero(self.common[s])
            np.maximum.at(closed, self.piece[s][where], where + 1 - sizes[s][self.piece[s][where]])
            tail[s] = np.diff(sizes[s]) - closed
        at = sizes["a"] + sizes["b"]
        marks = (at[:-1], at[1:] - tail["b"] - tail["a"], at[1:] - tail["b"], at[1:])
        for own in zip(*(written[m].tolist() for m in marks), strict=True):
            # Without the mark after the last id.
            yield tuple(all_[x:max(x, y - 1)] for x, y in itertools.pairwise(own))


class Names:
    """Ids in decimal with the mark that follows each: inside its side of a group, or at that side's end."""

    def __init__(self, both: Vocabularies):
        texts, self.block = [], {}
        for s, n, marks in (("a", len(both.bytes_a), ",|"), ("b", len(both.bytes_b), ",;")):
            for last, mark in enumerate(marks):
                self.block[s, bool(last)] = len(texts)
                texts += [f"{i}{mark}".encode() for i in range(n)]
        self.joined = np.frombuffer(b"".join(texts), np.uint8)
        self.length = np.array([len(x) for x in texts], np.int64)
        self.first = np.cumsum(self.length) - self.length


def _kept_counts(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, where = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
    counts = np.zeros(len(keys), np.int64)
    np.add.at(counts, where, np.concatenate([c for _, c in held]))
    return keys, counts


def pair_counts(cut: DataFrame, a: str = VOCABULARY_A, b: str = VOCABULARY_B) -> DataFrame:
    """(pair, b, links): for each pair of ids that overlap anywhere, how many links hold it."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = vocabularies(a, b)
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def out() -> pa.RecordBatch:
            keys, counts = _kept_counts(held)
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], names=["pair", "links"])

        for batch in _portions(batches):
            held.append(np.unique(Overlaps(batch, both).keys(), return_counts=True))
            if sum(len(k) for k, _ in held) > KEYS_HELD:
                held = [_kept_counts(held)]
                if len(held[0][0]) > KEYS_HELD // 2:
                    yield out()
                    held = []
        if held:
            yield out()

    counted = cut.mapInArrow(count, "pair long, links long").groupBy("pair").agg(F.sum("links").alias("links"))
    return counted.withColumn("b", F.pmod("pair", F.lit(_IDS)))


def _frequent(pairs: DataFrame, most: int) -> pd.DataFrame:
    """The pairs with the highest counts, at most ``most``: a cut through the counts, found from how many pairs
    have each count."""
    total, least = 0, None
    sizes = pairs.groupBy("links").agg(F.count("*").alias("n")).orderBy(F.desc("links"))
    for r in sizes.toLocalIterator():
        total += r.n
        if total > most:
            break
        least = r.links
    kept = pairs.where(F.col("links") >= least) if least is not None else pairs.limit(0)
    return kept.select("pair", "links", "best").toPandas().sort_values("pair")


def aligned(docs: DataFrame, a: str = VOCABULARY_A, b: str = VOCABULARY_B, work: int = WORK,
            frequent: int = FREQUENT) -> DataFrame:
    """One row per document: counts of tokens, groups and links, the links' corpus-wide counts, and the digest
    of its groups."""
    spark = docs.sparkSession
    with arrow_rows(spark, BATCH_ROWS):
        cut = staged(pieces(docs, a, b, work), "token-pieces", compression="zstd")
        counted = staged(pair_counts(cut, a, b), "pair-counts")
    highest = counted.groupBy("b").agg(F.max("links").alias("most"))
    pairs = staged(counted.join(highest, "b").select("pair", "links", (F.col("links") == F.col("most")).alias("best")), "pairs")
    top = _frequent(pairs, frequent)
    known = spark.sparkContext.broadcast((
        top["pair"].to_numpy(np.int64), top["links"].to_numpy(np.int64), top["best"].to_numpy(bool),
    ))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = vocabularies(a, b)
        names = Names(both)
        keys, counts, best = known.value
        place = pd.Index(keys)
        for batch in _portions(batches):
            o = Overlaps(batch, both)
            found = o.keys()
            at = place.get_indexer(found)
            hit = at >= 0
            piece = o.link_piece
            rare = np.argsort(piece[~hit], kind="stable")
            rare_at = np.concatenate([[0], np.cumsum(o.per_piece(piece[~hit]))])
            parts = list(o.groups(names))
            alone = batch.column("pieces").to_numpy() == 1
            n_a, n_b = o.per_piece(o.piece["a"]), o.per_piece(o.piece["b"])
            sha = [(hashlib.sha256(closed).hexdigest() if closed else "") if one else None
                   for one, (closed, _, _) in zip(alone, parts, strict=True)]
            columns = [batch.column(c) for c in ("doc_row", "doc_id", "piece", "pieces")] + [
                pa.array(x) for x in (
                    n_a, n_b, o.per_piece(o.piece["a"][o.common["a"]]), o.per_piece(piece),
                    o.per_piece(piece[hit][best[at[hit]]]), o.per_piece(piece[hit], counts[at[hit]]),
                )
            ] + [pa.array(sha, pa.string())] + [
                pa.array([None if one else p[k].decode() for one, p in zip(alone, parts, strict=True)], pa.string()) for k in range(3)
            ] + [pa.ListArray.from_arrays(pa.array(rare_at, pa.int32()), pa.array(found[~hit][rare]))]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _SCORED.split(", ")])

    sums = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
    with arrow_rows(spark, BATCH_ROWS):
        scored = staged(cut.mapInArrow(score, _SCORED), "scored-pieces")
    base = scored.select("doc_row", "doc_id", *sums, "groups_sha256")
    rare = scored.select("doc_row", F.explode("rare").alias("pair")).join(pairs, "pair").groupBy("doc_row").agg(
        F.count_if("best").alias("n_best"), F.sum("links").alias("count_sum")
    )
    stitched = scored.where("pieces > 1").select("doc_row", "piece", "closed", "open_a", "open_b").groupBy(
        "doc_row"
    ).applyInPandas(_stitch, "doc_row long, groups_sha256 string")
    whole = base.unionByName(rare, allowMissingColumns=True).unionByName(stitched, allowMissingColumns=True)
    return whole.groupBy("doc_row").agg(
        F.max("doc_id").alias("doc_id"), *[F.sum(c).alias(c) for c in sums], F.max("groups_sha256").alias("groups_sha256"),
    ).drop("doc_row")


def stitched_groups(parts: Iterator[tuple[str, str, str]]) -> Iterator[str]:
    """Closed groups of consecutive pieces: what a piece leaves open goes in front of the next closed group."""
    open_: tuple[list[str], list[str]] = ([], [])
    for closed, a, b in parts:
        if closed:
            first, _, rest = closed.partition(";")
            sides = first.split("|")
            yield "|".join(",".join([*o, s]) for o, s in zip(open_, sides, strict=True))
            if rest:
                yield rest
            open_ = ([], [])
        for o, s in zip(open_, (a, b), strict=True):
            if s:
                o.append(s)


def _stitch(own: pd.DataFrame) -> pd.DataFrame:
    own = own.sort_values("piece")
    digest = hashlib.sha256()
    mark = b""
    for text in stitched_groups(own[["closed", "open_a", "open_b"]].itertuples(index=False, name=None)):
        digest.update(mark + text.encode())
        mark = b";"
    return pd.DataFrame({"doc_row": own["doc_row"].iloc[:1], "groups_sha256": [digest.hexdigest()]})


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aligned(table(spark, sf_dir, "documents"))
