"""Best-fit packing of token pieces into sequences, improved by swap-based local search.

1. ``pieces`` encodes every whole text once, in one narrow pass, appends the end id and cuts only what
   is longer than a sequence. The vocabulary splits at white space, so a text's ids are its words' ids
   in a row; each worker keeps the ids of the first ``CACHED`` words it meets, the rest is encoded once a batch.
2. Full pieces are sequences by themselves. The others are dealt round-robin into shards of about
   ``SHARD`` pieces, so tasks stay equal however documents are spread, and a task holds a fixed
   number of small rows. Nothing but lengths and numbers is shuffled.
3. A shard is packed best-fit decreasing. Then pieces are exchanged between all sequences with room: a
   move, one for one, two for one or one for two. Each sequence, the fullest first, takes from the emptiest
   that holds a fitting size, each time by the exchange that raises the sum of squared fills most, so room
   gathers in few sequences until they empty. Partners are looked up by size. Passes end at the least
   possible number, when nothing raises the sum, or after ``STEPS`` exchanges a sequence with room.

Defined cases: a null or empty text is the end id alone; rows without ``doc_id`` and repeated rows are
packed like others; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import heapq
import itertools
import math
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridgale.llm.common import id_and_text, staged, table

VOCABULARY = "word_bpe_49k.json"
LENGTH, END_ID = 2048, 0
SHARD, CACHED, AT_ONCE = 50_000, 400_000, 4_000_000
STEPS, PAIRED = 20, 12
_LONG_WORD = 64
_LETTERS = re.compile(r"[a-zß-öø-ÿ]+")
_SIGNS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c != "'")
_SPACES = re.compile(r"[\t\n\r\x0b\x0c]")

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_PACKED = _PIECES + ", sequence_id long, offset long"


class _Words(dict):
    """Ids of words as little-endian bytes; what is missing is encoded, and kept while there is room."""

    def __init__(self, vocabulary: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        super().__init__({"": b""})
        self.passing: list[str] = []
        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(vocabulary))
        # Small Latin-1 letters are in the vocabulary's normal form and one part of its first split.
        self.bare = Tokenizer.from_file(public_tokenizers.path(vocabulary))
        self.bare.normalizer = normalizers.Sequence([])
        self.bare.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)

    def learn(self, words: set[str]) -> None:
        """Encode new words in one call. A word of letters and closing signs is two tokens of the
        vocabulary's first split, so each half is encoded once for all words that share it."""
        self.forget()
        halves, whole = {}, set()
        for w in words:
            if len(w) > _LONG_WORD:
                continue
            head = w.rstrip(_SIGNS)
            if len(head) < len(w) and _LETTERS.fullmatch(head):
                tail = w[len(head):]
                halves[w] = head, tail
                whole.add(head)
                whole.add(tail)
            else:
                whole.add(w)
        new = [w for w in whole if w not in self]
        letters = list(filter(_LETTERS.fullmatch, new))
        self._encode(letters, self.bare)
        self._encode([w for w in new if w not in self], self.tokenizer)
        for w, (head, tail) in halves.items():
            self[w] = self[head] + self[tail]
        if len(self) > CACHED:
            self.passing = [*new, *halves]

    def _encode(self, words: list[str], tokenizer) -> None:
        flat, ends = array("I"), [0]
        for e in tokenizer.encode_batch_fast(words, add_special_tokens=False):
            flat.extend(e.ids)
            ends.append(4 * len(flat))
        ids = np.array(flat, "<u4").tobytes()
        self.update(zip(words, map(ids.__getitem__, map(slice, ends, ends[1:])), strict=True))

    def forget(self) -> None:
        """Beyond the room, words last for one batch only; those met first, the common ones, stay."""
        for w in self.passing:
            self.pop(w, None)
        self.passing = []

    def __missing__(self, word: str) -> bytes:
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()


@functools.lru_cache(maxsize=1)
def _words(vocabulary: str) -> _Words:
    return _Words(vocabulary)


def _split(text: str) -> list[str]:
    """At ASCII white space only: other spaces are left to the vocabulary's own rule. Latin-1 texts are
    lower-cased here, where that is the vocabulary's normal form; others are left to it too."""
    try:
        text.encode("latin-1")
        text = text.lower()
    except UnicodeEncodeError:
        pass
    return _SPACES.sub(" ", text).split(" ")


def encoded(texts: list[str], words: _Words) -> Iterator[bytes]:
    """Each whole text's ids. Words are gathered over some ``AT_ONCE`` characters of texts at a time."""
    at = 0
    while at < len(texts):
        split, chars = [], 0
        while at < len(texts) and chars < AT_ONCE:
            split.append(_split(texts[at]))
            chars += len(texts[at])
            at += 1
        words.learn(set().union(*split).difference(words))
        for parts in split:
            yield b"".join(map(words.__getitem__, parts))


def pieces(docs: DataFrame, vocabulary: str = VOCABULARY, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = _words(vocabulary)
        for batch in batches:
            rows = []
            texts = encoded(batch["text"].tolist(), words)
            for doc, ids in zip(batch["doc_id"].astype(object), texts, strict=True):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * length)):
                    own = ids[at:at + 4 * length]
                    rows.append((None if pd.isna(doc) else doc, k, at // 4, len(own) // 4, zlib.crc32(own)))
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"]).astype(
                {"doc_id": "Int64"}
            )

    texts = id_and_text(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return texts.mapInPandas(cut, _PIECES)


def best_fit(sizes: np.ndarray, length: int) -> np.ndarray:
    """Bin of each size: largest first, each into the fullest bin that has room."""
    bins = np.empty(len(sizes), np.int64)
    by_room: list[list[int]] = [[] for _ in range(length + 1)]
    some, count = 0, 0  # bit r: there is a bin with room r
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fits = some >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            at = by_room[room].pop()
            if not by_room[room]:
                some ^= 1 << room
        else:
            room, at = length, count
            count += 1
        bins[i] = at
        room -= size
        by_room[room].append(at)
        some |= 1 << room
    return bins


def _lots(own: list[int], size: list[int]) -> Iterator[tuple[int, tuple[int, ...]]]:
    """What a sequence can give, one lot of each size: a piece, or two of its ``PAIRED`` largest."""
    lots: dict[int, tuple[int, ...]] = {}
    for i in own:
        lots.setdefault(size[i], (i,))
    big = sorted(own, key=size.__getitem__, reverse=True)[:PAIRED]
    for i, j in itertools.combinations(big, 2):
        lots.setdefault(size[i] + size[j], (i, j))
    yield from lots.items()


def local_search(sizes: np.ndarray, bins: np.ndarray, length: int, steps: int = STEPS) -> np.ndarray:
    """Exchanges between bins with room, each raising the sum of squared fills, until as few as possible are
    left, none raises it, or ``steps`` a bin with room are done. The number of bins never grows."""
    bins = bins.copy()
    if not len(bins):
        return bins
    size = sizes.tolist()
    fill = np.bincount(bins, sizes).astype(np.int64).tolist()
    least, smallest = math.ceil(sum(size) / length), min(size)
    count = sum(f > 0 for f in fill)
    held: dict[int, list[int]] = {b: [] for b, f in enumerate(fill) if 0 < f < length}
    for i, b in enumerate(bins.tolist()):
        if b in held:
            held[b].append(i)
    # By size of a lot: (fill, bin, version) of the bins that hold one, emptiest first; old versions are passed over.
    offers: dict[int, list[tuple[int, int, int]]] = {}
    version = dict.fromkeys(held, 0)
    lots: dict[int, dict[int, tuple[int, ...]]] = {}

    def offer(b: int) -> None:
        version[b] += 1
        lots[b] = dict(_lots(held[b], size)) if 0 < fill[b] < length else {}
        for total in lots[b]:
            heapq.heappush(offers.setdefault(total, []), (fill[b], b, version[b]))

    def emptiest(total: int, but: int) -> int | None:
        heap = offers.get(total)
        while heap and version[heap[0][1]] != heap[0][2]:
            heapq.heappop(heap)
        if not heap:
            return None
        if heap[0][1] != but:
            return heap[0][1]
        return min((x for x in heap[1:3] if version[x[1]] == x[2]), default=(0, None))[1]

    def exchange(b: int) -> int | None:
        """Best exchange that fills bin ``b``; the other bin."""
        best, found = 0, None
        for given, give in ((0, ()), *lots[b].items()):
            # Moving gain from fill c to fill b changes the sum by 2 gain (b - c + gain).
            for gain in range(length - fill[b], max(0, smallest - given - 1), -1):
                if gain * (fill[b] - given) <= best:  # fill c is given + gain at least
                    break
                if given + gain not in offers or (c := emptiest(given + gain, b)) is None:
                    continue
                take = lots[c][given + gain]
                if len(give) + len(take) < 4 and (worth := gain * (fill[b] - fill[c] + gain)) > best:
                    best, found = worth, (c, give, take, gain)
        if found is None:
            return None
        c, give, take, gain = found
        for x, y, out in ((b, c, give), (c, b, take)):
            held[x] = [i for i in held[x] if i not in out]
            held[y] += out
            bins[list(out)] = y
        fill[b] += gain
        fill[c] -= gain
        offer(b)
        offer(c)
        return c

    for b in held:
        offer(b)
    left, todo = steps * len(held), set(held)
    while todo and left > 0 and count > least:
        changed = set()
        for b in sorted(todo, key=lambda b: -fill[b]):
            while 0 < fill[b] < length and left > 0 and count > least and (c := exchange(b)) is not None:
                left -= 1
                count -= fill[c] == 0
                changed |= {b, c}
        # What changed may offer something new to any bin, so all with room look again.
        todo = {b for b in held if 0 < fill[b] < length} if changed else set()
    return bins


def pack_sizes(sizes: np.ndarray, length: int = LENGTH) -> np.ndarray:
    return local_search(sizes, best_fit(sizes, length), length)


def packed(docs: DataFrame, vocabulary: str = VOCABULARY, length: int = LENGTH, end_id: int = END_ID,
           shard: int = SHARD) -> DataFrame:
    """One row per piece with its sequence and its place there."""
    cut = staged(pieces(docs, vocabulary, length, end_id), "pieces")
    part = cut.where(F.col("length") < length)
    full = cut.where(F.col("length") >= length)

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frames = list(batches)
        if not frames:
            return
        own = pd.concat(frames, ignore_index=True)
        own["bin"] = pack_sizes(own["length"].to_numpy(np.int64), length)
        own = own.sort_values("bin", kind="stable")
        own["offset"] = own.groupby("bin")["length"].cumsum() - own["length"]
        own["sequence_id"] = (TaskContext.get().partitionId() << 32) + own["bin"]
        yield own[[c.split()[0] for c in _PACKED.split(", ")]].astype({"doc_id": "Int64"})

    shards = max(1, math.ceil(part.count() / shard))
    alone = full.withColumns({
        "sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long"),
    })
    return part.repartition(shards).mapInPandas(pack, _PACKED).unionByName(alone)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))
