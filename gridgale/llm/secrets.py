"""Secrets: fixed rules, and random strings told by how badly a public vocabulary compresses them.

A token-like string (letters, digits and ``+/_=-``) is proposed whole, and what is not random as a whole
in its parts between ``=``, then ``/``, then ``_`` and ``-``. Known digests (hex of the usual lengths),
UUIDs, plain numbers and identifiers (words joined by case, ``_``, ``-``, ``.`` or ``/``) are left out; a
run of ``MIN_LETTERS`` letters of one case is a word only when the vocabulary compresses it like one; the rest is encoded with a public byte-pair vocabulary, and a string with fewer than
``MAX_RATIO`` characters a token is random: text and names give about three and more, random base-62
strings about one and a half.

Whole texts are scanned in one narrow pass without a shuffle, in time linear in their length. The
vocabulary's path is a parameter that every task resolves by itself; nothing is copied or trained.

Defined cases: a null or empty text has no spans; a null ``doc_id`` is passed through; repeated rows
each get a row; extra columns are ignored.
"""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridgale.llm.common import id_and_text, table
from gridgale.llm.spans import Span, digest, joined

KINDS = ("assign", "access", "hex", "random")
ASSIGN, ACCESS, HEX, RANDOM = range(4)

VOCABULARY = "byte_bpe_50k.tiktoken"
MIN_CHARS, MIN_LETTERS, MAX_RATIO = 16, 20, 2.0

_ASSIGN = re.compile(
    r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % MIN_CHARS)
_UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}\Z")
_HEX_ONLY = re.compile(r"[0-9a-f]+\Z|[0-9A-F]+\Z")
_DIGEST_CHARS = frozenset((32, 40, 48, 56, 64, 96, 128))
_WORDS = re.compile(r"[_\-+/=]+|(?<=[a-z])(?=[A-Z])")
_JOINTS = (re.compile(r"[^=]+"), re.compile(r"[^/]+"), re.compile(r"[^_-]+"))
_WORD = re.compile(r"(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]{1,4})\Z")


def rule_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches per kind; a match that is too short is dropped, not retried."""
    out = [(m.start(), ASSIGN, m.end()) for m in _ASSIGN.finditer(text) if len(m[1]) >= 6]
    out += [(m.start(), ACCESS, m.end()) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    # A run of hex digits shorter than 24 fails wherever it is entered, so the length can stand in the pattern.
    out += [(m.start(), HEX, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


@functools.lru_cache(maxsize=2)
def _encoding(vocabulary: str):
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(vocabulary), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding(
        vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    )


def ratio(s: str, vocabulary: str = VOCABULARY) -> float:
    """Characters a token."""
    encode = _encoding(vocabulary).encode_ordinary
    # In pieces: the encoder's time grows with the square of a run without a break.
    return len(s) / sum(len(encode(s[i:i + 256])) for i in range(0, len(s), 256))


def known(s: str) -> bool:
    """Known digests, UUIDs and plain numbers too short to be told from random ones."""
    return bool(_HEX_ONLY.match(s) and len(s) in _DIGEST_CHARS or _UUID.match(s) or len(s) < 20 and s.isdigit())


def excluded(s: str, vocabulary: str = VOCABULARY, max_ratio: float = MAX_RATIO) -> bool:
    """Known digests and identifiers."""
    if known(s):
        return True
    words = [w for w in _WORDS.split(s) if w]
    return all(_WORD.match(w) for w in words) and all(
        len(w) < MIN_LETTERS or ratio(w, vocabulary) >= max_ratio for w in words
    )


def _random(s: str, start: int, joint: int, vocabulary: str, max_ratio: float) -> Iterator[Span]:
    if len(s) < MIN_CHARS or excluded(s, vocabulary, max_ratio):
        return
    if ratio(s, vocabulary) < max_ratio:
        yield start, RANDOM, start + len(s)
    elif joint < len(_JOINTS):
        for m in _JOINTS[joint].finditer(s):
            yield from _random(m[0], start + m.start(), joint + 1, vocabulary, max_ratio)


def random_spans(text: str, vocabulary: str = VOCABULARY, max_ratio: float = MAX_RATIO) -> list[Span]:
    return [s for m in _TOKEN.finditer(text) for s in _random(m[0], m.start(), 0, vocabulary, max_ratio)]


_FOUND = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_random long"


def find(docs: DataFrame, vocabulary: str = VOCABULARY, max_ratio: float = MAX_RATIO) -> DataFrame:
    """One row per document: counts and digest of the rule spans, and all spans."""

    @F.pandas_udf(_FOUND)
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text in batch:
                base, more = rule_spans(text), random_spans(text, vocabulary, max_ratio)
                counts = np.bincount([k for _, k, _ in base], minlength=3) if base else np.zeros(3, int)
                rows.append((*counts.tolist(), digest(base, KINDS), joined(base + more, KINDS), len(more)))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _FOUND.split(", ")])

    return id_and_text(docs).select(
        "doc_id", scan(F.coalesce("text", F.lit(""))).alias("found")
    ).select("doc_id", "found.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"))
