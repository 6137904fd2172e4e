"""Personal data: overlapping candidate spans, boosted trees over format and context, calibrated cuts.

1. ``rule_spans`` finds the four kinds by fixed rules; these spans always stay.
2. ``candidates`` proposes many more spans of the same kinds (looser separators, spelled-out signs,
   numbers that fail a checksum), overlapping or not.
3. ``learn`` takes a bounded sample of documents and labels candidates. Positive are those that a rule span
   lies in, and every rule span rewritten where it stands into the forms that no rule finds (``rewritten``:
   spelled-out signs, colon-hex, other separators, no +). Negative are those that fail their kind's check,
   and those without a cue next to them; what overlaps a rule span or has a cue is no negative. It fits boosted trees on format and context features (the checks of the rules are no
   features), calibrates the scores on the third of the documents that the trees haven't seen, and
   picks per kind the lowest cut whose calibrated probability reaches ``PRECISION``.
4. Candidates above the cut join the rule spans.

Only the fit uses a sample (``SAMPLE_DOCS`` documents, ``SAMPLE_SPANS`` spans); every text is scanned
whole. The scan is one narrow pass without a shuffle, and linear in a text's length.

Defined cases: a null or empty text has no spans; a null ``doc_id`` is passed through and never
sampled; repeated rows each get their own row; extra columns are ignored by ``find`` and kept by
``redact``; without candidates in the sample no candidate is selected.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridgale.llm.boosting import Trees, calibrated, fit
from gridgale.llm.common import hash_sample, id_and_text, table
from gridgale.llm.spans import Span, digest, joined, replaced

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)

SAMPLE_DOCS = 4000
SAMPLE_SPANS = 20000
PRECISION = 0.95

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A quad can only begin where a run of digits begins, and a run is never given back: same matches, linear time.
_QUAD = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_ANY_QUAD = re.compile(r"[0-9]\.[0-9]")
_DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NO_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(int(d) * 2 - 9 * (d > "4") for d in digits[-2::-2])) % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    """One match per @ at most: the local part is the whole run before it, back to the last match."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, EMAIL, m.end()
            last = m.end()
        at = text.find("@", max(at + 1, last))


def rule_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches per kind; a match that fails its check is dropped, not retried."""
    out = list(_emails(text))
    for m in _QUAD.finditer(text) if _ANY_QUAD.search(text) else ():
        if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split(".")):
            out.append((m.start(), IP, m.end()))
    for m in _DIGITS.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), CARD, m.end()))
    for m in _PHONE.finditer(text):
        if 10 <= len(_NO_DIGIT.sub("", m[0])) <= 15:
            out.append((m.start(), PHONE, m.end()))
    return sorted(out)


# High-recall generators. Repetitions are bounded, so that a long run cannot make them quadratic.
_LOOSE = (
    (EMAIL, re.compile(
        r"(?<![\w.+%-])[\w.+%-]{1,64} ?(?:@|[\[(] ?at ?[\])]) ?[\w-]{1,63}(?: ?(?:\.|[\[(] ?dot ?[\])]) ?[\w-]{1,63}){1,8}"
    )),
    (IP, re.compile(r"(?<![0-9.])[0-9]{1,6}(?:\.[0-9]{1,6}){3}(?![0-9])")),
    (IP, re.compile(r"(?<![0-9A-Fa-f:])[0-9A-Fa-f]{1,4}(?::{1,2}[0-9A-Fa-f]{1,4}){3,7}(?![0-9A-Fa-f:])")),
    (CARD, re.compile(r"(?<![0-9])[0-9](?:[ ./-]?[0-9]){12,18}(?![0-9])")),
    (PHONE, re.compile(r"(?<![0-9])(?:\+|00)[0-9](?:[ ()./-]{0,2}[0-9]){8,14}(?![0-9])")),
    (PHONE, re.compile(r"(?<![0-9+])\(?[0-9]{2,4}\)?[ ./-]{1,2}[0-9]{2,4}(?:[ ./-][0-9]{2,5}){1,3}(?![0-9])")),
)


# What any match of the generators holds; most texts hold neither and are done after two quick looks.
_AT_SIGN = re.compile(r"@|[\[(] ?at ?[\])]")
_NUMERIC = re.compile(r"[0-9][ ()./-]{0,2}[0-9]|[0-9A-Fa-f]:")


def candidates(text: str) -> list[Span]:
    numeric = _NUMERIC.search(text) is not None
    out: set[Span] = set()
    for kind, pattern in _LOOSE:
        if _AT_SIGN.search(text) if kind == EMAIL else numeric:
            out.update((m.start(), kind, m.end()) for m in pattern.finditer(text))
    return sorted(out)


_CUES = (
    re.compile(r"mail|contact|write to|@", re.I), re.compile(r"\bip\b|host|server|addr|subnet|port\b", re.I),
    re.compile(r"card|visa|credit|pay|account|iban", re.I), re.compile(r"phone|tel\b|call|mobile|fax|dial", re.I),
)
_GROUPS = re.compile(r"[0-9]+")
_REACH = 40
WIDTH = 24
_CUE = 22  # place of the cue among the features


def features(text: str, span: Span) -> list[float]:
    """Format of the span and of what stands next to it."""
    start, kind, end = span
    s = text[start:end]
    before, after = text[max(0, start - _REACH):start], text[end:end + _REACH]
    groups = [len(g) for g in _GROUPS.findall(s)] or [0]
    digits, letters = sum(groups), sum(c.isalpha() for c in s)
    seps = [c for c in s if not c.isalnum()]
    left, right = before[-1:], after[:1]
    around = before + after
    return [
        float(kind == EMAIL), float(kind == IP), float(kind == CARD), float(kind == PHONE),
        len(s), digits, letters, len(seps), len(set(seps)), len(groups), max(groups), min(groups),
        float(s[0] == "+"), float("(" in s), s.count("."), s.count(" "), s.count("-"),
        len(s.rpartition(".")[2]) if "." in s else 0,
        float(left == "" or left.isspace()), float(left.isalnum()), float(right == "" or right.isspace()),
        float(right.isalnum()), float(bool(_CUES[kind].search(around))),
        sum(c.isdigit() for c in around) / (len(around) + 1),
    ]


def rewritten(kind: int, span: str) -> list[str]:
    """A rule span in the forms that the generators propose and no rule finds."""
    if kind == EMAIL:
        local, _, domain = span.partition("@")
        return [f"{local} [at] {domain.replace('.', ' [dot] ')}", f"{local}(at){domain}", f"{local} @ {domain}",
                f"{local} (at) {domain.replace('.', '(dot)')}"]
    digits = _NO_DIGIT.sub("", span)
    if kind == IP:
        h = hashlib.sha256(span.encode()).hexdigest()
        groups = [h[i:i + 4].lstrip("0") or "0" for i in range(0, 24, 4)]
        return [f"2001:db8:{':'.join(groups)}", f"fe80::{':'.join(groups[:4])}", f"2001:{':'.join(groups[:2])}::{groups[2]}"]
    if kind == CARD:
        fours = [digits[i:i + 4] for i in range(0, len(digits), 4)]
        return [".".join(fours), "/".join(fours)]
    country, a, b, c = digits[:-10], digits[-10:-7], digits[-7:-4], digits[-4:]
    return [f"00{span[1:]}", f"00{country}{a}{b}{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}"]


def _impossible(kind: int, s: str) -> bool:
    """The span fails its kind's check, whatever stands next to it."""
    if kind == CARD:
        return not luhn(_NO_DIGIT.sub("", s))
    return kind == IP and ":" not in s and any(int(p) > 255 for p in s.split("."))


def _overlaps(base: list[Span]) -> Callable[[Span], list[Span]]:
    """The rule spans that overlap a candidate, found by search."""
    ends = list(itertools.accumulate((e for _, _, e in base), max))

    def near(s: Span) -> list[Span]:
        at = base[bisect.bisect_right(ends, s[0]):bisect.bisect_left(base, (s[2],))]
        return [r for r in at if r[2] > s[0]]

    return near


def labels(text: str) -> Iterator[tuple[Span, int, int, list[float]]]:
    """(span, form, label, features): form 0 as it stands in the text, others rewritten."""
    base = rule_spans(text)
    overlaps = _overlaps(base)
    for s in candidates(text):
        near = overlaps(s)
        if any(k == s[1] and s[0] <= b and e <= s[2] for b, k, e in near):
            yield s, 0, 1, features(text, s)
        elif not near and (_impossible(s[1], text[s[0]:s[2]]) or not features(text, s)[_CUE]):
            yield s, 0, 0, features(text, s)
    for b, kind, e in base:
        before, after = text[max(0, b - 2 * _REACH):b], text[e:e + 2 * _REACH]
        for form, new in enumerate(rewritten(kind, text[b:e]), 1):
            there, start, end = before + new + after, len(before), len(before) + len(new)
            for s in candidates(there):
                if s[1] == kind and s[0] <= start and end <= s[2]:
                    yield (b, kind, e), form, 1, features(there, s)
                    break


@dataclass(frozen=True)
class Model:
    trees: Trees | None
    cuts: tuple[float, ...]  # margins per kind; inf selects none

    def select(self, text: str) -> list[Span]:
        found = candidates(text) if self.trees is not None else []
        if not found:
            return []
        margin = self.trees.margin(np.array([features(text, s) for s in found]))
        return [s for s, m in zip(found, margin, strict=True) if m >= self.cuts[s[1]]]

    def all_spans(self, text: str) -> tuple[list[Span], list[Span]]:
        """Rule spans, and these together with the selected candidates that reach beyond them."""
        base = rule_spans(text)
        overlaps = _overlaps(base)
        more = [s for s in self.select(text) if not any(b <= s[0] and s[2] <= e for b, _, e in overlaps(s))]
        return base, sorted({*base, *more})


def _labelled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = [
            (doc, *s, form, y, x)
            for doc, text in zip(batch["doc_id"], batch["text"], strict=True) for s, form, y, x in labels(text)
        ]
        yield pd.DataFrame(rows, columns=["doc_id", "start", "kind", "end", "form", "y", "x"])


def learn(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_spans: int = SAMPLE_SPANS,
          precision: float = PRECISION, seed: int = 11) -> Model:
    texts = id_and_text(docs).where("text IS NOT NULL")
    ids = hash_sample(texts, sample_docs, seed)
    sample = texts.join(F.broadcast(ids), "doc_id").dropDuplicates(["doc_id"])  # at most sample_docs ids
    key = ["doc_id", "start", "kind", "end", "form"]
    rows = (
        sample.mapInPandas(_labelled, "doc_id long, start int, kind int, end int, form int, y int, x array<double>")
        .orderBy(F.xxhash64(F.lit(seed), *key), *key).limit(sample_spans).toPandas().sort_values(key)
    )
    none = (float("inf"),) * len(KINDS)
    if rows.empty or rows["y"].nunique() < 2:
        return Model(None, none)
    x, y, kind = np.stack(rows["x"].to_numpy()), rows["y"].to_numpy(float), rows["kind"].to_numpy()
    held = (rows["doc_id"].to_numpy(np.int64) % 3) == 0
    if held.all() or not held.any() or len(set(y[~held])) < 2:
        held[:] = False
    trees = fit(x[~held], y[~held])
    margin, cuts = trees.margin(x), []
    for k in range(len(KINDS)):
        mine = (held if held.any() else np.ones(len(y), bool)) & (kind == k)
        steps, prob = calibrated(margin[mine], y[mine]) if mine.any() else (np.array([]), np.array([]))
        good = steps[prob >= precision]
        cuts.append(float(good.min()) if len(good) else float("inf"))
    return Model(trees, tuple(cuts))


_FOUND = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long"


def find(docs: DataFrame, model: Model) -> DataFrame:
    """One row per document: counts and digest of the rule spans, and all spans."""

    @F.pandas_udf(_FOUND)
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text in batch:
                base, every = model.all_spans(text)
                counts = np.bincount([k for _, k, _ in base], minlength=len(KINDS)) if base else np.zeros(4, int)
                rows.append((*counts.tolist(), digest(base, KINDS), joined(every, KINDS), len(every)))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _FOUND.split(", ")])

    return id_and_text(docs).select(
        "doc_id", scan(F.coalesce("text", F.lit(""))).alias("found")
    ).select("doc_id", "found.*")


def redact(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; all columns stay, a null text stays null."""

    @F.pandas_udf("string")
    def cover(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([
                None if t is None else replaced(t, model.all_spans(t)[1], KINDS) for t in batch
            ], dtype=object)

    return docs.withColumn(text_col, cover(F.col(text_col)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return find(docs, learn(docs))
