"""Spans as (start, kind, end) in code points, and the digests that the queries report."""

from __future__ import annotations

import hashlib

Span = tuple[int, int, int]


def joined(spans: list[Span], kinds: tuple[str, ...]) -> str:
    """kind:start:end by start, then by the order of ``kinds``, comma-joined."""
    return ",".join(f"{kinds[k]}:{s}:{e}" for s, k, e in sorted(set(spans)))


def digest(spans: list[Span], kinds: tuple[str, ...]) -> str:
    return hashlib.sha256(joined(spans, kinds).encode()).hexdigest()


def replaced(text: str, spans: list[Span], kinds: tuple[str, ...]) -> str:
    """Cover every span by its kind in brackets; spans that overlap become one, named by the first."""
    out, at, end, kind = [], 0, -1, 0
    for s, k, e in sorted(spans):
        if s < end:
            end = max(end, e)
            continue
        if end >= 0:
            out.append(f"[{kinds[kind].upper()}]")
            at = end
        out.append(text[at:s])
        end, kind = e, k
    if end >= 0:
        out.append(f"[{kinds[kind].upper()}]")
        at = end
    return "".join(out) + text[at:]
