"""Main text of web pages: containers scored per page, a vote on their paths per host, a second reading.

1. Every page is read into blocks of text with the path of generalised ``tag.class`` names that holds them.
   Paragraphs give their length without links to their container, and half of it to the one around it.
2. The best container's path is the page's vote. Spark counts votes by host and path; a host's winner is
   the path with most votes, a host with few pages leaning on all hosts' shares (``PULL`` votes).
3. Pages are read again and the blocks inside the winning path are kept, or inside the page's own best
   container where the page has no such path; then so is what stands around it (``main_text``), up to the
   main or article that holds it.

Lists, tables and figures are parts of a text and no containers.

Menus, headers, footers, sidebars, notices, adverts, forms, comments, scripts and styles are told by tag,
class and id and not kept. A tag or the ``hidden`` attribute always tells; a name tells by how it is written and
by how little of the page's text it holds (``_told``), and nothing by name on html, body, main and article. A form
is told like a part of a name: one around most of the page's text is no form to leave out. Votes are pre-aggregated, so a hot host costs one row per path and task; the
winners join the pages by host, and Spark broadcasts them only while they are small.

Defined cases: a null or empty page has an empty text; a null url belongs to the empty host; a page without
any text block votes for nothing; repeated rows each get a row; extra columns are ignored; tags that are
not closed end with the element around them or with the next of their kind. Reading is linear in a page's
length, however deep its elements are nested.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridgale.llm.common import staged, table

PULL = 3

# Element kinds.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_PARAGRAPH = frozenset("p li h1 h2 h3 h4 h5 h6 pre blockquote dt dd td th figcaption caption summary address".split())
_BLOCK = _PARAGRAPH | frozenset(
    "html body main article section div ul ol dl table thead tbody tfoot tr figure details nav header footer aside "
    "form fieldset center hr".split()
)
_HOLDER = frozenset("html body main article section div details center".split())
_NEVER = frozenset(
    "head title nav footer aside button select option datalist textarea label legend noscript template iframe svg object "
    "canvas dialog menu".split()
)
_UNWANTED = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent "
    "gdpr notice alert popup modal overlay sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead "
    "comment comments commentlist discussion disqus replies share sharing social related recommended newsletter subscribe "
    "subscription signup login search toolbar pagination pager widget hidden".split()
)
_FORMS = frozenset("form fieldset".split())  # a page may stand in one as a whole: told as a part of a name is
# Names that mean little else: enough as a whole class or id, and as a part of one up to _MOST of the text.
_PLAIN = frozenset(
    "ad ads adv advert adverts advertisement advertising cookie cookies consent gdpr comment comments commentlist disqus "
    "replies newsletter breadcrumb breadcrumbs pagination pager".split()
)
# Beside one of these a word tells of the page's state, not of what the element is.
_STATE = frozenset("no non not without has have with show hide open opened closed enabled disabled free off".split())
_FRAME = frozenset("html body main article".split())
# By (plain, whole class or id): the share of the page's unlinked text below which the word tells.
_MOST = {(True, True): float("inf"), (True, False): 0.9, (False, True): 0.75, (False, False): 0.5}
# An opening tag ends what is open of its kind, up to the nearest element that may hold another.
_ENDS = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
         "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_CELLS = frozenset("td th li table".split())
_WALLS = frozenset("article section div main body aside".split())
_SCOPE = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}}

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style)\b[^>]*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*'|[\"'])*+)(?:>|\Z)", re.S | re.I
)
_NAMES = re.compile(r"""(?<![\w-])(class|id)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_DIGITS = re.compile(r"[0-9]+")
_PARTS = re.compile(r"[^a-z]+")
_QUOTED = re.compile(r"""=\s*(?:"[^"]*"|'[^']*'|[^\s"'>]+)""")
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:[\s=/]|$)", re.I)

_Mark = tuple[str, bool]  # an unwanted word, and whether it is the whole class or id
_NONE: frozenset[_Mark] = frozenset()


@dataclass
class _Open:
    tag: str
    path: int
    holder: int  # the nearest container's number, its own if it is one
    shut: bool  # nothing inside is kept
    link: bool
    marks: frozenset[_Mark]  # of this element and those around it


@dataclass
class Block:
    text: str
    holder: int  # number of the innermost container around it
    linked: int  # characters inside links


class Page(list[Block]):
    """The wanted blocks in page order, and the tree of their containers: number 0 is the page, and a container's
    number is above its parent's. Equal paths share a number; only a path that is asked for is spelled out."""

    def __init__(self) -> None:
        super().__init__()
        self.parent, self.tag, self.path = [0], [""], [0]  # of each container
        self._steps: dict[tuple[int, str], int] = {}
        self._names: list[tuple[int, str]] = [(0, "")]  # of each path: the path around it and its last name

    def step(self, path: int, name: str) -> int:
        """The number of the path that leads one name further."""
        number = self._steps.setdefault((path, name), len(self._names))
        if number == len(self._names):
            self._names.append((path, name))
        return number

    def container(self, parent: int, tag: str, path: int) -> int:
        self.parent.append(parent)
        self.tag.append(tag)
        self.path.append(path)
        return len(self.parent) - 1

    def spelled(self, path: int) -> str:
        names = []
        while path:
            path, name = self._names[path]
            names.append("/" + name)
        return "".join(reversed(names))

    def numbered(self, spelled: str) -> int | None:
        """The number of a spelled path; None where the page has no such path."""
        path: int | None = 0
        for name in spelled.split("/")[1:]:
            if (path := self._steps.get((path, name))) is None:
                return None
        return path

    def chain(self, number: int) -> list[int]:
        """The container and those around it, the page last."""
        out = [number]
        while out[-1]:
            out.append(self.parent[out[-1]])
        return out


def _label(tag: str, attributes: str) -> tuple[str, frozenset[_Mark], bool]:
    """Generalised ``tag.class`` name, the unwanted words among the names, and whether the element is hidden."""
    classes, marks = "", frozenset({(tag, False)}) if tag in _FORMS else _NONE
    for m in _NAMES.finditer(attributes):
        value = (m[2] or m[3] or m[4] or "").strip().lower()
        if tag not in _FRAME and not _UNWANTED.isdisjoint(_PARTS.split(value)):
            for name in value.split():
                parts = [p for p in _PARTS.split(name) if p]
                if _STATE.isdisjoint(parts):
                    marks |= {(p, len(parts) == 1) for p in parts if p in _UNWANTED}
        if m[1].lower() == "class" and value:
            classes = "." + _DIGITS.sub("N", value.split()[0]).replace("/", "_")
    hidden = "hidden" in attributes.lower() and tag not in ("html", "body") and _HIDDEN.search(_QUOTED.sub("=", attributes))
    return tag + classes, marks, bool(hidden)


def _told(pieces: list[tuple[str, frozenset[_Mark], bool]]) -> set[_Mark]:
    """The marks whose elements are unwanted on this page.

    Plain words go before others and whole names before parts, those that hold least first; each is held
    against the unlinked text that is left, all elements it marks together. So no page is emptied by names
    that are no whole plain word, however many elements carry them."""
    marked = [(len(text.strip()), marks) for text, marks, link in pieces if not link]
    rest = sum(n for n, _ in marked)
    open_ = set().union(*(marks for _, marks, _ in pieces))
    told: set[_Mark] = set()
    for tier, most in _MOST.items():
        left = {k for k in open_ if (k[0] in _PLAIN, k[1]) == tier}
        while left:
            held = dict.fromkeys(sorted(left), 0)
            for n, marks in marked:
                for k in marks & left:
                    held[k] += n
            k = min(held, key=held.__getitem__)
            left.remove(k)
            if held[k] < most * rest or not held[k]:
                told.add(k)
                rest -= held[k]
                marked = [(n, marks) for n, marks in marked if k not in marks]
    return told


def blocks(html: str) -> Page:
    """The page's wanted blocks of text in page order."""
    page = Page()
    stack = [_Open("", 0, 0, False, False, _NONE)]
    places: dict[str, list[int]] = defaultdict(list)  # of the open elements of each tag in the stack
    read: list[tuple[list[tuple[str, frozenset[_Mark], bool]], int]] = []
    words: list[tuple[str, frozenset[_Mark], bool]] = []
    at = 0

    def flush() -> None:
        nonlocal words
        if any(not w[0].isspace() for w in words):
            read.append((words, stack[-1].holder))
        words = []

    def say(raw: str) -> None:
        above = stack[-1]
        if raw and not above.shut:
            words.append((unescape(raw) if "&" in raw else raw, above.marks, above.link))

    def innermost(tags) -> int:
        return max((places[t][-1] for t in tags if places[t]), default=0)

    def end(to: int) -> None:
        if any(e.tag in _BLOCK for e in stack[to:]):
            flush()
        for e in stack[to:]:
            places[e.tag].pop()
        del stack[to:]

    for m in _MARKUP.finditer(html):
        say(html[at:m.start()])
        at = m.end()
        if m[3] is None:
            continue
        tag = m[3].lower()
        if m[2]:
            if places[tag]:
                end(places[tag][-1])
            continue
        if tag in _VOID:
            if tag == "br":
                say(" ")
            elif tag == "hr":
                flush()
            continue
        if last := innermost(_ENDS.get(tag, _ENDS["p"] if tag in _BLOCK else ())):
            if last > innermost(_SCOPE.get(tag, _CELLS)) and last > innermost(_WALLS):
                end(last)
        if tag in _BLOCK:
            flush()
        name, marks, hidden = _label(tag, m[4])
        above = stack[-1]
        path = page.step(above.path, name) if tag in _BLOCK else above.path
        header = tag == "header" and not places["article"] and not places["main"]
        places[tag].append(len(stack))
        stack.append(_Open(
            tag, path, page.container(above.holder, tag, path) if tag in _HOLDER else above.holder,
            above.shut or hidden or tag in _NEVER or header, above.link or tag == "a",
            above.marks | marks if marks else above.marks,
        ))
    say(html[at:])
    flush()
    said = [w for pieces, _ in read for w in pieces]
    told = _told(said) if any(marks for _, marks, _ in said) else set()
    for pieces, holder in read:
        kept = [w for w in pieces if told.isdisjoint(w[1])] if told else pieces
        if text := " ".join("".join(w[0] for w in kept).split()):
            page.append(Block(text, holder, sum(len(w[0]) for w in kept if w[2])))
    return page


def _best(page: Page) -> int | None:
    """The container that holds most text outside links; the first of equals."""
    score: dict[int, float] = defaultdict(float)
    for b in page:
        own = max(len(b.text) - b.linked, 0)
        score[b.holder] += own
        if b.holder:
            score[page.parent[b.holder]] += own / 2
    return max(score, key=lambda k: (score[k], -k)) if score else None


def best_container(page: Page) -> str | None:
    """Path of the best container; None where the page has no text."""
    best = _best(page)
    return None if best is None else page.spelled(page.path[best])


def _first(page: Page, path: int) -> int | None:
    """The first container of this path that has a block, directly or further inside."""
    inside = [0 if path == 0 else None]
    for number in range(1, len(page.parent)):
        inside.append(number if page.path[number] == path else inside[page.parent[number]])
    return next((inside[b.holder] for b in page if inside[b.holder] is not None), None)


def _around(page: Page, number: int) -> list[int]:
    """Paths of the container and of those around it, out to the main or else article that holds it."""
    chain = page.chain(number)
    for tag in ("main", "article"):
        if ends := [i for i, c in enumerate(chain) if page.tag[c] == tag]:
            chain = chain[:ends[-1] + 1]
            break
    return [page.path[c] for c in chain]


def main_text(html: str, winner: str | None) -> str:
    """Blocks of the winning container, or else of the page's best one, and of those around it, one a line.

    The widest container whose blocks outside the winner are not mainly links is kept whole; of the
    containers around that one, the blocks that are not mainly links themselves."""
    page = blocks(html)
    if not page:
        return ""
    path = page.numbered(winner) if winner is not None else None
    start = _first(page, path) if path is not None else None
    if start is None:
        start = _first(page, page.path[_best(page)])
    around = _around(page, start)
    # How many steps outside the winner a block stands; containers of one path count as one.
    steps = {p: i for i, p in enumerate(around)}
    far = [steps.get(0, len(around))]
    for number in range(1, len(page.parent)):
        far.append(steps.get(page.path[number], far[page.parent[number]]))
    links = [0] * (len(around) + 1)
    for b in page:
        if far[b.holder]:
            links[far[b.holder]] += 2 * b.linked - len(b.text)
    whole = max(i for i, balance in enumerate(accumulate(links[:-1])) if balance <= 0)
    return "\n".join(
        b.text for b in page
        if far[b.holder] <= whole or far[b.holder] < len(around) and 2 * b.linked <= len(b.text)
    )


def _vote(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in batches:
        yield pd.Series([best_container(blocks(h)) if h else None for h in batch], dtype=object)


def _read(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for pages, winners in batches:
        yield pd.Series([
            main_text(h, w) if h else "" for h, w in zip(pages, winners, strict=True)
        ], dtype=object)


def winning_paths(pages: DataFrame) -> DataFrame:
    """(host, path): the consensus of each host's pages; ``pages`` has host and html."""
    votes = staged(
        pages.select("host", F.pandas_udf(_vote, "string")("html").alias("path")).where("path IS NOT NULL")
        .groupBy("host", "path").agg(F.count("*").alias("n")), "votes",
    )
    total = votes.agg(F.sum("n")).first()[0] or 1
    common = votes.groupBy("path").agg((F.sum("n") * (PULL / total)).alias("pull"))
    # Written out, so that the size check that decides on broadcasting sees how small it is.
    return staged(votes.join(common, "path").groupBy("host").agg(
        F.max_by("path", F.struct(F.round(F.col("n") + F.col("pull"), 9), "path")).alias("path")
    ), "winners")


def extracted(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars), one row per page."""
    host = F.lower(F.coalesce(F.regexp_extract("url", r"://([^/?#]*)", 1), F.lit("")))
    own = pages.select("page_id", "url", "html", host.alias("host"))
    read = own.join(winning_paths(own), "host", "left").select(
        "page_id", "url", F.pandas_udf(_read, "string")("html", "path").alias("text")
    )
    return read.withColumn("n_chars", F.length("text").cast("long"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages"))
