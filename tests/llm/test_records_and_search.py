"""Archives, alignment and ranked search against plain readings of their definitions, odd cases included."""

import base64
import gzip
import hashlib
import io
import math
import random
import re
from collections import Counter

import pytest

from gridgale.llm import alignment, lexical, warc

# --- archives ------------------------------------------------------------------------------

PAGES = [
    (1, "http://a.org/x?y=1", "<p>one</p>"), (2, "http://a.org/\r\nZ", "<p>one</p>"), (2, "http://a.org/\r\nZ", "<p>one</p>"),
    (3, None, None), (4, "no scheme", ""), (None, "http://b.org", "<p>one</p>"), (None, None, "only here"),
    (7, "http://c.org/", "WARC/1.1\r\nContent-Length: 5\r\n\r\nü\r\n\r\n"), (8, "http://d.org/", "é" * 300_000),
]


def expected_pages(rows):
    out, groups = [], {}
    for k, (page, _, html) in enumerate(rows):
        groups.setdefault((html or "").encode(), []).append((page is not None, page or 0, k))
    for k, (page, _, html) in enumerate(rows):
        body = (html or "").encode()
        first = max(groups[body])[2]
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        out.append((page, len(body), digest, "response" if first == k else "revisit", None if first == k else rows[first][0]))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def archive(spark, make, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("warc") / "a")
    pages = make("pages", PAGES).selectExpr("*", "1 AS capture", "'x' AS payload", "2 AS first")
    warc.write(pages, path, records=7)
    return path


def test_archives_come_back_whole(spark, archive):
    assert sorted(map(tuple, warc.page_records(spark, archive).collect()), key=repr) == expected_pages(PAGES)
    records = warc.read(spark, archive).collect()
    assert Counter(r.type for r in records) == {"request": 9, "metadata": 9, "response": 5, "revisit": 4}
    assert {bytes(r.payload).decode() for r in records if r.type == "response"} == {h or "" for _, _, h in PAGES}
    assert {r.target_uri for r in records if r.fields.get("page_id") == "2"} == {"http://a.org/%0D%0AZ"}
    nested = warc.captures(warc.read(spark, archive)).collect()
    assert len(nested) == 9 and all(len(r.requests) == len(r.metadata) == 1 and r.part == 0 for r in nested)


def test_an_empty_table_and_a_damaged_file(spark, make, tmp_path):
    warc.write(make("pages", []), str(tmp_path / "none"))
    assert warc.page_records(spark, str(tmp_path / "none")).count() == 0
    record = b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <r>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    for content in (record + record[:-6], gzip.compress(record) + gzip.compress(record)[:-9], record + b"no archive"):
        stream = io.BytesIO(content)
        stream = gzip.GzipFile(fileobj=stream) if content[:2] == b"\x1f\x8b" else stream
        kinds = [r[0] for r in warc.parsed(stream)]
        assert kinds[0] == "resource" and kinds[-1] == "damaged"


def test_links_of_every_direction_and_large_captures(spark):
    def row(kind, name, to=()):
        return (kind, name, list(to))

    rows = [row("response", "R"), row("request", "Q", ["R"]), row("metadata", "M", ["Q"]), row("response", "S", ["T"]),
            row("request", "T"), row("request", "alone"), row("metadata", "N", ["gone", "S"]), row("damaged", None)]
    rows += [row("metadata", f"m{i}", ["R"]) for i in range(9)]
    df = spark.createDataFrame(rows, "type string, record_id string, concurrent_to array<string>")
    got = [(r.capture, r.part, r.response is not None, {x.record_id for x in r.requests}, {x.record_id for x in r.metadata})
           for r in warc.captures(df).collect()]
    found = {c: (resp, q, m) for c, _, resp, q, m in got}
    assert found["R"] == (True, {"Q"}, {"M", *(f"m{i}" for i in range(9))})
    assert found["S"] == (True, {"T"}, {"N"}) and found["alone"] == (False, {"alone"}, set()) and len(got) == 3
    split = warc.captures(df, members=3).where("capture = 'R'").collect()
    assert sum(len(r.metadata) + len(r.requests) for r in split) == 11 and len({r.part for r in split}) == len(split) > 1


# --- alignment -----------------------------------------------------------------------------

def brute_alignment(texts):
    both = alignment.vocabularies(alignment.VOCABULARY_A, alignment.VOCABULARY_B)
    rows, counts = [], Counter()
    for text in texts:
        a = both.a.encode(" " + text, add_special_tokens=False).ids if text else []
        b = both.b.encode(text) if text else []
        whole = (" " + text).encode() if text else b""
        if b"".join(both.bytes_a[i] for i in a) != whole or b"".join(both.bytes_b[i] for i in b) != whole:
            a, b = [], []
        spans = []
        for ids, names in ((a, both.bytes_a), (b, both.bytes_b)):
            at, own = 0, []
            for i in ids:
                own.append((at, at + len(names[i]), i))
                at += len(names[i])
            spans.append(own)
        links = [(x, y) for s, e, x in spans[0] for u, v, y in spans[1] if s < v and u < e]
        ends = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        groups, before = [], 0
        for end in ends:
            groups.append("|".join(",".join(str(i) for _, e, i in own if before < e <= end) for own in spans))
            before = end
        counts.update(links)
        rows.append((len(a), len(b), links, groups))
    best = {}
    for (_, y), n in counts.items():
        best[y] = max(best.get(y, 0), n)
    return [(a, b, len(g), len(k), sum(counts[p] == best[p[1]] for p in k), sum(counts[p] for p in k),
             hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for a, b, k, g in rows]


TEXTS = [
    None, "", " ", "  two  spaces ", "a\n b \n\n c\t d", "<|endoftext|> <s> x", "x ▁y", "naïve café ﬃ 漢字 🎈🎈", "don't 3.14, (ok)!!",
    "the cat sat on the mat", "the cat sat on the mat", "aaaa" * 200, "!" * 300, " nbsp  wide",
    " ".join(random.Random(3).choice(["alpha", "beta,", "γάμμα", "x1", "..."]) for _ in range(400)),
]


@pytest.mark.parametrize("work,frequent", [(16_384, 500_000), (7, 5)])
def test_alignment_equals_brute_force(spark, make, work, frequent):
    docs = make("documents", list(enumerate(TEXTS))).selectExpr("*", "1 AS piece", "2 AS doc_row", "'x' AS a")
    got = {r.doc_id: tuple(r)[1:] for r in alignment.aligned(docs, work=work, frequent=frequent).collect()}
    want = brute_alignment(TEXTS)
    assert [got[i] for i in range(len(TEXTS))] == want and want[6][0] == 0 and want[-1][0] > 400
    assert alignment.aligned(make("documents", [])).count() == 0


def test_new_words_are_encoded_together_and_come_out_as_alone(monkeypatch):
    both = alignment.vocabularies(alignment.VOCABULARY_A, alignment.VOCABULARY_B)
    both.clear()
    rng = random.Random(11)
    words = sorted({"".join(rng.choice("abcdeñü.,1") for _ in range(rng.randrange(1, 9))) for _ in range(4000)})
    odd = ["ﬃx", "x▁y", "aﬀa", "a\nb", "c\td", "漢字", "🎈🎈", "<s>"]
    texts = [" ".join(words[:1500] + odd[:4]), None, "  two  " + " ".join(odd[4:]), "", " ".join(words[1500:])]
    calls, plain = [], type(both)._ids
    monkeypatch.setattr(type(both), "_ids", lambda self, own: calls.append(len(own)) or plain(self, own))
    ids, counts = both.encode(texts)
    # Some thousand words take a few calls: joined texts, those of texts that come out different, and no more.
    assert 1 <= len(calls) <= 3
    both.clear()
    for s, names in (("a", both.bytes_a), ("b", both.bytes_b)):
        starts = [0, *counts[s].cumsum().tolist()]
        # A text with a word of another form has no tokens.
        assert counts[s].tolist()[:2] == [0, 0] and counts[s][3] == 0 and counts[s][2] > 0 and counts[s][4] > len(words) - 1501
        for t in (2, 4):
            own = ids[s][starts[t]:starts[t + 1]].tolist()
            assert b"".join(names[i] for i in own).decode() == " " + texts[t]
            alone = plain(both, [texts[t]])[s == "b"][0]
            assert own == alone
    both.clear()


# --- search --------------------------------------------------------------------------------

_TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_terms(text):
    return _TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute_search(docs, items, top):
    own = [(d, Counter(plain_terms(t))) for d, t in docs]
    own = [(d, c, sum(c.values())) for d, c in own if c]
    big_n, big_l = len(own), sum(n for _, _, n in own)
    df = Counter(t for _, c, _ in own for t in c)
    out = []
    for item, text in items:
        scores = []
        for d, c, n in own:
            m = 100 - 50 + (50 * n * big_n) // big_l
            s = sum(math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m))
                    for t in set(plain_terms(text)) if t in c)
            if s > 0:
                scores.append((-s, d is None, d or 0))
        out += [(item, k + 1, None if none else d, -s) for k, (s, none, d) in enumerate(sorted(scores)[:top])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("block,first,most_items", [(1000, 1000, 2000), (3, 2, 2)])
def test_search_equals_brute_force(spark, make, block, first, most_items):
    rng = random.Random(5)
    words = ["Alpha", "beta", "GAMMA", "ÄPFEL", "äpfel", "delta-7", "it's", "z"]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 30)))) for i in range(60)]
    docs += [(100, None), (101, ""), (102, " -- !"), (None, "alpha beta"), (5, docs[5][1]), (103, "beta " * 2000)]
    docs += [(200 + i, "alpha beta gamma") for i in range(30)]
    items = [(1, "alpha beta"), (2, ""), (3, None), (4, "nothing here"), (5, "ÄPFEL äpfel it's 7"), (None, "gamma gamma z"), (1, "alpha beta")]
    got = lexical.search(
        make("documents", docs).selectExpr("*", "1 AS m", "2 AS n", "'x' AS terms"),
        make("benchmark", items), top=10, block=block, first=first, most_items=most_items,
    )
    assert sorted(map(tuple, got.collect()), key=repr) == brute_search(docs, items, 10)
    assert lexical.search(make("documents", []), make("benchmark", items)).count() == 0
    assert lexical.search(make("documents", docs), make("benchmark", [])).count() == 0
