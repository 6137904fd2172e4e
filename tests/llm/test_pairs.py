"""Near-duplicates, fingerprints and decontamination against brute force."""

import hashlib
import itertools
import random
import re

import pytest

from gridgale.llm import decontamination, minhash, simhash
from gridgale.llm.components import components, extended


def shingles(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + 5]) for i in range(max(len(words) - 4, 1)))


def brute_components(rows):
    sets = {}
    for d, t in rows:
        if d is not None:
            sets.setdefault(d, []).append(shingles(t))
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        if any(x and y and 100 * len(x & y) >= 75 * len(x | y) for x in sets[a] for y in sets[b]):
            ra, rb = find(a), find(b)
            root[max(ra, rb)] = min(ra, rb)
    return {d: find(d) for d in sets}


def corpus(seed, groups=12, words=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(30)]
    rows = []
    for _ in range(groups):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(3, words))]
        if rng.random() < 0.5:
            base = passage + base
        for _ in range(rng.randint(1, 9)):
            own = list(base)
            for _ in range(rng.randint(0, 3)):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            rows.append((len(rows) * 3 + 1, " ".join(own) if rng.random() < 0.8 else "\n".join(own).upper()))
    rows += [(1000, None), (1001, ""), (1002, " \t"), (1003, "one two"), (1004, "One  two"), (1005, "one"), (1003, "one two")]
    return rows


@pytest.mark.parametrize("seed,frequent", [(1, 64), (2, 1), (3, 2)])
def test_near_duplicates_equal_brute_force(spark, make, monkeypatch, seed, frequent):
    monkeypatch.setattr(minhash, "FREQUENT", frequent)
    rows = corpus(seed)
    out = minhash.near_duplicates(make("documents", rows).withColumnRenamed("lang", "rep")).collect()
    assert len(out) == len(rows)
    want = brute_components(rows)
    for r in out:
        assert r.component_id == want[r.doc_id], r
        assert r.kept == (r.doc_id == r.component_id)
        assert r.n_shingles in {len(shingles(t)) for d, t in rows if d == r.doc_id}


def test_a_large_group_of_near_copies_is_one_component(spark, make, monkeypatch):
    monkeypatch.setattr(minhash, "FREQUENT", 8)
    rng = random.Random(4)
    base = [f"b{i}" for i in range(150)]
    rows = []
    for i in range(120):
        own = list(base)
        for _ in range(rng.randint(0, 9)):
            own[rng.randrange(150)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(own)))
    out = {r.doc_id: r.component_id for r in minhash.near_duplicates(make("documents", rows)).collect()}
    assert out == brute_components(rows)


def test_deduplicated_keeps_one_of_each_group(make):
    rows = corpus(5)
    docs = make("documents", rows + [(None, "alone and without a number"), (None, "alone and without a number")])
    kept = minhash.deduplicated(docs)
    assert kept.columns == docs.columns
    ids = sorted(r.doc_id for r in kept.collect() if r.doc_id is not None)
    assert ids == sorted(set(brute_components(rows).values()))
    assert kept.where("doc_id IS NULL").count() == 1
    assert minhash.near_duplicates(docs.limit(0)).count() == 0
    unnumbered = minhash.near_duplicates(docs.where("doc_id IS NULL")).collect()
    assert [(r.component_id, r.kept) for r in unnumbered] == [(None, True)] * 2


def test_components_of_long_chains(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 90), (95, 100), (95, 95), (7, 3)]
    out = {r.node: r.root for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert out == {**{i: 0 for i in range(1, 41)}, 95: 90, 100: 90}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_components_and_their_extension_equal_a_plain_search(spark, seed):
    rng = random.Random(seed)
    links = [(rng.randrange(120), rng.randrange(120)) for _ in range(90)]

    def plain(pairs):
        root = list(range(120))
        for _ in range(120):
            for a, b in pairs:
                root[a] = root[b] = min(root[a], root[b])
        return {n: r for n, r in enumerate(root) if n != r}

    first, more = (spark.createDataFrame(x, "u long, v long") for x in (links[:60], links[60:]))
    roots = components(first)
    assert {r.node: r.root for r in roots.collect()} == plain(links[:60])
    assert {r.node: r.root for r in extended(roots, more).collect()} == plain(links)


def simhash_of(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r.fingerprint for r in simhash.fingerprints(df, ["doc_id"]).collect()}


def test_fingerprints_are_the_signed_votes_of_word_pairs(spark):
    text = "the cat and the cat and a dog"
    words = text.split()
    pairs = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(zip(words, words[1:]))], "i int, a string, b string")
    hashes = [r.h % 2**64 for r in pairs.selectExpr("xxhash64(a, b) AS h").collect()]
    want = sum(1 << k for k in range(64) if 2 * sum((h >> k) & 1 for h in hashes) > len(hashes))
    got = simhash_of(spark, [text, text.upper().replace(" ", "\n"), "word", "", "other words here"])
    assert got[0] % 2**64 == want and got[1] == got[0] and len(set(got.values())) == 4


def test_edited_texts_and_likeness(make):
    rng = random.Random(1)
    rows = [(i * 5, " ".join(rng.choice(["alpha", "béta", "𝒳y", "delta", "z"]) for _ in range(rng.randint(1, 60)))) for i in range(40)]
    rows += [(500, None), (501, ""), (502, "x"), (503, "long " * 20_000)]
    docs = make("documents", rows + [(7 * 5, rows[7][1])]).withColumnRenamed("lang", "fingerprint")
    out = {r.doc_id: r for r in simhash.compared(docs).collect()}
    assert len(out) == len(rows)
    texts = [t or "" for _, t in rows]
    for i, (d, _) in enumerate(rows):
        after = texts[(i + 1) % len(rows)]
        k = len(texts[i]) // 4
        edited = texts[i][:len(texts[i]) - k] + after[:k]
        assert out[d].n_chars == len(texts[i])
        assert out[d].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        nxt = out[rows[(i + 1) % len(rows)][0]].fingerprint
        off = bin(int(out[d].fingerprint, 16) ^ int(nxt, 16)).count("1")
        assert out[d].near_next == 1 - off / 64
    assert out[500].fingerprint == out[501].fingerprint


def test_order_edge_cases(make):
    one = simhash.compared(make("documents", [(9, "only one text")])).collect()[0]
    assert one.near_next == 1.0 and one.near_edited <= 1.0
    assert simhash.compared(make("documents", [])).count() == 0
    rows = simhash.compared(make("documents", [(None, "abcd efgh"), (1, "x y"), (1, "z w")])).collect()
    assert len(rows) == 3 and [r.near_next for r in rows if r.doc_id is None] == [None]


def test_search_finds_all_within_the_radius(spark):
    rng = random.Random(2)
    prints = [rng.getrandbits(64) for _ in range(300)]
    for p in prints[:100]:
        for k in range(6):
            q = p
            for b in rng.sample(range(64), k):
                q ^= 1 << b
            prints.append(q)
    signed = sorted({p - 2**64 if p >= 2**63 else p for p in prints})
    df = spark.createDataFrame([(p,) for p in signed], "fingerprint long")
    queries = df.where("fingerprint % 3 = 0")
    got = {(r["query"], r.fingerprint, r.distance) for r in simhash.within_radius(df, queries).collect()}
    want = {(a, b, bin((a ^ b) % 2**64).count("1")) for a in signed if a % 3 == 0 for b in signed
            if bin((a ^ b) % 2**64).count("1") <= simhash.RADIUS}
    assert got == want


def brute_leaks(text, items):
    words = decontamination.words_of(text)
    out = set()
    for item, other in items:
        its = decontamination.words_of(other)
        if len(its) < 5:
            if its and words == its:
                out.add(item)
            continue
        bag, width = decontamination.shingle_bag(its), min(len(its), len(words))
        for s in range(len(words) - width + 1):
            if width >= 5 and decontamination.likeness(decontamination.shingle_bag(words[s:s + width]), bag) >= 0.75:
                out.add(item)
                break
    return out


def test_leaks_equal_brute_force(spark, make):
    rng = random.Random(3)
    vocabulary = [f"v{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(12, 40)))) for i in range(25)]
    items += [(100, "two words"), (101, None), (102, ""), (103, items[0][1]), (None, items[1][1])]
    rows = []
    for i in range(150):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(0, 80))]
        if i % 2:
            passage = rng.choice(items[:25])[1].split()
            for _ in range(rng.choice([0, 0, 0, 1, 2, 3])):
                passage[rng.randrange(len(passage))] = rng.choice(vocabulary)
            at = rng.randint(0, len(words))
            words[at:at] = passage
        rows.append((i, " ".join(words).upper() if i % 5 == 0 else ", ".join(words)))
    rows += [(900, None), (901, "Two words."), (902, "two words more"), (903, items[2][1]), (None, items[3][1])]
    docs, bench = make("documents", rows), make("benchmark", items)
    want = {(d, i) for d, t in rows for i in brute_leaks(t, items)}
    assert len(want) > 40
    for chunk in (5000, 7):
        got = [(r.doc_id, r.item_id) for r in decontamination.leaks(docs, bench, chunk).collect()]
        assert set(got) == want and len(got) == len(set(got))
    clean = decontamination.decontaminated(docs, bench)
    assert clean.columns == docs.columns
    assert {r.doc_id for r in clean.collect()} == {d for d, _ in rows} - {d for d, _ in want}
    assert decontamination.leaks(docs, bench.limit(0)).count() == 0


def test_every_item_within_the_radius_is_looked_up():
    rng = random.Random(5)
    items = [(i, " ".join(rng.choice("abcdefghijklmnop") * 3 for _ in range(20))) for i in range(60)]
    index = decontamination.Index.of(items)
    for row in range(60):
        for k in (0, 5, decontamination.RADIUS, decontamination.RADIUS + 1):
            value = index.prints[row]
            for b in rng.sample(range(64), k):
                value ^= 1 << b
            assert (row in index.within(20, value)) == (k <= decontamination.RADIUS)
