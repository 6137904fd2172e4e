"""Personal data and secrets: rule spans against plain regular expressions, and the added spans."""

import hashlib
import random
import re
import string

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gridgale.llm import pii, secrets
from gridgale.llm.spans import digest, joined, replaced

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
)


def plain_pii(text):
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        d = re.sub("[^0-9]", "", m[0])
        odd, even = d[-1::-2], d[-2::-2]
        if 14 <= len(d) <= 19 and (sum(map(int, odd)) + sum(sum(divmod(2 * int(x), 10)) for x in even)) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out)


def plain_secrets(text):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


PIECES = st.lists(st.sampled_from([
    "a", "b.c", "@", "x.org", ".", "-", " ", "  ", "1", "25", "300", "4111111111111111", "4111 1111-1111 1111", "+", "(",
    ")", "+1 (509) 555-6973", "1.2.3.4", "\n", "é", "token", "TOKEN", "api_key", "'", '"', ":", "=", "AKIA", "ABCDEFGHIJ0123456",
    "deadbeef", "0123456789abcdef01234567", "ſecret", "Kelvin", "password",
]), max_size=30).map("".join)


@settings(max_examples=400, deadline=None)
@given(PIECES)
def test_rule_spans_equal_the_plain_expressions(text):
    assert pii.rule_spans(text) == plain_pii(text)
    assert secrets.rule_spans(text) == plain_secrets(text)


@pytest.mark.parametrize("text", ["a" * 300_000, "1" * 300_000, "1 " * 150_000, "+1" * 100_000, "f" * 300_000, "@" * 100_000,
                                  "a." * 100_000, "token " * 50_000, "1." * 100_000, "((" * 100_000])
def test_long_runs_stay_linear(text):
    pii.rule_spans(text), pii.candidates(text), secrets.rule_spans(text), secrets.random_spans(text)


def test_random_strings_are_told_from_digests_and_names():
    found = secrets.random_spans("key Zk3vQ9xT1pLw8RfYb2NcHs7D and getHttpResponseCodeFromServer9")
    assert found == [(4, secrets.RANDOM, 28)]
    for s in ("d41d8cd98f00b204e9800998ecf8427e", "123e4567-e89b-12d3-a456-426614174000", "some_long_identifier_name_here",
              "12345678901234567890", "anotherVeryLongCamelCaseIdentifier", "path/to/some/file/name"):
        assert secrets.excluded(s) or not secrets.random_spans(s), s


def test_replaced_joins_overlaps():
    assert replaced("aa bb cc", [(0, 0, 2), (1, 1, 5), (6, 2, 8)], pii.KINDS) == "[EMAIL] [CARD]"
    assert joined([(3, 1, 4), (0, 2, 2), (0, 0, 1)], pii.KINDS) == "email:0:1,card:0:2,ip:3:4"
    assert digest([], pii.KINDS) == hashlib.sha256(b"").hexdigest()


ROWS = [
    (1, "write to jo.26@mail6.example.com now"), (2, None), (3, ""), (None, "ip 1.2.3.4"), (4, "ip 1.2.3.4"), (4, "ip 1.2.3.4"),
    (5, "+1 (509) 555-6973 or 4111111111111111 x" + " filler" * 20_000), (6, "é 10.0.0.1"),
]


def test_find_covers_the_defined_cases(make):
    docs = make("documents", ROWS).withColumnRenamed("lang", "spans").withColumnRenamed("source", "found")
    out = pii.find(docs, pii.learn(docs)).collect()
    assert len(out) == len(ROWS)
    got = sorted(((r.doc_id is None, r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone) for r in out), key=str)
    want = sorted(
        ((d is None, d, *[sum(k == i for _, k, _ in plain_pii(t or "")) for i in range(4)]) for d, t in ROWS), key=str
    )
    assert got == want
    for r in out:
        assert r.base_sha256 == digest(plain_pii(next(t for d, t in ROWS if d == r.doc_id) or ""), pii.KINDS)
        assert set(joined(plain_pii(next(t for d, t in ROWS if d == r.doc_id) or ""), pii.KINDS).split(",")) <= set(r.spans.split(","))
    assert pii.find(docs.limit(0), pii.learn(docs.limit(0))).count() == 0


def test_model_learns_the_format_and_redaction_keeps_columns(make):
    rows = [(i, f"call +1 (50{i % 10}) 555-{1000 + i} today or id {10**15 + i * 7919}") for i in range(300)]
    docs = make("documents", rows)
    model = pii.learn(docs)
    assert model.trees is not None
    # The same format without the rule's sign, in the same place, scores higher than the bare number.
    text = "call +1 (503) 555-1234 today"
    assert model.all_spans(text)[1]
    out = {r.doc_id: r.text for r in pii.redact(make("documents", [(1, text), (2, None), (3, "clean text")]), model).collect()}
    assert out == {1: "call [PHONE] today", 2: None, 3: "clean text"}


def test_secrets_query_counts(make):
    rows = [(1, 'token = "08813ad77930c5f691325605b62c9dfd1b407297" x'), (2, None), (3, "AKIA" + "A1" * 10), (None, "")]
    out = {r.doc_id: r for r in secrets.find(make("documents", rows)).collect()}
    assert (out[1].n_assign, out[1].n_access, out[1].n_hex) == (1, 0, 1)
    assert out[3].n_access == 1 and out[2].spans == "" and out[None].n_hex == 0
    assert out[1].base_sha256 == digest(plain_secrets(rows[0][1]), secrets.KINDS)


def test_planted_forms_that_no_rule_finds_are_selected(make):
    rows = [(i, f"mail jo.{i}@site{i % 7}.example.com now, from host 10.{i % 200}.3.{i % 50} and call +1 (50{i % 10}) 555-{1000 + i} today. "
                f"Build {i}.{i % 9}.{300 + i}.{i % 7} of 2024-10-{10 + i % 20} took 11:{10 + i % 50}:12:{10 + i % 40} for part {10**15 + i * 7919}."
             ) for i in range(400)]
    model = pii.learn(make("documents", rows))
    planted = ["mail ann.lee [at] mail [dot] example [dot] org now", "mail ann.lee(at)corp.example.net now",
               "from host 2001:db8:85a3:8d3:1319:8a2e:370:7348 and", "call 001 (503) 555-1234 today", "call (503) 555-1234 today",
               "call 503.555.1234 today"]
    assert [t for t in planted if pii.rule_spans(t) == [] and not model.select(t)] == []
    clean = ["Build 7.1.345.2 of 2024-10-17 took 11:15:12:20 for part 1000000000079191.", "Chapter 12 of 2023-01-05, pages 100-110 and 115"]
    assert [t for t in clean if model.select(t)] == []


def test_candidates_in_a_rule_span_teach_nothing():
    text = "call +1 (017) 555-7713 today"
    assert {y for _, _, y, _ in pii.labels(text)} == {1}
    assert any(s[0] > 5 for s in pii.candidates(text))


@pytest.mark.parametrize(("alphabet", "n", "before", "least"), [
    (string.ascii_lowercase, 32, "", 0.9), (string.ascii_uppercase, 32, "", 0.95), (string.ascii_letters + string.digits, 16, "", 0.95),
    (string.ascii_letters + string.digits, 24, "/services/integration/webhook/", 0.95),
    (string.ascii_letters + string.digits, 24, "production_database_connection_key=", 0.95),
    (string.ascii_uppercase + string.digits, 24, "production-database-connection-key-", 0.95),
])
def test_random_strings_are_found_in_any_place(alphabet, n, before, least):
    rng = random.Random(5)
    made = ["".join(rng.choices(alphabet, k=n)) for _ in range(300)]
    hits = [any(s <= len(before) + 4 and e == len(before) + 4 + n for s, _, e in secrets.random_spans(f"see {before}{x} now")) for x in made]
    assert sum(hits) >= least * len(made)


@pytest.mark.parametrize("text", [
    "Rechtsschutzversicherungsgesellschaften and internationalization of telecommunications", "CONFIGURATIONMANAGEMENTSYSTEM",
    "/usr/local/share/documentation/configuration", "connection_timeout=configuration_default_value", "1234567890123456 12345678901234567",
    "/users/profile/settings/123e4567-e89b-12d3-a456-426614174000", "responsibilities-and-qualifications",
])
def test_words_paths_and_numbers_are_not_random(text):
    assert secrets.random_spans(text) == []
