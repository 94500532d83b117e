import hashlib
import re

import pytest
from lanternfish.llm import secrets, trigrams

TEXTS = [
    "password: hunter2hunter2 x", "PASSWD='abc'", "Api_Key=\"ABCDEFGH12\" token=secret=abcdefgh12", "token: a secret = zzzzzzzz9",
    "AKIA" + "A1" * 8, "AKIA123", "AKIAAKIAAKIAAKIA", "deadbeef" * 4, "f" * 31, "F" * 40, "é" * 5 + " key api_key:=:abcdefgh", "ſecret=abcdefgh1",
    "-----BEGIN RSA PRIVATE KEY-----", "ghp_" + "a1" * 20, "password" * 3 + "=abcdefgh=password=12345678", None, "", "secret:" + " " * 50 + "abcdefgh",
]


def base_slow(text):
    text = text or ""
    out = []
    for m in re.finditer(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 8:
            out.append((m.start(), 0, "assign", m.end()))
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out)


def digest(found):
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, k, b in found).encode()).hexdigest()


def check(docs, result):
    got = sorted((r["doc_id"], r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) for r in result.collect())
    want = []
    for r in docs.collect():
        f = base_slow(r["text"])
        want.append((r["doc_id"], *[sum(x[1] == k for x in f) for k in range(3)], digest(f)))
    assert got == sorted(want)


def test_query_equals_plain_scan(spark, small):
    check(spark.read.parquet(f"{small}/documents.parquet"), secrets.op9_secrets(spark, small))


def test_planted(spark, odd_docs, no_docs):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    check(docs, secrets.secret_digests(docs))
    check(odd_docs, secrets.secret_digests(odd_docs))
    assert secrets.secret_digests(no_docs).count() == 0
    kinds = {s["kind"] for r in secrets.find_secrets(docs).collect() for s in r["spans"]}
    assert {"assign", "access", "hex", "private_key", "git_token"} <= kinds


def test_redaction(spark):
    docs = spark.createDataFrame([(1, "a password: hunter2hunter2 b", 7), (2, None, 8), (3, "clean", 9)], "doc_id long, text string, n_chars long")
    got = {r["doc_id"]: r["text"] for r in secrets.redacted(docs).collect()}
    assert got == {1: "a [assign] b", 2: None, 3: "clean"}


@pytest.mark.parametrize("pattern, query", [
    ("abc", b"abc"), ("abcd", ("and", [b"abc", b"bcd"])), ("(abc|xyz)", ("or", [b"abc", b"xyz"])), ("ab+", True), ("[0-9a-f]+", True),
    ("ab?cd", ("or", [("and", [b"abc", b"bcd"]), b"acd"])), ("abc.*xyz", ("and", [b"abc", b"xyz"])), ("(?:abc)?x", True), ("A[bB]C", b"abc"),
])
def test_trigram_queries(pattern, query):
    assert trigrams.trigram_query(pattern) == query


def test_candidates_lose_no_match():
    from hypothesis import given, strategies as st

    scanner = secrets.scanner_for(secrets.RULES)
    piece = st.sampled_from(["password", "AKIA", "token", "=", ":", " ", "abcdefgh", "f" * 32, "api_key", "é", "ghp_", "A1" * 20, "-----BEGIN PRIVATE KEY-----"])

    @given(st.lists(st.lists(piece, max_size=8).map("".join), max_size=5))
    def hold(texts):
        for text, spans in zip(texts, scanner.scan(texts)):
            assert spans == sorted((a, k, b) for k in range(len(scanner.rules)) for a, b in scanner.spans(k, text))

    hold()


def test_dotted_tokens_equal_their_expression_in_linear_time():
    import re
    import time

    from hypothesis import given, strategies as st

    rule = next(r for r in secrets.RULES if r.runs)
    piece = st.sampled_from(["eyJ", "abcdefgh", "abc", ".", "..", " ", "-_", "Z9" * 5, "eyJabcdefgh.eyJabcdefgh.abcdefgh"])

    @given(st.lists(piece, max_size=14).map("".join))
    def same(text):
        assert secrets.dotted_tokens(text, re.compile(rule.runs + "+")) == [m.span() for m in re.finditer(rule.pattern, text)]

    same()
    began = time.perf_counter()
    assert secrets.scanner_for(secrets.RULES).spans(secrets.RULES.index(rule), "eyJ" * 350_000) == []
    assert time.perf_counter() - began < 1
