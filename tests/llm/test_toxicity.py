import re
import zlib

import numpy as np
import pytest
from hypothesis import given, strategies as st
from lanternfish.llm import toxicity


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


TERMS = [toxicity.Term(t, 1.0) for t in ("bad", "stupid", "stupor", "pathetic", "worthless", "st")]
MATCHER = toxicity.Matcher(TERMS, frozenset(["studied", "stupids"]))


@given(st.one_of(st.text(alphabet="abcdehilmoprstuwx", max_size=11), st.sampled_from(["stupid", "worthles", "wortless", "stupids", "patethic", "worthlesssss"])))
def test_matcher_equals_edit_distance(word):
    want = {}
    for t, term in enumerate(TERMS):
        if (d := distance(term.text, word)) <= toxicity.allowed_errors(len(term.text)) and (d == 0 or word not in MATCHER.ordinary):
            want[t] = d
    assert dict(MATCHER.hits(word)) == want


def test_windows_tell_quotation():
    plain = toxicity.found_hits(MATCHER, "you are stupid and worthless")
    quoted = toxicity.found_hits(MATCHER, 'he said the word "stupid" there')
    assert plain == (5, {(1, 0, False): 1, (4, 0, False): 1}) and quoted == (6, {(1, 0, True): 1})
    assert toxicity.found_hits(MATCHER, "you are worthles") == (3, {(4, 1, False): 1})
    assert toxicity.found_hits(MATCHER, None) == (0, {})


def test_weights_are_never_negative():
    rng = np.random.default_rng(0)
    x = rng.random((400, 3))
    y = (x[:, 0] - x[:, 1] + 0.3 * rng.normal(size=400) > 0).astype(float)
    w, _ = toxicity.fit_logistic(x, y)
    assert w[0] > 0 and (w[:-1] >= 0).all() and w[1] == 0


def test_near_copies_count_once(spark):
    base = " ".join(f"w{i}" for i in range(200))
    rows = [(i, base.replace(f"w{i} ", f"v{i} ")) for i in range(30)] + [(50 + i, " ".join(f"u{i}x{j}" for j in range(60))) for i in range(5)]
    kept = toxicity.without_copies(spark.createDataFrame(rows, "id long, body string"))
    assert {r["id"] for r in kept.collect()} == {0, *range(50, 55)}


@pytest.fixture(scope="module")
def learned(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    return toxicity.train(docs, labels, ~toxicity.held_out("id"))


def test_method_decides(learned):
    """A misspelled insult scores between a clean and an exact one, and quoting lowers a score."""
    exact, fuzzy, clean, quoted = toxicity.score_text(learned, toxicity.Matcher(learned.terms, learned.ordinary), [
        "you are a stupid worthless idiot and pathetic", "you are a stupld wortless idoit and pathetik", "you are a friendly helpful person and kind",
        'they called me "stupid" and wrote "worthless" and said "idiot" and called it "pathetic"'])
    assert clean < 0.5 < exact and clean < fuzzy < exact and quoted < exact and fuzzy > clean + 0.05
    assert {"idiot", "stupid", "worthless"} <= {t.text for t in learned.terms}


def test_automata_keep_misspelled_documents(spark, learned):
    """Held-out toxic documents whose terms are misspelled: the automata find more of them than exact words do."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id")
    rows = docs.where(toxicity.held_out("doc_id")).select("text", "toxic").collect()
    named = re.compile(r"\b(" + "|".join(t.text for t in learned.terms if len(t.text) >= 5) + r")\b", re.I)
    spoiled = [named.sub(lambda m: m[0][:2] + m[0][3] + m[0][2] + m[0][4:] if len(m[0]) >= 9 else m[0][:2] + m[0][3:], r["text"] or "") for r in rows]
    marks = np.array([r["toxic"] for r in rows])

    def f1(scores):
        told = scores >= 0.5
        return 2 * (told & (marks == 1)).sum() / max(1, told.sum() + marks.sum())

    whole = toxicity.Matcher(learned.terms, learned.ordinary)
    words = toxicity.Matcher(learned.terms, learned.ordinary)
    words.reach = [0] * len(words.reach)
    words._reset()
    both, exact = f1(toxicity.score_text(learned, whole, spoiled)), f1(toxicity.score_text(learned, words, spoiled))
    plain = f1(toxicity.score_text(learned, whole, [r["text"] for r in rows]))
    print("F1: as written", plain, "misspelled", both, "misspelled, exact words only", exact)
    assert plain >= 0.9 and both >= exact + 0.3


@pytest.mark.parametrize("sf, least", [("sf0.01", 0.9), ("sf0.1", 0.95)])
def test_held_out_accuracy(spark, sf, least):
    folder = f"/root/testdata/{sf}"
    found = {r["doc_id"]: r for r in toxicity.op8_toxicity(spark, folder).collect()}
    marks = [(found[r["doc_id"]], r["toxic"]) for r in spark.read.parquet(f"{folder}/labels.parquet").collect()]
    assert len(found) == spark.read.parquet(f"{folder}/documents.parquet").count()
    for r, _ in marks:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    held = [(r["predicted"], t) for r, t in marks if r["held_out"]]
    assert sum(p == t for p, t in held) / len(held) >= least


def test_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, None), (99, 1)], "doc_id long, toxic int")
    rows = toxicity.scored(odd_docs, labels).collect()
    assert len(rows) == odd_docs.count() and all(r["score"] == 0 and r["predicted"] == 0 for r in rows)
    assert toxicity.scored(no_docs, labels).count() == 0


def slow_score(model, text, near):
    """The score by its definition: every word against every term by edit distance, every window read anew."""
    import math

    low = (text or "").lower()
    words = [(m.group(), m.start(), m.end()) for m in re.finditer(r"[^\W_]+", low)]
    counts = {}
    for i, (w, start, end) in enumerate(words):
        if not near(w):
            continue
        t, errors = min(near(w), key=lambda h: (h[1], -model.terms[h[0]].weight))
        window = words[max(0, i - 6) : i + 7]
        before = sum(c in '"«»“”„‟' for c in low[window[0][1] : start])
        behind = any(c in '"«»“”„‟' for c in low[end : window[-1][2] + 3])
        told = any(v in toxicity.REPORTING for v, *_ in words[max(0, i - 6) : i])
        key = (t, errors, bool(before % 2 and behind or told))
        counts[key] = counts.get(key, 0) + 1
    x = [0.0] * 4
    if counts:
        worth = {k: model.fuzzy ** k[1] * (model.quoted if k[2] else 1.0) for k in counts}
        share = {t: sum(n * worth[k] for k, n in counts.items() if k[0] == t) for t in {k[0] for k in counts}}
        mass = sum(model.terms[t].weight * s for t, s in share.items())
        x = [math.log(1 + mass), max(model.terms[k[0]].weight * v for k, v in worth.items()), sum(min(1.0, s) for s in share.values()), math.log(1 + 1000 * mass / len(words))]
    return 1 / (1 + math.exp(-sum(a * b for a, b in zip([*x, 1.0], model.weights))))


def test_scores_equal_their_definition(spark, learned):
    """Every document of the smallest table and a few made for the windows, scored by the column and by the definition."""
    from functools import lru_cache

    from pyspark.sql import functions as F

    @lru_cache(None)
    def near(word):
        out = []
        for t, term in enumerate(learned.terms):
            most = toxicity.allowed_errors(len(term.text))
            if abs(len(term.text) - len(word)) <= most and (d := distance(term.text, word)) <= most and (d == 0 or word not in learned.ordinary):
                out.append((t, d))
        return tuple(out)

    made = ['He said "you stupid idiot" and left', "«worthless» he wrote", 'stupid "quote" opened " and idiot', "stupld wortless idiot " * 30, "", None, "said " * 8 + "idiot"]
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()] + made
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["s"] for r in docs.select("doc_id", toxicity.toxicity(learned, F.col("text")).alias("s")).collect()}
    for k, text in enumerate(texts):
        assert got[k] == pytest.approx(slow_score(learned, text, near), rel=1e-9)
    assert any(near(w) and near(w)[0][1] for t in texts for w in re.findall(r"[^\W_]+", (t or "").lower()))
