import random
import re

import numpy as np
import pytest

from lanternfish.llm import minhash


def slow_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {" ".join(words[i : i + 2]) for i in range(max(1, len(words) - 1))} if words else set()


def slow(rows):
    """(doc_id, n_shingles, component_id) by comparing all pairs; ids must be distinct."""
    sets = [(d, slow_set(t)) for d, t in rows]
    parent = {d: d for d, _ in rows}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for k, (a, x) in enumerate(sets):
        for b, y in sets[k + 1 :]:
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                a, b = find(a), find(b)
                parent[max(a, b)] = min(a, b)
                a = find(a)
    return sorted((d, len(x), find(d)) for d, x in sets)


def family(rng, words, copies, changes):
    base = [rng.choice(words) for _ in range(200)]
    out = [" ".join(base)]
    for _ in range(copies):
        text = list(base)
        for k in rng.sample(range(200), changes):
            text[k] = rng.choice(words)
        out.append(" ".join(text))
    return out


def result(df, names=("doc_id", "n_shingles", "component_id")):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def test_query_equals_brute_force(spark, small):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    found = minhash.op11_bayesian_minhash(spark, small).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found) == slow(docs)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in found)


@pytest.mark.parametrize("part_rows, bytes_a_part", [(8192, 1 << 20), (4, 4000)])
def test_groups_of_copies_in_small_parts(spark, part_rows, bytes_a_part):
    rng = random.Random(11)
    words = [f"w{k}" for k in range(3000)]
    texts = [t for changes in (1, 4, 8, 12, 20) for t in family(rng, words, 12, changes)] + [" ".join(rng.choice(words) for _ in range(120)) for _ in range(40)]
    texts += texts[:30] + ["", " \t", None, "one", "ONE", "one two", "One two"]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert result(minhash.near_duplicates(docs, part_rows=part_rows, bytes_a_part=bytes_a_part)) == slow(rows)


def test_odd_rows(spark, odd_docs, no_docs):
    rows = {(r["doc_id"], r["text"]) for r in odd_docs.collect()}
    got = result(minhash.near_duplicates(odd_docs))
    assert set(got) == set(slow(sorted(rows, key=lambda r: r[0]))) and len(got) == odd_docs.count()
    assert minhash.near_duplicates(no_docs).count() == 0


def test_null_and_repeated_ids(spark):
    a, b = "a b c d e f g h i j", "k l m n o p q r s t"
    docs = spark.createDataFrame([(5, a), (5, b), (3, a), (4, b), (None, a), (9, "x y z")], "doc_id long, text string")
    got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(docs).collect()}
    assert got == {(5, 9, 3), (3, 9, 3), (4, 9, 3), (None, 9, None), (9, 2, 9)}


def test_pruning_keeps_similar_pairs_and_stops_early_on_others():
    rng = np.random.default_rng(3)
    least = minhash.least_matches(160)
    similar = rng.random((20_000, 160)) < 0.8
    one, many = np.zeros((20_000, 160), np.uint8), np.where(similar, 0, 1).astype(np.uint8)
    assert len(minhash.survivors(one, many, least)) >= 20_000 - 2
    far = (rng.random((20_000, 160)) > 0.3).astype(np.uint8)
    first = (far[:, :32] == 0).sum(axis=1) >= least[0]
    assert first.mean() < 0.1 and not len(minhash.survivors(one, far, least))
