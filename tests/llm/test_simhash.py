import re

import pytest
import xxhash
from lanternfish.llm import simhash


def slow_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow(rows, radius=4):
    rows = [(r["doc_id"], slow_print(r["text"])) for r in rows]
    parent = {}

    def find(a):
        while parent.setdefault(a, a) != a:
            a = parent[a]
        return a

    prints = sorted({f for _, f in rows})
    for i, a in enumerate(prints):
        for b in prints[i:]:
            if (a ^ b).bit_count() <= radius:
                parent[find(a)] = find(b)
    low = {}
    for d, f in rows:
        low[find(f)] = min(low.get(find(f), d), d)
    return sorted((d, f, low[find(f)]) for d, f in rows)


def test_query_equals_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").collect()
    got = sorted((r["doc_id"], int(r["fingerprint"], 16), r["component_id"]) for r in simhash.op7_simhash(spark, small).collect())
    assert got == slow(docs)


@pytest.mark.parametrize("tile", [16_384, 3])
def test_odd_rows(odd_docs, tile):
    got = sorted((r["doc_id"], r["fp"] & (2**64 - 1), r["component_id"]) for r in simhash.simhash_components(odd_docs, tile=tile).collect())
    assert got == slow(odd_docs.collect())


def test_empty(no_docs):
    assert simhash.simhash_components(no_docs).count() == 0


def test_links_over_planted_prints(spark):
    import random

    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(60)]
    prints = set(base)
    for b in base[:30]:
        for k in range(6):
            p = b
            for bit in rng.sample(range(64), k):
                p ^= 1 << bit
            prints.add(p)
    signed = [p - 2**64 if p >= 2**63 else p for p in prints]
    links = simhash.fingerprint_links(spark.createDataFrame([(p,) for p in signed], "fp long"), 4, tile=20)
    from lanternfish.operators.components import connected_components

    got = {}
    for r in connected_components(links).collect():
        got.setdefault(r["component"], set()).add(r["node"] & (2**64 - 1))
    parent = {p: p for p in prints}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in prints:
        for b in prints:
            if (a ^ b).bit_count() <= 4:
                parent[find(a)] = find(b)
    want = {}
    for p in prints:
        want.setdefault(find(p), set()).add(p)
    assert sorted(map(sorted, got.values())) == sorted(sorted(g) for g in want.values() if len(g) > 1)
