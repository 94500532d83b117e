import hashlib
import random

import numpy as np
import pytest
from lanternfish.llm import suffix_dedup as sd


def slow(rows):
    rows = sorted(((r["doc_id"], (r["text"] or "").encode()) for r in rows), key=lambda r: r[0])
    seen, out = set(), []
    for doc, raw in rows:
        gone = bytearray(len(raw))
        for i in range(len(raw) - sd.WINDOW + 1):
            w = raw[i : i + sd.WINDOW]
            if w in seen:
                gone[i : i + sd.WINDOW] = b"\1" * sd.WINDOW
            seen.add(w)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out.append((doc, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def got(frame):
    return sorted(map(tuple, frame.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()))


def texts(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdéf") for _ in range(rng.randint(2, 7)))
    passage = lambda n: " ".join(word() for _ in range(n))
    line = passage(30)
    common = [passage(60) for _ in range(4)]
    out = []
    for i in range(120):
        parts = [passage(rng.randint(0, 40))]
        if i % 2:
            parts.insert(rng.randint(0, 1), line)
        if i % 5 == 0:
            parts += [rng.choice(common), passage(5), rng.choice(common)]
        if i % 11 == 0:
            parts += ["ab" * rng.randint(40, 300), "z" * rng.randint(90, 900)]
        out.append(" ".join(parts))
    return [*out, out[3], out[3], out[10][:150], None, "", "short", common[0] + common[1], "x" * 99, "x" * 100, "x" * 101]


@pytest.mark.parametrize("hot", [1000, 5])
def test_equals_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(sd, "HOT_LEAST", hot)
    spark.conf.set("spark.sql.shuffle.partitions", "8" if hot == 1000 else "400")
    try:
        docs = spark.createDataFrame(list(enumerate(texts(hot))), "doc_id long, text string").repartition(5)
        assert got(sd.dedup_digests(docs)) == slow(docs.collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_full_bit_tables_change_nothing(spark, monkeypatch):
    """As in a corpus so large that every slot is hit."""
    monkeypatch.setattr(sd, "MAX_BITS", 4)
    docs = spark.createDataFrame(list(enumerate(texts(3))), "doc_id long, text string").repartition(5)
    assert got(sd.dedup_digests(docs)) == slow(docs.collect())


def test_only_repeated_triggers_get_slots(spark):
    rng = np.random.default_rng(2)
    once, twice = rng.integers(0, 2**63, 50_000, dtype=np.uint64) * np.uint64(2), rng.integers(0, 2**63, 500, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    rows = spark.createDataFrame([(int(k),) for k in np.concatenate([once, twice, twice]).view(np.int64)], "k long").repartition(6)
    table = sd.repeated_table(rows, sd._keys, 3 << 20)
    assert sd.in_slots(table, twice).all() and sd.in_slots(table, once).mean() < 0.15


def test_query(spark, small):
    assert got(sd.op3_prefix_free(spark, small)) == slow(spark.read.parquet(f"{small}/documents.parquet").collect())


def test_odd_rows(spark, odd_docs, no_docs):
    rows = odd_docs.collect()
    for g, w in zip(got(sd.dedup_digests(odd_docs)), slow(rows)):
        assert g == w
    assert sd.dedup_digests(no_docs).count() == 0
    both = spark.createDataFrame([(None, "y" * 300), (None, "y" * 300), (1, "y" * 300)], "doc_id long, text string")
    assert sorted(r["n_removed"] for r in sd.dedup_digests(both).collect()) == [0, 0, 299]


def test_cut_texts(spark):
    a = "é" * 20 + "".join(chr(97 + i % 23) + str(i) for i in range(100))
    docs = spark.createDataFrame([(1, a, "s"), (2, "new " + a + " end", "t"), (3, None, "u")], "doc_id long, text string, source string")
    kept = {r["doc_id"]: r["text"] for r in sd.without_repeats(docs).collect()}
    assert kept == {1: a, 2: "new  end", 3: None}


def test_ranks_are_lexicographic():
    rng = np.random.default_rng(1)
    data = rng.integers(97, 99, 3000).astype(np.uint8)
    at = np.arange(0, 3000 - sd.WINDOW)
    rank = sd.window_ranks(data, at)
    raw = data.tobytes()
    order = sorted(at.tolist(), key=lambda i: raw[i : i + sd.WINDOW])
    assert (np.diff(rank[order]) >= 0).all()


def test_windows_are_told_apart_without_their_order(monkeypatch):
    """Groups of windows are those of the suffix order, which is made only where hashes collide."""
    rng = np.random.default_rng(5)
    some = rng.integers(97, 99, 4000).astype(np.uint8)
    data = np.concatenate([some, some[500:900], np.full(300, 97, np.uint8), some[:2500]])
    at = np.sort(rng.choice(len(data) - sd.WINDOW + 1, 5000, replace=False))
    ranks = sd.window_ranks(data, at)
    kinds = len(set(ranks.tolist()))
    alike = lambda groups: len(set(groups.tolist())) == kinds == len(set(zip(groups.tolist(), ranks.tolist())))
    with monkeypatch.context() as m:
        m.setattr(sd, "_C1", np.uint64(0))  # all hashes are equal
        assert alike(sd.window_groups(data, at))
    monkeypatch.setattr(sd, "window_ranks", None)
    assert alike(sd.window_groups(data, at))
    one, other = bytes(data[:400]), bytes(data[100:350])
    own = sd._first_owned([other, one], np.array([2, 1]), np.zeros(2, int), np.zeros(2, int), np.array([151, 301]))
    assert not own[0].any() and own[1].all()
