import itertools
import re

import numpy as np
from hypothesis import given, strategies as st
from lanternfish.llm import packing
from pyspark.sql import functions as F


def waste(lengths, counts, bounds):
    return sum(n * (min(b for b in bounds if b >= x) - x) for x, n in zip(lengths, counts))


@given(st.dictionaries(st.integers(0, 60), st.integers(1, 9), min_size=1, max_size=9), st.integers(1, 4))
def test_boundaries_are_optimal(histogram, buckets):
    lengths = sorted(histogram)
    counts = [histogram[x] for x in lengths]
    got = packing.optimal_boundaries(np.array(lengths, float), np.array(counts, float), buckets)
    assert len(got) <= buckets and got[-1] == lengths[-1]
    want = min(waste(lengths, counts, (*inner, lengths[-1])) for k in range(min(buckets, len(lengths))) for inner in itertools.combinations(lengths[:-1], k))
    assert waste(lengths, counts, got) == want


def check(docs, rows, buckets, budget):
    size = {}
    for r in docs:
        size.setdefault(r["doc_id"], len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) + 1)
    assert sorted(r["doc_id"] for r in rows) == sorted(r["doc_id"] for r in docs)
    lengths, counts = np.unique([size[r["doc_id"]] for r in docs], return_counts=True)
    bounds = packing.optimal_boundaries(lengths.astype(float), counts.astype(float), buckets)
    by = {}
    for r in rows:
        assert r["n_tokens"] == size[r["doc_id"]]
        assert r["bucket"] == packing.bucket_of(bounds, r["n_tokens"]) and r["padded"] == bounds[r["bucket"]]
        by.setdefault(r["bucket"], []).append(r)
    for group in by.values():
        slots = max(1, budget // group[0]["padded"])
        group.sort(key=lambda r: (r["batch"], r["slot"]))
        assert [(r["batch"], r["slot"]) for r in group] == [divmod(k, slots) for k in range(len(group))]
        assert [r["doc_id"] for r in group] == sorted(r["doc_id"] for r in group)


def test_query(spark, small):
    check(spark.read.parquet(f"{small}/documents.parquet").collect(), packing.op4_length_buckets(spark, small).collect(), packing.BUCKETS, packing.BUDGET)


def test_odd_rows(odd_docs, no_docs):
    length = packing.word_tokens(F.col("text"))
    check(odd_docs.collect(), packing.pack(odd_docs, length, buckets=3, budget=20).collect(), 3, 20)
    assert packing.pack(no_docs, length).count() == 0


def test_null_ids(spark):
    docs = spark.createDataFrame([(2**62 + 1, "a b"), (None, "c d"), (None, None)], "doc_id long, text string")
    rows = packing.pack(docs, packing.word_tokens(F.col("text")), buckets=1).collect()
    assert sorted((r["doc_id"] or 0, r["slot"]) for r in rows) == [(0, 0), (0, 1), (2**62 + 1, 2)]


def test_coarse_histogram_still_covers(spark):
    lengths = spark.createDataFrame([(i * i,) for i in range(1, 200)], "n long")
    bounds = packing.length_boundaries(lengths, "n", 4, bins=50)
    assert bounds[-1] == 199 * 199 and len(bounds) <= 4


def test_one_long_text_keeps_short_boundaries(spark):
    lengths = spark.createDataFrame([(i,) for i in range(1, 16)] + [(10_000_000,)], "n long")
    assert packing.length_boundaries(lengths, "n") == [*range(1, 16), 10_000_000]
