import math

import numpy as np
import pytest
from lanternfish.llm import permutation_index, threshold
from pyspark.sql import functions as F

def query():
    return F.col("id") % 20 == 0


def rows_of(spark, folder):
    return [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]


def brute(rows, score, k=20, zero_ok=True):
    rows = [(i, v) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v) and (zero_ok or any(v))]
    out = {}
    for q, a in rows:
        if q % 20 == 0:
            best = sorted((-score(a, b), i) for i, b in rows if i != q and len(a) == len(b))[:k]
            if best:
                out.setdefault(q, [(i, -s) for s, i in best])
    return out


def product(a, b):
    return float(np.dot(np.array(a, dtype=float), np.array(b, dtype=float)))


def whole(a, b):
    return sum(math.floor(64 * float(x)) * math.floor(64 * float(y)) for x, y in zip(a, b))


def got(frame):
    out = {}
    for r in sorted(frame.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert len(out[r["query_id"]]) == r["rank"]
    return out


def odd_rows():
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(300)]
    rows += [(300 + i, rows[7][1]) for i in range(60)]  # many copies: ties
    rows += [(400, None), (401, []), (402, [0.0] * 8), (403, [math.nan] + [1.0] * 7), (404, [None] + [1.0] * 7), (405, [math.inf] * 8)]
    rows += [(420, [1.0, 2.0]), (421, [3.0, 4.0]), (440, [5.0])]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, id int, block string").repartition(4)


def test_threshold_query(spark, small):
    assert got(threshold.op2_uniform_threshold(spark, small)) == brute(rows_of(spark, small), whole)


@pytest.mark.parametrize("nodes", [1, 2, 3])
def test_threshold_odd_rows(spark, nodes):
    rows = odd_rows()
    assert got(threshold.top_products(frame(spark, rows), query(), nodes=nodes)) == brute(rows, whole)


def test_threshold_sends_few_entries(spark):
    """Of all pairs of a query and a row the nodes give less than a fifth even of few rows; the cutoffs are safe."""
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    vectors = threshold.finite_vectors(table, "vec_id", "embedding").select("id", F.transform("v", lambda x: F.floor(64 * x).cast("double")).alias("v"))
    reps, queries, _ = threshold.classes(vectors, query(), 20)
    entries, _, cutoffs = threshold.sent_entries(reps, queries, 21, threshold.NODES)
    sent, rows, asked = entries.agg(F.sum(F.size("local"))).first()[0], reps.count(), cutoffs.count()
    print("entries sent, of all pairs", sent / (rows * asked))
    assert 0 < sent < 0.2 * rows * asked
    want = brute(rows_of(spark, "/root/testdata/sf0.1"), whole, k=20)
    known = {r["query_id"]: r["cutoff"] for r in cutoffs.collect()}
    assert all(known[q] <= found[-1][1] for q, found in want.items() if q in known)


def test_threshold_entries_are_held_in_parts(spark):
    """Over 600 queries of one tile: no row of entries has more than 512 queries, the results are exact, and the session's sizes of batches stay."""
    keys = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize")
    own = [spark.conf.get(k) for k in keys]
    v = np.floor(np.random.default_rng(11).normal(size=(12_400, 6)) * 40)
    table = spark.createDataFrame([(i, x) for i, x in enumerate(v.tolist())], "vec_id long, embedding array<double>").repartition(4)
    reps, queries, wanted = threshold.classes(threshold.finite_vectors(table, "vec_id", "embedding"), query(), 5)
    entries, _, _ = threshold.sent_entries(reps, queries, wanted, threshold.NODES)
    assert entries.agg(F.max(F.size(F.array_distinct("queries")))).first()[0] <= 512
    found = got(threshold.top_products(table, query(), k=5, scale=None))
    assert found.keys() == set(range(0, 12_400, 20))
    for q, best in found.items():
        scores = v @ v[q]
        scores[q] = -np.inf
        order = np.lexsort((np.arange(len(v)), -scores))[:5]
        assert best == [(i, scores[i]) for i in order.tolist()]
    assert [spark.conf.get(k) for k in keys] == own


def test_threshold_hot_copies(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(3000, 8))
    v[rng.permutation(3000)[:1000]] = v[0] * 2
    rows = list(zip(range(3000), v.tolist()))
    want = brute(rows, whole)
    assert got(threshold.top_products(frame(spark, rows), query())) == want


def test_threshold_large_numbers(spark):
    rows = [(i, [float(v * 400_000) for v in np.random.default_rng(i).integers(-9, 9, 4)]) for i in range(50)]
    assert got(threshold.top_products(frame(spark, rows), query())) == brute(rows, whole)


def test_permutation_recall_and_scores(spark, small):
    rows = rows_of(spark, small)
    want, found = brute(rows, product, zero_ok=False), got(permutation_index.op1_permutation_index(spark, small))
    assert found.keys() == want.keys()
    vectors = dict(rows)
    hits = 0
    for q, best in found.items():
        assert len(best) == 20
        for i, s in best:
            assert s == pytest.approx(product(vectors[q], vectors[i]), abs=1e-12)
        hits += len({i for i, _ in best} & {i for i, _ in want[q]})
    assert hits >= 0.9 * 20 * len(want)


def test_permutation_recall_at_scale(spark):
    rows = rows_of(spark, "/root/testdata/sf0.1")
    want = brute(rows, product, zero_ok=False)
    found = got(permutation_index.op1_permutation_index(spark, "/root/testdata/sf0.1"))
    hits = sum(len({i for i, _ in found[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 20 * len(want)


def test_permutation_recall_where_the_index_prunes(spark):
    """50,000 random rows, of which a query reranks 3,568."""
    rng = np.random.default_rng(9)
    v = rng.normal(size=(50_000, 64))
    v /= np.linalg.norm(v, axis=1)[:, None]
    table = spark.createDataFrame([(i, x) for i, x in enumerate(v.tolist())], "vec_id long, embedding array<double>")
    found = got(permutation_index.nearest(table, F.col("id") % 500 == 0))
    hits = 0
    for q in range(0, 50_000, 500):
        scores = v @ v[q]
        scores[q] = -np.inf
        hits += len(set(np.argsort(-scores)[:20].tolist()) & {i for i, _ in found[q]})
    print("recall", hits / 2000)
    assert permutation_index.candidate_count(50_000) == 3568 and len(found) == 100 and hits >= 0.9 * 2000


def test_permutation_odd_rows(spark):
    rows = odd_rows()
    found = got(permutation_index.nearest(frame(spark, rows), query(), candidates=10**6))
    want = brute(rows, product, zero_ok=False)
    assert {q: [i for i, _ in v] for q, v in found.items()} == {q: [i for i, _ in v] for q, v in want.items()}


def test_empty(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert permutation_index.nearest(none, query()).count() == 0
    assert threshold.top_products(none, query()).count() == 0


def test_permutation_hot_copies(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(20_000, 8))
    hot = rng.permutation(20_000)[: 20_000 // 3]
    v[hot] = v[hot[0]] / np.linalg.norm(v[hot[0]]) * 4  # a third of all rows are copies
    ids = np.arange(20_000)
    found = got(permutation_index.nearest(frame(spark, list(zip(ids.tolist(), v.tolist()))), F.col("id") % 200 == 0))
    hits, copies, wanted = 0, 0, 0
    for q in ids[::200].tolist():
        scores = (v * v[q]).sum(axis=1)
        scores[q] = -np.inf
        want, mine = set(np.lexsort((ids, -scores))[:20].tolist()), {i for i, _ in found[q]}
        hits, copies, wanted = hits + len(want & mine), copies + len(want & mine & set(hot.tolist())), wanted + len(want & set(hot.tolist()))
    assert wanted > 0 and copies >= 0.99 * wanted and hits >= 0.9 * 20 * 100


def repeated_ids():
    """Ids that occur with two vectors (queries among them), with one vector many times, and with both."""
    rng = np.random.default_rng(8)
    vectors = [rng.normal(size=6).tolist() for _ in range(60)]
    rows = list(enumerate(vectors)) + [(20, vectors[33]), (20, rng.normal(size=6).tolist()), (37, rng.normal(size=6).tolist()), (0, vectors[0])]
    return rows + [(40, vectors[12])] * 9 + [(12, vectors[12])] * 9


def by_row(rows, score, k):
    """Of every query row, (rank, id, score) by comparing it with all rows of other ids."""
    out = []
    for q, a in rows:
        if q % 20 == 0:
            best = sorted((-score(a, b), i) for i, b in rows if i != q)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


def test_repeated_ids(spark):
    rows = repeated_ids()
    found = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in threshold.top_products(frame(spark, rows), query(), k=5).collect())
    assert found == by_row(rows, whole, 5)
    found = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in permutation_index.nearest(frame(spark, rows), query(), k=5).collect())
    want = by_row(rows, product, 5)
    assert [f[:3] for f in found] == [w[:3] for w in want] and np.allclose([f[3] for f in found], [w[3] for w in want])


def test_permutation_files_prune_on_clustered_vectors(spark):
    """Where vectors have structure a short prefix does: under a tenth of the rows stand in a query's files, and recall stays."""
    rng = np.random.default_rng(6)
    v = rng.normal(size=(100, 32))[rng.integers(0, 100, 20_000)] * 3 + rng.normal(size=(20_000, 32))
    v /= np.linalg.norm(v, axis=1)[:, None]
    table = spark.createDataFrame([(i, x) for i, x in enumerate(v.tolist())], "vec_id long, embedding array<double>")
    asked = list(range(0, 20_000, 200))
    found = got(permutation_index.nearest(table, F.col("id") % 200 == 0, prefix=3))
    hits = 0
    for q in asked:
        scores = v @ v[q]
        scores[q] = -np.inf
        hits += len(set(np.argsort(-scores)[:20].tolist()) & {i for i, _ in found[q]})
    pivots = v[::80][:256]
    files = permutation_index.Files.load(permutation_index.Files.of(v, pivots, 3).dump(), len(pivots))
    own = [np.argsort(-(pivots @ v[q]), kind="stable")[:3] for q in asked]
    share = np.mean([np.count_nonzero(files.common(o, len(v))) for o in own]) / len(v)
    read = np.mean([files.touched(o) for o in own]) / len(v)
    print("recall", hits / 2000, "rows in a query's files", share, "postings read for each row", read)
    assert hits >= 0.9 * 2000 and share < 0.1 and read < 0.15
