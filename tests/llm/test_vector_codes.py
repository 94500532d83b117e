import hashlib
import math

import numpy as np
import pytest

from lanternfish.llm import metric_trees as trees
from lanternfish.llm import vector_codes as vc

CLUSTERED = np.random.default_rng(1)


def slow(rows, parts=4, entries=256, rounds=4, scale=1024):
    """{id: (code, error, label_error, digest)} for rows (id, vector, label) with distinct ids and one length."""
    rows = sorted(((i, [math.floor(scale * float(x)) for x in v], lab) for i, v, lab in rows
                   if v is not None and all(x is not None and math.isfinite(x) for x in v)), key=lambda r: r[0])
    width = len(rows[0][1]) // parts
    codes, errors, books = [[] for _ in rows], [0] * len(rows), []
    for p in range(parts):
        x = np.array([r[1][p * width : (p + 1) * width] for r in rows], np.int64)
        book = x[:entries].copy()

        def nearest():
            d = ((x[:, None, :] - book[None]) ** 2).sum(axis=2)
            return d.argmin(axis=1), d.min(axis=1)

        for _ in range(rounds):
            own, _ = nearest()
            for k in set(own.tolist()):
                book[k] = x[own == k].sum(axis=0) // (own == k).sum()
        own, d = nearest()
        for k, (c, e) in enumerate(zip(own.tolist(), d.tolist())):
            codes[k].append(c)
            errors[k] += e
        books.append(book)
    digest = hashlib.sha256(",".join(str(v) for b in books for v in b.ravel().tolist()).encode()).hexdigest()
    by_label = {}
    for (_, _, lab), e in zip(rows, errors):
        by_label[lab] = by_label.get(lab, 0) + e
    return {i: ("".join(f"{c:02x}" for c in code), e, by_label[lab], digest) for (i, _, lab), code, e in zip(rows, codes, errors)}


def test_query_equals_brute_force(spark, small):
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in spark.read.parquet(f"{small}/embeddings.parquet").collect()]
    got = {r["vec_id"]: (r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in vc.op13_anchor_codes(spark, small).collect()}
    assert got == slow(rows)


@pytest.mark.parametrize("block_rows", [4096, 7])
def test_odd_rows_do_not_depend_on_blocks(spark, block_rows):
    """Nulls, copies, ties of entries, null labels and clashing columns."""
    rng = np.random.default_rng(5)
    vectors = [rng.normal(size=8).tolist() for _ in range(30)]
    vectors += [vectors[0]] * 20 + [[0.0] * 8] * 5 + [None, [1.0, None] + [0.0] * 6, [float("nan")] * 8, [float("inf")] * 8]
    rows = [(i, v, None if i % 5 == 0 else f"l{i % 3}") for i, v in enumerate(vectors)]
    table = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "vec_id long, embedding array<double>, label string, error int, code string, dim int").repartition(4)
    found, books = vc.vector_codes(table, entries=16, block_rows=block_rows)
    got = {r["vec_id"]: (r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in found.collect()}
    assert got == slow(rows, entries=16)
    assert [b.shape for b in books[8]] == [(16, 2)] * 4


def test_empty_table_other_lengths_null_and_repeated_ids(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert vc.vector_codes(spark.createDataFrame([], schema))[0].count() == 0
    rows = [(1, [1.0, 2.0, 3.0], 1), (1, [1.0, 2.0, 3.0], 1), (None, [4.0, 4.0, 4.0], 1), (2, [0.5] * 4, 2), (3, [], 3)]
    got = sorted(((r["vec_id"] or 0), r["code"], r["error"]) for r in vc.vector_codes(spark.createDataFrame(rows, schema))[0].collect())
    assert got == [(0, "00020202", 0), (1, "00000000", 0), (1, "00000000", 0), (2, "00000000", 0), (3, "00000000", 0)]


@pytest.mark.parametrize("points", [
    CLUSTERED.integers(-300, 300, (900, 16)),
    np.repeat(CLUSTERED.integers(-5, 5, (7, 3)), 60, axis=0),
    CLUSTERED.integers(-(2**24), 2**24, (200, 4)),
    np.zeros((30, 0), np.int64),
])
def test_trees_give_exact_assignments(points):
    tree = trees.Tree.load(trees.build(points).dump())
    entries = points[:64]
    d = ((points[:, None, :] - entries[None]) ** 2).sum(axis=2)
    codes, errors = trees.codes(tree, entries)
    assert (codes == d.argmin(axis=1)).all() and (errors == d.min(axis=1)).all()
    sums, counts = trees.totals(tree, entries)
    assert counts.tolist() == [int((d.argmin(axis=1) == k).sum()) for k in range(len(entries))]
    assert sums.sum(axis=0).tolist() == points.sum(axis=0).tolist()


def test_balls_are_owned_whole_on_clustered_points():
    """Inherited lists shrink: under a tenth of all distances are computed."""
    rng = np.random.default_rng(2)
    points = (rng.normal(size=(40, 16))[rng.integers(0, 40, 4000)] * 800 + rng.normal(size=(4000, 16)) * 10).astype(np.int64)
    tree = trees.build(points)
    balls, _, leaves, work = trees.owned(tree, points[:256])
    work += sum(int(tree.stop[k] - tree.start[k]) * len(c) for k, c in leaves)
    assert len(balls) and work < 4000 * 256 / 10
