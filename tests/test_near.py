"""Hamming pairs against all pairs, and the leader fold against a sequential one."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from lanternfish.operators import near


def signed(x):
    return x - 2**64 if x >= 2**63 else x


def some_hashes(rng, n=60):
    base = [rng.getrandbits(64) for _ in range(n)]
    out = set(base)
    for b in base:
        for k in (0, 1, 2, 5, 8, 9):
            x = b
            for bit in rng.sample(range(64), k):
                x ^= 1 << bit
            out.add(x)
    for b in base[:10]:  # chains: a to c is further than the radius
        for step in range(5):
            for bit in rng.sample(range(64), 6):
                b ^= 1 << bit
            out.add(b)
    return sorted(out)


@pytest.mark.parametrize("radius, bands", [(8, None), (8, 2), (8, 3), (8, 4), (8, 9), (3, 2), (1, None)])
def test_pairs_equal_all_pairs(spark, radius, bands):
    hashes = some_hashes(random.Random(radius))
    df = spark.createDataFrame([(signed(x),) for x in hashes + hashes[:5]] + [(None,)], "h long")
    got = sorted((r["a"], r["b"], r["distance"]) for r in near.hamming_pairs(df, "h", radius, bands).collect())
    small = [signed(x) for x in hashes]
    want = sorted((a, b, ((a ^ b) & (2**64 - 1)).bit_count()) for a in small for b in small if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= radius)
    assert got == want


def test_listed_neighbours_are_never_broadcast(spark):
    """Each hash is listed many times, which the planner does not count: with a small table that it would broadcast, no side of the join is."""
    df = spark.createDataFrame([(signed(x),) for x in some_hashes(random.Random(5))], "h long")
    for bands in (2, 3, 9):
        pairs = near.hamming_pairs(df, "h", 8, bands)
        assert pairs.collect()
        assert "Broadcast" not in pairs._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def small_broadcasts(spark):
    """A session that fails where more than 4 MB is broadcast."""
    spark.conf.set("spark.sql.maxBroadcastTableSize", "4m")
    yield spark
    spark.conf.unset("spark.sql.maxBroadcastTableSize")


def test_families_need_no_large_broadcast(small_broadcasts):
    hashes = [signed(x) for x in some_hashes(random.Random(6), 300)]
    found = near.families(small_broadcasts.createDataFrame([(x,) for x in hashes], "h long"), "h", 8).collect()
    family = {r["hash"]: r["family"] for r in found}
    assert len(found) == len(family) and family.keys() == set(hashes)
    assert all((family[a] == family[b]) for a, b in itertools.combinations(hashes, 2) if ((a ^ b) & (2**64 - 1)).bit_count() <= 8)


def test_leader_fold_broadcasts_no_listed_neighbours(spark, monkeypatch):
    plans = []

    def seen(df, name, stage=near.stage):
        if name == "fold-near":
            df.collect()
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return stage(df, name)

    monkeypatch.setattr(near, "stage", seen)
    hashes = [signed(x) for x in some_hashes(random.Random(7))]
    near.leader_fold(spark.createDataFrame([(k, h, k) for k, h in enumerate(hashes)], "id long, h long, at long"), "id", "h", "at", 8)
    assert "Join [band" in plans[0] and "BroadcastHashJoin [band" not in plans[0]


def test_work_grows_more_slowly_than_the_square():
    """Rows listed and pairs met by chance, for ten times the hashes."""
    def met(n):
        bands = near.bands_for(n, 8)
        width, flips = 64 // bands, 8 // bands
        return n * n / 2 * bands * sum(near.math.comb(width, k) for k in range(flips + 1)) / 2.0**width

    assert met(20_000) < 20_000 * 20_000 / 2 / 1000
    assert met(100_000_000) < 100 * met(1_000_000) * 100 / 4


def sequential(rows, radius):
    """(key, leader) of rows (key, hash, at) one after the other."""
    leaders, first, out = [], {}, {}
    for key, h, at in sorted((r for r in rows if r[1] is not None), key=lambda r: (r[2], r[0])):
        if h not in first:
            found = next((k for k, x in leaders if (x ^ h).bit_count() <= radius), None)
            if found is None:
                leaders.append((key, h))
                found = key
            first[h] = found
        out[key] = first[h]
    return out


def test_fold_equals_the_sequential_one(spark):
    rng = random.Random(2)
    hashes = some_hashes(rng)
    rows = [(k, h, rng.randrange(40)) for k, h in enumerate(hashes + rng.sample(hashes, 50))] + [(9999, None, 1)]
    df = spark.createDataFrame([(k, None if h is None else signed(h), at) for k, h, at in rows], "id long, h long, at long")
    got = {r["id"]: r["leader"] for r in near.leader_fold(df, "id", "h", "at", 8).collect()}
    assert got == sequential(rows, 8)


@pytest.mark.parametrize("reach", [1, 2])
def test_one_family_of_a_hundred_thousand(spark, reach):
    """Chains in order, in which every node waits for the one before: nothing is grouped by family.  With reach 2 (each is near the
    two before it) order is mixed, since a chain of nodes with two neighbours each cannot be doubled."""
    n = 100_000
    if reach == 1:
        edges = spark.range(1, n).select(F.col("id").alias("node"), (F.col("id") - 1).alias("earlier"))
        got = {r["node"] for r in near.leading(spark.range(n).select(F.col("id").alias("node")), edges).collect()}
        assert got == set(range(0, n, 2))
        return
    rng = random.Random(1)
    place = list(range(n))
    rng.shuffle(place)
    pairs = [(max(place[i], place[j]), min(place[i], place[j])) for i in range(n) for j in (i + 1, i + 2) if j < n]
    by = {}
    for a, b in pairs:
        by.setdefault(a, []).append(b)
    lead = [False] * n
    for x in range(n):
        lead[x] = not any(lead[y] for y in by.get(x, ()))
    got = {r["node"] for r in near.leading(spark.range(n).select(F.col("id").alias("node")), spark.createDataFrame(pairs, "node long, earlier long")).collect()}
    assert got == {x for x in range(n) if lead[x]}
