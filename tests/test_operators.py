"""Closed-form values, brute force and properties of the operators outside the optional subpackage."""

import math
import random

import numpy as np
import pytest
from lanternfish.functions import columns as C, tails
from lanternfish.operators import components, embedding, hawkes, images, near, ranking, relational as R, series, statistics as T
from lanternfish.sources import pages, windows
from pyspark.sql import functions as F


def one(spark, column, **values):
    """Value of a column expression over one row."""
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return row.select(column.alias("out")).first()["out"]


@pytest.mark.parametrize("url, first, last", [
    ("https://a/sitemap-2024.xml", "2024-01-01", "2024-12-31"), ("https://a/2024-02", "2024-02-01", "2024-02-29"), ("https://a/2024/02/30/x", "2024-02-01", "2024-02-29"),
    ("https://a/?yyyy=2025&mm=03&dd=07", "2025-03-07", "2025-03-07"), ("https://a/202503.xml", "2025-03-01", "2025-03-31"), ("https://a/?yyyy=2025&mm=03", "2025-03-01", "2025-03-31"), ("https://a/?yyyy=2025&amp;mm=03&amp;dd=07", "2025-03-07", "2025-03-07"),
    ("https://a/sitemap-2024.xml?mm=03&dd=07", "2024-03-07", "2024-03-07"), ("https://a/2024/0105", "2024-01-05", "2024-01-05"), ("https://a/2024-13.xml", "2024-01-01", "2024-12-31"), ("https://a/2024_01-02x", "2024-01-02", "2024-01-02"), ("https://a/none", None, None), ("https://a/1999/01/02", None, None),
])
def test_url_dates(spark, url, first, last):
    a, b = C.url_date_span(F.lit(url))
    got = spark.range(1).select(a.cast("string").alias("a"), b.cast("string").alias("b")).first()
    assert (got["a"], got["b"]) == (first, last)


@pytest.mark.parametrize("url, domain", [("https://www.a.example/x", "a.example"), ("http://u:p@b.example:8080/", "u:p@b.example:8080"), (None, "none"), ("not a url", "none")])
def test_domains(spark, url, domain):
    assert one(spark, C.url_domain(F.lit(url), F.lit("none"))) == domain


def test_text_helpers(spark):
    assert one(spark, C.join_parts(F.lit("a"), F.lit(""), F.lit(None).cast("string"), F.lit("b"))) == "a b"
    assert one(spark, C.html_escape(F.lit('<a href="x">&</a>'))) == "&lt;a href=&quot;x&quot;&gt;&amp;&lt;/a&gt;"
    assert one(spark, C.iso_from_compact(F.lit("20240102T030405Z"))) == "2024-01-02T03:04:05Z"
    assert one(spark, C.repair_json(F.lit(r'{"t": "a\x \" \\n"}'))) == r'{"t": "a\\x \" \\n"}'.replace(r"\\n", r"\\n")
    assert one(spark, C.not_in(F.lit(None).cast("string"), ["a"])) is True
    page = "<html><title> A\n b </title><meta content='c' property='og:title'><meta property=\"og:image\" content=\"d\"></html>"
    assert one(spark, pages.html_title(F.lit(page))) == "A b"
    assert (one(spark, pages.meta_content(F.lit(page), "og:title")), one(spark, pages.meta_content(F.lit(page), "og:image"))) == ("c", "d")
    assert one(spark, pages.unescape(F.lit("a &amp; &eacute;"))) == "a & é"


@pytest.mark.parametrize("text, score, hits", [
    (None, 0.0, []), ("", 0.0, []), ("123", 0.0, []), ("poisonous", 5.0, ["poisonous", "poisonous"]), ("BREAKING now", round(2 / math.sqrt(2), 3), ["opener"]),
    ("AAAA BBBB!!!!!", round((1 + 1.5) / math.sqrt(2), 3), ["caps"]), ("don't", 0.0, []),
])
def test_alarm(spark, text, score, hits):
    s, h = C.alarm_score(F.lit(text).cast("string"), ((3, r"poison[a-z]*"), (2, r"poisonous")), r"breaking\b")
    got = spark.range(1).select(s.alias("s"), h.alias("h")).first()
    assert (got["s"], got["h"]) == (score, hits)


@pytest.mark.parametrize("k, n, low, high", [(0, 10, 0.0, 0.2775), (10, 10, 0.7225, 1.0), (81, 100, 0.7222, 0.8749)])
def test_wilson(spark, k, n, low, high):
    a, b = C.wilson(F.lit(float(k)), F.lit(float(n)))
    got = spark.range(1).select(a.alias("a"), b.alias("b")).first()
    assert got["a"] == pytest.approx(low, abs=2e-4) and got["b"] == pytest.approx(high, abs=2e-4)


def test_writes_are_idempotent(spark):
    target = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    batch = spark.createDataFrame([(2, "x"), (3, "y"), (3, "z")], "k int, v string")
    once = R.insert_ignore(target, batch, ["k"], ["v"])
    again = R.insert_ignore(once, batch, ["k"], ["v"])
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, again.collect())) == [(1, "a"), (2, "b"), (3, "y")]
    up = R.upsert(target, batch, ["k"], [F.desc("v")])
    assert sorted(map(tuple, R.upsert(up, batch, ["k"], [F.desc("v")]).collect())) == [(1, "a"), (2, "x"), (3, "z")]


def test_components_do_not_depend_on_order(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(500, 560)] + [(900, i) for i in range(901, 960)]
    parent = {x: x for e in edges for x in e}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    want = {x: find(x) for e in edges if e[0] != e[1] for x in e}
    for _ in range(2):
        rng.shuffle(edges)
        got = components.connected_components(spark.createDataFrame([(b, a) for a, b in edges] + [(None, 1)], "src long, dst long"))
        assert {r["node"]: r["component"] for r in got.collect()} == want


def test_hamming_pairs_equal_brute_force(spark):
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(150)]
    values = base + [b ^ sum(1 << k for k in rng.sample(range(64), n)) for b in base[:40] for n in (3, 8, 9)]
    signed = [v - 2**64 if v >= 2**63 else v for v in values]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(signed + signed[:5])], "id long, h long")
    got = {(r["a"], r["b"], r["distance"]) for r in near.hamming_pairs(df, "h", 8).collect()}
    mask = 2**64 - 1
    want = {(min(a, b), max(a, b), d) for i, a in enumerate(signed) for b in signed[i + 1 :] if a != b and (d := ((a ^ b) & mask).bit_count()) <= 8}
    assert got == want


def test_leaders_differ_from_families(spark):
    a, b, c = 0, 0xFF, 0xFFFF  # a-b and b-c within 8 bits, a-c not
    df = spark.createDataFrame([(1, a, 1), (2, c, 2), (3, b, 3)], "id long, h long, at long")
    assert len({r["family"] for r in near.families(df, "h", 8).collect()}) == 1
    assert {r["id"]: r["leader"] for r in near.leader_fold(df, "id", "h", "at", 8).collect()} == {1: 1, 2: 2, 3: 1}


@pytest.mark.parametrize("small", [0, 1 << 18])
def test_running_sums(spark, small):
    df = spark.createDataFrame([(g, v, v % 3 + 1) for g in "ab" for v in range(50)], "g string, v int, w int")
    got = {(r["g"], r["v"]): r["s"] for r in ranking.running_sum(df, "v", "w", "s", ["g"], small_rows=small).collect()}
    assert all(got[g, v] == sum(x % 3 + 1 for x in range(v + 1)) for g in "ab" for v in range(50))


def test_distributions(spark):
    df = spark.createDataFrame([(float(x),) for x in [1, 1, 2, 5, 9]], "x double")
    x = sorted([1, 1, 2, 5, 9])
    want = sum((2 * i - 5 - 1) * v for i, v in enumerate(x, 1)) / (5 * sum(x))
    assert T.gini(df, "x").first()["gini"] == pytest.approx(want, abs=1e-4)
    zero = spark.createDataFrame([(0.0,), (0.0,)], "x double")
    assert T.gini(zero, "x").first()["gini"] is None
    kinds = spark.createDataFrame([(k,) for k in "aabb"], "k string")
    e = T.entropy(kinds, "k").first()
    assert (e["bits"], e["effective"], e["kinds"]) == (1.0, 2.0, 2)
    sides = spark.createDataFrame([("l", "a"), ("l", "a"), ("r", "b")], "s string, v string")
    assert T.jensen_shannon(sides, "s", "v", "l", "r").first()["jsd"] == 1.0
    assert T.jensen_shannon(sides, "s", "v", "l", "none").first()["jsd"] is None


def test_tests(spark):
    two = spark.createDataFrame([("a", float(i)) for i in range(6)] + [("b", float(i + 10)) for i in range(6)], "s string, v double")
    r = T.mann_whitney(two, "s", "v", "a", "b").first()
    assert (r["u"], r["superiority"]) == (0.0, 0.0)
    few = two.where("v < 14")
    assert T.mann_whitney(few, "s", "v", "a", "b").first()["u"] is None
    assert T.kruskal(two, "s", "v").first()["h"] == pytest.approx(8.307692, abs=1e-6)
    same = spark.createDataFrame([(float(i), float(2 * i)) for i in range(12)], "x double, y double")
    assert T.spearman(same, "x", "y").first()["rho"] == 1.0
    table = spark.createDataFrame([("a", "x")] * 10 + [("a", "y")] * 20 + [("b", "x")] * 30 + [("b", "y")] * 40, "r string, c string")
    assert T.chi_square(table, "r", "c", "a", "b").first()["chi2"] == pytest.approx(0.446429, abs=1e-4)
    assert tails.chi_square_p(3.841459, 1) == pytest.approx(0.05, abs=1e-6) and tails.normal_p(1.959964) == pytest.approx(0.05, abs=1e-6)
    assert one(spark, T.binomial_test(F.lit(1), F.lit(10))) == pytest.approx(0.021484, abs=1e-6)
    assert one(spark, T.beta_posterior(F.lit(5), F.lit(5))) == pytest.approx(1 - 0.5**6, abs=1e-6)
    assert one(spark, T.binomial_test(F.lit(0), F.lit(0))) is None


def test_bootstrap_covers_the_mean(spark):
    df = spark.createDataFrame([("a", float(x)) for x in np.random.default_rng(1).normal(5, 1, 500)] + [("b", 1.0)], "k string, x double")
    values = np.random.default_rng(1).normal(5, 1, 500)
    for name, f in (("mean", np.mean), ("median", np.median)):
        rows = {r["k"]: r for r in T.bootstrap_interval(df, "k", "x", name).collect()}
        drawn = [f(np.random.default_rng(s).choice(values, 500)) for s in range(2000)]
        assert (rows["a"]["low"], rows["a"]["high"]) == pytest.approx(tuple(np.percentile(drawn, [2.5, 97.5])), abs=0.02)
        assert rows["b"]["low"] is None and rows["b"]["n"] == 1


def test_bootstrap_draws_middle_values():
    rng = np.random.default_rng(3)
    for n in (5, 8):
        drawn = np.sort(rng.integers(1, n + 1, (40_000, n)), axis=1)[:, [(n + 1) // 2 - 1, n // 2]]
        found = T.middle_draws(n, 40_000, 1)
        for pair in {tuple(x) for x in drawn.tolist()}:
            assert np.mean((found == pair).all(axis=1)) == pytest.approx(np.mean((drawn == pair).all(axis=1)), abs=0.01)


def test_segments_are_optimal():
    rng = np.random.default_rng(3)

    def cost(y, a, b):
        s = y[a:b].sum()
        return 0.0 if s == 0 else -2 * (s * math.log(s / (b - a)) - s)

    for _ in range(15):
        y = np.concatenate([rng.poisson(r, rng.integers(3, 15)) for r in rng.choice([0.3, 2, 9], 3)]).astype(float)
        penalty = 2 * math.log(max(len(y), 2))
        best = [-penalty]
        for t in range(1, len(y) + 1):
            best.append(min(best[s] + cost(y, s, t) + penalty for s in range(t)))
        cuts = series.poisson_segments(y)
        assert sum(cost(y, a, b) + penalty for a, b in cuts) - penalty == pytest.approx(best[-1])
        assert [a for a, _ in cuts][1:] == [b for _, b in cuts][:-1] and cuts[0][0] == 0 and cuts[-1][1] == len(y)
    assert series.poisson_segments(np.zeros(5)) == [(0, 5)] and series.poisson_segments(np.ones(1)) == [(0, 1)]


def test_hawkes(spark):
    rng = np.random.default_rng(5)
    t, out = 0.0, []
    while t < 40:
        t += rng.exponential(1.0)
        out += [t + x for x in np.cumsum(rng.exponential(0.02, rng.integers(0, 6)))] + [t]
    df = spark.createDataFrame([("a", float(x)) for x in sorted(out)] + [("b", 1.0)], "k string, t double")
    rows = hawkes.hawkes_fit(df, "k", "t").collect()
    assert len(rows) == 1 and 0.3 < rows[0]["branching"] < 0.98 and rows[0]["mu"] > 0
    nll = series.hawkes_likelihood(df.where("k = 'a'"), "k", "t", 1.0, 0.0, 1.0).first()["nll"]
    assert nll == pytest.approx(max(out), abs=1e-3)


def test_vectors(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.6, 0.8]), (3, [0.0, 0.0])], "k int, v array<double>")
    refs = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 2.0])], "r string, rv array<double>")
    got = {r["k"]: r["sim"] for r in embedding.top_mean_cosine(rows, "k", "v", refs, "rv", k=1).collect()}
    assert got == {1: pytest.approx(1, abs=1e-6), 2: pytest.approx(0.8, abs=1e-6), 3: 0.0}
    with pytest.raises(ValueError):
        embedding.bounded(spark.range(11), 10)


@pytest.mark.parametrize("sim, mass, cos, cx, klass", [
    (0.4999, 0.5, 0.24, 0.4, "object_only"), (0.50, 0.50, 0.0, 0.4999, "subject_left"), (0.5, 0.5, 0.0, 0.5, "subject_right"),
    (0.2, 0.5, 0.2399, 0.4, "other"), (0.5, 0.1, 0.9, 0.4, "subject_only"), (None, 0.9, 0.9, None, "object_only"),
])
def test_class_rule(spark, sim, mass, cos, cx, klass):
    lit = lambda v: F.lit(v).cast("double")
    assert one(spark, embedding.classify(lit(sim), lit(mass), lit(cos), lit(cx))) == klass


def test_pictures():
    rng = np.random.default_rng(1)
    g = np.full((60, 120), 9.0)
    g[5:55, 10:110] = rng.normal(60, 6, (50, 100))
    assert images.border_box(g) == (5, 55, 10, 110)
    assert images.border_box(np.zeros((20, 20))) == (0, 20, 0, 20)
    split = rng.normal(60, 3, (60, 120))
    split[:, 64:] += 90
    found = images.find_seam(split)
    assert abs(found.x - 64 / 120) < 0.01 and found.contrast >= 5 and found.rows > 0.9 and found.straight > 0.9
    part = rng.normal(60, 3, (80, 120))
    part[20:60, 50:] += 90  # the cut runs down the middle rows only
    found = images.find_seam(part)
    assert (found.y0, found.y1) == (0.25, 0.75) and found.rows == 0.5 and abs(found.x - 50 / 120) < 0.01 and found.contrast >= 5 and found.straight > 0.9
    assert images.find_seam(np.full((80, 120), 5.0)) == images.Seam() == images.find_seam(np.zeros((4, 4)))
    assert images.longest_band(np.array([1, 1, 0, 0, 0, 1, 0, 0, 0, 0, 1], bool)) == (0, 5) and images.longest_band(np.zeros(3, bool)) == (0, -1)


def test_picture_hashes():
    rng = np.random.default_rng(4)
    g = rng.random((64, 96)) * 200
    small = g.reshape(32, 2, 32, 3).mean(axis=(1, 3))
    assert np.allclose(images.shrunk(g, 32, 32), small)
    low = np.array([[sum(small[y, x] * math.cos(math.pi * a * (2 * y + 1) / 64) * math.cos(math.pi * b * (2 * x + 1) / 64) for y in range(32) for x in range(32)) for b in range(8)] for a in range(8)])
    want = "".join(str(int(v > np.median(low))) for v in low.ravel())
    assert f"{images.perceptual_hash(g) & (2**64 - 1):064b}" == want
    slope = np.tile(np.arange(90.0), (40, 1))
    assert images.difference_hash(slope) == -1 and images.difference_hash(slope[:, ::-1]) == 0


def test_p_values(spark):
    from itertools import combinations

    for m, n in ((2, 3), (5, 6), (3, 9)):
        sums = [sum(some) - m * (m + 1) / 2 for some in combinations(range(1, m + n + 1), m)]
        assert tails.rank_sum_counts(m, n).tolist() == [sums.count(u) for u in range(m * n + 1)]
        for u in (0, 1, m * n // 2):
            assert tails.rank_sum_p(u, m, n, 0) == pytest.approx(min(1, 2 * sum(x >= m * n - u for x in sums) / len(sums)))
    # fixed values: known quantiles of the distributions
    assert tails.student_p(2.262157, 9) == pytest.approx(0.05, abs=1e-6) and tails.student_p(12.7062, 1) == pytest.approx(0.05, abs=1e-6)
    assert tails.chi_square_p(18.307038, 10) == pytest.approx(0.05, abs=1e-6) and tails.student_p(0, 5) == 1.0
    rng = np.random.default_rng(2)
    rows = [("a", float(v)) for v in rng.integers(0, 40, 60)] + [("b", float(v)) for v in rng.integers(5, 45, 50)]
    r = T.mann_whitney(spark.createDataFrame(rows, "s string, v double"), "s", "v", "a", "b").first()
    values, sides = np.array([v for _, v in rows]), np.array([s == "a" for s, _ in rows])
    ranks = np.array([(values < v).sum() + ((values == v).sum() + 1) / 2 for v in values])
    drawn = np.array([ranks[rng.permutation(110)[:60]].sum() for _ in range(20_000)])
    middle = 60 * 111 / 2
    assert r["p"] == pytest.approx(np.mean(np.abs(drawn - middle) >= abs(ranks[sides].sum() - middle)), abs=0.01)
    same = spark.createDataFrame([("a", 1.0)] * 6 + [("b", 1.0)] * 6, "s string, v double")
    assert T.mann_whitney(same, "s", "v", "a", "b").first()["p"] == 1.0 and T.kruskal(same, "s", "v").first()["p"] is None
    even = spark.createDataFrame([(float(i), 1.0) for i in range(12)], "x double, y double")
    assert T.spearman(even, "x", "y").first()["p"] is None


def test_windows(spark):
    from datetime import datetime, timedelta

    start = datetime(2024, 1, 1)
    stamps = [start + timedelta(minutes=m) for m in [*range(300), *([5000] * 40)]]
    count = lambda a, b: sum(a <= s < b for s in stamps)
    tiles = list(windows.bisect(count, start, start + timedelta(days=7), 50, timedelta(minutes=2)))
    assert sum(n for *_, n in tiles) == len(stamps) and all(n <= 50 or b - a <= timedelta(minutes=2) for a, b, n in tiles)

    class Fake(windows.WindowedSearch):
        @classmethod
        def name(cls):
            return "fake_search"

        def search(self, start, stop):
            yield from ((start, k) for k in range(3))

    windows.register(spark, Fake)
    rows = spark.read.format("fake_search").option("since", "2024-01-01").option("until", "2024-01-05").option("skip", "2024-01-02").load()
    assert rows.count() == 9 and {r["day"] for r in rows.collect()} == {"2024-01-01", "2024-01-03", "2024-01-04"}


def test_near_wall_golden(spark):
    """A wall of 21 sightings of 18 pictures, nine of which share one hash: ten families at the radius of eight bits."""
    rng = random.Random(9)
    shared = rng.getrandbits(63)
    hashes = [shared] * 9 + [rng.getrandbits(63) for _ in range(9)]
    df = spark.createDataFrame(list(enumerate(hashes)), "id long, h long")
    assert near.families(df, "h", 8).select("family").distinct().count() == 10


@pytest.mark.parametrize("radius", [0, 2, 3, 8, 11])
def test_hamming_pairs_are_all_there(spark, radius):
    rng = random.Random(radius)
    hashes = [rng.getrandbits(64) for _ in range(40)]
    for h in hashes[:30]:
        for _ in range(4):
            for k in rng.sample(range(64), rng.randint(1, radius + 3)):
                h ^= 1 << k
            hashes.append(h)
    signed = [h - (h >> 63 << 64) for h in dict.fromkeys(hashes)]
    found = near.hamming_pairs(spark.createDataFrame([(h,) for h in signed], "h long"), "h", radius).collect()
    want = {(a, b, n) for a in signed for b in signed if a < b and (n := ((a ^ b) & (2**64 - 1)).bit_count()) <= radius}
    assert {tuple(r) for r in found} == want and len(found) == len(want) and (want or not radius)


def test_ranks_and_quantiles_where_most_rows_are_tied(spark):
    """Nine tenths of the rows share a value: only counts of values are ranked, so no task meets them."""
    rng = random.Random(12)
    rows = [(rng.choice("ab"), 0.0 if rng.random() < 0.9 else rng.random() * 10) for _ in range(4000)] + [("a", None), ("c", 3.0)]
    df = spark.createDataFrame(rows, "side string, v double").repartition(8)
    a, b = ([v for s, v in rows if s == side and v is not None] for side in "ab")
    u = sum((x > y) + 0.5 * (x == y) for x in a for y in b)
    got = T.mann_whitney(df, "side", "v", "a", "b").first()
    assert (got["n_a"], got["n_b"]) == (len(a), len(b)) and got["u"] == pytest.approx(u, abs=1e-3)
    ranked = []
    real = T.running_sum
    T.running_sum = lambda counts, *args: ranked.append(counts.count()) or real(counts, *args)
    try:
        T.kruskal(df, "side", "v").collect()
        found = {r["side"]: r for r in T.exact_quantiles(df, ["side"], "v", {"median": 0.5, "p95": 0.95}).collect()}
        whole = T.exact_quantiles(df, [], "v", {"p97": 0.97}).first()["p97"]
    finally:
        T.running_sum = real
    assert max(ranked) <= len({(s, v) for s, v in rows})
    assert found["a"]["median"] == np.quantile(a, 0.5) and found["b"]["p95"] == pytest.approx(np.quantile(b, 0.95)) and found["c"]["p95"] == 3.0
    assert whole == pytest.approx(np.quantile([v for _, v in rows if v is not None], 0.97))


def test_siblings_of_a_hot_family(spark, monkeypatch):
    monkeypatch.setattr(R, "HOT_ROWS", 5)
    rows = [(k, "hot" if k % 10 else f"f{k % 3}") for k in range(200)] + [(500, None)]
    df = spark.createDataFrame(rows, "id long, family string")
    got = sorted((r["id"], r["sibling"], r["place"]) for r in R.siblings(df, "family", "id", [F.col("id")], k=4).collect())
    by = {}
    for k, f in rows:
        by.setdefault(f, []).append(k)
    assert got == sorted((k, s, n + 1) for k, f in rows if f for n, s in enumerate(sorted(by[f])[:4]))
