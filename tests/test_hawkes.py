"""The fit of split series against the fit of whole ones, and its parts against plain sums."""

import numpy as np
import pytest

from lanternfish.operators import hawkes


def simulated(rng, n, mu, ratio, beta):
    """Times of a self-exciting process: every event begets a Poisson number of others."""
    out, front = [], np.sort(rng.uniform(0, n * (1 - ratio) / mu, rng.poisson(n * (1 - ratio)))).tolist()
    while front:
        out += front
        front = [t + rng.exponential(1 / beta) for t in front for _ in range(rng.poisson(ratio))]
    return np.sort(np.array(out))


def test_chunks_give_the_whole_likelihood_and_its_derivatives():
    rng = np.random.default_rng(3)
    t = np.sort(np.concatenate([rng.uniform(0, 40, 300), [7.0] * 5, rng.uniform(900, 901, 50)]))
    point = np.array([0.7, 0.4, 3.0])

    def slow(p):
        mu, ratio, beta = p
        rates = [mu + ratio * beta * np.exp(-beta * (t[i] - t[:i])).sum() for i in range(len(t))]
        return mu * (t[-1] - t[0]) + ratio * (1 - np.exp(-beta * (t[-1] - t))).sum() - np.log(rates).sum()

    state, last, terms = np.zeros(3), t[0], np.zeros(10)
    for part in np.array_split(t, 7):
        state = hawkes._moved(state, point[2], part[0] - last)
        terms += hawkes.chunk_terms(part, t[-1], point, state)
        state = hawkes._moved(state, point[2], part[-1] - part[0]) + hawkes.excitement(part, point[2])[1]
        last = part[-1]
    assert terms[0] + point[0] * (t[-1] - t[0]) == pytest.approx(slow(point), rel=1e-10)
    grad = terms[1:4] + [t[-1] - t[0], 0, 0]
    eps = np.eye(3) * 1e-5
    assert grad == pytest.approx([(slow(point + e) - slow(point - e)) / 2e-5 for e in eps], rel=1e-5, abs=1e-4)
    curve = [[(slow(point + a + b) - slow(point + a - b) - slow(point - a + b) + slow(point - a - b)) / 4e-6 for b in np.eye(3) * 1e-3] for a in np.eye(3) * 1e-3]
    assert terms[4:] == pytest.approx(np.array(curve)[np.triu_indices(3)], rel=1e-3, abs=1e-2)


def test_split_series_agree_with_whole_ones(spark):
    """One author has most rows; fitted in chunks by many tasks, the parameters agree to a thousandth."""
    rng = np.random.default_rng(5)
    series = {"hot": simulated(rng, 6000, 2.0, 0.5, 8.0), "mild": simulated(rng, 700, 1.0, 0.3, 3.0), "short": np.arange(10.0), None: simulated(rng, 300, 1.0, 0.6, 5.0)}
    rows = [(name, float(t)) for name, times in series.items() for t in times] + [("hot", None)]
    df = spark.createDataFrame(rows, "author string, t double").repartition(6)
    whole = {r["author"]: r for r in hawkes.hawkes_fit(df, "author", "t").collect()}
    split = {r["author"]: r for r in hawkes.hawkes_fit(df, "author", "t", long_events=100, chunk=500).collect()}
    assert whole.keys() == split.keys() == {"hot", "mild", None}
    for name, r in whole.items():
        assert split[name]["n"] == r["n"] == len(series[name])
        for c in ("mu", "branching", "decay_hours"):
            assert split[name][c] == pytest.approx(r[c], rel=2e-3 if name is None else 1e-3)


def test_chunks_are_dealt_over_tasks(spark):
    """A series with nine tenths of all events is in chunks of many partitions."""
    df = spark.range(50_000).selectExpr("IF(id % 10 = 0, 'b', 'a') AS series", "CAST(id AS DOUBLE) AS t")
    held = hawkes.LongSeries(df, chunk=1000)
    sizes = {}
    for (pid, _), n, *_ in held.places["a"]:
        sizes[pid] = sizes.get(pid, 0) + n
    assert held.n == {"a": 45_000, "b": 5_000} and len(sizes) >= 7 and max(sizes.values()) < 2 * 45_000 / len(sizes)


def test_no_rows(spark):
    assert hawkes.hawkes_fit(spark.createDataFrame([], "author string, t double"), "author", "t").count() == 0
