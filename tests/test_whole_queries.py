"""Queries that SQL cannot express, over their whole small tables against slow and plain versions."""

import hashlib
import math

import numpy as np
import pytest
from lanternfish.operators import series
from lanternfish.plans import analytics, registry, views


def rows_of(spark, small, name):
    return registry.QUERIES[name](spark, small).collect()


def bits(a, b):
    return ((a ^ b) & (2**64 - 1)).bit_count()


def test_leader_fold(spark, small):
    rows = sorted(((-r["id"], r["id"], r["h"]) for r in views.hashes(spark, small).where("h IS NOT NULL").collect()))
    leaders, want = [], {}
    for _, key, h in rows:
        lead = next((k for k, g in leaders if bits(g, h) <= 8), None)
        if lead is None:
            leaders.append((key, h))
        want[key] = key if lead is None else lead
    assert {r["id"]: r["leader"] for r in rows_of(spark, small, "leader_fold")} == want
    assert any(k != v for k, v in want.items())


def test_simhash64(spark, small):
    texts = {r["doc_id"]: (r["text"] or "").split() for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    for r in rows_of(spark, small, "simhash64"):
        words = [int.from_bytes(hashlib.md5(w.encode()).digest()[:8], "big") for w in texts[r["doc_id"]]]
        want = sum(1 << k for k in range(64) if 2 * sum(w >> k & 1 for w in words) > len(words))
        assert r["h"] & (2**64 - 1) == want


def pictures(spark, small):
    return {r["vec_id"]: np.array(r["pixels"]).reshape(-1, r["width"]) for r in analytics._pictures(spark, small).collect()}


def test_border_trim(spark, small):
    shown = pictures(spark, small)
    for r in rows_of(spark, small, "border_trim"):
        g = shown[r["vec_id"]]
        lively = lambda lines: [i for i, line in enumerate(lines) if math.sqrt(sum((x - sum(line) / len(line)) ** 2 for x in line) / len(line)) > 3]
        down, across = lively(g.tolist()), lively(g.T.tolist())
        whole = len(down) < 16 or len(across) < 16
        want = (0, len(g), 0, len(g[0])) if whole else (down[0], down[-1] + 1, across[0], across[-1] + 1)
        assert (r["top"], r["bottom"], r["left"], r["right"]) == want


def plain_seam(g):
    """Row by row, column by column: place, contrast, rows, band and straightness of the longest cut."""
    steps = [[abs(b - a) for a, b in zip(row, row[1:])] for row in g]
    height, width = len(steps), len(steps[0])
    mean = lambda xs: sum(xs) / len(xs)
    columns = [mean([row[c] for row in steps]) for c in range(width)]
    least = max(12.0, 3 * (float(np.median(columns)) + 1))
    first, last = int(0.3 * width), int(0.7 * width)
    hits = {c: [max(row[c - 1 : c + 2]) > least for row in steps] for c in range(first, last)}
    best = None
    for c in sorted(hits, key=lambda c: -sum(hits[c]))[:6]:
        at = [y for y, hit in enumerate(hits[c]) if hit]
        runs = [[y] for y in at[:1]]
        for y in at[1:]:
            if y - runs[-1][-1] <= 4:
                runs[-1].append(y)
            else:
                runs.append([y])
        if runs:
            run = max(runs, key=lambda r: r[-1] - r[0])
            key = (run[-1] - run[0], columns[c])
            if best is None or key > best[0]:
                best = (key, c, run[0], run[-1] + 1)
    if best is None:
        return (None, 0.0, 0.0, 0.0, 1.0, 0.0)
    _, x, top, bottom = best
    band = steps[top:bottom]
    sharpest = [max(range(max(0, x - 4), min(width, x + 5)), key=lambda c, row=row: (row[c], -c)) for row in band]
    straight = max(mean([abs(s - c) <= 1 for s in sharpest]) for c in range(x - 4, x + 5))
    contrast = mean([row[x] for row in band]) / (float(np.median([mean([row[c] for row in band]) for c in range(width)])) + 1)
    return ((x + 0.5) / width, contrast, len(band) / height, top / height, bottom / height, straight)


def test_seam_find(spark, small):
    shown = pictures(spark, small)
    found = rows_of(spark, small, "seam_find")
    for r in found:
        want = plain_seam(shown[r["vec_id"]].tolist())
        assert tuple(r[c] for c in ("seam_x", "seam_score", "seam_rows", "seam_y0", "seam_y1", "seam_straight")) == pytest.approx(want)
    assert len(found) == len(shown) and any(r["seam_x"] is not None for r in found)


def test_bootstrap(spark, small):
    values = {}
    for r in analytics._engaged(spark, small).collect():
        values.setdefault(r["klass"], []).append(r["x"])
    rng = np.random.default_rng(0)
    for name, statistic in (("bootstrap_ci", np.median), ("bootstrap_mean", np.mean)):
        for r in rows_of(spark, small, name):
            x = np.array(values[r["klass"]])
            drawn = statistic(rng.choice(x, (3000, len(x))), axis=1)
            spread = drawn.std() + 1e-9
            assert (r["low"], r["high"]) == pytest.approx(tuple(np.percentile(drawn, [2.5, 97.5])), abs=0.35 * spread) and r["n"] == len(x)


def test_change_points(spark, small):
    days = {}
    for r in analytics._dense(spark, small).collect():
        days.setdefault(r["klass"], []).append((r["day"], r["n"]))
    found = {}
    for r in rows_of(spark, small, "change_points"):
        found.setdefault(r["klass"], []).append((r["start"], r["stop"], r["rate"]))

    def cost(y):
        s = sum(y)
        return -2 * (s * math.log(s / len(y)) - s) if s else 0.0

    assert found.keys() == {k for k, v in days.items() if sum(n for _, n in v) >= 10}
    for klass, cuts in found.items():
        y = [n for _, n in sorted(days[klass])]
        penalty, best = 2 * math.log(len(y)), [0.0]
        for t in range(1, len(y) + 1):
            best.append(min(best[s] + cost(y[s:t]) + penalty for s in range(t)))
        cuts.sort()
        assert [a for a, *_ in cuts] == [0, *[b for _, b, _ in cuts][:-1]] and cuts[-1][1] == len(y)
        assert sum(cost(y[a:b]) + penalty for a, b, _ in cuts) == pytest.approx(best[-1])
        assert all(rate == pytest.approx(sum(y[a:b]) / (b - a), abs=1e-6) for a, b, rate in cuts)


def test_hawkes_fit(spark, small):
    """The fit is no worse than any point of a grid, by a plain sum over all pairs of events."""
    times = {}
    for r in spark.read.parquet(f"{small}/events.parquet").select("user_id", "ts").collect():
        times.setdefault(str(r["user_id"]), []).append(r["ts"].timestamp() / 86400)

    def nll(t, mu, ratio, beta):
        past = [sum(math.exp(-beta * (x - y)) for y in t[:i]) for i, x in enumerate(t)]
        return mu * t[-1] + ratio * sum(1 - math.exp(-beta * (t[-1] - x)) for x in t) - sum(math.log(mu + ratio * beta * a) for a in past)

    found = rows_of(spark, small, "hawkes_fit")
    assert {r["author"] for r in found} == {k for k, v in times.items() if len(v) >= 30}
    for r in found[:3]:
        t = sorted(times[r["author"]])
        t = [x - t[0] for x in t]
        own = nll(t, r["mu"], r["branching"], 24 / r["decay_hours"])
        rate = len(t) / t[-1]
        grid = [nll(t, rate * (1 - b), b, beta) for b in (0.05, 0.3, 0.6, 0.9) for beta in (0.5, 2, 8, 24)]
        assert own <= min(grid) + 0.05


def test_segments_of_one_day():
    assert series.poisson_segments(np.array([3.0])) == [(0, 1)]
