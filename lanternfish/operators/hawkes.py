"""Fit of self-exciting processes: short series one to a task, long ones by many tasks at once.

An exponential process excites itself by a sum that fades, so a chunk of a series needs from all before it three numbers: the sum
and its first two derivatives by the decay.  A pass over the chunks of all long series gives what each chunk leaves behind, a
second one the likelihood, its gradient and its curvature, for several points of every series together.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from lanternfish.functions.frames import object_frame
from lanternfish.operators.series import fit_short
from lanternfish.plans.staging import discard, parts_for, stage

LONG_EVENTS, CHUNK_EVENTS, PART_ROWS = 200_000, 1 << 16, 1 << 20
STARTS = ((0.5, 2.0), (0.8, 20.0))  # share of events that come unprompted, and decay
STEPS = (1.0, 0.5, 0.2, 0.05)
ROUNDS, MOST_RATIO = 60, 0.999
Points = dict[str, np.ndarray]  # of each series, rows (mu, ratio, beta)


def _moved(state: np.ndarray, beta: float, gap: np.ndarray | float) -> np.ndarray:
    """(sum, first, second derivative by the decay) after a gap without events; gaps may be an array (n x 3 then)."""
    fade = np.exp(-beta * np.asarray(gap, float))
    a, b, c = (state[..., k] for k in range(3))
    return np.stack([fade * a, fade * (b - gap * a), fade * (c - 2 * gap * b + gap * gap * a)], axis=-1)


def excitement(t: np.ndarray, beta: float, before: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Of every event the (sum, derivatives) that earlier events leave, and the state right after the last event.

    ``before`` is the state at the first event.  Times are taken in blocks over which nothing fades by more than e^50.
    """
    out, state, at, last = np.empty((len(t), 3)), np.zeros(3) if before is None else before, 0, t[0]
    while at < len(t):
        stop = max(at + 1, int(np.searchsorted(t, t[at] + 50.0 / beta, side="right")))
        since = t[at:stop] - t[at]
        here = _moved(state, beta, t[at] - last)
        grown = np.exp(beta * since)
        sums = np.cumsum(np.stack([grown, grown * since, grown * since * since], axis=1), axis=0)
        sums = np.vstack([np.zeros(3), sums])  # before each event; the last is after all
        to = np.append(since, since[-1])
        fade = np.exp(-beta * to)
        own = np.stack([fade * sums[:, 0], -fade * (to * sums[:, 0] - sums[:, 1]), fade * (to * to * sums[:, 0] - 2 * to * sums[:, 1] + sums[:, 2])], axis=1)
        both = own + _moved(here[None, :], beta, to)
        out[at:stop] = both[:-1]
        state, last, at = both[-1], t[stop - 1], stop
    return out, state


def chunk_terms(t: np.ndarray, end: float, point: np.ndarray, before: np.ndarray) -> np.ndarray:
    """What a chunk adds to the negative likelihood (without mu times the span), its gradient and its curvature in (mu, ratio,
    beta), as 1 + 3 + 6 numbers."""
    mu, ratio, beta = point
    a, b, c = excitement(t, beta, before)[0].T
    rate = mu + ratio * beta * a
    first = np.stack([np.ones_like(a), beta * a, ratio * (a + beta * b)])
    u = end - t
    fade = np.exp(-beta * u)
    q, q1, q2 = (1 - fade).sum(), (u * fade).sum(), -(u * u * fade).sum()
    grad = np.array([0.0, q, ratio * q1]) - (first / rate).sum(axis=1)
    curve = (first[:, None, :] * first[None, :, :] / rate**2).sum(axis=2)
    curve[1, 2] += q1 - ((a + beta * b) / rate).sum()
    curve[2, 2] += ratio * q2 - (ratio * (2 * b + beta * c) / rate).sum()
    return np.concatenate([[ratio * q - np.log(rate).sum()], grad, curve[np.triu_indices(3)]])


def _chunks(rows: DataFrame, chunk: int) -> DataFrame:
    """(series, pid, seq, times): the sorted times of each series (series, t), cut where a task's rows end and at ``chunk`` events."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        pid, current, held, seq = TaskContext.get().partitionId(), None, [], 0

        def full() -> pd.DataFrame:
            return object_frame([(current, pid, seq, np.array(held))], ["series", "pid", "seq", "times"])

        for batch in batches:
            for series, own in batch.groupby("series", sort=False):
                if series != current:
                    if held:
                        yield full()
                    current, held, seq = series, [], 0
                held += own["t"].tolist()
                while len(held) >= chunk:
                    held, rest = held[:chunk], held[chunk:]
                    yield full()
                    held, seq = rest, seq + 1
        if held:
            yield full()

    parts = parts_for(rows.sparkSession, rows.count(), PART_ROWS)
    placed = rows.repartitionByRange(parts, "series", "t").sortWithinPartitions("series", "t")
    return placed.mapInPandas(cut, "series string, pid int, seq int, times array<double>")


class LongSeries:
    """Staged chunks of series and what the driver knows of each: one row a chunk."""

    def __init__(self, rows: DataFrame, chunk: int = CHUNK_EVENTS):
        self.chunks = stage(_chunks(rows, chunk), "hawkes-chunks")
        known = self.chunks.select("series", "pid", "seq", F.size("times").alias("n"), F.col("times")[0].alias("first"), F.element_at("times", -1).alias("last"))
        self.places: dict[str, list] = {}
        for r in sorted(known.collect()):
            self.places.setdefault(r["series"], []).append(((r["pid"], r["seq"]), r["n"], r["first"], r["last"]))
        self.n = {s: sum(p[1] for p in own) for s, own in self.places.items()}
        self.end = {s: own[-1][3] for s, own in self.places.items()}
        self.span = {s: max(own[-1][3] - own[0][2], 1e-6) for s, own in self.places.items()}

    def _left_behind(self, points: Points) -> dict[tuple, np.ndarray]:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                out = [(s, int(p), int(q), np.concatenate([excitement(np.asarray(t), beta)[1] for _, _, beta in points[s]]).tolist())
                       for s, p, q, t in batch.itertuples(index=False) if s in points]
                yield object_frame(out, ["series", "pid", "seq", "state"])

        rows = self.chunks.mapInPandas(run, "series string, pid int, seq int, state array<double>").collect()
        return {(r["series"], r["pid"], r["seq"]): np.array(r["state"]).reshape(-1, 3) for r in rows}

    def terms(self, points: Points) -> dict[str, list[tuple[float, np.ndarray, np.ndarray]]]:
        """(likelihood, gradient, curvature) at every point of every series named."""
        left, before = self._left_behind(points), {}
        for s, own in points.items():
            state, last = np.zeros((len(own), 3)), self.places[s][0][2]
            for place, _, first, stop in self.places[s]:
                state = np.stack([_moved(x, p[2], first - last) for x, p in zip(state, own)])
                before[(s, *place)] = state
                faded = np.stack([_moved(x, p[2], stop - first) for x, p in zip(state, own)])
                state, last = faded + left[(s, *place)], stop
        shared = self.chunks.sparkSession.sparkContext.broadcast(before)  # three numbers a point and chunk
        end = self.end

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                out = [(s, k, chunk_terms(np.asarray(t), end[s], p, b).tolist()) for s, pid, seq, t in batch.itertuples(index=False) if s in points
                       for k, (p, b) in enumerate(zip(points[s], shared.value[s, pid, seq]))]
                yield object_frame(out, ["series", "k", "terms"])

        each = self.chunks.mapInPandas(run, "series string, k int, terms array<double>").select("series", "k", F.posexplode("terms").alias("at", "x"))
        found: dict[tuple[str, int], np.ndarray] = {}
        for r in each.groupBy("series", "k", "at").agg(F.sum("x").alias("x")).collect():
            found.setdefault((r["series"], r["k"]), np.zeros(10))[r["at"]] = r["x"]
        shared.destroy()
        out = {}
        for s, own in points.items():
            out[s] = []
            for k, p in enumerate(own):
                v = found[s, k]
                curve = np.zeros((3, 3))
                curve[np.triu_indices(3)] = v[4:]
                out[s].append((v[0] + p[0] * self.span[s], v[1:4] + [self.span[s], 0.0, 0.0], curve + np.triu(curve, 1).T))
        return out


def _ahead(theta: np.ndarray, grad: np.ndarray, curve: np.ndarray) -> np.ndarray:
    """Trial points in logarithms: along the Newton step of the curvature's absolute value, at several lengths."""
    p = np.exp(theta)
    g = p * grad
    values, vectors = np.linalg.eigh(p[:, None] * curve * p[None, :] + np.diag(g))
    step = -vectors @ ((vectors.T @ g) / np.maximum(np.abs(values), 1e-6 * max(1.0, np.abs(values).max())))
    step *= min(1.0, 2.0 / max(np.abs(step).max(), 1e-12))
    trial = np.clip(theta + np.outer(STEPS, step), -20, 20)
    trial[:, 1] = np.minimum(trial[:, 1], math.log(MOST_RATIO) - 1e-9)
    return trial


def fit_long(series: LongSeries) -> dict[str, np.ndarray]:
    """(mu, ratio, beta) of each series: Newton steps from two starts, all series and trial points of a step in one pass."""
    theta = {s: [np.log([n / series.span[s] * share, 1 - share, beta]) for share, beta in STARTS] for s, n in series.n.items()}
    known = {s: list(v) for s, v in series.terms({s: np.exp(np.array(t)) for s, t in theta.items()}).items()}
    moving = {(s, k) for s in theta for k in range(len(STARTS))}
    for _ in range(ROUNDS):
        if not moving:
            break
        trials = {(s, k): _ahead(theta[s][k], *known[s][k][1:]) for s, k in moving}
        points, order = {}, {}
        for (s, k), trial in trials.items():
            order.setdefault(s, []).append((k, trial))
            points[s] = np.exp(np.vstack([t for _, t in order[s]]))
        found = series.terms(points)
        for s, own in order.items():
            for j, (k, trial) in enumerate(own):
                some = found[s][j * len(STEPS) : (j + 1) * len(STEPS)]
                best = min(range(len(STEPS)), key=lambda i: some[i][0] if math.isfinite(some[i][0]) else math.inf)
                gain = known[s][k][0] - some[best][0]
                if gain > 0:
                    theta[s][k], known[s][k] = trial[best], some[best]
                if not gain > 1e-9 * (1 + abs(known[s][k][0])):
                    moving.discard((s, k))
    return {s: np.exp(theta[s][int(np.argmin([x[0] for x in known[s]]))]) for s in theta}


def hawkes_fit(df: DataFrame, by: str, time: str, least: int = 30, long_events: int = LONG_EVENTS, chunk: int = CHUNK_EVENTS) -> DataFrame:
    """(by, n, mu, branching, decay_hours): the fit of each series with at least ``least`` events; rows without a time are left out,
    and those without a name are a series of their own.

    Series of more than ``long_events`` events are fitted by all tasks together; of these the driver holds one row a chunk of
    ``chunk`` events.  The others are fitted one to a task by a simplex search.
    """
    key = F.to_json(F.struct(F.col(by).alias("k")))
    rows = stage(df.where(F.col(time).isNotNull()).select(F.col(by).cast("string").alias(by), F.col(time).cast("double").alias("t")).withColumn("series", key), "hawkes-rows")
    sizes = stage(rows.groupBy("series").agg(F.count("*").alias("n"), F.first(by).alias("name")), "hawkes-sizes")
    long = sizes.where(F.col("n") > long_events)
    short = rows.join(sizes.where(F.col("n").between(least, long_events)).select("series"), "series", "left_semi")
    fitted = fit_short(short.select("series", by, "t"), by, least)
    if long.isEmpty():
        return fitted
    names = {r["series"]: r["name"] for r in long.collect()}  # no more than rows / long_events
    held = LongSeries(rows.join(F.broadcast(long.select("series")), "series", "left_semi").select("series", "t"), chunk)
    found = [(names[s], held.n[s], float(mu), float(ratio), float(24 / beta)) for s, (mu, ratio, beta) in fit_long(held).items()]
    discard(held.chunks)
    return fitted.union(df.sparkSession.createDataFrame(found, fitted.schema))
