"""Time series and point processes: calendars and lags in Catalyst, sequential estimators one series to a task."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from lanternfish.functions.frames import object_frame
from lanternfish.operators.ranking import running_sum
from lanternfish.plans.staging import stage


def dense_daily(df: DataFrame, day: Column, since: str, until: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, day, n): counts for every day of the window, zero where there is none."""
    counts = df.groupBy(*by, day.alias("day")).agg(F.count("*").alias("n"))
    days = df.sparkSession.range(1).select(F.explode(F.sequence(F.lit(since).cast("date"), F.lit(until).cast("date"))).alias("day"))
    frame = df.select(*by).distinct().crossJoin(F.broadcast(days)) if by else days  # the calendar's length is set by its two dates
    return frame.join(counts, [*by, "day"], "left").select(*by, "day", F.coalesce("n", F.lit(0)).alias("n"))


def weekly(daily: DataFrame, since: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, week, n): sums over blocks of seven days from ``since`` on; the last may be shorter."""
    week = F.floor(F.datediff("day", F.lit(since).cast("date")) / 7).cast("int")
    return daily.groupBy(*by, week.alias("week")).agg(F.sum("n").alias("n"))


def lagged_correlation(daily: DataFrame, a: str, b: str, lags: int = 14) -> DataFrame:
    """(lag, r): mean of z-scored a at day + lag times b at day, over the overlap.  A positive lag means that a comes later."""
    stats = daily.agg(F.avg(a).alias("ma"), F.stddev_pop(a).alias("sa"), F.avg(b).alias("mb"), F.stddev_pop(b).alias("sb"))
    z = daily.crossJoin(F.broadcast(stats)).select("day", ((F.col(a) - F.col("ma")) / (F.col("sa") + 1e-9)).alias("za"), ((F.col(b) - F.col("mb")) / (F.col("sb") + 1e-9)).alias("zb"))
    shifted = z.select(F.explode(F.sequence(F.lit(-lags), F.lit(lags))).alias("lag"), "day", "zb").withColumn("day", F.date_add("day", F.col("lag")))
    return shifted.join(z.select("day", "za"), "day").groupBy("lag").agg(F.round(F.avg(F.col("za") * F.col("zb")), 6).alias("r"))


def change_points(daily: DataFrame, by: str, least: int = 10) -> DataFrame:
    """(by, start, stop, rate): segments of constant Poisson rate by the pruned exact search, for series with enough events."""

    def search(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("day")
        y = group["n"].to_numpy(float)
        if y.sum() < least:
            return object_frame([], [by, "start", "stop", "rate"])
        rows = [(group[by].iloc[0], a, b, round(float(y[a:b].mean()), 6)) for a, b in poisson_segments(y)]
        return object_frame(rows, [by, "start", "stop", "rate"])

    return daily.select(by, "day", "n").groupBy(by).applyInPandas(search, f"{by} string, start long, stop long, rate double")


def poisson_segments(y: np.ndarray, penalty: float | None = None) -> list[tuple[int, int]]:
    """Segmentation of least cost -2 (s ln(s / length) - s) plus a penalty for each segment, as half-open ranges."""
    n = len(y)
    penalty = 2 * math.log(max(n, 2)) if penalty is None else penalty
    total = np.concatenate(([0.0], np.cumsum(y)))
    best = np.full(n + 1, np.inf)
    best[0] = -penalty
    back = np.zeros(n + 1, int)
    alive = np.array([0])
    for t in range(1, n + 1):
        s = total[t] - total[alive]
        with np.errstate(divide="ignore", invalid="ignore"):
            cost = np.where(s > 0, -2 * (s * np.log(s / (t - alive)) - s), 0.0)
        value = best[alive] + cost
        k = int(np.argmin(value))
        best[t], back[t] = value[k] + penalty, alive[k]
        alive = np.append(alive[value <= best[t]], t)
    out, t = [], n
    while t > 0:
        out.append((int(back[t]), t))
        t = int(back[t])
    return out[::-1]


def hawkes_likelihood(df: DataFrame, by: str, time: str, mu: float, alpha: float, beta: float, decay: float = 8.0) -> DataFrame:
    """(by, n, nll): negative log likelihood of an exponential self-exciting process at fixed parameters; times are days.

    What earlier events still excite is a sum that fades, so time is cut into chunks that fade by exp(-``decay``): a chunk's
    own sum is one aggregate, what comes over from the chunks before takes the last few of them, and inside a chunk it is a
    running sum, which splits even a single author's rows.  Equal times excite each other in turn; rows of no author are left out.
    """
    width = decay / beta
    times = df.where(F.col(time).isNotNull()).groupBy(F.col(by).alias("series"), F.col(time).cast("double").alias("t")).agg(F.count("*").alias("m")).withColumn("c", F.floor(F.col("t") / width))
    times = stage(times.withColumn("w", F.col("m") * F.exp(beta * (F.col("t") - F.col("c") * width))), "hawkes-times")
    chunks = times.groupBy("series", "c").agg((F.sum("w") * math.exp(-decay)).alias("s"), F.sum("m").alias("n"), F.max("t").alias("last"))  # faded to the chunk's end
    reach = math.ceil(45 / decay)  # further back less is left than a double can hold
    later = chunks.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(reach)))).select("series", (F.col("c") + F.col("k")).alias("c"), (F.col("s") * F.exp(-decay * (F.col("k") - 1))).alias("s"))
    carried = later.groupBy("series", "c").agg(F.sum("s").alias("carry"))
    run = running_sum(times, "t", "w", "upto", ["series", "c"]).join(carried, ["series", "c"], "left")
    first = (F.col("upto") - F.col("w") + F.coalesce("carry", F.lit(0.0))) * F.exp(-beta * (F.col("t") - F.col("c") * width))
    logs = F.aggregate(F.sequence(F.lit(0), (F.col("m") - 1).cast("int")), F.lit(0.0), lambda s, k: s + F.log(mu + alpha * (first + k)))
    summed = run.groupBy("series").agg(F.sum(logs).alias("logs"))
    ends = chunks.groupBy("series").agg(F.max("last").alias("end"), F.sum("n").alias("n"))
    left = chunks.join(ends.select("series", "end"), "series").groupBy("series").agg(F.sum(F.col("s") * F.exp(-beta * (F.col("end") - (F.col("c") + 1) * width))).alias("left"))
    return ends.join(left, "series").join(summed, "series").select(F.col("series").alias(by), "n", F.round(mu * F.col("end") + alpha / beta * (F.col("n") - F.col("left")) - F.col("logs"), 4).alias("nll"))


def fit_short(df: DataFrame, by: str, least: int) -> DataFrame:
    """(by, n, mu, branching, decay_hours) of series (series, by, t) that fit in a task: a simplex search from two starts."""
    names = [by, "n", "mu", "branching", "decay_hours"]

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        t = np.sort(group["t"].to_numpy(float))
        if len(t) < least:
            return object_frame([], names)
        t = t - t[0]
        span = max(t[-1], 1e-6)

        def nll(p: np.ndarray) -> float:
            mu, ratio, beta = np.exp(np.clip(p, -20, 20))
            if ratio >= 0.999:
                return 1e12
            gaps = np.exp(-beta * np.diff(t))
            a, logs = 0.0, math.log(mu)
            for g in gaps:
                a = (a + 1) * g
                logs += math.log(mu + ratio * beta * a)
            return mu * span + ratio * float((1 - np.exp(-beta * (span - t))).sum()) - logs

        best = min((simplex(nll, np.log([len(t) / span * share, 1 - share, beta])) for share, beta in ((0.5, 2.0), (0.8, 20.0))), key=lambda r: r[1])
        mu, ratio, beta = np.exp(best[0])
        return object_frame([(group[by].iloc[0], len(t), float(mu), float(ratio), float(24 / beta))], names)

    return df.groupBy("series").applyInPandas(fit, f"{by} string, n long, mu double, branching double, decay_hours double")


def simplex(f, start: np.ndarray, steps: int = 400, tolerance: float = 1e-6) -> tuple[np.ndarray, float]:
    """Nelder-Mead minimum of f from ``start``."""
    points = [np.array(start, float)] + [np.array(start, float) + 0.5 * np.eye(len(start))[i] for i in range(len(start))]
    values = [f(p) for p in points]
    for _ in range(steps):
        order = np.argsort(values)
        points, values = [points[i] for i in order], [values[i] for i in order]
        if abs(values[-1] - values[0]) < tolerance:
            break
        middle = np.mean(points[:-1], axis=0)
        mirrored = middle + (middle - points[-1])
        v = f(mirrored)
        if v < values[0]:
            far = middle + 2 * (middle - points[-1])
            w = f(far)
            points[-1], values[-1] = (far, w) if w < v else (mirrored, v)
        elif v < values[-2]:
            points[-1], values[-1] = mirrored, v
        else:
            near = middle + 0.5 * (points[-1] - middle)
            w = f(near)
            if w < values[-1]:
                points[-1], values[-1] = near, w
            else:
                points = [points[0]] + [points[0] + 0.5 * (p - points[0]) for p in points[1:]]
                values = [values[0]] + [f(p) for p in points[1:]]
    k = int(np.argmin(values))
    return points[k], values[k]
