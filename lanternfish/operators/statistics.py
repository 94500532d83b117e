"""Statistics over grouped tables: distributions, tests and trends as aggregates; only p-value tails leave the JVM."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from lanternfish.functions.tails import chi_square_p, rank_sum_p, student_p
from lanternfish.operators.ranking import running_sum
from lanternfish.plans.staging import stage


def _p_value(tail, *parts: Column) -> Column:
    """``tail`` of a one-row result's numbers, null if one of them is."""

    @F.pandas_udf("double")
    def value(*columns: pd.Series) -> pd.Series:
        return pd.Series([None if any(v is None or v != v for v in row) else tail(*row) for row in zip(*(c.tolist() for c in columns))], dtype=float)

    return value(*[c.cast("double") for c in parts])


def gini(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Gini coefficient to four places; null where the sum is zero.  Equal values are counted once and ranked by sums."""
    counts = df.groupBy(*by, value).agg(F.count("*").alias("m"))
    ranked = running_sum(counts, value, "m", "upto", by).withColumn("before", F.col("upto") - F.col("m"))
    # ranks before+1 .. before+m share a value: their sum is m * before + m (m + 1) / 2
    part = F.col(value) * (2 * (F.col("m") * F.col("before") + F.col("m") * (F.col("m") + 1) / 2))
    sums = ranked.groupBy(*by).agg(F.sum("m").alias("n"), F.sum(F.col(value) * F.col("m")).alias("total"), F.sum(part).alias("weighted"))
    out = F.when(F.col("total") > 0, F.round((F.col("weighted") - (F.col("n") + 1) * F.col("total")) / (F.col("n") * F.col("total")), 4))
    return sums.select(*by, "n", out.alias("gini"))


def entropy(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Shannon entropy in bits, its effective number of kinds, and the number of kinds, of a value's counts."""
    counts = df.groupBy(*by, value).agg(F.count("*").alias("c"))
    sums = counts.groupBy(*by).agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.log2("c")).alias("clogc"), F.count("*").alias("kinds"))
    bits = F.log2("n") - F.col("clogc") / F.col("n")
    return sums.select(*by, "n", F.round(bits, 6).alias("bits"), F.round(F.pow(F.lit(2.0), bits), 6).alias("effective"), "kinds")


def jensen_shannon(df: DataFrame, side: str, value: str, a: str, b: str) -> DataFrame:
    """Divergence, base 2, to four places, of a value's distributions on two sides; null if a side is empty."""
    counts = df.where(F.col(side).isin(a, b)).groupBy(value).agg(F.count_if(F.col(side) == a).alias("x"), F.count_if(F.col(side) == b).alias("y"))
    totals = counts.agg(F.sum("x").alias("n"), F.sum("y").alias("m"))
    p, q = F.col("x") / F.nullif("n", F.lit(0)), F.col("y") / F.nullif("m", F.lit(0))
    mid = (p + q) / 2
    term = lambda t: F.when(t > 0, t * F.log2(t / mid)).otherwise(0.0)
    return counts.crossJoin(F.broadcast(totals)).agg(  # one row of totals
        F.when((F.max("n") > 0) & (F.max("m") > 0), F.round(F.sum((term(p) + term(q)) / 2), 4)).alias("jsd"))


def power_law(df: DataFrame, value: str, candidates: int = 30, least: int = 10) -> DataFrame:
    """(xmin, alpha, ks, tail): the best discrete power-law tail by the KS distance over the first distinct values."""
    counts = df.where(F.col(value) >= 1).groupBy(F.col(value).cast("double").alias("x")).agg(F.count("*").alias("m"))
    summed = running_sum(counts, "x", "m", "upto")
    minima = summed.orderBy("x").limit(candidates).select(F.col("x").alias("xmin"), (F.col("upto") - F.col("m")).alias("below"))
    tails = stage(summed.crossJoin(F.broadcast(minima)).where(F.col("x") >= F.col("xmin")).withColumn("upto", F.col("upto") - F.col("below")), "tails")  # at most ``candidates`` rows beside each value
    fits = tails.groupBy("xmin").agg(F.sum("m").alias("tail"), F.sum(F.col("m") * F.log(F.col("x") / (F.col("xmin") - 0.5))).alias("logs")).where(F.col("tail") >= least)
    fits = fits.withColumn("alpha", 1 + F.col("tail") / F.col("logs"))
    steps = tails.join(F.broadcast(fits), "xmin")
    model = 1 - F.pow(F.col("x") / F.col("xmin"), 1 - F.col("alpha"))
    first = F.abs((F.col("upto") - F.col("m") + 1) / F.col("tail") - model)
    last = F.abs(F.col("upto") / F.col("tail") - model)
    scored = steps.groupBy("xmin", "alpha", "tail").agg(F.max(F.greatest(first, last)).alias("ks"))
    return scored.orderBy(F.round("ks", 9), "xmin").limit(1).select("xmin", F.round("alpha", 4).alias("alpha"), F.round("ks", 4).alias("ks"), "tail")


def average_ranks(counts: DataFrame, value: str, ties: str) -> DataFrame:
    """``counts`` (distinct values with the number of rows of each, ``ties``) with ``rank``: the mean of the ranks that equal
    values take.  Rows are counted before they get here, so a value that most rows share is one row."""
    return running_sum(counts, value, ties, "__upto").withColumn("rank", F.col("__upto") - F.col(ties) + (F.col(ties) + 1) / 2).drop("__upto")


def exact_quantiles(df: DataFrame, by: Sequence[str], value: str, shares: dict[str, float]) -> DataFrame:
    """(by, shares' names): exact quantiles of each group, between neighbours as percentiles are, from running counts of
    distinct values; nulls are left out, and no task holds a group."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("__x")).agg(F.count("*").alias("__m"))
    run = running_sum(counts, "__x", "__m", "__upto", by)
    if by:
        totals = run.groupBy(*by).agg(F.max("__upto").alias("__n"))
        keyed = lambda t: t.withColumn("__key", F.to_json(F.struct(*by)))  # noqa: E731  so that null groups meet too
        run = keyed(run).join(keyed(totals).select("__key", "__n"), "__key")
    else:
        run = run.crossJoin(F.broadcast(run.agg(F.max("__upto").alias("__n"))))  # one row
    out = []
    for name, share in shares.items():
        place = share * (F.col("__n") - 1)
        low = F.min(F.when(F.col("__upto") > F.floor(place), F.col("__x")))
        high = F.min(F.when(F.col("__upto") > F.ceil(place), F.col("__x")))
        out.append((low + (high - low) * F.first(place - F.floor(place))).alias(name))
    return run.groupBy(*by).agg(*out)


def mann_whitney(df: DataFrame, side: str, value: str, a: str, b: str) -> DataFrame:
    """(n_a, n_b, u, superiority, p): U of side a with its two-sided p-value; null statistics where a side has fewer than
    five values."""
    counts = df.where(F.col(side).isin(a, b) & F.col(value).isNotNull()).groupBy(value).agg(
        F.count_if(F.col(side) == a).alias("a"), F.count_if(F.col(side) == b).alias("b"), F.count("*").alias("m"))
    m = F.col("m").cast("double")
    s = average_ranks(counts, value, "m").agg(F.coalesce(F.sum("a"), F.lit(0)).alias("n_a"), F.coalesce(F.sum("b"), F.lit(0)).alias("n_b"),
                                              F.sum(F.col("a") * F.col("rank")).alias("r"), F.sum(m * (m * m - 1)).alias("ties"))
    u = F.col("r") - F.col("n_a") * (F.col("n_a") + 1) / 2
    enough = (F.col("n_a") >= 5) & (F.col("n_b") >= 5)
    s = s.withColumn("u", F.when(enough, u))
    p = _p_value(lambda u, n, m, t: rank_sum_p(u, int(n), int(m), t), F.col("u"), F.col("n_a"), F.col("n_b"), F.col("ties"))
    return s.select("n_a", "n_b", F.round("u", 3).alias("u"), F.round(F.col("u") / (F.col("n_a") * F.col("n_b")), 6).alias("superiority"), p.alias("p"))


def kruskal(df: DataFrame, group: str, value: str, least: int = 5) -> DataFrame:
    """(h, groups, n, p): tie-corrected statistic over groups of at least ``least`` values; null for fewer than two groups
    or if all values are equal."""
    cells = df.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("c"))
    kept = cells.groupBy(group).agg(F.sum("c").alias("size")).where(F.col("size") >= least).select(group)
    cells = stage(cells.join(kept, group, "left_semi"), "rank-cells")
    ranks = average_ranks(cells.groupBy(value).agg(F.sum("c").alias("m")), value, "m")
    m = F.col("m").cast("double")
    each = cells.join(ranks, value).groupBy(group).agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("rank")).alias("r"), F.sum(F.col("c") * (m * m - 1)).alias("t"))
    sums = each.agg(F.sum("n").alias("n"), F.count("*").alias("groups"), F.sum(F.col("r") * F.col("r") / F.col("n")).alias("s"), F.sum("t").alias("ties"))
    n = F.col("n").cast("double")
    h = F.try_divide(12 / (n * (n + 1)) * F.col("s") - 3 * (n + 1), 1 - F.col("ties") / (n * n * n - n))
    s = sums.select(F.when(F.col("groups") >= 2, h).alias("h"), "groups", "n")
    p = _p_value(lambda h, k: chi_square_p(h, int(k) - 1), F.col("h"), F.col("groups"))
    return s.select(F.round("h", 6).alias("h"), "groups", "n", p.alias("p"))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """(n, rho, p): rank correlation with its two-sided p-value; null for fewer than ten pairs or a side of equal values."""
    pairs = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).alias("x"), F.col(y).alias("y"))
    counts = pairs.groupBy("x", "y").agg(F.count("*").alias("m"))
    rank = lambda c: running_sum(pairs.groupBy(c).agg(F.count("*").alias("k")), c, "k", "upto").select(c, (F.col("upto") - F.col("k") + (F.col("k") + 1) / 2).alias(f"r{c}"))
    both = counts.join(rank("x"), "x").join(rank("y"), "y")
    m, a, b = F.col("m"), F.col("rx"), F.col("ry")
    s = both.agg(F.sum("m").alias("n"), F.sum(m * a).alias("sa"), F.sum(m * b).alias("sb"), F.sum(m * a * a).alias("saa"), F.sum(m * b * b).alias("sbb"), F.sum(m * a * b).alias("sab"))
    n = F.col("n")
    rho = F.try_divide(n * F.col("sab") - F.col("sa") * F.col("sb"), F.sqrt((n * F.col("saa") - F.col("sa") * F.col("sa")) * (n * F.col("sbb") - F.col("sb") * F.col("sb"))))
    s = s.select("n", F.when(n >= 10, rho).alias("rho"))
    p = _p_value(lambda r, n: 0.0 if abs(r) >= 1 else student_p(r * math.sqrt((n - 2) / ((1 - r) * (1 + r))), n - 2), F.col("rho"), F.col("n"))
    return s.select("n", F.round("rho", 6).alias("rho"), p.alias("p"))


def chi_square(df: DataFrame, row: str, column: str, a: str, b: str) -> DataFrame:
    """(chi2, dof, n, p) of two rows against all columns; Yates' correction for one degree of freedom; null if not testable."""
    cells = df.where(F.col(row).isin(a, b)).groupBy(column).agg(F.count_if(F.col(row) == a).cast("double").alias("x"), F.count_if(F.col(row) == b).cast("double").alias("y"))
    totals = cells.agg(F.sum("x").alias("n"), F.sum("y").alias("m"), F.count("*").alias("k"))
    each = cells.crossJoin(F.broadcast(totals))  # one row of totals
    size = F.col("n") + F.col("m")
    ex, ey = (F.col("x") + F.col("y")) * F.col("n") / size, (F.col("x") + F.col("y")) * F.col("m") / size
    yates = lambda o, e: F.when(F.col("k") == 2, F.greatest(F.abs(o - e) - F.least(F.lit(0.5), F.abs(o - e)), F.lit(0.0))).otherwise(F.abs(o - e))
    part = F.try_divide(F.pow(yates(F.col("x"), ex), F.lit(2.0)), ex) + F.try_divide(F.pow(yates(F.col("y"), ey), F.lit(2.0)), ey)
    good = (F.max("k") >= 2) & (F.max("n") > 0) & (F.max("m") > 0)
    s = each.agg(F.when(good, F.sum(part)).alias("chi2"), (F.max("k") - 1).alias("dof"), F.max(size).cast("long").alias("n"))
    p = _p_value(lambda x, dof: chi_square_p(x, int(dof)), F.col("chi2"), F.col("dof"))
    return s.select(F.round("chi2", 6).alias("chi2"), "dof", "n", p.alias("p"))


def rayleigh(df: DataFrame, hour: str, by: Sequence[str] = (), least: int = 10) -> DataFrame:
    """Mean resultant length, z, p and peak hour of times of day; null for fewer than ``least`` of them."""
    angle = F.col(hour) * (2 * math.pi / 24)
    s = df.where(F.col(hour).isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), F.avg(F.cos(angle)).alias("c"), F.avg(F.sin(angle)).alias("s"))
    r = F.sqrt(F.col("c") * F.col("c") + F.col("s") * F.col("s"))
    z = F.col("n") * r * r
    p = F.least(F.lit(1.0), F.exp(-z) * (1 + (2 * z - z * z) / (4 * F.col("n")) - (24 * z - 132 * z * z + 76 * F.pow(z, F.lit(3.0)) - 9 * F.pow(z, F.lit(4.0))) / (288 * F.col("n") * F.col("n"))))
    peak = F.pmod(F.atan2("s", "c") * (24 / (2 * math.pi)), F.lit(24.0))
    ok = lambda x, d: F.when(F.col("n") >= least, F.round(x, d))
    return s.select(*by, "n", ok(r, 6).alias("r"), ok(z, 4).alias("z"), ok(p, 6).alias("p"), ok(peak, 4).alias("peak_hour"))


def logit_trend(months: DataFrame, k: str, n: str, order: str, least: int = 20) -> DataFrame:
    """(months, slope, se, odds_year): weighted logit regression of shares on the running number of months with enough rows."""
    used = months.where(F.col(n) >= least).withColumn("x", (F.row_number().over(Window.orderBy(order)) - 1).cast("double"))
    p = (F.col(k) + 0.5) / (F.col(n) + 1)
    used = used.withColumn("w", F.col(n) * p * (1 - p)).withColumn("y", F.log(p / (1 - p)))
    w, x, y = F.col("w"), F.col("x"), F.col("y")
    s = used.agg(F.count("*").alias("months"), F.sum(w).alias("sw"), F.sum(w * x).alias("sx"), F.sum(w * y).alias("sy"), F.sum(w * x * x).alias("sxx"), F.sum(w * x * y).alias("sxy"))
    d = F.col("sw") * F.col("sxx") - F.col("sx") * F.col("sx")
    slope = (F.col("sw") * F.col("sxy") - F.col("sx") * F.col("sy")) / d
    ok = lambda v: F.when(F.col("months") >= 4, F.round(v, 6))
    return s.select("months", ok(slope).alias("slope"), ok(F.sqrt(F.col("sw") / d)).alias("se"), ok(F.exp(12 * slope)).alias("odds_year"))


def binomial_tail(k: Column, n: Column) -> Column:
    """P(X <= k) of n fair coins: each term follows from the one before, in logarithms, so a row takes k steps; null k or n
    gives null."""
    put = lambda term, total: F.struct(term.alias("term"), total.alias("total"))
    none = -n * math.log(2)
    step = lambda s, j: put(s["term"] + F.log((n - j + 1) / j), s["total"] + F.exp(s["term"] + F.log((n - j + 1) / j)))
    more = F.aggregate(F.sequence(F.lit(1), k), put(none, F.exp(none)), step, lambda s: s["total"])
    return F.when(k < 0, 0.0).when(k == 0, F.exp(none)).otherwise(more)


def binomial_test(k: Column, n: Column) -> Column:
    """Exact two-sided p-value against one half: twice the smaller tail, one at most; null where n is 0."""
    low = F.least(k, n - k).cast("int")
    return F.when(n > 0, F.round(F.least(F.lit(1.0), 2 * binomial_tail(low, n.cast("int"))), 6))


def beta_posterior(k: Column, n: Column) -> Column:
    """P(share > 1/2) under a uniform prior: P(X <= k) of n + 1 fair coins; null where n is 0."""
    return F.when(n > 0, F.round(binomial_tail(k.cast("int"), (n + 1).cast("int")), 6))


def middle_draws(n: int, resamples: int, seed: int) -> np.ndarray:
    """Ranks (resamples x 2, from 1) of the two middle values of n draws with replacement from n values in order.

    The middle ones of n uniform draws follow beta distributions; where they fall, the value's rank is read off.
    """
    rng = np.random.default_rng(seed)
    low = (n + 1) // 2
    u = rng.beta(low, n - low + 1, resamples)
    v = u if n % 2 else u + (1 - u) * rng.beta(1, n - low, resamples)
    return np.clip(np.ceil(np.column_stack([u, v]) * n), 1, n).astype(np.int64)


def bootstrap_interval(df: DataFrame, by: str, value: str, statistic: str = "median", resamples: int = 2000, seed: int = 7) -> DataFrame:
    """(by, n, low, high): 95 % percentile interval of the median or mean by resampling, null under three values.

    For the median, the ranks of each resample's middle values are drawn at once from their own distribution and looked up in
    the running counts of distinct values.  For the mean, every distinct value is drawn a Poisson number of times in each
    resample and the tasks' sums are added.  Either way a group sends a few thousand numbers, whatever its size.
    """
    sized = df.where(F.col(value).isNotNull()).select(F.col(by), F.col(value).cast("double").alias("x"))
    hist = stage(sized.groupBy(by, "x").agg(F.count("*").alias("m")), "bootstrap-values")
    sizes = hist.groupBy(by).agg(F.sum("m").alias("n"))

    def medians(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, draws = None, None
        for batch in batches:
            for (group, n), rows in batch.groupby([by, "n"], dropna=False):
                if (group, n) != last:
                    last, draws = (group, n), middle_draws(int(n), resamples, seed)
                rows = rows.sort_values("x")
                upto, m = rows["upto"].to_numpy(), rows["m"].to_numpy()
                at = np.minimum(np.searchsorted(upto, draws), len(upto) - 1)  # rows of a batch may lack some of the ranks
                hit = (draws <= upto[at]) & (draws > upto[at] - m[at])
                i, side = np.nonzero(hit)
                yield pd.DataFrame({by: group, "i": i, "a": rows["x"].to_numpy()[at[i, side]] / 2, "b": 1.0})

    def means(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rng = np.random.default_rng([seed, TaskContext.get().partitionId()])
        for batch in batches:
            for group, rows in batch.groupby(by, dropna=False):
                total, count = np.zeros(resamples), np.zeros(resamples)
                for at in range(0, len(rows), 500):
                    x, m = rows["x"].to_numpy()[at : at + 500], rows["m"].to_numpy()[at : at + 500]
                    drawn = rng.poisson(m[:, None], (len(m), resamples))
                    total, count = total + x @ drawn, count + drawn.sum(axis=0)
                yield pd.DataFrame({by: group, "i": range(resamples), "a": total, "b": count})

    if statistic == "median":
        ranked = running_sum(hist, "x", "m", "upto", [by]).join(sizes.where("n >= 3"), by)
        drawn = ranked.select(by, "n", "x", "m", F.col("upto").cast("long").alias("upto")).mapInPandas(medians, f"{by} string, i int, a double, b double")
        stat = F.sum("a")
    else:
        drawn = hist.mapInPandas(means, f"{by} string, i int, a double, b double")
        stat = F.try_divide(F.sum("a"), F.sum("b"))
    each = drawn.groupBy(by, "i").agg(stat.alias("s"))
    ends = each.groupBy(by).agg(F.percentile("s", F.array(F.lit(0.025), F.lit(0.975))).alias("q"))  # ``resamples`` numbers a group
    enough = F.col("n") >= 3
    return sizes.join(ends, by, "left").select(by, "n", F.when(enough, F.round(F.col("q")[0], 3)).alias("low"), F.when(enough, F.round(F.col("q")[1], 3)).alias("high"))
