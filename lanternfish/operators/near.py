"""Near-duplicate families over 64-bit perceptual hashes."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from lanternfish.functions.columns import hamming
from lanternfish.operators.components import connected_components
from lanternfish.operators.relational import hot_join
from lanternfish.plans.staging import discard, stage

BITS = 64


def _cuts(bands: int) -> list[tuple[int, int]]:
    return [(BITS * k // bands, BITS * (k + 1) // bands) for k in range(bands)]


def _slice(h: Column, cut: tuple[int, int]) -> Column:
    return F.shiftrightunsigned(h, cut[0]).bitwiseAND(F.lit((1 << (cut[1] - cut[0])) - 1))


def near_slices(hashes: DataFrame, h: str, bands: int, flips: int, mask: str) -> DataFrame:
    """(h, band, slice, mask): each of ``bands`` slices of the hash, and its neighbours of up to ``flips`` other bits, with the
    bits that were flipped."""
    def around(band: int, cut: tuple[int, int]) -> Column:
        masks = [sum(1 << i for i in some) for n in range(flips + 1) for some in combinations(range(cut[1] - cut[0]), n)]
        return F.transform(F.lit(masks).cast("array<long>"), lambda m: F.struct(F.lit(band).alias("band"), _slice(F.col(h), cut).bitwiseXOR(m).alias("slice"), m.alias(mask)))

    each = [around(k, cut) for k, cut in enumerate(_cuts(bands))]
    return hashes.select(h, F.explode(F.flatten(F.array(*each))).alias("e")).select(h, "e.*")


def bands_for(rows: int, radius: int) -> int:
    """The number of slices with the least work for so many random hashes: rows listed on both sides, and pairs that meet.

    Fewer, longer slices list more neighbours and meet by chance less often, so the work grows more slowly than the square.
    """
    def work(bands: int) -> float:
        flips, width = radius // bands, BITS // bands
        around = lambda n: sum(math.comb(width, k) for k in range(n + 1))
        listed = bands * (around(flips - flips // 2) + around(flips // 2))
        return 2 * rows * listed + rows * rows / 2 * bands * around(flips) / 2.0**width

    return min(range(2, max(3, radius + 2)), key=work)


def hamming_pairs(df: DataFrame, h: str, radius: int, bands: int | None = None) -> DataFrame:
    """(a, b, distance) of all pairs of distinct hash values a < b within the radius; equal hashes are collapsed first.

    Of so many slices one at least differs in no more than its share of the radius.  Both sides list the neighbours of their
    slices up to half of that, so the theta join becomes an equi-join on long slices and loses no pair.  A pair counts in its first
    such slice only, and there for one way to share the differing bits between both sides, so nothing is listed twice.
    """
    distinct = df.select(F.col(h).alias("h")).where("h IS NOT NULL").distinct()
    bands = bands or bands_for(distinct.count(), radius)
    flips = radius // bands
    left = near_slices(distinct.withColumnRenamed("h", "a"), "a", bands, flips - flips // 2, "ma")
    right = near_slices(distinct.withColumnRenamed("h", "b"), "b", bands, flips // 2, "mb")
    a, b, ma, mb = F.col("a"), F.col("b"), F.col("ma"), F.col("mb")
    lowest = mb.bitwiseAND(-mb)  # the left side flips the lower of the differing bits
    once = (mb == 0) | ((F.bit_count(ma) == flips - flips // 2) & (ma < lowest))
    apart = [F.bit_count(_slice(a.bitwiseXOR(b), cut)) <= flips for cut in _cuts(bands)]
    first = F.lit(True)
    for k in range(1, bands):
        earlier = apart[0]
        for other in apart[1:k]:
            earlier = earlier | other
        first = first & ((F.col("band") != k) | ~earlier)
    right = right.hint("merge")  # planned by the size of the hashes, of which each is listed many times, a side would be broadcast
    near = left.join(right, ["band", "slice"]).where((a < b) & (hamming(a, b) <= radius) & once & first)
    return near.select("a", "b", hamming(a, b).alias("distance"))


def families(df: DataFrame, h: str, radius: int) -> DataFrame:
    """(hash, family): connected components of the pairs within the radius; family is the least hash."""
    distinct = df.select(F.col(h).alias("h")).where("h IS NOT NULL").distinct()
    groups = connected_components(hamming_pairs(df, h, radius), "a", "b")
    return distinct.join(groups, distinct["h"] == groups["node"], "left").select(F.col("h").alias("hash"), F.coalesce("component", "h").alias("family"))


def _doubled(single: DataFrame) -> DataFrame:
    """Pointers (node, to, odd) led to where they end, from each node's only open neighbour (node, to): ``odd`` is whether the
    number of steps is odd.  Each round doubles the steps, so a chain of any length takes a logarithm of rounds."""
    pointers = stage(single.withColumn("odd", F.lit(True)), "fold-pointers")
    while True:
        ahead = pointers.select(F.col("node").alias("to"), F.col("to").alias("next"), F.col("odd").alias("more"))
        moved = stage(pointers.join(ahead, "to", "left").select(
            "node", F.coalesce("next", "to").alias("to"), F.when(F.col("next").isNull(), F.col("odd")).otherwise(F.col("odd") != F.col("more")).alias("odd"),
            F.col("next").isNotNull().alias("on")), "fold-pointers")
        discard(pointers)
        pointers = moved
        if pointers.where("on").isEmpty():
            return pointers.select("node", "to", "odd")


def leading(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node) of those that lead: ``edges`` (node, earlier) name each node's near ones that come before it, and a node leads if
    none of them does.

    Settled in rounds by joins alone.  A node without open neighbours leads, and nodes beside it follow.  A node with one open
    neighbour does the opposite of it, whatever that will be: such chains are followed to their ends by doubling.  Rounds are few
    where order has nothing to do with nearness (a logarithm of the rows, as is known of the greedy independent set).
    """
    open_edges = stage(edges.select("node", "earlier").distinct(), "fold-edges")
    undecided = stage(nodes.select("node").distinct(), "fold-open")
    leaders = []
    while not undecided.isEmpty():
        free = undecided.join(open_edges.select("node").distinct(), "node", "left_anti")
        single = open_edges.groupBy("node").agg(F.count("*").alias("n"), F.min("earlier").alias("to")).where("n = 1").select("node", "to")
        decided = free.withColumn("leads", F.lit(True))
        if not single.isEmpty():
            ends = _doubled(single)
            known = ends.join(free.select(F.col("node").alias("to")), "to").select("node", (~F.col("odd")).alias("leads"))
            decided = decided.unionByName(known)
        decided = stage(decided, "fold-decided")
        beside = open_edges.join(decided.where("leads").select(F.col("node").alias("earlier")), "earlier").select("node").distinct()
        settled = stage(decided.select("node").union(beside).distinct(), "fold-settled")
        leaders.append(decided.where("leads").select("node"))
        left = stage(undecided.join(settled, "node", "left_anti"), "fold-open")
        rest = stage(open_edges.join(settled, "node", "left_anti").join(settled.select(F.col("node").alias("earlier")), "earlier", "left_anti").select("node", "earlier"), "fold-edges")
        for old in (undecided, open_edges, settled):
            discard(old)
        undecided, open_edges = left, rest
    return reduce(DataFrame.union, leaders) if leaders else undecided


def leader_fold(df: DataFrame, key: str, h: str, order: str, radius: int) -> DataFrame:
    """(key, leader): rows in order join the first leader within the radius, or lead themselves.

    Not transitive.  Rows stand in order of ``order`` and key; rows of one hash share the leader of the first of them; rows with a
    null hash are left out.  The near pairs are one table, and leaders are settled on it side by side (``leading``), so a
    family of any size is spread over tasks.
    """
    rows = df.select(F.col(key).alias("key"), F.col(h).alias("h"), F.col(order).alias("at")).where("h IS NOT NULL")
    firsts = stage(rows.groupBy("h").agg(F.min(F.struct("at", "key")).alias("first")), "fold-firsts")
    place = lambda name: firsts.select(F.col("h").alias(name), F.col("first").alias(f"{name}_at"))
    pairs = hamming_pairs(firsts, "h", radius).select("a", "b").join(place("a"), "a").join(place("b"), "b")
    swap = F.col("a_at") < F.col("b_at")
    near = stage(pairs.select(F.when(swap, F.col("b")).otherwise(F.col("a")).alias("node"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("earlier")), "fold-near")
    lead = stage(leading(firsts.select(F.col("h").alias("node")), near), "fold-leaders")
    named = lead.join(firsts, lead["node"] == firsts["h"]).select(F.col("node").alias("earlier"), "first")
    following = near.join(lead, "node", "left_anti").join(named, "earlier").groupBy("node").agg(F.min("first").alias("first"))
    folded = named.select(F.col("earlier").alias("h"), F.col("first.key").alias("leader")).union(following.select("node", "first.key"))
    return hot_join(rows, folded, "h").select(F.col("key").alias(key), "leader")


def text_simhash(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, h): 64-bit similarity hash of a text's words, a stand-in for a picture's perceptual hash: a bit is set if more
    than half of the words have it in their first 64 digest bits.  Each distinct word of a batch is digested once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            split = [(t or "").split() for t in batch["t"]]
            number: dict[str, int] = {}
            at = [np.array([number.setdefault(w, len(number)) for w in words], int) for words in split]
            digests = np.frombuffer(b"".join(hashlib.md5(w.encode("utf-8", "surrogatepass")).digest()[:8] for w in number), np.uint8).reshape(-1, 8)
            bits = np.unpackbits(digests, axis=1)
            votes = [bits[a].sum(axis=0, dtype=np.int64) for a in at]
            yield pd.DataFrame({"k": batch["k"], "h": [int(np.packbits(2 * v > len(a)).view(">i8")[0]) for v, a in zip(votes, at)]})

    return df.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInPandas(run, "k long, h long").withColumnRenamed("k", key)
