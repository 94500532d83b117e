"""Connected components of an edge table by repeated min-neighbour contraction.

Each round every vertex points at its smallest neighbour, pointers are doubled twice, and the edges are rewritten
between the targets; self-loops and repeats vanish, so the edge table shrinks geometrically.  All steps are
equi-joins and map-side-combined aggregates; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lanternfish.plans.staging import discard, stage


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component): component is the smallest node reachable, itself included.

    Rows with a null end and self-loops are ignored (a vertex that appears in no other edge is absent from the
    result).  Edges are undirected; repeats do not matter.  An empty table gives an empty result.
    """
    pairs = (
        edges.select(F.col(src).alias("a"), F.col(dst).alias("b"))
        .where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct()
    )
    live = stage(pairs, "edges")
    labels = None
    while not live.isEmpty():
        both = live.select("a", "b").union(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("p"))
        first = parent = stage(parent, "parents")
        for _ in range(2):
            up = parent.select(F.col("u").alias("v"), F.col("p").alias("q"))
            parent = parent.join(up, parent["p"] == up["v"]).select("u", F.col("q").alias("p"))
        parent = stage(parent, "parents")
        discard(first)
        left = parent.select(F.col("u").alias("a"), F.col("p").alias("pa"))
        right = parent.select(F.col("u").alias("b"), F.col("p").alias("pb"))
        before = live
        live = stage(
            live.join(left, "a").join(right, "b").where(F.col("pa") != F.col("pb"))
            .select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(),
            "edges",
        )
        discard(before)
        known = labels
        if labels is None:
            labels = parent.select(F.col("u").alias("node"), F.col("p").alias("component"))
        else:
            step = parent.select(F.col("u").alias("component"), F.col("p").alias("next"))
            labels = labels.join(step, "component", "left").select("node", F.coalesce("next", "component").alias("component"))
        labels = stage(labels, "labels")
        for table in (parent, known):
            if table is not None:
                discard(table)
    if labels is None:
        labels = live.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return labels
