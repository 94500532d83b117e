"""Exact top-k search by the three-phase uniform threshold algorithm.

A vector's score is the sum of the local scores of a few nodes, each of which holds a slice of the components of all
rows and nothing else.  Phase one: every node gives its highest local scores for a query; the rows so listed are looked up,
and the k-th highest of their totals is a safe cutoff.  Phase two: the cutoff goes to the nodes, and each gives every entry
whose local score reaches cutoff / nodes: a row whose total reaches the cutoff does so in one node at least, whatever the
signs.  Phase three: for the collected entries the local scores that are still missing are resolved from the other nodes'
components, and the k highest totals kept, ties to smaller ids.  No total is computed of a row that no node gave.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from lanternfish.llm.blocks import arrays, classes, crossed, dealt, finite_vectors, found_frame, merged_best, packed, ranked, sides, top_of
from lanternfish.llm.frames import few_rows
from lanternfish.plans.staging import stage

NODES = 2
QUERY_ROWS = 4096  # tiles are copied once for each block of so many queries
AT_ONCE = 512  # queries whose scores with a tile are held
NO_CUTOFF = -(2**62)
_PAIR = ["dim", "tile", "block"]


def slices(dim: int, nodes: int) -> list[slice]:
    """The components that each node holds; there are no more nodes than components."""
    nodes = min(nodes, dim)
    return [slice(dim * j // nodes, dim * (j + 1) // nodes) for j in range(nodes)]


def _node_rows(rows: DataFrame, nodes: int) -> DataFrame:
    """(id, node, width, v): each node's slice ``v`` of every row, which is ``width`` long."""
    each = rows.select("id", F.col("v").alias("whole"), F.size("v").alias("width"), F.least(F.lit(nodes), F.size("v")).alias("n"))
    each = each.withColumn("node", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    return each.select("id", "node", "width", F.expr("slice(whole, int(width * node div n) + 1, int(width * (node + 1) div n - width * node div n))").alias("v"))


def _whole(rows: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both sides in the narrowest type in which all sums of products are exact integers."""
    bound = float(np.abs(rows).max(initial=0.0)) * float(np.abs(other).max(initial=0.0)) * rows.shape[1]
    kind = np.float32 if bound < 2**24 else np.float64 if bound < 2**53 else np.int64
    return rows.astype(kind), other.astype(kind)


def _totals(row, entries: list, nodes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query ids, ids and totals of a pair's entries: what is known of a row's local scores, and the rest resolved."""
    ids, rows, query_ids, queries = arrays(row, row.dim)
    parts = slices(row.dim, nodes)
    got_ids = [np.asarray(e["ids"], np.int64) for e in entries]
    got_queries = [np.asarray(e["queries"], np.int64) for e in entries]
    key = np.concatenate([np.searchsorted(query_ids, q) * len(ids) + np.searchsorted(ids, i) for q, i in zip(got_queries, got_ids)])
    pair, which = np.unique(key, return_inverse=True)
    known, have = np.zeros(len(pair), np.int64), np.zeros((len(parts), len(pair)), bool)
    at = 0
    for e, i in zip(entries, got_ids):
        if e["node"] >= 0:  # else a row to look up, of which nothing is known
            known[which[at : at + len(i)]] += np.asarray(e["local"], np.int64)
            have[e["node"], which[at : at + len(i)]] = True
        at += len(i)
    rows, queries = _whole(rows, queries)
    for have_node, s in zip(have, parts):
        left = np.flatnonzero(~have_node)
        for a in range(0, len(left), 1 << 16):
            p = left[a : a + (1 << 16)]
            known[p] += np.einsum("ij,ij->i", rows[pair[p] % len(ids), s], queries[pair[p] // len(ids), s]).astype(np.int64)
    return query_ids[pair // len(ids)], ids[pair % len(ids)], known


def top_products(table: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding",
                 scale: int | None = 64, nodes: int = NODES) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` highest integer inner products of each query row, exactly.

    Components become floor(scale * x) (``scale`` None: they are whole already).  ``is_query`` is a condition on the
    column ``id``.  Rows whose vector is null, empty or holds a null or non-finite component take no part; vectors of
    different lengths never meet; rows with the query's own id are no candidates.  Repeated rows and equal vectors are one
    class of candidates; query rows that share an id are answered each, by their own vectors.  Scores must fit a long.  An empty table gives an empty result.
    """
    vectors = finite_vectors(table, id_col, vec_col)
    if scale is not None:
        vectors = vectors.select("id", F.transform("v", lambda x: F.floor(F.lit(float(scale)) * x).cast("double")).alias("v"))
    reps, queries, wanted = classes(vectors, is_query, k)
    return ranked(best_classes(reps, queries, wanted, nodes), reps, queries, k)


def sent_entries(reps: DataFrame, queries: DataFrame, k: int, nodes: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Phases one and two: the entries (dim, tile, block, node, part, ids, queries, local) that the nodes give, the pairs of whole
    tiles and blocks to resolve them with, and the cutoffs (query_id, cutoff)."""
    asked, _, n_tiles, n_blocks = sides(reps, queries, query_rows=QUERY_ROWS)
    whole = stage(crossed(packed(reps, n_tiles, "tile"), packed(asked, n_blocks, "block"), n_tiles, n_blocks), "threshold-pairs")
    share = lambda rows, n, name: packed(_node_rows(rows, nodes), n, name, ("width", "node"))
    held = stage(crossed(share(reps, n_tiles, "tile"), share(asked, n_blocks, "block"), n_tiles, n_blocks, ("dim", "width", "node")), "threshold-nodes")

    def lists(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                ids, rows, query_ids, columns = arrays(row, row.dim)
                rows, columns = _whole(rows, columns)
                found = [(q, *top_of(ids, scores.astype(np.int64), k)) for a in range(0, len(columns), AT_ONCE)
                         for q, scores in zip(query_ids[a : a + AT_ONCE].tolist(), columns[a : a + AT_ONCE] @ rows.T)]
                yield found_frame(found).assign(dim=row.width, node=row.node)[["dim", "node", "query_id", "found"]]

    listed = merged_best(held.mapInPandas(lists, "dim int, node int, query_id long, found array<struct<s long, id long>>"), k, ("dim", "node", "query_id"))
    pairs = listed.select("dim", "query_id", F.explode("best.id").alias("id")).distinct()
    looked = pairs.groupBy("dim", dealt("id", n_tiles).alias("tile"), dealt("query_id", n_blocks).alias("block")).agg(
        F.array(F.struct(F.lit(-1).alias("node"), F.collect_list("id").alias("ids"), F.collect_list("query_id").alias("queries"), F.array().cast("array<long>").alias("local"))).alias("entries"))

    def totals(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                query_ids, _, sums = _totals(row, row.entries, nodes)
                yield pd.DataFrame({"query_id": query_ids, "total": sums})

    sums = whole.join(looked, _PAIR).mapInPandas(totals, "query_id long, total long")
    best = F.sort_array(F.collect_list("total"), asc=False)  # nodes times k of each query
    with few_rows(reps.sparkSession):
        cutoffs = stage(sums.groupBy("query_id").agg(best.alias("t")).select(
            "query_id", F.when(F.size("t") >= k, F.col("t")[k - 1]).otherwise(NO_CUTOFF).alias("cutoff")), "threshold-cutoffs")
    told = asked.join(cutoffs, asked["id"] == cutoffs["query_id"]).groupBy(F.size("v").alias("width"), dealt("id", n_blocks).alias("block")).agg(
        F.array_sort(F.collect_list(F.struct("id", "cutoff")))["cutoff"].alias("cutoffs"))
    told = told.withColumn("tile", F.explode(F.sequence(F.lit(0), F.lit(n_tiles - 1)))).hint("merge")  # by tile too, else a block's pairs all meet in one task

    def give(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                ids, rows, query_ids, columns = arrays(row, row.dim)
                rows, columns = _whole(rows, columns)
                least = -(-np.asarray(row.cutoffs, np.int64) // len(slices(row.width, nodes)))  # a local score is whole, so the share is rounded up
                for a in range(0, len(columns), AT_ONCE):
                    local = columns[a : a + AT_ONCE] @ rows.T
                    j, i = np.nonzero(local >= least[a : a + AT_ONCE, None].astype(local.dtype))
                    if len(i):
                        yield pd.DataFrame({"dim": [row.width], "tile": [row.tile], "block": [row.block], "node": [row.node], "part": [a // AT_ONCE], "ids": [ids[i]],
                                            "queries": [query_ids[a + j]], "local": [local[j, i].astype(np.int64)]})

    schema = "dim int, tile int, block int, node int, part int, ids array<long>, queries array<long>, local array<long>"
    with few_rows(reps.sparkSession):
        return stage(held.join(told, ["width", "tile", "block"]).mapInPandas(give, schema), "threshold-entries"), whole, cutoffs


def best_classes(reps: DataFrame, queries: DataFrame, k: int, nodes: int) -> DataFrame:
    """(query_id, best): the ``k`` best classes of every class that is asked for.

    A pair's tile and block come first, then its entries, one part of the block's queries after the other, so a task holds the
    entries of one part.
    """
    entries, whole, _ = sent_entries(reps, queries, k, nodes)
    rows = whole.withColumn("part", F.lit(-1)).unionByName(entries, allowMissingColumns=True)
    rows = rows.repartition(max(1, whole.count()), *_PAIR).sortWithinPartitions(*_PAIR, "part")

    def resolved(pair, held: list) -> pd.DataFrame:
        query_ids, ids, sums = _totals(pair, [{"node": int(e.node), "ids": e.ids, "queries": e.queries, "local": e.local} for e in held], nodes)  # in order of query
        cuts = np.flatnonzero(np.concatenate(([True], query_ids[1:] != query_ids[:-1], [True])))
        return found_frame([(int(query_ids[a]), *top_of(ids[a:b], sums[a:b], k)) for a, b in zip(cuts, cuts[1:])])

    def resolve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pair, held = None, []
        for batch in batches:
            for row in batch.itertuples(index=False):
                if held and row.part != held[0].part:
                    yield resolved(pair, held)
                    held = []
                if row.part < 0:
                    pair = row
                else:
                    held.append(row)
        if held:
            yield resolved(pair, held)

    with few_rows(reps.sparkSession):
        return stage(merged_best(rows.mapInPandas(resolve, "query_id long, found array<struct<s long, id long>>"), k), "best-of-pairs")


def op2_uniform_threshold(spark, sf_dir: str) -> DataFrame:
    """The 20 highest products of floor(64 x) for every vector whose id is divisible by 20, among all others."""
    return top_products(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("id") % 20 == 0)


OP2_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 20 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
