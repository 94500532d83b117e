"""A stated query set against all vectors, in blocks: tiles of rows meet blocks of queries, never rows one by one.

Equal vectors are one class, which stands for its smallest ids, so that copies neither take each other's places nor
gather anywhere: only classes are searched, and the winners are spelled out at the end.  Results are a row's own: query rows that
share an id or a vector are answered each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from lanternfish.plans.staging import stage

TILE_ROWS = 8192
QUERY_ROWS = 1024


def finite_vectors(table: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v array<double>) of the rows whose vector is not null or empty and has only finite components."""
    v = F.col(vec_col).cast("array<double>")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return table.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(
        F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & ~F.exists("v", bad))


def classes(vectors: DataFrame, is_query: Column, k: int) -> tuple[DataFrame, DataFrame, int]:
    """The classes of equal vectors (id, v, members), the class of every query row (query_id, class_id), and how many classes
    must be found for each so that ``k`` rows of other ids are among their members.

    A class is named by a number of its own, in order of its smallest id, so an id that occurs with two vectors is in two
    classes.  Its members are its smallest ids, at most 2 ``k`` and each at most ``k`` times, which leaves ``k`` of other ids than any query's.
    Ranks are cut in the tasks before anything is shuffled, so a class of a third of all rows sends a few ids a task.
    """
    flat = vectors.select("id", F.transform("v", lambda x: x + 0.0).alias("v"))  # no negative zeros
    repeats = flat.groupBy("id").count().agg(F.coalesce(F.max("count"), F.lit(1))).first()[0]
    if repeats > k:
        flat = flat.withColumn("again", F.row_number().over(Window.partitionBy("v", "id").orderBy("id"))).where(F.col("again") <= k)
    first = flat.withColumn("place", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("place") <= k + min(k, repeats))
    known = first.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("members"))
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    low = F.col("members")[0]
    placed = stage(known, "vector-members").repartitionByRange(parts, low, F.xxhash64("v")).sortWithinPartitions(low, F.xxhash64("v"))
    reps = stage(placed.select(F.monotonically_increasing_id().alias("id"), "v", "members"), "vector-classes")  # written, so that numbers stay
    asked = vectors.select("id", F.transform("v", lambda x: x + 0.0).alias("v")).where(is_query).select(F.col("id").alias("query_id"), "v")
    queries = stage(asked.join(reps.select(F.col("id").alias("class_id"), "v"), "v").select("query_id", "class_id"), "vector-queries")
    if repeats == 1:
        return reps, queries, k + 1
    own = queries.distinct().groupBy("query_id").count()  # the classes of each query's id
    return reps, queries, k + own.agg(F.coalesce(F.max("count"), F.lit(1))).first()[0]


def dealt(key: str, parts: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")


def packed(rows: DataFrame, parts: int, name: str, also: tuple[str, ...] = ()) -> DataFrame:
    """Rows (id, v) dealt by hash of the id into ``parts`` groups for each dimension (and ``also``), as parallel arrays."""
    return (
        rows.groupBy(F.size("v").alias("dim"), *also, dealt("id", parts).alias(name)).agg(F.array_sort(F.collect_list(F.struct("id", "v"))).alias("rows"))
        .select("dim", *also, name, F.col("rows.id").alias(f"{name}_ids"), F.flatten("rows.v").alias(f"{name}_flat"))
    )


def sides(reps: DataFrame, queries: DataFrame, tile_rows: int = TILE_ROWS, query_rows: int = QUERY_ROWS) -> tuple[DataFrame, int, int, int]:
    """The classes that are asked for, the number of classes, and the numbers of tiles and of query blocks they are dealt into."""
    asked = reps.join(queries.select(F.col("class_id").alias("id")).distinct(), "id", "left_semi")
    n, n_asked = reps.count(), asked.count()
    return asked, n, max(1, -(-n // tile_rows)), max(1, -(-n_asked // query_rows))


def crossed(tiles: DataFrame, blocks: DataFrame, n_tiles: int, n_blocks: int, on: tuple[str, ...] = ("dim",)) -> DataFrame:
    """Every tile of rows beside every block of queries of the same dimension.

    Both sides are arrays of bounded size.  A pair's work is one task's; tiles are copied once for each query block.
    """
    left = tiles.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    return left.join(blocks, [*on, "block"]).repartition(n_tiles * n_blocks, *on, "tile", "block")


def arrays(row, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids and matrix of a pair's tile and of its block."""
    whole = lambda x: np.asarray(x, np.float64).reshape(-1, dim)
    return np.asarray(row.tile_ids, np.int64), whole(row.tile_flat), np.asarray(row.block_ids, np.int64), whole(row.block_flat)


def found_frame(found: list[tuple[int, np.ndarray, np.ndarray]]) -> pd.DataFrame:
    """(query id, ids, scores) as rows of (query_id, found)."""
    return pd.DataFrame({"query_id": [q for q, _, _ in found], "found": [[{"s": s, "id": i} for s, i in zip(sc.tolist(), ii.tolist())] for _, ii, sc in found]})


def best_first(entries: Column) -> Column:
    """Entries (s, id), largest score first, ties to smaller ids."""
    return F.array_sort(entries, lambda a, b: F.when(a["s"] > b["s"], -1).when(a["s"] < b["s"], 1).when(a["id"] < b["id"], -1).when(a["id"] > b["id"], 1).otherwise(0))


def merged_best(rows: DataFrame, k: int, by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """(by, best): the ``k`` best entries of each query's lists (found), of which every tile sends one of bounded length."""
    return rows.groupBy(*by).agg(F.slice(best_first(F.flatten(F.collect_list("found"))), 1, k).alias("best"))


Kernel = Callable[[object], Iterator[tuple[int, np.ndarray, np.ndarray]]]


def best_of_pairs(pairs: DataFrame, kernel: Kernel, k: int, score_type: str) -> DataFrame:
    """(query_id, best): ``kernel`` yields (query id, ids, scores) with at most ``k`` entries for each pair."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                found = list(kernel(row))
                if found:
                    yield found_frame(found)

    return stage(merged_best(pairs.mapInPandas(run, f"query_id long, found array<struct<s {score_type}, id long>>"), k), "best-of-pairs")


def ranked(best: DataFrame, reps: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score) of every query row, ranks from 1, from the best classes (query_id, best) of its class."""
    each = best.select(F.col("query_id").alias("class_id"), F.explode("best").alias("b"))
    spelled = each.join(reps.select(F.col("id").alias("rep"), "members"), F.col("b.id") == F.col("rep")).select(
        "class_id", F.transform("members", lambda m: F.struct(F.col("b.s").alias("s"), m.alias("id"))).alias("found"))
    own = merged_best(spelled, 2 * k, ("class_id",)).join(queries, "class_id").select(
        "query_id", F.posexplode(F.slice(F.filter("best", lambda e: e["id"] != F.col("query_id")), 1, k)).alias("pos", "b"))
    return own.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("b.id").alias("vec_id"), F.col("b.s").alias("score"))


def top_of(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` best, best first, ties to smaller ids."""
    if len(ids) > 4 * k:
        keep = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
        ids, scores = ids[keep], scores[keep]
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]
