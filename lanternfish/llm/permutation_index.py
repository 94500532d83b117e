"""Approximate nearest neighbours by a permutation index.

Pivots are drawn from a bounded sample.  A vector is represented by the order of its ``prefix`` nearest pivots and
posted in those pivots' inverted files with its weight (prefix minus rank).  The files are written once, for a tile of rows at
a time.  A query goes through the files of its own nearest pivots: the footrule distance of two truncated orders is a
constant less twice the sum, over common pivots, of the smaller weight, so candidates are ranked by that sum.  The best of
them are reranked by the exact inner product.  Equal vectors are one candidate, so that copies take no others' places.
Largest inner product becomes nearest neighbour by the usual lift: rows are scaled by the largest norm and given one
more component that makes them unit; queries are made unit.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from lanternfish.llm.blocks import arrays, best_of_pairs, classes, crossed, finite_vectors, packed, ranked, sides, top_of
from lanternfish.plans.staging import stage

PIVOTS, PREFIX, SAMPLE = 256, 96, 4096


def lift(rows: np.ndarray, largest: float) -> np.ndarray:
    scaled = rows / largest
    return np.column_stack([scaled, np.sqrt(np.maximum(0.0, 1.0 - (scaled * scaled).sum(axis=1)))])


@dataclass
class Files:
    """The pivots' inverted files of a tile: of pivot p the postings start[p] to start[p + 1], rows ascending, and their weights."""

    start: np.ndarray
    rows: np.ndarray
    weights: np.ndarray

    @classmethod
    def of(cls, points: np.ndarray, pivots: np.ndarray, prefix: int) -> Files:
        near = np.argsort(-(points @ pivots.T), axis=1, kind="stable")[:, :prefix]
        order = np.argsort(near.reshape(-1), kind="stable")
        weights = np.tile(np.arange(prefix, 0, -1, dtype=np.uint8), len(points))
        return cls(np.searchsorted(near.reshape(-1)[order], np.arange(len(pivots) + 1)), (order // prefix).astype(np.uint16), weights[order])

    def dump(self) -> bytes:
        return b"".join(a.tobytes() for a in (self.start.astype(np.int64), self.rows, self.weights))

    @classmethod
    def load(cls, data: bytes, pivots: int) -> Files:
        head = 8 * (pivots + 1)
        n = (len(data) - head) // 3
        return cls(np.frombuffer(data, np.int64, pivots + 1), np.frombuffer(data, np.uint16, n, head), np.frombuffer(data, np.uint8, n, head + 2 * n))

    def common(self, pivots: np.ndarray, size: int) -> np.ndarray:
        """Of each row of the tile the sum, over the pivots it shares with ``pivots`` (nearest first), of the smaller weight."""
        out = np.zeros(size, np.uint32)
        for rank, p in enumerate(pivots.tolist()):
            a, b = self.start[p], self.start[p + 1]
            out[self.rows[a:b]] += np.minimum(self.weights[a:b], np.uint8(len(pivots) - rank))  # a row is posted once in a file
        return out

    def touched(self, pivots: np.ndarray) -> int:
        """Postings read for these pivots."""
        return int((self.start[pivots + 1] - self.start[pivots]).sum())


def choose_pivots(vectors: DataFrame, pivots: int = PIVOTS, sample: int = SAMPLE) -> dict[int, np.ndarray]:
    """For each dimension at most ``pivots`` distinct rows, spread over the ``sample`` rows of smallest hash (the bound)."""
    drawn = vectors.select(F.size("v").alias("dim"), "v").orderBy(F.xxhash64("v", "id")).limit(sample).collect()
    by: dict[int, list] = {}
    for r in drawn:
        by.setdefault(r["dim"], []).append(r["v"])
    return {d: np.unique(np.array(v), axis=0)[:: max(1, len(v) // pivots)][:pivots] for d, v in by.items()}


def candidate_count(n: int) -> int:
    """Candidates reranked for each query: sixteen times the square root of the rows, 400 at least."""
    return max(400, 16 * math.isqrt(n))


def nearest(table: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", pivots: int = PIVOTS,
            prefix: int = PREFIX, candidates: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` largest inner products found for each query row, ties to smaller ids.

    ``is_query`` is a condition on the column ``id``.  Rows whose vector is null, empty, zero or holds a null or
    non-finite component take no part; vectors of different lengths never meet.  Rows with the query's own id are no
    candidates.  Fewer candidates than ``k`` give fewer rows; no valid vectors give an empty result.  Rows of other
    dimensions than those of the pivot sample are all reranked.
    """
    squared = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    vectors = finite_vectors(table, id_col, vec_col).where(F.exists("v", lambda x: x != 0))
    reps, queries, found_classes = classes(vectors, is_query, k)
    chosen = choose_pivots(reps, pivots)
    norms = {r["dim"]: r["m"] ** 0.5 for r in reps.groupBy(F.size("v").alias("dim")).agg(F.max(squared).alias("m")).collect()}
    asked, n, n_tiles, n_blocks = sides(reps, queries)
    wanted = candidates or candidate_count(n)

    def post(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                files = None
                if row.dim in chosen and math.isfinite(norms[row.dim]):
                    points = lift(np.asarray(row.tile_flat, np.float64).reshape(-1, row.dim), norms[row.dim])
                    axes = lift(chosen[row.dim], norms[row.dim])
                    files = Files.of(points, axes, min(prefix, len(axes))).dump()
                out.append(files)
            yield batch.assign(files=pd.Series(out, index=batch.index, dtype=object))

    tiles = stage(packed(reps, n_tiles, "tile").mapInPandas(post, "dim int, tile int, tile_ids array<long>, tile_flat array<double>, files binary"), "permutation-files")
    pairs = crossed(tiles, packed(asked, n_blocks, "block"), n_tiles, n_blocks)

    def kernel(row) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        ids, rows, query_ids, vectors = arrays(row, row.dim)
        share = max(found_classes, -(-wanted * len(ids) // max(1, n)))
        indexed = row.files is not None and share < len(rows)
        if indexed:
            axes = lift(chosen[row.dim], norms[row.dim])
            depth = min(prefix, len(axes))
            files = Files.load(row.files, len(axes))
            unit = np.column_stack([vectors / np.linalg.norm(vectors, axis=1)[:, None], np.zeros(len(vectors))])
            own = np.argsort(-(unit @ axes.T), axis=1, kind="stable")[:, :depth]
        for j, q in enumerate(query_ids.tolist()):
            take = slice(None)
            if indexed:
                common = files.common(own[j], len(rows))
                posted = np.flatnonzero(common)
                take = posted if len(posted) <= share else posted[np.argpartition(common[posted], len(posted) - share)[len(posted) - share :]]
                if len(take) < found_classes:  # fewer rows share a pivot than are wanted: the others are as near as each other
                    take = slice(None)
            yield (q, *top_of(ids[take], (rows[take] * vectors[j]).sum(axis=1), found_classes))

    return ranked(best_of_pairs(pairs, kernel, found_classes, "double"), reps, queries, k)


def op1_permutation_index(spark, sf_dir: str) -> DataFrame:
    """The 20 nearest found for every vector whose id is divisible by 20, among all others."""
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("id") % 20 == 0)
