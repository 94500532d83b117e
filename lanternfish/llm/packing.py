"""Length buckets that minimise padding, and token-budget batches inside them.

A global histogram of lengths (one Spark aggregation) is small; dynamic programming over it places the bucket
boundaries so that padding every sequence up to its bucket's boundary wastes least.  Inside a bucket, sequences in
order of their ids are cut into batches that fill a token budget at the padded length.  Their ranks come from one range
partitioning and the partitions' counts, so that a bucket that holds most rows is still ranked by many tasks.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from lanternfish.plans.staging import parts_for, stage

BUCKETS, BUDGET = 16, 65_536
PART_ROWS = 4 << 20
WORD = r"[^\x20\x09-\x0D]+"


def optimal_boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Ascending bucket boundaries (the last is the largest length) of least total padding, with at most ``buckets`` of them.

    The cost of a bucket satisfies the quadrangle inequality, so each layer of the dynamic programme is solved by
    divide and conquer in n log n steps.
    """
    n = len(lengths)
    if n == 0:
        return []
    many = np.concatenate(([0], np.cumsum(counts, dtype=np.float64)))
    tokens = np.concatenate(([0], np.cumsum(counts * lengths, dtype=np.float64)))

    def cost(a: np.ndarray, b: int) -> np.ndarray:  # lengths a..b-1 padded to lengths[b-1]
        return lengths[b - 1] * (many[b] - many[a]) - (tokens[b] - tokens[a])

    best = np.concatenate(([0.0], lengths * many[1:] - tokens[1:]))
    cuts = [np.zeros(n + 1, dtype=np.int64)]
    for _ in range(1, min(buckets, n)):
        layer, cut = best.copy(), np.zeros(n + 1, dtype=np.int64)
        todo = [(1, n, 0, n - 1)]
        while todo:
            low, high, first, last = todo.pop()
            if low > high:
                continue
            b = (low + high) // 2
            a = np.arange(first, min(last, b - 1) + 1)
            total = best[a] + cost(a, b)
            k = int(np.argmin(total))
            layer[b], cut[b] = total[k], a[k]
            todo += [(low, b - 1, first, a[k]), (b + 1, high, a[k], last)]
        cuts.append(cut)
        best = layer
    out, b = [], n
    for cut in reversed(cuts):
        if b == 0:
            break
        out.append(int(lengths[b - 1]))
        b = int(cut[b])
    return sorted(set(out))


def length_boundaries(lengths: DataFrame, length_col: str, buckets: int = BUCKETS, bins: int | None = None) -> list[int]:
    """Boundaries from the exact histogram of all rows, whose distinct lengths number at most the square root of twice the
    tokens.  Only if ``bins`` is given, lengths are rounded up to a multiple that keeps the histogram within so many rows."""
    largest = lengths.agg(F.max(length_col)).first()[0]
    if largest is None:
        return []
    width = 1 if bins is None else max(1, -(-int(largest) // bins))
    rounded = F.col(length_col) if width == 1 else (F.ceil(F.col(length_col) / width) * width).cast("long")
    rows = lengths.groupBy(rounded.alias("length")).agg(F.count("*").alias("n")).collect()
    rows = sorted((min(int(r["length"]), int(largest)), r["n"]) for r in rows)
    return optimal_boundaries(np.array([r[0] for r in rows], dtype=np.float64), np.array([r[1] for r in rows], dtype=np.float64), buckets)


def word_tokens(text: Column) -> Column:
    """Words of a text and one end token; a null text has the end token only."""
    return (F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)) + 1).cast("long")


def pack(docs: DataFrame, length: Column, id_col: str = "doc_id", buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """(id, n_tokens, bucket, padded, batch, slot) of every row.

    ``padded`` is the bucket's boundary; a batch has max(1, budget // padded) slots and only the last of a bucket may be
    short; a sequence longer than the budget is a batch of its own.  Rows are placed in order of id, ties of equal rows in
    any order.  A null length counts as zero.  Batches are numbered from 0 within their bucket.  Other columns are
    ignored; an empty table gives an empty result.
    """
    sized = stage(docs.select(F.col(id_col).alias("id"), F.coalesce(length, F.lit(0)).cast("long").alias("n_tokens")), "packing-lengths")
    bounds = length_boundaries(sized, "n_tokens", buckets)
    if not bounds:
        return sized.select(F.col("id").alias(id_col), "n_tokens", F.lit(0).alias("bucket"), F.lit(0).cast("long").alias("padded"),
                            F.lit(0).cast("long").alias("batch"), F.lit(0).alias("slot"))
    edges = F.array(*[F.lit(b).cast("long") for b in bounds])
    bucket = F.size(F.filter(edges, lambda b: b < F.col("n_tokens")))
    parts = parts_for(docs.sparkSession, sized.count(), PART_ROWS)
    ordered = sized.withColumn("bucket", bucket).repartitionByRange(parts, "bucket", "id").sortWithinPartitions("bucket", "id", "n_tokens")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), np.zeros(len(bounds) + 1, dtype=np.int64)
        for batch in batches:
            own = batch.column("bucket").to_numpy()  # sorted, so that each bucket is one run
            starts = np.searchsorted(own, own, side="left")
            place = seen[own] + np.arange(len(own)) - starts
            seen += np.bincount(own, minlength=len(seen))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(own), part, np.int32)), pa.array(place)], [*batch.schema.names, "part", "place"])

    placed = stage(ordered.mapInArrow(number, "id long, n_tokens long, bucket int, part int, place long"), "packing-places")
    counts = sorted((r["bucket"], r["part"], r["n"]) for r in placed.groupBy("bucket", "part").agg(F.count("*").alias("n")).collect())  # buckets + partitions rows
    before, seen = [], {}
    for b, part, n in counts:
        before.append((b, part, seen.get(b, 0)))
        seen[b] = seen.get(b, 0) + n
    offsets = docs.sparkSession.createDataFrame(before, "bucket int, part int, before long")
    rank = F.col("before") + F.col("place")
    slots = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.col("padded"))).cast("long")
    return (
        placed.join(F.broadcast(offsets), ["bucket", "part"])
        .withColumn("padded", F.greatest(F.lit(1).cast("long"), F.element_at(edges, F.col("bucket") + 1)))
        .select(F.col("id").alias(id_col), "n_tokens", "bucket", "padded", F.floor(rank / slots).cast("long").alias("batch"), (rank % slots).cast("int").alias("slot"))
    )


def bucket_of(bounds: list[int], length: int) -> int:
    return bisect_left(bounds, length)


def op4_length_buckets(spark, sf_dir: str) -> DataFrame:
    """Every document's bucket, batch and slot."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(docs, word_tokens(F.col("text")))
