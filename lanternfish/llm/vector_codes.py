"""Compression of vectors to one byte a part: whole-numbered k-means codebooks fitted over metric trees.

Rows are dealt into blocks; each block builds, once, a metric tree of its points for every part (``metric_trees``).  A round
sends the codebooks (at most 256 entries a part) to the blocks and gets back sums and counts for each entry; nothing else
passes the driver.  All arithmetic is whole, so results do not depend on how rows are dealt.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from lanternfish.llm.metric_trees import Tree, build, codes, totals
from lanternfish.operators.relational import hot_join
from lanternfish.plans.staging import discard, stage

PARTS, ENTRIES, ROUNDS, SCALE, BLOCK_ROWS = 4, 256, 4, 1024, 4096
Books = dict[int, list[np.ndarray]]  # for each length of vectors, the entries of every part


def cuts(dim: int, parts: int) -> list[slice]:
    return [slice(dim * k // parts, dim * (k + 1) // parts) for k in range(parts)]


def whole_vectors(table: DataFrame, id_col: str, vec_col: str, label_col: str, scale: int) -> DataFrame:
    """(id, label, v array<long>) of the rows whose vector is not null and has only finite components."""
    v = F.col(vec_col).cast("array<double>")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    kept = table.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), v.alias("v")).where(F.col("v").isNotNull() & ~F.exists("v", bad))
    return kept.select("id", "label", F.transform("v", lambda x: F.floor(F.lit(float(scale)) * x).cast("long")).alias("v"))


def first_books(vectors: DataFrame, parts: int, entries: int) -> Books:
    """The parts of the ``entries`` vectors of smallest id (nulls last, ties by vector) of each length."""
    books = {}
    for dim in sorted(r["dim"] for r in vectors.select(F.size("v").alias("dim")).distinct().collect()):
        rows = vectors.where(F.size("v") == dim).orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).collect()
        matrix = np.array([r["v"] for r in rows], np.int64).reshape(len(rows), dim)
        books[dim] = [matrix[:, c] for c in cuts(dim, parts)]
    return books


def tree_blocks(vectors: DataFrame, parts: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(dim, ids, labels, trees): blocks of at most ``block_rows`` rows of one length with the tree of every part."""
    label_type = vectors.schema["label"].dataType.simpleString()

    def block(dim: int, rows: list[tuple]) -> pd.DataFrame:
        matrix = np.array([r[2] for r in rows], np.int64).reshape(len(rows), dim)
        trees = [build(np.ascontiguousarray(matrix[:, c])).dump() for c in cuts(dim, parts)]
        return pd.DataFrame({"dim": [dim], "ids": [[r[0] for r in rows]], "labels": [[r[1] for r in rows]], "trees": [trees]})

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list[tuple]] = {}
        for batch in batches:
            ids = [None if pd.isna(i) else int(i) for i in batch["id"]]
            for row in zip(ids, batch["label"].astype(object).where(batch["label"].notna(), None), batch["v"]):
                rows = held.setdefault(len(row[2]), [])
                rows.append(row)
                if len(rows) == block_rows:
                    yield block(len(row[2]), held.pop(len(row[2])))
        for dim, rows in held.items():
            yield block(dim, rows)

    return vectors.mapInPandas(deal, f"dim int, ids array<long>, labels array<{label_type}>, trees array<binary>")


def next_books(blocks: DataFrame, books: Books) -> Books:
    """One round: every entry becomes the floored mean of the parts nearest to it; an entry without parts stays."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[tuple[int, int], list[np.ndarray]] = {}
        for batch in batches:
            for dim, trees in zip(batch["dim"], batch["trees"]):
                for part, (data, entries) in enumerate(zip(trees, books[dim])):
                    sums, counts = totals(Tree.load(data), entries)
                    if (dim, part) in found:
                        found[dim, part][0] += sums
                        found[dim, part][1] += counts
                    else:
                        found[dim, part] = [sums, counts]
        for (dim, part), (sums, counts) in found.items():
            used = np.flatnonzero(counts)
            yield pd.DataFrame({"dim": dim, "part": part, "entry": used, "n": counts[used], "sums": list(sums[used])})

    each = blocks.mapInPandas(add, "dim int, part int, entry int, n long, sums array<long>")
    counted = each.groupBy("dim", "part", "entry").agg(F.sum("n").alias("n"))
    places = each.select("dim", "part", "entry", F.posexplode("sums").alias("at", "s")).groupBy("dim", "part", "entry", "at").agg(F.sum("s").alias("s"))
    whole = places.groupBy("dim", "part", "entry").agg(F.array_sort(F.collect_list(F.struct("at", "s")))["s"].alias("sums")).join(counted, ["dim", "part", "entry"])
    out = {dim: [e.copy() for e in own] for dim, own in books.items()}
    for r in whole.collect():  # as many rows as there are entries
        out[r["dim"]][r["part"]][r["entry"]] = np.array(r["sums"], np.int64) // r["n"]
    return out


def books_digest(own: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for e in own for x in e.ravel().tolist()).encode()).hexdigest()


def vector_codes(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", parts: int = PARTS,
                 entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, Books]:
    """The rows (id, label, code, error, label_error, codebooks_sha256), and the codebooks.

    Components become floor(scale * x); rows whose vector is null or holds a null or non-finite component are dropped.
    Vectors of each length have codebooks of their own; a length that ``parts`` does not divide is cut as evenly as can be,
    and an empty vector has empty parts.  Rows with a null id are coded like any other; repeated rows are rows of their own.
    ``label_error`` sums errors over equal labels, null labels together.  Squared distances must fit a long.  At most 256
    entries make codes of two hex digits a part.  An empty table gives an empty result.
    """
    vectors = stage(whole_vectors(table, id_col, vec_col, label_col, scale), "codes-vectors")
    blocks = stage(tree_blocks(vectors.repartition(max(1, -(-vectors.count() // block_rows))), parts, block_rows), "codes-trees")
    books = first_books(vectors, parts, entries)
    discard(vectors)
    for _ in range(rounds):
        books = next_books(blocks, books)
    digests = {dim: books_digest(own) for dim, own in books.items()}

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, ids, labels, trees in zip(batch["dim"], batch["ids"], batch["labels"], batch["trees"]):
                found = [codes(Tree.load(data), e) for data, e in zip(trees, books[dim])]
                rows = np.column_stack([c for c, _ in found]).tolist()
                out = {"id": pd.array([None if pd.isna(i) else int(i) for i in ids], "Int64"), "label": pd.Series(list(labels), dtype=object),
                       "code": ["".join(f"{c:02x}" for c in row) for row in rows], "error": sum(e for _, e in found)}
                yield pd.DataFrame(out).assign(codebooks_sha256=digests[dim])

    label_type = table.schema[label_col].dataType.simpleString()
    coded = stage(blocks.mapInPandas(assign, f"id long, label {label_type}, code string, error long, codebooks_sha256 string"), "codes-rows")
    discard(blocks)
    keyed = coded.withColumn("__label", F.when(F.col("label").isNull(), "null").otherwise(F.concat(F.lit("="), F.col("label").cast("string"))))
    errors = keyed.groupBy("__label").agg(F.sum("error").alias("label_error"))
    out = hot_join(keyed, errors, "__label").select(F.col("id").alias(id_col), F.col("label").alias(label_col), "code", "error", "label_error", "codebooks_sha256")
    return out, books


def op13_anchor_codes(spark, sf_dir: str) -> DataFrame:
    """Every vector's four-byte code, its error and its label's, after four rounds from the 256 smallest ids."""
    found, _ = vector_codes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return found.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def _sql() -> str:
    """The rounds as chained tables; squared distances by whole inner products in double precision."""
    nearest = """SELECT p.vec_id, p.part, arg_min(c.entry, (p.xx - 2 * list_inner_product(p.x, c.c) + c.cc) * 1000 + c.entry) AS entry,
    min(p.xx - 2 * list_inner_product(p.x, c.c) + c.cc) AS d FROM p JOIN c{k} c ON p.part = c.part GROUP BY ALL"""
    moved = """SELECT o.part, o.entry, coalesce(m.c, o.c) AS c, list_inner_product(coalesce(m.c, o.c), coalesce(m.c, o.c)) AS cc FROM c{k} o LEFT JOIN (
    SELECT part, entry, list(v ORDER BY pos) AS c FROM (
      SELECT a.part, a.entry, pos, floor(sum(p.x[pos]) / count(*)) AS v FROM a{k} a JOIN p ON a.vec_id = p.vec_id AND a.part = p.part, range(1, 17) r(pos) GROUP BY ALL
    ) GROUP BY ALL) m ON o.part = m.part AND o.entry = m.entry"""
    steps = []
    for k in range(ROUNDS):
        steps += [f"a{k} AS MATERIALIZED ({nearest.format(k=k)})", f"c{k + 1} AS MATERIALIZED ({moved.format(k=k)})"]
    steps.append(f"a{ROUNDS} AS MATERIALIZED ({nearest.format(k=ROUNDS)})")
    return f"""
WITH v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS MATERIALIZED (
  SELECT vec_id, part, e[part * 16 + 1 : part * 16 + 16] AS x, list_inner_product(x, x) AS xx FROM v, range({PARTS}) r(part)
), c0 AS MATERIALIZED (
  SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, x AS c, xx AS cc FROM p QUALIFY entry < {ENTRIES}
), {", ".join(steps)}, s AS (
  SELECT sha256(string_agg(CAST(CAST(x AS BIGINT) AS VARCHAR), ',' ORDER BY part, entry, pos)) AS h
  FROM (SELECT part, entry, unnest(c) AS x, unnest(range(1, 17)) AS pos FROM c{ROUNDS})
), f AS (
  SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY vec_id
), g AS (
  SELECT label, CAST(sum(error) AS BIGINT) AS label_error FROM f JOIN v USING (vec_id) GROUP BY label
)
SELECT f.vec_id, f.code, f.error, g.label_error, s.h AS codebooks_sha256 FROM f JOIN v USING (vec_id) JOIN g ON g.label IS NOT DISTINCT FROM v.label, s
"""


OP13_SQL = _sql()
