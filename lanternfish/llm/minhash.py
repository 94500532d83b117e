"""MinHash near-duplicate detection with sequential Bayesian verification.

A document's set is its distinct word shingles.  Equal sets are one class.  A class gets ``BANDS`` x ``ROWS`` minimum
hashes; bands that agree make two classes candidates, and their bucket lists are compared in parts of bounded size.  A
comparison reads the signatures batch by batch: under a uniform prior the similarity has a beta posterior after every
batch, and a pair is dropped as soon as the posterior probability of reaching the threshold is below ``MISS``.  What
survives all batches is a link to verify; only a spanning forest of such links leaves a task.  Survivors that hang
together are then verified exactly on their full sets, each set travelling once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from lanternfish.llm.frames import text_batches
from lanternfish.llm.simhash import PART_BYTES, shingle_set, verified_components
from lanternfish.operators.components import connected_components
from lanternfish.operators.relational import hot_join
from lanternfish.plans.staging import discard, stage

BANDS, ROWS, BATCH, MISS, PART_ROWS = 32, 5, 32, 1e-6, 8192
THRESHOLD = 0.8  # the similarity that exact verification asks for
_CHUNK = 1024


def _multipliers(n: int) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(b"minimum %d" % k, 7) | 1 for k in range(n)], np.uint64)


def signature(hashes: np.ndarray, n: int = BANDS * ROWS) -> np.ndarray:
    """The minimum of each of ``n`` multiplicative permutations of distinct 64-bit shingle hashes."""
    factors, out = _multipliers(n)[:, None], np.full(n, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), _CHUNK):
        out = np.minimum(out, (hashes[None, at : at + _CHUNK] * factors).min(axis=1))
    return out


def band_keys(minima: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One signed 64-bit key for each band of ``rows`` minima; the band's place is part of the key."""
    bands = minima.reshape(-1, rows)
    key = np.arange(1, len(bands) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for j in range(rows):
        key = (key ^ bands[:, j]) * np.uint64(0xBF58476D1CE4E5B9)
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def sketch(minima: np.ndarray) -> np.ndarray:
    """One byte of each minimum; unequal minima agree in it once in 256 times."""
    return ((minima >> np.uint64(20)) & np.uint64(0xFF)).astype(np.uint8)


def least_matches(hashes: int, batch: int = BATCH, threshold: float = THRESHOLD, miss: float = MISS) -> np.ndarray:
    """For each number of batches read, the fewest agreeing bytes at which the pair is kept.

    With m of n in agreement and a uniform prior, the posterior of the rate of agreement is Beta(m + 1, n - m + 1), and its
    tail above the threshold is the chance of m or fewer successes in n + 1 trials at the threshold.
    """
    rate = threshold + (1.0 - threshold) / 256.0
    out = []
    for n in range(batch, hashes + batch, batch):
        n, tail, m = min(n, hashes), 0.0, -1
        while tail < miss:
            m += 1
            tail += math.comb(n + 1, m) * rate**m * (1.0 - rate) ** (n + 1 - m)
        out.append(m)
    return np.array(out)


def survivors(one: np.ndarray, many: np.ndarray, least: np.ndarray, batch: int = BATCH) -> np.ndarray:
    """Places of the rows of ``many`` that survive all batches against ``one`` (one row, or a row for each)."""
    alive, hits = np.arange(len(many)), np.zeros(len(many), np.int64)
    for k, enough in enumerate(least.tolist()):
        part = slice(k * batch, (k + 1) * batch)
        hits += (many[alive, part] == (one[alive, part] if one.ndim == 2 else one[part])).sum(axis=1)
        kept = hits >= enough
        alive, hits = alive[kept], hits[kept]
        if not len(alive):
            break
    return alive


def survivor_forest(sketches: np.ndarray, least: np.ndarray) -> tuple[list[int], list[int]]:
    """Spanning forest of the surviving pairs; a row is compared once with those not reached yet."""
    left, src, dst = np.arange(len(sketches)), [], []
    while len(left) > 1:
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = survivors(sketches[at], sketches[left], least)
            found = left[near].tolist()
            queue += found
            src += [at] * len(found)
            dst += found
            left = np.delete(left, near)
    return src, dst


def compared(lists: DataFrame, sketches: DataFrame, least: np.ndarray) -> DataFrame:
    """(src, dst): a spanning forest of the surviving pairs of every list (fids); equal lists are compared once."""
    once = stage(lists.select("fids").distinct(), "minhash-lists")
    each = once.withColumn("list", F.monotonically_increasing_id()).select("list", F.explode("fids").alias("fid"))
    work = each.join(sketches, "fid").groupBy("list").agg(F.collect_list("fid").alias("fids"), F.collect_list("sketch").alias("rows"))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            src, dst, a, b = [], [], [], []
            for fids, rows in zip(batch["fids"], batch["rows"]):
                if len(fids) == 2:  # most lists: all at once below
                    a.append((fids[0], rows[0]))
                    b.append((fids[1], rows[1]))
                elif len(fids) > 2:
                    i, j = survivor_forest(np.frombuffer(b"".join(rows), np.uint8).reshape(len(fids), -1), least)
                    src += [fids[k] for k in i]
                    dst += [fids[k] for k in j]
            if a:
                matrix = lambda rows: np.frombuffer(b"".join(r for _, r in rows), np.uint8).reshape(len(rows), -1)
                for k in survivors(matrix(a), matrix(b), least).tolist():
                    src.append(a[k][0])
                    dst.append(b[k][0])
            if src:
                yield pd.DataFrame({"src": src, "dst": dst})

    return work.select("fids", "rows").mapInPandas(compare, "src long, dst long")


def _dealt(members: DataFrame, part_rows: int) -> DataFrame:
    """Lists (key, part, parts, fids) of at most about ``part_rows`` members of each key, dealt by hash."""
    parts = F.ceil(F.col("n") / part_rows).cast("int")
    part = F.pmod(F.xxhash64("fid", "key"), parts).cast("int")
    return members.groupBy("key", parts.alias("parts"), part.alias("part")).agg(F.array_sort(F.collect_list("fid")).alias("fids"))


def survivor_links(members: DataFrame, sketches: DataFrame, least: np.ndarray, part_rows: int = PART_ROWS) -> DataFrame:
    """(src, dst): links whose components are those of all surviving pairs within a bucket (key, fid, n: size of the bucket).

    Buckets are compared in parts of ``part_rows``.  In buckets of several parts one member of each component found so far
    meets those of all parts, and what then still has several components is compared in full, but for the members of the
    bucket's largest component with each other.
    """
    lists = stage(_dealt(members, part_rows), "minhash-dealt")
    links = stage(compared(lists.where(F.size("fids") > 1), sketches, least), "minhash-links")
    large = stage(members.where(F.col("n") > part_rows), "minhash-large")
    discard(lists)
    if large.isEmpty():
        return links

    def labelled(known: DataFrame) -> DataFrame:
        groups = connected_components(known)
        own = large.join(groups, large["fid"] == groups["node"], "left").select("key", "fid", F.coalesce("component", "fid").alias("label"))
        several = own.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low != high").select("key")
        return stage(own.join(several, "key"), "minhash-labelled")

    def paired(one: DataFrame, two: DataFrame, which) -> DataFrame:
        other = two.select("key", F.col("part").alias("other"), F.col("fids").alias("others"))
        return one.join(other, "key").where(which).select(F.array_union("fids", "others").alias("fids"))

    def sized(rows: DataFrame) -> DataFrame:
        return rows.join(rows.groupBy("key").agg(F.count("*").alias("n")), "key")

    first = labelled(links)
    one_each = stage(_dealt(sized(first.groupBy("key", "label").agg(F.min("fid").alias("fid"))), part_rows), "minhash-one-each")
    links = stage(links.union(compared(paired(one_each, one_each, F.col("part") <= F.col("other")), sketches, least)), "minhash-links")
    rest = labelled(links)
    main = rest.groupBy("key", "label").count().groupBy("key").agg(F.max_by("label", F.struct("count", "label")).alias("main"))
    split = rest.join(main, "key")
    small = _dealt(sized(split.where("label != main").select("key", "fid")), part_rows)
    everything = _dealt(sized(rest.select("key", "fid")), part_rows)
    return stage(links.union(compared(paired(small, everything, F.lit(True)), sketches, least)), "minhash-links")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 2, seed: int = 42, miss: float = MISS,
                    part_rows: int = PART_ROWS, bytes_a_part: int = PART_BYTES) -> DataFrame:
    """(id, n_shingles, component_id) of every row: links are pairs of sets with a similarity of 0.8 or more.

    Sets are the distinct shingles of ``width`` words of the ASCII-lower-cased text; a text of fewer words is one shingle.
    A null or empty text, or one without words, has an empty set and is its own component.  A component's name is its
    smallest id.  Rows that share an id are one document: their components are joined.  Rows with a null id are linked with
    nothing and have a null component.  Other columns, whatever their names, are ignored; an empty table gives an empty result.
    A pair of similarity 0.8 shares no band three times in a million; a longer comparison loses it with at most about
    ``miss`` a batch.  Every link is verified on the full sets.
    """
    least = least_matches(BANDS * ROWS, miss=miss)
    text_batches(docs.sparkSession)

    @F.pandas_udf("digest binary, n long, sketch binary, keys array<long>")
    def minima(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            shingles = shingle_set(t, width, seed)
            m = signature(shingles) if len(shingles) else None
            digest = xxhash.xxh3_128_digest(shingles.tobytes())
            rows.append((digest, len(shingles), None if m is None else sketch(m).tobytes(), None if m is None else band_keys(m)))
        return pd.DataFrame({c: pd.Series([r[k] for r in rows], dtype="int64" if c == "n" else object) for k, c in enumerate(("digest", "n", "sketch", "keys"))})

    @F.pandas_udf("digest binary, shingles binary")
    def full_set(texts: pd.Series) -> pd.DataFrame:
        sets = [shingle_set(t, width, seed).tobytes() for t in texts]
        return pd.DataFrame({"digest": [xxhash.xxh3_128_digest(s) for s in sets], "shingles": sets}, dtype=object)

    keyed = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("body"))
    rows = stage(keyed.select("id", minima("body").alias("p")).select("id", "p.*"), "minhash-rows")
    linked = rows.where("n > 0 AND id IS NOT NULL")
    classes = stage(linked.groupBy("digest").agg(F.min("id").alias("fid"), F.first("sketch").alias("sketch"), F.first("keys").alias("keys")), "minhash-classes")
    each = classes.select("fid", F.explode("keys").alias("key")).distinct()
    buckets = each.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    members = stage(each.join(buckets, "key"), "minhash-buckets")
    found = stage(connected_components(survivor_links(members, classes.select("fid", "sketch"), least, part_rows)), "minhash-groups")
    discard(members)
    texts = keyed.join(found.select(F.col("node").alias("id")), "id", "left_semi").select("id", full_set("body").alias("p")).select("id", "p.*")
    candidates = classes.join(found, classes["fid"] == found["node"]).select("digest", "fid", F.col("component").alias("grp"))
    sets = texts.groupBy("id", "digest").agg(F.first("shingles").alias("shingles"))
    whole = stage(candidates.join(sets, (candidates["fid"] == sets["id"]) & (candidates["digest"] == sets["digest"])).select(
        "grp", "fid", F.col("fid").alias("label"), "shingles"), "minhash-sets")
    known = stage(verified_components(whole, bytes_a_part).distinct(), "minhash-known")
    discard(whole)
    again = linked.groupBy("id").agg(F.min("digest").alias("a"), F.max("digest").alias("b")).where("a != b").select("id")
    repeated = stage(linked.join(again, "id", "left_semi").join(classes, "digest").select(F.col("id").alias("src"), F.col("fid").alias("dst")), "minhash-repeated")
    if not repeated.isEmpty():
        known = connected_components(known.select(F.col("node").alias("src"), F.col("component").alias("dst")).union(repeated))
    named = classes.join(known, classes["fid"] == known["node"], "left").select("digest", F.coalesce("component", "fid").alias("component"))
    out = hot_join(rows.select("id", "n", "digest"), named, "digest")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id"))


def op11_bayesian_minhash(spark, sf_dir: str) -> DataFrame:
    """Every document with the size of its set of two-word shingles and its component at a similarity of 0.8."""
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.withColumn("kept", F.col("doc_id") == F.col("component_id"))
