"""SimHash near-duplicate detection by tiled exact comparison.

Distinct 64-bit fingerprints are dealt into cells by the population counts of their two 32-bit halves.  The sum of the
absolute differences of those counts never exceeds the Hamming distance, so cell pairs further apart than the radius
are never paired.  Cells larger than a tile are split by hash; each pair of tiles is compared exactly with numpy
exclusive-or and bit counts, and only a spanning forest of the links found in it leaves the task, so a group of any
size yields at most one edge per member and tile pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from lanternfish.operators.components import connected_components
from lanternfish.llm.frames import text_batches
from lanternfish.operators.relational import hot_join
from lanternfish.plans.staging import discard, stage

TILE = 16_384
_CHUNK_ROWS = 1 << 20


def shingle_hashes(data: bytes, width: int, seed: int) -> np.ndarray:
    """XXH64 of every word shingle of ASCII-lower-cased UTF-8 bytes; a text of fewer words gives its whole sequence."""
    words = data.lower().split()
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([digest(b" ".join(words), seed)] if words else [], dtype=np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[: -width] + 1)).tolist()
    stops = ends[width - 1 :].tolist()
    return np.array([digest(joined[a:b], seed) for a, b in zip(starts, stops)], dtype=np.uint64)


def fingerprint(text: str | None, width: int, seed: int) -> int:
    """64 bits as a signed long: a bit is one if it is set in more than half of the shingle hashes; no words: zero."""
    hashes = shingle_hashes((text or "").encode("utf-8", "surrogatepass"), width, seed)
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), _CHUNK_ROWS):
        part = hashes[at : at + _CHUNK_ROWS].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * counts > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, seed: int = 42) -> DataFrame:
    """(id, fp): one signed 64-bit fingerprint a row; a null text counts as empty."""

    @F.pandas_udf("long")
    def simhash(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, width, seed) for t in texts], dtype="int64")

    return docs.select(F.col(id_col), simhash(F.col(text_col)).alias("fp"))


def _settle(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Merge the components joined by the links (i, j); labels always point at the root of a component."""
    while len(i):
        a, b = labels[i], labels[j]
        apart = a != b
        if not apart.any():
            break
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(labels, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = labels[labels]
            if np.array_equal(up, labels):
                break
            labels = up
    return labels


def tile_forest(a: np.ndarray, b: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of all pairs of two tiles (or of one with itself) within the radius."""
    nodes = a if b is None else np.concatenate([a, b])
    other, shift = (a, 0) if b is None else (b, len(a))
    labels = np.arange(len(nodes))
    rows = max(1, _CHUNK_ROWS // max(1, len(other)))
    for at in range(0, len(a), rows):
        near = np.bitwise_count(a[at : at + rows, None] ^ other[None, :]) <= radius
        i, j = np.nonzero(near)
        labels = _settle(labels, i + at, j + shift)
    linked = np.flatnonzero(labels != np.arange(len(nodes)))
    return nodes[linked], nodes[labels[linked]]


def fingerprint_links(prints: DataFrame, radius: int = 4, tile: int = TILE) -> DataFrame:
    """(src, dst) edges whose components are those of all pairs of distinct ``fp`` values within the radius."""
    half = lambda shift: F.bit_count(F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit(0xFFFFFFFF)))
    cells = prints.select("fp", half(32).alias("hi"), half(0).alias("lo"))
    counts = cells.groupBy("hi", "lo").agg(F.ceil(F.count("*") / tile).cast("int").alias("parts"))  # 33 x 33 rows at most
    tiles = (
        cells.join(F.broadcast(counts), ["hi", "lo"])
        .groupBy("hi", "lo", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int").alias("part"), "parts")
        .agg(F.collect_list("fp").alias("fps"))
    )
    tiles = stage(tiles, "simhash-tiles")
    offsets = [(d, e) for d in range(0, radius + 1) for e in range(-radius, radius + 1) if d + abs(e) <= radius and (d or e >= 0)]
    steps = F.explode(F.array(*[F.struct(F.lit(d).alias("d"), F.lit(e).alias("e")) for d, e in offsets]))
    near = counts.select(F.col("hi").alias("bh"), F.col("lo").alias("bl"), F.col("parts").alias("bparts"))
    pairs = (
        counts.select("hi", "lo", "parts", steps.alias("s"))
        .select("hi", "lo", "parts", (F.col("hi") + F.col("s.d")).alias("bh"), (F.col("lo") + F.col("s.e")).alias("bl"))
        .join(F.broadcast(near), ["bh", "bl"])
        .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .withColumn("bpart", F.explode(F.sequence(F.lit(0), F.col("bparts") - 1)))
        .where((F.col("hi") != F.col("bh")) | (F.col("lo") != F.col("bl")) | (F.col("part") <= F.col("bpart")))
        .select("hi", "lo", "part", "bh", "bl", "bpart")
    )
    one = tiles.select("hi", "lo", "part", F.col("fps").alias("a"))
    two = tiles.select(F.col("hi").alias("bh"), F.col("lo").alias("bl"), F.col("part").alias("bpart"), F.col("fps").alias("b"))
    same = (F.col("hi") == F.col("bh")) & (F.col("lo") == F.col("bl")) & (F.col("part") == F.col("bpart"))
    work = pairs.join(one, ["hi", "lo", "part"]).join(two, ["bh", "bl", "bpart"]).select("a", F.when(~same, F.col("b")).alias("b"))
    work = work.repartition(F.xxhash64("a", "b"))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for a, b in zip(batch["a"], batch["b"]):
                a = np.asarray(a, dtype=np.int64).view(np.uint64)
                b = None if b is None else np.asarray(b, dtype=np.int64).view(np.uint64)
                src, dst = tile_forest(a, b, radius)
                if len(src):
                    yield pd.DataFrame({"src": src.view(np.int64), "dst": dst.view(np.int64)})

    return work.mapInPandas(compare, "src long, dst long")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, seed: int = 42,
                       radius: int = 4, tile: int = TILE) -> DataFrame:
    """(id, fp, component_id): component_id is the smallest id reachable over links of ``radius`` or fewer differing bits.

    Nulls and empty texts: no words, fingerprint zero, linked like any other.  Rows with equal texts share a
    fingerprint and so a component; repeated ids give repeated rows.  Any other columns are ignored, whatever their
    names.  An empty table gives an empty result.
    """
    text_batches(docs.sparkSession)
    keyed = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("body"))
    prints = stage(fingerprints(keyed, "id", "body", width, seed), "simhash-prints")
    distinct = stage(prints.groupBy("fp").agg(F.min("id").alias("first_id")), "simhash-distinct")
    groups = connected_components(fingerprint_links(distinct, radius, tile))
    tagged = distinct.join(groups, distinct["fp"] == groups["node"], "left").select(
        "fp", "first_id", F.coalesce("component", "fp").alias("root"))
    smallest = tagged.groupBy("root").agg(F.min("first_id").alias("component_id"))
    known = tagged.join(smallest, "root").select("fp", "component_id")
    return hot_join(prints, known, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


WIDE_WORDS, WIDE_TILE, PART_BYTES = 4, 32_768, 1 << 20
_STEPS = np.arange(WIDE_WORDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def wide_fingerprint(hashes: np.ndarray) -> bytes:
    """256 bits: the fingerprint of distinct shingle hashes, and of three further mixes of them."""
    out = []
    for step in _STEPS:
        h = hashes if not step else (hashes + step) * np.uint64(0xBF58476D1CE4E5B9)
        h = h if not step else (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
        counts = np.zeros(64, dtype=np.int64)
        for at in range(0, len(h), _CHUNK_ROWS):
            part = np.ascontiguousarray(h[at : at + _CHUNK_ROWS]).view(np.uint8).reshape(-1, 8)
            counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out.append(np.packbits((2 * counts > len(h)).astype(np.uint8), bitorder="little").tobytes())
    return b"".join(out)


def shingle_set(text: str | None, width: int, seed: int) -> np.ndarray:
    """The distinct shingle hashes of a text, ascending."""
    return np.unique(shingle_hashes((text or "").encode("utf-8", "surrogatepass"), width, seed))


def jaccard_forest(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Spanning forest of all pairs of sets with an exact Jaccard similarity of 0.8 or more.

    Each set is compared once with those not reached yet, so a group of like sets takes few steps.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    values, codes = np.unique(np.concatenate(sets), return_inverse=True) if len(sets) else (np.array([]), np.array([], int))
    own = np.split(codes, np.cumsum(sizes)[:-1]) if len(sets) else []
    flags = np.zeros(len(values), bool)
    left, out = np.flatnonzero(sizes > 0), []
    while len(left):
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            at = queue.pop()
            left_sizes = sizes[left]
            alike = np.flatnonzero((5 * left_sizes >= 4 * sizes[at]) & (4 * left_sizes <= 5 * sizes[at]))
            if not len(alike):
                continue
            flags[own[at]] = True
            starts = np.concatenate(([0], np.cumsum(left_sizes[alike])[:-1]))
            common = np.add.reduceat(flags[np.concatenate([own[k] for k in left[alike]])].astype(np.int64), starts)
            flags[own[at]] = False
            near = alike[5 * common >= 4 * (left_sizes[alike] + sizes[at] - common)]
            queue += left[near].tolist()
            out += [(at, int(k)) for k in left[near]]
            left = np.delete(left, near)
    return out


def jaccard_links(members: DataFrame, across: bool, bytes_a_part: int) -> DataFrame:
    """(src, dst) links of similar ``members`` (grp, fid, label, shingles) of one group, by exact comparison.

    Groups are dealt by hash into parts of bounded bytes.  Each part is compared with itself or, if ``across``, with all
    parts of its group, but for pairs of parts that already carry a single label.
    """
    total = members.groupBy("grp").agg(F.ceil(F.sum(F.length("shingles") + 64) / bytes_a_part).cast("int").alias("parts"))
    large = stage(total.where("parts > 1"), "near-sizes")  # written, so that it is broadcast where it is small and members need not meet by group
    dealt = members.join(large, "grp", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    parts = dealt.groupBy("grp", "parts", F.pmod(F.xxhash64("shingles"), F.col("parts")).cast("int").alias("part")).agg(
        F.collect_list(F.struct("fid", "label", "shingles")).alias("a"))
    if across:
        parts = stage(parts, "near-parts")
        b = parts.select("grp", F.col("part").alias("other"), F.col("a").alias("b"))
        ahead = parts.select("grp", "part", F.explode(F.sequence("part", F.col("parts") - 1)).alias("other"))
        work = ahead.join(parts.select("grp", "part", "a"), ["grp", "part"]).join(b, ["grp", "other"])
        work = work.repartition("grp", "part", "other").select("a", F.when(F.col("part") != F.col("other"), F.col("b")).alias("b"))
    else:
        work = parts.select("a", F.lit(None).cast(parts.schema["a"].dataType).alias("b"))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for a, b in zip(batch["a"], batch["b"]):
                rows = [*a, *(() if b is None else b)]
                if len({r["label"] for r in rows}) > 1:
                    links = jaccard_forest([np.frombuffer(r["shingles"], np.uint64) for r in rows])
                    found += [(rows[i]["fid"], rows[j]["fid"]) for i, j in links]
            if found:
                yield pd.DataFrame(found, columns=["src", "dst"])

    return work.mapInPandas(compare, "src long, dst long")


def _relabelled(members: DataFrame, links: DataFrame) -> DataFrame:
    """``members`` with the label that the components of the links, and of their labels, give."""
    groups = connected_components(links.union(members.select("fid", "label").where("fid != label")))
    return stage(members.join(groups, members["fid"] == groups["node"], "left").select(
        "grp", "fid", F.coalesce("component", "label").alias("label"), "shingles"), "near-members")


def _unsettled(members: DataFrame) -> DataFrame:
    """Members of the groups that carry more than one label."""
    several = members.groupBy("grp").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low != high").select("grp")
    return members.join(stage(several, "near-several"), "grp", "left_semi")  # written, so that members need not meet by group where it is small


def verified_components(members: DataFrame, bytes_a_part: int) -> DataFrame:
    """(node, component) of the links of exact similarity 0.8 or more among the ``members`` of each candidate group.

    Parts are settled within themselves, then one member of each label meets those of all other parts, then what still
    has several labels is compared in full; a group of many like members is thus settled without all pairs of its parts.
    """
    members = _relabelled(members, jaccard_links(members, False, bytes_a_part))
    size = stage(members.groupBy("grp").agg(F.sum(F.length("shingles") + 64).alias("size")).where(F.col("size") > bytes_a_part).select("grp"), "near-sizes")
    large = stage(_unsettled(members.join(size, "grp", "left_semi")), "near-large")  # groups of one part are settled
    if not large.isEmpty():
        large = _relabelled(large, jaccard_links(large.where("fid = label"), True, bytes_a_part))
        rest = stage(_unsettled(large), "near-rest")
        if not rest.isEmpty():
            again = _relabelled(rest, jaccard_links(rest, True, bytes_a_part))
            large = large.join(again.select("fid"), "fid", "left_anti").unionByName(again)
        members = members.join(large.select("fid"), "fid", "left_anti").unionByName(large)
    return members.select(F.col("fid").alias("node"), F.col("label").alias("component"))


def wide_forest(ids: np.ndarray, a: np.ndarray, b: np.ndarray | None, gate: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the pairs of two tiles (rows of four words) within ``gate`` bits in the first word and ``radius`` in all."""
    nodes = a if b is None else np.concatenate([a, b])
    other, shift = (a, 0) if b is None else (b, len(a))
    labels = np.arange(len(nodes))
    first = np.ascontiguousarray(other[:, 0])
    rows = max(1, _CHUNK_ROWS // max(1, len(other)))
    for at in range(0, len(a), rows):
        i, j = np.nonzero(np.bitwise_count(a[at : at + rows, :1] ^ first[None, :]) <= gate)
        i += at
        for p in range(0, len(i), _CHUNK_ROWS):
            x, y = i[p : p + _CHUNK_ROWS], j[p : p + _CHUNK_ROWS]
            near = np.bitwise_count(a[x] ^ other[y]).sum(axis=1, dtype=np.int64) <= radius
            labels = _settle(labels, x[near], y[near] + shift)
    linked = np.flatnonzero(labels != np.arange(len(nodes)))
    return ids[linked], ids[labels[linked]]


def similar_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, seed: int = 42,
                       gate: int = 24, radius: int = 78, tile: int = WIDE_TILE, bytes_a_part: int = PART_BYTES) -> DataFrame:
    """(id, component_id) for an exact Jaccard similarity of 0.8 or more of the distinct shingles of ``width`` words.

    Fingerprints only find the candidates.  A pair of similarity 0.8 differs in 39 of the 256 bits on average, in 48 for
    sets of four and five shingles; gate and radius lie four to five standard errors above even that, so that such a
    pair is missed about once in ten thousand times (larger sets: once in 300,000).  Every candidate is verified before
    it counts.  Rows that share an id share a component; rows with a null id are left out.  Texts without words are alike.
    """

    @F.pandas_udf("key binary, wide binary")
    def simhash(texts: pd.Series) -> pd.DataFrame:
        sets = [shingle_set(t, width, seed) for t in texts]
        return pd.DataFrame({"key": [xxhash.xxh3_128_digest(s.tobytes()) for s in sets], "wide": [wide_fingerprint(s) for s in sets]}, dtype=object)

    @F.pandas_udf("key binary, shingles binary")
    def shingles(texts: pd.Series) -> pd.DataFrame:
        sets = [shingle_set(t, width, seed).tobytes() for t in texts]
        return pd.DataFrame({"key": [xxhash.xxh3_128_digest(s) for s in sets], "shingles": sets}, dtype=object)

    text_batches(docs.sparkSession)
    keyed = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("body"))
    prints = stage(keyed.select("id", simhash("body").alias("p")).select("id", "p.key", "p.wide"), "wide-prints")
    pop = sum(F.bit_count(F.conv(F.hex(F.substring("wide", 8 * k + 1, 8)), 16, -10).cast("long")) for k in range(WIDE_WORDS))
    distinct = stage(prints.groupBy("key", "wide").agg(F.min("id").alias("first_id")).withColumn("ones", pop), "wide-distinct")
    counts = sorted((r["ones"], r["count"]) for r in distinct.groupBy("ones").count().collect())  # 257 rows at most
    before = np.cumsum([0] + [n for _, n in counts]).tolist()
    places = docs.sparkSession.createDataFrame([(p, int(b), int(n)) for (p, n), b in zip(counts, before)], "ones int, before long, n long")
    spread = F.pmod(F.xxhash64("wide"), F.lit(1 << 20)) / float(1 << 20)
    tiles = stage(
        distinct.join(F.broadcast(places), "ones").withColumn("tile", F.floor((F.col("before") + spread * F.col("n")) / tile).cast("int"))
        .groupBy("tile").agg(F.min("ones").alias("low"), F.max("ones").alias("high"), F.collect_list(F.struct("first_id", "wide")).alias("rows"))
        .select("tile", "low", "high", F.col("rows.first_id").alias("ids"), F.col("rows.wide").alias("wides")), "wide-tiles")
    last = int(max(0, before[-1] - 1) // tile)
    ahead = tiles.select("tile", "high", F.explode(F.sequence("tile", F.greatest(F.col("tile"), F.lit(last)))).alias("other"))
    far = tiles.select(F.col("tile").alias("other"), F.col("low").alias("olow"))
    pairs = ahead.join(far, "other").where(F.col("olow") - F.col("high") <= radius).select("tile", "other")
    one = tiles.select("tile", F.col("ids").alias("a"), F.col("wides").alias("aw"))
    two = tiles.select(F.col("tile").alias("other"), F.col("ids").alias("b"), F.col("wides").alias("bw"))
    apart = F.col("tile") != F.col("other")
    work = pairs.join(one, "tile").join(two, "other").select("tile", "other", "a", "aw", F.when(apart, F.col("b")).alias("b"), F.when(apart, F.col("bw")).alias("bw"))
    n_pairs = (last + 1) * (last + 2) // 2
    work = work.repartition(max(min(n_pairs, 2000), n_pairs // 16), "tile", "other")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def unpack(wides) -> np.ndarray:
            return np.frombuffer(b"".join(wides), np.uint64).reshape(-1, WIDE_WORDS)

        for batch in batches:
            for a, aw, b, bw in zip(batch["a"], batch["aw"], batch["b"], batch["bw"]):
                ids, words, others = np.asarray(a, np.int64), unpack(aw), None
                if b is not None:
                    ids, others = np.concatenate([ids, np.asarray(b, np.int64)]), unpack(bw)
                src, dst = wide_forest(ids, words, others, gate, radius)
                if len(src):
                    yield pd.DataFrame({"src": src, "dst": dst})

    # classes of one id are one node already, and their candidates are those of all of them
    groups = connected_components(work.mapInPandas(compare, "src long, dst long"))
    discard(tiles)
    found = stage(distinct.join(groups, distinct["first_id"] == groups["node"]).select("key", "first_id", F.col("component").alias("grp")), "near-candidates")
    texts = keyed.join(found.select(F.col("first_id").alias("id")).distinct(), "id", "left_semi").select("id", shingles("body").alias("p"))
    sets = texts.groupBy("id", F.col("p.key").alias("key")).agg(F.first("p.shingles").alias("shingles"))
    members = stage(found.join(sets, (found["first_id"] == sets["id"]) & (found["key"] == sets["key"])).select(
        "grp", F.col("first_id").alias("fid"), F.col("first_id").alias("label"), "shingles"), "near-members")
    checked = verified_components(members, bytes_a_part).distinct()
    known = distinct.join(checked, distinct["first_id"] == checked["node"], "left").select("key", F.coalesce("component", "first_id").alias("component_id"))
    return hot_join(prints.select("id", "key"), known, "key").groupBy("id").agg(F.min("component_id").alias("component_id")).select(F.col("id").alias(id_col), "component_id")


def without_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each group of similar ones, that of the smallest id; rows that share an id stay or go
    together, and rows with a null id stay."""
    gone = similar_components(docs, id_col, text_col).where(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias("__gone"))
    return docs.join(gone, docs[id_col] == gone["__gone"], "left_anti")


def op7_simhash(spark, sf_dir: str) -> DataFrame:
    """Every document with its 4-word-shingle fingerprint (hex) and component at 4 differing bits."""
    found = simhash_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
