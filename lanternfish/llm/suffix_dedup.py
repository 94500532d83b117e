"""Removal of repeated passages by prefix-free parsing.

Triggers are minima of a rolling hash of 32-byte strings: every 100-byte window has one, which depends on its bytes
alone.  A phrase is a run of neighbouring windows with the same trigger, with all of their bytes, so phrases overlap and
every window lies in exactly one.  Equal windows have equal triggers and so meet in phrases of the same trigger; equal
passages become equal phrases away from their edges.

The dictionary holds each distinct phrase once, with its first occurrence; the parse is the list of the phrases'
occurrences.  All later occurrences of a phrase are repeats.  This is done twice: coarse phrases of about a thousand bytes
take out the long repeats with few rows, and only first occurrences of those are parsed into fine phrases.  Where distinct phrases share a trigger, the suffixes of
the dictionary that are long enough to hold a window are grouped by their windows (hashes compared byte for byte; where two
collide, a suffix array by prefix doubling, cut at the window's length), and each group keeps its first occurrence in corpus
order, which the parse gives.  As phrases
carry the overlap, no suffix of the parse beyond the first phrase is needed to compare windows of fixed length.

Nothing is gathered by one key without a bound: triggers are counted, and a bit table of those that occur more than once
keeps single ones out of all shuffles (the larger the corpus, the more of them get by; they change no result); dictionary
rows are aggregated before they meet, and triggers with more than ``HOT_LEAST`` distinct phrases (edges of a passage that
most documents hold) take another exact path, by 128-bit digests of their windows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from lanternfish.llm.frames import text_batches
from lanternfish.plans.staging import discard, parts_for, stage

WINDOW, TRIGGER = 100, 32  # shorter triggers repeat by chance in large corpora
BLOCK = 256 << 10  # bytes parsed at a time, so that the arrays stay in a core's cache
SORT_BYTES = 1 << 20
COARSE = np.uint64(31)
MAX_BITS = 29
HOT_LEAST = 500
PART_ROWS = 1 << 18
CONTENT_BYTES = 4 << 20  # of phrases that a task holds before it sends them
COUNTED = 1 << 20  # triggers that a task counts before it sends them
_C1, _C3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _words(data: np.ndarray, order: str) -> np.ndarray:
    """The 8 bytes from every position on, as one number."""
    n = len(data) - 7
    out = np.empty(max(0, n), dtype=np.uint64)
    raw = data.tobytes()
    for j in range(min(8, max(0, n))):
        out[j::8] = np.frombuffer(raw, dtype=order, count=(len(data) - j) // 8, offset=j)[: len(out[j::8])]
    return out


def trigger_minima(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every window the least hash of its trigger-long strings, and whether its first string has it."""
    w = _words(data, "<u8")
    n = len(w) - (TRIGGER - 8)
    h = np.zeros(n, dtype=np.uint64)
    for at in range(0, TRIGGER, 8):
        h ^= w[at : at + n]
        h *= _C1
        h ^= h >> np.uint64(29)
    h *= _C3
    h ^= h >> np.uint64(32)
    span, reach, own = 1, WINDOW - TRIGGER + 1, h
    while span * 2 <= reach:
        h = np.minimum(h[:-span], h[span:])
        span *= 2
    least = np.minimum(h[: len(h) - (reach - span)], h[reach - span :]) if reach > span else h
    return least, own[: len(least)] == least


def parse(data: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Phrases of the texts put together in ``data``: trigger, text number, position of the first window, number of windows."""
    starts = np.concatenate(([0], stops[:-1]))
    long = stops - starts >= WINDOW
    none = np.zeros(0, dtype=np.int64)
    if not long.any():
        return none.astype(np.uint64), none, none, none
    minima, leaving = trigger_minima(data)
    fresh = np.zeros(len(minima) + 1, dtype=bool)
    fresh[1:-1] = (minima[1:] != minima[:-1]) | leaving[:-1]  # the trigger is the first of equal strings, so that no phrase repeats a window
    fresh[starts[long]] = True
    fresh[stops[long] - WINDOW + 1] = True
    fresh[-1] = True
    at = np.flatnonzero(fresh)
    first, n = at[:-1], np.diff(at)
    text = np.searchsorted(stops, first, side="right")
    keep = first + WINDOW <= stops[text]
    first, n, text = first[keep], n[keep], text[keep]
    spread = minima[first] * _C3  # least values crowd near zero; slots are taken from the upper bits
    spread ^= spread >> np.uint64(32)
    return spread * _C1, text, first, n


def coarse_phrases(k: np.ndarray, text: np.ndarray, first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Coarse phrases of about 32 phrases: the number of each one's first phrase, and its windows.  They break where a
    trigger's last five bits are zero, so that equal long passages break alike."""
    fresh = (k & COARSE) == 0
    fresh[:1] = True
    fresh[1:] |= text[1:] != text[:-1]
    head = np.flatnonzero(fresh)
    return head, np.add.reduceat(n, head) if len(head) else n


def _fresh_phrases(block, heads) -> tuple:
    """Phrases of a block inside coarse phrases that may be first occurrences, and the runs of those that are not."""
    ids, copies, data, stops = block
    k, text, first, n = parse(data, stops)
    lo = first - np.concatenate(([0], stops[:-1]))[text]
    head, span = coarse_phrases(k, text, first, n)
    at = text[head]
    known = in_slots(heads, place_hashes(ids[at], copies[at], lo[head]))
    keep = np.repeat(known, np.diff(np.append(head, len(k))))
    later = ids[at[~known]], copies[at[~known]], lo[head[~known]], span[~known]
    return k[keep], text[keep], first[keep], n[keep], lo[keep], later


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Ids, copies, bytes and ends of groups of whole texts of about ``BLOCK`` bytes."""
    ids, copies, parts, size = [], [], [], 0

    def block():
        return np.array(ids, np.int64), np.array(copies, np.int32), np.frombuffer(b"".join(parts), np.uint8), np.cumsum([len(p) for p in parts])

    for batch in batches:
        for i, c, t in zip(batch.column("id").to_pylist(), batch.column("copy").to_pylist(), batch.column("body").cast(pa.large_binary()).to_pylist()):
            ids.append(i)
            copies.append(c)
            parts.append(t)
            size += len(t)
            if size >= BLOCK:
                yield block()
                ids, copies, parts, size = [], [], [], 0
    if ids:
        yield block()


def slot_table(rows: DataFrame, hashes, expected: int, least: int = 2) -> np.ndarray:
    """A table of bits: those slots of 64-bit hashes that ``least`` (one or two) or more items fall into.

    ``hashes`` turns the batches of a task into arrays of hashes.  The table has about 12 bits an expected item, up to
    ``MAX_BITS``.  It only keeps work away, so false hits change no result.
    """
    bits = min(MAX_BITS, max(16, int(expected * 12).bit_length()))
    shift, split = np.uint64(64 - bits), max(0, bits - 22)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [h >> shift for h in hashes(batches)]
        if held:
            slots, n = np.unique(np.concatenate(held), return_counts=True)
            cuts = np.searchsorted(slots, np.arange((1 << split) + 1, dtype=np.uint64) << np.uint64(bits - split))
            for b in range(1 << split):
                part, many = slots[cuts[b] : cuts[b + 1]].astype(np.uint32), n[cuts[b] : cuts[b + 1]] >= least
                if len(part):
                    yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([part.tobytes()], pa.binary()), pa.array([part[many].tobytes()], pa.binary())], ["bucket", "once", "many"])

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        seen = np.sort(np.concatenate([np.frombuffer(x, np.uint32) for x in group["once"]]))
        more = np.concatenate([np.frombuffer(x, np.uint32) for x in group["many"]])
        flags = np.zeros(1 << (bits - split), dtype=bool)
        base = np.uint32(int(group["bucket"].iloc[0]) << (bits - split))
        flags[seen[1:][seen[1:] == seen[:-1]] - base] = True
        flags[more - base] = True
        return pd.DataFrame({"bucket": group["bucket"].iloc[:1], "bits": [np.packbits(flags, bitorder="little").tobytes()]})

    found = rows.mapInArrow(local, "bucket int, once binary, many binary").groupBy("bucket").applyInPandas(merge, "bucket int, bits binary").collect()
    table = np.zeros(1 << (bits - 3), dtype=np.uint8)  # at most 64 MB, set by MAX_BITS
    width = 1 << (bits - split - 3)
    for r in found:
        table[r["bucket"] * width : (r["bucket"] + 1) * width] = np.frombuffer(r["bits"], np.uint8)
    return table


def in_slots(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    slot = hashes >> np.uint64(64 - (len(table).bit_length() + 2))
    return (table[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _as_six(keys: np.ndarray) -> bytes:
    return np.ascontiguousarray(keys, dtype="<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _from_six(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), dtype=np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view("<u8").reshape(-1)


def repeated_table(texts: DataFrame, hashes, expected: int) -> np.ndarray:
    """A table of bits of the 64-bit hashes that occur more than once, told apart by their upper 48 bits.

    Each task sends its distinct hashes, six bytes each, in ranges of about a million, and whether it has them twice; a range
    is settled by one task.  Only hashes that are repeated get a slot.
    """
    split = (expected >> 20).bit_length()
    cut = np.uint64(48 - split)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for h in hashes(batches):
            held.append(h >> np.uint64(16))
            size += len(h)
            if size >= COUNTED:
                yield from send(held)
                held, size = [], 0
        if held:
            yield from send(held)

    def send(held: list) -> Iterator[pa.RecordBatch]:
        keys, n = np.unique(np.concatenate(held), return_counts=True)
        edges = np.searchsorted(keys, np.arange((1 << split) + 1, dtype=np.uint64) << cut)
        for b in np.flatnonzero(np.diff(edges)).tolist():
            part, many = keys[edges[b] : edges[b + 1]], n[edges[b] : edges[b + 1]] > 1
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([_as_six(part)], pa.binary()), pa.array([np.packbits(many).tobytes()], pa.binary())], ["range", "keys", "many"])

    def settle(group: pd.DataFrame) -> pd.DataFrame:
        parts = [_from_six(x) for x in group["keys"]]
        keys = np.concatenate(parts)
        many = np.concatenate([np.unpackbits(np.frombuffer(m, np.uint8), count=len(p)) for m, p in zip(group["many"], parts)]) == 1
        order = np.argsort(keys, kind="stable")
        keys, many = keys[order], many[order]
        many[1:] |= keys[1:] == keys[:-1]
        found = np.unique(keys[many])
        return pd.DataFrame({"keys": pd.Series([_as_six(found)], dtype=object), "n": [len(found)]})

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for batch in batches:
            for raw in batch.column("keys").to_pylist():
                yield _from_six(raw) << np.uint64(16)

    repeated = stage(texts.mapInArrow(local, "range int, keys binary, many binary").groupBy("range").applyInPandas(settle, "keys binary, n long"), "dedup-repeated")
    table = slot_table(repeated, known, repeated.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] + 1, 1)
    discard(repeated)
    return table


def place_hashes(ids: np.ndarray, copies: np.ndarray, los: np.ndarray) -> np.ndarray:
    """64-bit hashes of places of phrases."""
    h = ids.astype(np.int64).view(np.uint64) * _C1
    for part in (copies, los):
        h ^= h >> np.uint64(31)
        h = (h + part.astype(np.uint64)) * _C3
    h ^= h >> np.uint64(29)
    return h * _C1


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for batch in batches:
        yield place_hashes(*(batch.column(c).to_numpy() for c in ("id", "copy", "lo")))


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for batch in batches:
        yield batch.column("k").to_numpy().view(np.uint64)


def window_ranks(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Ranks, in lexicographic order, of the windows at the given positions: prefix doubling, cut at the window's length."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    rank = np.unique(_words(padded, ">u8"), return_inverse=True)[1].astype(np.uint64)
    size = 8
    while size * 2 <= WINDOW:
        rank = np.unique((rank[:-size] << np.uint64(32)) | rank[size:], return_inverse=True)[1].astype(np.uint64)
        size *= 2
    rest = WINDOW - size
    pair = (rank[at] << np.uint64(32)) | (rank[at + rest] if rest else np.uint64(0))
    return np.unique(pair, return_inverse=True)[1]


def window_groups(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Numbers from 0 of the windows at the given positions, equal for equal windows only.

    Hashes of windows are put together by doubling, without a sort at each step, and neighbours of equal hashes are compared
    byte for byte.  If any two of them differ, ranks in the order of suffixes tell all windows apart.
    """
    w = _words(data, "<u8")
    join = lambda h, by: h[:-by] * _C3 + (h[by:] ^ (h[by:] >> np.uint64(31)))
    h, size = w * _C1, 8
    h ^= h >> np.uint64(29)
    while size * 2 <= WINDOW:
        h = join(h, size)
        h ^= h >> np.uint64(29)
        size *= 2
    h = (join(h, WINDOW - size) if WINDOW > size else h)[at]
    order = np.argsort(h)
    same = h[order[1:]] == h[order[:-1]]
    one, other = at[order[:-1][same]], at[order[1:][same]]
    if not all(np.array_equal(w[one + o], w[other + o]) for o in (*range(0, WINDOW - 7, 8), WINDOW - 8)):
        return window_ranks(data, at)
    group = np.empty(len(at), np.int64)
    group[order] = np.cumsum(np.concatenate(([0], ~same)))[: len(at)]
    return group


def _first_owned(contents: list[bytes], ids: np.ndarray, copies: np.ndarray, los: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
    """For each phrase, which of its windows occur nowhere earlier among these phrases' first occurrences."""
    lengths = np.array([len(c) for c in contents])
    base = np.cumsum(lengths) - lengths
    step = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    which = np.repeat(np.arange(len(counts)), counts)
    data = np.frombuffer(b"".join(contents), np.uint8)
    group = window_groups(data, base[which] + step)
    own = np.bincount(group)[group] == 1  # of the others, the first of each group
    rest = np.flatnonzero(~own)
    x = which[rest]
    order = rest[np.lexsort((los[x] + step[rest], copies[x], ids[x], group[rest]))]
    own[order] = np.concatenate(([True], group[order][1:] != group[order][:-1]))[: len(order)]
    return np.split(own, np.cumsum(counts)[:-1])


_PHRASE = "k long, f long, id long, copy int, lo int, cnt int"
_PLACE = "id long, copy int, lo int"
_MASK = "id long, copy int, lo int, cnt int, mask binary"


def _coarse_rows(texts: DataFrame) -> DataFrame:
    """(digest, id, copy, lo): every coarse phrase with a 128-bit digest of its bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, copies, data, stops in _blocks(batches):
            k, text, first, n = parse(data, stops)
            head, span = coarse_phrases(k, text, first, n)
            raw, at, start = data.tobytes(), text[head], first[head]
            digest = [xxhash.xxh3_128_digest(raw[a:b]) for a, b in zip(start.tolist(), (start + span + WINDOW - 1).tolist())]
            lo = start - np.concatenate(([0], stops[:-1]))[at]
            yield pa.RecordBatch.from_arrays([pa.array(digest, pa.binary()), pa.array(ids[at]), pa.array(copies[at]), pa.array(lo.astype(np.int32))], ["digest", "id", "copy", "lo"])

    return texts.mapInArrow(run, f"digest binary, {_PLACE}")


def _phrase_rows(texts: DataFrame, heads, table) -> DataFrame:
    """The parse of what may be new: trigger, digest and place of every phrase whose trigger occurs more than once; and, with
    null trigger and digest, the runs that are later occurrences of coarse phrases."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            ids, copies, data, _ = block
            k, text, first, n, lo, later = _fresh_phrases(block, heads.value)
            keep = in_slots(table.value, k)
            k, text, first, n, lo = k[keep], text[keep], first[keep], n[keep], lo[keep]
            raw, digest = data.tobytes(), xxhash.xxh3_64_intdigest
            f = np.array([digest(raw[a:b]) for a, b in zip(first.tolist(), (first + n + WINDOW - 1).tolist())], dtype=np.uint64)
            i32 = lambda x: pa.array(x.astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(f.view(np.int64)), pa.array(ids[text]), i32(copies[text]), i32(lo), i32(n)], ["k", "f", "id", "copy", "lo", "cnt"])
            none = pa.nulls(len(later[0]), pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, pa.array(later[0]), *map(i32, later[1:])], ["k", "f", "id", "copy", "lo", "cnt"])

    return texts.mapInArrow(run, _PHRASE)


def _contents(texts: DataFrame, heads, table) -> DataFrame:
    """The phrases, with their bytes, at the places in the table of first occurrences.

    The texts are parsed again where they lie, so none of them is shuffled.  A false hit adds a later occurrence of a phrase;
    most are dropped here, as of equal phrases held at a time only the first can be the true one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, tuple] = {}
        size = 0
        for block in _blocks(batches):
            ids, copies, data, _ = block
            k, text, first, n, lo, _ = _fresh_phrases(block, heads.value)
            keep = in_slots(table.value, place_hashes(ids[text], copies[text], lo))
            k, text, first, n, lo = k[keep], text[keep], first[keep], n[keep], lo[keep]
            raw = data.tobytes()
            for x, y, *row in zip(first.tolist(), (first + n + WINDOW - 1).tolist(), ids[text].tolist(), copies[text].tolist(), lo.tolist(), n.tolist(), k.view(np.int64).tolist()):
                content = raw[x:y]
                if content not in held:
                    held[content] = tuple(row)
                    size += y - x
                elif tuple(row[:3]) < held[content][:3]:
                    held[content] = tuple(row)
            if size >= CONTENT_BYTES:
                yield send(held)
                held, size = {}, 0
        if held:
            yield send(held)

    def send(held: dict[bytes, tuple]) -> pa.RecordBatch:
        ids, copies, los, counts, ks = zip(*held.values())
        return pa.RecordBatch.from_arrays([pa.array(ks, pa.int64()), pa.array(ids, pa.int64()), pa.array(copies, pa.int32()), pa.array(los, pa.int32()),
                                           pa.array(counts, pa.int32()), pa.array(list(held), pa.binary())], ["k", "id", "copy", "lo", "cnt", "content"])

    return texts.mapInArrow(run, "k long, id long, copy int, lo int, cnt int, content binary")


def _cold_masks(phrases: DataFrame) -> DataFrame:
    """Masks by the dictionary's suffix order, a few megabytes of whole trigger groups at a time."""
    parts = parts_for(phrases.sparkSession, phrases.count(), PART_ROWS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += int(batch["content"].map(len).sum())
            if size >= SORT_BYTES:
                rows = pd.concat(held)
                open_group = rows["k"] == rows["k"].iloc[-1]
                yield from solve(rows[~open_group])
                held = [rows[open_group]]
                size = int(held[0]["content"].map(len).sum())
        if held:
            yield from solve(pd.concat(held))

    def solve(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        key = rows["k"].to_numpy()
        edges = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else []
        lengths = np.cumsum(rows["content"].map(len).to_numpy()) if len(key) else []
        at = 0
        for e, _ in enumerate(edges):  # whole groups up to a few megabytes
            stop = edges[e + 1] if e + 1 < len(edges) else len(key)
            if stop == len(key) or lengths[stop - 1] - (lengths[at - 1] if at else 0) >= SORT_BYTES:
                part = rows.iloc[at:stop]
                own = _first_owned(part["content"].tolist(), part["id"].to_numpy(), part["copy"].to_numpy(), part["lo"].to_numpy(), part["cnt"].to_numpy())
                keep = [not o.all() for o in own]
                out = part.loc[keep, ["id", "copy", "lo", "cnt"]]
                if len(out):
                    yield out.assign(mask=pd.Series([np.packbits(o, bitorder="little").tobytes() for o, k in zip(own, keep) if k], index=out.index, dtype=object))
                at = stop

    return phrases.repartition(parts, "k").sortWithinPartitions("k").mapInPandas(run, _MASK)


def _hot_masks(phrases: DataFrame, expected: int) -> DataFrame:
    """Masks of phrases of very frequent triggers, by digests of single windows; no group of them meets in one task.

    Windows whose slot is hit once are their own first occurrence.  Of the others each task sends the first it has of every
    digest; the least over all is the owner, and every window that is neither single nor an owner is a repeat.
    """
    def digests(batch) -> Iterator[tuple[int, np.ndarray, list[bytes]]]:
        for r, content in enumerate(batch["content"]):
            raw = [xxhash.xxh3_128_digest(content[o : o + WINDOW]) for o in range(len(content) - WINDOW + 1)]
            yield r, np.frombuffer(b"".join(raw), dtype="<u8")[::2], raw

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for batch in batches:
            for _, h, _ in digests({"content": batch.column("content").to_pylist()}):
                yield h

    table = phrases.sparkSession.sparkContext.broadcast(slot_table(phrases, hashes, expected))

    def firsts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            best: dict[bytes, tuple] = {}
            ids, copies, los = batch["id"].tolist(), batch["copy"].tolist(), batch["lo"].tolist()
            for r, h, raw in digests(batch):
                for o in np.flatnonzero(in_slots(table.value, h)).tolist():
                    place = (ids[r], copies[r], los[r] + o, los[r], o)
                    if raw[o] not in best or place < best[raw[o]]:
                        best[raw[o]] = place
            if best:
                cols = list(zip(*[(w, *p) for w, p in best.items()]))
                yield pd.DataFrame({n: pd.Series(v, dtype=object) for n, v in zip(("w", "id", "copy", "start", "lo", "o"), cols)})

    found = phrases.mapInPandas(firsts, "w binary, id long, copy int, start int, lo int, o int")
    owners = found.groupBy("w").agg(F.min(F.struct("id", "copy", "start", "lo", "o")).alias("p"))
    owned = owners.groupBy(F.col("p.id").alias("id"), F.col("p.copy").alias("copy"), F.col("p.lo").alias("lo")).agg(F.collect_list("p.o").alias("owned"))

    def masks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r, h, _ in digests(batch):
                own = ~in_slots(table.value, h)
                listed = batch["owned"].iloc[r]
                if listed is not None:
                    own[np.asarray(listed, dtype=np.int64)] = True
                if not own.all():
                    out.append((*(batch[c].iloc[r] for c in ("id", "copy", "lo", "cnt")), np.packbits(own, bitorder="little").tobytes()))
            if out:
                yield pd.DataFrame({n: pd.Series(v, dtype=object) for n, v in zip(("id", "copy", "lo", "cnt", "mask"), zip(*out))})

    return phrases.join(owned, ["id", "copy", "lo"], "left").select("id", "copy", "lo", "cnt", "content", "owned").mapInPandas(masks, _MASK)


def _numbered(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, bool]:
    """(id, copy, body): copy tells rows with equal ids apart; it is 0 without a look at the texts where ids are unique."""
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("body"))
    unique = slim.where("id IS NOT NULL").groupBy("id").count().where("count > 1").isEmpty()
    return (slim.withColumn("copy", F.lit(0)) if unique else slim), unique


def repeated_spans(texts: DataFrame) -> DataFrame:
    """(id, copy, runs array<struct<lo, cnt, mask>>): the windows of each text that also start earlier.

    ``texts`` has id, copy and body.  A run without mask is wholly repeated; of one with mask, the windows whose bit is 0.
    """
    spark = texts.sparkSession
    usable = texts.where(F.col("id").isNotNull() & (F.octet_length("body") >= WINDOW)).select("id", "copy", "body")
    size = usable.agg(F.coalesce(F.sum(F.octet_length("body")), F.lit(0))).first()[0]

    coarse = stage(_coarse_rows(usable).groupBy("digest").agg(F.min(F.struct("id", "copy", "lo")).alias("p")).select("p.id", "p.copy", "p.lo"), "dedup-coarse")
    heads = spark.sparkContext.broadcast(slot_table(coarse, _places, coarse.count() + 1, 1))
    discard(coarse)

    def triggers(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for block in _blocks(batches):
            yield _fresh_phrases(block, heads.value)[0]

    table = spark.sparkContext.broadcast(repeated_table(usable, triggers, size // 34 + 1))
    parsed = stage(_phrase_rows(usable, heads, table), "dedup-parse")
    occurrences = parsed.where("k IS NOT NULL")
    phrases = stage(
        occurrences.groupBy("k", "f").agg(F.min(F.struct("id", "copy", "lo")).alias("first"))
        .select("k", "first.id", "first.copy", "first.lo"), "dedup-dictionary")
    shared = stage(phrases.groupBy("k").agg(F.count("*").alias("kinds")).where("kinds > 1"), "dedup-shared")
    total = shared.agg(F.coalesce(F.sum("kinds"), F.lit(0))).first()[0]
    several = phrases.join(shared, "k").select("id", "copy", "lo")
    wanted = spark.sparkContext.broadcast(slot_table(several, _places, total + 1, 1))
    many = shared.where(F.col("kinds") > HOT_LEAST).select("k")
    hot_keys = spark.sparkContext.broadcast(slot_table(many, _keys, many.count() + 1, 1))  # a false hit sends a whole group the other exact way

    @F.pandas_udf("boolean")
    def is_hot(keys: pd.Series) -> pd.Series:
        return pd.Series(in_slots(hot_keys.value, keys.to_numpy(np.int64).view(np.uint64)))

    found = _contents(usable, heads, wanted).join(several, ["id", "copy", "lo"], "left_semi")  # without false hits a group is as large as its kinds
    content = stage(found.withColumn("hot", is_hot("k")), "dedup-content")
    masks = stage(_cold_masks(content.where("NOT hot").drop("hot")), "dedup-masks")
    hot = content.where("hot").drop("hot")
    n_hot = hot.agg(F.coalesce(F.sum("cnt"), F.lit(0))).first()[0]
    if n_hot:
        masks = masks.union(stage(_hot_masks(hot, n_hot), "dedup-hot-masks"))
    discard(content)
    n_first = phrases.count()
    firsts = spark.sparkContext.broadcast(slot_table(phrases.select("id", "copy", "lo"), _places, n_first + 1, 1))

    @F.pandas_udf("boolean")
    def maybe_first(ids: pd.Series, copies: pd.Series, los: pd.Series) -> pd.Series:
        return pd.Series(in_slots(firsts.value, place_hashes(ids.to_numpy(), copies.to_numpy(), los.to_numpy())))

    told = occurrences.select("id", "copy", "lo", "cnt", maybe_first("id", "copy", "lo").alias("maybe"))
    doubtful = told.where("maybe").join(phrases.select("id", "copy", "lo"), ["id", "copy", "lo"], "left_anti")
    copied = parsed.where("k IS NULL").select("id", "copy", "lo", "cnt")
    later = told.where("NOT maybe").unionByName(doubtful).select("id", "copy", "lo", "cnt").union(copied).withColumn("mask", F.lit(None).cast("binary"))
    runs = later.union(masks.select("id", "copy", "lo", "cnt", "mask"))
    return runs.groupBy("id", "copy").agg(F.collect_list(F.struct("lo", "cnt", "mask")).alias("runs"))  # a document's own phrases


def removed_ranges(length: int, runs) -> np.ndarray:
    """Maximal removed byte ranges (n x 2) of a text."""
    change = np.zeros(length + 1, dtype=np.int32)
    if runs is not None:
        whole = [(r["lo"], r["lo"] + r["cnt"] - 1 + WINDOW) for r in runs if r["mask"] is None]
        for r in runs:
            if r["mask"] is not None:
                bits = np.unpackbits(np.frombuffer(r["mask"], np.uint8), count=r["cnt"], bitorder="little")
                edges = np.flatnonzero(np.diff(np.concatenate(([1], bits, [1]))))
                whole += [(r["lo"] + a, r["lo"] + b - 1 + WINDOW) for a, b in zip(edges[::2].tolist(), edges[1::2].tolist())]
        if whole:
            at = np.array(whole)
            np.add.at(change, at[:, 0], 1)
            np.add.at(change, at[:, 1], -1)
    covered = np.cumsum(change[:-1]) > 0
    edges = np.flatnonzero(np.diff(np.concatenate(([False], covered, [False])).astype(np.int8)))
    return edges.reshape(-1, 2)


def kept_bytes(raw: bytes, ranges: np.ndarray) -> bytes:
    at, out = 0, []
    for a, b in ranges.tolist():
        out.append(raw[at:a])
        at = b
    return b"".join([*out, raw[at:]])


def _raw(text) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def with_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one more column, ``__runs``: the repeated windows of the row's text."""
    text_batches(docs.sparkSession)
    texts, unique = _numbered(docs, id_col, text_col)
    if unique:
        runs = repeated_spans(texts).select(F.col("id").alias("__id"), F.col("runs").alias("__runs"))
        return docs.join(runs, docs[id_col].cast("long") == runs["__id"], "left").drop("__id")
    order = "row_number() OVER (PARTITION BY `__id` ORDER BY xxhash64(`__body`))"
    marked = stage(docs.withColumn("__id", F.col(id_col).cast("long")).withColumn("__body", F.col(text_col)).withColumn("__copy", F.expr(order)), "dedup-copies")
    runs = repeated_spans(marked.select(F.col("__id").alias("id"), F.col("__copy").alias("copy"), F.col("__body").alias("body")))
    runs = runs.select(F.col("id").alias("__id"), F.col("copy").alias("__copy"), F.col("runs").alias("__runs"))
    return marked.drop("__body").join(runs, ["__id", "__copy"], "left").drop("__id", "__copy")


def dedup_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) of every row.

    A null text counts as empty.  Rows with equal ids follow each other in order of their texts' hashes; rows with a
    null id are whole and remove nothing elsewhere.  Other columns are ignored; an empty table gives an empty result.
    """

    @F.pandas_udf("n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    def digest(texts: pd.Series, runs: pd.Series) -> pd.DataFrame:
        rows = []
        for text, listed in zip(texts, runs):
            raw = _raw(text)
            ranges = removed_ranges(len(raw), listed)
            rows.append((len(raw), int((ranges[:, 1] - ranges[:, 0]).sum()), len(ranges), hashlib.sha256(kept_bytes(raw, ranges)).hexdigest()))
        return pd.DataFrame({n: pd.Series(v, dtype=object) for n, v in zip(("n_bytes", "n_removed", "n_spans", "kept_sha256"), zip(*rows) if rows else [()] * 4)})

    slim = docs.select(F.col(id_col), F.col(text_col).alias("__text"))
    return with_runs(slim, id_col, "__text").select(id_col, digest("__text", "__runs").alias("d")).select(id_col, "d.*")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the repeated bytes cut out of the texts; parts of characters at a cut go too.  Null texts stay null."""

    @F.pandas_udf("string")
    def cut(texts: pd.Series, runs: pd.Series) -> pd.Series:
        return pd.Series([t if t is None or r is None else kept_bytes(_raw(t), removed_ranges(len(_raw(t)), r)).decode("utf-8", "ignore")
                          for t, r in zip(texts, runs)], dtype=object)

    return with_runs(docs, id_col, text_col).withColumn(text_col, cut(text_col, F.col("__runs"))).select(*docs.columns)


def op3_prefix_free(spark, sf_dir: str) -> DataFrame:
    """What is removed from every document as repeated 100-byte passages."""
    return dedup_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
