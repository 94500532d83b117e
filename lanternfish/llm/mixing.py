"""Language-model scores by online logistic context mixing.

A text is coded as its UTF-8 bytes and one end byte, bit by bit.  Several predictors look up, in tables of hashed
contexts, how often the next bit was 0 and 1 in the training texts.  Their log odds are combined by weights that a gate
chooses (how often the longer contexts were seen), and a refinement table corrects the result; weights and table are learned
online, each part of the training texts from a fresh start, and averaged.  While scoring they stand still, so that a score
depends neither on the order nor on the place of rows.

Of running texts (which the query scores) contexts are the last one to four and six bytes and all bytes since the last white
space, wherever in the text they stand.  Tasks read whole texts; where all contexts and the byte are those of an event still
remembered, its cost is taken from there.

Of segments, the bytes up to and with the next white space, contexts do not reach further back (nor further than ``PIECE``
bytes), so a segment always costs the same bits.  Segments of all texts are counted by a Spark aggregation; every distinct one is
coded once, by whichever task has it, and costs reach the texts by a join (the commonest by a broadcast of fixed size).  Words
of running texts are counted the same way for the base.

Counts are over all training texts: all of them fill the tables, whose size grows with the segments' up to ``MOST_BITS``, and
teach the mixer.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from lanternfish.llm import text_contexts
from lanternfish.llm.frames import text_blocks
from lanternfish.plans.staging import discard, stage

END = 0xFF  # never a byte of UTF-8
ORDER_BITS = (16, 20, 21, 22)  # cells of the order 1 to 4 contexts, as powers of two
TEXT_ORDER_BITS = (*ORDER_BITS, 22)  # in whole texts, of order 1, 2, 3, 4 and 6
LEAST_BITS, MOST_BITS = 16, 23  # of the segment contexts
KINDS = len(ORDER_BITS) + 1
PIECE = 256  # bytes of a segment after which its contexts begin anew
CUT = 1 << 16  # bytes coded at a time
PART = 1 << 17
TEXT_BYTES = 2 << 20
SCORED_BYTES = 1 << 20  # of texts, scored at a time
FILL_SEGMENTS = 500_000  # in a task that fills tables
COMMON = 100_000  # segments whose costs are broadcast
HELD_SEGMENTS, HELD_BYTES = 600_000, 48 << 20  # counted in a task before they are sent on
COMMON_BYTES = 64  # of a segment whose costs may be broadcast
LEARN_SEGMENTS = 1 << 18  # of each part that the mixer learns from in a pass of its own
LEARN_BYTES = 8 << 20  # of whole texts, in each part that the mixer learns from
DISTINCT_BYTES = 1 << 20  # of whole texts, whose events are counted before they fill tables
FILL_BYTES = 48 << 20  # of whole texts in a task that fills tables
EVENTS = 1 << 13  # coded at a time
KNOWN_BITS = 21  # places for events met before, as a power of two
STEPS = 2048  # of log odds of 16 bits
_K = 0x9E3779B97F4A7C15 | 1
_MIX = np.uint64(0xD6E8FEB86659FD93)
_DELTA = np.float32(0.4)
_GATES = 5 * 4
_APM = 33

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_POWERS = np.cumprod(np.full(2 * CUT, _K, dtype=np.uint64))
_INVERSES = np.cumprod(np.full(2 * CUT, pow(_K, -1, 1 << 64), dtype=np.uint64))


def joined(texts: list[bytes]) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """The bytes of all texts with an end byte behind each, their segments in order, and the text that each belongs to.

    A segment ends behind a white-space or end byte.
    """
    data = np.frombuffer(b"\xff".join(texts) + b"\xff", dtype=np.uint8)
    ends = np.flatnonzero(_SPACE[data] | (data == END)) + 1
    offsets = np.concatenate(([0], ends)).astype(np.int32)
    segs = pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    closes = data[ends - 1] == END
    return data, segs, np.cumsum(closes) - closes


def pieces(segs: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Bytes, offsets and owners of the pieces of segments, about ``CUT`` bytes at a time."""
    held, owners, size = [], [], 0
    for k, seg in enumerate(segs):
        for a in range(0, len(seg), PIECE):
            held.append(seg[a : a + PIECE])
            owners.append(k)
            size += len(held[-1])
            if size >= CUT:
                yield _flat(held, owners)
                held, owners, size = [], [], 0
    if held:
        yield _flat(held, owners)


def _flat(held: list[bytes], owners: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(held), np.uint8), np.cumsum([0, *map(len, held)]), np.array(owners)


def contexts(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """For each kind of context a 64-bit hash at every byte of the pieces, from earlier bytes of the same piece."""
    starts = np.repeat(offsets[:-1], np.diff(offsets))
    at = np.arange(len(data))
    seen = at - starts
    out = []
    past = np.zeros(len(data), dtype=np.uint64)
    for order in range(1, KINDS):
        back = np.zeros(len(data), dtype=np.uint64)
        back[order:] = data[:-order]
        back = np.where(seen >= order, back + np.uint64(1), np.uint64(0))
        past = past | (back << np.uint64(9 * (order - 1)))
        out.append((past * _MIX) ^ (past >> np.uint64(7)))
    sums = np.zeros(len(data) + 1, dtype=np.uint64)  # of byte times power, so that a range's hash does not depend on its place
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _POWERS[: len(data)], out=sums[1:])
    h = (sums[at] - sums[starts]) * _INVERSES[starts]
    h ^= seen.astype(np.uint64) * _MIX
    h ^= h >> np.uint64(29)
    out.append(h * _MIX)
    return out


def cells(data: np.ndarray, offsets: np.ndarray, sizes: tuple[int, ...]) -> tuple[list[np.ndarray], np.ndarray]:
    """The table cell of each kind for every bit of the pieces' bytes, and the bits."""
    return placed(contexts(data, offsets), data, sizes)


def _spread() -> np.ndarray:
    """For each byte what sets its eight cells apart: those of either half of the byte stand in 16 neighbouring cells."""
    far = (np.random.default_rng(10).permutation(1 << LEAST_BITS - 4)[:16] << 4).astype(np.int64)
    byte = np.arange(256)
    half = lambda nibble: [(1 << j) | (nibble >> (4 - j)) for j in range(4)]
    return np.stack([*half(byte >> 4), *(far[byte >> 4] ^ low for low in half(byte & 15))], axis=1)


_SPREAD = _spread()
_BITS = (np.arange(256, dtype=np.uint8)[:, None] >> np.arange(7, -1, -1, dtype=np.uint8)[None, :]) & 1


def placed(hashes: list[np.ndarray], data: np.ndarray, sizes: tuple[int, ...]) -> tuple[list[np.ndarray], np.ndarray]:
    """The table cell of each kind, given by its hashes, for every bit, most significant first, and the bits; arrays of bytes x 8.

    As cells are set apart by exclusive or with the hash, contexts that share 16 neighbours use all of them."""
    spread = _SPREAD.take(data, axis=0)
    return [((h * _MIX) >> np.uint64(64 - size)).view(np.int64)[:, None] ^ spread for h, size in zip(hashes, sizes)], _BITS.take(data, axis=0)


def packed_counts(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Both counts of a cell in one 32-bit number; a cell whose larger count passes 65,535 keeps the ratio."""
    scale = np.maximum(1.0, np.maximum(zeros, ones) / 65535.0)
    up = lambda x: np.minimum(65535, np.ceil(x / scale)).astype(np.uint32)
    return (up(zeros) << np.uint32(16)) | up(ones)


_LOGS = np.log(np.arange(65536, dtype=np.float32) + _DELTA)
_SEEN_SEGMENT = np.minimum(4, np.ceil(np.log2(np.arange(131072) + 1) / 2)).astype(np.int64)
_SEEN_ORDER3 = np.minimum(3, np.ceil(np.log2(np.arange(131072) + 1) / 3)).astype(np.int64)


@dataclass
class Odds:
    """What tables of packed counts say: log odds of every cell and, of the last two kinds, how often it was seen.

    With ``own`` one occurrence of the bit is left out, where it has been counted; a cell then holds two log odds of 16 bits, for
    either bit, in steps of 1 / ``STEPS`` (only learning takes them)."""

    values: list[np.ndarray]
    seen: list[np.ndarray]
    own: bool

    @classmethod
    def of(cls, tables: Iterable[np.ndarray], own: bool = False) -> "Odds":
        values, seen = [], []
        for table in tables:
            values.append(np.empty(len(table), np.uint32 if own else np.float32))
            seen = [*seen[-1:], np.empty(len(table), np.uint8)]
            for a in range(0, len(table), PART):
                pair = table[a : a + PART]
                zeros, ones = (pair >> np.uint32(16)).view(np.int32), (pair & np.uint32(0xFFFF)).view(np.int32)
                if own:
                    less = [_LOGS.take(x) - _LOGS.take(np.maximum(y - 1, 0)) for x, y in ((ones, zeros), (zeros, ones))]
                    low, high = (np.rint(x * STEPS).astype(np.int16).view(np.uint16).astype(np.uint32) for x in (less[0], -less[1]))
                    values[-1][a : a + PART] = low | (high << np.uint32(16))
                else:
                    values[-1][a : a + PART] = _LOGS.take(ones) - _LOGS.take(zeros)
                seen[-1][a : a + PART] = np.minimum(255, np.maximum(zeros + ones - own, 0))  # classes end far below
        return cls(values, [_SEEN_ORDER3[:256].astype(np.uint8).take(seen[0]), (4 * _SEEN_SEGMENT[:256]).astype(np.uint8).take(seen[1])], own)

    @property
    def sizes(self) -> tuple[int, ...]:
        return tuple(len(t).bit_length() - 1 for t in self.values)

    def inputs(self, where: list[np.ndarray], bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log odds of every predictor and the constant (kinds + 1 x bits), and the gate."""
        flat = [at.reshape(-1) for at in where]
        x = np.ones((len(flat) + 1, bits.size), dtype=np.float32)
        if self.own:
            shift = bits.reshape(-1).astype(np.uint32) << np.uint32(4)
            for row, table, at in zip(x, self.values, flat):
                row[:] = (table.take(at) >> shift).astype(np.uint16).view(np.int16)
            x[:-1] *= np.float32(1 / STEPS)
        else:
            for row, table, at in zip(x, self.values, flat):
                table.take(at, out=row, mode="clip")  # no place is out of range, and "raise" would copy
        return x, (self.seen[0].take(flat[-2]) + self.seen[1].take(flat[-1])).astype(np.int64)


def _squash(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.minimum(np.maximum(z, -20.0), 20.0)))


@dataclass
class Mixer:
    """Weights for each gate and, for each gate, the refined probability at 33 points of the mixed log odds."""

    weights: np.ndarray
    refined: np.ndarray

    @classmethod
    def fresh(cls, kinds: int = KINDS) -> "Mixer":
        points = np.linspace(-8, 8, _APM)
        return cls(np.full((_GATES, kinds + 1), 0.3), np.tile(_squash(points), (_GATES, 1)))

    def _slots(self, z: np.ndarray, gate: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of each bit in the refinement table, and how far it is to the next."""
        place = np.minimum(np.maximum((z + 8) * 2, 0), _APM - 1 - 1e-6)
        low = place.astype(np.int64)
        return gate * _APM + low, place - low

    def mixed(self, x: np.ndarray, gate: np.ndarray) -> np.ndarray:
        """The weighted sum of every bit's inputs."""
        total = np.zeros(len(gate), np.float32)
        for row, weights in zip(x, np.ascontiguousarray(self.weights.T, dtype=np.float32)):
            part = weights.take(gate)
            part *= row
            total += part
        return total.astype(np.float64)

    def chances(self, x: np.ndarray, gate: np.ndarray, bits: np.ndarray) -> np.ndarray:
        """Probability of every bit."""
        z = self.mixed(x, gate)
        cell, part = self._slots(z, gate)
        flat = self.refined.reshape(-1)
        low = flat.take(cell)
        fine = low + (flat.take(cell + 1) - low) * part
        p = np.minimum(np.maximum(0.5 * _squash(z) + 0.5 * fine, 1e-6), 1 - 1e-6)
        return np.abs(p - 1 + bits)

    def learn(self, x: np.ndarray, gate: np.ndarray, bits: np.ndarray, weight: np.ndarray, rate: float, batch: int = 8192) -> None:
        """One online pass: gradient steps on the weights and moves of the refinement table, a small batch at a time."""
        flat = self.refined.reshape(-1)
        for a in range(0, len(bits), batch):
            xs, g, y, w = x[:, a : a + batch], gate[a : a + batch], bits[a : a + batch], weight[a : a + batch]
            z = self.mixed(xs, g)
            share = rate / np.maximum(np.bincount(g, weights=w, minlength=_GATES), 1e-300)
            pull = (y - _squash(z)) * w
            for k, row in enumerate(xs):
                self.weights[:, k] += share * np.bincount(g, weights=pull * row, minlength=_GATES)
            cell, part = self._slots(z, g)
            far = w * part
            for place, near in ((cell, w - far), (cell + 1, far)):
                total = np.bincount(place, weights=near, minlength=flat.size)
                right = np.bincount(place, weights=near * y, minlength=flat.size)
                moved = total > 0
                step = np.minimum(0.5, 0.02 * total[moved] / np.mean(w))
                flat[moved] += step * (right[moved] / total[moved] - flat[moved])


_UNPACKED: dict[tuple[str, bool], Odds] = {}


@dataclass
class Packed:
    """Tables as they are broadcast: compressed, and unpacked once by each worker."""

    name: str
    planes: list[bytes]

    @classmethod
    def of(cls, tables: Iterable[np.ndarray]) -> "Packed":
        press = zstandard.ZstdCompressor(level=3)
        return cls(uuid.uuid4().hex, [press.compress(t.tobytes()) for t in tables])

    def tables(self) -> Iterator[np.ndarray]:
        unpress = zstandard.ZstdDecompressor()
        return (np.frombuffer(unpress.decompress(p), np.uint32) for p in self.planes)

    def odds(self, own: bool = False) -> Odds:
        if (self.name, own) not in _UNPACKED:
            forget()
            _UNPACKED[self.name, own] = Odds.of(self.tables(), own)
        return _UNPACKED[self.name, own]


def forget() -> None:
    """Let go of what this worker holds of tables that earlier tasks have read, and give back what is free."""
    _UNPACKED.clear()
    _KNOWN.clear()
    trim()


def trim() -> None:
    """Give memory back that earlier tasks in this worker have freed: Arrow's, and (through the system's pool) numpy's."""
    pa.default_memory_pool().release_unused()
    pa.system_memory_pool().release_unused()


@dataclass
class Model:
    tables: Odds | Iterable[np.ndarray]  # or packed counts
    mixer: Mixer

    def __post_init__(self):
        if not isinstance(self.tables, Odds):
            self.tables = Odds.of(self.tables)

    def _coded(self, where: list[np.ndarray], bits: np.ndarray) -> np.ndarray:
        """log10 probability of every byte."""
        p = self.mixer.chances(*self.tables.inputs(where, bits), bits.reshape(-1)).reshape(-1, 8)
        return np.log10(p.prod(axis=1))  # 1e-48 at least

    def costs(self, segs: list[bytes]) -> np.ndarray:
        """log10 probability of every segment."""
        out = np.zeros(len(segs))
        for data, offsets, owners in pieces(segs):
            np.add.at(out, owners, np.add.reduceat(self._coded(*cells(data, offsets, self.tables.sizes)), offsets[:-1]))
        return out

    def event_costs(self, found: text_contexts.Events) -> np.ndarray:
        """log10 probability of every event's byte."""
        out = np.zeros(len(found.data))
        for a in range(0, len(out), EVENTS):
            some = found.take(slice(a, a + EVENTS))
            out[a : a + EVENTS] = self._coded(*placed(some.hashes(), some.data, self.tables.sizes))
        return out

    def text_costs(self, texts: list[bytes], known: "Known") -> np.ndarray:
        """log10 probability of every whole text; events that ``known`` still has are not coded again."""
        out, at = np.zeros(len(texts)), 0
        for found in text_contexts.events(text_contexts.stream(texts)):
            costs = known.costs(found, self.event_costs)
            ends = np.flatnonzero(found.data == END)
            text = at + np.repeat(np.arange(len(ends) + 1), np.diff([0, *(ends + 1), len(costs)]))
            out += np.bincount(text, weights=costs, minlength=len(texts) + 1)[: len(texts)]
            at += len(ends)
        return out


class Places:
    """Something held for each event met before, at the place its key gives, which the last to come keeps."""

    def __init__(self, kind: type, bits: int = KNOWN_BITS):
        self.shift = np.uint64(64 - bits)
        self.keys, self.held = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, kind)
        self.keys[0] = ~np.uint64(0)  # whose own place is the last one

    def look(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of every key, and which keys are not there."""
        place = (keys >> self.shift).view(np.int64)
        return place, np.flatnonzero(self.keys.take(place) != keys)

    def put(self, place: np.ndarray, keys: np.ndarray, values: np.ndarray) -> None:
        last = text_contexts.distinct(place[::-1])[0]  # of several at one place, so that key and value are of the same
        at = len(place) - 1 - last
        self.keys[place[at]], self.held[place[at]] = keys[at], values[at]


class Known(Places):
    """Costs of events coded before: only time depends on which are still there."""

    def costs(self, found: text_contexts.Events, code: Callable[[text_contexts.Events], np.ndarray]) -> np.ndarray:
        place, new = self.look(found.keys)
        out = self.held.take(place)
        if len(new):
            first, _, number = text_contexts.distinct(found.keys[new])
            some = found.take(new[first])
            coded = code(some)
            out[new] = coded[number]
            self.put(place[new[first]], some.keys, coded)
        return out

    @classmethod
    def of(cls, name: str) -> "Known":
        """This worker's, for the tables of that name."""
        if name not in _KNOWN:
            _KNOWN.clear()
            _KNOWN[name] = cls(np.float64)
        return _KNOWN[name]


_KNOWN: dict[str, Known] = {}


def count_segments(docs: DataFrame) -> DataFrame:
    """(seg binary, n, n_all): every segment of the texts (body, learn) with its occurrences in training texts and in all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        held, size, in_bytes = [], 0, 0
        for batch in batches:
            for part in text_blocks(batch, "body", TEXT_BYTES):
                _, segs, text = joined(part.column("body").cast(pa.large_binary()).to_pylist())
                known = segs.dictionary_encode()
                index = known.indices.to_numpy()
                learn = part.column("learn").to_numpy(zero_copy_only=False)
                held.append((known.dictionary, np.bincount(index[learn[text]], minlength=len(known.dictionary)), np.bincount(index, minlength=len(known.dictionary))))
                size, in_bytes = size + len(known.dictionary), in_bytes + known.dictionary.nbytes
                if size > HELD_SEGMENTS or in_bytes > HELD_BYTES:
                    yield merged(held)
                    held, size, in_bytes = [], 0, 0
        if held:
            yield merged(held)

    def merged(held: list) -> pa.RecordBatch:
        known = pa.concat_arrays([h[0] for h in held]).dictionary_encode()
        index = known.indices.to_numpy()
        add = lambda k: pa.array(np.bincount(index, weights=np.concatenate([h[k] for h in held]), minlength=len(known.dictionary)).astype(np.int64))
        return pa.RecordBatch.from_arrays([known.dictionary, add(1), add(2)], ["seg", "n", "n_all"])

    return docs.mapInArrow(run, "seg binary, n long, n_all long").groupBy("seg").agg(F.sum("n").alias("n"), F.sum("n_all").alias("n_all"))


def segment_bits(bytes_in_all: int) -> int:
    """Cells of the segment contexts, as a power of two: two for each byte of the distinct training segments, within bounds."""
    return min(MOST_BITS, max(LEAST_BITS, (2 * bytes_in_all).bit_length()))


def fill_tables(segs: DataFrame) -> Iterator[np.ndarray]:
    """The cells' counts over all training segments (seg, n): filled in parallel and summed part by part."""
    rows, total, distinct = segs.agg(F.count("*"), F.coalesce(F.sum(F.col("n") * F.length("seg")), F.lit(0)), F.coalesce(F.sum(F.length("seg")), F.lit(0))).first()
    sizes = (*ORDER_BITS, segment_bits(distinct))
    whole = np.uint32 if total < 2**32 else np.uint64

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        held = [np.zeros(2 << size, dtype=whole) for size in sizes]
        for batch in batches:
            weights = batch.column("n").to_numpy().astype(whole)
            for data, offsets, owners in pieces(batch.column("seg").to_pylist()):
                where, bits = cells(data, offsets, sizes)
                n = np.repeat(weights[owners], np.diff(offsets) * 8)
                for table, at in zip(held, where):
                    np.add.at(table, 2 * at.reshape(-1) + bits.reshape(-1), n)
        yield from sent(held)

    tasks = max(1, -(-rows // FILL_SEGMENTS))
    return summed(segs.coalesce(tasks).mapInArrow(fill, COUNTS), sizes, whole)


def fill_text_tables(texts: DataFrame, size: int, distinct: int) -> Iterator[np.ndarray]:
    """The cells' counts over all whole training texts (seg binary), ``size`` bytes of them, whose distinct segments hold ``distinct``."""
    sizes = (*TEXT_ORDER_BITS, segment_bits(distinct))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        empty = lambda: [np.zeros(2 << bits, dtype=np.uint32) for bits in sizes]
        held, filled = empty(), 0
        blocks = (part.column("seg").to_pylist() for batch in batches for part in text_blocks(batch, "seg", TEXT_BYTES))
        for some, n in counted_events(chain.from_iterable(text_contexts.events(text_contexts.stream(b)) for b in blocks), DISTINCT_BYTES):
            for k, begins in enumerate(some.begins()):
                add_context(k, held[k], begins, some.data, n)
            filled += int(n.sum())
            some = begins = None  # not held while the next are found
            if filled >= 2**31:  # before a count could pass 32 bits
                yield from sent(held)
                held, filled = empty(), 0
        yield from sent(held)

    tasks = max(min(8, -(-size // LEARN_BYTES)), -(-size // FILL_BYTES), 1)
    return summed(texts.coalesce(tasks).mapInArrow(fill, COUNTS), sizes, np.uint32)


def add_context(kind: int, table: np.ndarray, begins: np.ndarray, data: np.ndarray, n: np.ndarray) -> None:
    """Count ``n`` occurrences of each byte behind its context of one kind."""
    if kind != len(text_contexts.ORDERS) - 1:  # of the longest few occur again
        first, n, _ = text_contexts.distinct(begins * np.uint64(_K) + data, n)
        begins, data = begins[first], data[first]
    for a in range(0, len(data), EVENTS):
        at = slice(a, a + EVENTS)
        (where,), bits = placed([text_contexts.hashed(kind, begins[at])], data[at], (len(table).bit_length() - 2,))
        np.add.at(table, 2 * where.reshape(-1) + bits.reshape(-1), np.repeat(n[at].astype(np.uint32), 8))


def counted_events(found: Iterator[text_contexts.Events], size: int) -> Iterator[tuple[text_contexts.Events, np.ndarray]]:
    """Distinct events in order of first occurrence and how often they occur, of about ``size`` bytes at a time.

    An event whose place another has taken may come again with the rest of its count."""
    bits = max(1, min(KNOWN_BITS, size.bit_length() - 2))
    met, held, total, upto = Places(np.int32, bits), [], 0, 0
    for some in found:
        place, new = met.look(some.keys)
        old = np.ones(len(place), bool)
        old[new] = False
        first, n, _ = text_contexts.distinct(some.keys[new])
        if not held:
            times = np.zeros(size + text_contexts.STRETCH, np.int64)
        np.add.at(times, met.held[place[old]], 1)
        times[upto : upto + len(n)] = n
        held.append(some.take(new[first]))
        met.put(place[new[first]], held[-1].keys, np.arange(upto, upto + len(n)))
        total, upto = total + len(some.data), upto + len(n)
        if total >= size:
            block = text_contexts.Events.joined(held), times[:upto]
            met = times = None  # not held while the block is used
            held, total, upto = [], 0, 0
            yield block
            block, met = None, Places(np.int32, bits)
    if held:
        yield text_contexts.Events.joined(held), times[:upto]


COUNTS = "kind int, part int, counts binary"


def sent(tables: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Filled tables (twice as many counts as cells) in parts."""
    press = zstandard.ZstdCompressor(level=1)
    for k, table in enumerate(tables):
        for a in range(0, len(table), 2 * PART):
            if table[a : a + 2 * PART].any():
                counts = press.compress(table[a : a + 2 * PART].tobytes())  # whole, so that sums do not depend on their order
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([a // (2 * PART)], pa.int32()), pa.array([counts], pa.binary())], ["kind", "part", "counts"])


def summed(filled: DataFrame, sizes: tuple[int, ...], whole: type) -> Iterator[np.ndarray]:
    """The tables whose parts (``COUNTS``, of numbers of that type) tasks have filled."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        unpress = zstandard.ZstdDecompressor()
        for batch in batches:
            for k, part, counts in zip(*(batch.column(c).to_pylist() for c in ("kind", "part", "counts"))):
                got = np.frombuffer(unpress.decompress(counts), whole)
                sums[k, part] = sums[k, part] + got if (k, part) in sums else got.astype(np.float64)
        for (k, part), both in sums.items():
            pairs = packed_counts(both[::2], both[1::2]).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([part], pa.int32()), pa.array([pairs], pa.binary())], ["kind", "part", "pairs"])

    parts = stage(filled.repartition("kind", "part").mapInArrow(add, "kind int, part int, pairs binary"), "mixing-tables")
    for kind, size in enumerate(sizes):
        table = np.zeros(1 << size, dtype=np.uint32)
        for r in parts.where(F.col("kind") == kind).collect():  # 32 MB at most, set by the sizes
            got = np.frombuffer(r["pairs"], np.uint32)
            table[r["part"] * PART : r["part"] * PART + len(got)] = got
        yield table
    discard(parts)


def regrouped(batches: Iterator[pa.RecordBatch], size: int = CUT) -> Iterator[tuple[int, list[bytes], np.ndarray]]:
    """(part, segments, n) of rows (part, seg, n) that stand in order of part: runs of about ``size`` bytes of one part, wherever
    batches end."""
    part, held, times, total = None, [], [], 0
    for batch in batches:
        for p, seg, n in zip(*(batch.column(c).to_pylist() for c in ("part", "seg", "n"))):
            if held and (p != part or total >= size):
                yield part, held, np.array(times, np.float64)
                held, times, total = [], [], 0
            part = p
            held.append(seg)
            times.append(n)
            total += len(seg)
    if held:
        yield part, held, np.array(times, np.float64)


def fit_mixer(segs: DataFrame, tables, rate: float = 0.05) -> Mixer:
    """One online pass over each part of the training segments (seg, n), averaged by bytes learned from.

    Parts are dealt by the segments' hashes, as many as the number of segments asks for, and each is read in order of another
    hash: what is learned depends on the segments alone, not on partitions, retries or the cluster.  One occurrence of a
    segment is left out of the counts that predict it; it weighs as the root of its occurrences.  ``tables`` is a broadcast of
    packed ones.
    """
    parts = max(8, -(-segs.count() // LEARN_SEGMENTS))
    dealt = segs.select(F.pmod(F.xxhash64("seg"), F.lit(parts)).cast("int").alias("part"), "seg", "n", F.hash("seg").alias("h"))
    dealt = dealt.repartition(parts, "part").sortWithinPartitions("part", "h", "seg").select("part", "seg", "n")

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        odds = tables.value.odds(own=True)
        current, mixer, size = None, None, 0

        def learned() -> pa.RecordBatch:
            columns = [pa.array([current]), pa.array([mixer.weights.tobytes()], pa.binary()), pa.array([mixer.refined.tobytes()], pa.binary()), pa.array([size])]
            return pa.RecordBatch.from_arrays([columns[0].cast(pa.int32()), *columns[1:]], ["part", "weights", "refined", "size"])

        for part, held, times in regrouped(batches):
            if part != current:
                if size:
                    yield learned()
                current, mixer, size = part, Mixer.fresh(), 0
            n = np.sqrt(times)
            for data, offsets, owners in pieces(held):
                where, bits = cells(data, offsets, odds.sizes)
                weight = np.repeat(n[owners], np.diff(offsets) * 8)
                size += len(data)
                mixer.learn(*odds.inputs(where, bits), bits.reshape(-1).astype(float), weight, rate * min(1.0, 4 * CUT / size) + 0.002)
        if size:
            yield learned()

    return averaged(dealt.mapInArrow(fit, LEARNED), KINDS)


def fit_text_mixer(texts: DataFrame, size: int, tables, rate: float = 0.05) -> Mixer:
    """As ``fit_mixer``, over whole training texts (id, seg binary) of ``size`` bytes in all.

    Parts of about ``LEARN_BYTES`` are dealt by the hash of id and text and read in order of another.  What occurs again in a
    part is learned at its first place, weighing as all its occurrences.
    """
    parts = max(8, -(-size // LEARN_BYTES))
    dealt = texts.select(F.pmod(F.xxhash64("id", "seg"), F.lit(parts)).cast("int").alias("part"), "seg", F.lit(1).alias("n"), F.hash("id", "seg").alias("h"))
    dealt = dealt.repartition(parts, "part").sortWithinPartitions("part", "h", "seg").select("part", "seg", "n")

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        odds = tables.value.odds(own=True)
        for part, runs in groupby(regrouped(batches, TEXT_BYTES), key=lambda r: r[0]):
            mixer, size = Mixer.fresh(len(odds.sizes)), 0
            found = chain.from_iterable(text_contexts.events(text_contexts.stream(held)) for _, held, _ in runs)
            for some, n in counted_events(found, LEARN_BYTES):
                size += int(n.sum())
                done = 0
                for a in range(0, len(n), EVENTS):
                    few, weight = some.take(slice(a, a + EVENTS)), np.repeat(n[a : a + EVENTS].astype(float), 8)
                    where, bits = placed(few.hashes(), few.data, odds.sizes)
                    done += len(few.data)
                    mixer.learn(*odds.inputs(where, bits), bits.reshape(-1).astype(float), weight, rate * min(1.0, 4 * CUT / done) + 0.002)
            yield pa.RecordBatch.from_arrays([
                pa.array([part], pa.int32()), pa.array([mixer.weights.tobytes()], pa.binary()), pa.array([mixer.refined.tobytes()], pa.binary()), pa.array([size])],
                ["part", "weights", "refined", "size"])

    return averaged(dealt.mapInArrow(fit, LEARNED), len(TEXT_ORDER_BITS) + 1)


LEARNED = "part int, weights binary, refined binary, size long"


def averaged(learned: DataFrame, kinds: int) -> Mixer:
    """The mean of what the parts (``LEARNED``) have learned, by bytes learned from."""
    found = sorted(learned.collect(), key=lambda r: r["part"])  # six kilobytes a part
    mixer = Mixer.fresh(kinds)
    if found:
        share = [r["size"] for r in found]
        mean = lambda c, like: np.average([np.frombuffer(r[c]).reshape(like.shape) for r in found], axis=0, weights=share)
        mixer = Mixer(mean("weights", mixer.weights), mean("refined", mixer.refined))
    return mixer


def word_counts(segs: DataFrame) -> DataFrame:
    """(word, c): ASCII-lower-cased words of counted segments (seg, n); the empty word stands for the end of a text."""
    ended = F.substring("seg", F.length("seg"), F.lit(1)) == F.lit(bytes([END]))
    words = segs.select(_word("seg").alias("word"), "n").where(F.col("word") != "")
    ends = segs.where(ended).select(F.lit("").alias("word"), "n")
    return words.union(ends).groupBy("word").agg(F.sum("n").alias("c"))


def count_threshold(counted: DataFrame, count_col: str, limit: int) -> int:
    """The smallest count such that at most ``limit`` rows have it or a larger one; read off the histogram of counts."""
    total, least = 0, 1
    for r in counted.groupBy(count_col).count().orderBy(F.desc(count_col)).toLocalIterator():
        total += r["count"]
        if total > limit:
            return r[count_col] + 1
        least = r[count_col]
    return least


def _word(seg: str) -> Column:
    """The ASCII-lower-cased word of a segment; empty if it is white space or an end alone."""
    return F.translate(F.substring(seg, 1, F.length(seg) - 1).cast("string"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def coded_segments(segs: DataFrame, words: DataFrame, tables, mixer: Mixer) -> DataFrame:
    """(seg, n_all, cost, base, known): of every segment its log10 probability, the sum of log10(count + 1) of its tokens (its
    word, and the end of the text behind it) and how many of them are known.  ``tables`` is a broadcast of packed ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(tables.value.odds(), mixer)
        for batch in batches:
            costs = model.costs(batch.column("seg").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("seg"), batch.column("n_all"), pa.array(costs)], ["seg", "n_all", "cost"])

    return with_base(segs.select("seg", "n_all").mapInArrow(run, "seg binary, n_all long, cost double"), words)


def with_base(coded: DataFrame, words: DataFrame) -> DataFrame:
    """Segments (seg, n_all, cost) with ``base`` and ``known``."""
    end = words.where("word = ''").agg(F.coalesce(F.max("c"), F.lit(0))).first()[0]
    coded = coded.withColumn("word", _word("seg"))
    ended = (F.substring("seg", F.length("seg"), F.lit(1)) == F.lit(bytes([END]))).cast("int")
    found = coded.join(words.where("word != ''"), "word", "left")
    return found.select(
        "seg", "n_all", "cost", (F.log10(F.coalesce("c", F.lit(0)) + 1) + ended * F.log10(F.lit(end + 1.0))).alias("base"),
        (F.col("c").isNotNull().cast("int") + ended * int(end > 0)).cast("long").alias("known"))


def score_texts(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", running: bool = False) -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte), log10 probabilities of whole texts.

    ``learn`` is a condition on the id column; the other rows (and those with a null id) are held out.  The base adds one to
    the count of each ASCII-lower-cased word or end in the training rows.  Null texts count as empty: one end.  Repeated rows
    are scored each, and count twice in training.  Without training rows the base is uniform over nothing seen (log10 of 1
    for a vocabulary of none) and the model gives even bits.  Bits a byte count
    the end as a byte.  With ``running`` contexts are those of the running text, which reach over white space (and six bytes
    back), so that the order of words counts; without, a text's score is the sum of its segments' costs.  A text is held whole in a task; besides it, memory is bounded by bytes.
    """
    spark = docs.sparkSession
    keyed = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("body"), F.coalesce(learn, F.lit(False)).alias("learn"))
    segs = stage(count_segments(keyed.select("body", "learn")), "mixing-segments")
    training = segs.where("n > 0")
    words = stage(word_counts(training), "mixing-words")
    n_train, vocabulary = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    if running:
        texts = keyed.where("learn").select("id", F.col("body").cast("binary").alias("seg"))
        size, distinct = training.agg(F.coalesce(F.sum(F.col("n") * F.length("seg")), F.lit(0)), F.coalesce(F.sum(F.length("seg")), F.lit(0))).first()
        tables = spark.sparkContext.broadcast(Packed.of(fill_text_tables(texts, size, distinct)))
        mixer = fit_text_mixer(texts, size, tables)
        coded = stage(with_base(segs.select("seg", "n_all", F.lit(0.0).alias("cost")), words), "mixing-coded")
    else:
        tables = spark.sparkContext.broadcast(Packed.of(fill_tables(training)))
        coded = stage(coded_segments(segs, words, tables, fit_mixer(training, tables)), "mixing-coded")
        tables.destroy()
        tables = mixer = None  # tasks that put scores together need neither
    discard(segs)
    short = F.length("seg") <= COMMON_BYTES
    least = count_threshold(coded.where(short), "n_all", COMMON)
    often = short & (F.col("n_all") >= least)
    common = coded.where(often).select("seg", "cost", "base", "known").toArrow()  # at most ``COMMON`` rows of ``COMMON_BYTES``
    shared = spark.sparkContext.broadcast((common["seg"].combine_chunks(), *(common[c].to_numpy() for c in ("cost", "base", "known"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim()
        listed, cost, base, known = shared.value
        if running:
            model, coded_before = Model(tables.value.odds(), mixer), Known.of(tables.value.name)
        serial = TaskContext.get().partitionId() << 40
        none = lambda kind, n: pa.nulls(n, kind)
        for batch in batches:
            for part in text_blocks(batch, "body", SCORED_BYTES):
                texts = part.column("body").cast(pa.large_binary()).to_pylist()
                data, segs, text = joined(texts)
                coded = segs.dictionary_encode()
                place = pc.index_in(coded.dictionary, value_set=listed).fill_null(-1).to_numpy()
                index = coded.indices.to_numpy()
                at, n = place[index], len(texts)
                hit = at >= 0
                add = lambda values: pa.array(np.bincount(text[hit], weights=values[at[hit]], minlength=n))  # noqa: B023, E731
                long = np.diff(np.frombuffer(segs.buffers()[1], np.int32)) > 1
                whole = model.text_costs(texts, coded_before) if running else add(cost)
                rows = serial + np.arange(n)
                serial += n
                yield pa.RecordBatch.from_arrays([
                    pa.array(rows), part.column("id"), none(pa.binary(), n), pa.array(np.bincount(text, weights=long, minlength=n).astype(np.int64) + 1),
                    pa.array(np.array([len(t) for t in texts], np.int64)), whole, add(base), add(known)], NAMES)
                pair, times = np.unique(text[~hit].astype(np.int64) * len(place) + index[~hit], return_counts=True)
                for a in range(0, len(pair), 200_000):
                    some, m = pair[a : a + 200_000], len(pair[a : a + 200_000])
                    yield pa.RecordBatch.from_arrays([
                        pa.array(rows[some // len(place)]), none(pa.int64(), m), coded.dictionary.take(pa.array(some % len(place))), pa.array(times[a : a + m]),
                        *[none(k, m) for k in (pa.int64(), pa.float64(), pa.float64(), pa.float64())]], NAMES)

    mixed = stage(keyed.select("id", "body").mapInArrow(run, "row long, id long, seg binary, n long, bytes long, cost double, base double, known double"), "mixing-rows")
    if running:
        tables.destroy()
    rest = coded.where(~often).select("seg", "cost", "base", "known")
    times = lambda c: F.sum(F.col("times") * F.col(c)).alias(f"more_{c}")
    more = mixed.where("seg IS NOT NULL").select("row", "seg", F.col("n").alias("times")).join(rest, "seg").groupBy("row").agg(*map(times, ("cost", "base", "known")))
    both = lambda c: F.col(c) + F.coalesce(f"more_{c}", F.lit(0.0))
    each = F.log10(F.lit(float(n_train + vocabulary + 1)))
    return mixed.where("seg IS NULL").join(more, "row", "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_tokens"), both("known").cast("long").alias("n_known"), F.lit(int(n_train)).cast("long").alias("train_tokens"),
        (both("base") - F.col("n") * each).alias("base_score"), both("cost").alias("score"),
        (-both("cost") / float(np.log10(2)) / (F.col("bytes") + 1)).alias("bits_per_byte"))


NAMES = ["row", "id", "seg", "n", "bytes", "cost", "base", "known"]


def in_fold(id_col: str, folds: int = 7, fold: int = 2) -> Column:
    return F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(folds)) == fold


def op10_context_mixing(spark, sf_dir: str) -> DataFrame:
    """Scores of every document; one fold of seven is held out of learning."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = score_texts(docs, ~in_fold("doc_id"), running=True)
    return found.withColumn("held_out", in_fold("doc_id")).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")
