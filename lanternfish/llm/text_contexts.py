"""Hashed contexts at every byte of whole texts, which reach over white space.

Texts stand one behind another in a stream, each behind sentinels and with an end byte, and the stream is read a stretch of
bounded size at a time: what a context needs of earlier stretches (the last bytes, the hash of the word begun) is carried on.
Contexts never reach into the text before, so a byte's contexts depend on its own text alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd

END, BEFORE = 0xFF, 0xFE  # never bytes of UTF-8
ORDERS = (1, 2, 3, 4, 6)
REACH = max(ORDERS)
STRETCH = 1 << 17  # bytes of the stream read at a time
_K = 0x9E3779B97F4A7C15 | 1
_MIX = np.uint64(0xD6E8FEB86659FD93)
_EVENT = np.uint64(0xC2B2AE3D27D4EB4F)
_OPENS = np.zeros(256, dtype=bool)  # bytes behind which a word begins
_OPENS[[0x20, *range(0x09, 0x0E), BEFORE, END]] = True
_CODES = np.arange(1, 257, dtype=np.uint64)
_CODES[BEFORE] = 0
_POWERS = np.concatenate(([np.uint64(1)], np.cumprod(np.full(STRETCH, _K, dtype=np.uint64))))
_INVERSES = np.concatenate(([np.uint64(1)], np.cumprod(np.full(STRETCH, pow(_K, -1, 1 << 64), dtype=np.uint64))))


def stream(texts: list[bytes]) -> np.ndarray:
    """All texts, each behind ``REACH`` sentinels and with an end byte."""
    lead = bytes([BEFORE]) * REACH
    return np.frombuffer(lead + (bytes([END]) + lead).join(texts) + bytes([END]), dtype=np.uint8) if texts else np.zeros(0, np.uint8)


@dataclass
class Events:
    """Bytes with what their contexts are made of (the bytes before, nine bits each, and a hash of the word so far), and a number
    that is the same where all contexts and the byte are the same."""

    past: np.ndarray
    word: np.ndarray
    data: np.ndarray
    keys: np.ndarray

    def take(self, at: np.ndarray | slice) -> "Events":
        return Events(self.past[at], self.word[at], self.data[at], self.keys[at])

    def begins(self) -> Iterator[np.ndarray]:
        """A number for each context of ``ORDERS``, then for the word."""
        for order in ORDERS:
            yield self.past & np.uint64((1 << 9 * order) - 1)
        yield self.word

    def hashes(self) -> list[np.ndarray]:
        return [hashed(k, c) for k, c in enumerate(self.begins())]

    @classmethod
    def joined(cls, parts: list["Events"]) -> "Events":
        return cls(*(np.concatenate([getattr(p, c) for p in parts]) for c in ("past", "word", "data", "keys")))


def hashed(kind: int, contexts: np.ndarray) -> np.ndarray:
    """Hashes of a kind's contexts; the word's are hashes as they are."""
    return (contexts * _MIX) ^ (contexts >> np.uint64(7)) if kind < len(ORDERS) else contexts


def events(data: np.ndarray) -> Iterator[Events]:
    """The events of a stream's bytes, sentinels left out, a stretch at a time."""
    last = np.zeros(REACH, dtype=np.uint64)
    opened, begun, length = True, 0, 0  # does a word begin here, and the hash and length of the one begun
    for a in range(0, len(data), STRETCH):
        part = data[a : a + STRETCH]
        codes, n = _CODES[part], len(part)
        first = np.empty(n, dtype=bool)
        first[0] = opened
        first[1:] = _OPENS[part[:-1]]
        opened = bool(_OPENS[part[-1]])
        bounds = np.concatenate(([0], np.flatnonzero(first)))  # of the word carried on, then of those that begin here
        sizes = np.diff(np.append(bounds, n))
        sums = np.zeros(n + 1, dtype=np.uint64)  # of code times power, so that a range's hash does not depend on its place
        np.cumsum(codes * _POWERS[:n], out=sums[1:])
        h = (sums[:n] - np.repeat(sums[bounds], sizes)) * np.repeat(_INVERSES[bounds], sizes)
        size = np.arange(n) - np.repeat(bounds, sizes)
        ending = (int(sums[n]) - int(sums[bounds[-1]])) * int(_INVERSES[bounds[-1]])
        if own := int(sizes[0]):
            carried = pow(_K, length, 1 << 64)
            h[:own] = h[:own] * np.uint64(carried) + np.uint64(begun)
            size[:own] += length
        if len(bounds) == 1:
            ending, length = ending * carried + begun, length + n
        else:
            length = n - int(bounds[-1])
        begun = ending % (1 << 64)
        h ^= size.astype(np.uint64) * _MIX
        h ^= h >> np.uint64(29)
        h *= _MIX
        real = np.flatnonzero(part != BEFORE)
        reach = np.concatenate((last, codes))
        last = reach[n:]
        past = np.zeros(n, dtype=np.uint64)
        for back in range(1, REACH + 1):
            past |= reach[REACH - back : REACH - back + n] << np.uint64(9 * (back - 1))
        past, word, own = past[real], h[real], part[real]
        key = (past * _MIX ^ (past >> np.uint64(7))) * _EVENT + word
        yield Events(past, word, own, (key ^ (key >> np.uint64(32))) * _MIX + own * _EVENT)


def distinct(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of each first occurrence, occurrences, number of the distinct key at every place), in order of first occurrence."""
    codes, found = pd.factorize(keys)
    first = np.empty(len(found), dtype=np.int64)
    first[codes[::-1]] = np.arange(len(keys) - 1, -1, -1)
    return first, np.bincount(codes, weights=counts, minlength=len(found)), codes
