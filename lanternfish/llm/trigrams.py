"""Boolean trigram queries derived from regular expressions, and a trigram inverted index over a block of texts.

A query is True (no trigram is mandatory), a trigram (bytes), or ("and" | "or", [queries]).  It holds on every text that
the expression matches, so texts on which it fails need no look.  Letters are folded to lower case (A-Z) on both
sides, which can only admit more candidates.
"""

from __future__ import annotations

import re._constants as sre
import re._parser as sre_parser
from collections.abc import Iterable

import numpy as np

_MAX_STRINGS = 64


def _fold(codes: Iterable[int]) -> set[bytes]:
    return {chr(c).encode("utf-8").lower() for c in codes}


def _both(op: str, parts: list):
    """Joined by "and" or "or", with True and single parts folded away."""
    flat = []
    for p in parts:
        if p is True:
            if op == "or":
                return True
        elif p not in flat:
            flat.append(p)
    return True if not flat else flat[0] if len(flat) == 1 else (op, flat)


def _of_strings(strings: set[bytes]):
    """Some string of the set occurs: any of them, each with all of its trigrams; True if one is too short to have any."""
    return _both("or", [_both("and", [s[i : i + 3] for i in range(len(s) - 2)]) for s in sorted(strings)])


def _class_strings(items: list) -> set[bytes] | None:
    """The characters of a class if they are few."""
    codes: set[int] = set()
    for op, arg in items:
        if op is sre.LITERAL:
            codes.add(arg)
        elif op is sre.RANGE and arg[1] - arg[0] < 8:
            codes.update(range(arg[0], arg[1] + 1))
        else:
            return None
    folded = _fold(codes)
    return folded if len(folded) <= 4 else None


def _exact(node) -> set[bytes] | None:
    """All strings (folded) that a small sub-expression can match, or None."""
    out = {b""}
    for op, arg in node:
        if op is sre.LITERAL:
            step = _fold([arg])
        elif op is sre.IN:
            step = _class_strings(arg)
        elif op is sre.SUBPATTERN:
            step = _exact(arg[-1])
        elif op is sre.BRANCH:
            parts = [_exact(b) for b in arg[1]]
            step = None if None in parts else set().union(*parts)
        elif op is sre.MAX_REPEAT and arg[1] is not sre.MAXREPEAT and arg[1] <= 4:
            once = _exact(arg[2])
            step = None if once is None else {s for k in range(arg[0], arg[1] + 1) for s in _power(once, k)}
        elif op is sre.AT:
            step = {b""}
        else:
            return None
        if step is None or len(out) * len(step) > _MAX_STRINGS:
            return None
        out = {a + b for a in out for b in step}
    return out


def _power(strings: set[bytes], k: int) -> set[bytes]:
    out = {b""}
    for _ in range(k):
        out = {a + b for a in out for b in strings}
    return out


def _query(node):
    parts, run = [], {b""}

    def flush():
        nonlocal run
        parts.append(_of_strings(run))
        run = {b""}

    for op, arg in node:
        small = _exact([(op, arg)])
        if small is not None and len(run) * len(small) <= _MAX_STRINGS:
            run = {a + b for a in run for b in small}
            continue
        flush()
        if op is sre.SUBPATTERN:
            parts.append(_query(arg[-1]))
        elif op is sre.BRANCH:
            parts.append(_both("or", [_query(b) for b in arg[1]]))
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0] >= 1:
            once = _exact(arg[2])
            if once is not None and len(_power(once, min(arg[0], 4))) <= _MAX_STRINGS:
                parts.append(_of_strings(_power(once, min(arg[0], 4))))
            else:
                parts.append(_query(arg[2]))
        elif small is not None:
            run = small
    flush()
    return _both("and", parts)


def trigram_query(pattern: str):
    """The query of a regular expression (Python syntax)."""
    return _query(sre_parser.parse(pattern))


def trigrams_of(query) -> set[bytes]:
    if query is True:
        return set()
    return {query} if isinstance(query, bytes) else set().union(*map(trigrams_of, query[1]))


class BlockIndex:
    """Posting lists, over one block of texts, of the trigrams that a fixed set of queries asks for."""

    def __init__(self, wanted: Iterable[bytes]):
        self.wanted = {t: k for k, t in enumerate(sorted(wanted))}
        if len(self.wanted) > 254:
            raise ValueError("more than 254 trigrams are asked for")
        self.slot = np.zeros(1 << 24, dtype=np.uint8)
        for t, k in self.wanted.items():
            self.slot[int.from_bytes(t, "big")] = k + 1

    def post(self, texts: list[bytes]) -> np.ndarray:
        """One row of booleans for each wanted trigram: the texts of the block that hold it."""
        found = np.zeros((len(self.wanted) + 1, len(texts)), dtype=bool)
        starts = np.cumsum([0] + [len(t) + 1 for t in texts])
        data = np.frombuffer(b"\0".join(texts).lower() + b"\0", dtype=np.uint8)
        step = 1 << 22
        for at in range(0, len(data) - 2, step):
            b = data[at : at + step + 2].astype(np.uint32)
            slots = self.slot[(b[:-2] << 16) | (b[1:-1] << 8) | b[2:]]
            where = np.flatnonzero(slots)
            found[slots[where], np.searchsorted(starts, where + at, side="right") - 1] = True
        return found[1:]

    def candidates(self, query, posted: np.ndarray) -> np.ndarray:
        """Texts on which the query holds: postings are intersected for "and" and united for "or"."""
        if query is True:
            return np.ones(posted.shape[1], dtype=bool)
        if isinstance(query, bytes):
            return posted[self.wanted[query]]
        join = np.logical_and if query[0] == "and" else np.logical_or
        return join.reduce([self.candidates(q, posted) for q in query[1]])
