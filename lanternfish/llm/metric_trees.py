"""Metric trees by the anchors hierarchy, and exact nearest-entry assignment of their points, ball by ball.

A tree is built middle-out: about sqrt(n) anchors take the points nearest to them, each anchor's own points are split the
same way, and the anchors' balls are merged upward, smallest merged ball first.  Every ball caches its points' sum and
count.  To assign all points to their nearest codebook entry, balls inherit their parent's list of candidate entries and
drop those that a better one beats everywhere in the ball; a ball with one candidate left is owned whole.
"""

from __future__ import annotations

import io
import math
from dataclasses import dataclass, fields

import numpy as np

LEAF = 24
EXACT = 2.0**20  # whole components below this have exact squared distances in double precision


@dataclass
class Tree:
    """Points (whole numbers) in the order of the balls; ball k holds points start[k] to stop[k]."""

    points: np.ndarray
    rows: np.ndarray  # each point's place in the input
    start: np.ndarray
    stop: np.ndarray
    left: np.ndarray  # -1: a leaf
    right: np.ndarray
    centre: np.ndarray
    radius: np.ndarray
    sums: np.ndarray

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **{f.name: getattr(self, f.name) for f in fields(self)})
        return out.getvalue()

    @staticmethod
    def load(data: bytes) -> Tree:
        return Tree(**np.load(io.BytesIO(data)))


def _lengths(rows: np.ndarray) -> np.ndarray:
    return np.sqrt(np.einsum("ij,ij->i", rows, rows))


def owners(points: np.ndarray, k: int) -> np.ndarray:
    """The anchor of each point, of at most ``k``.

    A new anchor is the point furthest from its own anchor.  It can take a point only from an anchor whose point lies
    further away than half the gap between the two anchors, so other distances are not computed.
    """
    own, pivots = np.zeros(len(points), np.int64), points[:1]
    far = _lengths(points - pivots[0])
    while len(pivots) < k:
        new = points[int(np.argmax(far))]
        if far.max() == 0:
            break
        gap = _lengths(pivots - new)
        may = np.flatnonzero(far > gap[own] / 2)
        to_new = _lengths(points[may] - new)
        taken = to_new < far[may]
        own[may[taken]], far[may[taken]] = len(pivots), to_new[taken]
        pivots = np.vstack([pivots, new])
    return own


def _merged(nodes: list, points: np.ndarray) -> tuple:
    """One tree of (members, left, right) nodes: the pair with the smallest ball around both is merged first."""
    centres = np.array([points[n[0]].mean(axis=0) for n in nodes])
    radius = np.array([_lengths(points[n[0]] - c).max() for n, c in zip(nodes, centres)])
    size = np.array([float(len(n[0])) for n in nodes])
    ball = lambda i: np.maximum(np.maximum((_lengths(centres - centres[i]) + radius + radius[i]) / 2, radius), radius[i])
    both = np.array([ball(i) for i in range(len(nodes))])
    np.fill_diagonal(both, np.inf)
    nodes = list(nodes)
    for _ in range(len(nodes) - 1):
        i, j = divmod(int(np.argmin(both)), len(nodes))
        radius[i] = both[i, j]
        centres[i] = (centres[i] * size[i] + centres[j] * size[j]) / (size[i] + size[j])
        size[i] += size[j]
        nodes[i] = (np.concatenate([nodes[i][0], nodes[j][0]]), nodes[i], nodes[j])
        gone = np.isinf(both[i]) & (np.arange(len(nodes)) != i)
        both[i] = ball(i)
        both[i, gone] = both[i, i] = np.inf
        both[:, i] = both[i]
        both[j, :] = both[:, j] = np.inf
        last = i
    return nodes[last]


def _grown(points: np.ndarray, members: np.ndarray) -> tuple:
    if len(members) <= LEAF:
        return members, None, None
    own = owners(points[members], max(2, math.isqrt(len(members))))
    groups = [members[own == k] for k in range(int(own.max()) + 1)]
    if len(groups) == 1:
        return members, None, None  # equal points
    return _merged([_grown(points, g) for g in groups], points)


def build(points: np.ndarray) -> Tree:
    """The tree of whole-numbered points (n x d, n > 0)."""
    real = points.astype(np.float64)
    todo, nodes, links = [(_grown(real, np.arange(len(points))), 0)], [], {}
    while todo:  # a node's points follow each other: left child's, then right child's
        (members, left, right), at = todo.pop()
        k = len(nodes)
        nodes.append((at, at + len(members), left is None, members))
        links[(at, at + len(members))] = k
        if left is not None:
            todo += [(right, at + len(left[0])), (left, at)]
    rows = np.empty(len(points), np.int64)
    for a, b, leaf, members in nodes:
        if leaf:
            rows[a:b] = members
    start, stop = np.array([n[0] for n in nodes]), np.array([n[1] for n in nodes])
    left, right = np.full(len(nodes), -1), np.full(len(nodes), -1)
    for k, (a, b, leaf, _) in enumerate(nodes):
        if not leaf:
            left[k] = k + 1  # preorder
            right[k] = links[(int(stop[k + 1]), b)]
    points, real = points[rows], real[rows]
    upto = np.concatenate([np.zeros((1, points.shape[1]), np.int64), np.cumsum(points, axis=0)])
    sums = upto[stop] - upto[start]
    centre = sums / (stop - start)[:, None]
    radius = np.array([_lengths(real[a:b] - c).max() for a, b, c in zip(start, stop, centre)])
    return Tree(points, rows, start, stop, left, right, centre, radius, sums)


def squared(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of whole-numbered points (n x d) to entries (m x d)."""
    largest = max(np.abs(points).max(initial=0), np.abs(entries).max(initial=0))
    if largest < EXACT:
        p, e = points.astype(np.float64), entries.astype(np.float64)
        return ((p * p).sum(axis=1)[:, None] - 2 * (p @ e.T) + (e * e).sum(axis=1)[None, :]).astype(np.int64)
    return ((points[:, None, :] - entries[None, :, :]) ** 2).sum(axis=2)


def owned(tree: Tree, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, np.ndarray]], int]:
    """(balls, their entries, [(leaf, candidates)], distances computed): what the entries own, exactly.

    An entry c leaves a ball of centre p and radius r if the best entry b at its centre is nearer to all its points:
    |p - c|^2 - |p - b|^2 > 2 r |c - b|.  An entry equal to an earlier one never owns a point.
    """
    real = entries.astype(np.float64)
    gaps = np.sqrt(np.maximum(0, squared(entries, entries)).astype(np.float64))
    twin = np.argmax(gaps == 0, axis=1)
    frontier, lists = np.array([0]), (twin == np.arange(len(entries)))[None, :]
    balls, winners, leaves, work = [], [], [], 0
    while len(frontier):
        work += int(lists.sum())
        centre = tree.centre[frontier]
        d = np.where(lists, (centre * centre).sum(axis=1)[:, None] - 2 * (centre @ real.T) + (real * real).sum(axis=1)[None, :], np.inf)
        best = d.argmin(axis=1)
        slack = 1e-6 + 1e-9 * np.where(lists, d, 0.0).max(axis=1)  # rounding keeps an entry, never drops one
        beaten = d - d[np.arange(len(d)), best][:, None] > 2 * tree.radius[frontier][:, None] * gaps[best] + slack[:, None]
        lists = lists & ~beaten
        one = lists.sum(axis=1) == 1
        balls += frontier[one].tolist()
        winners += lists[one].argmax(axis=1).tolist()
        leaf = ~one & (tree.left[frontier] < 0)
        leaves += [(int(k), np.flatnonzero(c)) for k, c in zip(frontier[leaf], lists[leaf])]
        down = ~one & ~leaf
        frontier, lists = np.concatenate([tree.left[frontier[down]], tree.right[frontier[down]]]), np.vstack([lists[down], lists[down]])
    return np.array(balls, np.int64), np.array(winners, np.int64), leaves, work


def totals(tree: Tree, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum and count of the points nearest to each entry, ties to the lower index; owned balls add their cached sums."""
    balls, winners, leaves, _ = owned(tree, entries)
    sums, counts = np.zeros(entries.shape, np.int64), np.zeros(len(entries), np.int64)
    np.add.at(sums, winners, tree.sums[balls])
    np.add.at(counts, winners, tree.stop[balls] - tree.start[balls])
    for k, candidates in leaves:
        points = tree.points[tree.start[k] : tree.stop[k]]
        codes = candidates[squared(points, entries[candidates]).argmin(axis=1)]
        np.add.at(sums, codes, points)
        np.add.at(counts, codes, 1)
    return sums, counts


def codes(tree: Tree, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry of each point and its squared distance, in the order of the input."""
    balls, winners, leaves, _ = owned(tree, entries)
    found = np.empty(len(tree.points), np.int64)
    for k, c in zip(balls, winners):
        found[tree.start[k] : tree.stop[k]] = c
    for k, candidates in leaves:
        part = slice(tree.start[k], tree.stop[k])
        found[part] = candidates[squared(tree.points[part], entries[candidates]).argmin(axis=1)]
    apart = tree.points - entries[found]
    out, error = np.empty_like(found), np.empty_like(found)
    out[tree.rows], error[tree.rows] = found, (apart * apart).sum(axis=1)
    return out, error
