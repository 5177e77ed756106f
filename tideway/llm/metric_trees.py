"""Anchors-hierarchy metric trees: balls that cache sums and counts, and the nearest entries of all their points.

A tree is grown middle-out. Some anchors take the points nearest to them; a new anchor starts at the point farthest from the
anchor with the largest radius and steals only points that can be nearer to it, those farther from their anchor than half
the way between both. Anchors with many points get a tree of their own below; above, the two balls with the smallest common
ball are joined until one is left. All arithmetic on points is on integers, so sums and distances are exact.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Most points of a leaf.
LEAF = 48


def exact_squared(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of integer rows: by a matrix product where doubles hold them, else by differences."""
    most = 2.0 * max(np.abs(points).max(initial=0), np.abs(entries).max(initial=0))
    if points.shape[1] * most * most < 2.0**52:
        a, b = points.astype(np.float64), entries.astype(np.float64)
        return (a * a).sum(axis=1)[:, None] - 2.0 * (a @ b.T) + (b * b).sum(axis=1)[None, :]
    return np.stack([((points.astype(np.int64) - e) ** 2).sum(axis=1) for e in entries.astype(np.int64)], axis=1)


def anchors(points: np.ndarray, wanted: int) -> np.ndarray:
    """Number of the anchor that owns each point; fewer than ``wanted`` where points repeat."""
    owner, at = np.zeros(len(points), np.int64), [0]
    gap = np.sqrt(((points - points[0]) ** 2).sum(axis=1))
    while len(at) < wanted:
        far = int(gap.argmax())  # the farthest point of the anchor with the largest radius
        if gap[far] == 0:
            break
        apart = np.sqrt(((points[at] - points[far]) ** 2).sum(axis=1))
        some = np.flatnonzero(gap > apart[owner] / 2)
        new = np.sqrt(((points[some] - points[far]) ** 2).sum(axis=1))
        closer = new < gap[some]
        owner[some[closer]], gap[some[closer]] = len(at), new[closer]
        at.append(far)
    return np.unique(owner, return_inverse=True)[1]


@dataclass
class Tree:
    """Balls over ``points`` in the order ``order``: ball i holds places lo[i] to hi[i]; the last ball is the root."""

    order: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    left: np.ndarray
    right: np.ndarray
    radius: np.ndarray
    sums: np.ndarray

    FIELDS = ("order", "lo", "hi", "left", "right", "radius", "sums")


def grow(points: np.ndarray, leaf: int = LEAF) -> Tree:
    """The tree of integer points, one or more."""
    place = points.astype(np.float64)
    left: list[int] = []
    right: list[int] = []
    held: list[np.ndarray] = []  # points of each leaf, none for the other balls

    def ball(rows: np.ndarray, a: int = -1, b: int = -1) -> int:
        left.append(a)
        right.append(b)
        held.append(rows)
        return len(left) - 1

    def middle_out(rows: np.ndarray) -> int:
        if len(rows) <= leaf:
            return ball(rows)
        owner = anchors(place[rows], max(2, round(len(rows) ** 0.5)))
        groups = [rows[owner == n] for n in range(owner.max() + 1)]
        if len(groups) == 1:  # all equal
            return ball(rows)
        return joined([middle_out(g) for g in groups], groups)

    def joined(tops: list[int], groups: list[np.ndarray]) -> int:
        size = np.array([len(g) for g in groups], np.float64)
        mid = np.stack([place[g].mean(axis=0) for g in groups])
        wide = np.array([np.sqrt(((place[g] - m) ** 2).sum(axis=1)).max() for g, m in zip(groups, mid)])

        def common(i: int, others: np.ndarray) -> np.ndarray:
            """Radius of the ball around the common mean of ball i and each of the others."""
            way = np.sqrt(((mid[others] - mid[i]) ** 2).sum(axis=1))
            share = size[others] / (size[others] + size[i])
            return np.maximum(way * share + wide[i], way * (1 - share) + wide[others])

        live, n = np.ones(len(tops), bool), len(tops)
        cost = np.full((n, n), np.inf)
        for i in range(n - 1):
            cost[i, i + 1 :] = common(i, np.arange(i + 1, n))
        for _ in range(n - 1):
            i, j = divmod(int(cost.argmin()), n)
            radius = cost[i, j]
            tops[i] = ball(np.zeros(0, np.int64), tops[i], tops[j])
            mid[i] = (mid[i] * size[i] + mid[j] * size[j]) / (size[i] + size[j])
            size[i], wide[i], live[j] = size[i] + size[j], radius, False
            cost[j, :], cost[:, j] = np.inf, np.inf
            others = np.flatnonzero(live)
            others = others[others != i]
            cost[np.minimum(others, i), np.maximum(others, i)] = common(i, others)
        return tops[int(np.flatnonzero(live)[0])]

    root = middle_out(np.arange(len(points)))
    assert root == len(left) - 1
    n = len(left)
    lo, hi, order, at = np.zeros(n, np.int64), np.zeros(n, np.int64), [], 0
    stack = [(root, False)]
    while stack:  # leaves in order, then every ball from its first to its last leaf
        i, done = stack.pop()
        if left[i] < 0:
            lo[i], hi[i], at = at, at + len(held[i]), at + len(held[i])
            order.append(held[i])
        elif done:
            lo[i], hi[i] = lo[left[i]], hi[right[i]]
        else:
            stack += [(i, True), (right[i], False), (left[i], False)]
    order = np.concatenate(order)
    total = np.concatenate([np.zeros((1, points.shape[1]), np.int64), np.cumsum(points[order].astype(np.int64), axis=0)])
    sums = total[hi] - total[lo]
    means, sorted_place = sums / (hi - lo)[:, None], place[order]
    radius = np.array([np.sqrt(((sorted_place[a:b] - m) ** 2).sum(axis=1).max()) for a, b, m in zip(lo, hi, means)])
    return Tree(order, lo, hi, np.array(left), np.array(right), radius, sums)


def nearest(tree: Tree, points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(entry of each point, sums, counts of each entry's points): exact, ties to the lower index.

    Balls inherit the entries that may own one of their points. An entry leaves a ball's list when the plane half-way to the
    entry nearest to the ball's mean passes outside the ball; what a wholly owned ball caches is added at once.
    """
    k, dim = entries.shape
    label = np.zeros(len(points), np.int64)
    sums, counts = np.zeros((k, dim), np.int64), np.zeros(k, np.int64)
    apart = np.sqrt(np.maximum(exact_squared(entries, entries), 0).astype(np.float64))
    place, front = entries.astype(np.float64), np.array([len(tree.lo) - 1])
    may = np.ones((1, k), bool)
    open_leaves: list[tuple[int, np.ndarray]] = []
    while len(front):
        mean = tree.sums[front] / (tree.hi - tree.lo)[front][:, None]
        far = ((mean[:, None, :] - place[None, :, :]) ** 2).sum(axis=2) if len(front) * k * dim < 1 << 22 else np.stack([((place - m) ** 2).sum(axis=1) for m in mean])
        far[~may] = np.inf
        best = far.argmin(axis=1)
        row = np.arange(len(front))
        between = apart[best]
        reach = 2 * between * (tree.radius[front][:, None] * (1 + 1e-9) + 1e-6)
        lead = far - far[row, best][:, None]
        gone = lead > reach + 1e-9 * (far + 1)
        # Of equal entries only the first can own a point.
        gone |= (between == 0) & (np.arange(k)[None, :] > best[:, None])
        may = may & ~gone
        may[row, best] |= True
        owned = may.sum(axis=1) == 1
        np.add.at(sums, best[owned], tree.sums[front[owned]])
        np.add.at(counts, best[owned], (tree.hi - tree.lo)[front[owned]])
        for i, e in zip(front[owned], best[owned]):
            label[tree.order[tree.lo[i] : tree.hi[i]]] = e
        is_leaf = tree.left[front] < 0
        open_leaves += [(i, m) for i, m in zip(front[~owned & is_leaf], may[~owned & is_leaf])]
        down = ~owned & ~is_leaf
        front, may = np.concatenate([tree.left[front[down]], tree.right[front[down]]]), np.concatenate([may[down], may[down]])
    for i, m in open_leaves:
        rows, some = tree.order[tree.lo[i] : tree.hi[i]], np.flatnonzero(m)
        e = some[exact_squared(points[rows], entries[some]).argmin(axis=1)]
        label[rows] = e
        np.add.at(sums, e, points[rows].astype(np.int64))
        np.add.at(counts, e, 1)
    return label, sums, counts
