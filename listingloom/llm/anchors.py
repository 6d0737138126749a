"""Metric trees over integer points, built middle-out from anchors, and nearest entries of a codebook found by them.

About sqrt(n) anchors are chosen one by one: the point farthest from its anchor in the widest ball becomes the next one and
takes the points that are nearer to it; a point nearer to its anchor than half the way between both anchors is not looked
at. The balls are built on within in the same way, and joined from the middle upwards, the two whose common ball is
smallest first. Every ball keeps the sum and the number of its points.
"""

from __future__ import annotations

import numpy as np

#: Balls of so many points at most are not divided.
LEAF = 32
#: Leaves next to each other that compare their points in one step.
RUN = 8

#: Part of a bound by which entries must differ before one is given up, beyond all rounding of doubles.
_SLACK = 1e-9
#: Beyond all squared distances.
_NEVER = np.iinfo(np.int64).max


class Tree:
    """Balls of one point set. order: the points, those of every ball next to each other from first to last; left: its
    first child, -1 for a leaf; right: its second; center, radius: an integer point and how far the others are; sums."""

    FIELDS = ("order", "first", "last", "left", "right", "radius", "center", "sums")

    def __init__(self, **arrays: np.ndarray):
        for name in self.FIELDS:
            setattr(self, name, arrays[name])

    def to_bytes(self) -> bytes:
        """All as 64-bit integers; radius holds the squares."""
        head = np.array([len(self.order), len(self.first), self.center.shape[1]], dtype=np.int64)
        return b"".join([head.tobytes(), *(getattr(self, name).astype(np.int64).tobytes() for name in self.FIELDS)])

    @classmethod
    def from_bytes(cls, data: bytes) -> Tree:
        values = np.frombuffer(data, dtype=np.int64)
        n, balls, dims = values[:3]
        sizes = [n, balls, balls, balls, balls, balls, balls * dims, balls * dims]
        parts = np.split(values[3:], np.cumsum(sizes)[:-1])
        return cls(**{k: p.reshape(-1, dims) if k in ("center", "sums") else p for k, p in zip(cls.FIELDS, parts)})


def squares(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of all points from all entries, exact."""
    most = max(np.abs(points).max(initial=0), np.abs(entries).max(initial=0))
    exact = 4 * points.shape[1] * int(most) ** 2 < 1 << 53
    a, b = (points.astype(np.float64), entries.astype(np.float64)) if exact else (points, entries)
    return (a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)


def _anchored(points: np.ndarray, idx: np.ndarray) -> list[np.ndarray]:
    """The points of every anchor; one group if all points are equal."""
    mine = points[idx]
    pivots, far = [mine[0]], ((mine - mine[0]) ** 2).sum(1).astype(np.float64)
    owner = np.zeros(len(idx), dtype=np.int64)
    for _ in range(int(np.ceil(np.sqrt(len(idx)))) - 1):
        at = int(far.argmax())  # the farthest point of the widest ball
        if far[at] == 0:
            break
        pivot = mine[at]
        half = ((np.array(pivots) - pivot) ** 2).sum(1) / 4  # of the way between the anchors, squared
        asked = np.flatnonzero(far > half[owner])
        near = ((mine[asked] - pivot) ** 2).sum(1).astype(np.float64)
        won = near < far[asked]
        owner[asked[won]], far[asked[won]] = len(pivots), near[won]
        pivots.append(pivot)
    return [idx[owner == k] for k in range(len(pivots)) if (owner == k).any()]


def _joined(balls: list[tuple]) -> tuple:
    """One ball over many: the two whose common ball is smallest are joined until one is left.

    A ball is (points, left, right, center, radius, n); radius bounds the distance of its points from its center.
    """
    n = len(balls)
    center = np.zeros((2 * n - 1, len(balls[0][3])))
    radius, size, alive = np.zeros(2 * n - 1), np.zeros(2 * n - 1), np.zeros(2 * n - 1, dtype=bool)
    for i, b in enumerate(balls):
        center[i], radius[i], size[i], alive[i] = b[3], b[4], b[5], True
    cost = np.full((2 * n - 1, 2 * n - 1), np.inf)

    def costs(i: int, others: np.ndarray) -> np.ndarray:
        apart = np.sqrt(((center[others] - center[i]) ** 2).sum(1))
        return np.maximum(np.maximum(radius[others], radius[i]), (apart + radius[others] + radius[i]) / 2)

    for i in range(1, n):
        cost[i, :i] = costs(i, np.arange(i))
    for new in range(n, 2 * n - 1):
        b, a = divmod(int(cost[:new, :new].argmin()), new)
        center[new] = (center[a] * size[a] + center[b] * size[b]) / (size[a] + size[b])
        size[new] = size[a] + size[b]
        apart = np.sqrt(((center[[a, b]] - center[new]) ** 2).sum(1))
        radius[new] = max(apart[0] + radius[a], apart[1] + radius[b])
        alive[[a, b]], alive[new] = False, True
        for gone in (a, b):
            cost[gone, :], cost[:, gone] = np.inf, np.inf
        others = np.flatnonzero(alive[:new])
        cost[new, others] = costs(new, others)
        balls.append((None, balls[a], balls[b], center[new], radius[new], size[new]))
    return balls[-1]


def _ball(points: np.ndarray, idx: np.ndarray) -> tuple:
    groups = [idx] if len(idx) <= LEAF else _anchored(points, idx)
    if len(groups) == 1:
        center = points[idx].mean(0)
        return idx, None, None, center, float(np.sqrt(((points[idx] - center) ** 2).sum(1).max())), len(idx)
    return _joined([_ball(points, g) for g in groups])


def tree(points: np.ndarray) -> Tree:
    """The metric tree of at least one point (int64, rows)."""
    order, first, last, left, right = [], [], [], [], []
    placed = 0
    # Depth first with a stack, as a chain of joins may be as deep as there are anchors.
    todo = [(_ball(points, np.arange(len(points))), -1, False)]
    spans = []
    while todo:
        ball, parent, second = todo.pop()
        own = len(left)
        if parent >= 0:
            (right if second else left)[parent] = own
        left.append(-1)
        right.append(-1)
        spans.append((placed, int(ball[5])))
        if ball[0] is not None:
            order.append(ball[0])
            placed += len(ball[0])
        else:
            todo += [(ball[2], own, True), (ball[1], own, False)]
    order = np.concatenate(order)
    first = np.array([a for a, _ in spans])
    last = first + np.array([n for _, n in spans])
    sorted_points = points[order]
    total = np.concatenate((np.zeros((1, points.shape[1]), dtype=np.int64), np.cumsum(sorted_points, axis=0)))
    sums = total[last] - total[first]
    center = sums // (last - first)[:, None]
    radius = np.array([((sorted_points[a:b] - c) ** 2).sum(1).max() for a, b, c in zip(first, last, center)])
    return Tree(order=order, first=first, last=last, left=np.array(left), right=np.array(right), radius=radius, center=center, sums=sums)


class Found:
    """codes: the entry nearest to each point, the lower one of equals; sums, counts: of the points of each entry;
    owned: points that were assigned with a whole ball; compared: distances of single points that were looked at."""

    def __init__(self, n: int, entries: int, dims: int):
        self.codes = np.zeros(n, dtype=np.int64)
        self.sums, self.counts = np.zeros((entries, dims), dtype=np.int64), np.zeros(entries, dtype=np.int64)
        self.owned = self.compared = 0


def nearest(balls: Tree, points: np.ndarray, entries: np.ndarray) -> Found:
    """Assigns every point to its nearest entry, whole balls at once where only one entry can own them.

    A ball inherits the entries that were left for its parent. It gives up an entry if all of the ball lies beyond the
    plane halfway between that entry and the one nearest to its center; of equal entries only the lowest is kept. A ball
    with one entry left adds its cached sum. Leaves compare their points with what is left, in exact arithmetic.
    """
    found = Found(len(points), len(entries), points.shape[1])
    apart = np.sqrt(np.maximum(squares(entries, entries), 0).astype(np.float64))
    radius = np.sqrt(balls.radius.astype(np.float64))
    at, left = np.array([0]), np.ones((1, len(entries)), dtype=bool)
    leaves, lists = [], []
    while len(at):
        far = np.where(left, squares(balls.center[at], entries).astype(np.float64), np.inf)
        best = far.argmin(1)
        gap = far - far[np.arange(len(at)), best][:, None]
        between = apart[best]
        beyond = gap > 2 * radius[at][:, None] * between + _SLACK * (1 + np.where(left, far, 0) + between * between)
        twin = (between == 0) & (np.arange(len(entries)) > best[:, None])
        left = left & ~beyond & ~twin
        left[np.arange(len(at)), best] = True
        alone = left.sum(1) == 1
        owners = best[alone]
        np.add.at(found.sums, owners, balls.sums[at[alone]])
        np.add.at(found.counts, owners, balls.last[at[alone]] - balls.first[at[alone]])
        for ball, entry in zip(at[alone], owners):
            inside = balls.order[balls.first[ball] : balls.last[ball]]
            found.codes[inside] = entry
            found.owned += len(inside)
        leaf = ~alone & (balls.left[at] < 0)
        leaves.append(at[leaf])
        lists.append(left[leaf])
        inner = ~alone & ~leaf
        at, left = np.concatenate((balls.left[at[inner]], balls.right[at[inner]])), np.concatenate((left[inner], left[inner]))

    at, left = np.concatenate(leaves), np.concatenate(lists)
    near = np.argsort(balls.first[at])
    for k in range(0, len(near), RUN):
        run = at[near[k : k + RUN]]
        sizes = balls.last[run] - balls.first[run]
        inside = np.concatenate([balls.order[balls.first[b] : balls.last[b]] for b in run])
        own = np.repeat(left[near[k : k + RUN]], sizes, axis=0)
        asked = np.flatnonzero(own.any(0))  # what any of them has left; each point minds its own list
        far = np.where(own[:, asked], squares(points[inside], entries[asked]), _NEVER)
        codes = asked[far.argmin(1)]
        found.codes[inside] = codes
        np.add.at(found.sums, codes, points[inside])
        found.counts += np.bincount(codes, minlength=len(entries))
        found.compared += int(own.sum())
    return found
