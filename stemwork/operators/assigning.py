"""Least-cost matching of a cell's points without their pairs: few candidates are held, and all others are asked for by prices.

A matching over some candidates gives each point a price. Where no other pair costs less than the prices of its two points, the
matching is the least over all pairs too; pairs that do are added, and the matching is mended. So memory grows with the points,
while pairs are looked at in blocks and left again.
"""

from __future__ import annotations

import heapq
from array import array
from collections.abc import Callable, Iterator

import numpy as np

#: Points a tile; candidates of each point at first, and those that a round may add to it.
TILE, FIRST, MORE = 64, 12, 8
#: Prices closer than that are the same.
SAME = 1e-12


class _Tiles:
    """Points in tiles of 64 that lie together, with the box of each."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        slab = TILE * max(1, int(np.ceil(np.sqrt(len(x) / TILE))))
        rank = np.empty(len(x), np.int64)
        rank[np.argsort(x, kind="stable")] = np.arange(len(x)) // slab
        self.order = np.lexsort((y, rank))
        self.starts = np.arange(0, len(x), TILE)
        self.ends = np.append(self.starts[1:], len(x))
        self.x0, self.x1, self.y0, self.y1 = (f.reduceat(c[self.order], self.starts) for c in (x, y) for f in (np.minimum, np.maximum))

    def of(self, f: np.ufunc, values: np.ndarray) -> np.ndarray:
        return f.reduceat(values[self.order], self.starts)

    def rows(self, t: int) -> np.ndarray:
        return self.order[self.starts[t] : self.ends[t]]

    def away(self, other: _Tiles, t: int) -> np.ndarray:
        """The least distance of each tile's box from that of the other's tile t, or slightly less."""
        dx = np.maximum(0, np.maximum(self.x0 - other.x1[t], other.x0[t] - self.x1))
        dy = np.maximum(0, np.maximum(self.y0 - other.y1[t], other.y0[t] - self.y1))
        return np.sqrt(dx * dx + dy * dy) * (1 - 1e-9)


class Pairs:
    """All pairs of two sides of points, by blocks. cost(rows, cols) is their matrix, inf where they are no candidates."""

    def __init__(self, a: np.ndarray, b: np.ndarray, tol: float, cost: Callable[[np.ndarray, np.ndarray], np.ndarray]):
        self.a, self.b, self.tol, self.cost = _Tiles(*a.T), _Tiles(*b.T), tol, cost

    def tiles(self, wanted: Callable[[int, np.ndarray], np.ndarray] | None = None) -> Iterator[tuple[np.ndarray, Iterator[tuple[np.ndarray, np.ndarray]]]]:
        """(rows, [(cols, costs), ...]) of each tile with those within tolerance. wanted(tile, distances): which tiles of the right."""
        for t in range(len(self.a.starts)):
            away = self.b.away(self.a, t)
            hit = away <= self.tol
            if wanted is not None:
                hit &= wanted(t, away)
            hit = np.flatnonzero(hit)
            if len(hit):
                yield self.a.rows(t), self._chunks(self.a.rows(t), hit)

    def _chunks(self, rows: np.ndarray, hit: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for k in range(0, len(hit), TILE):
            cols = np.concatenate([self.b.rows(t) for t in hit[k : k + TILE].tolist()])
            yield cols, self.cost(rows, cols)


def _least(parts: list[tuple[np.ndarray, ...]], k: int) -> tuple[np.ndarray, ...]:
    """Of parts (row, col, key, cost) the k of each row with the least keys, as (row, col, cost)."""
    row, col, key, cost = (np.concatenate(c) for c in zip(*parts, strict=True))
    if len(parts) > 1:
        order = np.lexsort((key, row))
        row, col, cost = row[order], col[order], cost[order]
        first = np.arange(len(row)) - np.searchsorted(row, row) < k
        row, col, cost = row[first], col[first], cost[first]
    return row, col, cost


def _part(rows: np.ndarray, cols: np.ndarray, key: np.ndarray, cost: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    some = np.argpartition(key, k - 1, axis=1)[:, :k] if key.shape[1] > k else np.broadcast_to(np.arange(key.shape[1]), key.shape)
    at = np.broadcast_to(np.arange(len(rows))[:, None], some.shape)
    found = np.isfinite(key[at, some])
    i, j = at[found], some[found]
    return rows[i], cols[j], key[i, j], cost[i, j]


class _Groups:
    """Connected groups of names, lefts 0 to n - 1 and rights after them."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        """Labels spread along many links until nothing moves."""
        while len(a):
            p, q = self.up[a], self.up[b]
            apart = p != q
            a, b, p, q = a[apart], b[apart], p[apart], q[apart]
            np.minimum.at(self.up, np.maximum(p, q), np.minimum(p, q))
            while True:
                after = self.up[self.up]
                if (after == self.up).all():
                    break
                self.up = after


class _Matching:
    """Pairs of least cost over the candidates held, in which staying single costs nothing and pairs cost less than that.

    Prices u and v are at most 0, no candidate costs less than the sum of its two, and taken ones cost as much. Points that are
    free and have a price below 0 are what is left to do; each is settled by one shortest path, from either side.
    """

    def __init__(self, n: int, m: int):
        self.to, self.cost = ([array("i") for _ in range(n)], [array("i") for _ in range(m)]), ([array("d") for _ in range(n)], [array("d") for _ in range(m)])
        self.reset()

    def reset(self) -> None:
        self.price, self.taken = tuple([0.0] * len(t) for t in self.to), tuple([-1] * len(t) for t in self.to)

    def add(self, i: np.ndarray, j: np.ndarray, c: np.ndarray) -> None:
        for side, a, b in ((0, i, j), (1, j, i)):
            to, cost = self.to[side], self.cost[side]
            for x, y, z in zip(a.tolist(), b.tolist(), c.tolist(), strict=True):
                to[x].append(y)
                cost[x].append(z)

    def fit(self, rows: Iterator[int], slack: float) -> None:
        """Lefts' prices by those of rights; pairs that cost more than the best by the slack are given up."""
        u, v = self.price
        co, ro = self.taken
        for i in rows:
            least, mine, held = 0.0, 0.0, co[i]
            for j, c in zip(self.to[0][i], self.cost[0][i]):
                x = c - v[j]
                if x < least:
                    least = x
                if j == held and x < mine:
                    mine = x
            u[i] = least
            if held >= 0 and mine > least + slack:
                co[i] = ro[held] = -1

    def bid(self, step: float, most: int | None = None) -> None:
        """Free lefts take the best right, whose price falls by as much as it is better than the next and a step."""
        to, cost, v = self.to[0], self.cost[0], self.price[1]
        co, ro = self.taken
        stack = [i for i in range(len(co)) if co[i] < 0][::-1]
        left = -1 if most is None else most * len(stack)
        while stack and left:
            i = stack.pop()
            left -= 1
            best = second = 0.0
            take = -1
            for j, c in zip(to[i], cost[i]):
                x = c - v[j]
                if x < best:
                    second, best, take = best, x, j
                elif x < second:
                    second = x
            if take < 0:
                continue
            old = ro[take]
            if second - best + step <= 0 and old >= 0:
                continue
            v[take] -= second - best + step
            ro[take], co[i] = i, take
            if old >= 0:
                co[old] = -1
                stack.append(old)

    def solve(self) -> None:
        for side in (0, 1):
            taken, price = self.taken[side], self.price[side]
            for k in [k for k in range(len(taken)) if taken[k] < 0 and price[k] < -SAME]:
                if taken[k] < 0 and price[k] < -SAME:
                    self._settle(k, side)

    def _settle(self, s: int, side: int) -> None:
        """The shortest path from a free point to a free one of the other side, or to one of its own that can stay single."""
        to, cost, u, v, co, ro = self.to[side], self.cost[side], self.price[side], self.price[1 - side], self.taken[side], self.taken[1 - side]
        dist: dict[int, float] = {}
        way: dict[int, int] = {}
        get, push, pop, heap, done = dist.get, heapq.heappush, heapq.heappop, [], []
        row, far, end, alone, last = s, 0.0, float("inf"), -1, -1
        while True:
            base = far - u[row]
            if base < end:
                end, alone, last = base, row, -1
            for j, c in zip(to[row], cost[row]):
                x = base + c - v[j]
                if x < far:
                    x = far
                if x < end and x < get(j, end):
                    way[j] = row
                    if ro[j] < 0:
                        end, last = x, j
                    else:
                        dist[j] = x
                        push(heap, (x, j))
            while heap and heap[0][0] > dist[heap[0][1]]:
                pop(heap)
            if not heap or heap[0][0] >= end:
                break
            far, j = pop(heap)
            row = ro[j]
            done.append(j)
        for j in done:
            step = end - dist[j]
            v[j] -= step
            u[ro[j]] += step
        u[s] += end
        if last < 0:
            u[alone] = 0.0
            if alone != s:
                last = co[alone]
                ro[last] = co[alone] = -1
        while last >= 0:
            row = way[last]
            free = co[row]
            ro[last], co[row], last = row, last, free


def match(a: np.ndarray, b: np.ndarray, left: np.ndarray, right: np.ndarray, tol: float, cost: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of a, row of b, cost) of the least-cost matching in which staying single costs 1 more than a connected group's dearest pair.

    a, b: positions. left, right: numbers from 0 of their names, each of which has one pair at most. cost(rows, cols): a matrix of costs,
    which are no less than the distance, inf for what is no candidate; none is farther than tol.
    """
    none = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    if not len(a) or not len(b):
        return none
    pairs, rng = Pairs(a, b, tol, cost), np.random.default_rng(0)
    n, m, wide = int(left.max()) + 1, int(right.max()) + 1, len(b)

    # candidates to begin with: the nearest of each, any of equally near ones
    found, farthest, link = [], np.full(len(a), -np.inf), np.full(len(b), -1)
    for rows, chunks in pairs.tiles():
        parts = []
        for cols, d in chunks:
            some = np.isfinite(d)
            farthest[rows] = np.maximum(farthest[rows], np.where(some, d, -np.inf).max(axis=1))
            met = some.any(axis=0)
            link[cols[met]] = rows[some.argmax(axis=0)[met]]
            parts.append(_part(rows, cols, d + 1e-9 * rng.random(d.shape, np.float32), d, FIRST))
        found.append(_least(parts, FIRST))
    i, j, c = (np.concatenate(x) for x in zip(*found, strict=True)) if found else none
    if not len(i):
        return none

    groups = _Groups(n + m)
    groups.join(left[i], n + right[j])
    groups.join(left[link[link >= 0]], n + right[link >= 0])
    la, lb = groups.up[left], groups.up[n + right]
    ends = [side.of(f, l) for side, l in ((pairs.a, la), (pairs.b, lb)) for f in (np.minimum, np.maximum)]
    apart = lambda t, away: (ends[2] != ends[0][t]) | (ends[3] != ends[0][t]) | (ends[1][t] != ends[0][t])
    for rows, chunks in pairs.tiles(apart):
        for cols, d in chunks:
            p, q = np.nonzero(np.isfinite(d) & (la[rows][:, None] != lb[cols]))
            if len(p):
                links = np.unique(la[rows[p]] * (n + m) + lb[cols[q]])
                groups.join(*np.divmod(links, n + m))
    single = np.full(n + m, -np.inf)
    np.maximum.at(single, groups.up[left], farthest)
    worth = 2 * (single[groups.up[:n]] + 1)  # of each name; those that meet nothing have none

    matching, held, dist = _Matching(n, m), np.empty(0, np.int64), np.empty(0)

    def add(i: np.ndarray, j: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Candidates that are not held yet are; names of the lefts that have any of these."""
        nonlocal held, dist
        key, at = np.unique(i * wide + j, return_index=True)
        new = ~np.isin(key, held, assume_unique=True)
        key, at = key[new], at[new]
        matching.add(left[i[at]], right[j[at]], c[at] - worth[left[i[at]]])
        held, dist = np.append(held, key), np.append(dist, c[at])
        return np.unique(left[i[at]])

    def below(slack: float) -> np.ndarray:
        """Candidates are added that cost less than their prices by more than the slack."""
        u, v = np.array(matching.price[0])[left] + worth[left], np.array(matching.price[1])[right]
        u[~np.isfinite(u)] = -np.inf
        high, low, found = pairs.a.of(np.maximum, u), pairs.b.of(np.maximum, v), []
        for rows, chunks in pairs.tiles(lambda t, away: away < high[t] + low - slack):
            parts = []
            for cols, d in chunks:
                gap = d - u[rows][:, None] - v[cols]
                gap[~(gap < -slack)] = np.inf
                if np.isfinite(gap).any():
                    parts.append(_part(rows, cols, gap * (1 + 1e-6 * rng.random(gap.shape, np.float32)), d, MORE))
            if parts:
                found.append(_least(parts, MORE))
        return add(*(np.concatenate(x) for x in zip(*found, strict=True))) if found else np.empty(0, int)

    add(i, j, c)
    step = tol / 40  # rough prices show the candidates that matter
    for _ in range(6):
        matching.fit(range(n), step)
        matching.bid(step)
        matching.fit(range(n), np.inf)
        if len(below(step)) < n / 50:
            break
    below(step / 2)
    matching.reset()
    matching.bid(0.0, 20)
    matching.fit(range(n), 0.0)
    while True:
        matching.solve()
        touched = below(SAME)
        if not len(touched):
            break
        matching.fit(touched.tolist(), SAME)

    i, j = np.divmod(held, wide)
    co = np.array(matching.taken[0])
    took = np.flatnonzero(co[left[i]] == right[j])
    took = took[np.lexsort((j[took], i[took], dist[took], left[i[took]]))]
    took = took[np.unique(left[i[took]], return_index=True)[1]]
    return i[took], j[took], dist[took]
