"""One-to-one matching of stems and detections, or of overlapping labels, from candidate pairs.

Cells are matched apart. The kernels sort a cell's candidates, not its points, in one Arrow group; for
cells too large for a task there is the greedy rule in rounds, which is DataFrame work only. nearest_first()
makes the candidates of dense cells in bands of distance, so that they grow with the points and not with their pairs;
optimal_points() and nearest_in_turn() send a dense cell's points to its task.
"""

from __future__ import annotations

import bisect
import heapq
import itertools
import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from stemwork.sources.scratch import checkpointed

from . import assigning, spatial
from .keys import joined


def _fields(df: DataFrame, names: list[str]) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*names).schema)


def greedy(pairs: DataFrame, keys: list[str], a: str = "stem", b: str = "det", cost: str = "dist") -> DataFrame:
    """Pairs in the order of (cost, a, b), each taken if neither side is taken yet."""
    rows = pairs.select(*keys, a, b, cost)

    def kernel(cell: pd.DataFrame) -> pd.DataFrame:
        cell = cell.sort_values([cost, a, b], kind="stable")
        left, right, keep = set(), set(), []
        for x, y in zip(cell[a], cell[b], strict=True):
            free = x not in left and y not in right
            if free:
                left.add(x)
                right.add(y)
            keep.append(free)
        return cell[keep]

    return rows.groupBy(*keys).applyInPandas(kernel, _fields(rows, rows.columns))


def greedy_rounds(pairs: DataFrame, keys: list[str], a: str = "stem", b: str = "det", cost: str = "dist") -> DataFrame:
    """The same matching without a task per cell: pairs that come first on both sides are taken, all round.

    (cost, a, b) orders pairs strictly, so each round takes at least one pair of every cell that has any,
    and what it takes is what the one-by-one rule takes. Rounds end when no pair is left.
    """
    rank = F.struct(cost, a, b)
    left, taken = pairs.select(*keys, a, b, cost), None
    while True:
        marked = left.withColumns({"_a": F.min(rank).over(W.partitionBy(*keys, a)), "_b": F.min(rank).over(W.partitionBy(*keys, b))})
        won = marked.where((F.col("_a") == F.col("_b")) & (F.col("_a") == rank)).drop("_a", "_b").checkpoint()
        if won.isEmpty():
            return taken if taken is not None else won
        taken = won if taken is None else taken.union(won)
        for side in (a, b):
            used = won.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(side).alias("_u"))
            left = left.join(used, [*[F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)], F.col(side) == F.col("_u")], "left_anti")
        left = left.checkpoint()


def nearest_first(
    stems: DataFrame, dets: DataFrame, keys: list[str], tol: float | str = 4.0, up: float | str = 8.0, most: float | None = None, gate: bool = True,
    method: Callable[[DataFrame, list[str]], DataFrame] = greedy, per: float = 8.0, least: int = spatial.FEW_PAIRS,
) -> DataFrame:
    """The matching of greedy() over all candidates of stems and detections (see spatial.candidates), made in bands of distance.

    The rule takes the nearest pairs first, so what it takes among pairs within a radius is final, and stems and
    detections that are taken need no farther candidates. Each band is as wide as leaves about `per` candidates a
    row; where all candidates are that few, or `least`, there is one band. Where a point shares its place with one other
    or more on average, if only because a few places hold many, candidates are places (see _greedy_places), whatever the
    heights there, so points of one position never make more pairs than there are rows. method: greedy or greedy_rounds.
    """
    side = spatial.widest(tol, most)
    reach, done = spatial.sparse_reach(stems, dets, keys, side, per, least, True), -1.0
    if reach >= side:
        return method(spatial.candidates(stems, dets, keys, tol, up, most, gate), keys)
    more = sorted({c for c in (tol, up) if isinstance(c, str)} - set(keys))
    fold, taken = method is greedy and stems.schema["stem"].dataType == dets.schema["det"].dataType, None
    left, right = (checkpointed(_placed(df, keys, c, cols) if fold else df.select(*keys, c, "x", "y", "z", *cols)) for df, c, cols in ((stems, "stem", more), (dets, "det", [])))
    if fold:
        sizes = left.select("_place").unionByName(right.select((-1 - F.col("_place")).alias("_place"))).groupBy("_place").agg(F.count("*").cast("double").alias("_n"))
        rows, met = sizes.agg(F.coalesce(F.sum("_n"), F.lit(0.0)), F.coalesce(F.sum(F.col("_n") * F.col("_n")), F.lit(0.0))).first()
        fold = met >= 2 * rows
    ends = (lambda: (_places(left, "stem"), _places(right, "det"))) if fold else (lambda: (left, right))
    if fold:
        reach = spatial.sparse_reach(*ends(), keys, side, per, least, True)
    while True:
        last = reach >= side
        pairs = spatial.candidates(*ends(), keys, tol, up, most, gate and not fold, None if last else reach).where(F.col("dist") > done)
        won = checkpointed(_greedy_places(pairs, left, right, keys, up, gate) if fold else method(pairs, keys))
        taken = won if taken is None else taken.unionByName(won)
        if last:
            return taken
        left, right = (checkpointed(joined(df, won.select(*keys, c), [*keys, c], "left_anti")) for df, c in ((left, "stem"), (right, "det")))
        done = reach  # what is left of pairs as near as that is of heights that the gate keeps apart
        reach = min(side, max(1.5 * reach, spatial.sparse_reach(*ends(), keys, side, per, least, True, reach)))


def _placed(df: DataFrame, keys: list[str], item: str, more: list[str]) -> DataFrame:
    """Rows with _place, a number that those with equal keys, position and tolerances share, with heights or all without."""
    rows = df.select(*keys, item, "x", "y", "z", *more).withColumn("_row", F.monotonically_increasing_id())
    return rows.withColumn("_place", F.min("_row").over(W.partitionBy(*keys, "x", "y", F.col("z").isNull(), *more))).drop("_row")


def _places(df: DataFrame, item: str) -> DataFrame:
    """One row a place, with its number as its name."""
    return df.drop(item, "z").dropDuplicates(["_place"]).withColumnRenamed("_place", item)


def _greedy_places(pairs: DataFrame, left: DataFrame, right: DataFrame, keys: list[str], up: float | str, gate: bool) -> DataFrame:
    """What greedy() takes of the candidates that pairs of places stand for.

    pairs: keys, stem, det (places), dist, whatever their heights. All points of a place are as far from another's, so a task needs
    a cell's points and pairs of places: at each distance stems in their order take the first detection that is free in the places
    they reach and has a height that they allow.
    """
    own = [f"_m{i}" for i in range(len(keys))]
    z, top = F.col("z"), F.when(F.col(up).isNotNull(), F.col("z") + F.col(up)).otherwise(-math.inf) if isinstance(up, str) else F.col("z") + up
    side = lambda df, item, low, high: df.select(*[F.col(k).alias(o) for k, o in zip(keys, own, strict=True)], "_place", F.col(item).alias("_id"), low.cast("double").alias("_low"), high.cast("double").alias("_high"), (z.isNull() | F.lit(not gate)).alias("_any"), F.lit(item == "stem").alias("_left"))
    points = side(left, "stem", 0.5 * z, top).unionByName(side(right, "det", z, z))

    def kernel(cell: pd.DataFrame, members: pd.DataFrame) -> pd.DataFrame:
        cell = cell.sort_values("dist", kind="stable")
        members = members[members["_place"].isin(cell["stem"]) & members["_left"] | members["_place"].isin(cell["det"]) & ~members["_left"]]
        codes, names = pd.factorize(members["_id"].to_numpy(), sort=True, use_na_sentinel=False)
        found = _taken_in_places(cell["stem"].to_numpy(), cell["det"].to_numpy(), cell["dist"].to_numpy(), *_sides(members.assign(_id=codes)))
        stem, det, dist = zip(*found, strict=True) if found else ((), (), ())
        return cell[keys].iloc[np.zeros(len(found), int)].reset_index(drop=True).assign(stem=names[np.array(stem, int)], det=names[np.array(det, int)], dist=list(dist))

    kind = lambda df, c: f"`{c}` {df.schema[c].dataType.simpleString()}"
    schema = ", ".join([*(kind(pairs, k) for k in keys), kind(left, "stem"), kind(right, "det"), "dist double"])
    return pairs.groupBy(*keys).cogroup(points.groupBy(*own)).applyInPandas(kernel, schema)


class _Place:
    """Points of one place in the order of their heights, with the first name that is free in any run of them.

    low, high: places of a stem's bounds among the heights of all detections, or of a detection's height, twice. Neither falls.
    """

    __slots__ = ("high", "low", "names", "tree")

    def __init__(self, low: list[int], high: list[int], names: list[int]):
        n = len(names)
        self.low, self.high, self.names = low, high, names
        self.tree = [math.inf] * n + [name * n + k for k, name in enumerate(names)]  # the least of each two below
        for k in range(n - 1, 0, -1):
            self.tree[k] = min(self.tree[2 * k], self.tree[2 * k + 1])

    def first(self, start: int, end: int, used: set[int]) -> int | None:
        """The least name from start to before end; those of used leave."""
        tree, n = self.tree, len(self.names)
        while True:
            i, j, best = start + n, end + n, math.inf
            while i < j:
                if i & 1:
                    best, i = min(best, tree[i]), i + 1
                if j & 1:
                    j -= 1
                    best = min(best, tree[j])
                i, j = i // 2, j // 2
            if best == math.inf or best // n not in used:
                return None if best == math.inf else best // n
            k = best % n + n
            tree[k] = math.inf
            while k > 1:
                k //= 2
                tree[k] = min(tree[2 * k], tree[2 * k + 1])

    def any(self, used: set[int]) -> int | None:
        return self.first(0, len(self.names), used)

    def allowed(self, low: int, high: int, used: set[int]) -> int | None:
        """The first detection that is free and of a height from low to before high."""
        return self.first(bisect.bisect_left(self.low, low), bisect.bisect_left(self.low, high), used)

    def allowing(self, height: int, used: set[int]) -> int | None:
        """The first stem that is free and allows the height."""
        return self.first(bisect.bisect_right(self.high, height), bisect.bisect_right(self.low, height), used)


def _sides(members: pd.DataFrame) -> tuple[dict[int, _Place], dict[int, _Place]]:
    """The places of stems and of detections. Points without a height are last: only stems that allow any reach them."""
    stems, dets = (members[members["_left"] == k] for k in (True, False))
    levels = np.unique(dets["_low"].to_numpy()[~dets["_any"].to_numpy()])
    at = lambda df, c, side, other: np.where(df["_any"], other, np.searchsorted(levels, df[c].to_numpy(), side))
    stems = stems.assign(_low=at(stems, "_low", "left", 0), _high=at(stems, "_high", "right", len(levels) + 1))
    dets = dets.assign(_low=at(dets, "_low", "left", len(levels)), _high=at(dets, "_low", "left", len(levels)))
    return tuple(_by_place(df.sort_values(["_place", "_low", "_high"], kind="stable")) for df in (stems, dets))


def _by_place(df: pd.DataFrame) -> dict[int, _Place]:
    place, low, high, names = (df[c].to_numpy() for c in ("_place", "_low", "_high", "_id"))
    return {int(place[i]): _Place(low[i:j].tolist(), high[i:j].tolist(), names[i:j].tolist()) for i, j in _runs(place)}


def _runs(values: np.ndarray) -> list[tuple[int, int]]:
    """(start, end) of each run of equal values."""
    ends = [*(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist(), len(values)] if len(values) else []
    return list(zip([0, *ends[:-1]], ends)) if ends else []


def _taken_in_places(a: np.ndarray, b: np.ndarray, dist: np.ndarray, stems: dict[int, _Place], dets: dict[int, _Place]) -> list[tuple[int, int, float]]:
    """(stem, det, dist) taken of pairs of places in the order of their distance."""
    out, left, right = [], set(), set()
    waiting: dict[int, list[tuple[int, int, int]]] = {}

    def take(stem: int, det: int, d: float) -> None:
        out.append((stem, det, d))
        left.add(stem)
        right.add(det)

    for lo, hi in _runs(dist):
        reached: dict[int, list[_Place]] = {}
        for s, d in zip(a[lo:hi].tolist(), b[lo:hi].tolist(), strict=True):
            if stems[s].any(left) is not None and dets[d].any(right) is not None:
                reached.setdefault(s, []).append(dets[d])
        if len(reached) == 1:
            (s, found), = reached.items()
            if len(found) == 1 and len(found[0].names) == 1:  # one detection: no need to ask all stems
                stem = stems[s].allowing(found[0].low[0], left)
                if stem is not None:
                    take(stem, found[0].names[0], float(dist[lo]))
                continue
        queues = []
        for s in reached:
            of = stems[s]
            mine = waiting.get(s) or sorted(zip(of.names, of.low, of.high, strict=True))
            waiting[s] = [x for x in mine if x[0] not in left]
            queues.append([(*x, s) for x in waiting[s]])
        for stem, same in itertools.groupby(heapq.merge(*queues), key=lambda x: x[0]):
            options = [det for _, low, high, s in same for d in reached[s] if (det := d.allowed(low, high, right)) is not None]
            if options:
                take(stem, min(options), float(dist[lo]))
    return out


def iou_match(overlaps: DataFrame, keys: list[str], gate: float = 0.5) -> DataFrame:
    """(keys, pred_id, ref_id, iou): overlaps of at least the gate, the largest first, each label once."""
    ranked = overlaps.where(F.col("iou") >= gate).withColumn("cost", -F.col("iou"))
    return greedy(ranked, keys, "pred_id", "ref_id", "cost").select(*keys, "pred_id", "ref_id", (-F.col("cost")).alias("iou"))


def assignment(cost: np.ndarray) -> np.ndarray:
    """Column of each row in a least-cost assignment of a square matrix, by shortest augmenting paths."""
    n = len(cost)
    u, v, row_of, way = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1, int), np.zeros(n + 1, int)
    for i in range(1, n + 1):
        row_of[0], j0 = i, 0
        best, used = np.full(n + 1, np.inf), np.zeros(n + 1, bool)
        while True:
            used[j0] = True
            i0 = row_of[j0]
            gap = cost[i0 - 1] - u[i0] - v[1:]
            better = ~used[1:] & (gap < best[1:])
            best[1:][better] = gap[better]
            way[1:][better] = j0
            open_ = np.where(used[1:], np.inf, best[1:])
            j1 = int(np.argmin(open_)) + 1
            step = open_[j1 - 1]
            u[row_of[used]] += step
            v[used] -= step
            best[1:][~used[1:]] -= step
            j0 = j1
            if row_of[j0] == 0:
                break
        while j0:
            row_of[j0] = row_of[way[j0]]
            j0 = way[j0]
    out = np.empty(n, int)
    out[row_of[1:] - 1] = np.arange(n)
    return out


def optimal(pairs: DataFrame, keys: list[str], a: str = "stem", b: str = "det", cost: str = "dist") -> DataFrame:
    """Matching of most pairs and, among those, least total cost; staying single costs more than any pair.

    Being single is priced by connected groups of candidates, whose pairs alone are held: there is no matrix of a cell's points.
    """
    rows = pairs.select(*keys, a, b, cost)

    def kernel(cell: pd.DataFrame) -> pd.DataFrame:
        cell = cell.sort_values([a, b])
        li, ri = pd.factorize(cell[a])[0], pd.factorize(cell[b])[0]
        keep = _least_cost(li, ri, cell[cost].to_numpy(float))
        return cell.iloc[keep]

    return rows.groupBy(*keys).applyInPandas(kernel, _fields(rows, rows.columns))


def _connected(li: np.ndarray, ri: np.ndarray) -> np.ndarray:
    """The connected group of each pair of numbers, by labels that spread until nothing moves."""
    group = np.arange(li.max() + 1)
    while True:
        right = np.full(ri.max() + 1, len(group))
        np.minimum.at(right, ri, group[li])
        after = group.copy()
        np.minimum.at(after, li, right[ri])
        after = after[after]
        if (after == group).all():
            return group[li]
        group = after


def _least_cost(li: np.ndarray, ri: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """Positions of the pairs of a least-cost matching in which staying single costs 1 more than a connected group's dearest pair.

    Lefts come in one after the other along shortest augmenting paths over the candidates alone: memory is in proportion to these.
    """
    if not len(li):
        return np.empty(0, int)
    group = _connected(li, ri)
    single = np.full(int(group.max()) + 1, -np.inf)
    np.maximum.at(single, group, cost)
    gain = cost - 2 * (single[group] + 1)
    order = np.argsort(li, kind="stable")
    cols, c = ri[order], gain[order]
    starts = np.searchsorted(li[order], np.arange(li.max() + 2))
    n, m = len(starts) - 1, int(ri.max()) + 1
    u, v, row_of, col_of = np.zeros(n), np.zeros(m), np.full(m, -1), np.full(n, -1)
    at, best, way = np.full(n, -1), np.full(m, np.inf), np.full(m, -1)
    open_, pair, closed = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool)
    for i in range(n):
        lo, hi = starts[i], starts[i + 1]
        u[i] = min(0.0, (c[lo:hi] - v[cols[lo:hi]]).min())
        row, far, end, alone, done, touched = i, 0.0, np.inf, -1, [], []
        while True:
            lo, hi = starts[row], starts[row + 1]
            here = cols[lo:hi]
            to = far + (c[lo:hi] - u[row] - v[here])
            better = np.flatnonzero((to < best[here]) & ~closed[here])
            some = here[better]
            best[some] = open_[some] = to[better]
            way[some], pair[some] = row, lo + better
            touched.append(some)
            if far - u[row] < end:
                end, alone = far - u[row], row
            j = int(open_.argmin())
            if end <= open_[j]:
                far, last = end, -1
                break
            far, last = float(open_[j]), j
            if row_of[j] < 0:
                break
            open_[j], closed[j] = np.inf, True
            done.append(j)
            row = int(row_of[j])
        if done:
            k = np.array(done)
            closed[k] = False
            step = np.maximum(far - best[k], 0.0)
            v[k] -= step
            u[row_of[k]] += step
        u[i] += far
        if last < 0:  # a left stays single, and what it had goes to those before it
            last, col_of[alone], at[alone] = (int(col_of[alone]) if alone != i else -1), -1, -1
        while last >= 0:
            row, entry = int(way[last]), int(pair[last])
            free = int(col_of[row]) if row != i else -1
            row_of[last], col_of[row], at[row] = row, last, entry
            last = free
        for some in touched:
            best[some] = open_[some] = np.inf
    return np.sort(order[at[at >= 0]])


def soft_candidates(stems: DataFrame, dets: DataFrame, keys: list[str], tol: float = 4.0, weight: float = 0.5) -> DataFrame:
    """Candidates by sqrt(d2 + (weight * dz)^2) no more than tol, in place of the height gate."""
    dz = F.coalesce(F.col("r_z") - F.col("z"), F.lit(0.0)) * weight
    rows = spatial.within(stems, dets, tol, keys).withColumn("dist", F.sqrt(F.col("d2") + dz * dz))
    return rows.where(F.col("dist") <= tol).select(*keys, "stem", F.col("r_det").alias("det"), "dist")


def optimal_points(
    stems: DataFrame, dets: DataFrame, keys: list[str], tol: float = 4.0, up: float = 8.0, weight: float | None = None, per: float = 8.0, least: int = spatial.FEW_PAIRS,
) -> DataFrame:
    """The matching of optimal() over all candidates of stems and detections, or over soft_candidates() with a weight.

    Where their pairs are many, a cell's points go to its task and not their pairs (see assigning.match), so neither the shuffle nor
    a task grows with the square of the density. Of several matchings of one total cost either form has one, not always the same.
    """
    if spatial.sparse_reach(stems, dets, keys, tol, per, least) >= tol:
        return optimal(spatial.candidates(stems, dets, keys, tol, up) if weight is None else soft_candidates(stems, dets, keys, tol, weight), keys)
    side = lambda df, name, left: df.where("x is not null and y is not null and not isnan(x) and not isnan(y)").select(*keys, F.col(name).alias("_id"), "x", "y", F.col("z").cast("double").alias("z"), F.col("z").isNull().alias("_flat"), F.lit(left).alias("_left"))
    rows = side(stems, "stem", True).unionByName(side(dets, "det", False))
    # a number of its own, or cells of few bytes and much work would come to one task
    rows = rows.repartition(int(stems.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)

    def kernel(cell: pd.DataFrame) -> pd.DataFrame:
        cell = cell.sort_values(["_id", "x", "y", "z"], kind="stable")
        s, d = cell[cell._left], cell[~cell._left]
        (at, z, flat), (to, h, level) = ((p[["x", "y"]].to_numpy(float), p["z"].to_numpy(float), p["_flat"].to_numpy(bool)) for p in (s, d))
        no_more = lambda p, q: (p <= q) | np.isnan(q)  # noqa: E731  as SQL orders NaN

        def cost(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            dx, dy = at[i, 0][:, None] - to[j, 0], at[i, 1][:, None] - to[j, 1]
            d2 = dx * dx + dy * dy
            if weight is None:
                dist, low, high = np.sqrt(d2), z[i][:, None], h[j]
                fits = flat[i][:, None] | ~level[j] & no_more(0.5 * low, high) & no_more(high, low + up)
            else:
                dz = np.where(flat[i][:, None] | level[j], 0.0, h[j] - z[i][:, None]) * weight
                dist, fits = np.sqrt(d2 + dz * dz), True
            return np.where(fits & (d2 <= tol * tol) & (dist <= tol), dist, np.inf)

        names = [pd.factorize(p["_id"], use_na_sentinel=False)[0].astype(np.int64) for p in (s, d)]
        if len(s) <= len(d):  # the fewer seek
            i, j, dist = assigning.match(at, to, *names, tol, cost)
        else:
            j, i, dist = assigning.match(to, at, *names[::-1], tol, lambda p, q: cost(q, p).T)
        return s.iloc[i].assign(stem=s["_id"].to_numpy()[i], det=d["_id"].to_numpy()[j], dist=dist)[[*keys, "stem", "det", "dist"]]

    name = lambda df, c: f"{c} {df.schema[c].dataType.simpleString()}"
    return rows.groupBy(*keys).applyInPandas(kernel, f"{_fields(rows, keys)}, {name(stems, 'stem')}, {name(dets, 'det')}, dist double")


def in_turn(pairs: DataFrame, keys: list[str], a: str = "stem", b: str = "det", cost: str = "dist") -> DataFrame:
    """Left rows in their order each take the nearest right row that is free (ties: the first)."""
    rows = pairs.select(*keys, a, b, cost)

    def kernel(cell: pd.DataFrame) -> pd.DataFrame:
        used, keep = set(), []
        for _, mine in cell.sort_values([a, cost, b], kind="stable").groupby(a, sort=True):
            k = next((k for k, y in zip(mine.index, mine[b], strict=True) if y not in used), None)
            if k is not None:
                used.add(cell.at[k, b])
                keep.append(k)
        return cell.loc[keep]

    return rows.groupBy(*keys).applyInPandas(kernel, _fields(rows, rows.columns))


def nearest_in_turn(stems: DataFrame, dets: DataFrame, keys: list[str], tol: float, per: float = 8.0, least: int = spatial.FEW_PAIRS) -> DataFrame:
    """The matching of in_turn() over all stems and detections within tol, heights ungated.

    Where their pairs are many, a cell's points go to its task and not their pairs, and each stem looks for the nearest free
    detection in widening squares. Stems and detections have names of their own in a cell.
    """
    if spatial.sparse_reach(stems, dets, keys, tol, per, least) >= tol:
        return in_turn(spatial.candidates(stems, dets, keys, tol, gate=False), keys)
    side = lambda df, name, left: df.where("x is not null and y is not null").select(*keys, F.col(name).alias("_id"), "x", "y", F.lit(left).alias("_left"))
    rows = side(stems, "stem", True).unionByName(side(dets, "det", False))

    def kernel(cell: pd.DataFrame) -> pd.DataFrame:
        a, b = cell[cell._left].sort_values("_id"), cell[~cell._left].sort_values("_id")
        picks, dist = _free_in_turn(a[["x", "y"]].to_numpy(float), b[["x", "y"]].to_numpy(float), tol)
        out = a.assign(stem=a["_id"], dist=dist)[picks >= 0]
        return out.assign(det=b["_id"].to_numpy()[picks[picks >= 0]])[[*keys, "stem", "det", "dist"]]

    kinds = _fields(rows, keys)
    name = lambda df, c: f"{c} {df.schema[c].dataType.simpleString()}"
    return rows.groupBy(*keys).applyInPandas(kernel, f"{kinds}, {name(stems, 'stem')}, {name(dets, 'det')}, dist double")


def _free_in_turn(a: np.ndarray, b: np.ndarray, tol: float) -> tuple[np.ndarray, np.ndarray]:
    """(row of b or -1, distance) that each row of a takes in turn: the nearest that is free, the first of equally near ones."""
    picks, dist = np.full(len(a), -1), np.full(len(a), np.nan)
    free, low = np.arange(len(b)), np.minimum(a.min(axis=0, initial=np.inf), b.min(axis=0, initial=np.inf)) if len(a) and len(b) else None
    used, taken, step = np.zeros(len(b), bool), 0, tol / 32
    if low is None:
        return picks, dist

    def table() -> tuple[np.ndarray, np.ndarray]:
        at = np.floor((b[free] - low) / step).astype(np.int64)
        number = at[:, 0] * wide + at[:, 1]
        order = np.argsort(number, kind="stable")
        return number[order], free[order]

    wide = int(np.floor((max(a[:, 1].max(), b[:, 1].max()) - low[1]) / step)) + 2
    held, order = table()
    for i, (x, y) in enumerate(a):
        gx, gy = int((x - low[0]) // step), int((y - low[1]) // step)
        k = 1
        while True:
            lines = np.arange(gx - k, gx + k + 1) * wide
            starts = np.searchsorted(held, lines + max(gy - k, 0))
            ends = np.searchsorted(held, lines + min(gy + k, wide - 1), "right")
            near = np.concatenate([order[s:e] for s, e in zip(starts.tolist(), ends.tolist(), strict=True) if e > s] or [order[:0]])
            near = near[~used[near]]
            if len(near):
                d2 = (x - b[near, 0]) * (x - b[near, 0]) + (y - b[near, 1]) * (y - b[near, 1])
                d = np.sqrt(d2)
                d[(d2 > tol * tol) | (d > tol)] = np.inf
                least = d.min()
                # points outside of the square are at least k - 1 squares away; a lesser k would miss equally near ones
                if least < (k - 0.5) * step or (k * step > tol + step and least < np.inf):
                    j = int(near[d == least].min())
                    picks[i], dist[i], used[j] = j, least, True
                    taken += 1
                    break
            if k * step > tol + step:
                break
            k *= 2
        if taken > 1000 and taken * 4 > len(held):
            free, taken = free[~used[free]], 0
            held, order = table()
    return picks, dist


def agreement(matched: DataFrame, left: DataFrame, right: DataFrame, keys: list[str], a: str = "stem", b: str = "det") -> DataFrame:
    """(keys, n_left, n_right, diff, matched, jaccard, dz_mean, dz_sd): how far two sets agree by their matches.

    dz is the height of b less that of a over the matches; its sample deviation is NULL for fewer than two.
    """
    count = lambda df, name: df.groupBy(*keys).agg(F.count("*").alias(name))
    side = lambda df, item, z: df.select(*keys, F.col(item), F.col("z").alias(z))
    pairs = joined(joined(matched, side(left, a, "_za"), [*keys, a], "left"), side(right, b, "_zb"), [*keys, b], "left").withColumn("_dz", F.col("_zb") - F.col("_za"))
    found = pairs.groupBy(*keys).agg(F.count("*").alias("matched"), F.avg("_dz").alias("dz_mean"), F.stddev_samp("_dz").alias("dz_sd"))
    rows = joined(joined(count(left, "n_left"), count(right, "n_right"), keys, "full"), found, keys, "full").na.fill(0, ["n_left", "n_right", "matched"])
    rows = rows.withColumn("diff", F.col("n_left") - F.col("n_right"))
    return rows.withColumn("jaccard", F.try_divide(F.col("matched").cast("double"), F.col("n_left") + F.col("n_right") - F.col("matched")))


def suppress(points: DataFrame, keys: list[str], radius: float) -> DataFrame:
    """Points in the order of (x, y), each kept if no kept one lies within the radius."""
    rows = points.select(*keys, "x", "y")
    return rows.groupBy(*keys).applyInPandas(lambda cell: _suppressed(cell, radius), _fields(rows, rows.columns))


def suppress_by(points: DataFrame, keys: list[str], radius: str) -> DataFrame:
    """suppress() with a radius that is one of the keys."""
    rows = points.select(*keys, "x", "y")
    return rows.groupBy(*keys).applyInPandas(lambda cell: _suppressed(cell, float(cell[radius].iloc[0])), _fields(rows, rows.columns))


def _suppressed(cell: pd.DataFrame, radius: float) -> pd.DataFrame:
    cell = cell.sort_values(["x", "y"], kind="stable")
    grid: dict[tuple[int, int], list[tuple[float, float]]] = {}
    keep = []
    for x, y in zip(cell.x, cell.y, strict=True):
        gx, gy = int(x // radius), int(y // radius)
        near = (p for i in (-1, 0, 1) for j in (-1, 0, 1) for p in grid.get((gx + i, gy + j), ()))
        free = all((px - x) ** 2 + (py - y) ** 2 > radius * radius for px, py in near)
        if free:
            grid.setdefault((gx, gy), []).append((x, y))
        keep.append(free)
    return cell[keep]
