"""Kernels over one plot's raster or points, run on grouped Arrow batches: a plot is bounded, plots are many.

Rasters are long tables (keys, row, col, value), row 1 at the top and column 1 at the left; a cell's number is
(row - 1) * columns + col. A cell that isn't there has no data.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from stemwork.functions.scalars import squared

from .keys import joined


def _kinds(df: DataFrame, keys: list[str]) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema)


def _by_plot(rows: DataFrame, keys: list[str]):
    """rows by plot, for kernels of much work on few rows: tasks stay as many as shuffle partitions, however small these are."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys).groupBy(*keys)


def surface(points: DataFrame, keys: list[str], res: float, top: str = "z", corner: tuple[float, float] | None = None) -> DataFrame:
    """(keys, row, col, value): highest point of each cell; rows count from the plot's greatest y down, or from a corner (x0, y1)."""
    if corner:
        x0, y1 = corner
        row, col = (F.floor((y1 - F.col("y")) / res) + 1).cast("int"), (F.floor((F.col("x") - x0) / res) + 1).cast("int")
        return points.withColumns({"row": row, "col": col}).groupBy(*keys, "row", "col").agg(F.max(top).alias("value"))
    box = points.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.min("x").alias("_x0"), F.max("y").alias("_y1"))
    rows = points.join(F.broadcast(box) if not keys else box, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])
    row, col = (F.floor((F.col("_y1") - F.col("y")) / res) + 1).cast("int"), (F.floor((F.col("x") - F.col("_x0")) / res) + 1).cast("int")
    return rows.withColumns({"row": row, "col": col}).groupBy(*keys, "row", "col").agg(F.max(top).alias("value"))


def smoothed(raster: DataFrame, keys: list[str]) -> DataFrame:
    """Mean of the cells present in each 3x3 square."""
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    spread = raster.withColumn("_o", F.explode(steps)).select(*keys, (F.col("row") + F.col("_o.i")).alias("row"), (F.col("col") + F.col("_o.j")).alias("col"), F.col("value").alias("_v"))
    means = spread.groupBy(*keys, "row", "col").agg(F.avg("_v").alias("_m"))
    return joined(raster, means, [*keys, "row", "col"]).select(*keys, "row", "col", F.col("_m").alias("value"))


def filled(raster: DataFrame, keys: list[str], depth: float = 1.0) -> DataFrame:
    """Pits filled: a cell more than `depth` below the median of its 8 neighbours takes that median."""
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j])
    spread = raster.withColumn("_o", F.explode(steps)).select(*keys, (F.col("row") + F.col("_o.i")).alias("row"), (F.col("col") + F.col("_o.j")).alias("col"), F.col("value").alias("_v"))
    middle = spread.groupBy(*keys, "row", "col").agg(F.median("_v").alias("_m"))
    value = F.when(F.col("_m") - F.col("value") > depth, F.col("_m")).otherwise(F.col("value"))
    return joined(raster, middle, [*keys, "row", "col"], "left").select(*keys, "row", "col", value.alias("value"))


def lookup(points: DataFrame, raster: DataFrame, keys: list[str], x0: float, y1: float, res: float, out: str = "value") -> DataFrame:
    """points with the raster's value at them, NULL where it has none."""
    row, col = (F.floor((y1 - F.col("y")) / res) + 1).cast("int"), (F.floor((F.col("x") - x0) / res) + 1).cast("int")
    r = raster.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("row").alias("_r"), F.col("col").alias("_c"), F.col("value").alias(out))
    on = [*[F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)], row == F.col("_r"), col == F.col("_c")]
    return points.join(r, on, "left").drop("_r", "_c", *[f"_k{i}" for i in range(len(keys))])


def local_maxima(points: DataFrame, keys: list[str], point: str, size, most: float, floor: float = 2.0) -> DataFrame:
    """Points from `floor` up without a higher one (of equal heights: an earlier one) within half their window.

    size: a Column of the window's width; most: its largest value. Nearly all points fall to the highest point of their
    own or a neighbouring grid cell, of which there is one a cell: of cells of an eighth of the largest window first, which leave about
    a point each however dense the cloud is, then of ones of its half and sixteenth. Only what is left meets all points around it, and it is
    that side which serves the neighbouring cells, so the cloud itself is moved once for the first cells and once for the last step.
    """
    from .spatial import grid, served

    side = most / 2
    columns = points.columns
    some = points.where((F.col("z") >= floor) & F.col("x").isNotNull() & F.col("y").isNotNull()).withColumn("_h", size / 2)
    names = {k: f"_lk{i}" for i, k in enumerate(keys)}
    above = (F.col("_d") < -F.col("z")) | ((F.col("_d") == -F.col("z")) & (F.col("_p") < F.col(point)))
    near = squared(F.col("x"), F.col("y"), F.col("_x"), F.col("_y")) <= F.least(F.col("_h"), F.lit(side)) * F.least(F.col("_h"), F.lit(side))
    same = [F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()]

    def narrowed(width: float) -> DataFrame:
        return grid(some, "x", "y", width).select(*[F.col(k).alias(n) for k, n in names.items()], F.col("_gx").alias("_ox"), F.col("_gy").alias("_oy"), (-F.col("z")).alias("_d"), F.col(point).alias("_p"), F.col("x").alias("_x"), F.col("y").alias("_y"))

    left = some
    for width in (side / 4, side, side / 8):
        # the tops of cells of that width, of those that are left after the first ones
        tops = grid(left, "x", "y", width).groupBy(*[F.col(k).alias(n) for k, n in names.items()], F.col("_gx").alias("_ox"), F.col("_gy").alias("_oy")).agg(F.min(F.struct((-F.col("z")).alias("_d"), F.col(point).alias("_p"), F.col("x").alias("_x"), F.col("y").alias("_y"))).alias("t")).select(*names.values(), "_ox", "_oy", "t.*")
        left = grid(left, "x", "y", width).join(served(tops, "_ox", "_oy"), [*same, F.col("_gx") == F.col("_sx"), F.col("_gy") == F.col("_sy"), above & near], "left_anti").drop("_gx", "_gy")
    left, narrow = grid(left, "x", "y", side), narrowed(side)
    left = left.groupBy(*columns, "_h", "_gx", "_gy").agg(F.count("*").cast("int").alias("_copies"))  # repeated rows stay as many
    around = served(left)
    met = around.join(narrow, [*same, F.col("_sx") == F.col("_ox"), F.col("_sy") == F.col("_oy"), above & near], "left")
    kept = met.groupBy(*columns, "_copies").agg(F.count("_d").alias("_n")).where("_n = 0")
    return kept.withColumn("_copies", F.explode(F.array_repeat(F.lit(0), F.col("_copies")))).select(*columns)


def markers(seeds: DataFrame, keys: list[str], x0: float, y1: float, res: float, rows: int, cols: int, order: str = "tree") -> DataFrame:
    """(keys, row, col, tree): the first seed of each cell; seeds off the raster go."""
    row, col = (F.floor((y1 - F.col("y")) / res) + 1).cast("int"), (F.floor((F.col("x") - x0) / res) + 1).cast("int")
    some = seeds.withColumns({"row": row, "col": col}).where(F.col("row").between(1, rows) & F.col("col").between(1, cols))
    return some.withColumn("_r", F.row_number().over(W.partitionBy(*keys, "row", "col").orderBy(order))).where("_r = 1").select(*keys, "row", "col", "tree")


def flood(value: np.ndarray, label: np.ndarray, floor: float) -> np.ndarray:
    """Seeded watershed: cells from `floor` up join, highest first, the basin of their highest labelled neighbour.

    Of equal heights the cell that came to the frontier first goes first, of equal neighbours the first of up,
    down, left and right. Cells that no basin reaches keep 0.
    """
    canopy = np.isfinite(value) & (value >= floor)
    out = np.where(canopy, label, 0)
    high, wide = value.shape
    heap: list[tuple[float, int, int, int]] = []
    queued, turn = np.zeros(value.shape, bool), 0

    def around(r: int, c: int):
        return ((i, j) for i, j in ((r - 1, c), (r + 1, c), (r, c - 1), (r, c + 1)) if 0 <= i < high and 0 <= j < wide)

    def offer(r: int, c: int) -> None:
        nonlocal turn
        for i, j in around(r, c):
            if canopy[i, j] and not out[i, j] and not queued[i, j]:
                queued[i, j] = True
                heapq.heappush(heap, (-value[i, j], turn, i, j))
                turn += 1

    for r, c in np.argwhere(out > 0):
        offer(int(r), int(c))
    while heap:
        _, _, r, c = heapq.heappop(heap)
        out[r, c] = max(((value[i, j], -k, out[i, j]) for k, (i, j) in enumerate(around(r, c)) if out[i, j]), key=lambda x: x[:2])[2]
        offer(r, c)
    return out


def walk(value: np.ndarray, label: np.ndarray, floor: float, beta: float = 1.0, tolerance: float = 1e-10) -> np.ndarray:
    """Random walker: each canopy cell joins the seed that a walker from it most probably meets first.

    Heights are scaled to 0..1, an edge weighs exp(-beta * difference^2) + 1e-6 and the Laplacian's diagonal
    1e-6 more. One system for each seed is solved by conjugate gradients, scaled by the diagonal; cells without a
    chance keep 0.
    """
    canopy = np.isfinite(value) & (value >= floor)
    number = np.full(value.shape, -1)
    number[canopy] = np.arange(canopy.sum())
    v = value[canopy]
    out = np.where(canopy, label, 0)
    seeds = [k for k in np.unique(out) if k]
    if not seeds:
        return out
    v = (v - v.min()) / (np.ptp(v) or 1.0)
    pairs = [np.stack([number[:, :-1].ravel(), number[:, 1:].ravel()]), np.stack([number[:-1].ravel(), number[1:].ravel()])]
    i, j = np.concatenate(pairs, axis=1)
    i, j = i[(keep := (i >= 0) & (j >= 0))], j[keep]
    w = np.exp(-beta * (v[i] - v[j]) ** 2) + 1e-6
    n = len(v)
    diagonal = np.bincount(i, w, n) + np.bincount(j, w, n) + 1e-6
    marked = out[canopy]
    free = marked == 0

    def times(x: np.ndarray) -> np.ndarray:
        return diagonal * x - np.bincount(i, w * x[j], n) - np.bincount(j, w * x[i], n)

    best, chance = marked.copy(), np.zeros(n)
    for k in seeds:
        known = (marked == k).astype(float)
        b = np.where(free, -times(known), 0.0)
        x, r = np.zeros(n), b.copy()
        z = r / diagonal
        p, rz = z.copy(), float(r @ z)
        for _ in range(20 * n):
            if float(r @ r) <= tolerance**2 * max(float(b @ b), 1e-300):
                break
            q = np.where(free, times(p), 0.0)
            a = rz / float(p @ q)
            x, r = x + a * p, r - a * q
            z = r / diagonal
            new = float(r @ z)
            p, rz = z + new / rz * p, new
        better = free & (x > chance + 1e-12)
        best[better], chance[better] = k, x[better]
    out[canopy] = best
    return out


def grow(value: np.ndarray, label: np.ndarray, floor: float, seed_share: float = 0.45, crown_share: float = 0.55, most: int = 10) -> np.ndarray:
    """Region growing after Dalponte and Coomes (2016): rounds in which a neighbour joins a crown if it is higher
    than seed_share of the seed and crown_share of the crown's mean, no higher than 1.05 of the seed, and
    within `most` cells of it."""
    out = np.where(np.isfinite(value) & (value >= floor), label, 0)
    at = {int(out[r, c]): (int(r), int(c)) for r, c in np.argwhere(out > 0)}
    sums = {k: [float(value[p]), 1] for k, p in at.items()}
    edge = [(*p, k) for k, p in at.items()]
    while edge:
        joined: dict[tuple[int, int], int] = {}
        for r, c, k in edge:
            sr, sc = at[k]
            top, mean = value[sr, sc], sums[k][0] / sums[k][1]
            for i, j in ((r - 1, c), (r, c - 1), (r, c + 1), (r + 1, c)):
                if 0 <= i < value.shape[0] and 0 <= j < value.shape[1] and not out[i, j] and (i, j) not in joined:
                    h = value[i, j]
                    if np.isfinite(h) and h >= floor and top * seed_share < h <= top * 1.05 and h > mean * crown_share and abs(i - sr) < most and abs(j - sc) < most:
                        joined[i, j] = k
        for (i, j), k in joined.items():
            out[i, j] = k
            sums[k][0] += float(value[i, j])
            sums[k][1] += 1
        edge = [(i, j, k) for (i, j), k in joined.items()]
    return out


def voronoi(value: np.ndarray, label: np.ndarray, floor: float, res: float = 1.0, reach: float = 0.6, share: float = 0.3) -> np.ndarray:
    """Nearest seed after Silva and others (2016), within reach * its height and above share of its height."""
    seeds = np.argwhere((label > 0) & np.isfinite(value))
    out = np.zeros_like(label)
    for r, c in np.argwhere(np.isfinite(value) & (value >= floor)):
        if len(seeds):
            d = np.hypot(seeds[:, 0] - r, seeds[:, 1] - c) * res
            s = tuple(seeds[int(np.argmin(d))])
            if d.min() <= reach * value[s] and value[r, c] >= share * value[s]:
                out[r, c] = label[s]
    return out


METHODS = {"watershed": flood, "random_walker": walk, "region_growing": grow, "voronoi": voronoi}


def segment(raster: DataFrame, seeds: DataFrame, keys: list[str], method: str = "watershed", floor: float = 2.0, **options) -> DataFrame:
    """(keys, row, col, value, label) by plot: crowns grown from seeds (keys, row, col, tree); 0 is background."""
    kernel = METHODS[method]
    rows = raster.join(seeds, [*keys, "row", "col"], "left").select(*keys, "row", "col", F.col("value").cast("double").alias("value"), F.coalesce("tree", F.lit(0)).cast("int").alias("tree"))

    def plot(cells: pd.DataFrame) -> pd.DataFrame:
        r, c = cells.row - cells.row.min(), cells.col - cells.col.min()
        value, label = np.full((r.max() + 1, c.max() + 1), np.nan), np.zeros((r.max() + 1, c.max() + 1), int)
        value[r, c], label[r, c] = cells.value, cells.tree
        return cells[[*keys, "row", "col", "value"]].assign(label=kernel(value, label, floor, **options)[r, c].astype("int32"))

    return rows.groupBy(*keys).applyInPandas(plot, f"{_kinds(rows, keys)}, row int, col int, value double, label int")


def truncated(labels: DataFrame, heights: DataFrame, keys: list[str], share: float = 0.55) -> DataFrame:
    """labels with 0 where the value is below share * the height of the label's seed (keys, tree, z), if it has one."""
    h = heights.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("tree").alias("_t"), F.col("z").alias("_z"))
    rows = labels.join(h, [*[F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)], F.col("label") == F.col("_t")], "left")
    cut = F.coalesce(F.col("value") < share * F.col("_z"), F.lit(False))
    return rows.select(*keys, "row", "col", "value", F.when(cut, 0).otherwise(F.col("label")).alias("label"))


def crowns(labels: DataFrame, keys: list[str], res: float) -> DataFrame:
    """(keys, label, cells, area, d_eq, cx, cy, top): size, equivalent diameter, mean place (in cells) and height."""
    out = labels.where("label > 0").groupBy(*keys, "label").agg(F.count("*").alias("cells"), F.avg("col").alias("cx"), F.avg("row").alias("cy"), F.max("value").alias("top"))
    area = F.col("cells") * (res * res)
    return out.withColumns({"area": area, "d_eq": 2 * F.sqrt(area / F.pi())})


def hull(points: np.ndarray) -> np.ndarray:
    """Corners of the convex hull, by the monotone chain."""
    points = np.unique(points, axis=0)
    if len(points) < 3:
        return points

    def side(ps) -> list[np.ndarray]:
        chain: list[np.ndarray] = []
        for p in ps:
            while len(chain) > 1 and (chain[-1][0] - chain[-2][0]) * (p[1] - chain[-2][1]) <= (chain[-1][1] - chain[-2][1]) * (p[0] - chain[-2][0]):
                chain.pop()
            chain.append(p)
        return chain[:-1]

    return np.array(side(points) + side(points[::-1]))


def diameters(points: DataFrame, keys: list[str], label: str = "inst", least: int = 5) -> DataFrame:
    """(keys, label, n_pts, d_eq, d_caliper): diameters from the hull's area and its farthest corners; NULL for few points."""
    rows = points.where(F.col(label).isNotNull()).select(*keys, label, F.col("x").cast("double"), F.col("y").cast("double"))

    def measure(part: pd.DataFrame) -> pd.DataFrame:
        d_eq = caliper = None
        if len(part) >= least:
            h = hull(part[["x", "y"]].to_numpy())
            x, y = h[:, 0], h[:, 1]
            d_eq = 2 * math.sqrt(abs(float(x @ np.roll(y, -1) - np.roll(x, -1) @ y)) / 2 / math.pi)
            caliper = float(np.sqrt(((h[:, None] - h[None]) ** 2).sum(-1)).max())
        return part.iloc[:1][[*keys, label]].assign(n_pts=len(part), d_eq=d_eq, d_caliper=caliper).astype({"d_eq": float, "d_caliper": float})

    return rows.groupBy(*keys, label).applyInPandas(measure, f"{_kinds(rows, [*keys, label])}, n_pts long, d_eq double, d_caliper double").withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("d_eq", "d_caliper")})


def trees(points: DataFrame, keys: list[str], near: float = 1.5, far: float = 2.0, tall: float = 15.0, reach: float = 10.0, floor: float = 2.0) -> DataFrame:
    """(keys, x, y, z) of tree tops after Li and others (2012): from the highest point left, lower points join the
    tree or stay for later by their distances to both, with a wider gap (far) above the height `tall`.

    Written from the paper; other implementations differ in detail.
    """
    rows = points.where(F.col("z") >= floor).select(*keys, *[F.col(c).cast("double") for c in "xyz"])

    def plot(p: pd.DataFrame) -> pd.DataFrame:
        a = p.sort_values(["z", "x", "y"], ascending=[False, True, True])[["x", "y", "z"]].to_numpy()
        out = pd.DataFrame(a[grown_tops(a, near, far, tall, reach)], columns=["x", "y", "z"])
        return out.assign(**{k: p[k].iloc[0] for k in keys})[[*keys, "x", "y", "z"]]

    return _by_plot(rows, keys).applyInPandas(plot, f"{_kinds(rows, keys)}, x double, y double, z double")


def nearest_before(a: np.ndarray, some: np.ndarray, pool: np.ndarray, limit: np.ndarray) -> dict[int, list[int]]:
    """For rows `some` of a the nearest rows of pool (in their order) that come before them, all of equally near ones, no farther than limit.

    Grids of doubling cells, from a sixteenth of the largest limit, are searched for the rows that have found none.
    """
    found, most = {}, float(limit.max(initial=0.0))
    side = most / 16
    while len(some) and len(pool) and side > 0:
        last = side >= most
        low = a[:, :2].min(axis=0)
        place = np.floor((a[:, :2] - low) / side).astype(np.int64) + 1
        wide = int(place[:, 1].max()) + 2
        number = place[:, 0] * wide + place[:, 1]
        order = pool[np.argsort(number[pool], kind="stable")]
        held, mine = number[order], some[np.argsort(number[some], kind="stable")]
        rest = []
        for group in np.split(mine, np.flatnonzero(np.diff(number[mine])) + 1):
            cell = number[group[0]]
            ends = [(np.searchsorted(held, cell + k * wide - 1), np.searchsorted(held, cell + k * wide + 1, "right")) for k in (-1, 0, 1)]
            near = np.concatenate([order[i:j] for i, j in ends])
            if not len(near):
                rest.append(group)
                continue
            step = max(1, 2_000_000 // len(near))
            for part in (group[k : k + step] for k in range(0, len(group), step)):
                dx, dy = a[part, None, 0] - a[None, near, 0], a[part, None, 1] - a[None, near, 1]
                d = np.where(near[None] < part[:, None], np.sqrt(dx * dx + dy * dy), np.inf)
                least = d.min(axis=1)
                ok = least <= np.minimum(limit[part], most if last else side)
                for k in np.flatnonzero(ok):
                    found[int(part[k])] = near[d[k] == least[k]].tolist()
                rest.append(part[~ok & (limit[part] > side)])
        some = np.concatenate(rest) if rest and not last else some[:0]
        side = min(most, side * 2)
    return found


def grown_tops(a: np.ndarray, near: float, far: float, tall: float, reach: float) -> list[int]:
    """Rows of a (x, y, z; highest first) that start a tree.

    A point joins the tree if the nearest of the points before it is in the tree, near enough, so points hang on the nearest point
    before them, and trees are what hangs on a top. Only points whose nearest one is beyond the tree's reach, or went with
    an earlier tree, are looked at again.
    """
    n, every = len(a), np.arange(len(a))
    limit, alive = np.where(a[:, 2] > tall, far, near), np.ones(len(a), bool)
    above = nearest_before(a, every, every, limit)
    first, below = np.full(n, -1), {}
    tied = set()

    def hang(q: int, on: list[int]) -> None:
        first[q] = on[0]
        for k in on:
            below.setdefault(k, []).append(q)
        tied.discard(q)
        if len(on) > 1:
            tied.add(q)

    for q, on in above.items():
        hang(q, on)
    tops, start = [], 0
    while True:
        start += int(np.argmax(alive[start:])) if start < n else 0
        if start >= n or not alive[start]:
            return tops
        top = start
        tops.append(top)
        inside = alive & ((a[:, 0] - a[top, 0]) ** 2 + (a[:, 1] - a[top, 1]) ** 2 <= reach**2)
        cut = np.flatnonzero(inside & (first >= 0) & ~inside[first])
        if tied:
            cut = np.array([q for q in cut.tolist() if q not in tied or not any(inside[k] for k in above[q])], dtype=np.int64)
        extra: dict[int, list[int]] = {}
        if len(cut):
            for q, on in nearest_before(a, cut, np.flatnonzero(inside), limit).items():
                for k in on:
                    extra.setdefault(k, []).append(q)
        mine, open_ = {top}, [top]
        moved = set(cut.tolist())
        while open_:
            k = open_.pop()
            for q in (*(q for q in below.get(k, ()) if q not in moved), *extra.get(k, ())):
                if q not in mine and inside[q]:
                    mine.add(q)
                    open_.append(q)
        gone = np.fromiter(mine, np.int64, len(mine))
        alive[gone] = False
        lost = {q for k in mine for q in below.pop(k, ()) if alive[q]}
        again = []
        for q in lost:
            on = [k for k in above[q] if alive[k]]
            above[q] = on
            if on:
                first[q] = on[0]
            else:
                first[q] = -1
                again.append(q)
        if again:
            new = nearest_before(a, np.array(sorted(again)), np.flatnonzero(alive), limit)
            for q, on in new.items():
                above[q] = on
                hang(q, on)


def mean_shift(points: DataFrame, keys: list[str], width: float = 0.4, depth: float = 0.8, floor: float = 2.0, rounds: int = 20) -> DataFrame:
    """(keys, x, y, z, mode): points with the number of the mode that a mean shift leads them to; the kernel is a
    cylinder of width * z across and depth * z high around each place (after Ferraz and others, 2016)."""
    rows = points.where(F.col("z") >= floor).select(*keys, *[F.col(c).cast("double") for c in "xyz"])

    def plot(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(["x", "y", "z"])
        a = p[["x", "y", "z"]].to_numpy()
        m = a.copy()
        for _ in range(rounds):
            moved = _shifted(a, m, width, depth)
            still = np.abs(moved - m).max() < 1e-3
            m = moved
            if still:
                break
        modes = pd.factorize(pd.Series([tuple(x) for x in np.round(m / 0.5).astype(int)]))[0]
        return p[[*keys, "x", "y", "z"]].assign(mode=modes.astype("int32"))

    return _by_plot(rows, keys).applyInPandas(plot, f"{_kinds(rows, keys)}, x double, y double, z double, mode int")


def _shifted(a: np.ndarray, m: np.ndarray, width: float, depth: float, side: float = 0.5) -> np.ndarray:
    """Places m moved to the weighted means of the points a in their cylinders; places of one square meet the points around it alone."""
    low = np.minimum(a[:, :2].min(axis=0), m[:, :2].min(axis=0))
    at, here = (np.floor((v[:, :2] - low) / side).astype(np.int64) for v in (a, m))
    wide = int(max(at[:, 1].max(), here[:, 1].max())) + 1
    number, mine = at[:, 0] * wide + at[:, 1], here[:, 0] * wide + here[:, 1]
    order = np.argsort(number, kind="stable")
    held, by = number[order], np.argsort(mine, kind="stable")
    moved = m.copy()
    for group in np.split(by, np.flatnonzero(np.diff(mine[by])) + 1):
        across, high = np.maximum(width * m[group, 2] / 2, 1e-9), np.maximum(depth * m[group, 2] / 2, 1e-9)
        k = int(across.max() // side) + 1
        x, y = here[group[0]]
        left, right = max(y - k, 0), min(y + k, wide - 1)
        near = np.concatenate([order[np.searchsorted(held, i * wide + left) : np.searchsorted(held, i * wide + right, "right")] for i in range(max(x - k, 0), x + k + 1)])
        p, step = a[np.sort(near)], max(1, 1_000_000 // max(1, len(near)))
        for some in (slice(i, i + step) for i in range(0, len(group), step)):
            q = m[group[some]]
            d = np.subtract.outer(q[:, 0], p[:, 0])
            d *= d
            e = np.subtract.outer(q[:, 1], p[:, 1])
            d += e * e
            d /= (across[some] * across[some])[:, None]
            h = np.abs(np.subtract.outer(q[:, 2], p[:, 2]), out=e)
            h /= high[some, None]
            inside = np.nonzero((d <= 1) & (h <= 1))
            w = np.zeros(d.shape)
            w[inside] = np.exp(-5 * d[inside]) * (1 - h[inside])
            total = w.sum(axis=1)
            some_weight = total > 0
            moved[group[some][some_weight]] = (w @ p)[some_weight] / total[some_weight, None]
    return moved


def snap(apexes: DataFrame, tops: DataFrame, keys: list[str], radius: float = 2.0) -> DataFrame:
    """apexes moved to the highest top within the radius, where there is one. Both: keys, point, x, y, z."""
    from .spatial import within

    best = within(apexes, tops, radius, keys).groupBy(*keys, "point").agg(F.max_by(F.struct("r_x", "r_y", "r_z"), F.struct("r_z", -F.col("r_point"))).alias("_b"))
    rows = joined(apexes, best, [*keys, "point"], "left")
    return rows.select(*keys, "point", *[F.coalesce(F.col(f"_b.r_{c}"), F.col(c)).alias(c) for c in "xyz"])


def cylinders(points: DataFrame, keys: list[str], step: float) -> DataFrame:
    """(keys, cx, cy): centres in steps from the least x and y of each group's points that cover their box, its far edges included."""
    box = points.groupBy(*keys).agg(*[f(c).cast("double").alias(f"_{f.__name__}_{c}") for c in "xy" for f in (F.min, F.max)])

    def line(c: str):
        low, high = F.col(f"_min_{c}"), F.col(f"_max_{c}")
        steps = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((high - low) / step).cast("int")))
        return F.explode(F.array_distinct(F.transform(steps, lambda k: F.least(high, low + k * step))))

    return box.where("_min_x is not null and _min_y is not null").withColumn("cx", line("x")).withColumn("cy", line("y")).select(*keys, "cx", "cy")


def above_ground(dets: DataFrame, ground: DataFrame, keys: list[str], x0: float, y1: float, res: float) -> tuple[DataFrame, DataFrame]:
    """(detections less the ground's height, (keys, n_dropped) of those off the ground raster)."""
    rows = lookup(dets, ground, keys, x0, y1, res, "_g")
    dropped = rows.groupBy(*keys).agg(F.count_if(F.col("_g").isNull()).alias("n_dropped"))
    return rows.where("_g is not null").withColumn("z", F.col("z") - F.col("_g")).drop("_g"), dropped


def failed_cells(kept: DataFrame, dropped: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of cells that had detections and lost all of them: their arm failed there, it did not find nothing."""
    names = {k: f"_k{i}" for i, k in enumerate(keys)}
    left = kept.select(*[F.col(k).alias(n) for k, n in names.items()])
    return dropped.where("n_dropped > 0").join(left, [F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()], "left_anti").select(*keys)
