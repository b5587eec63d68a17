"""Triangulated surfaces over clouds of any extent, tile by tile.

A triangulation here is the Delaunay triangles whose circumcircle has at most a given radius. Whether such a
triangle is one depends only on points within twice the radius of its corners, so tiles with a halo of that width give the
same triangles whatever their side, and each is reported by the tile of its first corner. Four points on one
circle have two triangulations: points are therefore moved by a millionth at most, by a rule of their place,
while it is decided which corners belong together; heights come from the places as they are.

Within a tile the triangles around a point are found by turning from neighbour to neighbour, for all points at once.
Candidates are the points within a distance that grows until it is certain that nothing farther away can matter.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .keys import joined
from .spatial import nearest_k

#: Candidates that a point has on average at first, and numbers that a step holds at once.
FIRST, HELD = 24, 2_000_000
SHIFT = 1e-6
EDGE = 1e-9


def _turned(x: str, y: str, a: float, b: float) -> Column:
    v = F.sin(F.col(x) * a + F.col(y) * b) * 43758.5453
    return (v - F.floor(v) - 0.5) * SHIFT


def _candidates(x: np.ndarray, y: np.ndarray, some: np.ndarray, reach: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """(points, matrix of the points within reach of each, -1 where there are no more) in blocks of `some` of bounded size."""
    gx, gy = np.floor((x - x.min()) / reach).astype(np.int64) + 1, np.floor((y - y.min()) / reach).astype(np.int64) + 1
    wide = gy.max() + 2
    cell = gx * wide + gy
    order = np.argsort(cell, kind="stable")
    keys = cell[order]
    starts, ends = [], []
    for step in (-wide, 0, wide):
        starts.append(np.searchsorted(keys, cell[some] + step - 1, "left"))
        ends.append(np.searchsorted(keys, cell[some] + step + 1, "right"))
    total = sum(e - s for s, e in zip(starts, ends))
    blocks, by_size = [], np.argsort(total, kind="stable")
    at = 0
    while at < len(some):
        # sizes ascend, so the last of a block sets its width
        n = len(by_size) - at
        while n > 1 and n * total[by_size[at + n - 1]] > HELD:
            n = max(1, n // 2)
        rows = by_size[at : at + n]
        at += n
        width = int(total[rows[-1]])
        found = np.full((n, width), -1, np.int64)
        left = np.zeros(n, np.int64)
        for s, e in zip(starts, ends):
            count = e[rows] - s[rows]
            inside = np.arange(int(count.max(initial=0)))[None, :] < count[:, None]
            r, c = np.nonzero(inside)
            found[r, left[r] + c] = order[s[rows][r] + c]
            left += count
        p = some[rows]
        d2 = (x[found] - x[p][:, None]) ** 2 + (y[found] - y[p][:, None]) ** 2
        found[(d2 > reach * reach) | (found == p[:, None])] = -1
        blocks.append((p, found))
    return blocks


def _around(x: np.ndarray, y: np.ndarray, p: np.ndarray, near: np.ndarray, radius: float, reach: float, final: bool) -> tuple[list[np.ndarray], np.ndarray]:
    """Triangles (p, b, c) around each of p among its candidates, and the points for which these don't settle them."""
    dx, dy = x[near] - x[p][:, None], y[near] - y[p][:, None]
    none = near < 0
    d2 = np.where(none, np.inf, dx * dx + dy * dy)
    rows = np.arange(len(p))
    start = d2.argmin(axis=1)
    alive = np.isfinite(d2[rows, start])
    unsure = ~alive if not final else np.zeros(len(p), bool)
    made = []
    closed = np.zeros(len(p), bool)
    for side in (1.0, -1.0):
        at = start.copy()
        go = np.nonzero(alive & ~closed & ~unsure)[0]
        for _ in range(near.shape[1]):
            if not len(go):
                break
            qx, qy = dx[go, at[go]], dy[go, at[go]]
            cross = side * (qx[:, None] * dy[go] - qy[:, None] * dx[go])
            with np.errstate(all="ignore"):
                t = np.where((cross > 0) & ~none[go], (d2[go] - qx[:, None] * dx[go] - qy[:, None] * dy[go]) / (2 * cross), np.inf)
            t[np.arange(len(go)), at[go]] = np.inf
            c = t.argmin(axis=1)
            best = t[np.arange(len(go)), c]
            there = np.isfinite(best)
            r2 = (qx * qx + qy * qy) * (0.25 + best * best)
            if final:
                fits = there & (r2 <= radius * radius)
            else:
                fits = there & (4 * r2 <= reach * reach)
                unsure[go[~fits]] = True
                fits &= r2 <= radius * radius
            made.append(np.stack([p[go[fits]], near[go[fits], at[go[fits]]], near[go[fits], c[fits]]], axis=1))
            at[go] = np.where(there, c, at[go])
            shut = there & (c == start[go])
            closed[go[shut]] = True
            go = go[there & ~shut & ~unsure[go]]
    return made, unsure


def delaunay(x: np.ndarray, y: np.ndarray, own: np.ndarray, radius: float) -> np.ndarray:
    """Rows (a, b, c), a < b < c, of the Delaunay triangles of circumradius up to `radius` whose first corner a is in own (a mask).

    Points must differ. All those within 2 * radius of the own ones must be there.
    """
    out, some = [], np.nonzero(own)[0]
    if len(x) < 3 or not len(some):
        return np.empty((0, 3), np.int64)
    area = max(float(np.ptp(x) * np.ptp(y)), 1e-12)
    reach = min(2 * radius, math.sqrt(FIRST * area / (math.pi * len(x))))
    while len(some):
        final = reach >= 2 * radius
        left = []
        for p, near in _candidates(x, y, some, reach):
            made, unsure = _around(x, y, p, near, radius, reach, final)
            found = np.concatenate([np.empty((0, 3), np.int64), *made])
            out.append(found[~np.isin(found[:, 0], p[unsure])])
            left.append(p[unsure])
        some = np.concatenate(left) if left else some[:0]
        reach = min(2 * radius, 2 * reach)
    found = np.concatenate(out)
    return np.sort(found[(found[:, 0] < found[:, 1]) & (found[:, 0] < found[:, 2])], axis=1)


def triangles(points: DataFrame, keys: list[str], radius: float, top: bool = False, tile: float | None = None) -> DataFrame:
    """keys, a, b, c (points, ascending) and ax, ay, az, bx, ... of the triangles of each group of points (keys, point, x, y, z).

    Triangles have circumradii of at most `radius`. Of points at one place the lowest counts, the highest if top, the first
    of equal ones. Rows without a place or height count for nothing, groups of fewer than three points have no triangle. tile: the side of
    tiles, 8 * radius if None; it changes how much a task holds, not the result.
    """
    side = float(tile or 8 * radius)
    kinds = points.select(*keys, "point").schema
    id_kind = kinds["point"].dataType.simpleString()
    row = F.struct((-F.col("z") if top else F.col("z")).alias("h"), F.col("point").alias("p"))
    known = points.where("x is not null and y is not null and z is not null")
    one = known.groupBy(*keys, "x", "y").agg(F.min(row).alias("m")).select(*keys, "x", "y", F.col("m.p").alias("point"), (-F.col("m.h") if top else F.col("m.h")).alias("z"))
    moved = one.withColumns({"_jx": F.col("x") + _turned("x", "y", 12.9898, 78.233), "_jy": F.col("y") + _turned("x", "y", 39.3468, 11.1351)})
    span = lambda c: F.sequence(F.floor((F.col(c) - 2 * radius) / side), F.floor((F.col(c) + 2 * radius) / side))
    served = moved.withColumn("_tx", F.explode(span("x"))).withColumn("_ty", F.explode(span("y")))
    served = served.withColumn("_own", (F.floor(F.col("x") / side) == F.col("_tx")) & (F.floor(F.col("y") / side) == F.col("_ty")))
    corners = [f"{n}{c}" for n in "abc" for c in "xyz"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kinds if f.name in keys), *(f"{n} {id_kind}" for n in "abc"), *(f"{c} double" for c in corners)])

    def run(key: tuple, tile_rows: pd.DataFrame) -> pd.DataFrame:
        rows = tile_rows.sort_values("point", ignore_index=True)
        found = delaunay(rows["_jx"].to_numpy(float), rows["_jy"].to_numpy(float), rows["_own"].to_numpy(bool), radius)
        out = {k: [v] * len(found) for k, v in zip(keys, key)}
        out |= {n: rows["point"].to_numpy()[found[:, i]] for i, n in enumerate("abc")}
        out |= {f"{n}{c}": rows[c].to_numpy(float)[found[:, i]] for i, n in enumerate("abc") for c in "xyz"}
        return pd.DataFrame(out)

    return served.groupBy(*keys, "_tx", "_ty").applyInPandas(run, schema)


def _weights(x: Column, y: Column) -> tuple[Column, Column, Column]:
    """What the corners a, b and c of a triangle weigh at a place; all of them are positive inside."""
    c = F.col
    whole = (c("by") - c("cy")) * (c("ax") - c("cx")) + (c("cx") - c("bx")) * (c("ay") - c("cy"))
    u = ((c("by") - c("cy")) * (x - c("cx")) + (c("cx") - c("bx")) * (y - c("cy"))) / whole
    v = ((c("cy") - c("ay")) * (x - c("cx")) + (c("ax") - c("cx")) * (y - c("cy"))) / whole
    return u, v, 1 - u - v


def heights(points: DataFrame, tri: DataFrame, keys: list[str], cell: float, out: str = "ground") -> DataFrame:
    """points (keys, point, x, y, ...) with the height of the triangles over them, of the first triangle on an edge; NULL where there is none.

    Triangles meet the points of the grid cells of side `cell` that their boxes touch.
    """
    span = lambda c: F.sequence(F.floor(F.least(f"a{c}", f"b{c}", f"c{c}") / cell - EDGE), F.floor(F.greatest(f"a{c}", f"b{c}", f"c{c}") / cell + EDGE))
    names = {k: f"_tk{i}" for i, k in enumerate(keys)}
    spread = tri.withColumnsRenamed(names).withColumn("_gx", F.explode(span("x"))).withColumn("_gy", F.explode(span("y")))
    on = [*(F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()), F.floor(F.col("x") / cell) == F.col("_gx"), F.floor(F.col("y") / cell) == F.col("_gy")]
    u, v, w = _weights(F.col("x"), F.col("y"))
    met = points.select(*keys, "point", "x", "y").join(spread, on).withColumns({"_u": u, "_v": v, "_w": w}).where(F.least("_u", "_v", "_w") >= -EDGE)
    z = F.col("_u") * F.col("az") + F.col("_v") * F.col("bz") + F.col("_w") * F.col("cz")
    first = met.groupBy(*keys, "point").agg(F.min(F.struct("a", "b", "c", z.alias("z")))["z"].alias(out))
    return joined(points, first, [*keys, "point"], "left")


def ground_heights(points: DataFrame, ground: DataFrame, keys: list[str], radius: float = 10.0, cell: float = 1.0, beyond: float = 50.0, k: int = 3, tile: float | None = None, out: str = "ground") -> DataFrame:
    """points with the height of the triangulated ground at them, and where no triangle is, of the k nearest ground points.

    The latter weigh by the inverse of their distance, and NULL stays where none is within `beyond`. Both tables: keys, point, x, y, z.
    """
    rows = heights(points, triangles(ground, keys, radius, tile=tile), keys, cell, "_in")
    outside = rows.where("_in is null").select(*keys, "point", "x", "y")
    near = nearest_k(outside, ground.select(*keys, "point", "x", "y", "z"), keys, k, radius, beyond)
    there = F.min(F.when(F.col("d2") == 0, F.struct("r_point", "r_z")))["r_z"]
    weight = F.when(F.col("d2") > 0, 1 / F.sqrt("d2"))
    guess = near.groupBy(*keys, "point").agg(there.alias("_at"), F.try_divide(F.sum(F.col("r_z") * weight), F.sum(weight)).alias("_far"))
    rows = joined(rows, guess, [*keys, "point"], "left")
    return rows.withColumn(out, F.coalesce("_in", "_at", "_far")).drop("_in", "_at", "_far")


def raster(tri: DataFrame, keys: list[str], res: float, corner: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """(keys, row, col, value): the height of the triangles over the centres of cells, of the first triangle on an edge.

    Rows count from corner (x0, y1) down and columns from it to the right; both may be below 1.
    """
    x0, y1 = corner
    low, high = lambda c: F.least(f"a{c}", f"b{c}", f"c{c}"), lambda c: F.greatest(f"a{c}", f"b{c}", f"c{c}")
    line = lambda a, b: F.sequence(F.ceil(a - 0.5 - EDGE), F.floor(b - 0.5 + EDGE))
    sized = tri.withColumns({"_cols": line((low("x") - x0) / res, (high("x") - x0) / res), "_rows": line((y1 - high("y")) / res, (y1 - low("y")) / res)})
    # a sequence runs down where a box holds no centre
    sized = sized.where(((high("x") - x0) / res + EDGE >= F.ceil((low("x") - x0) / res - 0.5 - EDGE) + 0.5) & ((y1 - low("y")) / res + EDGE >= F.ceil((y1 - high("y")) / res - 0.5 - EDGE) + 0.5))
    each = sized.withColumn("_c", F.explode("_cols")).withColumn("_r", F.explode("_rows"))
    u, v, w = _weights(x0 + (F.col("_c") + 0.5) * res, y1 - (F.col("_r") + 0.5) * res)
    met = each.withColumns({"_u": u, "_v": v, "_w": w}).where(F.least("_u", "_v", "_w") >= -EDGE)
    z = F.col("_u") * F.col("az") + F.col("_v") * F.col("bz") + F.col("_w") * F.col("cz")
    row, col = (F.col("_r") + 1).cast("int").alias("row"), (F.col("_c") + 1).cast("int").alias("col")
    return met.groupBy(*keys, row, col).agg(F.min(F.struct("a", "b", "c", z.alias("z")))["z"].alias("value"))


def _longest() -> Column:
    side = lambda m, n: (F.col(f"{m}x") - F.col(f"{n}x")) * (F.col(f"{m}x") - F.col(f"{n}x")) + (F.col(f"{m}y") - F.col(f"{n}y")) * (F.col(f"{m}y") - F.col(f"{n}y"))
    return F.greatest(side("a", "b"), side("b", "c"), side("a", "c"))


def canopy(points: DataFrame, keys: list[str], res: float, radius: float = 10.0, corner: tuple[float, float] = (0.0, 0.0), tile: float | None = None) -> DataFrame:
    """The surface through the highest points of a cloud (first returns): their triangulation at the centres of cells."""
    return raster(triangles(points, keys, radius, top=True, tile=tile), keys, res, corner)


def pit_free(points: DataFrame, keys: list[str], res: float, thresholds: tuple[float, ...] = (0.0, 10.0, 20.0), edges: tuple[float, float] = (0.0, 1.5), subcircle: float = 0.0, radius: float = 10.0, corner: tuple[float, float] = (0.0, 0.0), tile: float | None = None) -> DataFrame:
    """The highest of the surfaces through all points, and through those from each further threshold up.

    Triangles of the first layer have edges up to edges[0], those of the others up to edges[1]; 0 sets no limit. So pits inside crowns
    are covered, and gaps between crowns aren't. subcircle: the radius of eight points that stand for each, none if 0;
    `point` must then be a number.
    """
    if subcircle > 0:
        turn = F.explode(F.sequence(F.lit(0), F.lit(7))).alias("_s")
        around = points.select("*", turn)
        points = around.withColumns({
            "x": F.col("x") + subcircle * F.cos(F.col("_s") * (math.pi / 4)), "y": F.col("y") + subcircle * F.sin(F.col("_s") * (math.pi / 4)), "point": F.col("point") * 8 + F.col("_s"),
        }).drop("_s")
    layers = None
    for n, least in enumerate(thresholds):
        limit = edges[min(n, 1)]
        tri = triangles(points.where(F.col("z") >= least), keys, radius, top=True, tile=tile)
        layer = raster(tri if limit <= 0 else tri.where(_longest() <= limit * limit), keys, res, corner)
        layers = layer if layers is None else layers.unionByName(layer)
    return layers.groupBy(*keys, "row", "col").agg(F.max("value").alias("value"))
