"""Joins by distance. Each is an equi-join on grid cells as wide as the radius, of which one side serves the
eight neighbours too, so no cartesian product appears; the exact distance is tested on what meets."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from stemwork.functions.scalars import squared
from stemwork.sources.scratch import checkpointed

from .keys import joined


#: Pairs that may be tested at once whatever the number of rows.
FEW_PAIRS = 1_000_000


def grid(df: DataFrame, x: str, y: str, side: float) -> DataFrame:
    """df with _gx and _gy, the grid cell of each row."""
    return df.withColumns({"_gx": F.floor(F.col(x) / side).cast("long"), "_gy": F.floor(F.col(y) / side).cast("long")})


def served(df: DataFrame, gx: str = "_gx", gy: str = "_gy") -> DataFrame:
    """df, with columns of its grid cell, nine times: _sx and _sy are the cells that a row may serve."""
    steps = F.array(*[F.struct(F.lit(i).cast("long").alias("i"), F.lit(j).cast("long").alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    rows = df.withColumn("_o", F.explode(steps))
    return rows.withColumns({"_sx": F.col(gx) + F.col("_o.i"), "_sy": F.col(gy) + F.col("_o.j")}).drop(gx, gy, "_o")


def within(left: DataFrame, right: DataFrame, radius: float, keys: list[str], xy: tuple[str, str] = ("x", "y"), prefix: str = "r_", how: str = "inner", extra: Column | None = None, turned: bool = False) -> DataFrame:
    """Pairs of rows with equal keys no more than `radius` apart.

    right's columns get the prefix and d2 is the squared distance. how: inner, left, left_semi or left_anti
    (the last two keep left's columns). Rows without a position meet nothing. extra: a further condition. turned: left serves
    the neighbouring cells, for inner joins of a left side that has fewer rows.
    """
    names = {c: prefix + c for c in right.columns}
    rows, around = grid(left, *xy, radius), grid(right, *xy, radius).withColumnsRenamed(names)
    if turned:
        rows = served(rows)
    else:
        around = served(around)
    d2 = squared(F.col(xy[0]), F.col(xy[1]), F.col(prefix + xy[0]), F.col(prefix + xy[1]))
    on = (F.col("_gx") == F.col("_sx")) & (F.col("_gy") == F.col("_sy"))
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(prefix + k))
    on = on & (d2 <= radius * radius)
    rows = rows.join(around, on if extra is None else on & extra, how)
    return rows.drop("_gx", "_gy") if how in ("left_semi", "left_anti") else rows.withColumn("d2", d2).drop("_gx", "_gy", "_sx", "_sy")


def sparse_reach(left: DataFrame, right: DataFrame, keys: list[str], most: float, per: float, least: int = FEW_PAIRS, past: bool = False, known: float = 0.0) -> float:
    """A radius up to `most` within which about `per` pairs a row meet, or `least` in all, judged by counts of grid cells.

    Where points lie on each other no radius has few pairs, and the search ends when a smaller one has hardly fewer. past: it goes
    on as long as most pairs are of different positions, so that crowds of any width have a radius. known: pairs within that don't count.
    """
    one = lambda df, a, b: df.where("x is not null and y is not null").select(*keys, "x", "y", F.lit(a).alias("_l"), F.lit(b).alias("_r"))
    rows, radius, before = one(left, 1, 0).unionByName(one(right, 0, 1)), float(most), math.inf

    def meeting(df: DataFrame, *at: str) -> tuple[float, int]:
        cells = df.groupBy(*keys, *at).agg(F.sum("_l").alias("_l"), F.sum("_r").alias("_r"))
        return cells.agg(F.coalesce(F.sum(9.0 * F.col("_l") * F.col("_r")), F.lit(0.0)), F.coalesce(F.sum(F.col("_l") + F.col("_r")), F.lit(0))).first()

    base = meeting(grid(rows, "x", "y", known), "_gx", "_gy")[0] if known else 0.0
    while True:
        met, n = meeting(grid(rows, "x", "y", radius), "_gx", "_gy")
        met, enough = max(met - base, 0.0), max(per * n, float(least))
        if met <= enough or radius <= known or (met > 0.9 * before and (not past or meeting(rows, "x", "y")[0] > met / 2)):
            return radius
        before, radius = met, radius * min(0.7, max(0.1, math.sqrt(enough / met)))


def widest(tol: float | str, most: float | None) -> float:
    """The largest tolerance, of which `most` tells where tol is a column."""
    side = float(tol) if not isinstance(tol, str) else float(most or 0)
    if side <= 0:
        raise ValueError("a column of tolerances needs its largest value")
    return side


def candidates(stems: DataFrame, dets: DataFrame, keys: list[str], tol: float | str = 4.0, up: float | str = 8.0, most: float | None = None, gate: bool = True, reach: float | None = None) -> DataFrame:
    """(keys, stem, det, dist) of stems and detections within tolerance and the height gate.

    stems: keys, stem, x, y, z; dets: keys, det, x, y, z. tol is a number or a column of stems, then with
    `most` as its largest value, which sets the grid; up is a number or a column of stems. reach: only pairs as near as that.
    """
    from stemwork.functions.scalars import height_gate

    side = widest(tol, most)
    near = side if reach is None else min(side, reach * (1 + 1e-9))  # by distance below, whose root may round
    pairs = within(stems, dets, near, keys).withColumn("dist", F.sqrt("d2"))
    pairs = pairs.where(F.col("dist") <= (F.col(tol) if isinstance(tol, str) else tol))
    if reach is not None:
        pairs = pairs.where(F.col("dist") <= reach)
    if gate:
        pairs = pairs.where(height_gate("z", "r_z", F.col(up) if isinstance(up, str) else up))
    return pairs.select(*keys, "stem", F.col("r_det").alias("det"), "dist")


def nearest(points: DataFrame, sources: DataFrame, tol: float, keys: list[str], point: str, source: str, label: str) -> DataFrame:
    """(keys, point, label) of the nearest source within tol; the first by `source` of equally near ones; NULL if none.

    Where many sources lie within tol, they are looked for in widening rings.
    """
    reach = sparse_reach(points, sources, keys, tol, 6.0)
    if reach < tol:
        here, there = points.select(*keys, F.col(point).alias("point"), "x", "y"), sources.select(*keys, F.col(source).alias("point"), F.col(label).alias("_label"), "x", "y")
        near = nearest_k(here, there, keys, 1, reach, tol).select(*keys, F.col("point").alias(point), F.col("r__label").alias("_label"))
    else:
        near = within(points, sources, tol, keys).groupBy(*keys, point).agg(F.min_by("r_" + label, F.struct("d2", "r_" + source)).alias("_label"))
    on = [F.col(c).eqNullSafe(F.col(f"_n_{c}")) for c in [*keys, point]]
    return points.join(near.withColumnsRenamed({c: f"_n_{c}" for c in [*keys, point]}), on, "left").select(*keys, point, F.col("_label").alias(label))


def assign(points: DataFrame, stems: DataFrame, keys: list[str], most: float) -> DataFrame:
    """(keys, point, stem): the nearest stem, if the point is within that stem's radius; NULL otherwise.

    stems: keys, stem, x, y, radius (NULL assigns nothing). Nearest comes first, the gate after: a point
    inside the radius of a stem that is not its nearest stays unassigned. most: the largest radius. Stems
    farther than that can be nearest but never assigned, so looking up to `most` decides all points.
    """
    near = within(points, stems, most, keys).groupBy(*keys, "point").agg(F.min(F.struct("d2", F.col("r_stem").alias("stem"), F.col("r_radius").alias("radius"))).alias("_m"))
    near = near.select(*[F.col(c).alias(f"_n_{c}") for c in [*keys, "point"]], F.when(F.col("_m.d2") <= F.col("_m.radius") * F.col("_m.radius"), F.col("_m.stem")).alias("stem"))
    return points.join(near, [F.col(c).eqNullSafe(F.col(f"_n_{c}")) for c in [*keys, "point"]], "left").select(*keys, "point", "stem")


def isolated(points: DataFrame, known: DataFrame, radius: float, keys: list[str]) -> DataFrame:
    """points with near: whether a known position lies within the radius."""
    hits = within(points, known, radius, keys, how="left_semi").withColumn("near", F.lit(True))
    return hits.unionByName(within(points, known, radius, keys, how="left_anti").withColumn("near", F.lit(False)))


def witnesses(points: DataFrame, wits: DataFrame, radius: float, keys: list[str], point: str, kind: str = "fam") -> DataFrame:
    """(keys, point, families): distinct families of witnesses within the radius, 0 if none.

    A witness of the point's own family doesn't count where points have that column.
    """
    other = F.col(kind) != F.col("r_" + kind) if kind in points.columns else None
    near = within(points, wits, radius, keys, extra=other).groupBy(*keys, point).agg(F.count_distinct("r_" + kind).alias("families"))
    on = [F.col(c).eqNullSafe(F.col(f"_n_{c}")) for c in [*keys, point]]
    return points.join(near.withColumnsRenamed({c: f"_n_{c}" for c in [*keys, point]}), on, "left").select(*keys, point, F.coalesce("families", F.lit(0)).cast("long").alias("families"))


def pairs_within(points: DataFrame, radius: float, keys: list[str], point: str, apart: str | None = None, dz: float | None = None) -> DataFrame:
    """(keys, a, b) with a < b: points within the radius, of different `apart`, heights no more than dz apart."""
    extra = F.col(point) < F.col("r_" + point)
    if apart:
        extra = extra & (F.col(apart) != F.col("r_" + apart))
    if dz is not None:
        extra = extra & (F.abs(F.col("z") - F.col("r_z")) <= dz)
    return within(points, points, radius, keys, extra=extra).select(*keys, F.col(point).alias("a"), F.col("r_" + point).alias("b"))


def halo(points: DataFrame, side: float, margin: float) -> DataFrame:
    """points, once for each tile (tx, ty) whose square widened by margin < side holds them; core where it is their own."""
    own_x, own_y = F.floor(F.col("x") / side), F.floor(F.col("y") / side)
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    rows = points.withColumn("_o", F.explode(steps)).withColumns({"tx": (own_x + F.col("_o.i")).cast("long"), "ty": (own_y + F.col("_o.j")).cast("long")})
    inside = lambda v, t: (F.col(v) >= F.col(t) * side - margin) & (F.col(v) < (F.col(t) + 1) * side + margin)
    return rows.withColumn("core", (F.col("_o.i") == 0) & (F.col("_o.j") == 0)).where(inside("x", "tx") & inside("y", "ty")).drop("_o")


def in_polygon(x: str, y: str, ring: str) -> Column:
    """Whether a point is inside a ring, an array of (x, y), by the parity of the edges that a ray crosses."""
    n = F.size(ring)
    edge = F.zip_with(ring, F.concat(F.slice(ring, 2, F.greatest(n - 1, F.lit(0))), F.slice(ring, 1, 1)), lambda p, q: ((p["y"] > F.col(y)) != (q["y"] > F.col(y))) & (F.col(x) < (q["x"] - p["x"]) * F.try_divide(F.col(y) - p["y"], q["y"] - p["y"]) + p["x"]))
    return F.size(F.filter(edge, lambda e: e)) % 2 == 1


def nearest_k(points: DataFrame, sources: DataFrame, keys: list[str], k: int, side: float, beyond: float | None = None, same: bool = True) -> DataFrame:
    """(keys, point, r_..., d2, place) of the k sources nearest to each point, place 1 being the nearest; ties go by r_point.

    points: keys, point, x, y; sources: keys, point, x, y, ... Rings of twice the radius, from `side` on or less where sources are dense, are searched for the points that have
    found fewer than k, so few far sources don't make many near ones meet. A point has fewer than k rows only if its group has
    fewer sources, or fewer are within `beyond`. same=False leaves out sources of the point's own name.
    """
    there = sources.where("x is not null and y is not null")
    reach = there.groupBy(*keys).agg(F.count("*").alias("_n"), *[f(c).alias(f"_{f.__name__}_{c}") for c in "xy" for f in (F.min, F.max)])
    open_ = joined(points.where("x is not null and y is not null").select(*keys, "point", "x", "y"), reach, keys)
    # no source is farther away than the farthest corner of their box
    far = lambda c: F.greatest(F.abs(F.col(c) - F.col(f"_min_{c}")), F.abs(F.col(c) - F.col(f"_max_{c}")))
    most = F.sqrt(far("x") * far("x") + far("y") * far("y"))
    open_ = open_.withColumn("_most", most if beyond is None else F.least(most, F.lit(float(beyond)))).select(*keys, "point", "x", "y", "_most")
    open_ = checkpointed(open_)
    out, radius = None, sparse_reach(open_, there, keys, side, 6.0 * k)
    while True:
        reached = radius if beyond is None else min(radius, float(beyond))
        near = within(open_, there, reached, keys, extra=None if same else F.col("point") != F.col("r_point"), turned=True).drop(*[f"r_{c}" for c in keys])
        order = W.partitionBy(*keys, "point").orderBy("d2", "r_point")
        ranked = near.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
        tally = ranked.groupBy(*keys, "point").agg(F.count("*").alias("_found"))
        state = joined(open_, tally, [*keys, "point"], "left")
        done = (F.coalesce(F.col("_found"), F.lit(0)) >= k) | (F.col("_most") <= reached)
        ended = ranked.join(_names(state.where(done), [*keys, "point"]), _equal([*keys, "point"]), "left_semi").drop("x", "y", "_most")
        ended = checkpointed(ended)
        out = ended if out is None else out.unionByName(ended)
        open_ = checkpointed(state.where(~done).drop("_found"))
        if open_.isEmpty():
            return out
        radius *= 2


def _names(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.select(*[F.col(c).alias(f"_nk{i}") for i, c in enumerate(keys)])


def _equal(keys: list[str]) -> list[Column]:
    return [F.col(c).eqNullSafe(F.col(f"_nk{i}")) for i, c in enumerate(keys)]
