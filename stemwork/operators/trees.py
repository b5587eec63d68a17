"""Trees in point clouds by layers of the canopy, by windows from the local density of trees, and by nearest neighbours at several scales.

All of them are joins and aggregates over clouds of any extent; no task holds a plot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from stemwork.functions.scalars import squared
from stemwork.sources.scratch import checkpointed

from . import rasters, spatial
from .keys import joined


def canopy_layers(points: DataFrame, keys: list[str], res: float, corner: tuple[float, float], thickness: float = 0.5, floor: float = 2.0) -> DataFrame:
    """(keys, layer, row, col, value): the surface of the cloud, then that of what lies more than `thickness` below it, and so on.

    Layer 1 is the uppermost. A cell's layers depend on its own points alone, so they are taken in one walk down its heights and
    not in rounds over the cloud. Points below `floor` and those without a place or height count for nothing.
    """
    x0, y1 = corner
    row, col = (F.floor((y1 - F.col("y")) / res) + 1).cast("int"), (F.floor((F.col("x") - x0) / res) + 1).cast("int")
    # one list a cell of the raster, of its distinct heights
    held = points.where((F.col("z") >= floor) & F.col("x").isNotNull() & F.col("y").isNotNull()).groupBy(*keys, row.alias("row"), col.alias("col")).agg(F.sort_array(F.collect_set("z"), asc=False).alias("_z"))
    none = F.array().cast("array<double>")
    down = lambda tops, z: F.when((F.size(tops) == 0) | (z <= F.element_at(tops, -1) - thickness), F.concat(tops, F.array(z))).otherwise(tops)
    tops = held.withColumn("_t", F.aggregate(F.transform("_z", lambda z: z.cast("double")), none, down))
    return tops.select(*keys, "row", "col", F.posexplode("_t").alias("layer", "value")).select(*keys, (F.col("layer") + 1).alias("layer"), "row", "col", "value")


def spread_apart(tops: DataFrame, keys: list[str], point: str, flat: float, deep: float | None = None) -> DataFrame:
    """tops (keys, point, x, y, z), from the highest down, each kept if no kept one is within `flat` of it in the plane (and, given `deep`, within that in space).

    Rounds settle all tops that no unsettled higher one is near: a top that is left without any is kept, and it
    removes those near it. So rounds follow the longest chain of tops that are near each other, not their number.
    """
    near = F.col("d2") <= flat * flat
    if deep is not None:
        near = near & (F.col("d2") + (F.col("z") - F.col("r_z")) * (F.col("z") - F.col("r_z")) <= deep * deep)
    higher = (F.col("r_z") > F.col("z")) | ((F.col("r_z") == F.col("z")) & (F.col(f"r_{point}") < F.col(point)))
    names = [*keys, point]
    above = checkpointed(spatial.within(tops, tops, flat, keys).where(near & higher).select(*names, F.col(f"r_{point}").alias("_by")))
    open_, kept = checkpointed(tops.select(*names)), None
    by = lambda df: df.select(*keys, F.col(point).alias("_by"))
    while True:
        won = checkpointed(joined(open_, above.select(*names).distinct(), names, "left_anti"))
        kept = won if kept is None else kept.unionByName(won)
        lost = joined(above, by(won), [*keys, "_by"], "left_semi").select(*names).distinct()
        open_ = checkpointed(joined(joined(open_, won, names, "left_anti"), lost, names, "left_anti"))
        if open_.isEmpty():
            return joined(tops, kept, names, "left_semi")
        above = checkpointed(joined(joined(above, by(open_), [*keys, "_by"], "left_semi"), open_, names, "left_semi"))


def layered_maxima(points: DataFrame, keys: list[str], size, most: float, res: float = 0.5, corner: tuple[float, float] = (0.0, 0.0), thickness: float = 0.5, flat: float = 3.0, deep: float = 5.0, floor: float = 2.0) -> DataFrame:
    """(keys, row, col, layer, x, y, z): treetops of all layers of the canopy.

    Each layer's surface is searched for local maxima, whose window is `size` (a Column of z, at most `most` wide). Of the
    maxima of all layers, from the highest down, those stay that have no kept one within `flat` in the plane and `deep` in
    space: so trees below others' crowns are found, and a crown's own lower layers make none. x and y are centres of cells; of equally
    high maxima that of the upper layer, then of the lesser row and column, comes first.
    """
    x0, y1 = corner
    cells = canopy_layers(points, keys, res, corner, thickness, floor)
    at = cells.select(*keys, "layer", F.struct("row", "col").alias("_place"), (x0 + (F.col("col") - 0.5) * res).alias("x"), (y1 - (F.col("row") - 0.5) * res).alias("y"), F.col("value").alias("z"))
    tops = rasters.local_maxima(at, [*keys, "layer"], "_place", size, most, floor)
    # a number of its own without a window over a group: layers, rows and columns are whole numbers
    tops = checkpointed(tops.withColumn("point", F.struct("layer", "_place")))
    return spread_apart(tops, keys, "point", flat, deep).select(*keys, F.col("_place.row").alias("row"), F.col("_place.col").alias("col"), "layer", "x", "y", "z")


def density_window(trees: Column, area: float, low: float, high: float, share: float = 0.75) -> Column:
    """Window for as many trees on an area: `share` of the side of the square that each of them has, held between low and high; high without trees."""
    return F.when(trees > 0, F.least(F.greatest(F.sqrt(area / trees) * share, F.lit(low)), F.lit(high))).otherwise(F.lit(high))


def auto_maxima(points: DataFrame, keys: list[str], point: str = "point", first: float = 5.0, around: float = 10.0, low: float = 2.0, high: float = 8.0, floor: float = 2.0) -> DataFrame:
    """Local maxima without parameters of the stand: windows come from the trees that a first pass of one window finds around each point.

    points: keys, point, x, y, z. The first pass has windows of width `first`; its tops within `around` of a point say how
    dense trees stand there, and density_window() what window that calls for. Columns: those of points and n_around.
    """
    rough = checkpointed(rasters.local_maxima(points, keys, point, F.lit(first), first, floor))
    some = points.where(F.col("z") >= floor)
    tally = spatial.within(some, rough.select(*keys, point, "x", "y"), around, keys).groupBy(*keys, point).agg(F.count("*").alias("n_around"))
    counted = joined(some, tally, [*keys, point], "left").na.fill(0, ["n_around"])
    return rasters.local_maxima(counted, keys, point, density_window(F.col("n_around"), 3.141592653589793 * around * around, low, high), high, floor)


def segments(points: DataFrame, keys: list[str], k: int, side: float) -> DataFrame:
    """(keys, point, parent): for each point the nearest higher one among its k nearest, NULL for an apex. Equal heights: the lesser point is higher."""
    near = spatial.nearest_k(points.select(*keys, "point", "x", "y"), points.select(*keys, "point", "x", "y", "z"), keys, k, side, same=False)
    with_z = joined(near, points.select(*keys, "point", F.col("z").alias("_z")), [*keys, "point"])
    up = with_z.where((F.col("r_z") > F.col("_z")) | ((F.col("r_z") == F.col("_z")) & (F.col("r_point") < F.col("point"))))
    parent = up.groupBy(*keys, "point").agg(F.min_by("r_point", "place").alias("parent"))
    return joined(points.select(*keys, "point"), parent, [*keys, "point"], "left")


def roots(forest: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, point, tree): the apex that each point's parents lead to, by jumping to the parent's parent until nothing moves."""
    now = checkpointed(forest.select(*keys, "point", F.coalesce("parent", "point").alias("tree")))
    while True:
        jump = now.select(*keys, F.col("point").alias("tree"), F.col("tree").alias("_next"))
        after = checkpointed(joined(now, jump, [*keys, "tree"]))
        if after.where("_next <> tree").isEmpty():
            return now
        now = after.select(*keys, "point", F.col("_next").alias("tree"))


def _shape(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, tree, n, score): how much a segment looks like a crown, 0 to 1: round in the plane, its apex over its middle.

    Roundness is the ratio of the lesser to the greater standard deviation along the axes of the segment; the middle counts by
    the distance of apex and mean over the root mean square distance from the mean. Segments on a line or of one place have 0.
    """
    apex = rows.where("point = tree").select(*keys, "tree", F.col("x").alias("_ax"), F.col("y").alias("_ay"))
    sums = rows.groupBy(*keys, "tree").agg(F.count("*").alias("n"), F.avg("x").alias("_mx"), F.avg("y").alias("_my"), F.var_pop("x").alias("_vx"), F.var_pop("y").alias("_vy"), F.covar_pop("x", "y").alias("_c"))
    both = joined(sums, apex, [*keys, "tree"])
    half, whole = (F.col("_vx") - F.col("_vy")) / 2, F.col("_vx") + F.col("_vy")
    gap = F.sqrt(half * half + F.col("_c") * F.col("_c"))
    round_ = F.sqrt(F.greatest(F.lit(0.0), whole / 2 - gap) / (whole / 2 + gap))
    middle = F.greatest(F.lit(0.0), 1 - F.sqrt(squared(F.col("_ax"), F.col("_ay"), F.col("_mx"), F.col("_my")) / whole))
    return both.select(*keys, "tree", "n", F.when(whole > 0, round_ * middle).otherwise(0.0).alias("score"))


def point_trees(points: DataFrame, keys: list[str], scales: tuple[int, ...] = (30, 15), side: float = 1.0, floor: float = 2.0) -> DataFrame:
    """(keys, point, tree): points from `floor` up with the apex of their tree, from segmentations at several scales.

    At a scale of k neighbours a point hangs on the nearest higher of them. Fewer neighbours cut more of these links and add
    none, so each scale's segments are parts of those of the one before. From the finest up, a segment replaces its
    parts if it looks at least as much like a crown (see _shape) as they do on average, weighed by points; else they stay. Groups of fewer points
    than the least scale have no tree.
    """
    some = points.where((F.col("z") >= floor) & F.col("x").isNotNull() & F.col("y").isNotNull()).select(*keys, "point", "x", "y", "z")
    enough = some.groupBy(*keys).count().where(F.col("count") >= min(scales)).select(*keys)
    some = checkpointed(joined(some, enough, keys, "left_semi"))
    best = None  # keys, point, tree of the best parts so far
    for k in sorted(scales):
        found = roots(segments(some, keys, k, side), keys)
        if best is None:
            best = found
            continue
        placed = joined(joined(best, found.withColumnRenamed("tree", "whole"), [*keys, "point"]), some, [*keys, "point"])
        placed = checkpointed(placed)
        parts = _shape(placed.drop("whole"), keys)
        of = placed.where("point = tree").select(*keys, "tree", "whole")
        average = joined(parts, of, [*keys, "tree"]).groupBy(*keys, "whole").agg((F.sum(F.col("n") * F.col("score")) / F.sum("n")).alias("_average"))
        wholes = _shape(placed.drop("tree").withColumnRenamed("whole", "tree"), keys).select(*keys, F.col("tree").alias("whole"), "score")
        takes = joined(wholes, average, [*keys, "whole"]).where(F.col("score") >= F.col("_average")).select(*keys, "whole", F.lit(True).alias("_take"))
        best = checkpointed(joined(placed, takes, [*keys, "whole"], "left").select(*keys, "point", F.when(F.col("_take"), F.col("whole")).otherwise(F.col("tree")).alias("tree")))
    return best
