"""A catalog of points in tiles with levels of detail: a scan of a box, at a depth, reads the tiles and levels that it needs.

A point's level is the coarsest at which it is the first, in an order drawn from its number, of its grid cell, whose
side halves from level to level; points that are the first of no cell have the last level. So levels 0 to d together
hold a point of every cell of level d that has any, spread evenly, and each point is stored once. Levels and tiles are folders,
and within them points follow a Morton curve, so boxes also skip row groups by the statistics of x and y.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Bits of either place on the curve, and steps that spread them apart. Fixed values.
BITS = 16
SPREAD = ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555))


def morton(x: Column, y: Column) -> Column:
    """The place on a Morton curve of whole numbers from 0 below 2**16."""

    def spread(v: Column) -> Column:
        v = v.cast("long")
        for shift, mask in SPREAD:
            v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask).cast("long"))
        return v

    return spread(x).bitwiseOR(F.shiftleft(spread(y), 1))


def levelled(points: DataFrame, base: float, depth: int, point: str = "point") -> DataFrame:
    """points (point, x, y, ...), point being unique, with level, 0 to depth. Cells of level 0 have the side `base`.

    The first points of all levels' cells come from one aggregate, in which a cell sends one row from each task. Points
    without a place have the last level.
    """
    each = points.where("x is not null and y is not null").select(point, "x", "y", F.explode(F.sequence(F.lit(0), F.lit(depth - 1))).alias("_l")) if depth else points.where("false").withColumn("_l", F.lit(0))
    side = F.lit(float(base)) / F.pow(F.lit(2.0), F.col("_l"))
    first = each.groupBy("_l", F.floor(F.col("x") / side).alias("_gx"), F.floor(F.col("y") / side).alias("_gy")).agg(F.min(F.struct(F.md5(F.col(point).cast("string")).alias("h"), F.col(point).alias("p")))["p"].alias("_p"))
    least = first.groupBy("_p").agg(F.min("_l").alias("_least"))
    return points.join(least, F.col(point) == F.col("_p"), "left").withColumn("level", F.coalesce("_least", F.lit(depth))).drop("_p", "_least")


def write_tiles(points: DataFrame, path: str, tile: float, base: float, depth: int, point: str = "point") -> None:
    """Writes points with a place as tiles of side `tile` and levels below path, and how they are laid out beside them.

    Ranges of (level, tile, curve) make the files, so a tile with many points is many files and none is a task's alone.
    """
    step = tile / (1 << BITS)
    inside = lambda c: F.least(F.floor((F.col(c) - F.floor(F.col(c) / tile) * tile) / step), F.lit((1 << BITS) - 1))
    rows = levelled(points.where("x is not null and y is not null"), base, depth, point)
    rows = rows.withColumns({"tx": F.floor(F.col("x") / tile), "ty": F.floor(F.col("y") / tile), "_curve": morton(inside("x"), inside("y"))})
    order = ["level", "tx", "ty", "_curve"]
    rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("_curve").write.partitionBy("level", "tx", "ty").parquet(f"{path}/tiles")
    points.sparkSession.range(1).select(F.lit(float(tile)).alias("tile"), F.lit(float(base)).alias("base"), F.lit(int(depth)).alias("depth")).write.parquet(f"{path}/layout")


def scan_tiles(spark: SparkSession, path: str, box: tuple[float, float, float, float] | None = None, depth: int | None = None) -> DataFrame:
    """Points of a catalog in a box (x0, y0, x1, y1), edges included, of levels 0 to depth; all of them if None.

    The box names the tiles that it touches, so other folders aren't listed as input, and the rest is pushed to the files.
    """
    rows = spark.read.parquet(f"{path}/tiles")
    if depth is not None:
        rows = rows.where(F.col("level") <= depth)
    if box is not None:
        tile = spark.read.parquet(f"{path}/layout").first()["tile"]
        x0, y0, x1, y1 = box
        rows = rows.where(F.col("tx").between(x0 // tile, x1 // tile) & F.col("ty").between(y0 // tile, y1 // tile) & F.col("x").between(x0, x1) & F.col("y").between(y0, y1))
    return rows


def finest_level(base: float, spacing: float) -> int:
    """The level whose cells are no wider than `spacing`: the depth for points about that far apart."""
    level = 0
    while base > spacing:
        base, level = base / 2, level + 1
    return level
