"""The sweep over a ladder of densities as one plan: clips, surfaces, treetops and scores of every plot and setting."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from stemwork.functions.scalars import window_size
from stemwork.sources.scratch import checkpointed

from . import detections, rasters, scoring, tin
from .keys import joined

#: First returns on an area unit from which surfaces may be finest, and from which they aren't smoothed. Fixed values.
DENSE = 8.0


def raster_maxima(raster: DataFrame, keys: list[str], size, most: float, res: float, corner: tuple[float, float], floor: float = 2.0) -> DataFrame:
    """(keys, det, x, y, z): cells from `floor` up without a higher one (of equal ones, an earlier one) within half their window; det numbers rows and columns, of up to 2**30 either way, in their order."""
    x0, y1 = corner
    number = (F.col("row").cast("long") + (1 << 30)) * (1 << 31) + F.col("col") + (1 << 30)
    at = raster.select(*keys, number.alias("det"), (x0 + (F.col("col") - 0.5) * res).alias("x"), (y1 - (F.col("row") - 0.5) * res).alias("y"), F.col("value").alias("z"))
    return rasters.local_maxima(at, keys, "det", size, most, floor)


def surfaces(clips: DataFrame, densities: DataFrame, keys: list[str], res: float, corner: tuple[float, float], radius: float, smooth_below: float = DENSE) -> DataFrame:
    """(keys, row, col, value): first-return triangulations with pits filled, smoothed where there are fewer first returns than smooth_below.

    clips: keys, point, x, y, z, ret; densities: keys, frdens.
    """
    plain = checkpointed(rasters.filled(tin.canopy(clips.where("ret = 1"), keys, res, radius, corner), keys))
    soft = rasters.smoothed(plain, keys).withColumnRenamed("value", "_soft")
    both = joined(joined(plain, soft, [*keys, "row", "col"]), densities.select(*keys, "frdens"), keys)
    return both.select(*keys, "row", "col", F.when(F.col("frdens") < smooth_below, F.col("_soft")).otherwise(F.col("value")).alias("value"))


def ladder(points: DataFrame, stems: DataFrame, plots: DataFrame, key: str, rungs: tuple[float, ...] = (8.0, 4.0, 2.0, 1.0), resolutions: tuple[float, ...] = (0.25, 0.5, 1.0), slopes: tuple[float, ...] = (0.05, 0.1, 0.15),
           buffer: float = 25.0, least: int = 100, ground: int = 10, cell: float = 1.0, radius: float = 10.0, dense: float = DENSE, low: float = 3.0, high: float = 5.0, tol: float = 4.0, corner: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """Scores of each plot, rung, resolution and window slope: key, rung (NULL for all points), pdens, frdens, chm_res, vwf_a and what score_plots() gives.

    points: key, point, x, y, z, class, ret; stems: key, stem, x, y, z, crown_class; plots: key, cx, cy, half. Clips
    have heights above the triangulated ground. A rung that isn't below a plot's own density makes nothing; the finest
    resolution is used from `dense` first returns on. Windows are slope * height + low, at most high. A plot whose clip is too small has no row at
    that rung. Settings are keys, so all plots and settings are matched and scored by one plan.
    """
    clips = dens = native = None
    for rung in (None, *rungs):
        mine, d = detections.prepared_clips(points, plots, [key], rung, buffer, least, ground, cell, by="tin", radius=radius)
        tagged = lambda df, rung=rung: df.withColumn("rung", F.lit(rung).cast("double"))
        mine, d = checkpointed(tagged(mine)), tagged(d)
        if rung is None:
            native = checkpointed(d)
            d = native
        else:
            known = native.select(F.col(key).alias("_key"), F.col("pdens").alias("_native"))
            d = d.join(known, F.col(key).eqNullSafe(F.col("_key"))).where(F.lit(float(rung)) < F.col("_native")).drop("_key", "_native")
        clips, dens = (mine, d) if clips is None else (clips.unionByName(mine), dens.unionByName(d))
    dens = checkpointed(dens)
    keys = [key, "rung"]
    clips = joined(clips, dens.select(*keys), keys, "left_semi")
    tops = settings = None
    for res in resolutions:
        allowed = dens if res > min(resolutions) else dens.where(F.col("frdens") >= dense)
        raster = checkpointed(surfaces(joined(clips, allowed.select(*keys), keys, "left_semi"), allowed, keys, res, corner, radius, dense))
        for slope in slopes:
            found = raster_maxima(raster, keys, window_size("z", slope, low, high), high, res, corner)
            setting = [F.lit(float(res)).alias("chm_res"), F.lit(float(slope)).alias("vwf_a")]
            found, here = found.select(*keys, *setting, "det", "x", "y", "z"), allowed.select(*keys, *setting, "pdens", "frdens")
            tops, settings = (found, here) if tops is None else (tops.unionByName(found), settings.unionByName(here))
    all_keys = [*keys, "chm_res", "vwf_a"]
    tops, settings = checkpointed(tops), checkpointed(settings)
    names = settings.select(*all_keys).withColumnRenamed(key, "_key")
    spread = lambda df: df.join(names, F.col(key).eqNullSafe(F.col("_key"))).drop("_key")
    scored = scoring.score_plots(spread(stems), tops, spread(plots.select(key, "cx", "cy", "half")), all_keys, tol)
    return joined(settings, scored, all_keys)
