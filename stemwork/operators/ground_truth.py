"""Building the reference population, and comparing populations and vintages of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from stemwork.functions.scalars import canopy_class, half_extent, in_box, polar, tile_name

from .selection import height_classes, keep


def located(mapped: DataFrame, points: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(stems with x, y and pos_unc, keys of points that are missing).

    mapped: stem, ptloc, distance, azimuth; points: ptloc, easting, northing, unc. Stems whose point is not
    known keep NULL positions.
    """
    p = points.dropDuplicates(["ptloc"]).withColumnRenamed("ptloc", "_p")
    rows = mapped.join(p, F.col("ptloc") == F.col("_p"), "left").drop("_p")
    x, y = polar("easting", "northing", "distance", "azimuth")
    missing = mapped.select("ptloc").distinct().join(p, F.col("ptloc") == F.col("_p"), "left_anti")
    return rows.withColumns({"x": x, "y": y}).withColumnRenamed("unc", "pos_unc").drop("easting", "northing"), missing


def measured(stems: DataFrame, measurements: DataFrame, year: int) -> DataFrame:
    """stems with the measurement nearest to the year (ties: the earlier row), its year and how far off it is.

    measurements: stem, row, date (text that starts with the year), height, dbh, position, status.
    """
    when = F.substring("date", 1, 4).try_cast("int")
    m = measurements.withColumn("meas_year", when).withColumn("off", F.abs(F.col("meas_year") - year))
    m = keep(m, ["stem"], F.col("off").asc_nulls_last(), F.col("row")).withColumnRenamed("stem", "_s").drop("row", "date")
    return stems.join(m, F.col("stem") == F.col("_s"), "left").drop("_s")


def population(stems: DataFrame, plots: DataFrame) -> DataFrame:
    """Living trees with a position inside their plot's core, their class from the canopy position or, where that
    says nothing, from the plot's heights, and their tile.

    stems: stem, plot, x, y, height, position, status; plots: plot, plot_type, cx, cy.
    """
    p = keep(plots, ["plot"], F.col("plot_type")).withColumnRenamed("plot", "_p")
    rows = stems.join(p, F.col("plot") == F.col("_p")).drop("_p")
    rows = rows.where(F.lower("status").startswith("live") & F.col("x").isNotNull() & in_box("x", "y", "cx", "cy", half_extent("plot_type")))
    rows = height_classes(rows, ["plot"], "height")
    return rows.withColumns({"crown_class": F.coalesce(canopy_class("position"), "height_class"), "tile": tile_name("x", "y")}).drop("height_class")


def tiles(stems: DataFrame) -> DataFrame:
    """(tile, n): living stems by tile."""
    return stems.groupBy("tile").agg(F.count("*").alias("n"))


def vintages(a: DataFrame, b: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Values of two poolings by key and their differences; a key that one lacks has NULLs there."""
    left = a.select(*keys, *[F.col(v).alias(f"{v}_a") for v in values])
    right = b.select(*keys, *[F.col(v).alias(f"{v}_b") for v in values])
    rows = left.join(right, keys, "full")
    return rows.withColumns({f"d_{v}": F.col(f"{v}_b") - F.col(f"{v}_a") for v in values})


def audit_offsets(stems: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """(n, worst): the greatest distance of recorded (E, N) from recomputed (x, y) positions in a sample by hash."""
    from .selection import audit

    off = F.sqrt((F.col("x") - F.col("E")) * (F.col("x") - F.col("E")) + (F.col("y") - F.col("N")) * (F.col("y") - F.col("N")))
    return audit(stems, key, n, seed).agg(F.count("*").alias("n"), F.max(off).alias("worst"))
