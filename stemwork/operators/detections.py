"""Filters and labels of detections, returns and crowns: guards of density, extents, crown boxes, field crowns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from stemwork.functions.scalars import finite, in_box
from stemwork.sources.scratch import checkpointed

from . import matching, rasters, scoring, spatial, tin

#: Classes of returns that are noise. Fixed values.
NOISE = (7, 18)


def _same(keys: list[str], prefix: str) -> list[Column]:
    """Conditions that keys are equal, NULL with NULL, to the columns with the prefix."""
    return [F.col(k).eqNullSafe(F.col(f"{prefix}{i}")) for i, k in enumerate(keys)]


def _named(df: DataFrame, keys: list[str], prefix: str, *more: Column) -> DataFrame:
    return df.select(*[F.col(k).alias(f"{prefix}{i}") for i, k in enumerate(keys)], *more)


def lower_rungs(plots: DataFrame, rungs: list[float], density: str = "pdens") -> DataFrame:
    """plots, once for each rung below their own density: points are thinned, never made. NULL densities have none."""
    return plots.withColumn("rung", F.explode(F.array(*[F.lit(float(r)) for r in rungs]))).where(F.col("rung") < F.col(density))


def near_value(a, b, apart: float = 1e-9) -> Column:
    """Whether two parameters are the same number but for rounding."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.coalesce(F.abs(a - b) < apart, F.lit(False))


def exact_year(rows: DataFrame, date: str, year: int) -> DataFrame:
    """Rows whose date, a date or a text that starts with the year, is of that year."""
    return rows.where(F.substring(F.col(date).cast("string"), 1, 4).try_cast("int") == year)


def clean_returns(points: DataFrame, kind: str = "class", withheld: str = "withheld", z: str = "z", low: float = -1.0, high: float = 80.0) -> DataFrame:
    """Points that are neither noise nor withheld, with heights in [low, high); NULL flags exclude nothing."""
    noise = F.coalesce(F.col(kind).isin(*NOISE), F.lit(False)) | F.coalesce(F.col(withheld).cast("int") == 1, F.lit(False))
    return points.where(~noise & (F.col(z) >= low) & (F.col(z) < high))


def boxes_to_detections(boxes: DataFrame, surface: DataFrame | None, keys: list[str], x0: float, y1: float, res: float, least: float = 0.0, floor: float = 2.0) -> DataFrame:
    """Crown boxes (keys, x, y, perhaps score) as detections: z is the surface's at the centre, `floor` where it has none.

    Boxes without a finite place, or with a score that is NULL or below `least`, go. surface: keys, row, col,
    value, with its corner at x0, y1; None is a surface without cells.
    """
    kept = boxes.where(finite("x") & finite("y"))
    if "score" in boxes.columns:
        kept = kept.where(F.col("score") >= least)
    if surface is None:
        return kept.withColumn("z", F.lit(float(floor)))
    rows = rasters.lookup(kept.drop("z"), surface, keys, x0, y1, res, "z")
    return rows.withColumn("z", F.when(finite("z"), F.col("z")).otherwise(float(floor)))


def extents(dets: DataFrame, keep: str = "recall", tol: float = 4.0) -> DataFrame:
    """dets (x, y, cx, cy, half) with in_core and in_recall_region, of the extent core, recall or all."""
    flags = {"in_core": in_box("x", "y", "cx", "cy", "half"), "in_recall_region": in_box("x", "y", "cx", "cy", F.col("half") + tol)}
    rows = dets.withColumns(flags)
    return rows if keep == "all" else rows.where({"core": "in_core", "recall": "in_recall_region"}[keep])


def any_match(seeds: DataFrame, keys: list[str], match: str = "match") -> DataFrame:
    """(keys, has_match): whether any seed set of the group has a match (a positive number); NULL is none."""
    return seeds.groupBy(*keys).agg(F.coalesce(F.bool_or(F.coalesce(F.col(match) > 0, F.lit(False))), F.lit(False)).alias("has_match"))


def top_seeds(seeds: DataFrame, keys: list[str], k: int, z: str = "z", item: str = "point") -> DataFrame:
    """The k highest seeds of each group, ties by item."""
    order = W.partitionBy(*keys).orderBy(F.col(z).desc_nulls_last(), item)
    return seeds.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k).drop("_r")


def labelled_core(stems: DataFrame, dets: DataFrame, plots: DataFrame, keys: list[str], tol: float = 4.0) -> DataFrame:
    """Detections inside their plot's core with label 1 if some stem is matched with them, else 0.

    plots: keys, cx, cy, half. All detections take part in the matching, those outside the core have no row.
    """
    found = matching.nearest_first(stems, dets, keys, tol)
    box = _named(plots, keys, "_b", "cx", "cy", "half")
    core = dets.join(box, _same(keys, "_b")).where(in_box("x", "y", "cx", "cy", "half")).drop("cx", "cy", "half", *[f"_b{i}" for i in range(len(keys))])
    hit = _named(found, keys, "_m", F.col("det").alias("_det"))
    rows = core.join(hit, [*_same(keys, "_m"), F.col("det") == F.col("_det")], "left")
    return rows.withColumn("label", F.col("_det").isNotNull().cast("int")).drop("_det", *[f"_m{i}" for i in range(len(keys))])


def with_field_crowns(stems: DataFrame, field: DataFrame, key: str, values: list[str]) -> DataFrame:
    """stems with the field table's values, which replace columns of theirs; those with no value at all go.

    field has one row a key, or the first of several counts.
    """
    one = field.dropDuplicates([key]).select(F.col(key).alias("_f"), *values)
    rows = stems.drop(*values).join(one, F.col(key) == F.col("_f"), "left").drop("_f")
    return rows.where(F.coalesce(*values).isNotNull())


def filled_from_field(stems: DataFrame, field: DataFrame, key: str, value: str) -> DataFrame:
    """stems with `value` from the field table where that has a finite one, else their own (NULL if they lack the column)."""
    own = F.col(value) if value in stems.columns else F.lit(None).cast("double")
    one = field.dropDuplicates([key]).select(F.col(key).alias("_f"), F.col(value).alias("_v"))
    rows = stems.withColumn(value, own).join(one, F.col(key) == F.col("_f"), "left")
    return rows.withColumn(value, F.when(finite("_v"), F.col("_v")).otherwise(F.col(value))).drop("_f", "_v")


def crown_of_seeds(seeds: DataFrame, crowns: DataFrame, keys: list[str], by: str, most: float = 6.0, least: float = 6.0, labels: DataFrame | None = None) -> DataFrame:
    """(keys, seed, tree): the crown of each seed that has one.

    by: id (the crown whose tree is the seed's tree), label (that of the raster's label in the seed's cell, the
    first of several) or nearest (the crown with the nearest centroid cx, cy, if that is within
    max(d_caliper, least)). seeds: keys, seed and tree, (row, col) or (x, y); labels: keys, row, col, label;
    most: the largest d_caliper, so that looking up to max(most, least) decides every seed.
    """
    if by == "nearest":
        centres = crowns.select(*keys, F.col("tree").alias("stem"), F.col("cx").alias("x"), F.col("cy").alias("y"), F.greatest(F.coalesce("d_caliper", F.lit(least)), F.lit(least)).alias("radius"))
        rows = spatial.assign(seeds.withColumnRenamed("seed", "point"), centres, keys, max(most, least))
        return rows.where("stem is not null").select(*keys, F.col("point").alias("seed"), F.col("stem").alias("tree"))
    if by == "label":
        at = _named(labels.where("label > 0"), keys, "_l", F.col("row").alias("_row"), F.col("col").alias("_col"), F.col("label").alias("tree"))
        seeds = seeds.drop("tree").join(at, [*_same(keys, "_l"), F.col("row") == F.col("_row"), F.col("col") == F.col("_col")])
        seeds = seeds.groupBy(*keys, "seed").agg(F.min("tree").alias("tree"))
    elif by != "id":
        raise ValueError("by is id, label or nearest")
    known = _named(crowns, keys, "_k", F.col("tree").alias("_tree")).distinct()
    return seeds.join(known, [*_same(keys, "_k"), F.col("tree") == F.col("_tree")], "left_semi").select(*keys, "seed", "tree")


def crown_iou(pairs: DataFrame, left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, a, b, iou) of matched crowns: cells that both have over cells that either has, 0 where none is shared.

    pairs: keys, a, b (labels); left, right: keys, row, col, label on one grid.
    """
    cells = _named(right, keys, "_r", F.col("row").alias("_row"), F.col("col").alias("_col"), F.col("label").alias("ref"))
    joined = left.select(*keys, "row", "col", F.col("label").alias("pred")).join(cells, [*_same(keys, "_r"), F.col("row") == F.col("_row"), F.col("col") == F.col("_col")], "full")
    joined = joined.select(*[F.coalesce(F.col(k), F.col(f"_r{i}")).alias(k) for i, k in enumerate(keys)], F.when(F.col("pred") > 0, F.col("pred")).alias("pred"), F.when(F.col("ref") > 0, F.col("ref")).alias("ref"))
    iou = _named(scoring.point_set_iou(joined, keys), keys, "_i", F.col("pred_id").alias("_p"), F.col("ref_id").alias("_f"), F.col("iou"))
    rows = pairs.join(iou, [*_same(keys, "_i"), F.col("a") == F.col("_p"), F.col("b") == F.col("_f")], "left")
    return rows.select(*keys, "a", "b", F.coalesce("iou", F.lit(0.0)).alias("iou"))


def covered(points: DataFrame, shapes: DataFrame, side: float) -> DataFrame:
    """Pairs of points and the shapes (ring: array of x, y) that cover them, by grid cells of the shapes' boxes.

    A shape meets the cells that its bounding box touches, a point its own one; so a shape of n cells has n rows.
    """
    low = lambda c: F.floor(F.array_min(F.transform("ring", lambda p: p[c])) / side).cast("long")
    high = lambda c: F.floor(F.array_max(F.transform("ring", lambda p: p[c])) / side).cast("long")
    cells = shapes.withColumn("_gx", F.explode(F.sequence(low("x"), high("x")))).withColumn("_gy", F.explode(F.sequence(low("y"), high("y"))))
    rows = points.withColumns({"_px": F.floor(F.col("x") / side).cast("long"), "_py": F.floor(F.col("y") / side).cast("long")})
    met = rows.join(cells, (F.col("_px") == F.col("_gx")) & (F.col("_py") == F.col("_gy")))
    return met.where(spatial.in_polygon("x", "y", "ring")).drop("_px", "_py", "_gx", "_gy")


def project_score(name) -> Column:
    """Preference of a survey project by its name: state, year and quality level count."""
    name = F.col(name) if isinstance(name, str) else name
    year = F.regexp_extract(name, "([12][0-9]{3})", 1).try_cast("int")
    return (
        F.when(name.startswith("CA_"), 100).otherwise(0)
        + F.when(year.between(1990, 2100), year - 1990).otherwise(0)
        + F.when(name.contains("QL2") | name.contains("_2_"), 10).otherwise(0)
    )


def ranked_projects(points: DataFrame, projects: DataFrame, side: float, site: str = "site") -> DataFrame:
    """(site, name, url, n_plots_covered, score, preferred): projects that cover plots of a site, the best preferred.

    points: site, x, y; projects: name, url, ring. The best has the greatest score, then coverage, then the
    first name; a site that nothing covers has one row without a name.
    """
    found = covered(points, projects, side).groupBy(site, "name", "url").agg(F.count("*").alias("n_plots_covered"))
    found = found.withColumn("score", project_score("name"))
    best = W.partitionBy(site).orderBy(F.col("score").desc(), F.col("n_plots_covered").desc(), "name")
    rows = found.withColumn("preferred", F.row_number().over(best) == 1)
    sites = points.select(F.col(site).alias("_s")).distinct()
    return sites.join(rows, F.col("_s").eqNullSafe(F.col(site)), "left").select(F.col("_s").alias(site), "name", "url", "n_plots_covered", "score", "preferred")


def site_summary(plots: DataFrame, stems: DataFrame, site: str = "site") -> DataFrame:
    """(site, n_plots, n_swept, n_stems, n_live, mean_density, mean_live_height), means to two decimals.

    plots: site, plot, swept, density; stems: site, live, height.
    """
    places = plots.groupBy(site).agg(F.count("*").alias("n_plots"), F.count_if("swept").alias("n_swept"), F.round(F.avg("density"), 2).alias("mean_density"))
    trees = stems.groupBy(F.col(site).alias("_s")).agg(F.count("*").alias("n_stems"), F.count_if("live").alias("n_live"), F.round(F.avg(F.when(F.col("live"), F.col("height"))), 2).alias("mean_live_height"))
    rows = places.join(trees, F.col(site).eqNullSafe(F.col("_s")), "left").drop("_s")
    return rows.na.fill(0, ["n_stems", "n_live"])


def seed_heights(tops: DataFrame, surface: DataFrame, keys: list[str], x0: float, y1: float, res: float) -> DataFrame:
    """Seeds of crowns: tops (keys, point, x, y, z) with the surface's height at them, else their own; tree counts those
    of a group that have a finite place and height, by point."""
    rows = rasters.lookup(tops, surface, keys, x0, y1, res, "_s").withColumn("z", F.when(finite("_s"), F.col("_s")).otherwise(F.col("z"))).drop("_s")
    kept = rows.where(finite("x") & finite("y") & finite("z"))
    return kept.withColumn("tree", F.row_number().over(W.partitionBy(*keys).orderBy("point")))


def prepared_clips(points: DataFrame, boxes: DataFrame, keys: list[str], per_area: float | None = None, buffer: float = 25.0, least: int = 100, ground: int = 10, res: float = 1.0, low: float = -1.0, high: float = 80.0, by: str = "grid", radius: float = 10.0) -> tuple[DataFrame, DataFrame]:
    """(points of each clip with heights above ground, (keys, pdens, frdens)): plots cut out with a buffer and normalized.

    points: keys, point, x, y, z, class, ret; boxes: keys, cx, cy, half. Clips of fewer than `least` points, or
    after thinning to per_area of fewer than `ground` ground points (class 2), go. By "grid" the ground of a cell of side
    res is its lowest ground point; by "tin" it is the triangulation of the ground points, with circumradii up to `radius`, found in grid cells of
    side res, and the nearest three ground points outside of it. Points without ground go, as do heights outside [low, high).
    Densities are of what is left over the clip's whole area, of all and of first returns.
    """
    from .selection import decimate, population

    n = len(keys)
    box = _named(boxes, keys, "_b", "cx", "cy", (F.col("half") + buffer).alias("half"))
    clip = points.join(box, _same(keys, "_b")).where(in_box("x", "y", "cx", "cy", "half")).drop(*[f"_b{i}" for i in range(n)])
    clip = population(clip, keys, least)
    clip = clip if per_area is None else decimate(clip, keys, per_area)
    enough = _named(clip.where("class = 2"), keys, "_g").groupBy(*[f"_g{i}" for i in range(n)]).count().where(F.col("count") >= ground)
    clip = clip.join(enough, _same(keys, "_g"), "left_semi")
    if by == "tin":
        clip = checkpointed(clip)
        known = tin.ground_heights(clip, clip.where("class = 2"), keys, radius, res, out="_z")
        rows = known.where("_z is not null").withColumn("z", F.col("z") - F.col("_z")).drop("_z")
    elif by == "grid":
        clip = clip.withColumns({"_r": F.floor(F.col("y") / res), "_c": F.floor(F.col("x") / res)})
        floor = _named(clip.where("class = 2"), keys, "_f", F.col("_r").alias("_fr"), F.col("_c").alias("_fc"), "z").groupBy(*[f"_f{i}" for i in range(n)], "_fr", "_fc").agg(F.min("z").alias("_z"))
        rows = clip.join(floor, [*_same(keys, "_f"), F.col("_r") == F.col("_fr"), F.col("_c") == F.col("_fc")]).withColumn("z", F.col("z") - F.col("_z"))
        rows = rows.drop("_r", "_c", "_fr", "_fc", "_z", *[f"_f{i}" for i in range(n)])
    else:
        raise ValueError("ground is by grid or by tin")
    rows = rows.where((F.col("z") >= low) & (F.col("z") < high))
    area = 4 * F.first("half") * F.first("half")
    densities = rows.groupBy(*keys).agg((F.count("*") / area).alias("pdens"), (F.count_if(F.col("ret") == 1) / area).alias("frdens"))
    return rows.drop("cx", "cy", "half"), densities


def parameter_grid(rows: DataFrame, **values: list[float]) -> DataFrame:
    """rows once for every combination of the parameters' values, which become columns of their own."""
    for name, some in values.items():
        rows = rows.withColumn(name, F.explode(F.array(*[F.lit(float(v)) for v in some])))
    return rows
