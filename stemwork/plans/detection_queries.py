"""Queries of the detection family: guards, extents, crown boxes, field crowns, crowns of seeds, project ranking,
held-out optima, credit grids, the reference population and raster helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from stemwork.functions import scalars as S
from stemwork.operators import clustering, detections as D, ground_truth, matching, pooling, rasters, scoring, selection, spatial, statistics
from stemwork.sources.tables import check_columns

from .fixtures import ctes, fixture
from .spatial_queries import CREDIT_GRID, D2, blocks, greedy_match, plots_of, sides, walk_sql

#: Corner (x0, y1) and cell of the grids that the queries here share.
CORNER, RES = (-64.0, 64.0), 2.0


def _cell(x: str = "x", y: str = "y") -> dict:
    return {"row": (F.floor((CORNER[1] - F.col(y)) / RES) + 1).cast("int"), "col": (F.floor((F.col(x) - CORNER[0]) / RES) + 1).cast("int")}


def lower_rungs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = fixture(spark, sf_dir, "plots").select("stratum", "plot", F.when(F.col("plot") % 10 != 0, F.col("metric") / 1000).alias("pdens"))
    return D.lower_rungs(p, [8, 4, 2, 1]).select("stratum", "plot", "rung")


def matched_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = fixture(spark, sf_dir, "scored_cells")
    return cells.where(D.near_value(F.col("chm_res") + 1e-12, S.resolution("frdens"))).select("site", "plot", "rung", "detector", "chm_res")


def clean_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = fixture(spark, sf_dir, "items").select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 20).alias("class"), (F.col("l_partkey") % 7 == 0).alias("withheld"), (F.col("l_quantity") * 2 - 10).alias("z"))
    return D.clean_returns(p).select("l_orderkey", "l_linenumber", "z")


def box_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = fixture(spark, sf_dir, "points")
    chm = rasters.surface(p.where("arm = 'chm_vwf'"), ["cell"], RES, corner=CORNER)
    boxes = p.where("arm = 'deepforest'").select("cell", "point", "x", "y", (F.col("z") / 20).alias("score"))
    return D.boxes_to_detections(boxes, chm, ["cell"], *CORNER, RES, least=0.4).select("cell", "point", "z")


def extent_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    dets = sides(spark, sf_dir)[1].join(plots_of(spark, sf_dir), "cell")
    return D.extents(dets, "recall").select("cell", "det", "in_core", "in_recall_region")


def seed_set_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = fixture(spark, sf_dir, "points").withColumn("match", F.when(F.col("point") % 3 != 0, F.when(F.col("z") > 14, F.col("point")).otherwise(0)))
    return D.any_match(p, ["cell", "arm"])


def exact_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = fixture(spark, sf_dir, "orders")
    return D.exact_year(o, "o_orderdate", 1995).select("o_orderkey", "o_custkey")


def core_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    stems, dets = sides(spark, sf_dir)
    return D.labelled_core(stems, dets, plots_of(spark, sf_dir), ["cell"]).select("cell", "det", "label")


def top_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.top_seeds(fixture(spark, sf_dir, "points"), ["cell", "arm"], 3).select("cell", "arm", "point")


def _own_and_field(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Stems with a diameter of their own, and the field's diameters of some of them."""
    stems = sides(spark, sf_dir)[0].select("cell", "stem", F.when(F.col("stem") % 3 != 0, F.col("z")).alias("max_cd"), F.lit(1.0).alias("ninety_cd"))
    field = fixture(spark, sf_dir, "part").select(F.col("p_partkey").alias("stem"), F.when(F.col("p_size") % 4 != 0, F.col("p_size").cast("double")).alias("max_cd"), F.when(F.col("p_size") % 3 != 0, F.col("p_retailprice")).alias("ninety_cd"))
    return stems, field


def field_crowns(spark: SparkSession, sf_dir: str) -> DataFrame:
    stems, field = _own_and_field(spark, sf_dir)
    return D.with_field_crowns(stems, field, "stem", ["max_cd", "ninety_cd"])


def filled_crowns(spark: SparkSession, sf_dir: str) -> DataFrame:
    stems, field = _own_and_field(spark, sf_dir)
    return D.filled_from_field(stems, field, "stem", "max_cd").select("cell", "stem", "max_cd")


def _crowns(spark: SparkSession, sf_dir: str) -> DataFrame:
    apexes = clustering.instance_apexes(blocks(spark, sf_dir), ["cell"])
    return apexes.select("cell", F.col("inst").alias("tree"), F.col("x").alias("cx"), F.col("y").alias("cy"), (F.col("inst") % 9).cast("double").alias("d_caliper"))


def _labels(spark: SparkSession, sf_dir: str, odd: int) -> DataFrame:
    """A raster of labels from the instances of even or odd points, the least of each cell."""
    b = blocks(spark, sf_dir).where(F.col("point") % 2 == odd).withColumns(_cell())
    return b.groupBy("cell", "row", "col").agg(F.min("inst").alias("label"))


def seed_crowns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The crown of each stem by its id, by the label of its cell and by the nearest centroid."""
    crowns = _crowns(spark, sf_dir)
    seeds = sides(spark, sf_dir)[0].select("cell", F.col("stem").alias("seed"), (F.col("stem") % 20).cast("int").alias("tree"), "x", "y").withColumns(_cell())
    out = None
    for by in ("id", "label", "nearest"):
        rows = D.crown_of_seeds(seeds, crowns, ["cell"], by, most=9.0, labels=_labels(spark, sf_dir, 1)).select("cell", "seed", "tree", F.lit(by).alias("by"))
        out = rows if out is None else out.union(rows)
    return out


def crown_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _labels(spark, sf_dir, 0), _labels(spark, sf_dir, 1)
    pairs = a.where("label > 0").select("cell", F.col("label").alias("a")).distinct().withColumn("b", F.col("a"))
    return D.crown_iou(pairs, a, b, ["cell"])


def project_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    plots = fixture(spark, sf_dir, "plots").select(F.col("stratum").alias("site"), (F.col("plot") % 100).cast("double").alias("x"), (F.col("plot") % 77).cast("double").alias("y"))
    n = fixture(spark, sf_dir, "nation")
    k = F.col("n_nationkey")
    name = F.concat(F.when(k % 3 == 0, "CA_").otherwise("NV_"), F.regexp_replace("n_name", " ", "_"), F.lit("_"), 2000 + k, F.when(k % 2 == 0, "_QL2").otherwise(""))
    x, y = k * 4.0, F.col("n_regionkey") * 15.0
    corner = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
    shapes = n.select(name.alias("name"), F.concat(F.lit("ept://"), "n_name").alias("url"), F.array(corner(x, y), corner(x + 20, y), corner(x + 20, y + 30), corner(x, y + 30)).alias("ring"))
    return D.ranked_projects(plots, shapes, 10.0)


def site_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = fixture(spark, sf_dir, "plots")
    plots = p.select(F.col("stratum").alias("site"), "plot", (F.col("plot") % 4 != 0).alias("swept"), (F.col("plot") % 16).cast("double").alias("density"))
    stems = p.select(F.col("stratum").alias("site"), (F.col("plot") % 5 != 0).alias("live"), (F.col("plot") % 40).cast("double").alias("height"))
    return D.site_summary(plots, stems)


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored cells with a resolution for each detector and a slope for each plot."""
    c = fixture(spark, sf_dir, "scored_cells").withColumn("chm_res", F.when(F.col("detector") == "A", 0.25).when(F.col("detector") == "N", 0.5).otherwise(1.0))
    return c.withColumn("vwf_a", F.when(F.col("plot").cast("long") % 2 == 0, 0.1).otherwise(0.2)).select("site", "plot", "rung", "detector", "n_ref", "n_det", "TP", "tp_core", "chm_res", "vwf_a")


def _chosen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(spark, sf_dir).select("site", "rung").distinct().withColumns({"vwf_a": F.lit(0.1), "chm_res": F.when(F.col("rung") == "native", 0.25).otherwise(0.5)})


def heldout_optimum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pooling.heldout_optimum(_cells(spark, sf_dir), _chosen(spark, sf_dir), ["site", "rung"])


def slope_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pooling.slope_spread(_cells(spark, sf_dir), _chosen(spark, sf_dir), ["site", "rung"])


def scope_equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    pooled = pooling.pool(fixture(spark, sf_dir, "scored_cells"), ["detector", "rung"], ())
    return pooling.equivalence(pooled.withColumnRenamed("detector", "scope"), "native", "2")


def credit_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    fps = fixture(spark, sf_dir, "points").select("cell", "point", F.col("arm").alias("fam"), "x", "y", (F.col("point") % 5 != 0).alias("eligible"))
    return clustering.sensitivity(fps, ["cell"], "chm_vwf")


def key_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = fixture(spark, sf_dir, "nation")
    return n.select("n_nationkey", S.seed_for("n_name", "n_nationkey", F.when(F.col("n_regionkey") % 2 == 0, F.col("n_regionkey").cast("string"))).alias("seed"))


def offset_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = fixture(spark, sf_dir, "points").select("point", "x", "y", (F.col("x") + F.col("point") % 3).alias("E"), (F.col("y") - F.col("point") % 5).alias("N"))
    return ground_truth.audit_offsets(p, "point", 50).withColumn("worst", F.round("worst", 9))


def crown_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = fixture(spark, sf_dir, "plots").select("plot", (F.col("plot") % 7).alias("n_under"), (F.col("plot") % 31).alias("n_over"))
    return selection.mix_class(p).select("plot", "crown_mix")


def unions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of two tables by all of their columns, and by the common ones."""
    a = fixture(spark, sf_dir, "nation").withColumn("a", F.col("n_nationkey") * 2)
    b = fixture(spark, sf_dir, "nation").where("n_regionkey = 1").select("n_name", "n_nationkey", F.col("n_regionkey").alias("b"))
    every = selection.union_fill(a, b).select("n_nationkey", "n_name", "n_regionkey", "a", "b", F.lit("fill").alias("kind"))
    common = selection.union_common(a, b).withColumn("kind", F.lit("common"))
    return selection.union_fill(every, common)


def stem_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions of mapped stems from their reference points; stems of unknown points have none."""
    mapped = fixture(spark, sf_dir, "items").select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 50).alias("ptloc"), F.col("l_quantity").alias("distance"), (F.col("l_partkey") % 360).cast("double").alias("azimuth"))
    points = fixture(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("ptloc"), (F.col("n_nationkey") * 10.0 + 500000).alias("easting"), (F.col("n_regionkey") * 10.0 + 4000000).alias("northing"), (F.col("n_nationkey") % 3).cast("double").alias("unc"))
    rows, _ = ground_truth.located(mapped, points)
    return rows.select("l_orderkey", "l_linenumber", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), "pos_unc")


def missing_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapped = fixture(spark, sf_dir, "items").select((F.col("l_partkey") % 50).alias("ptloc"), F.lit(1.0).alias("distance"), F.lit(0.0).alias("azimuth"))
    points = fixture(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("ptloc"), F.lit(0.0).alias("easting"), F.lit(0.0).alias("northing"), F.lit(0.0).alias("unc"))
    return ground_truth.located(mapped, points)[1]


def measured_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    stems = fixture(spark, sf_dir, "runs").select(F.col("plot").cast("long").alias("stem")).distinct()
    m = fixture(spark, sf_dir, "orders").select(F.col("o_custkey").alias("stem"), F.col("o_orderkey").alias("row"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), F.col("o_totalprice").alias("height"))
    return ground_truth.measured(stems, m, 1996).select("stem", "meas_year", "off", "height")


def _population(spark: SparkSession, sf_dir: str) -> DataFrame:
    stems = sides(spark, sf_dir)[0].select("stem", F.col("cell").alias("plot"), "x", "y", F.col("z").alias("height"), F.when(F.col("stem") % 4 == 0, "Partially shaded").when(F.col("stem") % 4 == 2, F.lit(None)).alias("position"), F.when(F.col("stem") % 10 == 0, "Standing dead").otherwise("Live").alias("status"))
    plots = plots_of(spark, sf_dir).select(F.col("cell").alias("plot"), F.when(F.col("cell") % 2 == 0, "tower").otherwise("distributed").alias("plot_type"), "cx", "cy")
    return ground_truth.population(stems, plots)


def living_population(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _population(spark, sf_dir).select("plot", "stem", "crown_class", "tile")


def population_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ground_truth.tiles(_population(spark, sf_dir))


def above_ground(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heights over a ground raster, where it has a cell."""
    p = fixture(spark, sf_dir, "points")
    ground = rasters.surface(p.where("arm = 'li2012'").withColumn("g", F.col("z") / 10), ["cell"], RES, "g", CORNER)
    kept, _ = rasters.above_ground(p.where("arm = 'deepforest'").select("cell", "point", "x", "y", "z"), ground, ["cell"], *CORNER, RES)
    return kept.select("cell", "point", "z")


def failed_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells that lose all their detections on a small ground raster."""
    p = fixture(spark, sf_dir, "points")
    ground = rasters.surface(p.where("arm = 'li2012' and cell % 3 = 0"), ["cell"], RES, "z", CORNER)
    kept, dropped = rasters.above_ground(p.where("arm = 'deepforest'").select("cell", "point", "x", "y", "z"), ground, ["cell"], *CORNER, RES)
    return rasters.failed_cells(kept, dropped, ["cell"])


def raster_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = fixture(spark, sf_dir, "points")
    chm = rasters.surface(p.where("point % 2 = 0"), ["cell"], RES, corner=CORNER)
    return rasters.lookup(p.where("point % 2 = 1").select("cell", "point", "x", "y"), chm, ["cell"], *CORNER, RES).select("cell", "point", "value")


def marker_raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = sides(spark, sf_dir)[0].select("cell", F.col("stem").alias("tree"), "x", "y")
    return rasters.markers(seeds, ["cell"], -10.0, 10.0, RES, 10, 10)


def cylinder_centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rasters.cylinders(fixture(spark, sf_dir, "points"), ["cell"], 8.0)


def structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = statistics.structure(fixture(spark, sf_dir, "points").withColumn("z", F.col("z") - 8), ["cell"])
    return s.select("cell", "cover", "gap", F.round("mean_ht", 9).alias("mean_ht"), F.round("height_cv", 9).alias("height_cv"))


def rumple(spark: SparkSession, sf_dir: str) -> DataFrame:
    chm = rasters.surface(fixture(spark, sf_dir, "points"), ["cell"], 4.0, corner=CORNER)
    return statistics.rumple(chm, ["cell"], 4.0).withColumn("rumple", F.round("rumple", 9))


def crown_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area, equivalent diameter, place and height of the labels of a raster."""
    top = rasters.surface(fixture(spark, sf_dir, "points"), ["cell"], RES, corner=CORNER)
    rows = _labels(spark, sf_dir, 0).join(top, ["cell", "row", "col"])
    out = rasters.crowns(rows, ["cell"], RES)
    return out.withColumns({c: F.round(c, 9) for c in ("d_eq", "cx", "cy")})


def circle_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture(spark, sf_dir, "points").where(S.in_circle("x", "y", F.lit(1.0), F.lit(-2.0), F.lit(6.0))).select("cell", "point")


def window_floors(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = fixture(spark, sf_dir, "part")
    return p.select("p_partkey", S.window_floor(F.col("p_size").cast("double") / 16).alias("least"), S.canopy_class(F.concat(F.element_at(F.array(*map(F.lit, ("Full sun", "Partially shaded", "Mostly shaded", "Full shade", "Unknown"))), (F.col("p_partkey") % 5 + 1).cast("int")), F.lit(" "))).alias("kind"), S.family(F.when(F.col("p_size") % 2 == 0, "li2012").otherwise("deepforest")).alias("fam"), S.utm_epsg(F.concat((F.col("p_partkey") % 70).cast("string"), F.lit("N"))).alias("epsg"))


def checked_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = check_columns(fixture(spark, sf_dir, "nation"), ["n_name", "rung"], {"rung": F.lit("native"), "n_name": F.lit("unused")})
    return rows.select("n_nationkey", "n_name", "rung")


def crowns_against_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    stems, _ = sides(spark, sf_dir)
    apexes = clustering.instance_apexes(blocks(spark, sf_dir), ["cell"]).withColumnRenamed("inst", "id")
    sizes = apexes.where("id % 5 <> 0").select("cell", "id", F.col("z").alias("d_eq"), (F.col("z") * 2).alias("d_caliper"))
    field = fixture(spark, sf_dir, "part").select(F.col("p_partkey").alias("stem"), F.col("p_size").cast("double").alias("max_cd"), F.col("p_retailprice").alias("ninety_cd"))
    out = scoring.crowns_against_field(sizes, apexes, stems, field, ["cell"])
    return out.withColumn("area", F.round("area", 6))


def wrong_by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    stems, dets = sides(spark, sf_dir)
    m = greedy_match(spark, sf_dir)
    wrong = dets.withColumnRenamed("det", "point").join(m.select("cell", F.col("det").alias("point")), ["cell", "point"], "left_anti").select("cell", "point", "x", "y")
    hit = stems.join(m.select("cell", "stem"), ["cell", "stem"], "left_semi").select("cell", "x", "y")
    return scoring.wrong_by_class(wrong, stems, hit, ["cell"])


def seed_heights(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = fixture(spark, sf_dir, "points")
    chm = rasters.surface(p.where("point % 4 = 0"), ["cell"], RES, corner=CORNER)
    tops = p.where("arm = 'li2012'").select("cell", "point", "x", "y", F.when(F.col("point") % 5 != 0, F.col("z")).alias("z"))
    return D.seed_heights(tops, chm, ["cell"], *CORNER, RES).select("cell", "point", "tree", "z")


def _clips(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    p = fixture(spark, sf_dir, "points").select("cell", "point", "x", "y", "z", F.when(F.col("point") % 4 == 0, 2).otherwise(5).alias("class"), (F.col("point") % 3).alias("ret"))
    return D.prepared_clips(p, plots_of(spark, sf_dir), ["cell"], 0.12, 2.0, 30, 7, 4.0)


def prepared_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _clips(spark, sf_dir)[0].select("cell", "point", "z")


def clip_densities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _clips(spark, sf_dir)[1]


def matcher_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pooled recall and precision of the greedy matcher by tolerance and upper height gate, in one plan."""
    stems, dets = sides(spark, sf_dir)
    # the nearest pairs go first, so a lesser tolerance takes the first pairs of a larger one
    by_gate = [D.parameter_grid(df, up=[4, 8]) for df in (stems.where("z is not null"), dets)]
    found = D.parameter_grid(matching.nearest_first(*by_gate, ["cell", "up"], 4.0, "up"), tol=[2, 3, 4])
    hits = found.where("dist <= tol").groupBy("tol", "up").agg(F.count("*").alias("TP"))
    n = stems.agg(F.count("*").alias("n_ref")).crossJoin(dets.agg(F.count("*").alias("n_det")))  # one row each
    return hits.crossJoin(F.broadcast(n)).select("tol", "up", "TP", S.rate("TP", "n_ref").alias("recall"), S.rate("TP", "n_det").alias("precision"))


QUERIES = {
    f.__name__: f for f in (
        seed_heights, prepared_points, clip_densities, matcher_grid,
        lower_rungs, matched_parameters, clean_returns, box_detections, extent_flags, seed_set_match, exact_year, core_labels, top_seeds, field_crowns, filled_crowns, seed_crowns, crown_overlaps, project_ranking,
        site_summary, heldout_optimum, slope_spread, scope_equivalence, credit_grid, key_seeds, offset_audit, crown_mix, unions, stem_locations, missing_locations, measured_stems, living_population, population_tiles, above_ground,
        failed_cells, raster_lookup, marker_raster, cylinder_centres, structure, rumple, crown_zones, circle_clip, window_floors, checked_columns, crowns_against_field, wrong_by_class,
    )
}

_P, _C = ctes("points"), ctes("scored_cells")
_S = f"{_P}, s AS (SELECT * FROM f_points WHERE point % 2 = 0), d AS (SELECT * FROM f_points WHERE point % 2 = 1)"
_ROW, _COL = "CAST(floor((64 - y) / 2.0) + 1 AS INT)", "CAST(floor((x + 64) / 2.0) + 1 AS INT)"
_GATE = "(b.z >= 0.5 * a.z AND b.z <= a.z + 8)"
_M = f"""c AS (SELECT a.cell, a.point AS stem, b.point AS det, sqrt({D2}) AS dist FROM s a JOIN d b ON a.cell = b.cell AND sqrt({D2}) <= 4 AND {_GATE}),
{walk_sql('c', 'stem', 'det', 'dist, stem, det')}, m AS (SELECT o.cell, stem, det FROM o JOIN w USING (cell, k) WHERE take)"""
_BL = "bl AS (SELECT cell, point, CAST((point // 4) % 15 AS INT) AS inst, x, y, z FROM f_points)"
_AP = f"{_BL}, ap AS (SELECT cell, inst, arg_max(x, (z, -point)) AS x, arg_max(y, (z, -point)) AS y, max(z) AS z FROM bl WHERE inst <> 0 GROUP BY ALL)"
_OWN = "s2 AS (SELECT cell, point AS stem, CASE WHEN point % 3 <> 0 THEN z END AS max_cd FROM f_points WHERE point % 2 = 0), f AS (SELECT p_partkey AS stem, CASE WHEN p_size % 4 <> 0 THEN CAST(p_size AS DOUBLE) END AS max_cd, CASE WHEN p_size % 3 <> 0 THEN p_retailprice END AS ninety_cd FROM part)"
_CELLS = f"""{_C}, k AS (SELECT site, plot, rung, detector, n_ref, n_det, TP, tp_core, CASE detector WHEN 'A' THEN CAST(0.25 AS DOUBLE) WHEN 'N' THEN CAST(0.5 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS chm_res, CASE WHEN CAST(plot AS BIGINT) % 2 = 0 THEN CAST(0.1 AS DOUBLE) ELSE CAST(0.2 AS DOUBLE) END AS vwf_a FROM f_scored_cells),
ch AS (SELECT DISTINCT site, rung, CAST(0.1 AS DOUBLE) AS vwf_a, CASE WHEN rung = 'native' THEN CAST(0.25 AS DOUBLE) ELSE CAST(0.5 AS DOUBLE) END AS chm_res FROM k)"""
_F1 = "CASE WHEN r + p > 0 THEN 2 * r * p / (r + p) END"
_POOL = "CASE WHEN sum(n_ref) > 0 THEN CAST(sum(TP) AS DOUBLE) / sum(n_ref) END AS r, CASE WHEN sum(n_det) > 0 THEN CAST(sum(tp_core) AS DOUBLE) / sum(n_det) END AS p"
_POP = """st AS (SELECT point AS stem, cell AS plot, x, y, z AS height, CASE WHEN point % 4 = 0 THEN 'codominant' END AS cls, CASE WHEN cell % 2 = 0 THEN 20 ELSE 10 END AS half FROM f_points WHERE point % 2 = 0 AND point % 10 <> 0),
ins AS (SELECT * FROM st WHERE abs(x) <= half AND abs(y) <= half), q AS (SELECT plot, count(height) AS k, quantile_cont(height, 0.33) AS a, quantile_cont(height, 0.66) AS b, quantile_cont(height, 0.9) AS c FROM ins GROUP BY plot),
pop AS (SELECT plot, stem, coalesce(cls, CASE WHEN k < 4 THEN NULL WHEN height <= a THEN 'suppressed' WHEN height <= b THEN 'intermediate' WHEN height <= c THEN 'codominant' ELSE 'dominant' END) AS crown_class,
CAST(CAST(floor(x / 1000) * 1000 AS BIGINT) AS VARCHAR) || '_' || CAST(CAST(floor(y / 1000) * 1000 AS BIGINT) AS VARCHAR) AS tile FROM ins JOIN q USING (plot))"""
_UNIT = "CAST(CAST('0x' || substr(md5({}), 1, 12) AS BIGINT) AS DOUBLE) / 281474976710656.0"


_CLIP = f"""p AS (SELECT *, CASE WHEN point % 4 = 0 THEN 2 ELSE 5 END AS class, point % 3 AS ret, CASE WHEN cell % 2 = 0 THEN 12 ELSE 8 END AS half FROM f_points), i AS (SELECT * FROM p WHERE abs(x) <= half AND abs(y) <= half QUALIFY count(*) OVER (PARTITION BY cell) >= 30),
dc AS (SELECT * FROM i QUALIFY row_number() OVER (PARTITION BY cell, floor(x / 5), floor(y / 5) ORDER BY {_UNIT.format(chr(39) + '0|' + chr(39) + ' || point')}, point) <= 3), e AS (SELECT * FROM dc QUALIFY count(*) FILTER (class = 2) OVER (PARTITION BY cell) >= 7),
fl AS (SELECT cell, floor(x / 4) AS gx, floor(y / 4) AS gy, min(z) AS g FROM e WHERE class = 2 GROUP BY ALL), pr AS (SELECT e.cell, e.point, e.z - g AS z, half, ret FROM e JOIN fl ON e.cell = fl.cell AND floor(e.x / 4) = gx AND floor(e.y / 4) = gy WHERE e.z - g >= -1 AND e.z - g < 80)"""
ORACLE_SQL = {
    "seed_heights": f"""WITH {_P}, r AS (SELECT cell, {_ROW} AS rw, {_COL} AS cl, max(z) AS v FROM f_points WHERE point % 4 = 0 GROUP BY ALL), t AS (SELECT p.cell, p.point, coalesce(v, CASE WHEN point % 5 <> 0 THEN z END) AS z FROM (SELECT *, {_ROW} AS rw, {_COL} AS cl FROM f_points WHERE arm = 'li2012') p LEFT JOIN r USING (cell, rw, cl))
SELECT cell, point, CAST(row_number() OVER (PARTITION BY cell ORDER BY point) AS INT) AS tree, z FROM t WHERE z IS NOT NULL""",
    "prepared_points": f"WITH {_P}, {_CLIP} SELECT cell, point, z FROM pr",
    "clip_densities": f"WITH {_P}, {_CLIP} SELECT cell, CAST(count(*) AS DOUBLE) / (4.0 * any_value(half) * any_value(half)) AS pdens, CAST(count_if(ret = 1) AS DOUBLE) / (4.0 * any_value(half) * any_value(half)) AS frdens FROM pr GROUP BY cell",
    "matcher_grid": f"""WITH RECURSIVE {_S}, g AS (SELECT * FROM (VALUES (CAST(2 AS DOUBLE)), (CAST(3 AS DOUBLE)), (CAST(4 AS DOUBLE))) a(tol), (VALUES (CAST(4 AS DOUBLE)), (CAST(8 AS DOUBLE))) b(up)),
c AS (SELECT a.cell * 100 + tol * 10 + up AS cell, tol, up, a.point AS stem, b.point AS det, sqrt({D2}) AS dist FROM s a CROSS JOIN g JOIN d b ON a.cell = b.cell AND sqrt({D2}) <= tol AND b.z >= 0.5 * a.z AND b.z <= a.z + up), {walk_sql('c', 'stem', 'det', 'dist, stem, det')},
h AS (SELECT tol, up, count(*) AS TP FROM o JOIN w USING (cell, k) WHERE take GROUP BY tol, up) SELECT tol, up, TP, CAST(TP AS DOUBLE) / (SELECT count(*) FROM s) AS recall, CAST(TP AS DOUBLE) / (SELECT count(*) FROM d) AS "precision" FROM h""",
    "lower_rungs": f"WITH {ctes('plots')} SELECT stratum, plot, r AS rung FROM f_plots, (VALUES (CAST(8 AS DOUBLE)), (CAST(4 AS DOUBLE)), (CAST(2 AS DOUBLE)), (CAST(1 AS DOUBLE))) v(r) WHERE plot % 10 <> 0 AND r < metric / 1000",
    "matched_parameters": f"WITH {_C} SELECT site, plot, rung, detector, chm_res FROM f_scored_cells WHERE abs(chm_res - CASE WHEN frdens >= 8 THEN 0.25 ELSE 0.5 END) < 1e-6",
    "clean_returns": "SELECT l_orderkey, l_linenumber, l_quantity * 2 - 10 AS z FROM lineitem WHERE l_partkey % 20 NOT IN (7, 18) AND l_partkey % 7 <> 0 AND l_quantity * 2 - 10 >= -1 AND l_quantity * 2 - 10 < 80",
    "box_detections": f"""WITH {_P}, r AS (SELECT cell, {_ROW} AS rw, {_COL} AS cl, max(z) AS v FROM f_points WHERE arm = 'chm_vwf' GROUP BY ALL)
SELECT p.cell, p.point, coalesce(r.v, 2.0) AS z FROM (SELECT *, {_ROW} AS rw, {_COL} AS cl FROM f_points WHERE arm = 'deepforest' AND z / 20 >= 0.4) p LEFT JOIN r USING (cell, rw, cl)""",
    "extent_flags": f"WITH {_S}, h AS (SELECT *, CASE WHEN cell % 2 = 0 THEN 10 ELSE 6 END AS half FROM d) SELECT cell, point AS det, abs(x) <= half AND abs(y) <= half AS in_core, true AS in_recall_region FROM h WHERE abs(x) <= half + 4 AND abs(y) <= half + 4",
    "seed_set_match": f"WITH {_P} SELECT cell, arm, coalesce(bool_or(point % 3 <> 0 AND z > 14 AND point > 0), false) AS has_match FROM f_points GROUP BY ALL",
    "exact_year": "SELECT o_orderkey, o_custkey FROM orders WHERE year(o_orderdate) = 1995",
    "core_labels": f"WITH RECURSIVE {_S}, {_M} SELECT d.cell, d.point AS det, CASE WHEN m.det IS NOT NULL THEN 1 ELSE 0 END AS label FROM d LEFT JOIN m ON d.cell = m.cell AND d.point = m.det WHERE abs(x) <= CASE WHEN d.cell % 2 = 0 THEN 10 ELSE 6 END AND abs(y) <= CASE WHEN d.cell % 2 = 0 THEN 10 ELSE 6 END",
    "top_seeds": f"WITH {_P} SELECT cell, arm, point FROM f_points QUALIFY row_number() OVER (PARTITION BY cell, arm ORDER BY z DESC, point) <= 3",
    "field_crowns": f"WITH {_P}, {_OWN} SELECT s2.cell, s2.stem, f.max_cd, f.ninety_cd FROM s2 JOIN f USING (stem) WHERE coalesce(f.max_cd, f.ninety_cd) IS NOT NULL",
    "filled_crowns": f"WITH {_P}, {_OWN} SELECT s2.cell, s2.stem, coalesce(f.max_cd, s2.max_cd) AS max_cd FROM s2 LEFT JOIN f USING (stem)",
    "seed_crowns": f"""WITH {_S}, {_AP}, lb AS (SELECT cell, {_ROW} AS rw, {_COL} AS cl, min(inst) AS tree FROM bl WHERE point % 2 = 1 GROUP BY ALL),
sd AS (SELECT *, CAST(point % 20 AS INT) AS tree, {_ROW} AS rw, {_COL} AS cl FROM s), n AS (SELECT a.cell, a.point, arg_min(b.inst, ({D2}, b.inst)) AS tree, min({D2}) AS d2 FROM sd a JOIN ap b ON a.cell = b.cell GROUP BY ALL)
SELECT sd.cell, sd.point AS seed, sd.tree, 'id' AS "by" FROM sd JOIN ap ON sd.cell = ap.cell AND sd.tree = ap.inst
UNION ALL SELECT sd.cell, sd.point, lb.tree, 'label' FROM sd JOIN lb USING (cell, rw, cl) JOIN ap ON ap.cell = sd.cell AND ap.inst = lb.tree WHERE lb.tree > 0
UNION ALL SELECT cell, point, tree, 'nearest' FROM n WHERE d2 <= greatest(tree % 9, 6) * greatest(tree % 9, 6)""",
    "crown_overlaps": f"""WITH {_P}, {_BL}, a AS (SELECT cell, {_ROW} AS rw, {_COL} AS cl, min(inst) AS l FROM bl WHERE point % 2 = 0 GROUP BY ALL), b AS (SELECT cell, {_ROW} AS rw, {_COL} AS cl, min(inst) AS l FROM bl WHERE point % 2 = 1 GROUP BY ALL),
i AS (SELECT a.cell, a.l, count(*) AS n FROM a JOIN b USING (cell, rw, cl, l) GROUP BY ALL), na AS (SELECT cell, l, count(*) AS na FROM a WHERE l > 0 GROUP BY ALL), nb AS (SELECT cell, l, count(*) AS nb FROM b GROUP BY ALL)
SELECT na.cell, na.l AS a, na.l AS b, coalesce(CAST(n AS DOUBLE) / (na + nb - n), 0) AS iou FROM na LEFT JOIN i USING (cell, l) LEFT JOIN nb USING (cell, l)""",
    "project_ranking": f"""WITH {ctes('plots')}, p AS (SELECT stratum AS site, plot % 100 AS x, plot % 77 AS y FROM f_plots), n AS (SELECT CASE WHEN n_nationkey % 3 = 0 THEN 'CA_' ELSE 'NV_' END || replace(n_name, ' ', '_') || '_' || (2000 + n_nationkey) || CASE WHEN n_nationkey % 2 = 0 THEN '_QL2' ELSE '' END AS name, 'ept://' || n_name AS url,
n_nationkey * 4 AS x0, n_regionkey * 15 AS y0, CASE WHEN n_nationkey % 3 = 0 THEN 100 ELSE 0 END + 10 + n_nationkey + CASE WHEN n_nationkey % 2 = 0 THEN 10 ELSE 0 END AS score FROM nation),
c AS (SELECT site, name, url, count(*) AS n_plots_covered, CAST(any_value(score) AS INT) AS score FROM p JOIN n ON x >= x0 AND x < x0 + 20 AND y >= y0 AND y < y0 + 30 GROUP BY ALL)
SELECT s.site, name, url, n_plots_covered, score, row_number() OVER (PARTITION BY s.site ORDER BY score DESC, n_plots_covered DESC, name) = 1 AS preferred FROM (SELECT DISTINCT site FROM p) s LEFT JOIN c ON s.site = c.site""",
    "site_summary": f"WITH {ctes('plots')} SELECT stratum AS site, count(*) AS n_plots, count_if(plot % 4 <> 0) AS n_swept, round(avg(plot % 16), 2) AS mean_density, count(*) AS n_stems, count_if(plot % 5 <> 0) AS n_live, round(avg(plot % 40) FILTER (plot % 5 <> 0), 2) AS mean_live_height FROM f_plots GROUP BY stratum",
    "heldout_optimum": f"""WITH {_CELLS}, h AS (SELECT k.* FROM k JOIN ch ON k.site = ch.site AND k.rung = ch.rung AND k.vwf_a = ch.vwf_a), nd AS (SELECT site, rung, count(DISTINCT chm_res) AS n FROM h GROUP BY ALL),
ok AS (SELECT site, rung, plot FROM h JOIN nd USING (site, rung) GROUP BY site, rung, plot, n HAVING count(DISTINCT chm_res) = n), wh AS (SELECT h.* FROM h SEMI JOIN ok USING (site, rung, plot)),
f AS (SELECT site, rung, chm_res, {_F1} AS F1 FROM (SELECT site, rung, chm_res, {_POOL} FROM wh GROUP BY ALL)), b AS (SELECT * FROM f WHERE F1 IS NOT NULL QUALIFY row_number() OVER (PARTITION BY site, rung ORDER BY F1 DESC, chm_res) = 1),
x AS (SELECT site, rung, max(F1) FILTER (chm_res = 0.5) AS t, count(F1) AS n FROM f GROUP BY ALL), pa AS (SELECT site, rung, count(DISTINCT plot) AS n FROM h GROUP BY ALL), pw AS (SELECT site, rung, count(DISTINCT plot) AS n FROM wh GROUP BY ALL)
SELECT ch.site, ch.rung, ch.vwf_a, ch.chm_res AS cal_chm_res, b.chm_res AS ho_chm_res, b.F1 AS ho_F1, x.t AS F1_at_target, coalesce(x.n, 0) AS n_res, coalesce(pw.n, 0) AS n_pool, coalesce(pa.n, 0) - coalesce(pw.n, 0) AS n_drop, b.chm_res = 0.5 AS is_target
FROM ch LEFT JOIN b USING (site, rung) LEFT JOIN x USING (site, rung) LEFT JOIN pa USING (site, rung) LEFT JOIN pw USING (site, rung)""",
    "slope_spread": f"""WITH {_CELLS}, h AS (SELECT k.* FROM k JOIN ch ON k.site = ch.site AND k.rung = ch.rung AND k.chm_res = ch.chm_res), f AS (SELECT site, rung, {_F1} AS F1 FROM (SELECT site, rung, vwf_a, {_POOL} FROM h GROUP BY ALL)),
x AS (SELECT site, rung, min(F1) AS f1_min, max(F1) AS f1_max FROM f GROUP BY ALL), n AS (SELECT site, rung, count(DISTINCT plot) AS n FROM h GROUP BY ALL) SELECT ch.site, ch.rung, ch.chm_res, f1_min, f1_max, f1_max - f1_min AS spread, coalesce(n.n, 0) AS n_pool FROM ch LEFT JOIN x USING (site, rung) LEFT JOIN n USING (site, rung)""",
    "scope_equivalence": f"""WITH {_C}, p AS (SELECT detector, rung, CAST(sum(n_ref) AS BIGINT) AS n_ref, CAST(sum(TP) AS BIGINT) AS TP, CAST(sum(TP) AS DOUBLE) / sum(n_ref) AS recall FROM f_scored_cells GROUP BY ALL)
SELECT a.detector AS scope, a.recall AS recall_a, a.n_ref AS n_ref_a, a.TP AS TP_a, b.recall AS recall_b, b.n_ref AS n_ref_b, b.TP AS TP_b, a.recall - b.recall AS delta_recall FROM p a JOIN p b ON a.detector = b.detector AND a.rung = 'native' AND b.rung = '2'""",
    "credit_grid": f"WITH RECURSIVE {_P}, {CREDIT_GRID} SELECT cell, radius, families, count(*) AS credited FROM kp GROUP BY ALL",
    "key_seeds": """WITH t AS (SELECT n_nationkey, n_name || '|' || n_nationkey || '|' || CASE WHEN n_regionkey % 2 = 0 THEN CAST(n_regionkey AS VARCHAR) ELSE 'native' END AS k FROM nation)
SELECT n_nationkey, CAST(list_reduce(list_transform(string_split(k, ''), lambda c: CAST(ascii(c) AS DOUBLE)), lambda h, c: ((h - (h % 128) + CAST(xor(CAST(h % 128 AS BIGINT), CAST(c AS BIGINT)) AS DOUBLE)) * 16777619) % 4294967296, CAST(2166136261 AS DOUBLE)) % 2147483648 AS BIGINT) AS seed FROM t""",
    "offset_audit": f"WITH {_P}, a AS (SELECT point FROM f_points ORDER BY {_UNIT.format(chr(39) + '0|' + chr(39) + ' || point')}, point LIMIT 50) SELECT count(*) AS n, round(max(sqrt((point % 3) * (point % 3) + (point % 5) * (point % 5))), 9) AS worst FROM a",
    "crown_mix": f"WITH {ctes('plots')} SELECT plot, CASE WHEN plot % 7 > 0 AND plot % 7 >= (plot % 31) / 4 THEN 'understory' ELSE 'overstory' END AS crown_mix FROM f_plots",
    "unions": """WITH a AS (SELECT n_nationkey, n_name, n_regionkey, n_nationkey * 2 AS a FROM nation), b AS (SELECT n_name, n_nationkey, n_regionkey AS b FROM nation WHERE n_regionkey = 1)
SELECT *, 'fill' AS kind FROM (SELECT * FROM a UNION ALL BY NAME SELECT * FROM b) UNION ALL BY NAME SELECT *, 'common' AS kind FROM (SELECT n_nationkey, n_name FROM a UNION ALL SELECT n_nationkey, n_name FROM b)""",
    "stem_locations": """SELECT l_orderkey, l_linenumber, round(n_nationkey * 10.0 + 500000 + l_quantity * sin(radians(l_partkey % 360)), 6) AS x, round(n_regionkey * 10.0 + 4000000 + l_quantity * cos(radians(l_partkey % 360)), 6) AS y, CAST(n_nationkey % 3 AS DOUBLE) AS pos_unc
FROM lineitem LEFT JOIN nation ON l_partkey % 50 = n_nationkey""",
    "missing_locations": "SELECT DISTINCT l_partkey % 50 AS ptloc FROM lineitem WHERE l_partkey % 50 NOT IN (SELECT n_nationkey FROM nation)",
    "measured_stems": "SELECT o_custkey AS stem, CAST(year(o_orderdate) AS INT) AS meas_year, CAST(abs(year(o_orderdate) - 1996) AS INT) AS off, o_totalprice AS height FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer) QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY abs(year(o_orderdate) - 1996), o_orderkey) = 1",
    "living_population": f"WITH {_P}, {_POP} SELECT * FROM pop",
    "population_tiles": f"WITH {_P}, {_POP} SELECT tile, count(*) AS n FROM pop GROUP BY tile",
    "above_ground": f"""WITH {_P}, g AS (SELECT cell, {_ROW} AS rw, {_COL} AS cl, max(z / 10) AS g FROM f_points WHERE arm = 'li2012' GROUP BY ALL) SELECT p.cell, p.point, p.z - g.g AS z FROM (SELECT *, {_ROW} AS rw, {_COL} AS cl FROM f_points WHERE arm = 'deepforest') p JOIN g USING (cell, rw, cl)""",
    "failed_cells": f"""WITH {_P}, g AS (SELECT DISTINCT cell, {_ROW} AS rw, {_COL} AS cl FROM f_points WHERE arm = 'li2012' AND cell % 3 = 0), p AS (SELECT *, {_ROW} AS rw, {_COL} AS cl FROM f_points WHERE arm = 'deepforest')
SELECT p.cell FROM p LEFT JOIN (SELECT *, true AS hit FROM g) g USING (cell, rw, cl) GROUP BY p.cell HAVING count(hit) = 0""",
    "raster_lookup": f"WITH {_P}, r AS (SELECT cell, {_ROW} AS rw, {_COL} AS cl, max(z) AS value FROM f_points WHERE point % 2 = 0 GROUP BY ALL) SELECT p.cell, p.point, value FROM (SELECT *, {_ROW} AS rw, {_COL} AS cl FROM f_points WHERE point % 2 = 1) p LEFT JOIN r USING (cell, rw, cl)",
    "marker_raster": f"""WITH {_S}, t AS (SELECT cell, point, CAST(floor((10 - y) / 2.0) + 1 AS INT) AS "row", CAST(floor((x + 10) / 2.0) + 1 AS INT) AS col FROM s) SELECT cell, "row", col, min(point) AS tree FROM t WHERE "row" BETWEEN 1 AND 10 AND col BETWEEN 1 AND 10 GROUP BY ALL""",
    "cylinder_centres": f"WITH {_P}, b AS (SELECT cell, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM f_points GROUP BY cell) SELECT DISTINCT cell, least(x1, x0 + i * 8.0) AS cx, least(y1, y0 + j * 8.0) AS cy FROM b, range(0, 40) a(i), range(0, 40) c(j) WHERE i <= ceil((x1 - x0) / 8) AND j <= ceil((y1 - y0) / 8)",
    "structure": f"""WITH {_P}, t AS (SELECT cell, z - 8 AS z FROM f_points) SELECT cell, CAST(count_if(z > 2) AS DOUBLE) / count(*) AS cover, 1 - CAST(count_if(z > 2) AS DOUBLE) / count(*) AS gap,
CASE WHEN count_if(z > 2) >= 20 THEN round(avg(z) FILTER (z > 2), 9) END AS mean_ht, CASE WHEN count_if(z > 2) >= 20 THEN round(stddev_samp(z) FILTER (z > 2) / avg(z) FILTER (z > 2), 9) END AS height_cv FROM t GROUP BY cell""",
    "rumple": f"""WITH {_P}, r AS (SELECT cell, CAST(floor((64 - y) / 4.0) + 1 AS INT) AS rw, CAST(floor((x + 64) / 4.0) + 1 AS INT) AS cl, max(z) AS v FROM f_points GROUP BY ALL)
SELECT a.cell, round(sum(2 * sqrt((b.v - a.v) * (b.v - a.v) + (c.v - a.v) * (c.v - a.v) + 16) + 2 * sqrt((d.v - b.v) * (d.v - b.v) + (d.v - c.v) * (d.v - c.v) + 16)) / (count(*) * 16), 9) AS rumple
FROM r a JOIN r b ON a.cell = b.cell AND b.rw = a.rw AND b.cl = a.cl + 1 JOIN r c ON a.cell = c.cell AND c.rw = a.rw + 1 AND c.cl = a.cl JOIN r d ON a.cell = d.cell AND d.rw = a.rw + 1 AND d.cl = a.cl + 1 GROUP BY a.cell""",
    "crown_zones": f"""WITH {_P}, {_BL}, l AS (SELECT cell, {_ROW} AS rw, {_COL} AS cl, min(inst) AS label FROM bl WHERE point % 2 = 0 GROUP BY ALL), t AS (SELECT cell, {_ROW} AS rw, {_COL} AS cl, max(z) AS v FROM f_points GROUP BY ALL)
SELECT cell, label, count(*) AS cells, round(avg(cl), 9) AS cx, round(avg(rw), 9) AS cy, max(v) AS top, CAST(count(*) * 4 AS DOUBLE) AS area, round(2 * sqrt(count(*) * 4 / pi()), 9) AS d_eq FROM l JOIN t USING (cell, rw, cl) WHERE label > 0 GROUP BY cell, label""",
    "circle_clip": f"WITH {_P} SELECT cell, point FROM f_points WHERE (x - 1) * (x - 1) + (y + 2) * (y + 2) <= 36",
    "window_floors": """SELECT p_partkey, greatest(2.0, round_even(2.5 / sqrt(CAST(p_size AS DOUBLE) / 16), 1)) AS least, CASE p_partkey % 5 WHEN 0 THEN 'dominant' WHEN 1 THEN 'codominant' WHEN 2 THEN 'intermediate' WHEN 3 THEN 'suppressed' END AS kind,
CASE WHEN p_size % 2 = 0 THEN 'pc' ELSE 'rgb' END AS fam, CASE WHEN p_partkey % 70 BETWEEN 1 AND 60 THEN CAST(32600 + p_partkey % 70 AS INT) END AS epsg FROM part""",
    "checked_columns": "SELECT n_nationkey, n_name, 'native' AS rung FROM nation",
    "crowns_against_field": f"""WITH RECURSIVE {_P}, s AS (SELECT * FROM f_points WHERE point % 2 = 0), {_AP}, d AS (SELECT cell, inst AS point, x, y, z FROM ap), {_M}
SELECT m.cell, m.stem, s.crown_class, x.d_eq, x.d_eq * 2 AS d_caliper, round(pi() * (x.d_eq / 2) * (x.d_eq / 2), 6) AS area, CAST(p_size AS DOUBLE) AS max_cd, p_retailprice AS ninety_cd
FROM m JOIN s ON m.cell = s.cell AND m.stem = s.point LEFT JOIN (SELECT cell, point, z AS d_eq FROM d WHERE point % 5 <> 0) x ON x.cell = m.cell AND x.point = m.det LEFT JOIN part ON p_partkey = m.stem""",
    "wrong_by_class": f"""WITH RECURSIVE {_S}, {_M}, wr AS (SELECT d.* FROM d LEFT JOIN m ON d.cell = m.cell AND d.point = m.det WHERE m.det IS NULL), ht AS (SELECT s.* FROM s JOIN m ON s.cell = m.cell AND s.point = m.stem),
k AS (SELECT a.cell, a.point, EXISTS (SELECT 1 FROM ht b WHERE b.cell = a.cell AND {D2} <= 16) AS near FROM wr a), n AS (SELECT a.cell, a.point, arg_min(b.crown_class, ({D2}, b.point)) AS crown_class FROM wr a JOIN s b ON a.cell = b.cell AND {D2} <= 400 GROUP BY ALL)
SELECT k.cell, crown_class, count_if(near) AS fp_near, count_if(NOT near) AS fp_isolated FROM k LEFT JOIN n USING (cell, point) GROUP BY ALL""",
}
